"""Line dedup over the corpus by segment-partition edit join, with DataFrame and SQL functions.

A line is dropped if an earlier line of the corpus (order: document key, then line number) is
equal to it or lies within a few edits: one edit per ``chars_per_edit`` characters of the
shorter line, ``MAX_EDITS`` at most.

* Equal lines are merged first, map-side, so that a line that stands in a third of all documents
  is one row from then on.
* A line that allows t edits is split into t + 1 segments. A line at most t longer and within t
  edits holds one of them unchanged, shifted by a bounded number of places, so it probes just
  those substrings (5 + 4 + 3 for two edits). Segments and probes are numbers; only keys that
  meet both ways go on, and only their lines' texts are looked up.
* Survivors with close character counts are verified by a banded bit-parallel edit distance: a
  band of 2t + 1 diagonals in one integer, stepped along the longer line.
* What is asked is whether an earlier line exists, so the last join is a semi join: a large
  group of near copies yields one row per line, never all its pairs.

Defined cases: null and empty texts have no lines; lines without a word are kept and never
compared; repeated rows (same key, same text) count as one document, so a line that stays does so
in each of them; rows of one key with other texts are documents of their own, ordered by a hash
of the text; null keys come last in the order; other columns are passed through by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import kept_table

MAX_EDITS = 2
CHARS_PER_EDIT = 25
#: A semi join side of at most so many line numbers (8 bytes each) travels to every task.
SMALL_IDS = 2_000_000
#: Keys are hashes of so many bits; two that are equal by chance cost one verification.
KEY_BITS = (1 << 48) - 1
_GROUPS = 16
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,0123456789"


def allowed(length: str) -> str:
    """Edits that a line of this length allows (SQL text)."""
    return f"least({MAX_EDITS}, cast({length} div {CHARS_PER_EDIT} AS int))"


def _places() -> list[tuple[int, int, int, int, bool]]:
    """Every piece that is looked at: edits that the shorter line allows, segment (from 0), how much
    shorter that line is, shift of the piece, and whether a line is filed under it or asks for it.

    Of ``edits`` edits some lie before a segment and the rest behind it, which bounds its shift
    from both ends.
    """
    out = []
    for edits in range(1, MAX_EDITS + 1):
        for i in range(edits + 1):
            out.append((edits, i, 0, 0, True))
            for shorter in range(edits + 1):
                low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
                out += [(edits, i, shorter, shift, False) for shift in range(low, high + 1)]
    return out


def keys_of(lines: DataFrame) -> DataFrame:
    """``(k, mark)`` of every piece of the lines ``(id, n, line)``: the hash of edits, segment,
    length of the shorter line and piece; ``mark`` is twice the id, plus one where it is filed.

    Segments divide a line evenly, later ones are longer. Characters take four bytes each, so
    that a piece is cut out without reading what is before it.
    """
    wide = lines.select("id", "n", F.encode("line", "UTF-32").alias("wide"))
    places = F.array(*[F.struct(F.lit(e).alias("edits"), F.lit(i).alias("i"), F.lit(short).alias("shorter"),
                                F.lit(shift).alias("shift"), F.lit(int(filed)).alias("filed"))
                       for e, i, short, shift, filed in _places()])
    spread = wide.select("id", "wide", F.col("n"), F.inline(places)).withColumn("m", F.expr("n - shorter"))
    fitting = spread.filter(f"{allowed('m')} = edits").withColumns({
        "base": F.expr("cast(m div (edits + 1) AS int)"), "longer": F.expr("m % (edits + 1)")})
    begin = "(1 + shift + i * base + greatest(0, i - edits - 1 + longer))"
    size = "(base + if(i >= edits + 1 - longer, 1, 0))"
    return fitting.filter(f"{begin} >= 1").select(
        F.expr(f"xxhash64(edits, i, m, substring(wide, 4 * {begin} - 3, 4 * {size})) & {KEY_BITS}").alias("k"),
        F.expr("2 * id + filed").alias("mark"))


def _signature(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("sig")


def _with_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sig, line_no, line)`` of every line with a word; ``sig`` tells texts of one key apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (df.select(F.col(key).alias("key"), _signature(text),
                      F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
            .filter(_with_word(F.col("line"))))


def _order() -> Column:
    """Document key, nulls last, then line number."""
    return F.struct(F.col("key").isNull().alias("no_key"), "key", "sig", "line_no")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """``(id, n, first, line)``: every distinct line with the place of its first occurrence. Keep
    the table before it is used: ``id`` holds for one run only."""
    return (lines.groupBy("line").agg(F.min(_order()).alias("first"))
            .select(F.monotonically_increasing_id().alias("id"), F.length("line").alias("n"), "first", "line"))


def band_distance(shorter: str, longer: str) -> str:
    """SQL text of the edit distance of two arrays of characters, right up to ``MAX_EDITS``.

    Bit b of a column stands for row (column - t + b): sums of vertical differences are kept as
    rises and falls, and the distance is read off the diagonal that ends in the last cell.
    """
    t, width = MAX_EDITS, 2 * MAX_EDITS + 1
    full = (1 << width) - 1
    start = sum(1 << b for b in range(t, width))
    same = " + ".join(f"if(get(p.x, j - {t} + {b}) <=> c, {1 << b}, 0)" for b in range(width))
    gap = "(size(p.y) - size(p.x))"
    up, down = f"((a.fall | ~(d | a.rise)) & {full})", "(d & a.rise)"
    step = (
        f"transform(array((((x.same & a.rise) + a.rise) ^ a.rise | x.same | a.fall) & {full}), d -> "
        f"named_struct('rise', ({down} | ~(shiftright(d, 1) | {up})) & {full}, "
        f"'fall', shiftright(d, 1) & {up}, "
        f"'far', a.far + if(x.j >= {gap} AND (d & shiftleft(1, {t} - {gap})) = 0, 1, 0)))[0]")
    # One-element arrays bind a value, so that it is worked out once.
    return (
        f"transform(array(named_struct('x', {shorter}, 'y', {longer})), p -> "
        f"aggregate(transform(p.y, (c, j) -> named_struct('same', {same}, 'j', j)), "
        f"named_struct('rise', {start}, 'fall', 0, 'far', {gap}), (a, x) -> {step}, a -> a.far))[0]")


def _counts() -> list[Column]:
    """Sixteen character counts modulo 256 in two longs."""
    out = []
    for half in range(2):
        packed = F.lit(0).cast("long")
        for i in range(8):
            group = _LETTERS[half * 8 + i::_GROUPS]
            count = F.length("line") - F.length(F.translate("line", group, ""))
            packed = packed + F.shiftleft((count % 128).cast("long"), 8 * i)
        out.append(packed.alias(f"chars{half}"))
    return out


def _close(t: str) -> str:
    """The counts of two lines within t edits differ by 2t at most, all groups together."""
    def off(c: str, i: int) -> str:
        x = f"abs((shiftright(r.{c}, {8 * i}) & 127) - (shiftright(s.{c}, {8 * i}) & 127))"
        return f"least({x}, 128 - {x})"
    return " + ".join(off(f"chars{h}", i) for h in range(2) for i in range(8)) + f" <= 2 * {t}"


def near_lines(distinct: DataFrame) -> DataFrame:
    """First places of the distinct lines that have an earlier line within their edits."""
    rows = keys_of(distinct.filter(F.col("n") >= CHARS_PER_EDIT))
    # One shuffle of two numbers a row; a key that a third of all lines share spills, it is not collected.
    every = Window.partitionBy("k")
    met = rows.select("k", "mark", *[F.expr(x).over(every).alias(name) for name, x in (
        ("low", "min(mark div 2)"), ("high", "max(mark div 2)"),
        ("any_asks", "min(mark & 1)"), ("any_filed", "max(mark & 1)"))])
    pairs = kept_table(met.filter("low <> high AND any_filed = 1 AND any_asks = 0").select(
        "k", F.expr("mark div 2").alias("id"), F.expr("mark & 1 = 1").alias("filed")))
    ids = pairs.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    texts = kept_table(distinct.join(ids, "id", "left_semi").select(
        "id", "n", "first", "line", *_counts()))
    sides = pairs.join(texts, "id")
    filed_side, asked_side = sides.filter("filed").alias("r"), sides.filter("NOT filed").alias("s")
    t = allowed("r.n")
    test = (f"r.k = s.k AND r.line <> s.line AND {_close(t)} AND "
            + band_distance("regexp_extract_all(r.line, '(?s).', 0)", "regexp_extract_all(s.line, '(?s).', 0)")
            + f" <= {t}")
    later = asked_side.join(filed_side, F.expr(f"{test} AND r.first < s.first"), "left_semi")
    shorter_later = filed_side.join(asked_side, F.expr(f"{test} AND s.first < r.first"), "left_semi")
    return later.select("first").union(shorter_later.select("first")).distinct()


def decisions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sig, kept, near)`` per document that holds the first place of any line: the numbers
    of its lines that stay, and of those that go because a near line is earlier."""
    distinct = kept_table(distinct_lines(lines_of(df, key, text)))
    near = near_lines(distinct).select("first.*", F.lit(True).alias("near"))
    places = distinct.select("first.*", F.lit(False).alias("near")).union(near)
    sides = places.groupBy("key", "sig").agg(
        F.collect_list(F.when(~F.col("near"), F.col("line_no"))).alias("firsts"),
        F.sort_array(F.collect_list(F.when(F.col("near"), F.col("line_no")))).alias("near"))
    return sides.select("key", "sig", F.array_except("firsts", "near").alias("kept"), "near")


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` of ``key`` and ``text`` with ``n`` lines with words, ``drop`` and ``near``."""
    found = found.select(F.col("key").alias("at"), F.col("sig").alias("of"), "kept", "near")
    own = rows.withColumn("sig", _signature("text"))
    joined = own.join(found, F.col("key").eqNullSafe(F.col("at")) & (F.col("sig") == F.col("of")), "left")
    none = F.array().cast("array<int>")
    body = F.coalesce(F.col("text"), F.lit(""))
    numbers = F.filter(
        F.transform(F.split(body, "\n"), lambda line, i: F.when(_with_word(line), i)),
        lambda i: i.isNotNull())
    return joined.withColumn("numbers", numbers).withColumns({
        "drop": F.array_except("numbers", F.coalesce("kept", none)),
        "near": F.coalesce("near", none), "n": F.size("numbers")})


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: lines with a word, the numbers of those dropped, and how many of
    them have no equal earlier line."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _joined(rows, decisions(df, key, text)).select(
        F.col("key").alias(key), F.col("n").alias("n_lines"), F.col("drop").alias("dropped"),
        F.size("near").alias("n_near"))


def clean(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without its dropped lines; a document that had lines with words and lost all of
    them goes. The text is the only column that changes."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(
        *[df[c] for c in df.columns if c != text]).alias("others"))
    joined = _joined(rows, decisions(df, key, text)).withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.expr("sequence(0, size(lines) - 1)"), F.col("drop"))
    cleaned = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    left = joined.filter((F.col("n") == 0) | (F.size("drop") < F.col("n")))
    return left.select(*[
        F.when(F.size("drop") > 0, cleaned).otherwise(F.col("text")).alias(text) if c == text
        else F.col("others").getField(c).alias(c) for c in df.columns])
