"""Near-duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint bit is set if it is set in over half of the hashes of the text's word shingles.
Fingerprints link at a small Hamming distance. To find the links, every distinct fingerprint
gets a table of its distances to fixed reference fingerprints, block of bits by block:

* blocks add up to the whole distance. Distances of two linked fingerprints to any reference
  differ by no more than their own distance, so a pair whose largest coordinate difference is
  greater is discarded before it is verified;
* with two more blocks than allowed bits, two linked fingerprints agree in two blocks at least,
  where all their distances to the references are equal. Tables are therefore joined on the rows
  of two blocks, so that no pair far apart is ever formed.

Where more fingerprints than ``bucket_limit`` share two rows (a large group of near copies),
their pairs are not formed: they are linked through their neighbours instead. Two fingerprints
within 4 bits have a common neighbour within 2 bits of either, and all fingerprints around one
neighbour are within 4 bits of each other, so linking each to the smallest around every
neighbour loses no connection. At most 2,081 fingerprints surround one neighbour.

Defined cases: null and empty texts have no words and the fingerprint zero, which links like
any other; repeated rows come out as often as they came in; a null key never becomes a
component id unless all keys of the component are null; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.components import connected
from gaugeworks.llm.shared import kept_table, lower_ascii, words

BITS = 64
REFERENCES = 16
_MASK = (1 << BITS) - 1


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


#: Reference fingerprints by a rule: odd multiples of the golden ratio of 64 bits.
PIVOTS = tuple(_signed((2 * i + 1) * 0x9E3779B97F4A7C15 & _MASK) for i in range(REFERENCES))


def shingle_hashes(tokens: str, shingle: int) -> Column:
    """XXH64 (seed 42) of every run of ``shingle`` words; shorter texts hash as one run."""
    rest = "".join(f", get({tokens}, i + {k})" for k in range(1, shingle))
    return F.expr(
        f"CASE WHEN size({tokens}) = 0 THEN array() "
        f"WHEN size({tokens}) < {shingle} THEN array(xxhash64(array_join({tokens}, ' '))) "
        f"ELSE slice(transform({tokens}, (w, i) -> xxhash64(concat_ws(' ', w{rest}))), 1, "
        f"size({tokens}) - {shingle - 1}) END")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``(key, fp, copies)``: the fingerprint of every text, equal rows as one with their number.

    Shingles are counted bit by bit, two bits to a counter, and summed map-side: one narrow row
    per text and task is shuffled, never a text or a shingle.
    """
    body = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    # Distinct texts of one key stay apart by their digest.
    base = df.select(F.col(key).alias("key"), F.unhex(F.md5(body)).alias("digest"),
                     words(body).alias("_words"))
    hashed = base.select("key", "digest", F.posexplode_outer(shingle_hashes("_words", shingle))
                         .alias("pos", "h"))
    pair = "4294967297L"  # bit i counts in the low half, bit i + 32 in the high half
    half = BITS // 2
    counted = hashed.groupBy("key", "digest").agg(
        F.count("h").alias("n"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"),
        *[F.expr(f"sum(shiftrightunsigned(h, {i}) & {pair})").alias(f"s{i}") for i in range(half)])

    def bit(count: str, i: int) -> Column:
        return F.expr(f"CASE WHEN 2 * ({count}) > n THEN {_signed(1 << i)}L ELSE 0L END")

    bits = [bit(f"s{i} & 4294967295L", i) for i in range(half)]
    bits += [bit(f"shiftrightunsigned(s{i}, 32)", half + i) for i in range(half)]
    return counted.select(F.col("key").alias(key), reduce(Column.bitwiseOR, bits).alias("fp"), "copies")


def _blocks(count: int) -> list[int]:
    """Masks of ``count`` near-equal blocks of bits."""
    ends = [BITS * i // count for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]


def _packed(items: list[str], width: int) -> Column:
    return F.expr(" | ".join(f"shiftleft(cast({x} AS long), {width * i})" for i, x in enumerate(items)))


def block_rows(distance: int) -> Column:
    """The table of ``fp`` by block: one long per block, 4 bits a reference."""
    return F.array(*[
        _packed([f"bit_count((fp ^ {p}L) & {_signed(m)}L)" for p in PIVOTS], 4)
        for m in _blocks(distance + 2)])


def whole_rows() -> list[Column]:
    """The table of ``fp`` over all bits: 8 bits a reference in ``far0`` and ``far1``."""
    whole = [f"bit_count(fp ^ {p}L)" for p in PIVOTS]
    return [_packed(whole[:8], 8).alias("far0"), _packed(whole[8:], 8).alias("far1")]


def _within(distance: int) -> str:
    """No coordinate of the two tables differs by more than ``distance``."""
    return " AND ".join(
        f"abs((shiftrightunsigned(x.{c}, {8 * i}) & 255) - (shiftrightunsigned(y.{c}, {8 * i}) & 255))"
        f" <= {distance}" for c in ("far0", "far1") for i in range(8))


def links(fps: DataFrame, distance: int = 4, bucket_limit: int = 64) -> DataFrame:
    """Edges ``(a, b)`` that connect just the fingerprints connected at ``distance`` or less.

    ``fps`` holds distinct fingerprints ``fp``; ``distance`` is 4, 6 or 8.
    """
    if distance not in (4, 6, 8):
        raise ValueError("distance must be 4, 6 or 8")
    tables = fps.select("fp", block_rows(distance).alias("rows"))
    pairs = list(combinations(range(distance + 2), 2))
    keyed = tables.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.col("rows")[i], F.col("rows")[j]) for k, (i, j) in enumerate(pairs)
    ])).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = kept_table(keyed.join(shared, "bucket"))
    few = met.filter(F.col("n") <= bucket_limit)
    sides = few.select("bucket", "fp", *whole_rows())
    near = (sides.alias("x").join(
        sides.alias("y"),
        F.expr(f"x.bucket = y.bucket AND x.fp < y.fp AND {_within(distance)} "
               f"AND bit_count(x.fp ^ y.fp) <= {distance}"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    crowd = met.filter(F.col("n") > bucket_limit).select("fp").distinct()
    return near.union(_neighbour_links(crowd, distance // 2)).distinct()


def _neighbour_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links every fingerprint to the smallest one around each of its neighbours."""
    flips = [_signed(sum(1 << i for i in at))
             for r in range(radius + 1) for at in combinations(range(BITS), r)]
    around = fps.select("fp", F.explode(F.transform(
        F.array(*[F.lit(x) for x in flips]), lambda m: m.bitwiseXOR(F.col("fp")))).alias("v"))
    return (around.selectExpr("fp AS b", "min(fp) OVER (PARTITION BY v) AS a")
            .filter("a < b").select("a", "b").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4,
                    distance: int = 4, bucket_limit: int = 64) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest key that can be reached over links."""
    found = kept_table(fingerprints(df, key, text, shingle))
    first = found.groupBy("fp").agg(F.min(key).alias("first"))
    roots = connected(links(first.select("fp"), distance, bucket_limit))
    placed = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return (found.join(named, "fp")
            .withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
            .select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                  distance: int = 4) -> DataFrame:
    """The rows of ``df`` whose key is its component's id: one document of each group.

    Rows that repeat key and text are one document, of which one row stays. A key that names
    several texts stays if it is the id of one of their components. Rows with the null key
    stay, since nothing tells them apart.
    """
    found = near_duplicates(df, key, text, shingle, distance)
    keys = found.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("_key")).distinct()
    firsts = df.join(keys, df[key] == keys["_key"], "left_semi").dropDuplicates([key, text])
    return firsts.union(df.filter(F.col(key).isNull()))
