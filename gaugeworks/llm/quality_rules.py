"""Quality rules by distribution divergence, with DataFrame and SQL functions alone.

A document is compared with language references: the mean share of each character class and
of each common word over all documents of a language. The distance is Jensen-Shannon (root of
the divergence, base 2, 0 to 1). A document is kept when for one language both distances stay
below limits that loosen for short texts, where shares scatter by chance.

The first pass reduces every text to a few counts, kept as a narrow table; the references are
one row per language out of that table, so the texts are read once and never shuffled. ``keep``
keeps whole rows beside their counts and judges them where they lie.

Defined cases: null and blank texts have no words and fail the base rule; a table without any
reference document (or of an unknown language) rejects by the base rule alone; repeated rows
are judged alike; extra columns are passed through by ``keep`` and not looked at otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import kept_table, words

# Frequent function words.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "on"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "que", "est"),
    "de": ("der", "die", "und", "das", "in", "den", "von", "zu", "mit", "ist"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las"),
}
VOCABULARY = tuple(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))
#: Character classes besides small letters: white space, capitals, digits, sentence marks,
#: symbols; all others come last.
CLASSES = (r"\x20\x09-\x0D", r"\p{Lu}", r"\p{Nd}", r".,;:?'\"()\-", r"!#*$%&|<>")
SYMBOLS = "#*$%&|<>"
#: So many keys with rows of both verdicts travel to every task.
SMALL_KEYS = 500_000


@dataclass(frozen=True)
class Limits:
    min_words: int = 50  # base rule
    max_repeat_percent: int = 50  # base rule
    #: Largest distance of the class shares, and its rise over the root of the number of words.
    class_limit: float = 0.125
    class_scatter: float = 0.9
    word_limit: float = 0.19
    word_scatter: float = 1.05
    #: Below so many words the common words are not compared.
    min_words_for_words: int = 50


def repeat_counts(df: DataFrame, tokens: str = "_words") -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of three that occur twice or more in the row.

    Windows are hashed; where two are equal they are sorted, equal neighbours are repeats and
    their positions are merged into covered words: n log n in the length of a text.
    """
    df = df.withColumn("_windows", F.expr(
        f"slice(transform({tokens}, (w, i) -> xxhash64(w, get({tokens}, i + 1), "
        f"get({tokens}, i + 2))), 1, greatest(size({tokens}) - 2, 0))"))
    df = df.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) "
        "THEN sort_array(transform(_windows, (h, i) -> struct(h, i AS p))) END"))
    df = df.withColumn("_at", F.expr(
        "sort_array(transform(filter(_sorted, (s, i) -> coalesce(s.h = get(_sorted, i - 1).h, false) "
        "or coalesce(s.h = get(_sorted, i + 1).h, false)), s -> s.p))"))
    df = df.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(transform(_at, (p, i) -> least(3, coalesce(get(_at, i + 1) - p, 3))), "
        "0L, (a, x) -> a + x), 0L)"))
    return df.drop("_windows", "_sorted", "_at")


def histograms(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
               carried: Sequence[str] = ()) -> DataFrame:
    """Key, language, base counts, class counts and common-word counts of every whole text, and the
    ``carried`` columns.

    Most of a text is small letters; they are taken out once and the other classes are counted
    in what remains.
    """
    def counted(column: str, drop: str) -> Column:
        return F.length(column) - F.length(F.regexp_replace(column, drop, ""))

    df = df.select(key, lang, *carried, F.coalesce(F.col(text), F.lit("")).alias("_body"))
    df = repeat_counts(df.withColumn("_words", words(F.col("_body"))))
    df = df.select(
        "*",
        F.regexp_replace("_body", r"\p{Ll}+", "").alias("_rest"),
        F.filter(F.split("_body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.filter("_words", lambda w: w.isin(*VOCABULARY, *(w.capitalize() for w in VOCABULARY)))
        .alias("_common"))
    df = df.select(
        "*",
        F.array(F.length("_body") - F.length("_rest"),
                *[counted("_rest", f"[{c}]+") for c in CLASSES]).alias("_known"),
        F.concat(F.lit(" "), F.lower(F.array_join("_common", "  ")), F.lit(" ")).alias("_hit_text"))
    blank = F.lit("")
    hits = [((F.length("_hit_text") - F.length(F.replace("_hit_text", F.lit(f" {w} "), blank)))
             / (len(w) + 2)).cast("int") for w in VOCABULARY]
    return df.select(
        key, lang, *carried,
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_body") - F.col("_known")[1]).cast("long").alias("word_chars"),
        (F.length("_rest") - F.length(F.translate("_rest", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.concat("_known", F.array(F.length("_body") - F.aggregate(
            "_known", F.lit(0), lambda a, x: a + x))).alias("_classes"),
        F.array(*hits).alias("_hits"))


def shares(df: DataFrame) -> DataFrame:
    """Counts to shares: ``_p`` over classes, ``_q`` over common words and all other words."""
    return df.withColumns({
        "_p": F.expr("transform(_classes, c -> c / greatest(aggregate(_classes, 0, (a, x) -> a + x), 1))"),
        "_q": F.expr("transform(concat(_hits, array(cast(greatest(n_words - aggregate(_hits, 0, (a, x) "
                     "-> a + x), 0) AS int))), c -> c / greatest(n_words, 1))"),
    })


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def references(counted: DataFrame, limits: Limits, lang: str = "lang") -> dict[str, tuple[list, list]]:
    """Mean shares per language over all its documents that pass the base rule.

    At most one row per language of ``COMMON_WORDS`` comes to the driver.
    """
    sure = shares(counted.filter(F.col(lang).isin(*COMMON_WORDS)).filter(~base_failed(limits)))
    p = [F.avg(F.col("_p")[i]) for i in range(len(CLASSES) + 2)]
    q = [F.avg(F.col("_q")[i]) for i in range(len(VOCABULARY) + 1)]
    rows = sure.groupBy(lang).agg(F.array(*p).alias("p"), F.array(*q).alias("q")).collect()
    return {r[lang]: (list(r["p"]), list(r["q"])) for r in sorted(rows, key=lambda r: r[lang])}


def distance(shares_column: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of an array of shares from a fixed reference."""
    fixed = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    half = ("if({a} > 0, {a} * log2(2 * {a} / (p + r)), 0D)")
    term = f"{half.format(a='p')} + {half.format(a='r')}"
    total = f"aggregate(zip_with({shares_column}, {fixed}, (p, r) -> {term}), 0D, (a, x) -> a + x)"
    return F.expr(f"sqrt(greatest(0D, {total} / 2))")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          limits: Limits = Limits()) -> DataFrame:
    """One row per document: key, base counts, distances, ``base_failed`` and ``kept``."""
    return _verdicts(kept_table(histograms(df, key, text, lang)), [key], limits, lang)


def _verdicts(counted: DataFrame, carried: Sequence[str], limits: Limits, lang: str) -> DataFrame:
    found = references(counted, limits, lang)
    out = shares(counted).withColumn("base_failed", base_failed(limits))
    scatter = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    fits, names = F.lit(not found), []
    for i, (p, q) in enumerate(found.values()):
        out = out.withColumns({f"_dp{i}": distance("_p", p), f"_dq{i}": distance("_q", q)})
        near = F.col(f"_dp{i}") <= limits.class_limit + limits.class_scatter * scatter
        near &= (F.col(f"_dq{i}") <= limits.word_limit + limits.word_scatter * scatter) | (
            F.col("n_words") < limits.min_words_for_words)
        fits, names = fits | near, [*names, i]
    least = [F.array_min(F.array(*[F.col(f"_d{x}{i}") for i in names])) if names
             else F.lit(None).cast("double") for x in "pq"]
    return out.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & fits).alias("kept"),
        least[0].alias("class_distance"), least[1].alias("word_distance"))


def keep(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
         limits: Limits = Limits()) -> DataFrame:
    """The rows of ``df`` whose key has only kept texts; all columns as they came.

    Rows travel with their counts, so no text is shuffled back to its verdict; only keys with rows
    of both verdicts are joined. A null key cannot name a row, so such rows are judged, but stay
    only if their key's rows are all kept, the null key counting as one key.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"),
                     F.struct(*[df[c] for c in df.columns]).alias("_row"))
    counted = kept_table(histograms(rows, "_key", "_text", "_lang", carried=["_row"]))
    judged = _verdicts(counted, ["_key", "_row"], limits, "_lang")
    mixed = kept_table(judged.groupBy(F.col("_key").alias("_mixed")).agg(
        F.bool_and("kept").alias("_all"), F.bool_or("kept").alias("_any"))
        .filter("_any AND NOT _all").select("_mixed"))
    mixed = F.broadcast(mixed) if mixed.count() <= SMALL_KEYS else mixed
    return judged.filter("kept").join(
        mixed, F.col("_key").eqNullSafe(F.col("_mixed")), "left_anti").select("_row.*")
