"""Label classifiers: genre and taxonomy signals, log levels, error classes, meal labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import any_of, col, dedupe_text, has_any, literals

# Genre names and taxonomy tokens for and against a rock show.
POSITIVE_GENRES = (
    "rock", "hard rock", "metal", "alternative", "alternative rock", "punk", "punk rock",
)
NEGATIVE_GENRES = (
    "pop", "country", "r&b", "rnb", "other", "hip-hop/rap", "hip hop/rap", "latin", "jazz",
    "classical", "dance/electronic",
)
POSITIVE_TAXONOMY = (
    "concert", "rock", "indie", "metal", "alternative", "punk", "hard rock", "classic rock",
)
NEGATIVE_TAXONOMY = (
    "sports", "comedy", "theater", "family", "nfl", "nba", "mlb", "nhl", "mls", "ncaa",
    "monster truck", "wrestling", "rodeo",
)


def genre_signal(label: Column | str) -> Column:
    text = dedupe_text(label)
    return (
        F.when(text == "", "neutral")
        .when(text.isin(*POSITIVE_GENRES), "positive")
        .when(text.isin(*NEGATIVE_GENRES), "negative")
        .when(has_any(text, POSITIVE_GENRES), "positive")
        .when(has_any(text, NEGATIVE_GENRES), "negative")
        .otherwise("neutral")
    )


def taxonomy_tokens(label: Column | str) -> Column:
    parts = F.split(F.lower(F.coalesce(col(label), F.lit(""))), "[,/]")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def taxonomy_signal(label: Column | str) -> Column:
    """Exact negative tokens, then exact positive ones, then hints in token order."""
    tokens = taxonomy_tokens(label)

    def hint(token: Column) -> Column:
        return F.when(token.rlike("sport|comedy|theater"), "negative").when(
            token.rlike("rock|metal|concert"), "positive")

    hints = F.array_compact(F.transform(tokens, hint))
    return (
        F.when(F.size(tokens) == 0, "neutral")
        .when(F.arrays_overlap(tokens, literals(NEGATIVE_TAXONOMY)), "negative")
        .when(F.arrays_overlap(tokens, literals(POSITIVE_TAXONOMY)), "positive")
        .otherwise(F.coalesce(F.get(hints, F.lit(0)), F.lit("neutral")))
    )


# ---- logs ----------------------------------------------------------------------------

# Level tag, error words, and the words of each error class.
LEVEL_TAG = r"(?i)\[(WARNING|WARN|ERROR|CRITICAL)\]"
ERROR_WORDS = r"(?i)(ERROR|WARNING|WARN|Traceback|Exception|failed|blocked|timeout)"
CONFIG_WORDS = r"(?i)\bmissing required tuya\b|\bconfig\b|not configured"
CLOUD_WORDS = r"(?i)\b(cloud read|tuya cloud|sign|api key|unauthorized|forbidden)\b"
LOCAL_WORDS = r"(?i)\b(local read|tinytuya|deviceScan|connection|timeout|unreachable)\b"


def log_level(line: Column | str) -> Column:
    """Level in brackets, WARN as WARNING; null without one."""
    level = F.nullif(F.upper(F.regexp_extract(col(line), LEVEL_TAG, 1)), F.lit(""))
    return F.when(level == "WARN", "WARNING").otherwise(level)


def is_error_line(line: Column | str) -> Column:
    return col(line).rlike(ERROR_WORDS)


def error_class(message: Column | str) -> Column:
    m = col(message)
    return (
        F.when(m.rlike(CONFIG_WORDS), "config").when(m.rlike(CLOUD_WORDS), "cloud")
        .when(m.rlike(LOCAL_WORDS), "local").otherwise("api")
    )


# ---- meal labels ---------------------------------------------------------------------

# Words of vegetarian, unclear and meat labels.
VEGETARIAN = r"(?i)vegetarian|veggie|\bvegan\b|plant[\s-]?based"
UNCLEAR = r"(?i)cheese\s+pizza|^pizza$|mac\s+and\s+cheese"
MEAT = (
    r"(?i)chicken|beef|turkey|\bham\b|pork|pepperoni|\bmeat\b|burger|\btaco\b"
    r"|pasta\s+with\s+meat|nugget|sausage|bacon|fish|salmon"
)


def meal_class(label: Column | str) -> Column:
    text = F.trim(F.regexp_replace(col(label), r"\s+", " "))
    return (
        F.when(text == "", "uncertain")
        .when(text.rlike("^V-"), "vegetarian")
        .when(text.rlike(VEGETARIAN), "vegetarian")
        .when(text.rlike(UNCLEAR), "uncertain")
        .when(text.rlike(MEAT), "non_vegetarian")
        .otherwise("uncertain")
    )


def choose_meal(options: DataFrame, group: str, label: str, position: str) -> DataFrame:
    """One choice per group, by counts per class and the first meat label; every part is a
    mergeable aggregate, so a group of any size reduces before the shuffle.

    Labels count once per group, as keys of the classification do.
    """
    kind = meal_class(label)
    once = options.groupBy(group, label).agg(F.min(position).alias("_pos"))
    counted = once.withColumn("_kind", kind).groupBy(group).agg(
        F.count(F.lit(1)).alias("option_count"),
        F.count_if(F.col("_kind") == "vegetarian").alias("veg"),
        F.count_if(F.col("_kind") == "non_vegetarian").alias("meat"),
        F.min_by(label, F.when(F.col("_kind") == "non_vegetarian", F.col("_pos"))).alias("_pick"),
    )
    two = F.col("option_count") == 2
    reason = (
        F.when(two & (F.col("veg") == 1) & (F.col("meat") == 1), "two_choice_exclude_vegetarian")
        .when(F.col("meat") > 0, "preferred_non_vegetarian")
        .otherwise("UNCERTAIN_MEAL_SKIPPED")
    )
    return counted.select(group, F.col("_pick").alias("selected"), reason.alias("reason"))


def pattern_of(terms) -> str:
    return any_of(terms)
