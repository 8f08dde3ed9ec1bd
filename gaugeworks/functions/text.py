"""Text normalisers as column expressions: prices, identifiers, links, keys, list lines."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(terms: Iterable[str]) -> str:
    """Pattern that finds any of the literal terms; one regex pass instead of one per term."""
    return "(?:" + "|".join(re.escape(t) for t in terms) + ")"


def has_any(text: Column, terms: Iterable[str]) -> Column:
    return text.rlike(any_of(terms))


def literals(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_group(text: Column, pattern: str, *groups: int) -> Column:
    """First non-empty group of the pattern's first match, else null."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(text, pattern, g)) for g in groups])


def digits_to_int(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("int")


# ---- prices --------------------------------------------------------------------------

def price_text(raw: Column | str) -> Column:
    """First run of digits and commas after dropping ``$``, as whole dollars."""
    found = F.regexp_extract(F.regexp_replace(col(raw), r"\$", ""), r"[\d,]+", 0)
    return F.regexp_replace(found, ",", "").try_cast("int")


def price_minor_units(value: Column | str) -> Column:
    """Integer prices that may be in cents: 1000 and more are cents, 0 and less are none."""
    v = col(value)
    return F.when(v <= 0, F.lit(None)).when(v >= 1000, F.floor(v / 100)).otherwise(v).cast("int")


PRICE_STYLES = ("text", "minor_units")


def price(raw: Column | str, style: Column | str) -> Column:
    """Price by a configured style column, see :data:`PRICE_STYLES`."""
    return F.when(col(style) == "minor_units", price_minor_units(col(raw).try_cast("long"))).otherwise(
        price_text(raw)
    )


# ---- identifiers ---------------------------------------------------------------------

def identifier(value: Column | str) -> Column:
    """Stripped identifier without the leading apostrophe of spreadsheet exports."""
    return blank_to_null(F.trim(F.regexp_replace(F.trim(col(value)), r"^'", "")))


def hash_identifier(value: Column | str) -> Column:
    return F.substring(F.sha2(identifier(value), 256), 1, 16)


# ---- links ---------------------------------------------------------------------------

def absolute_link(href: Column | str, origin: str) -> Column:
    """Protocol-relative, rooted and bare paths made absolute on ``origin``."""
    h = F.trim(col(href))
    return (
        F.when(h == "", F.lit(None))
        .when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.startswith("/"), F.concat(F.lit(origin), h))
        .when(h.startswith("http"), h)
        .otherwise(F.concat(F.lit(origin + "/"), h))
    )


def canonical_link(href: Column | str, origin: str, product_path: str, strip: str = "?") -> Column:
    """Absolute link; on product pages everything from ``strip`` on and a last ``/`` go."""
    link = absolute_link(href, origin)
    cut = F.regexp_replace(F.substring_index(link, strip, 1), r"/+$", "")
    return F.when(link.contains(product_path), cut).otherwise(link)


def item_page_link(item_id: Column | str, raw: Column | str, origin: str, legacy: str, current: str):
    """Item page with one trailing ``/``; the legacy path is rewritten, anything that is not
    an item page falls back to the id."""
    link = absolute_link(raw, origin)
    host = re.escape(origin.split("//", 1)[1].removeprefix("www."))
    link = F.regexp_replace(link, rf"(?i)^https?://(?:www\.)?{host}{legacy}", origin + current)
    page = F.when(link.endswith("/"), link).otherwise(F.concat(link, F.lit("/")))
    built = F.concat(F.lit(origin + current), col(item_id), F.lit("/"))
    return F.when(link.rlike(f"(?i){host}{current}"), page).otherwise(built)


# ---- keys ----------------------------------------------------------------------------

def dedupe_text(value: Column | str) -> Column:
    """Lower case, everything but letters and digits collapsed to single spaces."""
    lowered = F.lower(F.coalesce(col(value), F.lit("")))
    return F.trim(F.regexp_replace(lowered, r"[^a-z0-9]+", " "))


def local_start_key(starts_at: Column | str) -> Column:
    """``YYYY-MM-DD HH:MM`` cut from the text itself; no zone conversion."""
    raw = F.trim(F.coalesce(col(starts_at), F.lit("")))
    clock = F.regexp_extract(raw, r"T(\d{2}:\d{2})", 1)
    day = F.substring_index(raw, "T", 1)
    with_t = F.when(clock != "", F.concat(day, F.lit(" "), clock)).otherwise(day)
    return F.when(raw.contains("T"), with_t).otherwise(F.substring(raw, 1, 16))


def show_key(title: Column | str, venue: Column | str, starts_at: Column | str) -> Column:
    """Show identity over title, venue and local start; empty when all three are."""
    parts = [dedupe_text(title), dedupe_text(venue), local_start_key(starts_at)]
    joined = F.concat_ws("|", *parts)
    return F.when(joined == "||", F.lit("")).otherwise(
        F.concat(F.lit("event|"), F.substring(F.sha1(joined), 1, 16))
    )


def provider_key(source: Column | str, event_id: Column | str) -> Column:
    return F.concat_ws("|", col(source), F.coalesce(col(event_id), F.lit("")))


# Plural endings of a single word and what is left of it, in this order. Words
# of three letters and fewer, and those in -ss, -us and -gs, stay.
PLURALS = (
    (r"^(\S{2,})ies$", "$1y"),
    (r"^(?=\S{4,}$)(\S*(?:o|x|ch|sh))es$", "$1"),
    (r"^(?=\S{4,}$)(\S*[^gsu])s$", "$1"),
)


def singular(word: Column) -> Column:
    """Conservative singular of one word; text with spaces passes unchanged.

    A chain of replacements that reads its input once: no ending survives an earlier rule,
    so the rules exclude each other.
    """
    for pattern, replacement in PLURALS:
        word = F.regexp_replace(word, pattern, replacement)
    return word


def name_key(text: Column | str) -> Column:
    """Lower case, punctuation to spaces (hyphens stay); a single word becomes singular."""
    cleaned = F.regexp_replace(F.lower(F.trim(col(text))), r"(?U)[^\w\s-]", " ")
    return singular(F.trim(F.regexp_replace(cleaned, r"(?U)\s+", " ")))


# ---- free-text item lists ------------------------------------------------------------

# Units that may stand between a quantity and a name.
LIST_UNITS = (
    "dozen", "dz", "lb", "lbs", "oz", "g", "kg", "pack", "packs", "ct", "count", "gal",
    "gallon", "bottle", "bottles", "bag", "bags",
)
_LINE = (
    r"(?i)^\s*(?:(\d+/\d+|\d+(?:\.\d+)?)\s*(?:x|×)?\s*)?"
    rf"(?:({'|'.join(LIST_UNITS)})\s+)?(.+?)\s*$"
)


def quantity(raw: Column) -> Column:
    """``2``, ``1.5`` or ``1/2``; 1 when it is missing or divides by zero."""
    upper = F.substring_index(raw, "/", 1).try_cast("double")
    lower = F.substring_index(raw, "/", -1).try_cast("double")
    value = F.when(raw.contains("/"), F.when(lower != 0, upper / lower)).otherwise(
        raw.try_cast("double")
    )
    return F.coalesce(value, F.lit(1.0))


def list_lines(text: Column | str) -> Column:
    """Cleaned lines of a list: comments, bullets and numbering removed, blanks dropped."""
    lines = F.split(col(text), r"[,;\n]+")
    lines = F.transform(lines, lambda x: F.trim(F.substring_index(x, "#", 1)))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•]+\s*", "")))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\d+[.)]\s+", "")))
    return F.filter(lines, lambda x: x != "")


def line_fields(line: Column) -> tuple[Column, Column, Column]:
    """(normalised name, quantity, unit) of one cleaned line; a dozen counts twelve."""
    raw_qty = blank_to_null(F.regexp_extract(line, _LINE, 1))
    unit = blank_to_null(F.lower(F.regexp_extract(line, _LINE, 2)))
    name = F.coalesce(blank_to_null(F.regexp_extract(line, _LINE, 3)), line)
    dozen = F.coalesce(unit.isin("dozen", "dz"), F.lit(False))
    amount = quantity(raw_qty) * F.when(dozen, 12.0).otherwise(1.0)
    return name_key(name), amount, F.when(~dozen, unit)


# ---- relevance -----------------------------------------------------------------------

def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([a-z0-9]+)"), F.lit(1))


# Query words too general to prove a match.
GENERIC_QUERY_TOKENS = (
    "for", "with", "and", "the", "item", "items", "sale", "buy", "used", "new",
)


def is_relevant(title: Column | str, query: Column | str, generic=GENERIC_QUERY_TOKENS) -> Column:
    """Title shares a strong query token (holds a digit or has three letters or more)."""
    ignored = literals(generic)
    strong = F.filter(
        tokens(query),
        lambda t: (F.length(t) > 1) & ~F.array_contains(ignored, t)
        & (t.rlike(r"\d") | (F.length(t) >= 3)),
    )
    blank = (F.coalesce(col(title), F.lit("")) == "") | (F.coalesce(col(query), F.lit("")) == "")
    return blank | (F.size(strong) == 0) | F.arrays_overlap(strong, tokens(title))


def lenient_list(raw: Column | str) -> Column:
    """A list cell: JSON array, else comma list, else a single value; blanks dropped."""
    text = F.trim(F.coalesce(col(raw), F.lit("")))
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    split = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda x: x != "")
    return F.coalesce(parsed, split)
