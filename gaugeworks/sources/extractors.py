"""Listing extractors by name, as one table function that SQL can call.

    SELECT * FROM listing_cards(TABLE(SELECT page_id, html FROM pages), 'grid')

The table argument stays as it is partitioned, so pages are read where they lie; a caller who wants
them together by page writes ``PARTITION BY (page_id)``. A name that nobody registered gives no rows,
as a source without an extractor gives no listings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from gaugeworks.sources.pages import CARD_SCHEMA, JSON_SCRIPT, LAYOUTS, Layout, _Cards, _nodes, listings_of

#: Title, price text, location and link of a card.
Card = tuple[str | None, str | None, str | None, str | None]


def by_layout(layout: Layout) -> Callable[[str], Iterator[Card]]:
    def find(html: str) -> Iterator[Card]:
        parser = _Cards(layout)
        parser.feed(html)
        parser.close()
        for card in parser.cards:
            yield card.get("title"), card.get("price"), card.get("location"), card.get("href")

    return find


def _text(*values) -> str | None:
    return next((str(v) for v in values if v not in (None, "")), None)


def embedded_feed(html: str) -> Iterator[Card]:
    """Items in a page's data script."""
    blob = re.search(JSON_SCRIPT, html)
    try:
        tree = json.loads(blob.group(1)) if blob else None
    except ValueError:
        return
    for node in _nodes(tree, None):
        yield _text(node.get("title"), node.get("name")), _text(node.get("price")), _text(node.get("locationName")), _text(
            node.get("listingId"), node.get("id"))


def attribute_details(html: str, attribute: str = "data-vehicle-details") -> Iterator[Card]:
    """Cards whose details sit as JSON in an attribute."""
    for raw in re.findall(rf'{attribute}="([^"]*)"', html):
        try:
            d = json.loads(unescape(raw))
        except ValueError:
            continue
        title = " ".join(str(d[k]) for k in ("stockType", "year", "make", "model", "trim") if d.get(k))
        yield title or None, _text(d.get("price"), d.get("msrp")), None, _text(d.get("link"), d.get("listingId"))


EXTRACTORS: dict[str, Callable[[str], Iterable[Card]]] = {
    **{name: by_layout(layout) for name, layout in LAYOUTS.items()},
    "feed": embedded_feed, "attributes": attribute_details,
}


def named(name: str) -> str:
    return (name or "").strip().lower()


class ListingCards:
    """Cards of each page of a table with ``page_id`` and ``html``, by the extractor of a name."""

    def eval(self, page: Row, extractor: str):
        find = EXTRACTORS.get(named(extractor), lambda html: ())
        for position, card in enumerate(find(page["html"] or "")):
            yield (page["page_id"], position, *card)


def register(spark: SparkSession, name: str = "listing_cards") -> None:
    """Makes the table function known to the SQL of this session."""
    spark.udtf.register(name, udtf(ListingCards, returnType=CARD_SCHEMA))


def extracted(pages: DataFrame, extractor: str) -> DataFrame:
    """Listings of pages by a named layout, through the table function."""
    spark = pages.sparkSession
    register(spark)
    cards = spark.sql("SELECT * FROM listing_cards(TABLE(SELECT page_id, html FROM {pages}), {name})",
                      pages=pages, name=extractor)
    return listings_of(cards, LAYOUTS[named(extractor)])
