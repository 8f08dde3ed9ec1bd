"""Benchmark passages in documents, found by pigeonhole pieces and verified by edit distance.

Item and text are compared in small letters, with every run of other characters than letters
and digits as one blank. An item of n characters may differ by ``k = floor(error_rate * n)``
edits from some passage of the text. It is split into k + 1 pieces; k edits leave one piece at
least untouched, so every passage within k edits shows as an exact hit of a piece. All pieces
of a block of items are searched at once in one pass over the text, and every hit is verified
outwards, to both sides of the piece, by Myers' bit-parallel edit distance.

The items are the stated query set: they come to the driver in blocks of ``BLOCK_CHARS``, each
block travels with its own pass over the documents, and no text is ever shuffled.

Defined cases: null and empty texts hold nothing; items that are null or shorter than
``min_chars`` after cleaning are not searched, since they would hit by chance; equal items are
found each on its own; an empty benchmark leaves every document clean; repeated rows are judged
alike; other columns of the documents are passed through, but for one named like ``into``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items that are searched in one pass.
BLOCK_CHARS = 1_000_000
LEAK = "array<struct<item_id: long, edits: int, start: int, stop: int>>"
_OTHER = re.compile(r"[\W_]+")


def clean(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def edits_from(pattern: str, text: str, budget: int) -> tuple[int, int]:
    """Least edits that turn ``pattern`` into a prefix of ``text``, and that prefix's length.

    More than ``budget`` edits come back as ``budget + 1``. One machine integer holds a whole
    column of the distance table as differences between its rows.
    """
    m = len(pattern)
    if m <= budget:
        best = (m, 0)
    else:
        best = (budget + 1, 0)
    if not m:
        return best
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score = full, 0, m
    for j, c in enumerate(text, 1):
        same = at.get(c, 0)
        diagonal = (((same & rise) + rise) ^ rise) | same | fall
        up, down = fall | ~(diagonal | rise) & full, diagonal & rise
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise, fall = down | ~(diagonal | up) & full, diagonal & up
        if score < best[0]:
            best = (score, j)
        if not j & 15 and j < m:
            low = (1 << j) - 1  # the cell on the main diagonal is at most twice what is to come
            if j + (rise & low).bit_count() - (fall & low).bit_count() > 2 * budget:
                break
    return best


class Items:
    """A block of items and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        self.items = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, raw in items:
            body = clean(raw)
            if len(body) < max(min_chars, 1):
                continue
            budget = int(error_rate * len(body))
            self.items[item] = (body, budget)
            ends = [len(body) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(ends, ends[1:], strict=False):
                pieces.setdefault(body[a:b], []).append((item, a))
        self.pieces = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.pieces.add_word(piece, (len(piece), owners))
        if pieces:
            self.pieces.make_automaton()

    def leaks(self, raw: str | None) -> list[dict]:
        """The best passage of every item that the text holds."""
        if not raw or not self.items:
            return []
        text, found = clean(raw), {}
        for end, (size, owners) in self.pieces.iter(text):
            begin = end + 1 - size
            for item, at in owners:
                best = found.get(item)
                if best is not None and best[0] == 0:
                    continue
                body, budget = self.items[item]
                spare = budget if best is None else best[0]
                left, back = edits_from(
                    body[:at][::-1], text[max(0, begin - at - spare):begin][::-1], spare)
                if left > spare:
                    continue
                stop = end + 1
                right, on = edits_from(
                    body[at + size:], text[stop:stop + len(body) - at - size + spare - left], spare - left)
                this = (left + right, begin - back, stop + on)
                if this[0] <= budget and (best is None or this < best):
                    found[item] = this
        return [{"item_id": i, "edits": e, "start": a, "stop": b}
                for i, (e, a, b) in sorted(found.items())]


_BUILT: dict[int, Items] = {}


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    rows = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text)
    for i, body in rows.toLocalIterator():
        if block and held + len(body) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((i, body))
        held += len(body)
    yield block


def _finder(block: list[tuple[int, str]], error_rate: float, min_chars: int):
    key = hash((tuple(block), error_rate, min_chars))

    @F.pandas_udf(LEAK)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Items(block, error_rate, min_chars)
        for texts in batches:
            yield pd.Series([_BUILT[key].leaks(t) for t in texts])

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", error_rate: float = 0.08, min_chars: int = 24,
               into: str = "leaks") -> DataFrame:
    """``docs`` and, in ``into``, the items found with their edits and place in the clean text."""
    found = [_finder(block, error_rate, min_chars)(F.col(text))
             for block in _blocks(benchmark, item, item_text)]
    return docs.withColumn(into, F.concat(*found) if len(found) > 1 else found[0])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; their columns as they came."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    marked = with_leaks(rows, benchmark, **options)
    return marked.filter(F.size("leaks") == 0).select("row.*")
