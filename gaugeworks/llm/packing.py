"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document's ids are cut into full pieces and a rest. A piece costs ``linear * n +
quadratic * n * n`` (attention inside a piece). Full pieces fill a sequence each; the rests of a
block go, dearest first, to the cheapest sequence that still has room. A block opens just as
many sequences as its tokens need, so a rest that fits nowhere whole is cut over the roomiest
sequences, and a block pads less than one sequence.

Blocks are runs of rows inside a scan partition: nothing is shuffled, and a task holds one
block of rests at a time.

Defined cases: a null or empty text is the end token alone; rows with the same key are packed
as separate documents; null keys are kept; an empty table gives no pieces; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import tokens

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: Rests that are packed together.
BLOCK_RESTS = 8192
#: Characters that are encoded together, or one longer text.
GROUP_CHARS = 1 << 20
END = bytes(4)


class _Rooms:
    """Open sequences by room left; finds the cheapest one with enough room."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.heaps: list[list] = [[] for _ in range(self.leaves)]
        self.best: list = [None] * (2 * self.leaves)

    def _refresh(self, room: int) -> None:
        at = room + self.leaves
        self.best[at] = (*self.heaps[room][0], room) if self.heaps[room] else None
        while at > 1:
            at //= 2
            a, b = self.best[2 * at], self.best[2 * at + 1]
            self.best[at] = a if b is None or (a is not None and a <= b) else b

    def put(self, room: int, cost: float, sequence: int) -> None:
        heappush(self.heaps[room], (cost, sequence))
        self._refresh(room)

    def take(self, need: int):
        """(cost, sequence, room) of the cheapest sequence with ``need`` left, or None."""
        lo, hi, found = need + self.leaves, 2 * self.leaves, None
        while lo < hi:
            if lo & 1:
                if self.best[lo] is not None and (found is None or self.best[lo] < found):
                    found = self.best[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                if self.best[hi] is not None and (found is None or self.best[hi] < found):
                    found = self.best[hi]
            lo, hi = lo // 2, hi // 2
        if found is not None:
            heappop(self.heaps[found[2]])
            self._refresh(found[2])
        return found

    def roomiest(self):
        at = 1
        while at < self.leaves:
            at = 2 * at + 1 if self.best[2 * at + 1] is not None else 2 * at
        room = at - self.leaves
        cost, sequence = heappop(self.heaps[room])
        self._refresh(room)
        return cost, sequence, room


def pack(lengths: list[int], size: int, linear: float, quadratic: float) -> list[list[tuple]]:
    """Per rest its parts as (start in the rest, length, sequence, offset)."""
    count = -(-sum(lengths) // size)
    rooms = _Rooms(size)
    for sequence in range(count):
        rooms.put(size, 0.0, sequence)
    parts: list[list[tuple]] = [[] for _ in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            found = rooms.take(left)
            cost, sequence, room = found if found is not None else rooms.roomiest()
            n = min(left, room)
            parts[i].append((start, n, sequence, size - room))
            rooms.put(room - n, cost + linear * n + quadratic * n * n, sequence)
            start, left = start + n, left - n
    return parts


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1024,
                   vocabulary: str = tokens.DEFAULT_VOCABULARY, linear: float = 1.0,
                   quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies in its sequence."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.ids(vocabulary)
        next_id = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        rests: list[tuple] = []

        def cut(piece: bytes) -> int:
            return zlib.crc32(piece)

        def encoded(batch: pd.DataFrame) -> Iterator[tuple]:
            """Rows of the batch with their ids, a group of texts at a time."""
            keys, texts, at = batch["k"].array, batch["t"].tolist(), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= GROUP_CHARS):
                    held, end = held + len(texts[end]), end + 1
                yield from zip(keys[at:end], encode.of(texts[at:end]), strict=True)
                at = end

        def flush() -> None:
            nonlocal next_id
            for (doc, start, ids, total), parts in zip(
                    rests, pack([len(r[2]) // 4 for r in rests], size, linear, quadratic), strict=True):
                for at, n, sequence, offset in parts:
                    out.append((doc, start + at, n, cut(ids[4 * at:4 * (at + n)]), total,
                                next_id + sequence, offset))
            next_id += -(-sum(len(r[2]) // 4 for r in rests) // size)
            rests.clear()

        def frame() -> pd.DataFrame:
            columns = list(zip(*out, strict=True)) or [()] * 7
            done = pd.DataFrame({
                "doc_id": pd.array(columns[0], dtype="Int64"), "start": columns[1],
                "length": columns[2], "ids_crc32": columns[3], "doc_tokens": columns[4],
                "sequence_id": columns[5], "offset": columns[6]})
            out.clear()
            return done

        for batch in batches:
            for doc, ids in encoded(batch):
                ids += END
                total = len(ids) // 4
                full = total // size
                for i in range(full):
                    out.append((doc, i * size, size, cut(ids[4 * i * size:4 * (i + 1) * size]), total,
                                next_id, 0))
                    next_id += 1
                if total > full * size:
                    rests.append((doc, full * size, ids[4 * full * size:], total))
                if len(rests) >= BLOCK_RESTS:
                    flush()
            if out:
                yield frame()
        flush()
        if out:
            yield frame()

    plain = docs.select(F.col(key).cast("long").cast("string").alias("k"),
                        F.coalesce(F.col(text), F.lit("")).alias("t"))
    return plain.mapInPandas(_as_keys(rows), PIECES)


def _as_keys(rows):
    """Keys travel as text, since a pandas integer column cannot hold nulls."""
    def run(batches):
        for batch in rows(b.assign(k=pd.array([None if k is None else int(k) for k in b["k"]],
                                              dtype="Int64")) for b in batches):
            yield batch
    return run
