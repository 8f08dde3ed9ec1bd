"""Frequent phrases that are more than their parts, by Rabin-Karp fingerprints.

Texts become blocks, one row each: a few megabytes of one language, lower-cased, words apart by one
blank and pieces by a line break. In a block, prefix polynomials modulo 2**64 give the hash of every
word from its bytes and of every n-gram from its words, each by one subtraction and one product.

* Words and pairs leave as (fingerprint, block, count). A window over the fingerprint adds the
  counts; the frequent ones go back to the blocks that they point to, as one list a block. This
  only decides what is looked at again, so a collision here costs time and changes nothing.
* A longer n-gram can only be frequent if every pair in it is. Listed words and pairs, and triples
  and quadruples all of whose pairs are listed, leave as (fingerprint, check, block, count). Every
  word of a block is compared byte by byte with the first of its hash, and its check is a digest of
  its own bytes; an n-gram's check is made of those of its words. Counts are added by both numbers,
  so texts that share a fingerprint stay apart.
* Each frequent pair of numbers keeps one pointer, a block. That block writes out its phrase, after
  comparing all occurrences there with the first, byte by byte.

Texts travel as compressed blocks, n-grams as numbers, and only frequent phrases as strings, once
each. A block's list is never longer than the block.

Defined cases: null and blank texts have no words, a null language is ``und``; repeated rows count
each; a text longer than a block is cut between pieces, and a longer piece is a block of its own;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import kept_table

LONGEST = 4
MIN_COUNT = 30
#: A candidate goes if a longer one around it has at least this share of its occurrences.
SWALLOWED_PERCENT = 80
SCORE_UNIT = 2_000_000
KEEP = 2_000
BLOCK_BYTES = 8 << 20
#: Bytes of all languages together that a task holds before it writes its blocks.
HELD_BYTES = 64 << 20
#: Bytes whose prefix polynomial is held at once.
CHUNK_BYTES = 1 << 20
#: Parts of a language that are ranked by themselves before they meet.
RANK_PARTS = 256

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAKS))
#: Odd bases of the polynomials over bytes, word hashes and word digests.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MODULUS = 1 << 64
WIDE = "decimal(38,0)"


# ---- hashes --------------------------------------------------------------------------

@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, by doubling."""
    out = []
    for factor in (base, pow(base, -1, _MODULUS)):
        found = np.ones(1, dtype=np.uint64)
        while len(found) < size:
            found = np.concatenate([found, found * np.uint64(pow(factor, len(found), _MODULUS))])
        out.append(found)
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, (size - 1).bit_length()))


def scrambled(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; no two numbers meet."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix polynomial: entry i is the sum of ``values[j] * base**j`` for j < i."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0][:len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts]


class Block:
    """Words of a block: where they are, which piece they are in, and their hashes."""

    def __init__(self, body: bytes, lang: str):
        self.data = np.frombuffer(body, dtype=np.uint8)
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = (self.data != 32) & (self.data != 10)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed=1)
        self.hashes = scrambled(self._words() + (self.ends - self.starts).astype(np.uint64))
        self.prefix = prefix_sums(self.hashes, _BASES[1])

    def _words(self) -> np.ndarray:
        """Hash of each word from the bytes, some words at a time."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            origin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, origin + CHUNK_BYTES, side="right")))
            part = self.data[origin:self.ends[to - 1]].astype(np.uint64) + np.uint64(1)
            out[at:to] = span_hashes(prefix_sums(part, _BASES[0]), self.starts[at:to] - origin,
                                     self.ends[at:to] - origin, _BASES[0])
            at = to
        return out

    def whole(self, n: int) -> np.ndarray:
        """First words of the n-grams that lie in one piece."""
        last = len(self.starts) - n + 1
        if last <= 0:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1:])

    def fingerprints(self, first: np.ndarray, n: int) -> np.ndarray:
        return self._marks(self.prefix, first, n, _BASES[1])

    def checks(self, first: np.ndarray, n: int) -> np.ndarray:
        return self._marks(self.digests, first, n, _BASES[2])

    def _marks(self, prefix: np.ndarray, first: np.ndarray, n: int, base: int) -> np.ndarray:
        raw = span_hashes(prefix, first, first + n, base)
        return scrambled(raw ^ np.uint64((self.seed + n) % _MODULUS)).view(np.int64)

    @cached_property
    def digests(self) -> np.ndarray:
        """Prefix polynomial over a digest of every word's bytes."""
        order = np.argsort(self.hashes, kind="stable")
        heads, counts = groups(self.hashes[order])
        found = np.array([self.digest(i) for i in order[heads]], dtype=np.uint64)
        out = np.empty(len(order), dtype=np.uint64)
        out[order] = np.repeat(found, counts)
        for i in differing(self, order, heads, counts, 1):
            out[order[i]] = self.digest(order[i])
        return prefix_sums(out, _BASES[2])

    def digest(self, word: int) -> int:
        return xxhash.xxh3_64_intdigest(self.data[self.starts[word]:self.ends[word]].tobytes(), seed=2)


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def portions(items: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """``items`` in runs of about ``CHUNK_BYTES`` bytes."""
    total = np.cumsum(lengths)
    marks = np.arange(CHUNK_BYTES, total[-1] if len(total) else 0, CHUNK_BYTES)
    return np.split(items, np.unique(np.searchsorted(total, marks)))


def differing(block: Block, first: np.ndarray, heads: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Which of the n-grams, grouped by mark, do not have the bytes of their group's head."""
    starts = block.starts[first]
    lengths = block.ends[first + n - 1] - starts
    head_of = np.repeat(heads, counts)
    wrong = lengths != lengths[head_of]
    same = np.flatnonzero(~wrong & (head_of != np.arange(len(first))))
    for part in portions(same, lengths[same]):
        unequal = block.data[gathered(starts[part], lengths[part])] != block.data[
            gathered(starts[head_of[part]], lengths[part])]
        if unequal.any():
            wrong[np.repeat(part, lengths[part])[unequal]] = True
    return np.flatnonzero(wrong)


def phrases(block: Block, first: np.ndarray, marks: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
    """The first n-gram of each mark and its phrase, all others having been compared with it."""
    order = np.argsort(marks, kind="stable")
    first = first[order]
    heads, counts = groups(marks[order])
    if len(differing(block, first, heads, counts, n)):
        raise ValueError("two phrases share fingerprint and check")
    first = first[heads]
    lengths = block.ends[first + n - 1] - block.starts[first]
    data = block.data[gathered(block.starts[first], lengths)]
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
    return first, texts.cast(pa.string())


def groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and how long they are."""
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:len(ordered)])
    return heads, np.diff(np.r_[heads, len(ordered)])


# ---- blocks --------------------------------------------------------------------------

def normalised(parts: list[bytes]) -> bytes:
    """Translated texts as one body: one blank between the words of a piece, no empty pieces."""
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    blank, cut = data == 32, data == 10
    return data[~(blank & np.r_[True, (blank | cut)[:-1]]) & ~(cut & np.r_[True, cut[:-1]])].tobytes()


def cuts(body: bytes) -> Iterator[bytes]:
    """``body`` in parts of about a block, cut between pieces."""
    at = 0
    while len(body) - at > BLOCK_BYTES:
        end = body.rfind(b"\n", at, at + BLOCK_BYTES)
        end = end if end > at else body.find(b"\n", at + BLOCK_BYTES)
        if end < 0:
            break
        yield body[at:end]
        at = end + 1
    yield body[at:]


_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("body", pa.binary())])
_GRAM = pa.schema([("fp", pa.int64()), ("block", pa.int64()), ("n", pa.int64())])
_CHECKED = pa.schema([("fp", pa.int64()), ("check", pa.int64()), ("block", pa.int64()), ("n", pa.int64())])
_TEXT = pa.schema([("fp", pa.int64()), ("check", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``lang, body`` to blocks, numbered by task."""
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    packer = zstandard.ZstdCompressor(level=3)

    def written(lang: str) -> pa.RecordBatch:
        nonlocal number
        del sizes[lang]
        body = normalised(held.pop(lang))
        number += 1
        return pa.record_batch([[number], [lang], [len(Block(body, lang).starts)], [packer.compress(body)]], schema=_BLOCK)

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for part in cuts(text.as_py().encode().translate(_TABLE)):
                held.setdefault(lang, []).append(part)
                sizes[lang] += len(part) + 1
                if sizes[lang] >= BLOCK_BYTES:
                    yield written(lang)
            if sizes.total() >= HELD_BYTES:
                yield from [written(one) for one in list(held)]
    yield from [written(one) for one in list(held)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, Block, pa.Array | None]]:
    """Number, language, words and list of each block of the batches."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang = batch.column("lang")[row].as_py()
            body = zstandard.decompress(batch.column("body")[row].as_buffer())
            listed = batch.column("listed")[row].values if "listed" in batch.schema.names else None
            yield batch.column("block")[row].as_py(), lang, Block(body, lang), listed


def _listed(marks: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which marks are in the sorted list."""
    if not len(listed):
        return np.zeros(len(marks), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, marks), len(listed) - 1)] == marks


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of all words and pairs of each block."""
    for number, _, block, _ in _rows(batches):
        for n in (1, 2):
            marks = np.sort(block.fingerprints(block.whole(n), n))
            heads, counts = groups(marks)
            yield pa.record_batch([marks[heads], np.full(len(heads), number), counts], schema=_GRAM)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both numbers of listed words and pairs, and of longer n-grams of listed pairs."""
    for number, _, block, listed in _rows(batches):
        listed = np.sort(listed.to_numpy())
        paired = np.zeros(len(block.starts), dtype=bool)
        for n in range(1, LONGEST + 1):
            first = block.whole(n)
            if n <= 2:
                first = first[_listed(block.fingerprints(first, n), listed)]
            if n == 2:
                paired[first] = True
            for pair in range(n - 1 if n > 2 else 0):
                first = first[paired[first + pair]]
            marks, checks = block.fingerprints(first, n), block.checks(first, n)
            order = np.lexsort((checks, marks))
            marks, checks = marks[order], checks[order]
            heads = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]) | (checks[1:] != checks[:-1])][:len(marks)])
            yield pa.record_batch([marks[heads], checks[heads], np.full(len(heads), number),
                                   np.diff(np.r_[heads, len(marks)])], schema=_CHECKED)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of the listed n-grams."""
    for _, lang, block, listed in _rows(batches):
        both = np.sort(_joint(*(listed.field(i).to_numpy() for i in (0, 1))))
        for n in range(1, LONGEST + 1):
            first = block.whole(n)
            joint = _joint(block.fingerprints(first, n), block.checks(first, n))
            known = _listed(joint, both)
            heads, texts = phrases(block, first[known], joint[known], n)
            yield pa.record_batch([block.fingerprints(heads, n), block.checks(heads, n), [lang] * len(heads), texts,
                                   np.full(len(heads), n)], schema=_TEXT)


def _joint(marks: np.ndarray, checks: np.ndarray) -> np.ndarray:
    return scrambled(marks.view(np.uint64) + scrambled(checks.view(np.uint64))).view(np.int64)


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of one to four words that occur ``least`` times or
    more, and ``lang, n`` with all words."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(text), F.lit("")).alias("body")).filter("body <> ''")
    blocks = kept_table(rows.mapInArrow(_pack, "block long, lang string, words long, body binary"), "none")
    bodies = blocks.select("block", "lang", "body")
    # A fingerprint has one row a block, so no window is longer than there are blocks.
    short = bodies.mapInArrow(_short, "fp long, block long, n long").withColumn(
        "_total", F.sum("n").over(Window.partitionBy("fp"))).filter(F.col("_total") >= least)
    listed = short.groupBy("block").agg(F.collect_list("fp").alias("listed"))
    grams = bodies.join(listed, "block").mapInArrow(_checked, "fp long, check long, block long, n long")
    frequent = kept_table(grams.groupBy("fp", "check").agg(
        F.sum("n").alias("f"), F.min("block").alias("block")).filter(F.col("f") >= least))
    asked = frequent.groupBy("block").agg(F.collect_list(F.struct("fp", "check")).alias("listed"))
    texts = bodies.join(asked, "block").mapInArrow(
        _texts, "fp long, check long, lang string, phrase string, words long")
    found = texts.join(frequent.select("fp", "check", "f"), ["fp", "check"]).select(
        "lang", "phrase", F.col("words").cast("int").alias("words"), "f")
    return kept_table(found), blocks.groupBy("lang").agg(F.sum("words").alias("n"))


# ---- scores --------------------------------------------------------------------------

def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(found: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score, cut`` of every candidate at its lowest cut."""
    words = F.split("phrase", " ")
    candidates = found.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("_w"), "words")
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "cut", _joined(F.col("_w"), 1, F.col("cut")).alias("_left"),
        _joined(F.col("_w"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("_right"))
    # Parts of a candidate are at least as frequent, so both are found.
    for side, name in (("_left", "l"), ("_right", "r")):
        cut = cut.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"CAST(CAST(a AS {WIDE}) * {SCORE_UNIT} AS {WIDE}) div (CAST(l AS {WIDE}) + CAST(r AS {WIDE}))")
    lowest = F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("_low")
    return cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "_low.l", "_low.r", "_low.score", "_low.cut")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, keep: int = KEEP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language."""
    found, sizes = frequent_phrases(df, text, lang, least)
    inner = found.filter("words > 2").withColumn("_w", F.split("phrase", " ")).withColumn(
        "_length", F.explode(F.expr("sequence(2, words - 1)"))).withColumn(
        "_start", F.explode(F.expr("sequence(1, words - _length + 1)"))).select(
        "lang", _joined(F.col("_w"), F.col("_start"), F.col("_length")).alias("phrase"), "f")
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_around"))
    swallowed = 100 * F.col("_around").cast(WIDE) >= SWALLOWED_PERCENT * F.col("a").cast(WIDE)
    left = scored(found).join(around, ["lang", "phrase"], "left").filter(~F.coalesce(swallowed, F.lit(False)))
    # A language may hold most phrases, so its parts are cut to ``keep`` rows before they meet.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    for keys in (["lang", part], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= keep)
    return left.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
