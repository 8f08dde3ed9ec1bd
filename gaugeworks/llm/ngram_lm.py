"""Language model scores of documents: a trie of all words, pairs and triples of the training texts.

Tokens are words and one end per text. Every word has a number of its own, a hash of 62 bits; a
trie has words, below them the words that follow, and below those the third ones, each known there
by the first 40 bits of its number. None is left out, however rare. The trie is cut into parts by
range of the first word's number, as many as the corpus needs; words and pairs with very many nodes
below them are cut again by the word that follows. Documents lie in blocks of rows; each block sends
every part its branches of that trie, once each, with the block's training counts. The part adds the
counts up, builds an Elias-Fano trie of what was learned (``elias_fano.build_counts``), maps it and
finds the branches in it, level by level, for the counts that go back in the same order. With these
the block is scored. So no task holds more than one part, and a word that a third of all texts share
is one node per block and part.

A token's probability is its training count after the two tokens before it, with ``PRIOR`` more
observations shared out as the probability after one token says, and that likewise by the word's
own smoothed share. Each context therefore adds up to one.

Defined cases: a null or empty text is the end alone; without training documents every count is
zero and a token has the share 1 of the one unseen word; repeated rows count and are scored each;
null keys are scored and train; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.elias_fano import Trie, build, build_counts, packed, unpacked
from gaugeworks.llm.shared import WORD, kept_table, lower_ascii

ORDER = 3
#: Observations that the shorter context adds to a pair's and a triple's.
PRIOR = (20.0, 5.0)
DISCOUNT = 0.75
#: Characters of text to a part; the number of parts grows with the corpus.
PART_CHARS = 12_000_000
#: Rows and characters of a block; a longer text is a block of its own.
BLOCK_ROWS = 2048
BLOCK_CHARS = 8_000_000
#: Bits of a word's number that tell it apart below its context.
CODE_BITS = 40
#: So many nodes of all blocks lie below one word or pair in a part; one block in so many is counted for that.
SLICE_NODES = 250_000
SLICE_BLOCKS = 16
_LEAST_NODES = 64
_BITS = 13
#: Numbers in a trie of one piece (``model``) before its words: start and end of a text.
START, END = 0, 1
_END_WORD = " end"  # no word has a blank
_SPLIT = re.compile(WORD)
_BLOCK_ROW = pa.schema([
    ("block", pa.int64()), ("chars", pa.int64()), ("key", pa.list_(pa.string())),
    ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary())])
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _number(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def _mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each n-gram, from the numbers of all but its last word and of that."""
    x = (first ^ (first >> np.uint64(29))) * _SALT + last
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _tokens(bodies: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of each token among the distinct ones, these, and the tokens of each text."""
    flat: list[str] = []
    sizes = []
    for body in bodies:
        found = _SPLIT.findall(body)
        flat += found
        flat.append(_END_WORD)
        sizes.append(len(found) + 1)
    numbers, distinct = pd.factorize(np.array(flat, dtype=object))
    return numbers, list(distinct), np.array(sizes)


def blocked(df: DataFrame, held_out, key: str, text: str) -> DataFrame:
    """``block, chars, key, held_out, sizes, body``: neighbours in a partition of the input, one block a
    row; their texts are one compressed body, cut by ``sizes`` in bytes.

    A row is never divided between tasks, however the table is cut into files and row groups, so all
    that read a block later see the same texts.
    """
    most_rows, most_chars = BLOCK_ROWS, BLOCK_CHARS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        chars = 0

        def made() -> pa.RecordBatch:
            names, held_outs, texts = zip(*held, strict=True)
            data = [text.encode() for text in texts]
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(data))
            return pa.record_batch([[number], [chars], [names], [held_outs], [[len(x) for x in data]], [body]],
                                   schema=_BLOCK_ROW)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (len(held) == most_rows or chars + len(row[2]) > most_chars):
                    yield made()
                    number, chars, held = number + 1, 0, []
                held.append(row)
                chars += len(row[2])
        if held:
            yield made()

    rows = df.select(
        F.col(key).cast("string").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    return kept_table(rows.mapInArrow(
        pack, "block long, chars long, key array<string>, held_out array<boolean>, sizes array<long>, body binary"), "none")


def _texts(sizes, body: bytes) -> list[str]:
    """The texts of a block."""
    data, ends = zstandard.decompress(body), np.cumsum(sizes)
    return [data[end - size:end].decode() for size, end in zip(sizes, ends, strict=True)]


def _grams(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per token its two predecessors (or start) and itself."""
    begins = np.cumsum(sizes) - sizes
    one = np.concatenate([[START], ids[:-1]]) if len(ids) else ids
    one[begins] = START
    two = np.concatenate([[START], one[:-1]]) if len(ids) else ids
    two[begins] = START
    return np.stack([two, one, ids], axis=1)


def _code(grams: np.ndarray) -> np.ndarray:
    return (grams[:, 0] << 2 * _BITS) | (grams[:, 1] << _BITS) | grams[:, 2]


def _decode(codes: np.ndarray) -> np.ndarray:
    mask = (1 << _BITS) - 1
    return np.stack([codes >> 2 * _BITS, codes >> _BITS & mask, codes & mask], axis=1)


class _Block:
    """The distinct words, pairs and triples of some texts, by number and number of the words.

    ``numbers`` of the words, with ``start`` and ``end``; ``first`` and ``last`` word of the pairs,
    with ``starts``, the two starts of a text; ``before`` (a pair) and ``third`` word of the triples;
    ``at`` by level, which of it each token is."""

    def __init__(self, bodies: list[str]):
        at, distinct, self.sizes = _tokens(bodies)
        numbers = np.array([_number(" start"), *(_number(w) for w in distinct)], np.uint64) >> np.uint64(2)
        order = np.argsort(numbers, kind="stable")
        place = np.argsort(order, kind="stable")
        self.numbers = numbers[order].astype(np.int64)
        self.start, self.end = int(place[0]), int(place[distinct.index(_END_WORD) + 1])
        ids, wide, begins = place[at + 1], len(numbers), np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[self.start], ids[:-1]])
        before[begins] = self.start
        starts = self.start * wide + self.start
        pairs, pair_at = np.unique(np.append(before * wide + ids, starts), return_inverse=True)
        pair_at, self.starts = pair_at[:-1], int(pair_at[-1])
        self.first, self.last = pairs // wide, pairs % wide
        # The pair before a token is that of the token before it; a text begins after two starts.
        before = np.concatenate([[self.starts], pair_at[:-1]])
        before[begins] = self.starts
        triples, triple_at = np.unique(before * wide + ids, return_inverse=True)
        self.before, self.third = triples // wide, triples % wide
        # Pair of a triple's last two words, through any token that is both.
        self.pair_of_triple = np.empty(len(triples), np.int64)
        self.pair_of_triple[triple_at] = pair_at
        self.at = (ids, pair_at, triple_at)

    def pair_numbers(self) -> np.ndarray:
        words = self.numbers.astype(np.uint64)
        return (_mixed(words[self.first], words[self.last]) >> np.uint64(2)).astype(np.int64)

    def learned(self, held_out) -> list[np.ndarray]:
        """Training counts by level."""
        weight = np.repeat(~np.array(held_out, dtype=bool), self.sizes)
        return [np.bincount(at, weight, n).astype(np.int64)
                for at, n in zip(self.at, (len(self.numbers), len(self.first), len(self.before)), strict=True)]


def _ranges(parts: int) -> np.ndarray:
    """Where each part of the numbers of 62 bits begins, and the end."""
    return np.array([(i << 62) // parts for i in range(parts + 1)], np.int64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest of them needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _codes(numbers: np.ndarray) -> bytes:
    """Word codes in five bytes each."""
    codes = (numbers >> (62 - CODE_BITS)).astype("<i8")
    return codes.view(np.uint8).reshape(-1, 8)[:, :CODE_BITS // 8].tobytes()


def _of_codes(data: bytes) -> np.ndarray:
    few = np.frombuffer(data, np.uint8).reshape(-1, CODE_BITS // 8)
    whole = np.zeros((len(few), 8), np.uint8)
    whole[:, :CODE_BITS // 8] = few
    return whole.view("<i8").ravel().astype(np.int64)


class _Paths:
    """The branches of a block in the parts of the trie: by level and in order of the parts, ``nodes``
    (the block's words, pairs and triples), ``home`` (whether its count lies there, or the node is
    only passed through), ``cuts`` (where each part begins); ``owner`` of pairs and triples."""

    def __init__(self, texts: _Block, parts: int, crowded: dict[int, int]):
        begins = _ranges(parts)
        hot = np.array(sorted(crowded), np.int64)
        slices = np.array([crowded[x] for x in hot.tolist()], np.int64)

        def split(route: np.ndarray, context: np.ndarray, last: np.ndarray) -> np.ndarray:
            """The route below a context, by the word that follows where the context is crowded."""
            if not len(hot):
                return route
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            many = np.nonzero(hot[at] == context)[0]
            slice_of = (texts.numbers[last[many]] % slices[at[many]]).astype(np.uint64)
            out = route.copy()
            out[many] = (_mixed(context[many].astype(np.uint64), slice_of) >> np.uint64(2)).astype(np.int64)
            return out

        def part(route: np.ndarray) -> np.ndarray:
            return np.searchsorted(begins, route, side="right") - 1

        words, pairs = len(texts.numbers), len(texts.first)
        to_word = texts.numbers
        to_pair = split(to_word[texts.first], texts.numbers[texts.first], texts.last)
        to_triple = split(to_pair[texts.before], texts.pair_numbers()[texts.before], texts.third) if len(hot) else (
            to_pair[texts.before])
        home = [part(to_word), part(to_pair), part(to_triple)]
        own = np.flatnonzero(np.arange(pairs) != texts.starts)
        second, at = np.unique(np.concatenate([home[1][own] * pairs + own, home[2] * pairs + texts.before]),
                               return_inverse=True)
        part2, node2 = np.divmod(second, pairs)
        owner3 = at[len(own):]
        node3 = np.argsort(owner3, kind="stable")
        own = np.flatnonzero(np.arange(words) != texts.start)
        roots, at = np.unique(np.concatenate([home[0][own] * words + own, part2 * words + texts.first[node2]]),
                              return_inverse=True)
        part1, node1 = np.divmod(roots, words)
        self.nodes = (node1, node2, node3)
        self.owner = (None, at[len(own):], owner3[node3])
        self.home = ((part1 == home[0][node1]) & (node1 != texts.start),
                     (part2 == home[1][node2]) & (node2 != texts.starts), np.ones(len(node3), bool))
        self.cuts = [np.searchsorted(x, np.arange(parts + 1)) for x in (part1, part2, home[2][node3])]
        self.parts = np.flatnonzero(np.diff(self.cuts[0]))


def crowded(rows: DataFrame, chars: int) -> dict[int, int]:
    """Numbers of words and pairs with very many nodes below them, and how many slices these make.

    Counted on one block in ``SLICE_BLOCKS``. It decides where nodes lie and nothing else: every
    block is counted and scored whatever is found here.
    """
    some = rows.filter(F.pmod(F.xxhash64("block"), F.lit(SLICE_BLOCKS)) == 0)
    seen = some.agg(F.sum("chars")).first()[0]
    if not seen:
        return {}

    least = _LEAST_NODES

    def loads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sizes, body in (row for frame in batches for row in frame.itertuples(index=False, name=None)):
            texts = _Block(_texts(sizes, body))
            of_pair = np.bincount(texts.before, minlength=len(texts.first))
            of_word = np.bincount(texts.first, 1 + of_pair, len(texts.numbers)).astype(np.int64)
            number, load = np.concatenate([texts.numbers, texts.pair_numbers()]), np.concatenate([of_word, of_pair])
            much = load >= least
            yield pd.DataFrame({"number": number[much], "load": load[much]})

    found = some.select("sizes", "body").mapInPandas(loads, "number long, load long").groupBy("number").agg(
        F.ceil(F.sum("load") * (chars / seen) / SLICE_NODES).alias("slices")).filter("slices > 1")
    return {r["number"]: r["slices"] for r in found.collect()}


def requests(rows: DataFrame, parts: int, crowded: dict[int, int]) -> DataFrame:
    """``(part, block, words, pairs, triples, base, roots, fan1, fan2, code2, code3, n1, n2, n3)``: the
    branches of each block by part of the trie: numbers of the words, how many nodes lie below each
    word and pair, codes of the second and third words, and the training counts of all nodes."""
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, held_out, sizes, body in (row for frame in batches for row in frame.itertuples(index=False, name=None)):
            texts = _Block(_texts(sizes, body))
            paths = _Paths(texts, parts, crowded)
            n1, n2, n3 = (np.where(home, n[node], 0) for home, n, node in zip(
                paths.home, texts.learned(held_out), paths.nodes, strict=True))
            roots = texts.numbers[paths.nodes[0]]
            second = texts.numbers[texts.last[paths.nodes[1]]]
            third = texts.numbers[texts.third[paths.nodes[2]]]
            fan1, fan2 = np.bincount(paths.owner[1], minlength=len(roots)), np.bincount(paths.owner[2], minlength=len(second))
            out = []
            for p in paths.parts.tolist():
                a, b, c = (slice(x[p], x[p + 1]) for x in paths.cuts)
                low = roots[a][0]
                out.append((p, *(x.stop - x.start for x in (a, b, c)), low, packed(roots[a] - low), _small(fan1[a]),
                            _small(fan2[b]), _codes(second[b]), _codes(third[c]), _small(n1[a]), _small(n2[b]), _small(n3[c])))
            made = pd.DataFrame(out, columns=["part", "words", "pairs", "triples", "base", "roots", "fan1", "fan2",
                                              "code2", "code3", "n1", "n2", "n3"])
            made.insert(1, "block", number)
            yield made

    return rows.select("block", "held_out", "sizes", "body").mapInPandas(
        send, "part long, block long, words long, pairs long, triples long, base long, roots binary, fan1 binary, "
        "fan2 binary, code2 binary, code3 binary, n1 binary, n2 binary, n3 binary")


def _found(nodes: list[np.ndarray], n: list[np.ndarray]) -> list[np.ndarray]:
    """Training counts of a part's nodes, from a trie of those that were learned.

    ``nodes``: numbers of the words, then owner and code of pairs and triples in one number, all
    distinct and in order; ``n`` their counts."""
    owner = [None, *(x >> CODE_BITS for x in nodes[1:])]
    code = [None, *(x & (1 << CODE_BITS) - 1 for x in nodes[1:])]
    keep = [x > 0 for x in n]
    for k in (2, 1):  # whatever has a learned node below it stays
        keep[k - 1][owner[k][keep[k]]] = True
    levels = [{"n": n[0][keep[0]]}]
    for k in (1, 2):
        place = np.cumsum(keep[k - 1]) - 1
        levels.append({"n": n[k][keep[k]], "owner": place[owner[k][keep[k]]], "child": code[k][keep[k]]})
    trie = Trie(build_counts(nodes[0][keep[0]], levels))
    at = [trie.first(nodes[0])]
    for k in (1, 2):
        at.append(trie.below(k + 1, at[k - 1][owner[k]], code[k]))
    out = []
    for k, place in enumerate(at, 1):
        count = np.zeros(len(place), np.int64)
        count[place >= 0] = trie.value(k, "n", place[place >= 0])
        out.append(count)
    return out


def counts(asked: DataFrame) -> DataFrame:
    """``(block, part, c1, c2, c3, tokens, kinds)``: the counts over all blocks of the nodes that each
    block asked for, by level in its order; one row of each part also holds the tokens and distinct
    words that were learned."""
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [frame[name].to_numpy() for name in ("words", "pairs", "triples")]

        def joined(name: str, size: np.ndarray) -> np.ndarray:
            return np.concatenate([_wide(x, m) for x, m in zip(frame[name], size.tolist(), strict=True)])

        roots = np.concatenate([unpacked(x) + low for x, low in zip(frame["roots"], frame["base"], strict=True)])
        words, at = np.unique(roots, return_inverse=True)
        nodes, place = [words], [at]
        for k in (1, 2):
            code = np.concatenate([_of_codes(x) for x in frame[f"code{k + 1}"]])
            own = np.repeat(place[k - 1], joined(f"fan{k}", sizes[k - 1]))
            distinct, at = np.unique(own << CODE_BITS | code, return_inverse=True)
            nodes.append(distinct)
            place.append(at)
        n = [np.bincount(at, joined(f"n{k}", size), len(x)).astype(np.int64)
             for k, (at, size, x) in enumerate(zip(place, sizes, nodes, strict=True), 1)]
        head = np.arange(len(frame)) == 0
        return pd.DataFrame({
            "block": frame["block"], "part": frame["part"],
            **{f"c{k}": [_small(x) for x in np.split(count[at], np.cumsum(size)[:-1])]
               for k, (count, at, size) in enumerate(zip(_found(nodes, n), place, sizes, strict=True), 1)},
            "tokens": np.where(head, n[0].sum(), 0), "kinds": np.where(head, (n[0] > 0).sum(), 0)})

    return kept_table(asked.groupBy("part").applyInPandas(
        answer, "block long, part long, c1 binary, c2 binary, c3 binary, tokens long, kinds long"))


def model(trigrams: pd.DataFrame, bigrams: pd.DataFrame, unigrams: np.ndarray) -> bytes:
    """A trie in one piece of some kept counts of numbered words. ``unigrams`` counts every number; a context's total is its own
    count, so what the kept continuations leave is backed off."""
    size, total = len(unigrams), unigrams.sum()
    spoken = np.arange(size) != START
    p1 = np.where(spoken, (unigrams + 0.5) / (total + 0.5 * (size - 1)), 0.0)
    grams2 = _decode(bigrams["code"].to_numpy())[:, 1:]
    n2 = bigrams["n"].to_numpy(dtype=float)
    totals1 = np.where(spoken, unigrams, unigrams[END])  # as many starts as ends
    p2 = (n2 - np.minimum(DISCOUNT, n2 / 2)) / np.maximum(totals1[grams2[:, 0]], n2)
    back1 = _back(grams2[:, 0], p2, p1[grams2[:, 1]], size)
    place2 = {g: i for i, g in enumerate(bigrams["code"].tolist())}
    codes3 = trigrams["code"].to_numpy()
    grams3, n3 = _decode(codes3), trigrams["n"].to_numpy(dtype=float)
    mask = (1 << 2 * _BITS) - 1
    context = np.array([place2[c] for c in (codes3 >> _BITS).tolist()], np.int64)
    suffix = np.array([place2[c] for c in (codes3 & mask).tolist()], np.int64)
    p3 = (n3 - np.minimum(DISCOUNT, n3 / 2)) / np.maximum(n2[context], n3)
    back2 = _back(context, p3, p2[suffix], len(n2))
    log = lambda x: np.log10(np.maximum(x, 1e-12))
    return build([
        {"prob": log(p1), "back": log(back1)},
        {"gram": grams2, "prob": log(p2), "back": log(back2)},
        {"gram": grams3, "prob": log(p3), "back": np.zeros(len(p3))}])


def _back(context: np.ndarray, kept: np.ndarray, lower: np.ndarray, size: int) -> np.ndarray:
    left = 1 - np.bincount(context, kept, size)
    free = 1 - np.bincount(context, lower, size)
    return np.clip(left, 1e-9, 1) / np.clip(free, 1e-9, 1)


def _probabilities(texts: _Block, found: list[np.ndarray], tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word its share, and of each distinct triple its last word's probability;
    ``found`` has the training counts by level, as the block numbers them."""
    words, pairs, triples = found
    share = (words + 0.5) / (tokens + 0.5 * (kinds + 1))
    as_context, pair_context = words.copy(), pairs.copy()
    as_context[texts.start] = pair_context[texts.starts] = words[texts.end]  # as many starts as ends
    second = (pairs + PRIOR[0] * share[texts.last]) / (as_context[texts.first] + PRIOR[0])
    return share, (triples + PRIOR[1] * second[texts.pair_of_triple]) / (pair_context[texts.before] + PRIOR[1])


def score(df: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (unigrams, add one half) and ``score`` (triples), both log10 probabilities.

    ``held_out`` is a condition on the key; rows that it holds for are never learned from.
    """
    rows = blocked(df, held_out, key, text)
    chars = rows.agg(F.sum("chars")).first()[0] or 0
    parts = 1 + chars // PART_CHARS
    slices = crowded(rows, chars) if parts > 1 else {}
    answers = counts(requests(rows, parts, slices))
    tokens, kinds = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def score_block(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])
        names, held = (list(frame[name].iat[0]) for name in ("key", "held_out"))
        texts = _Block(_texts(frame["sizes"].iat[0], frame["body"].iat[0]))
        paths = _Paths(texts, parts, slices)
        known = known.sort_values("part")
        found = []
        for k, (nodes, home, cuts) in enumerate(zip(paths.nodes, paths.home, paths.cuts, strict=True), 1):
            size = np.diff(cuts)[paths.parts].tolist()
            values = np.concatenate([_wide(x, n) for x, n in zip(known[f"c{k}"], size, strict=True)])
            count = np.zeros((len(texts.numbers), len(texts.first), len(texts.before))[k - 1], np.int64)
            count[nodes[home]] = values[home]
            found.append(count)
        share, probability = _probabilities(texts, found, tokens, kinds)
        owner = np.repeat(np.arange(len(names)), texts.sizes)
        word_at, _, triple_at = texts.at

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, values, len(names))

        return pd.DataFrame({
            "key": names, "held_out": held, "n_tokens": texts.sizes,
            "n_known": per_text((found[0] > 0)[word_at]).astype(np.int64),
            "base_score": per_text(np.log10(share)[word_at]),
            "score": per_text(np.log10(probability)[triple_at])})

    kind = df.schema[key].dataType.simpleString()
    scored = rows.drop("chars").groupBy("block").cogroup(
        answers.select("block", "part", "c1", "c2", "c3").groupBy("block")).applyInPandas(
        score_block, "key string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("key").cast(kind).alias(key), "held_out", "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
