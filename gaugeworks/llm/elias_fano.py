"""Elias-Fano sequences and an n-gram trie of them, read from a memory map.

A monotone sequence is kept as its low bits, packed, and its high bits as gaps in unary. The trie
has a level per order; a level keeps where each node's children begin (monotone), and the
children's numbers, made monotone by adding what came before. From the third level on a child is
numbered among the successors of the last word of its context, which are few, so its number is
found by searching that shorter list first. Probabilities and back-off weights are bytes into a
table of at most 256 values per level.

A trie of counts (``build_counts``) is one part of a larger one: its first level is a monotone
sequence of word numbers, its children are codes of words, since the contexts that would number
them lie in other parts, and its values are places in a table of all distinct counts, so none is
rounded.
"""

from __future__ import annotations

import io
import tempfile

import numpy as np

_ONE = np.uint64(1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other, in 64-bit words and one to spare."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        values = values.astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + np.uint64(width) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.int64)
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((low | high) & ((_ONE << np.uint64(width)) - _ONE)).astype(np.int64)


class Monotone:
    """A non-decreasing sequence of numbers from 0 on."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["size"])
        self.low, self.high, self.ranks = arrays["low"], arrays["high"], arrays["ranks"]

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack(values & ((1 << width) - 1), width)
        ones = (values >> width) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, _ONE << (ones & 63).astype(np.uint64))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {"size": np.array([n, width]), "low": low, "high": high, "ranks": ranks}

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        word = np.searchsorted(self.ranks, at, side="right") - 1
        left = (at - self.ranks[word]).astype(np.int64)
        bits, base = self.high[word], np.zeros(len(at), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the place of the one number ``left`` inside its word
            part = bits & ((_ONE << np.uint64(half)) - _ONE)
            ones = np.bitwise_count(part).astype(np.int64)
            above = left >= ones
            left = np.where(above, left - ones, left)
            base = np.where(above, base + half, base)
            bits = np.where(above, bits >> np.uint64(half), part)
        gaps = word * 64 + base - at
        return (gaps << self.width) | _unpack(self.low, self.width, at)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        at = np.arange(self.n)
        return ((ones - at) << self.width) | _unpack(self.low, self.width, at)

    def successor(self, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        """In each range, the place of the first number not below ``value``, or its end."""
        return _successor(self, begin, end, value)

    def read(self, times: int) -> Monotone | np.ndarray:
        """What to read at ``times`` places: this, or where these are many, the whole sequence."""
        return self.all() if 4 * times > self.n else self


def _successor(values, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    lo, hi = begin.copy(), end.copy()
    at = np.nonzero(lo < hi)[0]
    while len(at):
        middle = (lo[at] + hi[at]) >> 1
        below = values[middle] < value[at]
        lo[at] = np.where(below, middle + 1, lo[at])
        hi[at] = np.where(below, hi[at], middle)
        at = at[lo[at] < hi[at]]
    return lo


def packed(values: np.ndarray) -> bytes:
    """A non-decreasing sequence in a row of a table."""
    made = Monotone.encode(values)
    return np.concatenate([made["size"].astype(np.uint64), made["low"], made["high"]]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The sequence of ``packed``."""
    whole = np.frombuffer(data, np.uint64)
    n, width = int(whole[0]), int(whole[1])
    end = 2 + n * width // 64 + 2
    return Monotone({"size": whole[:2], "low": whole[2:end], "high": whole[end:], "ranks": None}).all()


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the table of their values: means of at most 256 equally full bins."""
    distinct = np.unique(values)
    if len(distinct) <= 256:
        return np.searchsorted(distinct, values).astype(np.uint8), distinct
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1]))
    at = np.searchsorted(cuts, values, side="right")
    sums, counts = np.bincount(at, values), np.bincount(at)
    return at.astype(np.uint8), sums / np.maximum(counts, 1)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of the distinct values, in as few bytes as these need, and that table."""
    table, at = np.unique(values, return_inverse=True)
    return at.astype(np.min_scalar_type(max(len(table) - 1, 0))), table


def _children(k: int, owner: np.ndarray, child: np.ndarray, parents: int) -> dict[str, np.ndarray]:
    """Arrays of level ``k``: where the children of each parent begin, and these in monotone form."""
    begins = np.searchsorted(owner, np.arange(parents + 1))
    most = int(child.max(initial=0)) + 1
    return ({f"{k}.begin.{n}": v for n, v in Monotone.encode(begins).items()}
            | {f"{k}.child.{n}": v for n, v in Monotone.encode(owner * most + child).items()}
            | {f"{k}.most": np.array([most])})


def _saved(arrays: dict[str, np.ndarray]) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def build_counts(roots: np.ndarray, levels: list[dict[str, np.ndarray]]) -> bytes:
    """The bytes of a trie of counts. ``roots`` are the numbers of the first level, in order; every
    level has ``n``, later ones also ``owner``, the place of each node's parent in the level before,
    and ``child``, its word's code, both in order."""
    out = {f"1.root.{n}": v for n, v in Monotone.encode(roots).items()}
    for k, level in enumerate(levels, 1):
        out[f"{k}.n"], out[f"{k}.ns"] = ranked(level["n"])
        if k > 1:
            out |= _children(k, level["owner"], level["child"], len(levels[k - 2]["n"]))
    return _saved(out)


def build(levels: list[dict[str, np.ndarray]]) -> bytes:
    """The trie's bytes. Level 1 has one node per word number; level k > 1 has ``gram``, rows of k
    word numbers in sorted order whose parents and shorter suffixes are in the level before; all
    have ``prob`` and ``back``."""
    out: dict[str, np.ndarray] = {}
    size = len(levels[0]["prob"])
    parents = {(w,): w for w in range(size)}
    begins_before = None
    rows_before: dict[tuple, int] = parents
    for k, level in enumerate(levels, 1):
        for name in ("prob", "back"):
            out[f"{k}.{name}"], out[f"{k}.{name}s"] = quantise(level[name])
        if k == 1:
            continue
        grams = [tuple(g) for g in level["gram"].tolist()]
        owner = np.array([rows_before[g[:-1]] for g in grams], np.int64)
        if k == 2:
            child = np.array([g[-1] for g in grams], np.int64)
        else:  # the place of the last word among the successors of the context's last words
            child = np.array([rows_before[g[1:]] - begins_before[parents_of[g[1:-1]]] for g in grams], np.int64)
        count = len(rows_before)
        out |= _children(k, owner, child, count)
        parents_of, begins_before = rows_before, np.searchsorted(owner, np.arange(count + 1))
        rows_before = {g: i for i, g in enumerate(grams)}
    return _saved(out)


class Trie:
    """Finds and scores n-grams in the bytes of ``build`` or ``build_counts``, mapped from a file of its own."""

    def __init__(self, data: bytes):
        self._arrays: dict[str, np.ndarray] = {}
        with tempfile.TemporaryFile() as file, np.load(io.BytesIO(data)) as packed:
            places = {}
            for name in packed.files:
                array = np.ascontiguousarray(packed[name])
                file.write(bytes(-file.tell() % 8))
                places[name] = (file.tell(), array.dtype, array.shape)
                file.write(array.tobytes())
            file.flush()
            # The file has no name; it goes when the map does.
            for name, (at, kind, shape) in places.items():
                self._arrays[name] = (np.memmap(file, kind, "r", at, shape) if shape[0]
                                      else np.zeros(shape, kind))
        self.order = max(int(n.split(".")[0]) for n in self._arrays)
        self._begin = {k: Monotone(self._part(f"{k}.begin.")) for k in range(2, self.order + 1)}
        self._child = {k: Monotone(self._part(f"{k}.child.")) for k in range(2, self.order + 1)}

    def _part(self, prefix: str) -> dict[str, np.ndarray]:
        return {n[len(prefix):]: a for n, a in self._arrays.items() if n.startswith(prefix)}

    def value(self, k: int, name: str, nodes: np.ndarray) -> np.ndarray:
        return self._arrays[f"{k}.{name}s"][self._arrays[f"{k}.{name}"][nodes]]

    def first(self, numbers: np.ndarray) -> np.ndarray:
        """Place of each number in the first level of a trie of counts, -1 where it is not kept."""
        roots = Monotone(self._part("1.root."))
        kept, n = roots.read(len(numbers)), roots.n
        at = _successor(kept, np.zeros(len(numbers), np.int64), np.full(len(numbers), n), numbers)
        found = np.full(len(numbers), -1, np.int64)
        there = np.nonzero(at < n)[0]
        there = there[kept[at[there]] == numbers[there]]
        found[there] = at[there]
        return found

    def below(self, k: int, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place in level ``k`` of a node's child, -1 where there is none."""
        found = np.full(len(node), -1, np.int64)
        most = int(self._arrays[f"{k}.most"][0])
        ask = np.nonzero((node >= 0) & (child >= 0) & (child < most))[0]
        begins, children = self._begin[k].read(len(ask)), self._child[k].read(len(ask))
        begin, end = begins[node[ask]], begins[node[ask] + 1]
        sought = node[ask] * most + child[ask]
        at = _successor(children, begin, end, sought)
        there = np.nonzero(at < end)[0]
        there = there[children[at[there]] == sought[there]]
        found[ask[there]] = at[there]
        return found

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Place of each n-gram (a row) in the level of its order, -1 where it is not kept."""
        k = grams.shape[1]
        if k == 1:
            return grams[:, 0].astype(np.int64)
        context = self.find(grams[:, :-1])
        child = grams[:, -1].astype(np.int64)
        if k > 2:
            suffix = self.find(grams[:, 1:])
            home = self.find(grams[:, 1:-1])
            known = np.nonzero((suffix >= 0) & (home >= 0))[0]
            child = np.full(len(grams), -1, np.int64)
            child[known] = suffix[known] - self._begin[k - 1][home[known]]
        return self.below(k, context, child)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each row's last word after the words before it."""
        k = grams.shape[1]
        if k == 1:
            return self.value(1, "prob", grams[:, 0])
        out = np.empty(len(grams))
        at = self.find(grams)
        hit = np.nonzero(at >= 0)[0]
        out[hit] = self.value(k, "prob", at[hit])
        miss = np.nonzero(at < 0)[0]
        if len(miss):
            out[miss] = self.log_probability(grams[miss, 1:])
            context = self.find(grams[miss, :-1])
            known = np.nonzero(context >= 0)[0]
            out[miss[known]] += self.value(k - 1, "back", context[known])
        return out
