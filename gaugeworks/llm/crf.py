"""Language of documents by a linear-chain conditional random field over their words.

Every word of a line gets a language; neighbours are tied by learned transitions, so a passage in
another language is labelled as such. A word's features are its affixes of 1 to 3 letters, its
letter trigrams, the word itself, and for each language whether the word is in a lexicon of its
frequent words; all are hashed into one weight table. Forward-backward gives each word's
probability per language; a document's language is the one with the largest expected share of
its words.

Chains are lines, long lines are cut after ``CHAIN`` words. Chains of a group of texts are
stepped together, longest first, so the work per word does not depend on the texts' layout.

The model is fitted on the driver from whole texts of at most ``TRAIN_PER_LANGUAGE`` documents of
each of the ``TRAIN_LANGUAGES`` most frequent languages, those with the smallest hash of their key,
texts of over ``TRAIN_CHARS`` characters left aside; every document is labelled whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; null languages are
not learned from; without any training document everything is ``und``; one language only is that
language; repeated rows are labelled each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_PER_LANGUAGE = 500
TRAIN_LANGUAGES = 64
TRAIN_CHARS = 20_000
CHAIN = 512
UNDECIDED = "und"
_SLOTS = 1 << 17
_LETTERS = 16
_LEXICON = 400
#: Characters of text that are labelled together.
_GROUP_CHARS = 4 << 20
_WORD = re.compile(r"[^\W\d_]+")


def word_lines(text: str) -> list[list[str]]:
    """The words of each chain of a text, in small letters."""
    out = []
    for line in text.lower().split("\n"):
        found = _WORD.findall(line)
        out += [found[i:i + CHAIN] for i in range(0, len(found), CHAIN)]
    return out


def _hash(columns: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(columns), (salt * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), np.uint64)
    for j in range(columns.shape[1]):
        h = (h ^ columns[:, j].astype(np.uint64)) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(_SLOTS - 1)).astype(np.int32) + 1


def word_features(words: list[str]) -> np.ndarray:
    """Slots of the affix, trigram and word features of each word; slot 0 is none."""
    cut = [w if len(w) <= _LETTERS else w[:_LETTERS - 6] + w[-6:] for w in words]
    codes = np.array(cut, dtype=f"U{_LETTERS}").view(np.uint32).reshape(len(words), _LETTERS)
    sizes = np.count_nonzero(codes, axis=1)
    rows, out = np.arange(len(words)), []
    for k in (1, 2, 3):
        fits = sizes >= k
        out.append(np.where(fits, _hash(codes[:, :k], k), 0))
        ends = np.stack([codes[rows, np.maximum(sizes - 1 - j, 0)] for j in range(k)], axis=1)
        out.append(np.where(fits, _hash(ends, 10 + k), 0))
    for at in range(_LETTERS - 2):
        out.append(np.where(sizes >= at + 3, _hash(codes[:, at:at + 3], 20), 0))
    out.append(_hash(codes, 30))
    return np.stack(out, axis=1)


def _steps(sizes: np.ndarray):
    """Per step the rows of the chains that still run; chains are in descending size."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    running = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), side="left")
    return starts, running


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray,
                     pairs: bool = False):
    """Probability of each label of each word, and the expected moves between labels.

    ``scores`` holds the words of the chains one after the other, chains by descending size.
    """
    starts, running = _steps(sizes)
    heat = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    ahead = np.empty_like(heat)
    for t, k in enumerate(running):
        at = starts[:k] + t
        now = heat[at] if t == 0 else (ahead[at - 1] @ step) * heat[at]
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    back = np.ones_like(heat)
    expected = np.zeros_like(step)
    for t in range(len(running) - 1, 0, -1):
        at = starts[:running[t]] + t
        later = heat[at] * back[at]
        before = later @ step.T
        back[at - 1] = before / before.sum(axis=1, keepdims=True)
        if pairs:
            joint = ahead[at - 1][:, :, None] * step[None] * later[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    found = ahead * back
    return found / found.sum(axis=1, keepdims=True), expected


class Tagger:
    """Languages, hashed weights, lexicon slots and transitions."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        n = len(languages)
        self.weights = np.zeros((_SLOTS, n), np.float32)
        self.moves = np.zeros((n, n), np.float64)
        self.lexicon_weights = np.zeros((n, n), np.float64)
        self.lexicon: dict[str, list[int]] = {}

    def _lexicon_of(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for i, w in enumerate(words):
            for k in self.lexicon.get(w, ()):
                out[i, k] = 1
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of every language for each (distinct) word."""
        out = np.empty((len(words), len(self.languages)))
        for a in range(0, len(words), 100_000):
            part = words[a:a + 100_000]
            out[a:a + 100_000] = self.weights[word_features(part)].sum(axis=1)
            out[a:a + 100_000] += self._lexicon_of(part) @ self.lexicon_weights
        return out

    def word_shares(self, texts: list[str | None]) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Label probabilities of all words of the texts, each word's text, and its place."""
        chains = [(i, words) for i, t in enumerate(texts) if t for words in word_lines(t) if words]
        order = sorted(range(len(chains)), key=lambda c: -len(chains[c][1]))
        flat = [w for c in order for w in chains[c][1]]
        if not flat:
            return np.zeros((0, len(self.languages))), [], np.zeros(0, int)
        numbers, distinct = pd.factorize(np.array(flat, dtype=object))
        sizes = np.array([len(chains[c][1]) for c in order])
        shares, _ = forward_backward(self.word_scores(list(distinct))[numbers], sizes, self.moves)
        owner = np.repeat([chains[c][0] for c in order], sizes)
        begins = np.cumsum([0, *(len(words) for _, words in chains)])[:-1]
        place = np.repeat(begins[order], sizes) + np.arange(len(flat)) - np.repeat(
            np.cumsum(sizes) - sizes, sizes)
        return shares, owner, place

    def languages_of(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share of each text."""
        if not self.languages:
            return [UNDECIDED] * len(texts), [0.0] * len(texts)
        shares, owner, _ = self.word_shares(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        if len(shares):
            for k in range(len(self.languages)):
                sums[:, k] = np.bincount(owner, shares[:, k], len(texts))
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        share = np.divide(sums.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
        names = [self.languages[b] if t > 0 else UNDECIDED for b, t in zip(best, total, strict=True)]
        return names, np.clip(share, 0, 1).tolist()

    def runs_of(self, text: str | None) -> list[tuple[str, int]]:
        """Stretches of words of one language, in order, with their numbers of words."""
        shares, _, place = self.word_shares([text])
        labels = shares[np.argsort(place)].argmax(axis=1) if len(shares) else []
        out: list[tuple[str, int]] = []
        for k in labels:
            name = self.languages[k]
            out = [*out[:-1], (name, out[-1][1] + 1)] if out and out[-1][0] == name else [*out, (name, 1)]
        return out


def fit(texts: list[str], languages: list[str], epochs: int = 3, chains: int = 256,
        rate: float = 0.2, decay: float = 1e-6, seed: int = 7) -> Tagger:
    """A tagger whose words are all labelled with their document's language.

    Gradient of the chains' log likelihood, observed minus expected counts, with a step size per
    weight that falls with the gradients seen.
    """
    tagger = Tagger(sorted(set(languages)))
    n, number = len(tagger.languages), {name: i for i, name in enumerate(sorted(set(languages)))}
    seen = [Counter() for _ in range(n)]
    data: list[tuple[int, list[str]]] = []
    for text, language in zip(texts, languages, strict=True):
        for words in word_lines(text):
            if words:
                data.append((number[language], words))
                seen[number[language]].update(words)
    for k, counts in enumerate(seen):
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:_LEXICON]:
            tagger.lexicon.setdefault(w, []).append(k)
    if n < 2 or not data:
        return tagger
    random = np.random.default_rng(seed)
    memory = [np.full_like(x, 1e-3, dtype=np.float64)
              for x in (tagger.weights, tagger.moves, tagger.lexicon_weights)]

    def climb(x: np.ndarray, held: np.ndarray, slope: np.ndarray) -> None:
        held += slope * slope
        x += rate * slope / np.sqrt(held) - decay * x

    for _ in range(epochs):
        order = random.permutation(len(data))
        for a in range(0, len(order), chains):
            batch = sorted((data[i] for i in order[a:a + chains]), key=lambda c: -len(c[1]))
            flat = [w for _, words in batch for w in words]
            numbers, distinct = pd.factorize(np.array(flat, dtype=object))
            distinct = list(distinct)
            sizes = np.array([len(words) for _, words in batch])
            truth = np.repeat([k for k, _ in batch], sizes)
            slots, lexicon = word_features(distinct), tagger._lexicon_of(distinct)
            scores = tagger.weights[slots].sum(axis=1) + lexicon @ tagger.lexicon_weights
            found, expected = forward_backward(scores[numbers], sizes, tagger.moves, pairs=True)
            slope = -found
            slope[np.arange(len(truth)), truth] += 1
            by_word = np.stack([np.bincount(numbers, slope[:, k], len(distinct)) for k in range(n)], axis=1)
            by_slot = np.stack([np.bincount(slots.ravel(), np.repeat(by_word[:, k], slots.shape[1]), _SLOTS)
                                for k in range(n)], axis=1) / len(batch)
            by_slot[0] = 0
            climb(tagger.weights, memory[0], by_slot)
            kept = -expected
            np.add.at(kept, ([k for k, _ in batch],) * 2, sizes - 1)
            climb(tagger.moves, memory[1], kept / len(batch))
            climb(tagger.lexicon_weights, memory[2], lexicon.T @ by_word / len(batch))
    return tagger


def training_rows(df: DataFrame, key: str, text: str, lang: str) -> pd.DataFrame:
    """The bounded sample of whole texts that a tagger is fitted on."""
    known = df.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
                      & (F.length(text) <= TRAIN_CHARS))
    frequent = (known.groupBy(lang).agg(F.count(F.lit(1)).alias("_n"))
                .orderBy(F.desc("_n"), lang).limit(TRAIN_LANGUAGES).select(lang))
    first = Window.partitionBy(lang).orderBy("_order", key)
    places = (known.select(key, lang, F.xxhash64(key).alias("_order"))
              .withColumn("_rank", F.row_number().over(first))
              .filter(F.col("_rank") <= TRAIN_PER_LANGUAGE))
    places = places.join(F.broadcast(frequent), lang).select(key).distinct()
    # At most TRAIN_LANGUAGES * TRAIN_PER_LANGUAGE keys travel.
    rows = known.join(F.broadcast(places), key).select(key, text, lang)
    return rows.orderBy(key, lang, text).limit(TRAIN_LANGUAGES * TRAIN_PER_LANGUAGE).toPandas()


def _groups(texts: list) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end] or "") <= _GROUP_CHARS):
            held, end = held + len(texts[end] or ""), end + 1
        yield at, end
        at = end


def identify(df: DataFrame, held_out, key: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """One row per document: key, ``held_out``, ``lang_pred`` and ``score``.

    ``held_out`` is a condition on the key; rows that it holds for are never learned from.
    """
    marked = df.select(key, text, lang, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sample = training_rows(marked.filter("NOT held_out"), key, text, lang)
    tagger = fit(sample[text].tolist(), sample[lang].tolist())

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts, names, shares = texts.tolist(), [], []
            for a, b in _groups(texts):
                found = tagger.languages_of(texts[a:b])
                names += found[0]
                shares += found[1]
            yield pd.DataFrame({"lang_pred": names, "score": shares})

    return marked.select(key, "held_out", label(text).alias("_said")).select(
        key, "held_out", "_said.lang_pred", "_said.score")
