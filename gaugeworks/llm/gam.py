"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes through the features in turn; each step
fits a shallow tree to the gradient's sums per bin and adds a small share of it to the feature's
lookup table. Then the pairs of features with the largest remaining gain get tables over two
coarse axes, boosted in turn by trees of one cut per axis. A score is the sum of table entries,
so scoring is one bin search and one addition per term for a whole column at a time.

Features are counts and shares of the whole text, made with SQL functions; labels, language,
source and keys are no features. The model is fitted on the driver from at most ``TRAIN_ROWS``
labelled rows, those with the smallest hash of their key; it is a few kilobytes.

Defined cases: null and empty texts have all counts zero and get the score that the tables give
them; a label that is null, or that disagrees within one key, is no label; without labels of both
kinds every score is the share of label 1, or 0.5 where there are none; repeated rows are scored
each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import quality_rules
from gaugeworks.llm.shared import kept_table

#: Bound of the labelled rows that the model is fitted on.
TRAIN_ROWS = 40_000
FEATURES = ("log_words", "word_length", "repeat_share", "dup_lines", "blank_share", "capital_share",
            "digit_share", "mark_share", "symbol_share", "other_share", "common_share",
            "common_kinds")


@dataclass(frozen=True)
class Settings:
    bins: int = 64
    pair_bins: int = 12
    rounds: int = 300
    pair_rounds: int = 100
    pairs: int = 8
    rate: float = 0.08
    leaves: int = 3
    smallest_leaf: int = 20
    shrink: float = 1.0


@dataclass
class Model:
    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row of ``x``."""
        total = np.full(len(x), self.start)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right")
                  for pair in self.pairs for f in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float, shrink: float) -> float:
    return g / (h + shrink)


def _gain(g, h, shrink: float):
    return g * g / (h + shrink)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Value per bin of a tree of ``leaves`` leaves over ordered bins, grown best cut first."""
    out = np.zeros(len(g))
    leaves = [(0, len(g))]

    def best_cut(a: int, b: int):
        cg, ch, cn = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
        if not len(cg):
            return 0.0, a
        tg, th, tn = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
        gain = _gain(cg, ch, s.shrink) + _gain(tg - cg, th - ch, s.shrink) - _gain(tg, th, s.shrink)
        gain[(cn < s.smallest_leaf) | (tn - cn < s.smallest_leaf)] = 0
        at = int(np.argmax(gain))
        return float(gain[at]), a + at + 1

    while len(leaves) < s.leaves:
        gain, at, leaf = max((*best_cut(*leaf), leaf) for leaf in leaves)
        if gain <= 0:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], at), (at, leaf[1])]
    for a, b in leaves:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), s.shrink)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either axis of a table of sums."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = []
    for c, t in ((cg, tg), (ch, th)):
        low, left, top = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        parts.append((low, left - low, top - low, t - left - top + low))
    gain = sum(_gain(a, b, s.shrink) for a, b in zip(*parts, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [_leaf(a[i, j], b[i, j], s.shrink) for a, b in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """The model of 0/1 labels ``y`` over the rows of ``x``."""
    share = float(np.mean(y)) if len(y) else 0.5
    if not len(y):
        return Model(0.0)
    if not 0 < share < 1:
        return Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    model = Model(float(np.log(share / (1 - share))))
    width = x.shape[1]
    model.edges = [_edges(x[:, f], s.bins) for f in range(width)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(k) for k in sizes]
    counts = [np.bincount(b, minlength=k) for b, k in zip(bins, sizes, strict=True)]
    total = np.full(len(y), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(s.rounds):
        for f in range(width):
            g, h = slopes()
            step = s.rate * _tree(np.bincount(bins[f], g, sizes[f]), np.bincount(bins[f], h, sizes[f]),
                                  counts[f], s)
            model.tables[f] += step
            total += step[bins[f]]
    model.pair_edges = [_edges(x[:, f], s.pair_bins) for f in range(width)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def sums(a: int, b: int, g, h):
        flat, k = coarse[a] * shape[b] + coarse[b], shape[a] * shape[b]
        return [np.bincount(flat, v, k).reshape(shape[a], shape[b]) for v in (g, h)]

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: -_quadrants(*sums(*p, g, h), s)[0])
    model.pairs = ranked[:s.pairs]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(s.pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = s.rate * _quadrants(*sums(a, b, *slopes()), s)[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``FEATURES`` of every whole text."""
    plain = df.select(key, text).withColumn("_none", F.lit(None).cast("string"))
    h = quality_rules.histograms(plain, key, text, "_none")
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.aggregate("_classes", F.lit(0), lambda a, x: a + x), F.lit(1))
    hits = F.aggregate("_hits", F.lit(0), lambda a, x: a + x)
    share = [F.col("_classes")[i] / chars for i in range(1, 7)]
    columns = [F.log1p("n_words"), F.col("word_chars") / words, F.col("n_repeat_words") / words,
               F.col("n_dup_lines").cast("double"), *share, hits / words,
               F.size(F.filter("_hits", lambda x: x > 0)) / F.sqrt(words)]
    return h.select(key, *[c.cast("double").alias(n) for c, n in zip(columns, FEATURES, strict=True)])


def _training(made: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    known = (labels.filter(F.col(label).isNotNull()).groupBy(key)
             .agg(F.min(label).alias("_low"), F.max(label).alias("_high")).filter("_low = _high"))
    rows = (made.join(known, key).orderBy(F.xxhash64(key), *FEATURES).limit(TRAIN_ROWS)
            .select(*FEATURES, "_low").toPandas())
    return rows[list(FEATURES)].to_numpy(), rows["_low"].to_numpy(dtype=float)


def score(df: DataFrame, labels: DataFrame, held_out, key: str = "doc_id", text: str = "text",
          label: str = "quality", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """One row per document: key, ``held_out``, ``score`` and ``predicted``.

    ``held_out`` is a condition on the key; rows that it holds for are never learned from.
    """
    made = kept_table(features(df, key, text)).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = fit(*_training(made.filter("NOT held_out"), labels, key, label), settings)

    @F.pandas_udf("double")
    def lookup(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            if len(columns[0]):
                yield pd.Series(model.score(np.column_stack([c.to_numpy() for c in columns])))
            else:
                yield pd.Series([], dtype=float)

    return made.select(key, "held_out", lookup(*FEATURES).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
