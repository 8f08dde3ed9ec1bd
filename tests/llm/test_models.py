"""Quality rules, classifier, language tagger and language model."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import crf, elias_fano, gam, ngram_lm, quality_rules, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def base_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_base_counts_match_brute_force(odd, larger):
    for frame in (odd, larger):
        texts = frame.select("doc_id", "text").collect()
        got = {r.doc_id: r for r in quality_rules.judge(frame).collect()}
        for key, text in texts:
            r, want = got[key], base_counts(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)


def test_distances_match_brute_force(spark, larger):
    counted = quality_rules.shares(quality_rules.histograms(larger)).limit(50).cache()
    found = quality_rules.references(counted, quality_rules.Limits())
    p_ref, q_ref = found["en"]
    rows = counted.select("_p", "_q", quality_rules.distance("_p", p_ref).alias("p"),
                          quality_rules.distance("_q", q_ref).alias("q")).collect()

    def jensen_shannon(a, b):
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        return math.sqrt(max(0, sum(part(x, y) + part(y, x) for x, y in zip(a, b, strict=True)) / 2))

    for r in rows:
        assert r.p == pytest.approx(jensen_shannon(r["_p"], p_ref), abs=1e-7)
        assert r.q == pytest.approx(jensen_shannon(r["_q"], q_ref), abs=1e-7)


def test_rules_keep_good_texts(larger, labels):
    rows = [r for r in quality_rules.judge(larger).collect() if r.doc_id in labels]
    good = [r for r in rows if labels[r.doc_id] == 1 and not r.base_failed]
    bad = [r for r in rows if labels[r.doc_id] == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)


def test_keep_carries_rows(odd, none, larger):
    assert quality_rules.keep(odd).columns == odd.columns
    assert quality_rules.keep(none).count() == 0
    twice = larger.union(larger)
    assert quality_rules.keep(twice).count() == 2 * quality_rules.keep(larger).count()


@pytest.mark.parametrize("most", [500_000, 0])
def test_keep_judges_rows_where_they_lie(spark, larger, monkeypatch, most):
    """Texts are not shuffled back to their verdicts; a key with rows of both verdicts goes."""
    monkeypatch.setattr(quality_rules, "SMALL_KEYS", most)
    kept = {r.doc_id for r in quality_rules.judge(larger).collect() if r.kept}
    one, two, three = sorted(kept)[:3]
    bad = spark.createDataFrame([(one, "few words", "en", None, 9), (None, "few", None, "s", 3)], larger.schema)
    unnamed = larger.filter(F.col("doc_id") == three).withColumn("doc_id", F.lit(None).cast("long"))
    again = larger.filter(F.col("doc_id") == two)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quality_rules.keep(larger.unionByName(bad).unionByName(again).unionByName(unnamed))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not most or "hashpartitioning" not in plan
    want = [tuple(r) for r in larger.collect() if r.doc_id in kept - {one}]
    want += [tuple(r) for r in again.collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_classifier_on_rows_held_out(spark, labels):
    rows = queries.op4_quality_gam(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    fresh = rng.random((1000, 3))
    model = gam.fit(x, y, gam.Settings(rounds=30, pairs=2, smallest_leaf=5))
    right = (model.score(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))
    assert right.mean() > 0.95 and model.pairs[0] == (0, 1)


def test_classifier_without_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    rows = gam.score(odd, empty, F.lit(False)).collect()
    assert len(rows) == odd.count() and {round(r.score, 6) for r in rows} == {0.5}
    mixed = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (7, None), (None, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in gam.score(odd, mixed, F.col("doc_id") == 99).collect())
    assert gam.score(none, mixed, F.lit(False)).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    total, shares, steps = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for y in product(range(3), repeat=4):
        w = math.exp(sum(scores[i, k] for i, k in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        for i, k in enumerate(y):
            shares[i, k] += w
        for a, b in zip(y, y[1:], strict=False):
            steps[a, b] += w
    found, expected = crf.forward_backward(np.vstack([scores, scores[:1]]), np.array([4, 1]), moves, pairs=True)
    assert np.allclose(found[:4], shares / total) and np.allclose(expected, steps / total)


def test_languages_on_rows_held_out(spark, larger):
    rows = queries.op7_language_crf(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in larger.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_switches_inside_a_line():
    texts = ["the cat and the dog of the house", "le chat et le chien de la maison"] * 20
    tagger = crf.fit(texts, ["en", "fr"] * 20, epochs=5)
    assert tagger.runs_of("the dog of the house le chien de la maison") == [("en", 5), ("fr", 5)]
    assert tagger.runs_of(None) == [] and tagger.languages_of([None, "12 !?", ""])[0] == ["und"] * 3


def test_languages_of_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in crf.identify(odd, F.lit(False)).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in crf.identify(odd, F.lit(True)).collect()} == {"und"}
    assert crf.identify(none, F.lit(False)).count() == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (50, 40), (1000, 10**6), (3000, 2000)])
def test_monotone_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    made = elias_fano.Monotone(elias_fano.Monotone.encode(values))
    assert (made[np.arange(n)] == values).all()
    sought = rng.integers(0, top + 5, 100)
    found = made.successor(np.zeros(100, int), np.full(100, n), sought)
    assert (found == np.searchsorted(values, sought)).all()


def test_trie_finds_all_grams_and_no_other():
    rng = np.random.default_rng(3)
    text = rng.integers(3, 12, 400)
    three = np.unique(np.stack([text[:-2], text[1:-1], text[2:]], 1), axis=0)
    two = np.unique(np.vstack([three[:, :2], three[:, 1:]]), axis=0)
    level = lambda g: {"gram": g, "prob": -np.arange(len(g)) / 7, "back": -np.arange(len(g)) / 9}
    trie = elias_fano.Trie(elias_fano.build([level(np.arange(12)), level(two), level(three)]))
    for grams, order in ((two, 2), (three, 3)):
        assert (trie.find(grams) == np.arange(len(grams))).all()
        every = np.array(list(product(range(12), repeat=order)))
        known = {tuple(g) for g in grams.tolist()}
        assert {tuple(g) for g in every[trie.find(every) >= 0].tolist()} == known


def test_each_context_adds_up_to_one():
    rng = np.random.default_rng(5)
    ids = np.concatenate([[*rng.integers(2, 60, 30), ngram_lm.END] for _ in range(40)])
    sizes = np.full(40, 31)
    codes, n = np.unique(ngram_lm._code(ngram_lm._grams(ids, sizes)), return_counts=True)
    import pandas as pd

    grams = pd.DataFrame({"code": codes, "n": n})
    pairs = grams.assign(code=grams["code"] & (1 << 26) - 1).groupby("code", as_index=False)["n"].sum()
    kept = grams[(grams["n"] > 1) & (grams["code"] >= 1 << 13)]
    trie = elias_fano.Trie(ngram_lm.model(kept, pairs[pairs["n"] > 1], np.bincount(ids, minlength=60).astype(float)))
    for context in ((0, 3), (3, 4), (5, 5), (7, 2)):
        rows = np.array([[*context, w] for w in range(1, 60)])
        assert (10 ** trie.log_probability(rows)).sum() == pytest.approx(1, abs=0.03)


def unigram_scores(texts, held):
    tokens = {k: [*WORD.findall((t or "").translate(LOWER)), None] for k, t in texts}
    counts = Counter(w for k, ws in tokens.items() if not held(k) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    floor = math.log10(total + 0.5 * (kinds + 1))
    return total, {k: (len(ws), sum(counts[w] > 0 for w in ws),
                       sum(math.log10(counts[w] + 0.5) - floor for w in ws)) for k, ws in tokens.items()}


def test_language_model_scores(spark, larger):
    rows = {r.doc_id: r for r in queries.op10_ngram_lm(spark, SF).collect()}
    texts = larger.select("doc_id", "text").collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    total, want = unigram_scores(texts, held)
    sums = defaultdict(float)
    for k, (n, known, score) in want.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        if held(k):
            sums["base"] += r.base_score
            sums["model"] += r.score
    assert sums["model"] > sums["base"]


def test_language_model_on_odd_rows(odd, none):
    rows = ngram_lm.score(odd, F.col("doc_id") == 4).collect()
    assert len(rows) == odd.count()
    by_key = {r.doc_id: r for r in rows}
    assert by_key[1].n_tokens == by_key[2].n_tokens == by_key[3].n_tokens == 1
    assert by_key[4].held_out and by_key[4].n_tokens == 30_001 and not by_key[None].held_out
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    untrained = ngram_lm.score(odd, F.lit(True)).collect()
    assert {r.n_known for r in untrained} == {0} and {r.train_tokens for r in untrained} == {0}
    assert ngram_lm.score(none, F.lit(False)).count() == 0


def test_language_model_counts_every_word_and_gram(spark, monkeypatch):
    """Scores equal to brute force over all words and n-grams, also those that occur once, in many parts."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{min(int(x), 3000)}" for x in rng.zipf(1.3, 80)) for _ in range(120)] + ["", None, "only here once"]
    rows = list(enumerate([*texts, "only here once"]))
    held = {k for k, _ in rows if k % 5 == 1} | {len(rows) - 1}
    monkeypatch.setattr(ngram_lm, "PART_CHARS", 5_000)
    monkeypatch.setattr(ngram_lm, "BLOCK_ROWS", 20)
    got = {r.doc_id: r for r in ngram_lm.score(
        spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id").isin(list(held))).collect()}

    tokens = {k: ["<", "<", *(t or "").split(), ">"] for k, t in rows}
    seen = [Counter() for _ in range(3)]
    for k, ws in tokens.items():
        if k not in held:
            for i in range(2, len(ws)):
                for n in range(3):
                    seen[n][tuple(ws[i - n:i + 1])] += 1
    total, kinds, texts_learned = sum(seen[0].values()), len(seen[0]), seen[0][(">",)]
    seen_before = seen[0] + Counter({("<",): texts_learned}), seen[1] + Counter({("<", "<"): texts_learned})
    for k, ws in tokens.items():
        want = 0.0
        for i in range(2, len(ws)):
            p = (seen[0][(ws[i],)] + 0.5) / (total + 0.5 * (kinds + 1))
            for n in (1, 2):
                more, context = ngram_lm.PRIOR[n - 1], tuple(ws[i - n:i])
                p = (seen[n][(*context, ws[i])] + more * p) / (seen_before[n - 1][context] + more)
            want += math.log10(p)
        assert got[k].score == pytest.approx(want, rel=1e-9)


def test_counts_are_found_in_a_trie(monkeypatch):
    """A part's counts come out of its Elias-Fano trie, exactly, also of nodes that are only passed through."""
    rng = np.random.default_rng(4)
    below = 1 << ngram_lm.CODE_BITS
    words = np.sort(rng.choice(1 << 61, 300, replace=False))
    nodes = [words]
    for size, parents in ((2000, 300), (9000, 2000)):
        nodes.append(np.unique(rng.integers(0, parents, size) * below + rng.choice(rng.integers(0, below, 200), size)))
        parents = len(nodes[-1])
    nodes[2] = nodes[2][nodes[2] // below < len(nodes[1])]
    n = [np.where(rng.random(len(x)) < 0.5, 0, rng.zipf(1.2, len(x)) % 10**6) for x in nodes]
    looked_up = []

    class Watched(elias_fano.Trie):
        def below(self, k, node, child):
            looked_up.append((k, len(node)))
            return super().below(k, node, child)

    monkeypatch.setattr(ngram_lm, "Trie", Watched)
    for counted in (n, [np.zeros_like(x) for x in n]):
        for got, want in zip(ngram_lm._found(nodes, counted), counted, strict=True):
            assert (got == want).all()
    assert looked_up[:2] == [(2, len(nodes[1])), (3, len(nodes[2]))]


def test_crowded_contexts_are_cut(spark, monkeypatch):
    """Words and pairs that very much follows lie in many parts; no score depends on that."""
    texts = [(k, " ".join(f"of the x{k}_{i} of the y{i % 7}" for i in range(40))) for k in range(60)]
    docs = spark.createDataFrame([*texts, (60, ""), (61, None)], "doc_id long, text string").repartition(4)
    held = F.col("doc_id") % 5 == 1
    plain = {r.doc_id: r for r in ngram_lm.score(docs, held).collect()}
    for name, value in (("PART_CHARS", 5_000), ("BLOCK_ROWS", 5), ("SLICE_NODES", 100), ("SLICE_BLOCKS", 1)):
        monkeypatch.setattr(ngram_lm, name, value)
    rows = ngram_lm.blocked(docs, held, "doc_id", "text")
    chars = rows.agg(F.sum("chars")).first()[0]
    many = ngram_lm.crowded(rows, chars)
    pair = ngram_lm._Block(["of the"])
    assert many.keys() >= {int(x) for x, a, b in zip(pair.pair_numbers(), pair.first, pair.last)
                           if pair.numbers[a] == ngram_lm._number("of") >> 2 and pair.numbers[b] == ngram_lm._number("the") >> 2}
    parts = 1 + chars // 5_000
    nodes = lambda crowded: max(r["n"] for r in ngram_lm.requests(rows, parts, crowded)
                                .groupBy("part").agg(F.sum(F.col("pairs") + F.col("triples")).alias("n")).collect())
    assert 2 * nodes(many) < nodes({})
    got = {r.doc_id: r for r in ngram_lm.score(docs, held).collect()}
    assert got.keys() == plain.keys()
    for k, r in got.items():
        assert r[:5] == plain[k][:5] and r[5:] == pytest.approx(plain[k][5:], rel=1e-9)


@pytest.mark.parametrize("n, top", [(1, 1), (1, 1 << 61), (1000, 1 << 62), (5000, 3), (3000, 1 << 50)])
def test_packed_sequences(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n))
    assert (elias_fano.unpacked(elias_fano.packed(values)) == values).all()


def test_blocks_that_fill_many_row_groups(spark, larger, monkeypatch):
    """The table of blocks is read in other pieces than it was written in."""
    from gaugeworks.llm import shared

    settings = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in settings}
    plain = {r.doc_id: r.score for r in ngram_lm.score(larger, F.col("doc_id") % 5 == 1).collect()}

    def small_groups(df, *rest):
        folder = shared.shared_folder(df.sparkSession)
        df.write.option("parquet.block.size", 65536).parquet(folder)
        return df.sparkSession.read.schema(df.schema).parquet(folder)

    monkeypatch.setattr(ngram_lm, "kept_table", small_groups)
    monkeypatch.setattr(ngram_lm, "BLOCK_CHARS", 200_000)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.score for r in ngram_lm.score(larger.coalesce(1), F.col("doc_id") % 5 == 1).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.keys() == plain.keys()
    assert all(got[k] == pytest.approx(plain[k], rel=1e-9) for k in plain)
