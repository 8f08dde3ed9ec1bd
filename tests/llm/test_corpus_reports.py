"""Mixing, collocations and the filter audit against plain versions."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import collocations, filter_audit, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- mixing --------------------------------------------------------------------------

def plain_targets(sizes):
    """Targets by repeated sharing, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * w / open_weight for s, w in weight.items()}
        above = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def plain_rates(sizes, target):
    """Rates of one source by bisection of its multiplier."""
    full = [x for x in sizes if x]
    low, high = -60.0 / min(full), math.log(3) / min(full) * 1.0001
    for _ in range(300):
        middle = (low + high) / 2
        mass = sum(x * min(3.0, math.exp(min(9.0, middle * x))) for x in full)
        low, high = (middle, high) if mass < target else (low, middle)
    return {x: min(3.0, math.exp(min(9.0, high * x))) for x in full}


def check_mix(rows, texts):
    """``texts``: (key, source, size) of every row."""
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in rows) == sorted((str(k), str(s), n) for k, s, n in texts)
    sizes = defaultdict(int)
    for _, s, n in texts:
        sizes[s] += n
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-12)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s, target in targets.items():
        own = [n for _, x, n in texts if x == s]
        full = sorted(n for n in own if n) or [0]
        assert abs(taken[s] - target) <= max(1, full[len(full) // 2] / 2), s
        if sizes[s]:
            rates = plain_rates(own, target)
            for r in rows:
                if r.source == s and r["size"]:
                    assert r.rate == pytest.approx(rates[r["size"]], abs=2e-4)


@pytest.mark.parametrize("sent", [8 << 20, 0])
def test_mix_against_bisection(spark, docs, monkeypatch, sent):
    monkeypatch.setattr(mixing, "SENT_BYTES", sent)
    rows = mixing.mix(docs).collect()
    texts = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    check_mix(rows, texts)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_takes_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    check_mix(rows, [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in odd.collect()])
    assert mixing.mix(none).count() == 0


def test_mix_of_capped_sources_and_repeated_rows(spark):
    rows = [(1, "w " * 4, "en", "a", 0)] * 9 + [(None, "w " * 3, "en", "a", 0)] * 7 + [
        (i, "w " * (i % 50 + 1), "en", "b", 0) for i in range(400)] + [(7, "w", "en", "c", 0), (8, "", "en", "d", 0),
                                                                       (9, "w " * 90, "en", None, 0)]
    out = mixing.mix(spark.createDataFrame(rows, COLUMNS)).collect()
    check_mix(out, [(k, s, len(t.split())) for k, t, _, s, _ in rows])
    assert {r.copies for r in out if r.source == "c"} == {3}
    # Nine equal rows share their copies as evenly as whole copies can be.
    equal = [r.copies for r in out if r.doc_id == 1 and r.source == "a"]
    assert len(equal) == 9 and max(equal) - min(equal) <= 1


def test_rounding_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT_ROWS", 300)
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id * id % 97 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    out = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert len(out) == 2 and all(abs(r.t - r.g) <= 1e-3 * r.g for r in out)


def test_ranks_follow_code_points(spark):
    names = [(x,) for x in ("b", "a", "é", "", "Z", "z", None, "中", "😀", "～")]
    got = mixing.ranked(spark.createDataFrame(names, "s string"), "s").collect()
    want = sorted((n for n, in names if n is not None), key=lambda n: n.encode()) + [None]
    assert [r.s for r in sorted(got, key=lambda r: r["_rank"])] == want


# ---- collocations --------------------------------------------------------------------

def plain_collocations(rows, least, keep):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i:i + k])] += 1
    candidates = {g: f for g, f in count.items() if len(g[1]) > 1 and f >= least}
    around = defaultdict(int)
    for (lang, words), f in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                around[lang, words[i:i + k]] = max(around[lang, words[i:i + k]], f)
    out = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * around[lang, words] >= 80 * a:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k, count[lang, words[:k]], count[lang, words[k:]])
            for k in range(1, len(words)))
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:keep], 1))


FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("parts", [1, 9])
def test_collocations_against_counting(docs, parts):
    got = collocations.collocations(docs.repartition(parts), least=5, keep=300).collect()
    want = plain_collocations([(r.lang, r.text) for r in docs.collect()], 5, 300)
    assert sorted(tuple(r[f] for f in FIELDS) for r in got) == want


def test_collocations_take_odd_rows(odd, none):
    rows = odd.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    got = collocations.collocations(rows, least=2).collect()
    want = plain_collocations([(r.lang, r.text) for r in rows.collect()], 2, 2000)
    assert sorted(tuple(r[f] for f in FIELDS) for r in got) == want and want
    assert collocations.collocations(none).count() == 0


def block_of(text):
    return collocations.Block(collocations.normalised([text.encode().translate(collocations._TABLE)]), "en")


def test_equal_spans_have_equal_hashes():
    block = block_of("A  bc\tA bc. bc a! naïve, naïve bc a" + " x" * 10)
    words = [bytes(block.data[s:e]).decode() for s, e in zip(block.starts, block.ends, strict=True)]
    assert words[:9] == ["a", "bc", "a", "bc", "bc", "a", "naïve", "naïve", "bc"]
    for n in (1, 2, 3):
        first = block.whole(n)
        marks = block.fingerprints(first, n)
        by_text = defaultdict(set)
        for i, m in zip(first, marks, strict=True):
            by_text[tuple(words[i:i + n])].add(int(m))
        assert all(len(m) == 1 for m in by_text.values())
        assert len({*map(frozenset, by_text.values())}) == len(by_text)
    assert not any(words[i] == "bc" and words[i + 1] == "bc" for i in block.whole(2))


def test_collisions_are_told_apart_by_text(monkeypatch):
    """All words have one hash: the digests of their bytes keep them apart."""
    monkeypatch.setattr(collocations, "scrambled", lambda x: x)
    monkeypatch.setattr(collocations.Block, "_words", lambda self: np.zeros(len(self.starts), dtype=np.uint64))
    block = block_of("ab cd ab ef cd ab gh ab")
    first = block.whole(2)
    assert len(set(block.fingerprints(first, 2).tolist())) == 1
    words = "ab cd ab ef cd ab gh ab".split()
    by_text = defaultdict(set)
    for i, check in zip(first, block.checks(first, 2), strict=True):
        by_text[tuple(words[i:i + 2])].add(int(check))
    assert all(len(c) == 1 for c in by_text.values()) and len({min(c) for c in by_text.values()}) == len(by_text)
    with pytest.raises(ValueError, match="share"):
        collocations.phrases(block, first, np.zeros(len(first), dtype=np.int64), 2)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 10)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 4)
    body = b"one two\nthree\n" + b"x" * 30 + b"\nlast one here"
    parts = list(collocations.cuts(body))
    assert b"\n".join(parts) == body and b"x" * 30 in parts
    block = block_of("aaaaaaaaaaaa b cc aaaaaaaaaaaa b cc")
    marks = block.fingerprints(block.whole(3), 3)
    assert marks[0] == marks[3] and len(set(marks.tolist())) == 3


# ---- audit ---------------------------------------------------------------------------

def plain_audit(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    fails, out = [], {}
    for key, text, part in rows:
        body, words = text or "", WORD.findall(text or "")
        fails.append((part or "", key in good, key in toxic, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", body)) > 2 * len(body), "D": bool(re.search("[#$%&*|]", body)),
            "E": key is not None and least[body] < key}))
    for order in map("".join, permutations("ABCDE")):
        for part, is_good, is_toxic, bad in fails:
            gone = False
            for step, letter in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 6)
                row[0] += not gone and not bad[letter]
                row[1] += not gone and bad[letter]
                row[2] += gone and bad[letter]
                row[3] += bad[letter] and sum(bad.values()) == 1
                row[4] += not gone and bad[letter] and is_good
                row[5] += not gone and bad[letter] and is_toxic
                gone = gone or bad[letter]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def check_audit(frame, labels):
    out = filter_audit.audit(frame, labels).collect()
    got = {(r.part, r.filter_order, r.step): (*(r[c] for c in filter_audit.COUNTS), r.shapley) for r in out}
    want = plain_audit([(r.doc_id, r.text, r.source) for r in frame.collect()], [tuple(r) for r in labels.collect()])
    assert len(out) == len(got) and got == want


def test_audit_against_plain_folds(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    few = docs.limit(60).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat("lang", F.lit("1"))))
    check_audit(few.cache(), labels)


def test_audit_takes_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (8, None, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    check_audit(odd, labels)
    check_audit(odd, labels.limit(0))
    assert filter_audit.audit(none, labels).count() == 0
