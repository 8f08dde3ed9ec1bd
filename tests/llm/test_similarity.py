"""SimHash, components, line dedup and decontamination against brute force."""

import random
import re

import pytest
import xxhash

from gaugeworks.llm import components, decontaminate, line_dedup, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    edges += [(300 + i, 301 + i) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components.connected(frame).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = roots({n for e in edges for n in e}, edges)
    assert found == want


def test_no_edges_no_components(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_and_components_match_brute_force(spark, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    want = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    ids = sorted(want)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (want[a] ^ want[b]).bit_count() <= 4]
    assert pairs
    assert {k: r.component_id for k, r in got.items()} == roots(ids, pairs)


@pytest.mark.parametrize("limit", [2, 64])
def test_crowded_buckets_lose_no_link(spark, limit):
    rng = random.Random(9)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(60):
        x = centre
        for i in rng.sample(range(64), rng.randrange(6)):
            x ^= 1 << i
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps |= {rng.getrandbits(63) for _ in range(60)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(frame, 4, bucket_limit=limit).collect()
    mask = (1 << 64) - 1
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & mask).bit_count() <= 4]
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in edges)
    assert roots(fps, [(r.a, r.b) for r in edges]) == roots(fps, near)


def test_simhash_on_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_key = {r.doc_id: r for r in rows}
    assert {by_key[k].fingerprint for k in (1, 2, 3)} == {"0" * 16}
    assert {by_key[k].component_id for k in (1, 2, 3)} == {1}
    assert by_key[None].component_id is None
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8]
    assert simhash.near_duplicates(none).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def dropped(texts):
    places = sorted(((k is None, k or 0, i), line) for k, t in texts
                    for i, line in enumerate((t or "").split("\n")) if WORD.search(line))
    first, out = {}, {}
    for at, line in places:
        if line in first:
            out.setdefault(at[:2], set()).add(at[2])
            continue
        near = any(abs(len(x) - len(line)) <= 2
                   and edits(x, line) <= min(2, min(len(x), len(line)) // 25) for x in first)
        first[line] = at
        if near:
            out.setdefault(at[:2], set()).add(at[2])
    return out


def changed(rng, line):
    line = list(line)
    for _ in range(rng.randint(0, 3)):
        at, kind = rng.randrange(len(line) + 1), rng.random()
        if kind < 0.4:
            line.insert(at, rng.choice("abé"))
        elif line:
            at = min(at, len(line) - 1)
            line[at:at + 1] = "" if kind < 0.7 else "q"
    return "".join(line)


def test_dropped_lines_match_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "of", "land", "ridge", "é", "sound", "maple", "😀", "x"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 20))) for _ in range(60)]
    texts = [(i, "\n".join(changed(rng, rng.choice(base)) for _ in range(rng.randint(1, 6))))
             for i in range(150)] + [(None, "\n".join(base[:3]))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    want = dropped(texts)
    rows = line_dedup.report(frame).collect()
    assert len(rows) == len(texts) and sum(r.n_near for r in rows) > 30
    for r in rows:
        assert set(r.dropped) == want.get((r.doc_id is None, r.doc_id or 0), set()), r
    kept = {r.doc_id: r.text for r in line_dedup.clean(frame).collect()}
    for key, text in texts:
        lines, gone = text.split("\n"), want.get((key is None, key or 0), set())
        left = [x for i, x in enumerate(lines) if i not in gone]
        if any(WORD.search(x) for x in left):
            assert kept[key] == "\n".join(left)
        else:
            assert key not in kept


def test_band_distance_is_right_within_its_band(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(1, 70)))
        b = changed(rng, a)
        if abs(len(a) - len(b)) <= 2:
            pairs.append(tuple(sorted((a, b), key=len)))
    split = "regexp_extract_all({}, '(?s).', 0)"
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr(
        "a", "b", f"{line_dedup.band_distance(split.format('a'), split.format('b'))} AS d").collect()
    for r in rows:
        assert min(r.d, 3) == min(edits(r.a, r.b), 3), r


def test_line_dedup_on_odd_rows(odd, none):
    rows = {r.doc_id: r for r in line_dedup.report(odd).collect()}
    assert rows[1].n_lines == rows[2].n_lines == rows[3].n_lines == 0
    assert sorted(rows[8].dropped) == [1, 3]
    cleaned = line_dedup.clean(odd)
    assert cleaned.columns == odd.columns
    got = {r.doc_id: r for r in cleaned.collect()}
    assert got[8].text == "the\n\n" and got[1].text is None and got[8]["line"] == "own line"
    assert cleaned.filter("doc_id = 5").count() == 2
    assert line_dedup.report(none).count() == line_dedup.clean(none).count() == 0


def best_passage(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_leaks_match_brute_force():
    rng = random.Random(1)
    hits = 0
    for _ in range(200):
        item = decontaminate.clean("".join(rng.choices("abcde ", k=rng.randint(24, 80))))
        near = item
        for _ in range(3):
            near = changed(rng, near)
        text = decontaminate.clean("".join(rng.choices("abcde ", k=50)) + near + "".join(rng.choices("abcde ", k=50)))
        found = decontaminate.Items([(7, item)], 0.15, 1).leaks(text)
        want = best_passage(item, text)
        assert (want <= int(0.15 * len(item))) == bool(found)
        if found:
            hits += 1
            assert found[0]["edits"] == want
    assert hits > 50


def test_decontamination_frames(spark, odd, none, monkeypatch):
    item = "a passage long enough to be searched for in the texts"
    bench = spark.createDataFrame([(1, item), (2, "short"), (3, None), (None, item), (4, item + " again and once more")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before. {item.upper()}! after"), (2, "clean"), (3, None)],
                                 "doc_id long, text string")
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.with_leaks(docs, bench).collect()}
    assert found == {1: [1], 2: [], 3: []}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)  # one item a block
    again = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.with_leaks(docs, bench).collect()}
    assert again == found
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    kept = decontaminate.clean_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontaminate.with_leaks(none, bench).count() == 0
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == 3
