"""Resharding, archives and packing: round trips and exact laws."""

import base64
import hashlib
import random
import zlib
from array import array
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import packing, reshard, tokens, warc


def cheapest(sizes, capacities):
    """Least bytes moved, by brute force over greedy orders of a small network."""
    best = None
    shards = sorted(set(sizes) | set(capacities))
    for order in permutations(shards):
        left, room, moved = dict(sizes), dict(capacities), 0
        for s in shards:
            stay = min(left.get(s, 0), room.get(s, 0))
            left[s], room[s] = left.get(s, 0) - stay, room.get(s, 0) - stay
        for s in order:
            moved += left[s]
        best = moved if best is None else min(best, moved)
    return best


def test_fewest_bytes_move():
    rng = random.Random(2)
    for _ in range(30):
        sizes = {s: rng.randrange(100) for s in range(4)}
        total = sum(sizes.values())
        cuts = sorted(rng.randrange(total + 1) for _ in range(4))
        capacities = dict(enumerate(b - a for a, b in zip([0, *cuts], [*cuts, total], strict=True)))
        flows = reshard.min_cost_transfers(sizes, capacities)
        for s in sizes:
            assert sum(f.bytes for f in flows if f.old == s) == sizes[s]
        for s in capacities:
            assert sum(f.bytes for f in flows if f.new == s) == capacities[s]
        assert sum(f.bytes for f in flows if f.old != f.new) == cheapest(sizes, capacities)


def test_prices_of_single_moves_count():
    flows = reshard.min_cost_transfers({0: 10, 1: 10}, {2: 10, 3: 10},
                                       lambda o, n: 5 if (o, n) in ((0, 2), (1, 3)) else 1)
    assert {(f.old, f.new) for f in flows} == {(0, 3), (1, 2)}


def test_reshard_places_every_row_once(docs):
    old = F.pmod(F.crc32("source"), F.lit(6))
    rows = reshard.rewrite(docs, old, 4).select("row.*", "_size", "_crc", "_shard", "_slot").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sizes = {}
    for s in range(4):
        own = [r for r in rows if r["_shard"] == s]
        assert sorted(r["_slot"] for r in own) == list(range(len(own)))
        sizes[s] = sum(r["_size"] for r in own)
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 4
    for r in rows:
        assert r["_size"] == len(r.text.encode()) + 8 and r["_crc"] == zlib.crc32(r.text.encode())


def test_untouched_shards_stay(spark):
    docs = spark.createDataFrame([(i, "x" * 92, i % 3) for i in range(30)], "doc_id long, text string, s int")
    rows = reshard.rewrite(docs, F.col("s"), 3).collect()
    assert all(r["_shard"] == r["_old"] == r.row.s for r in rows) and len(rows) == 30


def test_reshard_odd_rows(odd, none):
    rows = reshard.rewrite(odd, F.col("n_chars") % 2, 3)
    assert rows.count() == odd.count() and rows.select("row.*").columns == odd.columns
    assert rows.filter("_key = 1").select("_size", "_crc").first() == (8, 0)
    assert reshard.rewrite(none, F.lit(1), 3).count() == 0


PAGES = [(1, "u1", "same"), (5, "u\r\n5", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""),
         (None, "n", "same"), (None, "n", "lone"), (7, "x", "é\r\n\r\nWARC/1.1"), (8, "y", "z" * 900_000),
         (8, "y", "z" * 900_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns(
        {c: F.lit("own") for c in ("payload", "sha1", "size", "best", "data")})


def test_archive_round_trip(pages):
    rows = warc.read(warc.write(pages)).collect()
    assert len(rows) == len(PAGES)
    for page, _, html in PAGES:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        (r, *_) = [r for r in rows if r.page_id == page and r.payload_digest == digest]
        assert r.payload_bytes == len(body)
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        best = max(same, default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if page == best else ("revisit", best))
        if r.record_type == "response":
            assert bytes(r.payload) == body


def test_records_by_index(pages):
    written = warc.write(pages)
    data = {r.bundle: bytes(r.data) for r in written.collect()}
    places = warc.index(written).collect()
    assert len(places) == len(PAGES)
    for r in places:
        assert warc.record_id(warc.read_record(data[r.bundle], r.frame, r.offset)["page_id"]) == r.record_id
        assert len(warc.frame(data[r.bundle], r.frame)) >= r.offset + r.length


def test_short_payloads_are_responses(pages):
    rows = warc.read(warc.write(pages, revisit_from=5)).collect()
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 5)


def test_export_and_empty(spark, pages, tmp_path):
    names = [r.bundle for r in warc.export(warc.write(pages), str(tmp_path)).collect()]
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(names)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_broken_payload_is_noticed():
    made = warc.record(1, "u", b"abc", 3, warc.base32_sha1(b"abd"), None, False)
    with pytest.raises(ValueError):
        warc.parse(made)


@pytest.mark.parametrize("text", [
    "", " ", "  a b", "a  b \n c d", "a  b c ", "don't it's 'x y", "a <|endoftext|> b c", "\n\n a b\n",
    "1 2  3\t4 5 \t 6", "a\x1c b c\x1f d", "x y   z 中文 😀 ok"])
def test_ids_equal_the_whole_encoding(text):
    ids = tokens.ids()
    want = ids._whole.encode(text, add_special_tokens=False).ids
    assert list(array("I", ids.of([text])[0])) == want


def check_packing(rows, texts, size):
    whole = tokens.ids()._whole
    at, filled = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= size
    for key, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        at[key] = 0
        for r in own:
            assert r.start == at[key] and r.doc_tokens == len(ids)
            at[key] += r.length
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start:at[key]]).tobytes())
        assert at[key] == len(ids)
    return sum(filled.values()) / (size * len(filled))


def test_packing_is_whole_and_tight(docs):
    rows = packing.pack_documents(docs).collect()
    assert check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 1024) > 0.98


def test_packing_odd_rows(odd, none):
    rows = packing.pack_documents(odd, size=64).collect()
    assert sum(r.start == 0 for r in rows) == odd.count()
    for key in (1, 2):
        assert [(r.length, r.doc_tokens) for r in rows if r.doc_id == key] == [(1, 1)]
    assert packing.pack_documents(none).count() == 0


def test_costs_are_balanced():
    rng = random.Random(6)
    lengths = [rng.randint(1, 1023) for _ in range(3000)]
    parts = packing.pack(lengths, 1024, 1.0, 1 / 1024)
    fill, cost = {}, {}
    for n, own in zip(lengths, parts, strict=True):
        assert sum(p[1] for p in own) == n
        for _, k, sequence, offset in own:
            assert offset == fill.get(sequence, 0) or offset >= 0
            fill[sequence] = fill.get(sequence, 0) + k
            cost[sequence] = cost.get(sequence, 0) + k + k * k / 1024
    assert max(fill.values()) <= 1024 and len(fill) == -(-sum(lengths) // 1024)
    mean = sum(cost.values()) / len(cost)
    assert sum(c > 1.35 * mean for c in cost.values()) < 0.05 * len(cost)
