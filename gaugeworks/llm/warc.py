"""Web archives as seekable Zstandard bundles.

Pages become WARC records: the page with the largest id of those with equal payloads is the
response, the others are revisits that name it and carry no payload. Records are grouped into
frames that decompress on their own, frames into bundles, and a bundle ends in a skippable frame
with a table of the frames' sizes. An index maps every record id to its bundle, its frame and
the record's offset inside the decompressed frame, so one record costs one frame.

A bundle is a row with the bytes of a whole ``.warc.zst`` file. Spark's writer puts it into the
shared folder, so archives reach any store that Spark writes to, with its commit protocol;
``export`` writes them as files where a folder is mounted.

Defined cases: a null html is an empty payload; payloads shorter than ``revisit_from`` bytes are
all responses; rows that repeat the largest id with the same payload are all responses; a null
page id is a revisit of the largest id, or a response where there is none; a null url has no
target line, control characters in one are percent-encoded; a record longer than a frame or a
bundle is a frame or a bundle of its own; no pages, no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import shared_folder

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 16 * 1024 * 1024
#: Date of records whose table has none.
DATE = "2024-01-01T00:00:00Z"
# The seekable format's numbers and the revisit profile of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = ("bundle string, data binary, "
           "records array<struct<record_id: string, frame: int, offset: long, length: long>>")
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, payload binary")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page_of(name: str | None) -> int | None:
    number = name[len("<urn:page:"):-1] if name else ""
    return int(number) if number else None


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str,
           refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; ``size`` and ``digest`` are the full payload's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = block.encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs if v}


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where the next one begins."""
    head = data.index(b"\r\n\r\n", at)
    fields = _fields(data[at:head])
    begin, size = head + 4, int(fields["content-length"])
    block = data[begin:begin + size]
    inner = block.index(b"\r\n\r\n")
    payload, kind = block[inner + 4:], fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "payload_bytes": int(_fields(block[:inner])["content-length"]), "payload_digest": digest,
        "record_type": kind, "refers_to": _page_of(fields.get("warc-refers-to")),
        "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }, begin + size + 4


class Bundle:
    """Collects records into frames; ``finish`` gives the file's bytes and its index."""

    def __init__(self, name: str, level: int = 3):
        self.name, self._zstd = name, zstandard.ZstdCompressor(level=level)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._open: list[bytes] = []
        self._held = 0
        self.bytes = 0
        self.records: list[dict] = []

    def add(self, name: str, record: bytes) -> None:
        if self._held and self._held + len(record) > FRAME_BYTES:
            self._close()
        self.records.append({"record_id": name, "frame": len(self._frames),
                             "offset": self._held, "length": len(record)})
        self._open.append(record)
        self._held += len(record)
        self.bytes += len(record)

    def _close(self) -> None:
        frame = self._zstd.compress(b"".join(self._open))
        self._frames.append(frame)
        self._sizes.append((len(frame), self._held))
        self._open, self._held = [], 0

    def finish(self) -> bytes:
        if self._held:
            self._close()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes)
        table += struct.pack("<IBI", len(self._sizes), 0, SEEK_MAGIC)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the bundle's last bytes."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    out, start = [], 0
    for size, _ in struct.iter_unpack("<II", data[-9 - 8 * count:-9]):
        out.append((start, size))
        start += size
    return out


def frame(data: bytes, number: int) -> bytes:
    start, size = seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[start:start + size])


def read_record(data: bytes, number: int, offset: int) -> dict:
    """One record of a bundle by its place in the index; reads no other frame."""
    return parse(frame(data, number), offset)[0]


def classify(pages: DataFrame, page: str = "page_id", html: str = "html", url: str = "url",
             revisit_from: int = 0) -> DataFrame:
    """``(page_id, url, payload, size, sha1, revisit, refers_to)``; revisits have no payload.

    The largest id per digest is a map-side aggregate; a digest that a third of all pages share
    is a skewed join key, which adaptive execution splits.
    """
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "sha1": F.sha1("payload")})
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("best"))
    joined = rows.join(largest, "sha1").withColumn(
        "revisit", (F.col("size") >= revisit_from) & F.col("best").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("best")))
    return joined.select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "sha1",
        "revisit", F.when(F.col("revisit"), F.col("best")).alias("refers_to"))


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, number, bundle = TaskContext.get().partitionId(), 0, None

    def done() -> pd.DataFrame:
        return pd.DataFrame({"bundle": [bundle.name], "data": [bundle.finish()], "records": [bundle.records]})

    for batch in batches:
        for page, url, payload, size, sha1, revisit, refers in batch.itertuples(index=False, name=None):
            page, refers = (int(x) if x is not None else None for x in (page, refers))
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            made = record(page, url, (payload or "").encode(), size, digest, refers, revisit)
            if bundle is not None and bundle.bytes + len(made) > BUNDLE_BYTES:
                yield done()
                bundle = None
            if bundle is None:
                bundle, number = Bundle(f"part-{part:06d}-{number:06d}.warc.zst"), number + 1
            bundle.add(record_id(page), made)
    if bundle is not None:
        yield done()


def bundles(pages: DataFrame, **options) -> DataFrame:
    """Rows of ``BUNDLES``: file name, file bytes and the index of its records."""
    rows = classify(pages, **options)
    # Ids travel as text, since a pandas integer column cannot hold nulls.
    return rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(
        _bundled, BUNDLES)


def write(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the bundles below ``folder`` (the shared folder if none is named) and reads them."""
    folder = folder or shared_folder(pages.sparkSession)
    bundles(pages, **options).write.option("compression", "none").parquet(folder)
    return pages.sparkSession.read.schema(BUNDLES).parquet(folder)


def index(written: DataFrame) -> DataFrame:
    """``(record_id, bundle, frame, offset, length)`` of every record."""
    return written.select("bundle", F.explode("records").alias("r")).select(
        "r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["data"]:
            for number in range(len(seek_table(data))):
                raw, at, found = frame(data, number), 0, []
                while at < len(raw):
                    row, at = parse(raw, at)
                    found.append(row)
                out = pd.DataFrame(found)
                for c in ("page_id", "refers_to"):
                    out[c] = pd.array(out[c].tolist(), dtype="Int64")
                yield out


def read(written: DataFrame) -> DataFrame:
    """Every record of the bundles, response payloads checked against their digest."""
    return written.select("data").mapInPandas(_parsed, RECORDS)


def export(written: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as a file of ``folder``, which every node has to have mounted; returns
    the names. A task that runs again replaces its own files."""
    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch["bundle"], batch["data"], strict=True):
                with open(os.path.join(folder, name), "wb") as file:
                    file.write(data)
            yield batch[["bundle"]]

    return written.select("bundle", "data").mapInPandas(save, "bundle string")
