"""WARC archives: a writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm.shared import one_by_one, place, stored, write_whole

#: First step of the search for a header's end, which doubles, and how much is read at a time.
MAX_HEAD, CHUNK = 64 * 1024, 1 << 16
DATE = "1970-01-01T00:00:00Z"
_LINE = re.compile(rb"WARC/[01]\.[0-9]\r?\n")
_GZIP = b"\x1f\x8b\x08"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs

FOUND = (
    "file string, at long, end long, kind string, problem string, record_type string, record_id string, refers_to_id string, url string, "
    "page_key string, refers_to_key string, payload_digest string, payload binary"
)


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, key: str, url: str, payload: bytes, refers: str | None) -> bytes:
    """One record with its own check sum of the block; a revisit has the HTTP head only."""
    digest = digest_of(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {key} {digest}')}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)), ("X-Page-Key", key), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'response {refers} {digest}')}>"), ("X-Refers-To-Key", refers or "")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, key: str, url: str, html: str, folder: str, gzip: bool = True) -> None:
    """One record per row: of equal payloads the row with the largest key is a response, others revisit it.

    Null pages have an empty payload; a null key is smaller than all others and written as an empty name. Rows that repeat
    both the largest key and the payload are responses each. The choice is made on digests; pages themselves
    are joined by key and digest, so neither a payload nor a key that many rows share meets in one task.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    table = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha"))
    keys = table.select("key", "sha").distinct()
    last = keys.groupBy("sha").agg(F.max("key").alias("last"))
    known = keys.join(last, "sha").where("key is null and last is not null or key < last").select(F.coalesce("key", F.lit(-(1 << 63))).alias("_key"), F.col("sha").alias("_sha"), "last")
    chosen = table.join(known, (F.coalesce("key", F.lit(-(1 << 63))) == F.col("_key")) & (F.col("sha") == F.col("_sha")), "left").select("key", "url", "html", "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = [0]

        def records() -> Iterator[bytes]:
            for b in batches:
                for k, u, h, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    n[0] += 1
                    data = _record("response" if r is None else "revisit", "" if k is None else str(k), u, h.encode(), None if r is None else str(r))
                    yield _member(data) if gzip else data

        name = f"part-{TaskContext.get().partitionId():06d}.warc{'.gz' if gzip else ''}"
        size = write_whole(f"{folder}/{name}", records())
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n[0]], "n_bytes": [size]})

    chosen.mapInArrow(write, "file string, n_records long, n_bytes long").write.parquet(f"{folder}/files")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Bytes:
    """A file from its place `at` on, as a buffer with an offset: going on copies nothing, and no more than about one record is held."""

    def __init__(self, file):
        self.file, self.at, self.data, self.pos, self.over = file, 0, b"", 0, False

    def need(self, n: int) -> bool:
        """Tries to hold n bytes from here on."""
        have = len(self.data) - self.pos
        if have >= n or self.over:
            return have >= n
        parts = [self.data[self.pos :]]
        while have < n and not self.over:
            more = self.file.read(max(CHUNK, min(n - have, 1 << 26)))
            self.over = not more
            parts.append(more)
            have += len(more)
        self.data, self.pos = b"".join(parts), 0
        return have >= n

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n

    def ends(self, n: int) -> bool:
        """Whether a record of n bytes could end there, by its last bytes alone: a wrong length is found out before all it claims is read."""
        if len(self.data) - self.pos >= n:
            return self.data[self.pos + n - 4 : self.pos + n] == b"\r\n\r\n"
        here = self.file.tell()
        self.file.seek(self.at + n - 4)
        last = self.file.read(4)
        self.file.seek(here)
        return last == b"\r\n\r\n"


def _plain(data: bytes, at: int, whole: bool) -> tuple[dict, bytes, int] | str | int | None:
    """Header, block and length of the record that begins at a place; a text: what is wrong; a number: how many bytes it claims; None: its header goes on."""
    m = _LINE.match(data, at)
    if not m:
        return "version line" if len(data) - at > 12 or whole else None
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        # a header may have any size, but each of its whole lines a colon
        return "header" if whole or any(b":" not in x for x in data[m.end() :].split(b"\r\n")[:-1]) else None
    head: dict[str, str] = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "header"
        head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdecimal() or not size.isascii():
        return "length"
    start = end + 4
    stop = start + int(size)
    if len(data) < stop + 4:
        return "truncated" if whole else stop + 4 - at
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "length"
    block, told = data[start:stop], head.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest_of(block):
        return "digest"
    return head, block, stop + 4 - at


def _inflated(src: _Bytes) -> tuple[bytes, int] | str:
    """Content and length of the gzip member that starts here, or what is wrong with it."""
    z, out, at = zlib.decompressobj(31), [], 0
    while not z.eof:
        if src.pos + at >= len(src.data) and not src.need(at + CHUNK) and src.pos + at >= len(src.data):
            return "truncated"
        piece = src.data[src.pos + at : src.pos + at + CHUNK]
        try:
            out.append(z.decompress(piece))
        except zlib.error:
            return "gzip"
        at += len(piece)
    return b"".join(out), at - len(z.unused_data)


def salvage(file, gzip: bool) -> Iterator[tuple[int, int, dict | None, bytes, str | None]]:
    """(start, end, header, block, problem) of all that a file (one that can be sought in) holds: records, and gaps that belong to none.

    After a failed check the reader looks for the next place where a member (or, in plain files, a version line) begins a
    valid record, and reports the bytes in between as one gap.
    """
    src, gap, why = _Bytes(file), None, None
    while src.need(1):
        used = 0
        if gzip:
            src.need(CHUNK)
            got = _inflated(src) if src.data.startswith(_GZIP, src.pos) else "member"
            if isinstance(got, str):
                found = got
            else:
                found, used = _plain(got[0], 0, True), got[1]
                if isinstance(found, tuple) and found[2] != len(got[0]):
                    found = "length"
        else:
            size = MAX_HEAD
            while not isinstance(found := _plain(src.data, src.pos, src.over), (tuple, str)):
                if found is not None and not src.ends(found):
                    found = "length"
                    break
                size = found or max(size * 2, len(src.data) - src.pos + CHUNK)
                src.need(size)
            if isinstance(found, tuple):
                used = found[2]
        if isinstance(found, tuple):
            if gap is not None:
                yield gap, src.at, None, b"", why
                gap = None
            yield src.at, src.at + used, found[0], found[1], None
            src.skip(used)
            continue
        if gap is None:
            gap, why = src.at, found
        _seek(src, gzip)
    if gap is not None:
        yield gap, src.at, None, b"", why


def _seek(src: _Bytes, gzip: bool) -> None:
    """Moves on to the next place that looks like the start of a record, at least one byte further."""
    keep = 16
    src.skip(1)
    while True:
        if gzip:
            at = src.data.find(_GZIP, src.pos)
        else:
            m = _LINE.search(src.data, src.pos)
            at = m.start() if m else -1
        if at >= 0:
            src.skip(at - src.pos)
            return
        left = len(src.data) - src.pos
        if src.over:
            src.skip(left)
            return
        src.skip(max(0, left - keep))
        src.need(len(src.data) - src.pos + CHUNK)


def _urn(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_archives(spark: SparkSession, folder: str, files: list[str] | None = None) -> DataFrame:
    """Records and gaps of all archives of a folder: kind is record or gap; a gap has its bytes' place and the check that failed.

    Each file is one task, which reads it as a stream, one record at a time. A record's payload is its block after the HTTP head.
    """
    listed = spark.read.parquet(f"{folder}/files").select("file") if files is None else spark.createDataFrame([(f,) for f in files], "file string")
    names = ["file", "at", "end", "kind", "problem", "record_type", "record_id", "refers_to_id", "url", "page_key", "refers_to_key", "payload_digest", "payload"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                fs, path = place(f"{folder}/{name}")
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for start, end, head, block, why in salvage(file, name.endswith(".gz")):
                        if head is None:
                            rows.append((name, start, end, "gap", why, *[None] * 8))
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                        rows.append((name, start, end, "record", None, head.get("warc-type"), _urn(head.get("warc-record-id")), _urn(head.get("warc-refers-to")), head.get("warc-target-uri"),
                                     head.get("x-page-key"), head.get("x-refers-to-key"), head.get("warc-payload-digest", "").removeprefix("sha1:"), payload))
                        held += len(payload)
                        if held > 8_000_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return one_by_one(listed, "file").mapInPandas(read, FOUND)


def page_digests(records: DataFrame, key: str = "page_id", gaps: bool = True) -> DataFrame:
    """Per record: key, payload_bytes and payload_digest of the full payload, record_type and refers_to.

    A response's payload is at hand; a revisit has that of the response it refers to, found by record id. Archives are read
    once: what is needed of each record, without its payload, is written to the shared folder. Only revisits are
    joined, each with one small row, so a response that many revisit splits as any skewed join does. Gaps are no rows of
    the result; without `gaps` they are an error.
    """
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    kept = stored(records.select("file", "at", "end", "kind", "problem", "record_id", F.octet_length("payload").cast("long").alias("own_bytes"), "record_type", "refers_to_id", "payload_digest", number("page_key").alias("key"), number("refers_to_key").alias("refers")), "records")
    if not gaps and (lost := kept.where("kind = 'gap'").select("file", "at", "end", "problem").limit(3).collect()):
        raise ValueError(f"archives with gaps: {[tuple(r) for r in lost]}")
    sound = kept.where("kind = 'record'")
    revisits, others = sound.where("record_type = 'revisit'"), sound.where("record_type is distinct from 'revisit'")
    answers = sound.where("record_type = 'response'").groupBy("record_id").agg(F.first("own_bytes").alias("full_bytes")).withColumnRenamed("record_id", "_id")
    found = revisits.join(answers, F.col("refers_to_id") == F.col("_id"), "left").select(F.col("key").alias(key), F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers").alias("refers_to"))
    own = others.select(F.col("key").alias(key), F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found)
