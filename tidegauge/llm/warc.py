"""Deterministic sharded WARC files: written from a table, committed by manifest, and read back.

Rows are dealt to shards by ranges of page_id that exact byte counts fix, so the same table gives
the same shards on any cluster. A task sorts its shards, makes the records (headers and digests
are regenerated from the payload; nothing depends on time or attempt), and starts a new file when
the compressed size of the current one reaches FILE_BYTES. Files are written under names that
only the attempt knows and listed in a manifest, which is kept in the shared folder; a second job
renames what the manifest lists, which may be repeated, and the manifest table marks the archive
as whole. A lost executor costs the attempts it ran, whose files no manifest lists.

Of equal payloads of at least LEAST_REVISIT bytes the row with the largest page_id is the
response; the others are revisits that name it. Which row that is comes from counts by digest, not
from gathering copies.

Defined cases: null html is an empty payload; a null url is written as ``urn:page:`` and the id;
rows that repeat page_id and payload are a response and revisits of it; rows without page_id are
always responses; other columns are not written. Invalid characters in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm._shared import durable_table, shared_folder

LEAST_REVISIT = 1000
SHARD_BYTES = 128 << 20  # of payload
FILE_BYTES = 64 << 20  # compressed
PLACES = 4096
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {digest} {nth}')}>"


def _address(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int) -> bytes:
    """A WARC/1.1 record, uncompressed; ``digest`` is the SHA-1 of the payload in hexadecimal."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    b32 = lambda raw: "sha1:" + base64.b32encode(raw).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, nth)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_address(url, page_id)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {b32(bytes.fromhex(digest))}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest, 0)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    """A gzip member without time or name."""
    codec = zlib.compressobj(6, zlib.DEFLATED, 31)
    return codec.compress(raw) + codec.flush()


def _shard_starts(pages: DataFrame) -> list[int]:
    """First page_ids of the shards: ranges of about SHARD_BYTES, cut where exact byte counts say.

    Ids are counted in PLACES equal ranges; a range that holds more than a shard is counted again
    in PLACES parts. The driver sees at most PLACES sums for each shard's worth of bytes.
    """
    sizes = pages.where("page_id is not null").groupBy("page_id").agg(F.sum("n_bytes").alias("n"))
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []

    def counted(low: int, high: int) -> list[tuple[int, int, int]]:
        width = -(-(high - low + 1) // PLACES)
        inside = sizes.where(F.col("page_id").between(low, high))
        place = F.floor((F.col("page_id").cast("decimal(38,0)") - F.lit(low)) / F.lit(width)).cast("long")
        found = inside.groupBy(place.alias("p")).agg(F.sum("n").alias("n")).orderBy("p").collect()
        out = []
        for r in found:
            a, b = low + r.p * width, min(high, low + (r.p + 1) * width - 1)
            out += counted(a, b) if r.n > SHARD_BYTES and a < b else [(a, b, r.n)]
        return out

    starts, held = [], 0
    for a, _, n in counted(low, high):
        if not starts or held + n > SHARD_BYTES:
            starts.append(a)
            held = 0
        held += n
    return starts


def _shard_of(spark: SparkSession, starts: list[int]):
    """The shard of a page_id by binary search; one number per shard is broadcast, and null is in the first."""
    shared = spark.sparkContext.broadcast(np.array(starts, np.int64))

    @F.pandas_udf("int")
    def found(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(shared.value, ids.fillna(shared.value[0]).to_numpy(np.int64), side="right") - 1
        return pd.Series(at.astype(np.int32))

    return found


def _writer(folder: str, attempt_space: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(posixpath.join(root, "_temporary"), recursive=True)
        attempt = f"{attempt_space}-{uuid.uuid4().hex}"
        shard, file, open_, before, nth = None, 0, None, None, 0

        def closed() -> pa.RecordBatch:
            stream, temporary, records, size, digest = open_
            stream.close()
            name = f"part-{shard:06d}-{file:05d}.warc.gz"
            return pa.RecordBatch.from_pydict({"name": [name], "temporary": [temporary], "records": [records], "bytes": [size], "sha256": [digest.hexdigest()]})

        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                s, page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if open_ is not None and (s != shard or open_[3] >= FILE_BYTES):
                    yield closed()
                    open_, file = None, file + 1
                if s != shard:
                    shard, file = s, 0
                nth = nth + 1 if before == (page_id, digest) else 0
                before = (page_id, digest)
                if refers_to == page_id and nth == 0:
                    refers_to = None
                if open_ is None:
                    temporary = f"{attempt}-{shard:06d}-{file:05d}"
                    open_ = [store.open_output_stream(posixpath.join(root, "_temporary", temporary)), temporary, 0, 0, hashlib.sha256()]
                raw = _member(record(page_id, url, payload, digest, refers_to, nth))
                open_[0].write(raw)
                open_[4].update(raw)
                open_[2] += 1
                open_[3] += len(raw)
        if open_ is not None:
            yield closed()

    return run


def _renamer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes"))):
                final, source = posixpath.join(root, name), posixpath.join(root, "_temporary", temporary)
                done, todo = store.get_file_info([final, source])
                if todo.type == fs.FileType.File and todo.size == size:
                    store.move(source, final)
                elif done.type != fs.FileType.File or done.size != size:
                    raise OSError(f"{name}: neither written nor committed")
            yield batch

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archive of ``pages(page_id, url, html)``; return its manifest, a row per file."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keys = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    keys = durable_table(keys, "warc-keys")
    groups = keys.where(f"n_bytes >= {LEAST_REVISIT} and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    starts = _shard_starts(keys)
    shard = _shard_of(pages.sparkSession, starts)(F.col("page_id")) if len(starts) > 1 else F.lit(0)
    # One shuffle brings each page and what it refers to together: a note on (page_id, digest) is sorted in before the page.
    notes = keys.join(groups, "digest").where("page_id is not null").select("page_id", "digest", "refers_to").distinct()
    records = rows.withColumn("digest", F.sha1("payload")).withColumn("note", F.lit(1)).withColumn("refers_to", F.lit(None).cast("long"))
    notes = notes.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).alias("note"), "refers_to")
    dealt = records.unionByName(notes).withColumn("shard", shard).repartitionById(max(1, len(starts)), F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "digest", "note", "url")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The notes put on the rows that follow them; the notes themselves go."""
        last = None
        for batch in batches:
            refers = []
            for page_id, digest, note, value in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "note", "refers_to"))):
                if note == 0:
                    last = (page_id, digest, value)
                refers.append(last[2] if note and last and last[:2] == (page_id, digest) else None)
            i = batch.schema.get_field_index("refers_to")
            yield batch.set_column(i, "refers_to", pa.array(refers, pa.int64())).filter(pc.equal(batch.column("note"), 1))

    write = _writer(folder, "attempt")
    manifest = ordered.mapInArrow(lambda batches: write(joined(batches)), "name string, temporary string, records long, bytes long, sha256 string")
    listed = durable_table(manifest, "warc-manifest")
    final = listed.mapInArrow(_renamer(folder), listed.schema).drop("temporary")
    final.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return pages.sparkSession.read.parquet(f"{folder.rstrip('/')}/manifest")


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    codec, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        raw = rest or stream.read(1 << 20)
        if not raw:
            return
        parts.append(codec.decompress(raw))
        rest = codec.unused_data
        if codec.eof:
            yield b"".join(parts)
            codec, parts = zlib.decompressobj(31), []


def parse_record(raw: bytes) -> dict:
    """Header fields in lower case, and ``block``; digests are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["warc-payload-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"damaged payload of {fields.get('warc-record-id')}")
    return fields | {"block": block}


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary"


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the files that the manifest lists; revisits have no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in READ.split(", ")]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for raw in _members(stream):
                        f = parse_record(raw)
                        number = lambda k: int(f[k]) if f.get(k) else None  # noqa: E731, B023
                        payload = f["block"].partition(b"\r\n\r\n")[2] if payloads and f["warc-type"] == "response" else None
                        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((number("x-page-id"), number("x-payload-length"), digest, f["warc-type"], number("x-refers-to-page-id"), f["warc-target-uri"], f["warc-record-id"], payload))
                        size += len(raw)
                        if size > 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    files = manifest.select("name")
    return files.repartition(max(1, min(files.count(), 4096)), "name").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the archive back: a row per page."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(pages, folder)
    return read_warc(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), g AS (
  SELECT h, max(page_id) AS top, count(*) AS copies FROM d WHERE n >= 1000 GROUP BY h
)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN g.copies > 1 AND g.top <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.copies > 1 AND g.top <> d.page_id THEN g.top END AS refers_to
FROM d LEFT JOIN g ON d.n >= 1000 AND d.h = g.h
"""
