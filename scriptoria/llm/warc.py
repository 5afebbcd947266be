"""WARC archives: a deterministic sharded writer with manifests, and a reader that goes through Spark's file source."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import cut, place_of, shard_bounds, shard_of

#: Records of fewer payload bytes are never revisits.
LEAST_BYTES = 100
#: Compressed bytes after which a shard goes on in a new file.
ROLL_BYTES = 16_000_000
#: Compressed bytes that a reader unpacks at once.
SLICE = 16_384
#: Records carry this date unless the caller gives another: equal input makes equal bytes.
RECORD_DATE = datetime(2024, 1, 1, tzinfo=UTC)

READ_SCHEMA = (
    "page_id long, url string, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary, file string, offset long, intact boolean"
)


#: Digits of base 32 in RFC 4648, as int() reads them.
_DIGITS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv")


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest and size of each row of pages (page_id, payload)."""
    return pages.select("page_id", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").alias("size"))


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_digest and refers_to of the rows of pages (page_id, payload) that are revisits."""
    return revisits_of(digests(pages), least_bytes)


def revisits_of(found: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_digest and refers_to of the rows of digests() that are revisits.

    Of equal payloads of least_bytes or more, the smallest page_id is a response and others are revisits of it; rows that
    repeat that page_id are responses too, and so are rows without one if none of their payload has one.
    """
    short = found.where(F.col("size") >= least_bytes).select("page_id", "payload_digest").distinct()
    first = short.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = short.join(first, short.payload_digest == first.digest).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.select("page_id", "payload_digest", "refers_to")


def record_bytes(page_id, url, kind, refers_to, size, digest, payload, date: datetime) -> bytes:
    """One record, not compressed. A revisit has the HTTP head only; its digest and length are those of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if kind == "revisit" else head + payload
    name = lambda n: f"<urn:page:{'none' if n is None else n}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}", f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode()}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp, so that equal records make equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(
    pages: DataFrame,
    path: str,
    key_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    shards: int | None = None,
    roll_bytes: int = ROLL_BYTES,
    least_bytes: int = LEAST_BYTES,
    level: int = 5,
    date: datetime = RECORD_DATE,
) -> DataFrame:
    """Write a record for each row under path and give the manifest's rows: file, shard, records, bytes, sha256.

    Shards are ranges of (key, digest) of about SHARD_BYTES of payload, with bounds from a hash-picked sample; in a shard,
    records are in the order of (key, digest, url) and go to a new file when the current one has roll_bytes compressed. The
    same rows make the same files with the same bytes, whatever the cluster. Payload: the html in UTF-8, null as empty; a
    null url is empty; null keys come last; repeated rows are a record each; no rows make a manifest without rows.

    Tasks write files under names of their own attempt in path/_temporary; when all have succeeded, tasks rename the files
    that successful ones named (a move that is found done counts as done), and then the manifest, a table of JSON lines, is
    written under a temporary name and renamed to path/manifest.json. Readers go by the manifest, so tasks that are lost or
    run twice leave nothing that counts, and a job that fails leaves no manifest. path is a URI that pyarrow's file systems
    open, or a local folder.
    """
    rows = pages.select(
        pages[key_col].cast("long").alias("page_id"),
        F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    spark = pages.sparkSession
    found = cut(digests(rows), "digests")
    place = place_of(F.col("page_id"), F.left("payload_digest", F.lit(16)))
    bounds = shard_bounds(found.select(place.alias("place"), "size"), shards)
    # one shuffle of payloads: which rows are revisits travels to their shards as rows of its own, which sort before them
    again = revisits_of(found, least_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "payload_digest", "refers_to", F.lit(0).alias("full"))
    full = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("full"))
    dealt = full.unionByName(again).withColumn("shard", shard_of(place, bounds)).repartitionById(len(bounds) + 1, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "payload_digest", "full", "url")
    order = ["shard", "page_id", "url", "payload", "payload_digest", "refers_to", "full"]
    staging = f"{path.rstrip('/')}/_temporary/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, attempt, known = Shards(staging, TaskContext.get().taskAttemptId(), roll_bytes), [], (None, None, None)
        for batch in batches:
            others = [batch[c].to_pylist() for c in order if c != "payload"]  # payloads one by one: a batch of them may be long
            for payload, shard, page_id, url, digest, refers_to, full in zip(batch["payload"], *others, strict=True):
                if not full:
                    known = (page_id, digest, refers_to)
                    continue
                kind, target = ("revisit", known[2]) if known[:2] == (page_id, digest) else ("response", None)
                payload = payload.as_py()
                record = record_bytes(page_id, url, kind, target, len(payload), digest, payload, date)
                attempt += files.add(shard, gzip_member(record, level))
        attempt += files.close()
        if attempt:
            yield pa.RecordBatch.from_pylist(attempt, MANIFEST)

    written = cut(dealt.select(*order).mapInArrow(run, MANIFEST_DDL), "written")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        for batch in batches:
            for file, temporary in zip(batch["file"].to_pylist(), batch["temporary"].to_pylist(), strict=True):
                source, target = f"{root}/_temporary/{staging.rpartition('/')[2]}/{temporary}", f"{root}/{file}"
                if store.get_file_info(source).type == pafs.FileType.File:
                    store.move(source, target)
                elif store.get_file_info(target).type != pafs.FileType.File:
                    raise FileNotFoundError(source)
            yield batch

    manifest = cut(written.repartition(F.col("file")).mapInArrow(move, MANIFEST_DDL), "manifest").drop("temporary").orderBy("file")
    store, root = opened(path)
    store.create_dir(root, recursive=True)
    manifest.write.json(f"{staging}-manifest")
    store.move(f"{root}/_temporary/{staging.rpartition('/')[2]}-manifest", f"{root}/manifest.json")
    if store.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        store.delete_dir(f"{root}/_temporary")
    return manifest


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


MANIFEST_DDL = "file string, temporary string, shard int, records long, bytes long, sha256 string"
MANIFEST = pa.schema([("file", pa.string()), ("temporary", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


class Shards:
    """The files of one task's shards, one open at a time."""

    def __init__(self, staging: str, attempt: int, roll_bytes: int):
        self.fs, self.root = opened(staging)
        self.attempt, self.roll, self.shard, self.part, self.out = attempt, roll_bytes, None, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, shard: int, member: bytes) -> list[dict]:
        done = []
        if self.out and (shard != self.shard or self.size + len(member) > self.roll):
            done = self.close()
        if shard != self.shard:
            self.shard, self.part = shard, 0
        if not self.out:
            self.name = f"shard-{shard:06d}-{self.part:06d}.warc.gz"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(f"{self.root}/{self.attempt}-{self.name}", compression=None), 0, 0, hashlib.sha256()
            self.part += 1
        self.out.write(member)
        self.digest.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        return done

    def close(self) -> list[dict]:
        if not self.out:
            return []
        self.out.close()
        self.out = None
        return [{"file": self.name, "temporary": f"{self.attempt}-{self.name}", "shard": self.shard, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest()}]


def records_in(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each gzip member. A member is unpacked by slices, as zlib copies what it was given beyond
    the member's end: given the rest of the file, time would grow with its length times its records."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof and end < len(data):
            parts.append(unpack.decompress(view[end : end + SLICE]))
            end = min(end + SLICE, len(data))
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield at, headers, block[: int(headers["Content-Length"])]
        at = end - len(unpack.unused_data)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that path's manifest names, in columns of READ_SCHEMA.

    Responses' lengths and digests are computed from the payloads that were read, and intact says whether they agree with
    the headers; a revisit has no payload, and its length and digest are those its headers state. Files are read by
    Spark's binary file source, so one file is in memory at a time; roll_bytes bounds it.
    """
    listed = spark.read.schema("file string").json(f"{path}/manifest.json").select(F.col("file").alias("name"))
    if not listed.head(1):
        return spark.createDataFrame([], READ_SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    name = F.substring_index("path", "/", -1)
    # names outside the manifest do not count; where there are none, as usual, no content waits for a join
    if files.select(name.alias("name")).join(listed, "name", "left_anti").head(1):
        files = files.join(listed, name == F.col("name"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size, name = [], 0, name.as_py()
                for offset, h, block in records_in(content.as_py()):
                    rows.append(parsed(name, offset, h, block, with_payload))
                    size += len(block) * with_payload
                    if size > 8_000_000 or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, READ_SCHEMA)


READ_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("intact", pa.bool_())]
)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ_ARROW, strict=True)], schema=READ_ARROW)


def digest_of(header: str) -> str:
    """The SHA-256 in a digest header, in hex: its 52 digits of base 32 are 256 bits and four that are zero."""
    return f"{int(header.partition(':')[2].rstrip('=').translate(_DIGITS), 32) >> 4:064x}"


def parsed(name: str, offset: int, h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of READ_SCHEMA."""
    number = lambda urn: None if urn is None or urn == "<urn:page:none>" else int(urn.rpartition(":")[2].rstrip(">"))
    stated, size = digest_of(h["WARC-Payload-Digest"]), int(h["X-Payload-Length"])
    intact = digest_of(h["WARC-Block-Digest"]) == hashlib.sha256(block).hexdigest()
    payload, digest = None, stated
    if h["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest = hashlib.sha256(payload).hexdigest()
        intact, size = intact and digest == stated and len(payload) == size, len(payload)
    return (
        number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Type"], number(h.get("WARC-Refers-To")),
        size, digest, payload if with_payload else None, name, offset, intact,
    )
