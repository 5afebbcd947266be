import gzip
import hashlib
import json
import random
import zlib
from pathlib import Path
from types import SimpleNamespace

import pytest

from scriptoria.llm import warc
from scriptoria.llm.queries import op5_warc
from scriptoria.llm.common import shard_of
from scriptoria.llm.warc import read_warc, revisits, write_warc
from pyspark.sql import functions as F

BIG = "<p>é</p>" * 40
PAGES = [
    (5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (1, "http://a/1", None), (2, "http://a/2\r\nX: y", ""), (4, "http://a/4", "short"),
    (6, "http://a/6", "short"), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (None, "u", "y" * 100), (12, "u", "WARC/1.1\r\n\r\n" * 50_000),
    (3, "http://again", BIG),
]
DDL = "page_id long, url string, html string, payload string"


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], DDL)


def brute(rows):
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        again = len(data) >= 100 and same and key != min(same)
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [1, 400, 10_000_000])
def test_round_trip(spark, tmp_path, roll):
    entries = write_warc(frame(spark), f"{tmp_path}/w", shards=3, roll_bytes=roll).collect()
    rows = read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str) == brute(PAGES)
    assert all(r.intact for r in rows)
    by_id = {r.page_id: r for r in rows if r.record_type == "response"}
    assert bytes(by_id[12].payload).decode() == PAGES[12][2] and by_id[2].url == "http://a/2X: y"
    assert sum(e["records"] for e in entries) == len(PAGES)
    for e in entries:
        data = Path(tmp_path, "w", e["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == e["sha256"] and len(data) == e["bytes"]
        assert gzip.decompress(data).count(b"WARC-Record-ID") == e["records"]
    assert not Path(tmp_path, "w", "_temporary").exists()


def test_same_rows_same_bytes(spark, tmp_path):
    a = write_warc(frame(spark), f"{tmp_path}/a", shards=4).collect()
    b = write_warc(frame(spark, PAGES[::-1]).repartition(7), f"file://{tmp_path}/b", shards=4).collect()
    assert a == b and len(a) > 1
    lines = [[json.loads(x) for f in sorted(Path(tmp_path, d, "manifest.json").glob("part-*")) for x in f.read_text().splitlines()] for d in "ab"]
    assert lines[0] == lines[1] == [r.asDict() for r in a]


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    write_warc(frame(spark), f"{tmp_path}/w", shards=2)
    Path(tmp_path, "w", "shard-999999-000000.warc.gz").write_bytes(b"left by a lost task")
    assert read_warc(spark, f"{tmp_path}/w").count() == len(PAGES)


def test_empty(spark, tmp_path):
    assert write_warc(frame(spark).limit(0), f"{tmp_path}/w").collect() == []
    assert read_warc(spark, f"{tmp_path}/w").collect() == []


def test_shards_are_ranges(spark):
    df = spark.createDataFrame([(k,) for k in [*range(-3, 12), None]], "k long")
    for bounds in ([], [0], [0, 1], [-2, 0, 4, 5, 9]):
        for r in df.select("k", shard_of(F.col("k"), bounds).alias("s")).collect():
            assert r.s == (len(bounds) if r.k is None else sum(b <= r.k for b in bounds))


def test_roles_of_rows_without_keys(spark):
    df = spark.createDataFrame([(None, "u", b"z" * 200)] * 2, "page_id long, url string, payload binary")
    assert revisits(df).collect() == []


def test_query(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = op5_warc(spark, str(tmp_path)).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute(PAGES)


def test_one_key_is_cut_apart(spark, tmp_path):
    """Rows of one key and rows without one are dealt to several shards, in the order of their digests."""
    rows = [(key, "u", f"{key} {i} " * 60) for key in (7, None) for i in range(300)] + [(1, "u", ""), (9, "u", "")]
    entries = write_warc(frame(spark, rows), f"{tmp_path}/w", shards=8).collect()
    assert len({e.shard for e in entries}) >= 6 and max(e.records for e in entries) < 250
    got = read_warc(spark, f"{tmp_path}/w").orderBy("file", "offset").collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows)
    order = [(r.page_id is None, r.page_id or 0, r.payload_digest) for r in got]
    assert order == sorted(order)


def test_reading_grows_with_the_file(monkeypatch):
    """A reader hands zlib each record and what follows it in a slice, not the rest of the file for each record."""
    payloads = [random.Random(i).randbytes(n) for i, n in enumerate([2_000] * 400 + [300_000, 0, 16_384, 2_000])]
    members = [warc.gzip_member(warc.record_bytes(i, "u", "response", None, len(p), hashlib.sha256(p).hexdigest(), p, warc.RECORD_DATE), 5) for i, p in enumerate(payloads)]
    data, given = b"".join(members), []

    class Counting:
        def __init__(self, bits):
            self.inner = zlib.decompressobj(bits)

        def decompress(self, part):
            given.append(len(part))
            return self.inner.decompress(part)

        eof, unused_data = property(lambda self: self.inner.eof), property(lambda self: self.inner.unused_data)

    monkeypatch.setattr(warc, "zlib", SimpleNamespace(decompressobj=Counting))
    rows = list(warc.records_in(data))
    assert [block.partition(b"\r\n\r\n")[2] for _, _, block in rows] == payloads
    assert [at for at, _, _ in rows] == [sum(map(len, members[:i])) for i in range(len(members))]
    assert sum(given) <= len(data) + 20_000 * len(members) < 10 * len(data)
