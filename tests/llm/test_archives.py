"""Web archives: contract against brute force, exact records through the store, files in and out."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from heartloom.llm import warc
from heartloom.llm.common import SALT, dealt, hot_keys, spread

SCHEMA = "page_id long, url string, html string, digest string, payload string, __salt long"
LONG = "<p>" + "long text ü " * 20_000


def brute(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by payload."""
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 7) for r in rows], SCHEMA)


def test_contract_equals_brute_force(spark):
    copies = [(i, f"http://a.net/{i}", "<html>" + "copied " * 30) for i in range(60, 20, -1)]  # a third and more of the rows
    rows = [
        *copies, (1, "http://b.net/", "é" * 50), (2, None, "é" * 50), (3, "http://b.net/\r\nX: y", "é" * 49 + "a"), (4, "", "x" * 99), (5, "u", "x" * 99), (6, "u", "x" * 100), (7, "u", "x" * 100),
        (8, "u", None), (9, "u", ""), (10, "u", LONG), (11, "u", LONG), (12, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n" * 5), (13, "u", "tied " * 40), (13, "u", "tied " * 40), (14, "u", "tied " * 40),
        (None, "u", "tied " * 40), (None, None, "nobody has an id " * 9), (None, "x", "nobody has an id " * 9), *((i, "u", f"page {i} " * 30) for i in range(100, 140)),
    ]
    got = warc.round_trip(pages_of(spark, rows))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_store_holds_a_payload_once_and_restores_it_exactly(spark, tmp_path):
    rows = [(i, f"http://a.net/{i}", "same text " * 20 if i % 3 else f"own text {i} " * 20) for i in range(30)]
    pages = pages_of(spark, rows)
    records, _ = warc.page_records(pages)
    warc.store(pages.select(F.col("html").cast("binary").alias("payload")), records, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 11 and spark.read.parquet(f"{tmp_path}/a/headers").count() == 30
    back = {r.page_id: r for r in warc.restore(spark, f"{tmp_path}/a").collect()}
    assert bytes(back[4].payload) == b"same text " * 20 and not back[4].held and back[4].refers_to == 1
    one, four = bytes(back[1].record), bytes(back[4].record)
    assert one.endswith(b"\r\n\r\n" + b"same text " * 20) and four.endswith(b"Content-Length: 200\r\n\r\n") and b"WARC-Type: revisit\r\n" in four
    own = one.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0]
    assert four.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] == own and b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"same text " * 20).hexdigest().encode() in four
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/b/payloads")
    records.write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.restore(spark, f"{tmp_path}/b").collect()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_written_are_read_back_as_they_were(spark, tmp_path, compression):
    rows = [(i, f"http://a.net/{i}", "same text " * 20 if i % 3 else f"own {i} \r\n\r\nWARC/1.0\r\n\r\n" * 9) for i in range(20)] + [(50, None, None)]
    pages = pages_of(spark, rows)
    records, _ = warc.page_records(pages)
    warc.store(pages.select(F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")), records, f"{tmp_path}/a")
    restored = warc.restore(spark, f"{tmp_path}/a")
    want = sorted(bytes(r.record) for r in restored.collect())
    warc.write_files(restored, f"{tmp_path}/w", compression)
    files = warc.read_files(spark, f"{tmp_path}/w")
    assert files.filter("error is not null").count() == 0 and files.count() == 21
    warc.ingest(files, f"{tmp_path}/c")
    again = warc.restore(spark, f"{tmp_path}/c").collect()
    assert sorted(bytes(r.record) for r in again) == want
    assert {hashlib.sha256(r.payload).hexdigest() for r in again} == {r.digest for r in again} and sum(not r.held for r in again) == 12


def test_foreign_files(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\na: b\r\n\r\n\xff"
    page = b"WARC/1.0\r\nwarc-type: response\r\ncontent-type: application/http;msgtype=response\r\ncontent-length: 24\r\n\r\nHTTP/1.0 200 OK\r\n\r\n\x00\xfe\xff\r\n"
    (tmp_path / "a.warc").write_bytes(info + b"\r\n\r\n" + page + b"\r\n\r\n")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info + b"\r\n\r\n") + gzip.compress(page + b"\r\n\r\n"))
    (tmp_path / "c.warc").write_bytes(page + b"\r\n\r\n" + page[:-4])
    (tmp_path / "d.warc").write_bytes(b"<html>no archive")
    (tmp_path / "e.warc").write_bytes(b"")
    files = warc.read_files(spark, str(tmp_path)).cache()
    got = {}
    for r in files.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    for name in ("a.warc", "b.warc.gz"):
        assert [bytes(r.header + r.head + r.payload) for r in sorted(got[name], key=lambda r: r.offset)] == [info, page]
        assert bytes(got[name][1].payload) == b"\x00\xfe\xff\r\n" and bytes(got[name][0].head) == b""
    assert "cut off" in got["c.warc"][1].error and "no WARC record" in got["d.warc"][0].error and "e.warc" not in got
    warc.ingest(files, f"{tmp_path}/store")
    assert sorted(bytes(r.record) for r in warc.restore(spark, f"{tmp_path}/store").collect()) == sorted([info, page, info, page, page])


def test_hot_keys_are_dealt_and_lose_nothing(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("k"))
    rows = rows.unionByName(spark.createDataFrame([(9000, None)], "id long, k string"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "k", 5001, parts=10)
    assert [tuple(r) for r in hot.collect()] == [("hot", 4)]
    left = dealt(rows, hot, "k", "id")
    assert left.filter("k = 'hot'").select(SALT).distinct().count() == 4 and left.filter("k <> 'hot' or k is null").select(SALT).distinct().collect() == [(0,)]
    joined = left.join(spread(counts, hot, "k"), ["k", SALT])
    assert joined.count() == 5000 and joined.filter("k = 'hot'").select("n").distinct().collect() == [(1667,)]
