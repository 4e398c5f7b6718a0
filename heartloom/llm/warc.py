"""Content-addressed web archives: payloads once by verified digest, exact record headers apart, records by joins.

A record is its header block (exact bytes, blank line included), the head of its block (the HTTP head, empty where there
is none) and its payload. An archive is a folder with two tables:

* payloads (digest, size, payload): each distinct payload once, under the SHA-256 of its bytes,
* headers (the record's own columns, digest, size, header, head, held): one row per record. held tells whether the
  record's own bytes hold the payload; a revisit has the digest of a payload that another record holds.

``restore`` joins them to the records as they were, byte for byte, and recomputes every digest on the way. A digest that
a large part of the records share is dealt over many tasks (``common.hot_keys``), so neither storing nor restoring
gathers a group of copies in one place.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom.llm.common import SALT, dealt, hot_keys, shared_place, spread

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST = 100
#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Date of records made from tables, which have none.
DATE = "2000-01-01T00:00:00Z"
OWN = ("digest", "size", "header", "head", "held", "payload", "type", "refers_to")


def _bytes(c: str) -> Column:
    return F.octet_length(c).cast("long")


def counts_of(records: DataFrame) -> DataFrame:
    """(digest, first, n, same): the smallest page_id and the number of rows of each payload, and whether its copies agree.

    Two payloads under one digest would differ in length or in an independent 64-bit hash; ``same`` says that none do.
    """
    same = (F.min("size") == F.max("size")) & (F.min("check") == F.max("check"))
    return records.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), same.alias("same"))


def page_records(pages: DataFrame, date: str = DATE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """WARC records of pages, and the hot digests among them.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and the
    others are revisits of it; smaller payloads are all responses. A null html is an empty payload. Rows that repeat the
    smallest page_id are responses too; rows without page_id are revisits where any copy has an id, else responses.
    Extra columns are left out. A null url gives a record without target; line ends in urls are percent-encoded.
    """
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    held = held.withColumns({"digest": F.sha2("payload", 256), "size": _bytes("payload"), "check": F.xxhash64("payload")})
    counts = counts_of(held.select("page_id", "digest", "size", "check"))
    hot = hot_keys(counts.select("digest", "n"), "digest", pages.count())
    # only narrow rows meet the counts; the payload of a page is read again where it is stored
    narrow = dealt(held.select("page_id", "url", "digest", "size"), hot, "digest", "page_id", "url").join(spread(counts, hot, "digest"), ["digest", SALT]).drop(SALT)
    checked = F.when(F.col("same"), F.col("first")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("long"))
    narrow = narrow.withColumn("first", checked)
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    narrow = narrow.withColumn("refers_to", F.when(again, F.col("first"))).withColumn("type", F.when(again, "revisit").otherwise("response"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    narrow = narrow.withColumn("head", head)
    length = F.octet_length("head") + F.when(again, F.lit(0)).otherwise(F.col("size"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "type"), F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target), F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))), F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit(END))
    records = narrow.select("page_id", "digest", "size", header.cast("binary").alias("header"), F.col("head").cast("binary").alias("head"), (~again).alias("held"), "type", "refers_to")
    return records, hot


def record_id(page_id: Column) -> Column:
    """A page's record id: a uuid from the hash of its page_id; pages without one share the id of the empty name."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def distinct_payloads(payloads: DataFrame) -> DataFrame:
    """(digest, size, payload), each distinct payload of payloads (payload) once; copies meet in their own task first."""
    held = payloads.select("payload", F.sha2("payload", 256).alias("digest"), F.xxhash64("payload").alias("check"))
    one = held.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("check").alias("low"), F.max("check").alias("high"))
    sure = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary"))
    return one.select("digest", _bytes("payload").alias("size"), sure.alias("payload"))


def store(payloads: DataFrame, headers: DataFrame, folder: str) -> None:
    """Write an archive: payloads (payload) in any number of copies, headers (digest, size, header, head, held and more)."""
    distinct_payloads(payloads).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records: the columns of headers, payload (of every record, whoever holds it) and record.

    record is the record's exact bytes, without the two line ends that close it in a file. Payloads whose bytes don't
    give their digest, and headers without payload, raise.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", F.col("size").alias("__size"), "payload")
    counts = headers.groupBy("digest").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "digest", headers.count())
    right = spread(payloads, hot, "digest")
    out = dealt(headers, hot, "digest", "header").join(right, ["digest", SALT], "left").drop(SALT)
    sound = (F.sha2("payload", 256) == F.col("digest")) & (_bytes("payload") == F.col("size")) & (F.col("__size") == F.col("size"))
    whole = F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is missing or damaged: "), "digest")).cast("binary"))
    out = out.withColumn("payload", whole)
    return out.withColumn("record", F.concat("header", "head", F.when(F.col("held"), F.col("payload")).otherwise(F.lit(b"")))).drop("__size")


def field(name: str, header: Column) -> Column:
    """A named field of a record's header, null where it has none."""
    found = F.regexp_extract(header.cast("string"), rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def round_trip(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, from an archive read back.

    The archive is written to the shared folder; all columns but page_id and refers_to are taken from the restored bytes
    of the record and its payload. Nulls, copies and repeated rows as in ``page_records``; an empty table gives an empty
    table.
    """
    spark = pages.sparkSession
    folder = shared_place(spark, "warc")
    records, _ = page_records(pages)
    store(pages.select(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")), records, folder)
    back = restore(spark, folder)
    size = F.octet_length("header") + F.octet_length("head")
    own = F.substring("record", size + 1, F.octet_length("record") - size)  # the bytes after the heads, as a reader finds them
    full = F.when(F.col("held"), own).otherwise(F.col("payload"))
    told = F.octet_length("record") == F.octet_length("header") + field("Content-Length", F.col("header")).cast("long")
    digest = F.when(told, F.sha2(full, 256)).otherwise(F.raise_error(F.lit("a record is not as long as its header says")))
    return back.select("page_id", F.octet_length(full).cast("long").alias("payload_bytes"), digest.alias("payload_digest"), field("WARC-Type", F.col("header")).alias("record_type"), "refers_to")


def write_files(restored: DataFrame, path: str, compression: str = "none") -> None:
    """Restored records as WARC files, one for each task; compression none or gzip. Records that only refer stay revisits."""
    restored.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header, block) of each record of a WARC file; gzip files and files of gzip members are unpacked first.

    Raises ValueError where a record is cut off or has no length.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # line ends between records
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        header = data[at : end + 4]
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r$", header)
        if not length:
            raise ValueError(f"record at byte {at} has no Content-Length")
        block = data[end + 4 : end + 4 + int(length[1])]
        if len(block) < int(length[1]):
            raise ValueError(f"record at byte {at} is cut off")
        yield at, header, block
        at = end + 4 + len(block)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, digest, size, header, head, held, payload, error) of the records of WARC files.

    For responses and requests the HTTP head is apart and the payload is what follows it; a revisit's digest is the one
    that its header states in bare or prefixed hexadecimal SHA-256 (held is false), or that of its own block. A file is
    read as one value, so it must be below 2 GB and fit an executor; one that can't be parsed gives its sound records
    and a row with the error. Empty files give no rows.
    """
    names = ["file", "offset", "header", "head", "payload", "stated", "error"]
    types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, held, error = [], 0, None
                try:
                    for at, header, block in parse(content.as_py()):
                        http = re.search(rb"(?im)^content-type:[ \t]*application/http", header)
                        cut = block.find(b"\r\n\r\n") + 4 if http else 0
                        head, payload = (block[:cut], block[cut:]) if cut > 3 else (b"", block)
                        stated = re.search(rb"(?im)^warc-payload-digest:[ \t]*(?:sha256:)?([0-9a-f]{64})[ \t]*\r$", header) if re.search(rb"(?im)^warc-type:[ \t]*revisit[ \t]*\r$", header) and not payload else None
                        rows.append((file, at, header, head, payload, stated and stated[1].decode().lower(), None))
                        held += len(block)
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                except (ValueError, EOFError, OSError) as e:
                    error = str(e)
                if error:
                    rows.append((file, None, None, None, None, None, error))
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(run, "file string, offset long, header binary, head binary, payload binary, stated string, error string")
    return out.withColumns({"held": F.col("stated").isNull(), "digest": F.coalesce("stated", F.sha2("payload", 256)), "size": F.when(F.col("stated").isNull(), _bytes("payload"))}).drop("stated")


def ingest(files: DataFrame, folder: str) -> None:
    """Write the sound records of ``read_files`` as an archive. A revisit takes the size of the payload that it refers to.

    A revisit whose payload is in none of the files raises when it is restored.
    """
    sound = files.filter("error is null")
    counts = sound.groupBy("digest").agg(F.max("size").alias("known"), F.count("*").alias("n"))
    hot = hot_keys(counts.select("digest", "n"), "digest", sound.count())
    narrow = dealt(sound.drop("payload", "error"), hot, "digest", "file", "offset")
    headers = narrow.join(spread(counts.drop("n"), hot, "digest"), ["digest", SALT]).withColumn("size", F.coalesce("size", "known")).drop(SALT, "known")
    store(sound.filter("held").select("payload"), headers, folder)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
SELECT p.page_id, octet_length(p.payload)::BIGINT AS payload_bytes, sha256(p.payload) AS payload_digest,
  CASE WHEN octet_length(p.payload) >= 100 AND p.page_id IS DISTINCT FROM f.first AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(p.payload) >= 100 AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p JOIN f USING (payload)
"""
