"""Fill-in-the-middle by a distinct-text index: boundary lists once per text, a seeded cut per document.

1. Equal texts are grouped by SHA-256, verified by length and an independent 64-bit hash; each text moves once.
2. The index holds each distinct text's Elias-Fano list of code point boundaries (``eliasfano``).
3. Documents, as narrow rows of id and digest, are joined to the index; each one's two seeded cuts are selected from the
   list, which gives byte offsets without a walk over the text.
4. Cuts meet the texts of step 1 where these already lie (the same shuffle), and each document's output is spelled out.

A text that many documents share is dealt over many tasks in steps 3 and 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartloom.llm import eliasfano
from heartloom.llm.common import SALT, bounded_batches, dealt, hot_keys, spread

#: Marks of the parts. Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents in a hundred that are cut, and of these the ones whose suffix comes first. Fixed values.
CUT, SPM = 90, 20


def seeds(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits from the hash of the seed and a document's id; a null id counts as an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def spell(text: bytes, a: int, b: int, form: str) -> bytes:
    """A document's output from its text, the byte offsets of its cuts and its form."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "plain":
        return text
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


def rebuild(output: bytes, form: str) -> bytes:
    """The text of an output; its marks stand once each, for texts that hold one stay plain."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(digest, text): each distinct text once; copies meet in their own task before they are shuffled.

    No digest is null; that is said as a filter, which later joins would add on some ways to this table and not on
    others, so that all of them read one shuffle.
    """
    held = _keyed(docs).filter("digest is not null").withColumns({"size": F.octet_length("text"), "check": F.xxhash64("text")})
    one = held.groupBy("digest").agg(F.first("text").alias("text"), F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    sure = F.when((F.col("s0") == F.col("s1")) & (F.col("c0") == F.col("c1")), F.col("text")).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("binary"))
    return one.select("digest", sure.alias("text"))


def index(texts: DataFrame) -> DataFrame:
    """(digest, n, marked, bounds) of distinct texts (digest, text): the number of code points, whether the text holds a
    mark, and the Elias-Fano list of its boundaries."""
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text"):
                text = t.as_py()
                code = eliasfano.encode(eliasfano.boundaries(text))
                out.append((eliasfano.size(code) - 1, any(x in text for x in marks), code))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.binary()), strict=True))], ["digest", "n", "marked", "bounds"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n long, marked boolean, bounds binary")


CUTS = "doc_id long, digest binary, n long, form string, prefix_chars long, middle_chars long, a long, b long"


def cuts(ids: DataFrame, found: DataFrame, hot: DataFrame, seed: str = "1") -> DataFrame:
    """Each document's form and cuts, in code points and as byte offsets, of ids (doc_id, digest) and a spread index."""
    h1, h2, h3, h4 = seeds(F.col("doc_id"), seed)
    drawn = ids.withColumns({"h1": h1, "h2": h2, "h3": h3, "h4": h4})
    met = dealt(drawn, hot, "digest", "doc_id").join(found, ["digest", SALT])
    plain = (F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= CUT)
    met = met.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SPM, "spm").otherwise("psm"))
    x, y = (F.when(F.col("form") != "plain", F.pmod(c, F.col("n") + 1)) for c in ("h1", "h2"))
    held = met.select("doc_id", "digest", "n", "form", F.least(x, y).alias("p"), F.greatest(x, y).alias("q"), F.when(F.col("form") != "plain", F.col("bounds")).alias("bounds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [(None, None) if p is None else (eliasfano.select(c.as_py(), p), eliasfano.select(c.as_py(), q)) for p, q, c in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), batch.column("bounds"), strict=True)]
            p, q = batch.column("p"), batch.column("q")
            middle = pa.array([None if x is None else y - x for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "n", "form")), p, middle, *(pa.array([r[i] for r in at], pa.int64()) for i in (0, 1))], [x.split()[0] for x in CUTS.split(", ")])

    return held.mapInArrow(run, CUTS)


def _joined(docs: DataFrame, seed: str) -> DataFrame:
    """One row per document with its text and cuts."""
    bounded_batches(docs.sparkSession)
    ids = _keyed(docs).select("doc_id", "digest")
    hot = hot_keys(ids.groupBy("digest").agg(F.count("*").alias("n")), "digest", docs.count())
    texts = distinct_texts(docs)
    found = spread(index(texts), hot, "digest").repartition("digest", SALT)  # one shuffle that both ways below read
    cold = texts.join(cuts(ids.join(hot, "digest", "left_anti"), found, hot, seed), "digest")
    few = spread(texts.join(hot.select("digest"), "digest", "left_semi"), hot, "digest")
    many = dealt(cuts(ids.join(hot.select("digest"), "digest", "left_semi"), found, hot, seed), hot, "digest", "doc_id")
    return cold.unionByName(few.join(many, ["digest", SALT]).drop(SALT))


def transform(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the transformed text) of every row of docs.

    A null text is an empty one, and stays plain; repeated rows give equal rows, each of them; rows without doc_id are
    cut by the seed of an empty id; very long texts are cut whole; extra columns are left out; an empty table gives an
    empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [spell(t.as_py(), a, b, form) for t, a, b, form in zip(batch.column("text"), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary()).cast(pa.string())], [*names, "output"])

    return _joined(docs, seed).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def digests(docs: DataFrame, seed: str = "1") -> DataFrame:
    """The same with the hashes of the output and of the text rebuilt from it instead of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, back = [], []
            for t, a, b, form in zip(batch.column("text"), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("form").to_pylist(), strict=True):
                made = spell(t.as_py(), a, b, form)
                out.append(hashlib.sha256(made).hexdigest())
                back.append(hashlib.sha256(rebuild(made, form)).hexdigest())
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string()), pa.array(back, pa.string())], [*names, "output_sha256", "restored_sha256"])

    return _joined(docs, seed).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q FROM s),
c AS (SELECT *, substring(text, 1, p) AS a, substring(text, p + 1, q - p) AS m, substring(text, q + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
