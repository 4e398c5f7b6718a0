"""Stored media and scores against brute force, and edge rows through packets and the whole pipeline."""

import hashlib
import zlib

import numpy as np
import pytest

from heartloom.llm import byte_bpe, matroska, quality_gam

SF = "/root/testdata/sf0.01"


def test_stored_media_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in matroska.round_trip(docs).collect():
        data = texts[r.doc_id]
        payload = data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))
        media = matroska.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(media))
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest())
        said = dict(x.split("=") for x in r.feature.split(";"))
        assert int(said["sum"]) == sum(payload) and int(said["energy"]) == sum((b - 128) ** 2 for b in payload) and int(said["ms"]) == len(payload) * 1000 // 8000
        assert int(said["crossings"]) == sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False))


def test_packets_of_edge_rows(spark):
    good = bytearray(matroska.mux(b"y" * 640))
    rows = [(None, good, "a", 1), ("k", good, "a", 1), ("k", good, "a", 1), ("e", bytearray(), "a", 1), ("n", None, None, None)]
    df = spark.createDataFrame(rows, "name string, media binary, error string, size int")
    got = matroska.packets(df, "name", "media").collect()
    assert sum(r["size"] for r in got if r.name == "k") == 1280 and sum(r["size"] for r in got if r.name is None) == 640
    assert {r.name for r in got if r.error} == {"e", "n"} and matroska.packets(df.limit(0), "name", "media").count() == 0


def test_scores_equal_a_sum_of_lookups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").limit(200).collect()}
    for r in quality_gam.classify(docs.limit(200), model).collect():
        x = quality_gam.features((texts[r.doc_id] or "").encode())
        z = model.intercept
        for v, edges, table in zip(x, model.edges, model.tables, strict=True):
            z += table[sum(e <= v for e in edges)]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            z += table[sum(e <= x[i] for e in model.pair_edges[i]), sum(e <= x[j] for e in model.pair_edges[j])]
        want = 1 / (1 + np.exp(-z))
        assert r.score == pytest.approx(want) and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_ids_of_edge_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "ab ab"), (2, "ab ab")], "doc_id long, text string")
    encoded = byte_bpe.encode_texts(docs)
    back = sorted((r.doc_id or 0, bytes(r.bytes)) for r in byte_bpe.decode_ids(encoded).collect())
    assert back == [(0, b""), (1, b""), (2, b"ab ab"), (2, b"ab ab")] and byte_bpe.decode_ids(encoded.limit(0)).count() == 0


LONG = " ".join(f"{'qwertzuiop'[i % 10]}{i % 1009}ab" for i in range(20_000))
GOOD = (
    "The quick story of a river and the town beside it, told by {} people who have lived there for many years, begins in spring, when snow in distant hills turns to water "
    "and every bridge carries farmers, traders, children and dogs toward markets that smell of bread; later chapters follow one family through floods, weddings, "
    "quarrels about land, long winters without light, a fire, two elections and the slow return of storks."
)
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (None, GOOD.format("some"), "b"), (None, GOOD.format("some"), "b"), (5, GOOD.format("nine"), None), (5, GOOD.format("nine"), None), (6, GOOD.format("nine"), "c"),
    (7, LONG, "d"), (8, "### $$$ ### " * 30, "e"), (9, GOOD.format("many") + " Mail a.b@mail1.example.com or ask Mr John Smith.", "f"),
]


def test_pipeline_on_edge_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z", 1) for i, t, s in EDGE], "doc_id long, text string, lang string, source string, n_chars long, key string, hub string, new string, size int")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, held in (("edges", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        for stage, f in c.STAGES[:-1]:
            after = f(spark, held, folder)
            after.write.parquet(f"{folder}/{stage}.parquet")
            held = spark.read.parquet(f"{folder}/{stage}.parquet")
            assert held.columns == docs.columns
            rows = held.collect()
            if name == "none":
                assert not rows
            elif stage == "quality_rules":
                assert {r.doc_id for r in rows} <= {None, 5, 6, 7, 9} and {5, 9} <= {r.doc_id for r in rows}
            elif stage == "near_dedup":
                assert sum(r.doc_id is None for r in rows) in (0, 2) and not any(r.doc_id == 6 for r in rows)
            elif stage == "pii":
                assert not any("a.b@" in r.text or "John Smith" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
        packed = c.STAGES[-1][1](spark, held, folder).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in held.collect()}
