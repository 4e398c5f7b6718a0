"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from heartloom.llm import byte_bpe, html_text, license_scan, matroska, minhash, packing, pii, quality_gam, quality_rules, url_rules

LONG = " ".join(f"w{i % 977}x{i % 7}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, hub string, size long, rid long"
ROWS = [
    (1, "a plain text of some words, which is short", "en", "s", 1, "x", "k", "h", 1, 1), (1, "a plain text of some words, which is short", "en", "s", 1, "x", "k", "h", 1, 1),
    (2, None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "", "", "", 0, 0), (4, " \t\n ", "en", "s", 4, "", "", "", 0, 0),
    (None, "no id here, mail a.b@mail1.example.com", "en", "s", 9, "x", "k", "h", 1, 1), (5, LONG, "en", "s", len(LONG), "x", "k", "h", 1, 1), (6, "😀 x́ é   z\x00", "en", "s", 3, "x", "k", "h", 1, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + ("### $$$ " * 9 if i % 2 else "good words here " * 9)) for i in range(60)], "doc_id long, text string")
    return quality_gam.train(docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality")))


def run(name, df, model):
    ops = {
        "pii": lambda d: pii.report(d, "k"), "rules": quality_rules.judge, "license": license_scan.scan, "bpe": byte_bpe.digests, "gam": lambda d: quality_gam.classify(d, model),
        "near": minhash.near_groups, "matroska": matroska.round_trip, "packing": packing.pack,
    }
    return ops[name](df)


NAMES = ("pii", "rules", "license", "bpe", "gam", "near", "matroska", "packing")


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows_have_defined_results(docs, model, name):
    got = run(name, docs, model).collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, None} and {r.doc_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
        return
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    check = {
        "pii": lambda: by[2].text is None and by[3].text == "" and by[None].n_entities == 1 and "a.b@" not in by[None].text and by[5].text == LONG,
        "rules": lambda: by[2].base_failed and by[2].n_words == 0 and not by[4].kept and by[5].n_words == 30_000,
        "license": lambda: by[2].n_words == 0 and by[2].labels == "" and by[2].score == 0 and by[2].first_word is None,
        "bpe": lambda: by[2].n_tokens == by[3].n_tokens == 0 and by[2].ids_sha256 == by[3].ids_sha256,
        "gam": lambda: by[2].score == by[3].score and not by[None].held_out and all(0 <= r.score <= 1 for r in got),
        "near": lambda: by[1].component_id == 1 and by[2].n_shingles == by[4].n_shingles == 0 and by[None].component_id is None and by[None].kept and [r.kept for r in got if r.doc_id == 1] == [True, True],
        "matroska": lambda: by[2].payload_bytes == by[3].payload_bytes == 64 and by[2].media_sha256 == by[3].media_sha256,
    }[name]
    assert check()


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_tables(docs, model, name):
    assert run(name, docs.limit(0), model).count() == 0


def test_filters_keep_columns(docs, model):
    for kept in (quality_rules.keep_passing(docs), quality_gam.keep_good(docs, model), minhash.keep_first(docs), pii.pseudonymise(docs, "k")):
        assert kept.columns == docs.columns
    assert quality_rules.keep_passing(docs.limit(0)).count() == 0 and minhash.keep_first(docs.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.net/x", "<p>one"), (2, None, None), (3, "no scheme", ""), (None, "https://B.example.NET/en/?q#f", "<article>t <b>b</article>"), (4, "http://a.net/x", "<p>one")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, items string")
    text = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert text[2] == text[3] == "" and text[None] == "t b"
    got = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert got[1].rule == "net/" and got[1].verdict == "block" and got[2].host == "" and got[2].verdict == "allow" and got[2].rule is None
    assert got[None].host == "b.example.net" and got[None].path == "/en/" and got[None].rule == "example.net/en/" and got[None].verdict == "allow"
    assert html_text.extract(pages.limit(0)).count() == 0 and url_rules.judge(pages.limit(0)).count() == 0
