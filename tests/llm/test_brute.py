"""Operators against brute force, other libraries, round trips and held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartloom.llm import byte_bpe, graph, html_text, license_scan, matroska, minhash, packing, pii, quality_gam, quality_rules, url_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(2).persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_rules_equal_sql(docs, duck, same):
    same(quality_rules.judge(docs).toPandas(), duck(quality_rules.ORACLE, documents=f"{SF}/documents.parquet"))


def test_rule_filter_keeps_what_the_verdict_keeps(docs):
    kept = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in quality_rules.keep_passing(docs).select("doc_id").collect()} == kept


def test_cascade_order_follows_rejection_per_cost():
    costs = [quality_rules.RuleCost("a", 1.0, 0.1), quality_rules.RuleCost("b", 0.01, 0.01), quality_rules.RuleCost("c", 0.1, 0.0)]
    assert [c.name for c in sorted(costs, key=lambda c: -c.gain)] == ["b", "a", "c"]


def test_near_groups_equal_sql(docs, duck, same):
    same(minhash.near_groups(docs).toPandas(), duck(minhash.ORACLE, documents=f"{SF}/documents.parquet"))


def test_hot_group_of_near_copies_is_linked_whole(spark, duck, same):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = []
    for i in range(260):
        ws = list(base)
        for k in rng.integers(0, len(ws), rng.integers(0, 16)):
            ws[k] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(minhash.near_groups(df).toPandas(), duck(minhash.ORACLE, documents=df.toPandas()))


def test_all_pairs_within_the_signature_distance_share_a_key(spark):
    p, rng = minhash.NearParams(), np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, p.size).astype(np.uint16)
    rows = [(0, 1, base.tobytes())]
    for i in range(1, 60):
        other = base.copy()
        other[rng.choice(p.size, p.chunks * (p.errors + 1) - 1, replace=False)] ^= 1
        rows.append((i, 1, other.tobytes()))
    k = minhash.keys(spark.createDataFrame([(n, bytearray(s)) for n, _, s in rows], "node long, sig binary"), p)
    assert k.join(k.filter("node = 0").select("key"), "key").select("node").distinct().count() == 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[102] == 100


def test_licences_equal_brute_force(docs, texts):
    for r in license_scan.scan(docs).collect():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        places = [(i, label) for p, label in license_scan.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_spans_bear_small_changes(spark):
    full = license_scan.NOTICES[1][0].split()
    changed = full[:6] + ["really"] + full[6:12] + full[13:]
    rows = [(1, " ".join(full)), (2, " ".join(changed)), (3, " ".join(full[:8]) + " zz" * 40 + " ".join(full[8:])), (4, "MIT License, mit-license; MIT LICENSE licenses")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[2].labels == "mit" and got[3].labels == ""
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (3, 0, 4)


def test_bpe_equals_the_library(docs, texts):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.digests(docs).collect():
        ids = want.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    few = docs.limit(20)
    back = {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode_ids(byte_bpe.encode_texts(few)).collect()}
    assert all(texts[k] == v for k, v in back.items())


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.slot_of_key.tolist()) == list(range(5000)) and table.slots(keys).tolist() == table.slot_of_key.tolist()


def test_classifier_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_gam.train(docs, labels)
    got = quality_gam.classify(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.97
    assert set(quality_gam.classify(docs, model).filter("held_out").select("doc_id").toPandas().doc_id) == {i for i in docs.toPandas().doc_id if zlib.crc32(str(i).encode()) % 5 == 0}


def test_pairwise_tables_learn_what_single_ones_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality_gam.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("lacing", ["xiph", "ebml", "fixed", "auto"])
def test_matroska_round_trip(lacing):
    data = np.random.default_rng(1).integers(0, 256, 64 * 3001, dtype=np.uint8).tobytes()
    size = 640 if lacing == "fixed" else 700
    data = data[: len(data) // (size * 8) * size * 8] if lacing == "fixed" else data
    media = matroska.mux(data, frame=size, laced=8, blocks=5, lacing=lacing)
    m = matroska.parse(media)
    assert b"".join(media[p[3] : p[3] + p[4]] for p in m.packets) == data
    assert m.doctype == "matroska" and m.tracks[1]["codec"] == "A_PCM/INT/LIT" and m.duration == len(data)
    samples = np.cumsum([0] + [p[4] for p in m.packets])[:-1]
    assert [p[1] for p in m.packets] == [int(s) * 125_000 for s in samples]
    assert len(m.cues) == len(m.clusters) and all(media[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in m.cues)


def test_packet_table_and_broken_files(spark):
    good = matroska.mux(b"x" * 6400)
    rows = [(1, bytearray(good)), (2, bytearray(good[:200])), (3, None), (4, bytearray(b"junk"))]
    got = matroska.packets(spark.createDataFrame(rows, "file long, body binary"), "file", "body").collect()
    assert sum(r["size"] for r in got if r.file == 1) == 6400 and all(r.error for r in got if r.file != 1) and {r.file for r in got} == {1, 2, 3, 4}
    live = good.replace(b"\x18\x53\x80\x67" + matroska._vint(len(good) - good.index(b"\x18\x53\x80\x67") - 6), b"\x18\x53\x80\x67\x01" + b"\xff" * 7)
    assert len(matroska.parse(live).packets) == len(matroska.parse(good).packets)


def test_pages_give_their_article(spark):
    import html as h

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.find("<article>") :]
        body = body[: body.find("</article>")] if "</article>" in body else re.sub(r"<[^>]*$", "", body)
        parts = (re.sub(r"\s+", " ", h.unescape(x.replace("<br>", " ").replace("<b>", ""))).strip() for x in re.split(r"</?p>|</?h1>|</?article>", body))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_pages_without_article_elements():
    prose = " ".join(["Some words of running text that go on for a while,"] * 4)
    page = f"<div><a href=/>Home</a></div><div><a href=/b>Blog</a></div><h2>Title here now</h2><p>{prose}</p><p>short one</p><p>{prose}</p><div class='comments'><p>{prose}</p></div><div><a href=/x>more</a></div>"
    assert html_text.main_text(page, html_text.train()).split("\n") == [prose, "short one", prose]


def test_packing_is_exact_and_tight(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).toPandas()
    ids = {k: np.array([*e.ids, 1], "<u4") for k, e in zip(texts, t.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    got = got.sort_values(["doc_id", "start"])
    assert (got.groupby("doc_id").length.cumsum() - got.length == got.start).all() and got.length.sum() == sum(map(len, ids.values()))
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.98


def test_patterns_meet_every_demand():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 5, 8, 13, 21, 34])
    demand = rng.integers(1, 200, 6)
    found = packing.patterns(sizes, demand, 64)
    assert (sum(n * a for a, n in found) >= demand).all() and all(a @ sizes <= 64 for a, _ in found)
    # no two of the largest size fit together
    assert sum(n for _, n in found) <= max(-(-int(sizes @ demand) // 64), int(demand[-1])) + 6


def test_urls_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(9001, "ftp://X.Org/fr/a?b#c", ""), (9002, "http://notnet/de/", ""), (9003, "http://a.net", ""), (9004, "http://example.net/en/", "")], "page_id long, url string, html string"))
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_rules.judge(pages).collect():
        head, sep, rest = urls[r.page_id].partition("://")
        host = re.split(r"[/?#]", rest, maxsplit=1)[0] if sep else ""
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(n), n, v) for n, v in url_rules.RULES for d, p in [n.split("/", 1)] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        assert (r.host, r.path) == (host, path) and r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_mined_rules_are_confident(spark):
    rows = [(["host:a", "path:x"], "block")] * 30 + [(["host:a", "path:y"], "allow")] * 30 + [(["host:b", "path:x"], "block")] * 30
    mined = url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string")).collect()
    said = {(tuple(r.antecedent), r.verdict) for r in mined}
    assert (("path:x",), "block") in said and (("path:y",), "allow") in said and all(r.confidence >= 0.9 for r in mined)
    assert (("host:b", "path:x"), "block") not in said


PRIVATE = [
    (1, "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM now, ip 97.51.17.173."), (2, "call +1 (017) 555-7713, card 4689387053447877 and 4111 1111 1111 1111 ok"),
    (3, 'x### token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### z'), (4, "Mr. John Smith met Mrs Anna Smith and Herr Smith; Госпожа Анна Иванова"), (5, "again und.34@mail7.example.com, 123-45-6789"),
]


def luhn(s):
    ds = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(ds)) % 10


def test_surrogates_keep_type_form_and_coreference(spark):
    df = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df, "k1").collect()}
    for i, text in PRIVATE:
        for e in re.findall(r"\S+@\S+|[\d.]{9,}|[\d -]{11,}|Smith|John|Anna|Анна|Иванова", text):
            assert e.strip(" .") not in got[i].text
    mails = re.findall(r"[\w.]+@[\w.]+\.com", got[1].text, re.I)
    assert len(mails) == 2 and mails[0].upper() == mails[1] and mails[0] in got[5].text and mails[0].endswith(".example.com")
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}, card \d{16} and \d{4} \d{4} \d{4} \d{4} ok", got[2].text)
    cards = re.findall(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4})", got[2].text)[0]
    assert luhn(cards[1]) == 0 and cards[0][0] == "4" and re.search(r'token = "[0-9a-f]{40}"', got[3].text)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+) and Herr (\w+); Госпожа ([А-яё]+) ([А-яё]+)", got[4].text)
    assert m and m[2] == m[4] == m[5] and m[3].endswith(("a", "elle")) and m[6].endswith(("а", "ия"))
    assert pii.report(df, "k1").filter("doc_id = 1").first().text == got[1].text != pii.report(df, "k2").filter("doc_id = 1").first().text
    assert got[1].types == "email,ip" and got[1].n_entities == 3


def test_clashes_are_drawn_again(spark):
    names = spark.createDataFrame([("ip", f"10.0.{i // 250}.{i % 250 + 1}") for i in range(500)] + [("ssn", f"{i:09d}") for i in range(2000)] + [("pin", str(i)) for i in range(10)], "type string, canon string")
    small = spark.createDataFrame([("surname", f"n{i}") for i in range(3000)], "type string, canon string").union(names.filter("type <> 'pin'"))
    again = pii.clashes(small, "k")
    drawn = small.join(again, ["type", "canon"], "left").withColumn("s", pii.surrogate("k", F.col("type"), F.col("canon"), F.coalesce("attempt", F.lit(0))))
    assert drawn.select("type", "s").distinct().count() == small.count()
    assert drawn.join(small.select("type", F.col("canon").alias("s")), ["type", "s"], "left_semi").count() == 0


def test_no_planted_entity_survives(docs, texts):
    found = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}|[0-9a-f]{40}")
    for r in pii.report(docs, "k").collect():
        hits = set(found.findall(texts[r.doc_id]))
        assert not hits & set(found.findall(r.text)) and (hits or r.text == texts[r.doc_id])


def test_pipeline_stages_agree_with_their_operators(spark, docs):
    import corpus_pipeline as c

    held = docs.limit(400).persist()
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, held, SF).persist()
        assert out.columns == held.columns
        ids, kept = ({r.doc_id for r in d.select("doc_id").collect()} for d in (held, out))
        want = {"quality_rules": lambda: {r.doc_id for r in quality_rules.judge(held).filter("kept").collect()}, "near_dedup": lambda: {r.doc_id for r in minhash.near_groups(held, minhash.NearParams(words=5)).filter("kept").collect()}, "pii": lambda: ids}.get(name)
        assert kept <= ids and (want is None or kept == want())
        held = out
    packed = c.STAGES[-1][1](spark, held, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in held.select("doc_id").collect()}
