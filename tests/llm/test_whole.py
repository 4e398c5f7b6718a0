"""Operators do the whole job: cases that a shortcut once lost."""

import re
from itertools import combinations

from pyspark.sql import functions as F

from heartloom.llm import html_text, minhash, pii


def five_word_kept(rows):
    """Smallest doc_id of each component of texts of similarity 0.8 and more on five-word shingles, by all pairs."""
    sets = {i: {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} for i, ws in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i for i in sets if root[i] == i}


def test_near_stage_equals_five_word_brute_force(spark):
    import corpus_pipeline

    rows = []
    for g in range(6):
        ws = [f"g{g}w{i}" for i in range(100)]
        scattered, once = list(ws), list(ws)
        for k in (10, 28, 46, 64, 82):
            scattered[k] = f"x{k}"
        once[50] = "y"
        rows += [(10 * g, " ".join(ws)), (10 * g + 1, " ".join(scattered)), (10 * g + 2, " ".join(once)), (10 * g + 3, " ".join(ws).upper().lower())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == five_word_kept(rows) == {10 * g + k for g in range(6) for k in (0, 1)}
    assert {r.doc_id for r in minhash.keep_first(docs).collect()} == {10 * g for g in range(6)}


def test_dense_short_forms_get_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [f"{c}@example.com" for c in letters] + [f"{i}@qq.com" for i in range(10)] + ['token = "!!!!!!"', 'token = "??????"'] + [f"+1{i:04d}" for i in range(0, 10_000, 16)] + [f"+19{i:03d}" for i in range(1000)]
    rows = list(dict.fromkeys(rows))
    docs = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.report(docs, "k").collect()}
    new = [got[i][4:-6] for i in range(len(rows))]
    assert len(set(new)) == len(rows) and not set(new) & set(rows)
    for old, x in zip(rows, new, strict=True):
        form = r"[a-z]*[a-z]@example\.com" if "example" in old else r"[a-z]*\d@qq\.com" if "qq" in old else r'token = "[^"!?]+"' if "token" in old else r"\+1\d{4,}"
        assert re.fullmatch(form, x), (old, x)


def test_dense_names_and_phones_are_solved(spark):
    phones = [("phone", f"+1{i:04d}") for i in range(10_000)]
    df = spark.createDataFrame([*phones, *(("email", f"{c}@example.com") for c in "abcdefghijklmnopqrstuvwxyz")], "type string, canon string")
    again = pii.clashes(df, "k")
    drawn = df.join(again, ["type", "canon"], "left").select("type", "canon", pii.surrogate("k", F.col("type"), F.col("canon"), F.coalesce("attempt", F.lit(0))).alias("s")).collect()
    new = {(r.type, r.s) for r in drawn}
    assert len(new) == len(drawn) == 10_026 and not new & {(r.type, r.canon) for r in drawn}


def test_long_secrets_and_local_parts_are_replaced_whole(spark):
    jwt, digits, local = "eyJ" + "aB3-xY_9." * 600, "0123456789abcdef" * 300, "first.last" * 20
    texts = [f'token = "{jwt}" end', f"sum {digits} end", f"sum {digits.upper()} end", f"mail {local}@mail.example.com end", f"mail ..{local}@mail.example.com end", "a.b-" * 50_000 + " " + "ab01" * 50_000 + "g end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs, "k").collect()}
    for i in range(5):
        assert got[i].n_entities == 1 and len(got[i].text) == len(texts[i]) and got[i].text.endswith(" end")
    assert got[0].types == got[1].types == got[2].types == "secret" and got[3].types == got[4].types == "email"
    assert not any(x in got[i].text for i, x in ((0, jwt[:40]), (0, jwt[-40:]), (1, digits[:32]), (1, digits[-32:]), (2, digits.upper()[:32]), (3, "first"), (4, "first")))
    assert got[3].text.endswith(".example.com end") and got[5].n_entities == 0 and got[5].text == texts[5]


def test_article_survives_names_and_forms_around_it():
    prose = "This is a sentence of the article that has a dozen words and more in it. " * 3
    article = f"<article><h1>Heading</h1><p>{prose}</p></article>"
    pages = [
        f'<html class="no-sidebar"><body class="page has-sidebar">{article}</body></html>', f'<body class="page-header modal">{article}</body>', f'<body><div class="wrap with-header">{article}</div></body>',
        f'<body><div class="widget social">{article}</div></body>', f'<body><form action="/x">{article}</form></body>', f'<body><form><div class="sidebar"><main><p>Heading</p><p>{prose}</p></main></div></form></body>',
    ]
    tree = html_text.train()
    nav = '<nav><a href="/">Home</a></nav><div class="sidebar"><p>Related things are here</p></div>'
    for page in pages:
        assert html_text.main_text(page.replace("<body", f"{nav}<body", 1), tree) == f"Heading\n{prose.strip()}", page
    assert html_text.main_text(f'<body><div class="has-sidebar"><p>{prose}</p></div></body>', tree) == prose.strip()
    inner = f'<article><p>{prose}</p><div class="share-bar"><p>Share this</p></div></article>'
    assert html_text.main_text(inner, tree) == prose.strip()
    assert html_text.main_text(f'<body><article><p>{prose}</p></article><aside><article><p>{prose}</p></article></aside></body>', tree) == prose.strip()
