"""Licence labels and scores against brute force, small edits of every notice, and texts that only look alike."""

import re
from collections import defaultdict

import pytest

from heartloom.llm import license_scan as ls

SF = "/root/testdata/sf0.01"
P = ls.ScanParams()


def brute(text):
    """Labels and score by a quadratic search over all hits of each template, without windows or votes."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = defaultdict(list)
    for i in range(len(ws) - 1):
        at[ws[i], ws[i + 1]].append(i)
    labels, score = set(), 0.0
    for x in ls.templates(P):
        hits = sorted((i, t) for t in x.votes for i in at[x.words[t], x.words[t + 1]])
        for low in {i - t for i, t in hits}:
            some = [(i, t) for i, t in hits if low <= i - t <= low + x.drift]
            best = [[h] for h in some]
            for b, (i, t) in enumerate(some):
                for a, (j, u) in enumerate(some[:b]):
                    if j < i and u < t and len(best[a]) >= len(best[b]):
                        best[b] = [*best[a], (i, t)]
            run = max(best, key=len)
            ts = {t for _, t in run}
            if len(run) >= x.need and ts.issuperset(x.whole) and {t + k for t in ts for k in (0, 1)}.issuperset(x.telling):
                labels.add(x.label)
                score = score if x.base else max(score, len(run) / len(x.votes))
    return ",".join(sorted(labels)), round(score, 9)


def scan(spark, texts):
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(texts))]


def test_labels_and_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = ls.scan(docs).collect()
    assert {r.doc_id: (r.labels, round(r.score, 9)) for r in got} == {i: brute(x) for i, x in texts.items()} and sum(bool(r.labels) for r in got) > 5


def test_edits_of_every_notice(spark):
    texts, want = [], []
    for text, label, _ in ls.NOTICES:
        ws = text.split()
        x = next(t for t in ls.templates(P) if t.words == tuple(ws) and not t.base)
        loose = [i for i in range(len(ws)) if i not in x.telling]
        gap = next((i for i in range(len(ws) // 2, len(ws) - 1) if i not in x.whole), 0)
        for edited in (ws, ws[: gap + 1] + ["hereby"] + ws[gap + 1 :], [w for i, w in enumerate(ws) if i != loose[0]], ["thing" if i == loose[0] else w for i, w in enumerate(ws)]):
            texts.append("some words before " + " ".join(edited).upper() + " and some after")
            want.append(label)
    for text, label, r in zip(texts, want, scan(spark, texts), strict=True):
        assert label in r.labels.split(",") and (r.labels, round(r.score, 9)) == brute(text), (text, r)


ALIKE = [
    "licensed under xx under cc xx cc by xx by 4 xx 4 0", "licensed under cc by nc 4 0", "the mit license xx released under", "under the " * 500, "licensed under the gnu lesser general public license", "license apache the under licensed 0 2 version",
    "this work is licensed under the gnu general public license version 4",
]


@pytest.mark.parametrize("k", range(len(ALIKE)))
def test_texts_that_look_alike(spark, k):
    got = scan(spark, [ALIKE[k]])[0]
    assert got.labels == ["", "cc-by-nc-4.0", "mit", "", "gpl,lgpl", "", "gpl"][k] and (got.labels, round(got.score, 9)) == brute(ALIKE[k])


def test_rows_of_one_id_and_hot_texts(spark):
    rows = [(1, "mit license"), (1, "apache license"), (1, "apache license"), (None, "mit license mit license"), (None, None), (2, "general public license " * 5000), (3, ("permission is hereby granted free of charge " * 3000))]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.base_labels) for r in ls.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, template string, t int")).collect()))
    assert got == [(0, 0, 0, ""), (0, 4, 2, "mit"), (1, 2, 1, "apache"), (1, 2, 1, "apache"), (1, 2, 1, "mit"), (2, 15000, 5000, "gpl"), (3, 21000, 0, "")]


NAMED = [
    ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("under the BSD-3-Clause license", "bsd-3-clause"), ("CC BY-ND 4.0", "cc-by-nd-4.0"),
    ("Licensed under CC-BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"), ("under the Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
]


def test_tags_and_short_names(spark):
    for (text, label), r in zip(NAMED, scan(spark, [t for t, _ in NAMED]), strict=True):
        assert r.labels == label and (r.labels, round(r.score, 9)) == brute(text), (text, r)
    phrase, notice = scan(spark, ["the apache license is named", "released under the mit license"])
    assert (phrase.labels, phrase.score) == ("apache", 0.0) and (notice.labels, notice.score) == ("mit", 1.0)
