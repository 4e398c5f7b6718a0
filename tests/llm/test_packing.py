"""Ids of odd texts against the library, and the linear program's limit."""

import logging

import numpy as np

from heartloom.llm import packing

ODD = [
    "", None, " \t\n ", "é x́ é", "ΑΣ ΑΣΑ İstanbul don't we'LL 'S it''s a ́b", "１２ ½ x²", "日本語 テスト　全角",
    "a b c\x85d", "<|startoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "ﬁ ǅ ß ẞ K Å", "x\x00y \x1c z", "\U0001f600\U0001f600 ê", "Ά·;;͵ΐ ῦ ς", "﻿bom a​b",
    "'''s 's's don'td 12'3", "a" * 5000 + " " + "!?" * 3000,
]


def test_odd_texts_equal_the_library():
    from tokenizers import Tokenizer

    p = packing.PackParams(memo=8)
    held, whole = packing.Encoder(p), Tokenizer.from_file(p.vocabulary)
    for texts in (ODD, ODD[::-1], *([x] for x in ODD)):
        ids, ends = held.encode(texts, 1)
        for text, got in zip(texts, np.split(ids, ends)[:-1], strict=True):
            assert got.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1], text


def test_a_stopped_linear_program_is_logged_and_meets_demand(caplog):
    sizes, demand = np.arange(1, 40), np.arange(40, 1, -1)
    with caplog.at_level(logging.WARNING):
        found = packing.patterns(sizes, demand, 97, steps=2)
    assert "stopped after 2 columns" in caplog.text and (sum(n * a for a, n in found) >= demand).all()


def test_ties_and_null_ids(spark):
    docs = spark.createDataFrame([(i % 3 or None, "same words here", "x", 1) for i in range(30)], "doc_id long, text string, size string, salt int")
    got = packing.pack(docs).toPandas()
    assert len(got) == 30 and got.sequence_id.nunique() == 1 and sorted(got.offset) == list(range(0, 30 * got.length[0], got.length[0]))
