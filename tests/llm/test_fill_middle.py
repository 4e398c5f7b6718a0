"""Fill-in-the-middle and its boundary lists against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heartloom.llm import eliasfano, fill_middle


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a é日😀́<P>", max_size=400))
def test_lists_give_every_boundary(text):
    data = text.encode()
    want = [len(text[:i].encode()) for i in range(len(text) + 1)]
    code = eliasfano.encode(eliasfano.boundaries(data))
    assert eliasfano.size(code) == len(text) + 1 and [eliasfano.select(code, i) for i in range(len(text) + 1)] == want


def test_lists_of_sparse_and_long_numbers():
    rng = np.random.default_rng(1)
    for values in (np.cumsum(rng.integers(0, 1000, 3000)), np.array([0]), np.array([7, 7, 7, 10**12]), np.cumsum(rng.integers(0, 2, 20_000))):
        code = eliasfano.encode(values)
        assert [eliasfano.select(code, i) for i in range(0, len(values), 7)] == values[::7].tolist()
    text = ("word " * 200_000).encode()
    code = eliasfano.encode(eliasfano.boundaries(text))
    assert eliasfano.select(code, 777_777) == 777_777 and len(code) < 0.4 * len(text)


def brute(doc_id, text):
    """The contract, by slices of the text."""
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, m, z = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{x}<S>{z}<M>{m}", "spm": f"<S>{z}<P>{x}<M>{m}"}[form]
    return (doc_id, n, form, *((None, None) if form == "plain" else (a, b - a)), out)


def rows():
    rng = random.Random(5)
    made = ["".join(rng.choices("abc é日😀\n\x00", k=rng.randint(0, 60))) for _ in range(150)]
    out = list(enumerate(made)) + [(200 + i, "a text that a third of all documents share, é 😀") for i in range(90)]
    return out + [(300, None), (301, ""), (302, "x<P>y"), (303, "<M>"), (304, "<S"), (305, "long ü " * 40_000), (306, "long ü " * 40_000), (None, "no id"), (307, "twice"), (307, "twice"), (-5, "negative")]


def test_transform_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", 3, 4) for r in rows()], "doc_id long, text string, digest string, n long, __salt long")
    want = sorted((brute(*r) for r in rows()), key=str)
    assert sorted((tuple(r) for r in fill_middle.transform(docs).collect()), key=str) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {(i, len(t or "")): t or "" for i, t in rows()}
    got = fill_middle.digests(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((*w[:5], sha(w[5]), sha(texts[w[0], w[1]])) for w in want), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs.limit(0)).count() == fill_middle.transform(docs.limit(0)).count() == 0


def test_index_holds_a_text_once(spark):
    docs = spark.createDataFrame([(*r,) for r in rows()], "doc_id long, text string")
    index = fill_middle.index(fill_middle.distinct_texts(docs)).collect()
    assert len(index) == len({t or "" for _, t in rows()}) and sum(r.marked for r in index) == 2
    assert all(eliasfano.size(r.bounds) == r.n + 1 for r in index)


def test_outputs_are_rebuilt():
    for text in ("", "a", "ab\ncd", "P><S", "é😀"):
        data = text.encode()
        cuts = [len(text[:i].encode()) for i in range(len(text) + 1)]
        for a in cuts:
            for b in cuts:
                for form in ("plain", "psm", "spm"):
                    if a <= b:
                        assert fill_middle.rebuild(fill_middle.spell(data, a, b, form), form) == data
