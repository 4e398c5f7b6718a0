"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are computed in Arrow tasks. Shallow trees are boosted cyclically, one feature at a time, on
binned features, so each feature ends as a lookup table; the strongest pairs get tables of their own in the same way.
Scoring adds one table entry per feature and pair to an intercept, vectorised over a batch.

Only a bounded sample of labelled rows reaches the driver (``GamParams.sample`` rows of a few numbers); the model is a
few thousand numbers, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartloom.llm.wordhash import SPACES, hashes, mix, spans

FEATURES = ("words", "word_length", "symbols", "digits", "upper", "punctuation", "non_ascii", "distinct", "repeated", "stutter", "lines", "dup_lines", "line_words", "word_sd")


@dataclass(frozen=True)
class GamParams:
    """sample bounds the labelled rows that are fitted; bins the table size of a feature; pairs the pairs kept."""

    sample: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    leaves: int = 3
    threshold: float = 0.3


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_CLASSES = np.stack([
    _class("#*$%&|<>{}[]=@~^\\"), _class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("!?;:"),
    (np.arange(256) >= 0xC0).astype(float), ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)).astype(float), SPACES.astype(float),
])


def features(text: bytes) -> np.ndarray:
    """The features of one text; all finite, zeros for an empty one."""
    data = np.frombuffer(text, np.uint8)
    counts = _CLASSES @ np.bincount(data, minlength=256)
    starts, ends = spans(data)
    n = len(starts)
    if not n:
        return np.zeros(len(FEATURES))
    length = (ends - starts).astype(float)
    ws = hashes(data, starts, ends)
    chars = max(counts[5] - counts[6], 1.0)
    grams = ws
    for i in (1, 2, 4):  # 8-word windows by doubling
        grams = mix(grams[:-i] * np.uint64(0xD6E8FEB86659FD93) + grams[i:]) if len(grams) > i else grams[:0]
    repeated = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
    cuts = np.flatnonzero(data == 10)
    first, last = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(data)]))
    full = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    line = hashes(data, first[full], last[full])
    return np.array([
        n, chars / n, counts[0] / n, counts[1] / chars, counts[2] / chars, counts[3] / n, counts[4] / chars, len(np.unique(ws)) / n,
        repeated, np.count_nonzero(ws[1:] == ws[:-1]) / n, len(line), 1 - len(np.unique(line)) / len(line), n / len(line), length.std(),
    ])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    return np.stack([features(x or b"") for x in texts]) if texts else np.empty((0, len(FEATURES)))


def featurise(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named in keep and an array column f with the features."""
    schema = docs.select(*keep).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(list(_matrix(batch)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), rows], [*keep, "f"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{schema}, f array<double>")


@dataclass
class Gam:
    """edges[i] bins feature i; tables[i] is its lookup; pair tables are over coarser edges."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[i], x[:, i], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The values of a tree of that many leaves over ordered bins, split greedily by gain; g, h: sums by bin."""
    parts, gain = [(0, len(g))], lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    while len(parts) < leaves:
        best = None
        for a, b in parts:
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if not len(left_g):
                continue
            right_g, right_h = g[a:b].sum() - left_g, h[a:b].sum() - left_h
            gains = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - gain(a, b)
            k = int(np.argmax(gains))
            if best is None or gains[k] > best[0]:
                best = (gains[k], a, b, a + k + 1)
        if best is None or best[0] <= 1e-9:
            break
        parts.remove(best[1:3])
        parts += [(best[1], best[3]), (best[3], best[2])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree that splits a grid once by row and once by column, at the places of most gain."""
    if min(g.shape) < 2:
        return np.full_like(g, g.sum() / (h.sum() + 1.0))
    cg, ch = (a.cumsum(0).cumsum(1) for a in (g, h))
    part = lambda a: (a[:-1, :-1], a[:-1, -1:] - a[:-1, :-1], a[-1:, :-1] - a[:-1, :-1], a[-1, -1] - a[:-1, -1:] - a[-1:, :-1] + a[:-1, :-1])
    gains = sum(x**2 / (y + 1.0) for x, y in zip(part(cg), part(ch), strict=True))
    r, k = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, r + 1), slice(r + 1, None)):
        for cols in (slice(0, k + 1), slice(k + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, p: GamParams = GamParams()) -> Gam:
    """Fit by Newton boosting of the log-loss. Without rows, or with one class only, the score is the prior."""
    n, m = x.shape if len(x) else (0, len(FEATURES))
    prior = (y.sum() + 1) / (n + 2)
    model = Gam(float(np.log(prior / (1 - prior))), [np.empty(0)] * m, [np.zeros(1)] * m, [np.empty(0)] * m, [], [])
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, i], p.bins) for i in range(m)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, i], p.pair_bins) for i in range(m)]
    at = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.edges)]
    z = np.full(n, model.intercept)

    def step(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.bincount(codes, y - q, size), np.bincount(codes, q * (1 - q), size)

    for _ in range(p.rounds):
        for i in range(m):
            move = p.rate * _tree(*step(at[i], len(model.tables[i])), p.leaves)
            model.tables[i] = model.tables[i] + move
            z += move[at[i]]
    coarse = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]
    gains = []
    for i, j in combinations(range(m), 2):
        g, h = step(coarse[i] * wide[j] + coarse[j], wide[i] * wide[j])
        gains.append((float((g**2 / (h + 1)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[: p.pairs]]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(p.pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            codes = coarse[i] * wide[j] + coarse[j]
            g, h = step(codes, wide[i] * wide[j])
            g, h = g.reshape(wide[i], wide[j]), h.reshape(wide[i], wide[j])
            move = _quarters(g, h)
            move *= p.rate
            model.pair_tables[k] = model.pair_tables[k] + move
            z += move[coarse[i], coarse[j]]
    return model


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, p: GamParams = GamParams()) -> Gam:
    """Fit on at most p.sample labelled documents, none of them held out, drawn by a hash of doc_id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna()
    drawn = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    rows = featurise(docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(drawn), "doc_id"), "doc_id", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.f))
    return fit(np.array([r.f for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float), p)


def classify(docs: DataFrame, model: Gam, p: GamParams = GamParams()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= the threshold).

    Null and empty texts are scored as texts without words, very long ones whole. Equal texts tie. A null doc_id stays null and isn't held out. Repeated rows
    are scored alone; extra columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= p.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Gam, p: GamParams = GamParams()) -> DataFrame:
    """docs without the rows that are predicted 0; columns unchanged.

    Null and empty texts are scored as texts without words, very long ones whole; equal texts share a fate; null doc_ids,
    repeated rows and extra columns are kept as they are; an empty table gives an empty table.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = [features((x or "").encode()) for x in texts]
        return pd.Series(model.score(np.stack(rows)) if rows else np.empty(0))

    return docs.filter(score(F.col("text").cast("string")) >= p.threshold)
