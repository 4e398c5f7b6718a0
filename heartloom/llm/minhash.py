"""Near-duplicate groups: MinHash signatures, a multi-index Hamming join, and exact confirmation.

Signatures have ``chunks * width`` components of b bits. If two signatures differ in at most
``chunks * (errors + 1) - 1`` components, then by pigeonhole some chunk differs in at most ``errors``; every way to
leave ``errors`` components of a chunk out is enumerated as a key, so all pairs within that signature distance meet
under a key. Pairs that meet are confirmed on their full shingle sets; no pair is lost to a cap.

A bucket may hold a large part of all rows, so pairs within a bucket are never all emitted. Equal sets are first one
node. Star rounds then link each node with a few hubs of its buckets, links are contracted to components, and only
nodes of buckets that still hold different components go on, to an exact prefix-filtered join on rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartloom.llm.common import BROADCAST_ROWS, cut, small
from heartloom.llm.graph import components
from heartloom.llm.wordhash import mix, shingles


@dataclass(frozen=True)
class NearParams:
    """Word shingle length, similarity in per cent, signature layout, and how far signatures may lie apart.

    ``far`` is the largest signature distance that is confirmed on full sets. It is above the guaranteed distance
    (13 with 7 chunks and 1 error), and at similarity 0.8 fewer than one pair in 10,000 lies beyond it.
    """

    words: int = 2
    percent: int = 80
    chunks: int = 7
    width: int = 5
    errors: int = 1
    far: int = 17
    hubs: int = 3
    stars: int = 2

    @property
    def size(self) -> int:
        return self.chunks * self.width


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    draw = lambda: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    return (draw() << np.uint64(1)) | np.uint64(1), draw()


def signature(items: np.ndarray, n: int) -> np.ndarray:
    """n components of 16 bits; items are hashed in blocks, so memory stays bounded for any text."""
    a, b = _factors(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1 << 14):
        low = np.minimum(low, (items[at : at + (1 << 14)][None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def sign(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """doc_id, n_shingles, and for non-empty sets a 128-bit fingerprint of the set (hi, lo) and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for text in _texts(batch, "text"):
                items = shingles(text, p.words)
                n.append(len(items))
                if not len(items):
                    hi.append(None), lo.append(None), sig.append(None)
                    continue
                hi.append(int(mix(items + np.uint64(11)).sum(dtype=np.uint64).view(np.int64)))
                lo.append(int(np.bitwise_xor.reduce(mix(items ^ np.uint64(0x5DEECE66D))).view(np.int64)))
                sig.append(signature(items, p.size).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "hi", "lo", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, sig binary")


def keys(nodes: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """(key, node) for every chunk and every choice of components left out of it."""
    left = [np.array(x) for x in combinations(range(p.width), p.width - p.errors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, p.chunks, p.width).astype(np.uint64)
            out = []
            for c in range(p.chunks):
                for k, cols in enumerate(left):
                    h = np.full(len(sigs), c * len(left) + k, np.uint64)
                    for i in cols:
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + sigs[:, c, i])
                    out.append(h)
            each = len(out)
            node = np.tile(batch.column("node").to_numpy(), each)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _distance(a: str, b: str, size: int) -> F.Column:
    """Components in which two signatures differ."""
    return F.expr(f"aggregate(sequence(0, {size - 1}), 0, (s, i) -> s + if(substring({a}, 2 * i + 1, 2) = substring({b}, 2 * i + 1, 2), 0, 1))")


def _near(pairs: DataFrame, nodes: DataFrame, p: NearParams) -> DataFrame:
    """Distinct pairs (a, b) with their signature distance, those that are too far apart left out."""
    sig = nodes.select("node", "sig")
    out = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return out.select("a", "b", _distance("sa", "sb", p.size).alias("d")).filter(F.col("d") <= p.far)


def confirm(pairs: DataFrame, docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """Pairs (a, b) of doc_ids whose full shingle sets reach the similarity.

    Only texts named by a pair are moved. A pair table of checked size is broadcast to the texts, a larger one is
    joined by shuffle.
    """
    pairs = cut(pairs)
    narrow = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if narrow else (lambda df: df)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    right = texts.join(hint(pairs), texts.doc_id == pairs.b).select("a", "b", F.col("text").alias("tb"))
    left = texts.join(hint(pairs.select("a").distinct()), F.col("doc_id") == F.col("a"), "left_semi").select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ok = []
            for ta, tb in zip(_texts(batch, "ta"), _texts(batch, "tb"), strict=True):
                if ta != last:
                    last, held = ta, shingles(ta, p.words)
                other = shingles(tb, p.words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(both > 0 and 100 * both >= p.percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return right.join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have an empty set: they are linked with nothing and kept. Rows with equal sets are
    linked. A repeated doc_id is one node, linked if any of its rows is. A row without doc_id is linked with nothing;
    its component_id is null and it is kept. Extra columns are ignored; an empty table gives an empty table.
    """
    signed = cut(sign(docs, p))
    classes = signed.filter("sig is not null and doc_id is not null").groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig"))
    nodes = cut(classes.withColumnRenamed("n_shingles", "n"))
    met = _buckets(nodes, p)
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links, label = None, None
    for turn in range(p.stars):
        if label is None:
            star = met.select("node", "hub").filter("node <> hub").distinct()
        else:  # nodes that are still apart from a hub of theirs get another hub, drawn anew from those apart
            apart = _apart(met, label)
            again = apart.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node", F.lit(turn))).alias("hub2"))
            star = apart.select("key", "node").join(again, "key").select("node", F.col("hub2").alias("hub")).filter("node <> hub").distinct()
        near = _near(star.select(F.col("node").alias("a"), F.col("hub").alias("b")), nodes, p)
        best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, p.hubs).alias("x")).select("a", F.explode("x").alias("x")).select("a", "x.b")
        found = confirm(order(best), docs, p)
        links = cut(found if links is None else links.unionAll(found))
        label = cut(components(links))
    apart = cut(_apart(met, label))
    left = met.join(apart.select("key").distinct(), "key", "left_semi").select("node").distinct()
    pairs = _prefix_pairs(_labelled(left, label, "node", "comp"), docs, p)
    links = cut(links.unionAll(confirm(order(pairs), docs, p)))
    label = components(links)

    members = nodes.select("hi", "lo", F.col("n").alias("n_shingles"), "node").join(label, "node", "left")
    members = members.select("hi", "lo", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = signed.drop("sig").join(members, ["hi", "lo", "n_shingles"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _buckets(nodes: DataFrame, p: NearParams) -> DataFrame:
    """(key, node, hub) of keys with two nodes or more; a bucket's hub is its node that meets most others over all keys.

    Copies with changes of their own lie closer to their common original than to each other, and the original meets
    most of them, so hubs link a group in few comparisons.
    """
    entries = keys(nodes, p)
    shared = cut(entries.join(entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key"))
    degree = shared.groupBy("node").agg(F.sum("c").alias("degree"))
    hubs = shared.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    return cut(shared.drop("c").join(hubs, "key"))


def _prefix_pairs(nodes: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """Pairs (a, b) of nodes (node, comp) in different components that can reach the similarity.

    Every pair of these nodes that reaches it is among them, so hot buckets lose nothing, and pairs that cannot reach
    it are not made. Shingles are ordered from rare to common; if sets of sizes n <= m reach a similarity t, they
    share a shingle among the first n - ceil(2t / (1 + t) n) + 1 of one and m - ceil(t m) + 1 of the other, at
    positions that leave room for the rest of the overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, comp, text in zip(batch.column("node"), batch.column("comp"), _texts(batch, "text"), strict=True):
                items = shingles(text, p.words)
                if len(items):
                    row = [np.full(len(items), x, np.int64) for x in (node.as_py(), comp.as_py(), int(mix(items + np.uint64(11)).sum(dtype=np.uint64).view(np.int64)))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*row, items.view(np.int64))], ["node", "comp", "sid", "item"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    items = texts.join(small(cut(nodes)), "node").select("node", "comp", "text").mapInArrow(run, "node long, comp long, sid long, item long")
    items = cut(items)
    ranked = items.join(items.groupBy("item").agg(F.count("*").alias("f")), "item")
    sets = ranked.groupBy("node", "comp", "sid").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("x"))
    t = p.percent / 100
    sets = sets.withColumn("n", F.size("x")).withColumn("short", F.col("n") - F.ceil(F.lit(2 * t / (1 + t)) * F.col("n") - 1e-9) + 1)
    heads = sets.select("node", "comp", "n", "short", F.posexplode(F.slice("x", F.lit(1), (F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).cast("int"))).alias("i", "e"))
    heads = cut(heads.select("node", "comp", "n", "i", "short", F.col("e.item").alias("item")).filter("e.f > 1"))
    a, b = heads.filter("i < short").alias("a"), heads.alias("b")
    room = f"{100 + p.percent} * least(a.n - a.i, b.n - b.i) >= {p.percent} * (a.n + b.n)"
    near = f"a.item = b.item and a.comp <> b.comp and a.n <= b.n and 100 * a.n >= {p.percent} * b.n and {room}"
    return a.join(b, F.expr(near)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _labelled(df: DataFrame, label: DataFrame, node: str, name: str) -> DataFrame:
    named = label.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(named, node, "left").withColumn(name, F.coalesce(name, node))


def _apart(met: DataFrame, label: DataFrame) -> DataFrame:
    """Members of buckets that are not yet in the component of the bucket's hub."""
    marked = _labelled(_labelled(met, label, "node", "comp"), label, "hub", "hubcomp")
    return marked.filter("comp <> hubcomp").drop("hubcomp")


def keep_first(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; columns unchanged.

    Rows without doc_id, and null, empty and blank texts stay; of repeated rows of one doc_id all stay or none; extra
    columns are kept; an empty table gives an empty table.
    """
    gone = cut(near_groups(docs, p).filter("not kept").select("doc_id"))
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), d AS MATERIALIZED (SELECT doc_id, len(sh) AS n, sh FROM s),
r AS MATERIALIZED (SELECT list_sort(sh) AS k, min(doc_id) AS rep, any_value(n) AS n FROM d WHERE n > 0 GROUP BY 1),
e AS MATERIALIZED (SELECT rep, n, unnest(k) AS g FROM r),
c AS (SELECT g, count(*) AS f FROM e GROUP BY g),
o AS (SELECT rep, n, e.g, row_number() OVER (PARTITION BY rep ORDER BY f, e.g) AS i FROM e JOIN c USING (g)),
p AS MATERIALIZED (SELECT rep, n, g FROM o WHERE i <= n - ceil(0.8 * n) + 1),
q AS MATERIALIZED (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v AS MATERIALIZED (SELECT q.a, q.b FROM q JOIN r x ON x.rep = q.a JOIN r y ON y.rep = q.b WHERE 100 * len(list_intersect(x.k, y.k)) >= 80 * (q.na + q.nb - len(list_intersect(x.k, y.k)))),
l AS (SELECT a, b FROM v UNION ALL SELECT b, a FROM v),
t AS MATERIALIZED (
  WITH RECURSIVE z(node, c) AS (SELECT rep, rep FROM r WHERE rep IN (SELECT a FROM l) UNION SELECT l.b, z.c FROM z JOIN l ON l.a = z.node)
  SELECT node, min(c) AS c FROM z GROUP BY node
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(t.c, r.rep, d.doc_id) AS component_id, d.doc_id = coalesce(t.c, r.rep, d.doc_id) AS kept
FROM d LEFT JOIN r ON d.n > 0 AND r.k = list_sort(d.sh) LEFT JOIN t ON t.node = r.rep
"""
