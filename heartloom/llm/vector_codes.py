"""Vector codes: product quantisation in exact integers, nearest entries found by segment-mean lower bounds.

Let x be a part of a vector and c an entry. On a block of m components with sums X and C, and with x and c falling into
means and residuals of norms r(x) and r(c), |x - c|^2 >= (X - C)^2 / m + (r(x) - r(c))^2. Summed over blocks this is a
lower bound, and halving the blocks never lowers it. An entry is left out where its bound lies above the exact distance
of an entry already computed; bounds are floating-point and lowered by more than their error, so nothing nearest, ties
included, is ever left out. Survivors of the finest blocks get exact integer distances.

Codebooks are 64 entries by 16 parts; sums for their means are formed in each task and added up on Spark, so what the
driver sees of the vectors is one codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heartloom.llm.common import SALT, cut, dealt, hot_keys, spread

#: Parts of a vector, entries of a codebook, rounds of its fit. Fixed values.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Largest absolute component; above it sums of squares might leave 64-bit integers.
LARGEST = float(1 << 17)
#: A floating-point bound is lowered by this share of the largest squared norms that went into it.
SLACK = 1e-9
#: Vectors that are compared at a time in a task.
BATCH = 1024

Codebooks = list[np.ndarray]  # of each part: entries x components, int64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), label of the rows that can be coded.

    Left out are null and empty vectors, and those with null or non-finite components.
    """
    e = F.col("embedding").cast("array<double>")
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.col("label"))
    return held.filter((F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(x * 0.0 == 0.0, F.lit(False))))


def whole(x: np.ndarray) -> np.ndarray:
    """Components as integers floor(256 x)."""
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST:.0f}; scale the vectors")
    return np.floor(x * 256.0).astype(np.int64)


class Blocks:
    """Rows of integers by column, and their sums and residual norms over blocks of halving size, coarse to fine."""

    def __init__(self, rows: np.ndarray) -> None:
        width = rows.shape[1]
        self.n, self.columns = len(rows), list(np.ascontiguousarray(rows.T))
        self.norm = float((rows.astype(np.float64) ** 2).sum(1).max()) if len(rows) else 0.0
        self.levels: list[list[np.ndarray]] = []  # of each level: a sum and a norm for each block, scaled to add up as squares
        edges = [0, width]
        while max(np.diff(edges)) > 1:
            level = []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                total = sum(self.columns[x:y])
                squares = sum(c * c for c in self.columns[x:y])
                level.append(total / np.sqrt(y - x))
                if y - x > 1:
                    level.append(np.sqrt(np.maximum(squares - total.astype(np.float64) ** 2 / (y - x), 0.0)))
            self.levels.append(level)
            edges = sorted({*edges, *((x + y) // 2 for x, y in zip(edges[:-1], edges[1:], strict=True))})


def _squares(a: list[np.ndarray], b: list[np.ndarray], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of pairs (r, c) over columns."""
    out = None
    for x, y in zip(a, b, strict=True):
        d = x[r]
        d -= y[c]
        d *= d
        out = d if out is None else np.add(out, d, out=out)
    return out


def nearest(rows: np.ndarray, book: Blocks) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry, ties to the lower index, and the number of exact distances."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    mine = Blocks(rows)
    slack = SLACK * (mine.norm + book.norm + 1.0)
    bound = np.zeros((mine.n, book.n))
    for x, y in zip(mine.levels[0], book.levels[0], strict=True) if mine.levels else ():
        d = x[:, None] - y[None, :]
        d *= d
        bound += d
    every = np.arange(mine.n)
    top = _squares(mine.columns, book.columns, every, bound.argmin(1))  # exact: an upper bound of the least distance
    r, c = np.divmod(np.flatnonzero(bound <= (top + slack)[:, None]), book.n)
    for x, y in zip(mine.levels[1:], book.levels[1:], strict=True):
        keep = _squares(x, y, r, c) <= top[r] + slack
        r, c = r[keep], c[keep]
    exact = _squares(mine.columns, book.columns, r, c)  # by row, entries rising, at least the first one in each
    lead = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    least = np.minimum.reduceat(exact, lead)
    tied = np.flatnonzero(exact == least[r])
    return c[tied[np.append(True, r[tied][1:] != r[tied][:-1])]], least, len(exact)


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """A batch's vectors as integers (rows x parts x components), some at a time."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS, width)
    for at in range(0, len(flat), BATCH):
        yield whole(flat[at : at + BATCH])


def first_books(kept: DataFrame) -> Codebooks | None:
    """The parts of the vectors of the 64 smallest vec_ids; equal ids in the order of their vectors. None without vectors."""
    rows = kept.filter("vec_id is not null").orderBy("vec_id", "embedding").limit(ENTRIES).select("embedding").collect()
    if not rows:
        rows = kept.orderBy("embedding").limit(ENTRIES).select("embedding").collect()
    if not rows:
        return None
    x = whole(np.array([r.embedding for r in rows]))
    return [x.reshape(len(x), PARTS, -1)[:, p] for p in range(PARTS)]


def sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, total): the number and the sum of the vectors' parts next to each entry."""
    width, held = books[0].shape[1], [Blocks(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((*count.shape, width), np.int64)
        for batch in batches:
            for rows in _parts(batch, width):
                for p in range(PARTS):
                    best, _, _ = nearest(rows[:, p], held[p])
                    np.add.at(count[p], best, 1)
                    np.add.at(total[p], best, rows[:, p])
        part, entry = np.nonzero(count)
        lists = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists], ["part", "entry", "n", "total"])

    each = kept.select("embedding").mapInArrow(run, "part long, entry long, n long, total array<long>")
    parts = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *parts).select("part", "entry", "n", F.array(*(f"s{i}" for i in range(width))).alias("total"))


def fit(kept: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of usable vectors after some rounds; an entry that no part is next to stays as it was."""
    books = first_books(kept)
    for _ in range(rounds if books else 0):
        new = [b.copy() for b in books]
        for r in sums(kept, books).collect():  # one row for each entry of each part
            new[r.part][r.entry] = [int(t) // r.n for t in r.total]
        books = new
    return books


def assign(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of usable vectors."""
    width, held = books[0].shape[1], [Blocks(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for rows in _parts(batch, width):
                found = [nearest(rows[:, p], held[p]) for p in range(PARTS)]
                codes += [row.tobytes().hex() for row in np.stack([f[0] for f in found], 1).astype(np.uint8)]
                errors.append(sum(f[1] for f in found))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else np.empty(0, np.int64))], ["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(books: Codebooks) -> str:
    """The hash of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with the column approx: the vector that a code stands for."""
    table = F.array(*(F.array(*(F.array(*(F.lit(float(v) / 256.0) for v in e)) for e in b)) for b in books))
    index: Column = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.conv(F.substring("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int"))
    return coded.withColumn("approx", F.flatten(F.transform(index, lambda e, p: F.get(F.get(table, p), e))))


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of vectors (vec_id, embedding, label).

    All vectors must have the dimension of the vector with the smallest vec_id, a multiple of 16; rows of another length
    are left out like those with unusable components. Fewer than 64 vectors give as many entries. Repeated rows give equal rows, each of them, and count
    each time; rows without vec_id are coded but begin no entry (unless no row has an id). Extra columns are left out;
    an empty table, or one without usable rows, gives an empty table.
    """
    kept = usable(vectors)
    lead = kept.filter(F.size("embedding") % PARTS == 0).orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    spark = vectors.sparkSession
    if lead is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.filter(F.size("embedding") == lead[0])
    books = fit(kept)
    coded = cut(assign(kept, books)).withColumn("key", F.to_json(F.struct("label")))  # a key that is there for null labels too
    each = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    hot = hot_keys(each.select("key", "n"), "key", coded.count())
    out = dealt(coded, hot, "key", "vec_id", "code").join(spread(each.drop("n"), hot, "key"), ["key", SALT])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    return f"""d{k} AS (SELECT v.vec_id, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c USING (part, pos) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(entry, d * 1000 + entry) AS entry FROM d{k} GROUP BY ALL)"""


def _moved(k: int) -> str:
    return f"""m{k} AS (SELECT part, a.entry, pos, floor(sum(x)::DECIMAL(38, 0) / count(*))::BIGINT AS x FROM v JOIN a{k} a USING (vec_id, part) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, entry, pos))"""


ORACLE = f"""
WITH k AS (SELECT vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, w, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM k),
v AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS pos, floor(x::DOUBLE * 256)::BIGINT AS x FROM u),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64),
c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM v JOIN s USING (vec_id)),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
r AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256
FROM r JOIN k USING (vec_id)
"""
