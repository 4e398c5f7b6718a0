"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder. Remainder lengths, in classes of ``unit`` tokens, form a
histogram of at most capacity / unit counts; only that reaches the driver. A linear program over patterns (which
classes share a sequence) is solved by column generation: a knapsack dynamic program prices the columns. Whole parts of
the solution are used as they are, the rest (bounded by the number of classes) is filled greedily. Pieces, ranked
within their class on Spark, are then dealt to the patterns' slots.
"""

from __future__ import annotations

import logging
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heartloom.llm.common import cut
from heartloom.llm.wordhash import hashes_of, mix


@dataclass(frozen=True)
class PackParams:
    """capacity: tokens of a sequence; unit: width of a length class; end: the id put after each document; memo: pieces
    of words that a worker remembers."""

    capacity: int = 2048
    unit: int = 8
    end: int = 1
    tokenizer: str | None = None
    memo: int = 1_500_000

    @property
    def vocabulary(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


_held: dict[str, Encoder] = {}

#: Characters of text that are held as ids at once.
_BLOCK = 1 << 20
#: Old and stable characters that composition leaves alone and lower-casing maps one to one: words of them are cut into
#: pieces here (spaces, letters, single digits, other characters), other words by the tokenizer. The apostrophe begins
#: pieces of its own and is left to it too, as are special tokens.
_KNOWN = 0x500
_PLAIN = regex.compile(r"[\x09-\x0d\x20-\x26\x28-\x7e\xa1-\u012f\u0131-\u017f\u0388-\u03a2\u03a4-\u0482\u048a-\u04ff]")
_TABLE = [chr(i) for i in range(_KNOWN)]
_ODD = np.array([not _PLAIN.match(c) for c in _TABLE])
_LOWER = np.array([ord(c if odd else c.lower()) for c, odd in zip(_TABLE, _ODD, strict=True)], np.uint32)
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.array([_SPACE if c in " \t\n\v\f\r" else _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _OTHER for c in _TABLE], np.uint8)
_VALUES = np.random.default_rng(77).integers(1, 1 << 63, (2, _KNOWN), dtype=np.uint64)


class Memo:
    """Slots of 64-bit keys in a table of open addresses, all keys of a call at once."""

    def __init__(self, limit: int) -> None:
        self.limit, bits = limit, max(10, (2 * limit).bit_length())
        self.keys, self.slots, self.mask, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is new."""
        out = np.full(len(keys), -1, np.int32)
        at, left = keys & self.mask, None
        while True:
            there = self.keys[at]
            wanted = keys if left is None else keys[left]
            hit, more = there == wanted, (there != wanted) & (there != 0)
            out[hit.nonzero()[0] if left is None else left[hit]] = self.slots[at[hit]]
            left = more.nonzero()[0] if left is None else left[more]
            if not len(left):
                return out
            at = (at[more] + np.uint64(1)) & self.mask

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Put in distinct new keys."""
        self.n += len(keys)
        at = keys & self.mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = free & (self.keys[at] == keys)
            self.slots[at[won]] = slots[won]
            keys, slots, at = keys[~won], slots[~won], (at[~won] + np.uint64(1)) & self.mask


class Encoder:
    """Ids of many texts at once, with a bounded memo of word pieces.

    The tokenizer drops white space and never joins across it, lower-cases, and cuts a word into pieces each of which
    ends in one token that says so. A block's texts are cut into pieces by arrays of character classes; pieces are
    known by two 64-bit hashes; those not in the memo are encoded once, all in few calls; and the ids of all pieces are
    gathered from a pool.
    """

    def __init__(self, p: PackParams) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark places the tasks; a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(p.vocabulary), p.memo
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.memo, self.pool = Memo(self.limit), np.empty(0, np.uint32)
        self.starts, self.lengths, self.checks = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)

    def _add(self, ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        slots = np.arange(len(self.lengths), len(self.lengths) + len(lengths), dtype=np.int32)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths, self.checks = np.concatenate([self.lengths, lengths]), np.concatenate([self.checks, checks])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
        self.memo.add(keys, slots)

    def _learn(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Take new pieces and odd words into the memo."""
        for some in np.array_split((~odd).nonzero()[0], max(1, len(odd) >> 15)):
            if len(some):
                joined, _ = ragged(codes, starts[some], ends[some] - starts[some], " ")
                ids = np.array(self.tokenizer.encode_batch_fast([joined.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
                last = self.last[ids].nonzero()[0]
                if len(last) != len(some):
                    raise ValueError("the tokenizer cuts words in another way")
                self._add(ids, np.diff(last, prepend=-1), keys[some], checks[some])
        some = odd.nonzero()[0]
        if len(some):
            words = [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[some], ends[some], strict=True)]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            self._add(np.concatenate(found), np.array([len(x) for x in found]), keys[some], checks[some])

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text's ids end."""
        held = [x or "" for x in texts]
        codes = np.frombuffer(("\n".join(held) + "\n").encode("utf-32-le"), np.uint32)
        codes, starts, ends, odd = units(codes)
        values = np.minimum(codes, _KNOWN - 1)
        keys, checks = (self._hashed(codes, values, k, starts, ends) for k in (0, 1))
        slots = self.memo.find(keys)
        if (slots < 0).any():
            new = np.unique(keys[slots < 0])
            if self.memo.n + len(new) > self.limit:
                self._clear()
                slots[:] = -1
            new, first = np.unique(keys[slots < 0], return_index=True)
            first = (slots < 0).nonzero()[0][first]
            if len(new) > self.limit:
                self.memo = Memo(len(new))
            self._learn(codes, starts[first], ends[first], odd[first], new, checks[first])
            slots = self.memo.find(keys)
        if (self.checks[slots] != checks).any():
            raise ValueError("two pieces have one hash")
        upto = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held]))
        total = np.append(0, np.cumsum(self.lengths[slots]))[upto] + np.arange(1, len(held) + 1)
        ids = np.full(int(total[-1]) if held else 0, end, "<u4")
        inner = np.ones(len(ids), bool)
        inner[total - 1] = False
        ids[inner] = ragged(self.pool, self.starts[slots], self.lengths[slots])[0]
        return ids, total

    @staticmethod
    def _hashed(codes: np.ndarray, values: np.ndarray, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rare = (codes >= _KNOWN).nonzero()[0]
        values = _VALUES[k][values]
        values[rare] = mix(codes[rare].astype(np.uint64) + np.uint64(k << 40))
        return np.maximum(hashes_of(values, starts, ends), np.uint64(1))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The runs of values from starts, one after another, each followed by a character; and where each begins."""
    wide = lengths + len(after)
    first = np.cumsum(wide) - wide
    at = np.repeat(starts - first, wide) + np.arange(wide.sum())
    if not after:
        return values[at], first
    out = values[np.minimum(at, len(values) - 1)]
    out[first + lengths] = ord(after)
    return out, first


def units(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with plain words lower-cased; starts and ends of pieces and of odd words; whether a unit is odd."""
    known = np.minimum(codes, _KNOWN - 1)
    kind = _CLASS[known]
    odd = _ODD[known] | (codes >= _KNOWN)
    kind[codes >= _KNOWN] = _OTHER
    odd[:-1] |= (codes[:-1] == ord("<")) & (codes[1:] == ord("|"))
    inside = kind != _SPACE
    before = np.append(np.uint8(_SPACE), kind[:-1])
    starting = inside & (before == _SPACE)
    words = starting.nonzero()[0]
    if not len(words):
        return codes, words, words, np.empty(0, bool)
    strange = np.logical_or.reduceat(odd & inside, words)
    whole = np.zeros(len(codes), bool)
    if strange.any():
        whole = strange[np.maximum(np.cumsum(starting) - 1, 0)]
    starting |= inside & ~whole & ((kind != before) | (kind == _DIGIT))
    ending = inside.copy()
    ending[:-1] &= ~inside[1:] | starting[1:]
    starts, ends = starting.nonzero()[0], ending.nonzero()[0] + 1
    return np.where(whole, codes, _LOWER[known]), starts, ends, whole[starts]


def encoder(p: PackParams) -> Encoder:
    """The worker's encoder, made once."""
    if p.vocabulary not in _held:
        _held[p.vocabulary] = Encoder(p)
    return _held[p.vocabulary]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about _BLOCK bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // _BLOCK
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def pieces(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and the end id, cut at full sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(p)
        for batch in batches:
            for part in _blocks(batch):
                ids, ends = held.encode(part.column("text").to_pylist(), p.end)
                data, out, first = memoryview(ids).cast("B"), [], 0
                for doc, last in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    n = last - first
                    out += ((doc, at, min(p.capacity, n - at), zlib.crc32(data[4 * (first + at) : 4 * (first + min(at + p.capacity, n))]), n) for at in range(0, n, p.capacity))
                    first = last
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of whole items within room, and how often each item is taken."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = np.flatnonzero((sizes <= r) & (values > 0))
        best[r] = best[r - 1]
        if len(fits):
            gain = best[r - sizes[fits]] + values[fits]
            k = int(np.argmax(gain))
            if gain[k] > best[r] + 1e-12:
                best[r], took[r] = gain[k], fits[k]
    counts, r = np.zeros(len(sizes), int), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            counts[took[r]] += 1
            r -= sizes[took[r]]
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts by size) and how often each is used, so that every demand is met.

    The linear program starts from one pattern for each size and takes in priced columns until none improves it. After
    ``steps`` columns it stops where it is, which is logged and costs padding only; what is left by rounding down is
    filled largest first.
    """
    m = len(sizes)
    left = demand.astype(np.int64).copy()
    found: list[tuple[np.ndarray, int]] = []
    if m:
        basis = np.diag((room // sizes).astype(float))
        cost, x = np.ones(m), demand / (room // sizes)
        inverse = np.diag(1.0 / (room // sizes))
        for step in range(steps):
            if step % 256 == 255:
                inverse = np.linalg.inv(basis)
                x = np.maximum(inverse @ demand, 0)
            prices = (cost[:, None] * inverse).sum(0)  # not by BLAS, whose threads would vie with Spark's
            low = int(np.argmin(prices))
            if prices[low] < -1e-9:
                column, c = -np.eye(m)[low], 0.0
            else:
                value, counts = knapsack(prices, sizes, room)
                if value <= 1 + 1e-7:
                    break
                column, c = counts.astype(float), 1.0
            move = (inverse * column).sum(1)
            ratios = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
            out = int(np.argmin(ratios))
            if not np.isfinite(ratios[out]):
                break
            x = np.maximum(x - ratios[out] * move, 0)
            x[out], cost[out], basis[:, out] = ratios[out], c, column
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        else:
            logging.getLogger(__name__).warning("the linear program was stopped after %d columns", steps)
        for k in range(m):
            n = int(x[k] + 1e-6)
            if cost[k] and n:
                found.append((basis[:, k].round().astype(int), n))
                left -= n * found[-1][0]
    left = np.maximum(left, 0)
    while left.any():
        counts, r = np.zeros(m, int), room
        for k in np.argsort(-sizes):
            n = min(left[k], r // sizes[k])
            counts[k] += n
            r -= n * sizes[k]
        often = max(1, int(min(left[k] // counts[k] for k in np.flatnonzero(counts))))
        found.append((counts, often))
        left -= often * counts
    return found


def slots(demand: dict[int, int], room: int) -> np.ndarray:
    """Rows (class, first rank, slots of a sequence, first sequence), sorted; ranks of a class run on over its rows."""
    sizes = np.array(sorted(demand), int)
    counts = np.array([demand[int(s)] for s in sizes], np.int64)
    rows, next_rank, sequence = [], dict.fromkeys(demand, 0), 0
    for pattern, often in patterns(sizes, counts, room):
        for k in np.flatnonzero(pattern):
            size, each = int(sizes[k]), int(pattern[k])
            rows.append((size, next_rank[size], each, sequence))
            next_rank[size] += each * often
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a very long one is cut into as many full sequences as it needs. Repeated
    rows are packed once each, in any order among themselves; pieces of equal length are dealt by doc_id and start; a
    null doc_id stays null; extra columns are ignored, whatever their names; an empty table gives an empty table. A
    sequence's pieces stand gapless from 0.
    """
    order = ["doc_id", "start", "length", "ids_crc32"]
    held = cut(pieces(docs, p).withColumn("size", F.ceil(F.col("length") / p.unit).cast("long")))
    total = held.count()
    salts = 16 + total // 20_000
    held = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = cut(held.groupBy("size", "salt").agg(F.count("*").alias("n")))
    demand = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    table = slots(demand, p.capacity // p.unit)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy(*order)) - 1
    ranked = held.withColumn("rank", rank.cast("long")).join(counts.select("size", "salt", before.alias("before")), ["size", "salt"])
    ranked = ranked.select(*order, "doc_tokens", "size", (F.col("rank") + F.col("before")).alias("rank"))
    wide = np.int64(total + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            size, rank = (batch.column(k).to_numpy() for k in ("size", "rank"))
            row = table[np.searchsorted(at, size * wide + rank, "right") - 1]
            sequence = row[:, 3] + (rank - row[:, 1]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], [*batch.schema.names, "sequence_id"])

    dealt = ranked.mapInArrow(deal, ranked.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")
    return dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
