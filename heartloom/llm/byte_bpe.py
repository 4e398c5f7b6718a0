"""Byte-level BPE with given ranks: two-tier lookup, and exact decoding.

Whole pre-tokens are first looked up in a minimal perfect hash of the vocabulary; a pre-token outside it is merged with
a heap over linked bytes. Distinct pre-tokens of a batch are resolved together, and a memo of bounded size spares
repeats for as long as a worker lives.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartloom.llm.wordhash import mix


class PerfectHash:
    """A minimal perfect hash of n distinct keys onto 0 .. n - 1, by hashing to buckets and displacing each bucket."""

    def __init__(self, keys: list[bytes]):
        self.n, self.r = len(keys), max(1, len(keys) // 4)
        h = self._hash(keys)
        bucket = (h % np.uint64(self.r)).astype(np.int64)
        self.move = np.zeros(self.r, np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(bucket, minlength=self.r))[:-1])
        free = np.ones(self.n, bool)
        self.slot_of_key = np.full(self.n, -1, np.int64)
        for b in sorted(range(self.r), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) > 1:
                at = 1
                while True:  # displacements are tried in blocks
                    tries = np.arange(at, at + 64)
                    slots = self._slot(h[group][None, :], tries[:, None])
                    ok = free[slots].all(1) & (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                    if ok.any():
                        k = int(np.argmax(ok))
                        self.move[b], self.slot_of_key[group] = tries[k], slots[k]
                        free[slots[k]] = False
                        break
                    at += 64
        rest = iter(np.flatnonzero(free))
        for b in range(self.r):  # a key alone in its bucket is sent straight to a free slot
            if len(groups[b]) == 1:
                slot = int(next(rest))
                self.move[b], self.slot_of_key[groups[b][0]] = -slot - 1, slot

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(k, 41) for k in keys), np.uint64, len(keys))

    def _slot(self, h: np.ndarray, move: np.ndarray) -> np.ndarray:
        return (mix(h + move.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for each key; a key outside the set also gets one, so the caller compares the slot's key."""
        h = self._hash(keys)
        move = self.move[(h % np.uint64(self.r)).astype(np.int64)]
        return np.where(move < 0, -move - 1, self._slot(h, move))


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 800_000):
        self.ranks, self.limit, self.memo = ranks, memo, {}
        self.split = regex.compile(pattern).findall
        keys = list(ranks)
        self.table = PerfectHash(keys)
        self.key_at, self.id_at = [b""] * len(keys), np.zeros(len(keys), np.int64)
        for key, slot in zip(keys, self.table.slot_of_key.tolist(), strict=True):
            self.key_at[slot], self.id_at[slot] = key, ranks[key]
        by_id = {i: k for k, i in ranks.items()}
        self.lengths = np.zeros(max(by_id) + 1, np.int64)
        for i, k in by_id.items():
            self.lengths[i] = len(k)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(self.lengths))), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        n, get = len(piece), self.ranks.get
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        heap = []
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                live[i] = r
                heap.append((r, i))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = pop(heap)
            if live[i] != r:
                continue  # one of the two has been merged since
            mid = after[i]
            stop = after[i] = after[mid]
            live[mid] = -1
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : after[stop]])) is not None:
                    push(heap, (r, i))
                    live[i] = r
                else:
                    live[i] = -1
            else:
                live[i] = -1
            if (b := before[i]) >= 0:
                if (r := get(piece[b:stop])) is not None:
                    push(heap, (r, b))
                    live[b] = r
                else:
                    live[b] = -1
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def resolve(self, tokens: list[str]) -> None:
        """Put pre-tokens into the memo: their ids as decimal text and as 32-bit numbers."""
        keys = [t.encode() for t in tokens]
        for token, key, slot in zip(tokens, keys, self.table.slots(keys).tolist(), strict=True):
            ids = [int(self.id_at[slot])] if self.key_at[slot] == key else self.merge(key)
            self.memo[token] = (" ".join(map(str, ids)), array("I", ids).tobytes())

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """The ids as decimal text joined by spaces, and as an array."""
        tokens = self.split(text)
        new = [t for t in set(tokens) if t not in self.memo]
        if new:
            if len(self.memo) + len(new) > self.limit:
                self.memo.clear()
                new = list(set(tokens))
            self.resolve(new)
        found = [self.memo[t] for t in tokens]
        return " ".join([x[0] for x in found]), np.frombuffer(b"".join([x[1] for x in found]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_held: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """The tokenizer of a rank file, built once in a process; the public 50k file and pattern by default."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _held:
        _held[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _held[path, pattern]


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs; null and empty texts have no ids.

    Very long texts and pre-tokens are encoded whole; merges of equal rank go from the left. Repeated rows give equal
    rows; a null doc_id stays null; extra columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "")[1].astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes of every row's ids.

    Null and empty ids give no bytes; bytes need not be whole characters. Repeated rows give equal rows; a null doc_id
    stays null; extra columns are ignored; an empty table gives an empty table. An id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; encoded, and decoded from the ids.

    Null and empty texts have no tokens; very long ones are encoded whole. Repeated rows give equal rows; a null doc_id stays null; extra columns are
    ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                written, ids = bpe.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(written.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
