"""Byte-level BPE encoding and decoding with a vocabulary of ranks.

Two tiers. A minimal perfect hash (hash and displace: one slot a vocabulary entry, no empty slot) resolves
a pre-token that is itself an entry. Any other pre-token is merged from its bytes: a doubly linked list of
parts, and a heap of (rank, position) for neighbouring parts whose concatenation is an entry; stale heap
entries are recognised by the lengths of the parts that they were made from. A pre-token of n bytes costs
O(n log n), so unbroken texts of any length stay cheap.

Defined cases: a null or empty text has no ids; decoding a null list gives an empty byte string; every row gives
one row, repeated ones too; an input column that has the name of an output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from livgrid.llm.storage import bound_batches, unused
from livgrid.llm.wordhash import chunks

#: Pre-tokens remembered by a worker (some 100 MB; half of it is the older generation), and the longest in characters that is remembered.
MEMO, MEMO_CHARS = 400_000, 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings: `displace` by bucket, then `keys` and `values` by slot."""

    def __init__(self, entries: dict[bytes, int]):
        n = self.n = max(1, len(entries))
        self.buckets = n // 4 + 1
        hashed = {k: xxhash.xxh3_64_intdigest(k) for k in entries}
        if len(set(hashed.values())) < len(hashed):
            raise ValueError("two entries share a 64-bit hash")
        groups: dict[int, list[bytes]] = {}
        for k, h in hashed.items():
            groups.setdefault(h % self.buckets, []).append(k)
        self.displace, self.keys, self.values = [0] * self.buckets, [None] * n, [0] * n
        for bucket, group in sorted(groups.items(), key=lambda x: -len(x[1])):
            d = 0
            while True:
                slots = {self._slot(hashed[k], d) for k in group}
                if len(slots) == len(group) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displace[bucket] = d
            for k in group:
                s = self._slot(hashed[k], d)
                self.keys[s], self.values[s] = k, entries[k]

    def _slot(self, h: int, d: int) -> int:
        return (((h >> 20) ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 24 & 0xFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.displace[h % self.buckets])
        return self.values[s] if self.keys[s] == key else None


class Encoder:
    """Encodes and decodes texts. Picklable; the memo stays with the process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int = MEMO):
        self.table, self.ranks, self.pattern, self.memo_size = PerfectHash(ranks), ranks, pattern, memo_size
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.token = {rank: token for token, rank in ranks.items()}
        self._start()

    def _start(self) -> None:
        self.split, self.memo = regex.compile(self.pattern).findall, _Memo(self)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("table", "ranks", "pattern", "memo_size", "token")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        data = piece.encode("utf-8")
        whole = self.table.get(data)
        return (whole,) if whole is not None else self.merge(data)

    def merge(self, data: bytes) -> tuple[int, ...]:
        n, rank = len(data), self.ranks.get
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, left, right = pop(heap)
            j = after[i]
            if j - i != left or j >= n or after[j] - j != right:
                continue
            k = after[j]
            after[i], after[j] = k, j  # j's part is empty from now on: no entry matches a length of 0
            if k < n:
                before[k] = i
                if (r := rank(data[i : after[k]])) is not None:
                    push(heap, (r, i, k - i, after[k] - k))
            if (h := before[i]) >= 0 and (r := rank(data[h:k])) is not None:
                push(heap, (r, h, i - h, k - i))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str | None) -> array:
        memo = self.memo
        if len(memo) > self.memo_size // 2:
            memo.age()
        return array("I", chain.from_iterable(map(memo.__getitem__, self.split(text)))) if text else array("I")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids)) if ids is not None else b""


class _Memo(dict):
    """Pre-tokens and their ids in two generations: what isn't used while a new one fills goes with the old one."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece) or self.encoder.piece(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = found
        return found


def encoder(path: str, pattern: str, memo_size: int = MEMO) -> Encoder:
    return Encoder(read_ranks(path), pattern, memo_size)


def _map(df: DataFrame, spark: SparkSession, coder: Encoder, column: str, outputs: dict[str, tuple[T.DataType, pa.DataType]], make) -> DataFrame:
    """df with the columns `outputs` (name: its Spark and Arrow types) that `make(coder, array)` gives for each batch of `column`."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(coder)  # the vocabulary: a fixed size
    df = df.drop(*(c for c in outputs if c != column))
    kept = [f for f in df.schema.fields if f.name not in outputs]
    schema = T.StructType([*kept, *(T.StructField(n, kind) for n, (kind, _) in outputs.items())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(held.value, batch.column(batch.schema.get_field_index(column)))
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(v, t) for v, (_, t) in zip(made, outputs.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *outputs])

    text = dict(df.dtypes)[column] == "string"
    return df.mapInArrow((lambda it: run(chunks(it, column))) if text else run, schema)


def _lists(rows: list[array]) -> pa.Array:
    flat = np.concatenate([np.frombuffer(r, np.uint32) for r in rows] or [np.zeros(0, np.uint32)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, coder: Encoder, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """df with each text's ids (array<int>) and their number."""

    def make(coder, column):
        rows = [coder.encode(t) for t in column.to_pylist()]
        return _lists(rows), [len(r) for r in rows]

    return _map(df, df.sparkSession, coder, text, {ids: (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), count: (T.LongType(), pa.int64())}, make)


def decode(df: DataFrame, coder: Encoder, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that each list of ids stands for."""
    return _map(df, df.sparkSession, coder, ids, {out: (T.BinaryType(), pa.binary())}, lambda coder, column: ([coder.decode(x) for x in column.to_pylist()],))


def encode_checked(df: DataFrame, coder: Encoder, text: str = "text", ids: str = "ids", count: str = "n_tokens", intact: str = "intact") -> DataFrame:
    """df without the texts, with each one's ids, their number, and whether they decode to the text's bytes: one pass and one worker a task."""

    def make(coder, column):
        rows, same = [], []
        for t in column.to_pylist():
            rows.append(coder.encode(t))
            same.append(coder.decode(rows[-1]) == (t or "").encode("utf-8"))
        return _lists(rows), [len(r) for r in rows], same

    kinds = {ids: (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), count: (T.LongType(), pa.int64()), intact: (T.BooleanType(), pa.bool_())}
    held = unused(df, "__text")
    return _map(df.withColumnRenamed(text, held), df.sparkSession, coder, held, kinds, make).drop(held)


def round_trip(df: DataFrame, coder: Encoder, text: str = "text") -> DataFrame:
    """Each text encoded and decoded again in one pass: the number of ids, and SHA-256 of the ids and of the decoded bytes."""

    def make(coder, column):
        out = []
        for t in column.to_pylist():
            ids = coder.encode(t)
            out.append((len(ids), hashlib.sha256(np.frombuffer(ids, np.uint32).astype("<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
        return zip(*out, strict=True) if out else ([], [], [])

    kinds = {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())}
    held = unused(df, "__text")
    return _map(df.withColumnRenamed(text, held), df.sparkSession, coder, held, kinds, lambda c, x: tuple(map(list, make(c, x)))).drop(held)
