"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: each pre-token's bytes are merged under a segment tree over the byte positions, which holds the leftmost
smallest rank of all neighbouring pairs; a merge updates the tree at the two live neighbours, in logarithmic time each,
so even a pre-token of millions of bytes takes n log n.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary's file lies on every node; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-token pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker remembers, at most, and their longest in characters: memory for speed, never results.
REMEMBERED, REMEMBERED_CHARS = 300_000, 48

_NONE = (1 << 63) - 1


class ByteBpe:
    """Encoder for a vocabulary of byte strings with ranks; a rank is also the id."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.texts = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        self.pattern = regex.compile(PATTERN)

    def _rank(self, a: int, b: int) -> int:
        """The rank of the pair of ids, or -1 if it does not merge."""
        rank = self.pairs.get((a, b))
        if rank is None:
            rank = self.pairs[(a, b)] = self.ranks.get(self.texts[a] + self.texts[b], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        ids = [self.single[b] for b in piece]
        size = 1 << (n - 1).bit_length()
        # leaf i: rank of (token at i, next live token) * 2^32 + i, so that the smallest entry is the leftmost smallest rank
        tree = array("q", [_NONE]) * (2 * size)
        for i in range(n - 1):
            if (rank := self._rank(ids[i], ids[i + 1])) >= 0:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, entry: int) -> None:
            i += size
            tree[i] = entry
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = bytearray(b"\1" * n)
        while (best := tree[1]) != _NONE:
            i, rank = best & 0xFFFFFFFF, best >> 32
            j = after[i]
            ids[i], live[j] = rank, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, _NONE)
            put(i, r << 32 | i if k < n and (r := self._rank(rank, ids[k])) >= 0 else _NONE)
            if (h := before[i]) >= 0:
                put(h, r << 32 | h if (r := self._rank(ids[h], rank)) >= 0 else _NONE)
        return [x for x, alive in zip(ids, live) if alive]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for null."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for m in self.pattern.finditer(text):
            piece = m[0]
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                        self.pairs.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.texts[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    return ByteBpe(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over at least as many partitions as there are cores: by a shuffle only if the scan has fewer (a few small files)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def encode_corpus(rows: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The key and ``ids`` (array<int>) of each row's text.

    Defined results: an empty list for a null and for an empty text; strings of special tokens in a text are ordinary
    text; rows keep their number, repeated or not, null key or not; texts are encoded whole, of any length; an empty
    table gives no rows; other columns are ignored.
    """
    df = spread(rows.select(key, F.col(text).alias("_text")), key)
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            ids = [bpe.encode(t.as_py()) for t in batch.column("_text")]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((x for one in ids for x in one), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return df.mapInArrow(run, schema)


def count_tokens(rows: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The key and ``tokens``, the number of ids, of each row's text (0 for null and empty)."""
    df = spread(rows.select(key, F.col(text).alias("_text")), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            n = [len(bpe.encode(t.as_py())) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64())], names=[key, "tokens"])

    return df.mapInArrow(run, df.select(key).schema.add("tokens", T.LongType()))

