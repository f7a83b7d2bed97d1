"""Byte-level BPE: encoding with a segment tree over pair ranks, and decoding.

A text is split by the tokenizer's pattern. A piece that is a token is that token. Any
other piece starts as single bytes; a segment tree over the byte positions holds, at
every node, the leftmost smallest rank of the pairs below it. The root names the next
merge; the merge joins a live position with its right neighbour, and the two pairs that
change are updated on their paths to the root, so a piece of n bytes takes
O(n log n), however long it is.

Pieces repeat, so results are kept per worker in a bounded cache. Rows are independent:
no shuffle.

Defined cases: null and empty texts have no tokens; repeated rows get equal results;
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import PieceCache, with_text

NONE = 1 << 62  # rank of a pair that is no token


class ByteBPE:
    """Encoder and decoder for one rank file (base64 token, rank per line)."""

    loaded: dict[tuple[str, str], "ByteBPE"] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = PieceCache(self.encode_piece)

    @classmethod
    def get(cls, path: str, pattern: str) -> "ByteBPE":
        if (path, pattern) not in cls.loaded:
            cls.loaded[path, pattern] = cls(path, pattern)
        return cls.loaded[path, pattern]

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of a piece that is no token itself, by rank-ordered merges."""
        n = len(raw)
        rank = self.ranks.get
        width = 1
        while width < n:
            width *= 2
        # A leaf is rank * n + position, so the smallest value is the leftmost smallest rank.
        tree = [NONE * n] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = rank(raw[i : i + 2], NONE) * n + i
        for at in range(width - 1, 0, -1):
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left < right else right
        end = list(range(1, n + 1))  # end of the live token that starts here
        start_of = list(range(-1, n))  # start of the live token that ends here
        limit = NONE * n

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    return
                tree[at] = value

        while tree[1] < limit:
            i = tree[1] % n
            j = end[i]
            e = end[j]
            end[i] = e
            start_of[e] = i
            if e < n:
                put(i, rank(raw[i : end[e]], NONE) * n + i)
            else:
                put(i, limit)
            put(j, limit)
            if i:
                h = start_of[i]
                put(h, rank(raw[h:e], NONE) * n + h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern as little-endian 32-bit integers."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = self.merge(raw) if whole is None else [whole]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, path: str, pattern: str, *keep: Column) -> DataFrame:
    """``keep`` columns, ids (little-endian unsigned 32-bit) and decoded (bytes of the decoded ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.get(path, pattern)
        for b in batches:
            for low in range(0, b.num_rows, 256):  # a few texts at a time bound the memory
                part = b.slice(low, 256)
                ids = [bpe.encode(t.as_py()) for t in part.column(part.num_columns - 1)]
                cols = [*part.columns[:-1], pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[:-1], "ids", "decoded"])

    rows = with_text(docs, *keep)
    made = T.StructType().add("ids", "binary").add("decoded", "binary")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made.fields]))


def token_digests(encoded: DataFrame, *keep: Column) -> DataFrame:
    """n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return encoded.select(
        *keep,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
