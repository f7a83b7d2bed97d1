"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for two 31-bit primes, the sums of
code point * B**position over every prefix. The difference of two entries is the hash of
a span (shifted by a power of B when spans stand at different places), so any two spans
are compared in constant time, and the longest common extension of two places is found
by binary search.

A document's fingerprint is a string: its length, the hash of the whole text, and the
prefix hashes at the multiples of a block of 2**k code points, 16 to 32 of them (one per
code point in shorter texts). Blocks of a coarser fingerprint are blocks of a finer one,
so two fingerprints can be compared without their texts: the likeness is the share of
code points, of the longer text, in blocks that are equal at the same place; runs of
equal blocks are found by longest common extension. What follows the last mark is a
block of its own between texts of one length (the hash of the whole text ends it); in
texts of different lengths these remainders are different spans and never equal. Equal
texts have equal fingerprints.

Defined cases: a null text is empty; two empty texts have likeness 1, an empty and
another one 0; a null doc_id comes last in descending order; rows with equal doc_id are
ordered by a hash of their text; a single document is its own successor; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import bucket_of, ordered_bounds, shuffle_width

#: Two primes below 2**31 and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
MAX_BLOCKS = 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(which: int, n: int) -> np.ndarray:
    """B**0 .. B**(n-1) modulo the prime, grown by doubling."""
    p = np.uint64(PRIMES[which])
    while len(_powers[which]) < n:
        have = _powers[which]
        step = np.uint64(pow(BASES[which], len(have), int(p)))
        _powers[which] = np.concatenate([have, have * step % p])
    return _powers[which][:n]


class PrefixHashes:
    """Prefix arrays of one text; spans are (start, length)."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = points * powers(k, self.n) % np.uint64(p)
            # up to 2**32 terms below 2**31 fit into 64 bits
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))

    def span(self, start: int, length: int, shift: int = 0) -> tuple[int, int]:
        """Hash of a span, times B**shift."""
        return tuple(
            (int(s[start + length]) - int(s[start])) * pow(b, shift, p) % p
            for s, b, p in zip(self.sums, BASES, PRIMES)
        )

    def equal(self, a: int, other: "PrefixHashes", b: int, length: int) -> bool:
        return self.span(a, length, max(0, b - a)) == other.span(b, length, max(0, a - b))

    def extension(self, a: int, other: "PrefixHashes", b: int) -> int:
        """Length of the longest common extension of place ``a`` here and ``b`` there."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(a, other, b, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        block = 1
        while self.n > MAX_BLOCKS * block:
            block *= 2
        first, second = self.sums
        marks = first[block : self.n + 1 : block]
        return f"{self.n:x}.{int(first[-1]):08x}{int(second[-1]):08x}." + "".join(f"{int(m):08x}" for m in marks)


def likeness(a: str, b: str) -> float:
    """Share of the longer text's code points in equal blocks of two fingerprints."""
    if a == b:
        return 1.0
    (n, u, x), (m, v, y) = a.split("."), b.split(".")
    sizes = int(n, 16), int(m, 16)
    if not min(sizes):
        return 0.0
    steps = []
    for size in sizes:
        block = 1
        while size > MAX_BLOCKS * block:
            block *= 2
        steps.append(block)
    block = max(steps)
    marks = []
    for text, step in ((x, steps[0]), (y, steps[1])):
        every = block // step
        at = [0, *(int(text[i : i + 8], 16) for i in range(0, len(text), 8))]
        marks.append(at[::every])
    p, total = PRIMES[0], min(map(len, marks)) - 1
    first, second = marks[0][: total + 1], marks[1][: total + 1]
    ends = [k * block for k in range(total + 1)]
    if sizes[0] == sizes[1] > ends[-1]:
        ends.append(sizes[0])
        first, second = ([*at, int(whole[:8], 16)] for at, whole in ((first, u), (second, v)))
        total += 1
    same = at = 0
    while at < total:
        # blocks from ``at`` on are equal as long as the spans are: binary search
        low, high = 0, total - at
        while low < high:
            mid = (low + high + 1) // 2
            if (first[at + mid] - first[at] - second[at + mid] + second[at]) % p == 0:
                low = mid
            else:
                high = mid - 1
        same += ends[at + low] - ends[at]
        at += low + 1
    return same / max(sizes)


def _with_successor(rows: Iterator[dict]) -> Iterator[tuple[dict, dict]]:
    """(row, next row) of the rows of one bucket, whose last ones are ghosts of its neighbour."""
    last = None
    for row in rows:
        if last is not None:
            yield last, row
            last = None
        if row["ghost"]:
            return
        last = row


def next_documents(docs: DataFrame) -> DataFrame:
    """Rows (bucket, wrap, doc_id, tie, text, ghost) dealt by ranges of doc_id and sorted
    descending in each bucket, where the last rows are copies of the next bucket's first.

    Buckets are ranges between quantiles of doc_id; one row per bucket (the bucket's
    largest doc_id) is what joins them, so texts are shuffled once and no task sees more
    than its range and one row.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    bounds = ordered_bounds(docs, "doc_id", width)
    ids = docs.select("doc_id", bucket_of(bounds, F.col("doc_id")).alias("bucket"))
    tops = sorted(ids.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())  # one row per bucket
    goes = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    rows = docs.select(
        bucket_of(bounds, F.col("doc_id")).alias("bucket"),
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(False).alias("ghost"),
    )
    known = [top for top in goes if top is not None]
    targets = F.create_map(*[F.lit(x) for top in known for x in (top, goes[top])]) if known else None
    ghost_of_null = F.lit(goes.get(None)).cast("int")
    to = F.when(F.col("doc_id").isNull(), ghost_of_null)
    if targets is not None:
        to = to.otherwise(F.try_element_at(targets, F.col("doc_id")))
    ghosts = rows.where(
        F.col("doc_id").isin(known) | (F.col("doc_id").isNull() if None in goes else F.lit(False))
    )
    ghosts = ghosts.withColumn("bucket", to).withColumn("ghost", F.lit(True))
    return (
        rows.unionByName(ghosts)
        .repartitionById(width, F.col("bucket"))
        .sortWithinPartitions("ghost", F.desc_nulls_last("doc_id"), "tie")
    )


def fingerprint_with_edit(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, the SHA-256 of the edited text, both fingerprints and the
    likeness to the edited text and to the next document in descending doc_id order."""
    rows = next_documents(docs)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        memo = (None, None)
        for row, after in _with_successor(stream(batches)):
            text, follows = row["text"], after["text"]
            n = len(text)
            edited = text[: n - n // 2] + follows[: n // 2]
            own = memo[1] if memo[0] is text else PrefixHashes(text).fingerprint()
            other, changed = PrefixHashes(follows).fingerprint(), PrefixHashes(edited).fingerprint()
            memo = (follows, other)
            digest = hashlib.sha256(edited.encode()).hexdigest()
            out.append((row["doc_id"], n, digest, own, changed, likeness(own, changed), likeness(own, other)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)

    made = T.StructType([rows.schema["doc_id"]])
    for name, kind in (
        ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
        ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"),
    ):
        made = made.add(name, kind)
    names = made.names
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(made)
    return rows.mapInArrow(run, made)
