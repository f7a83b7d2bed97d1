"""Shared helpers: scratch tables, ordered buckets, group streams, piece caches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

#: The word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder (never a machine-local one on a cluster).

    Scratch folders live until ``scratch_dropped`` ends or the driver's program exits.
    """
    if not _made:
        atexit.register(_drop, spark, 0)
    _made.append(f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}")
    return f"{_made[-1]}/{name}"


def _drop(spark: SparkSession, since: int) -> None:
    folders, _made[since:] = _made[since:], []
    with contextlib.suppress(Py4JError, AttributeError, OSError):  # the JVM may be gone at exit
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch_dropped(spark: SparkSession):
    """Delete the scratch folders made inside the block when it ends: for results that have been
    written elsewhere by then."""
    since = len(_made)
    yield
    _drop(spark, since)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    The written table cuts the lineage: a lost executor costs a reread, not a
    recomputation, and several consumers share one evaluation. Spark knows the
    file sizes, so it decides by itself whether a side is small enough to
    broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns, then the text as a string under a name that none of them has."""
    kept = docs.select(*keep).columns
    name = "text"
    while name in kept:
        name += "_"
    return docs.select(*keep, F.col("text").cast("string").alias(name))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_bounds(df: DataFrame, column: str, buckets: int) -> np.ndarray:
    """``buckets - 1`` ascending quantiles of a long column (a bounded array)."""
    if buckets < 2:
        return np.empty(0, np.int64)
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(column), shares, max(10_000, 20 * buckets)).alias("q")).first()
    return np.unique(np.array(row["q"] or [], dtype=np.int64))


def bucket_of(bounds: np.ndarray, column: Column) -> Column:
    """Ordered bucket of a long: the number of bounds not above it; null is the lowest bucket."""
    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    return bucket(column)


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from a stream sorted by those keys; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        heads = []
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k))
            if col.null_count:
                col = pa.compute.fill_null(col, pa.scalar(0, col.type))
            values = col.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
            heads.append(values)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(v[start] for v in heads)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class PieceCache(dict):
    """Pure function results (bytes) of strings, in two generations of at most ``limit`` bytes.

    The bound is on memory only; a dropped entry is computed again, and one that would take
    more than a hundredth of a generation is not kept.
    """

    #: An entry's objects and its slot, besides the characters and bytes themselves.
    ENTRY = 250

    def __init__(self, fn: Callable, limit: int = 96 << 20):
        super().__init__()
        self.fn, self.limit, self.old, self.held = fn, limit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        # up to four bytes a character
        size = self.ENTRY + 4 * len(key) + len(value)
        if 100 * size > self.limit:
            return value
        if self.held + size > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size
        return value


class Groups:
    """Disjoint sets over positions ``0..n-1``; merges take whole index arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        at = self.parent[at]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def merge(self, at: np.ndarray) -> None:
        roots = np.unique(self.find(at))
        self.parent[roots] = roots[0]
        self.parent[at] = roots[0]

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, root) of every position that is not its own root."""
        roots = self.find(np.arange(len(self.parent)))
        inner = np.flatnonzero(roots != np.arange(len(roots)))
        return inner, roots[inner]
