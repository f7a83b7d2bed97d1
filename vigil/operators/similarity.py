"""G19 by inverted lists: exact top-k cosine neighbours without scoring all pairs.

On unit vectors a cosine s is a distance d with d^2 = 2 - 2s. Corpus vectors are dealt to
the lists of their nearest centroids (fitted on a bounded sample; any centroids give exact
results, good ones prune more). Two rounds:

1. Every query scores the lists nearest to it that together hold ``k`` vectors. Its k-th
   best score there bounds the distance ``reach`` that a better vector can have.
2. By the triangle inequality a vector v of list c is at least |d(q,c) - d(v,c)| away. A
   query visits a further list only if the interval of d(v,c) in it comes within its reach,
   and in a list only the vectors whose own d(v,c) does are scored.

What a query meets are lists, never all blocks of the corpus. A list of more than
``block_rows`` vectors is split by hash into blocks, its visitors into parts of as many
rows, so no task holds an unbounded list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ownership import materialize

#: Rows of the sample that centroids are fitted on.
SAMPLE = 20_000
#: Slack of distances for the rounding of scores to 12 decimals.
EPS = 1e-5
#: Distances that a task holds at a time, and rows it hands on at a time: its memory does not grow with the lists.
DISTANCES, OUT_ROWS = 2**20, 4096


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0))


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(v: Column) -> Column:
    """A vector that has a cosine: no null or non-finite part, not all zeros."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.exists(v, lambda x: x != 0) & ~odd, F.lit(False))


def fit_centroids(corpus: DataFrame, lists: int, rounds: int = 4) -> np.ndarray:
    """Centroids of (vec_id, v) from at most ``SAMPLE`` rows, the first by hash."""
    sample = corpus.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()
    x = _unit(np.array([r["v"] for r in sample], np.float64))
    centres = x[: max(1, min(lists, len(x)))].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(x[i : i + 2048], centres).argmin(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def index_corpus(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, v, list, far): each vector's nearest centroid and its distance to it."""

    step = max(1, DISTANCES // len(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), step):
                part = b.iloc[low : low + step]
                d = _distances(_unit(_rows(part["v"])), centres)
                own = d.argmin(1)
                yield part.assign(list=own.astype(np.int32), far=d[np.arange(len(d)), own])

    return corpus.select("vec_id", "v").mapInPandas(run, "vec_id long, v array<double>, list int, far double")


def _visited(part: pd.DataFrame, centres: np.ndarray, spans: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The visits of some queries, ``OUT_ROWS`` at a time; see ``_visits``. ``spans`` and its ``centres`` stand by list."""
    at = spans["list"].to_numpy()
    n, low, high = (spans[c].to_numpy() for c in ("n", "low", "high"))
    d = _distances(_unit(_rows(part["qv"])), centres)
    by = np.argsort(d, axis=1, kind="stable")
    before = np.cumsum(n[by], axis=1) - n[by]
    first = np.zeros(d.shape, bool)
    np.put_along_axis(first, by, before < k, axis=1)
    reach = part["reach"].to_numpy(np.float64)[:, None]
    within = (d - high <= reach + EPS) & (low - d <= reach + EPS)
    for i, lists in enumerate(part["seen"]):
        if lists is not None:
            within[i, np.searchsorted(at, lists)] = False
    row, col = np.nonzero(np.where(np.isnan(reach), first, within))
    part = part.drop(columns="seen")
    for start in range(0, len(row), OUT_ROWS):
        r, c = row[start : start + OUT_ROWS], col[start : start + OUT_ROWS]
        yield part.iloc[r].assign(list=at[c].astype(np.int32), near=d[r, c])


def _visits(queries: DataFrame, centres: np.ndarray, spans: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, qv, reach, list, near): the lists of a query and its distance to their centroids.

    Without a reach (null) the nearest lists that hold ``k`` vectors; with one, the lists but those
    ``seen`` that a vector within reach can be in. ``spans`` has a row per list: n, low and high of d(v,c)."""
    spans = spans.sort_values("list")
    centres = centres[spans["list"].to_numpy()]
    step = max(1, DISTANCES // len(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), step):
                yield from _visited(b.iloc[start : start + step], centres, spans, k)

    return queries.mapInPandas(run, "query_id long, qv array<double>, reach double, list int, near double")


def _score(visits: DataFrame, indexed: DataFrame, spans: pd.DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, similarity): the best ``k`` of each visited block; and, with a null vec_id, the
    number of pairs scored in it as ``pairs`` (its query_id is null, too)."""

    # at most a row per list on the driver; most often none, and then Spark drops the joins
    spark, one = visits.sparkSession, F.lit(1)
    met = visits.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).collect()
    large = spans[spans["n"] > block_rows]
    pieces = lambda lists, n: [(int(x), int(-(-y // block_rows))) for x, y in zip(lists, n)]
    blocks = spark.createDataFrame(pieces(large["list"], large["n"]), "list int, blocks int")
    parts = spark.createDataFrame(pieces([r["list"] for r in met], [r["n"] for r in met]), "list int, parts int")

    def dealt(rows: DataFrame, key: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        rows = rows.join(blocks, "list", "left").join(parts, "list", "left")
        mine = F.pmod(F.xxhash64(key), F.coalesce(own, one)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))
        return rows.withColumn(names[0], mine).withColumn(names[1], every).drop("blocks", "parts")

    q = dealt(visits, "query_id", "parts", "blocks", ("part", "block"))
    c = dealt(indexed, "vec_id", "blocks", "parts", ("block", "part"))

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "similarity": [], "pairs": []}
        if qs.empty or cs.empty:
            return pd.DataFrame(out)
        cs = cs.sort_values(["far", "vec_id"], kind="stable")
        Q, V, far, vec = _rows(qs["qv"]), _rows(cs["v"]), cs["far"].to_numpy(), cs["vec_id"].to_numpy()
        q_norm, v_norm = np.sqrt((Q * Q).sum(axis=1)), np.sqrt((V * V).sum(axis=1))
        reach = qs["reach"].fillna(np.inf).to_numpy(np.float64) + EPS
        near, ids = qs["near"].to_numpy(), qs["query_id"].to_numpy()
        low, high = np.searchsorted(far, near - reach), np.searchsorted(far, near + reach, "right")
        frames, scored = [], 0
        for i in np.flatnonzero(high > low):
            a, b = low[i], high[i]
            s = np.round(V[a:b] @ Q[i] / (v_norm[a:b] * q_norm[i]), 12)
            scored += b - a
            best = np.lexsort((vec[a:b], -s))[:k] if b - a <= 4 * k else None
            if best is None:
                least = -np.partition(-s, k - 1)[k - 1]
                some = np.flatnonzero(s >= least)
                best = some[np.lexsort((vec[a:b][some], -s[some]))[:k]]
            frames.append((np.full(len(best), ids[i]), vec[a:b][best], s[best]))
        if frames:
            out = dict(zip(out, (np.concatenate(x) for x in zip(*frames))))
        rows = pd.DataFrame({**out, "pairs": None})
        total = pd.DataFrame({"query_id": [None], "vec_id": [None], "similarity": [None], "pairs": [scored]})
        return pd.concat([rows.astype(object), total.astype(object)], ignore_index=True)

    keys = ["list", "block", "part"]
    return (
        q.groupBy(*keys).cogroup(c.groupBy(*keys))
        .applyInPandas(score, "query_id long, vec_id long, similarity double, pairs long")
    )


def neighbours(queries: DataFrame, corpus: DataFrame, k: int, lists: int | None = None, block_rows: int = 4096) -> DataFrame:
    """Candidates (query_id, vec_id, similarity, pairs) that hold the ``k`` best corpus vectors of each
    query, for usable vectors of one length on both sides; ``pairs`` rows count what was scored.

    The corpus has about ``sqrt(n)`` lists, as far as the sample goes."""
    n = corpus.count()
    if not n:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, pairs long")
    centres = fit_centroids(corpus, lists or int(np.sqrt(n)))
    indexed = materialize(index_corpus(corpus, centres))
    spans = (
        indexed.groupBy("list").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
        .toPandas()  # a row per list
    )
    none = [F.lit(None).cast("double").alias("reach"), F.lit(None).cast("array<int>").alias("seen")]
    visits = materialize(_visits(queries.select("query_id", "qv", *none), centres, spans, k))
    first = materialize(_score(visits, indexed, spans, k, block_rows))
    best = first.where("pairs is null").groupBy("query_id").agg(
        F.sort_array(F.collect_list("similarity"), False).alias("s")  # k of each block of at most k lists
    )
    kth = F.get("s", F.lit(k - 1))
    reach = best.select("query_id", F.sqrt(F.greatest(2 - 2 * kth, F.lit(0.0))).alias("reach"))
    seen = visits.groupBy("query_id").agg(F.collect_list("list").alias("seen"))  # at most k lists
    # a query without a k-th neighbour has visited every list
    known = queries.select("query_id", "qv").join(reach.where("reach is not null"), "query_id").join(seen, "query_id")
    further = materialize(_visits(known, centres, spans, k))
    return first.unionByName(_score(further, indexed, spans, k, block_rows))
