"""Near-duplicate embeddings by product quantisation, with no link lost.

Vectors of one label and length with cosine of at least ``threshold`` are linked; on
unit vectors that is a distance of at most r = sqrt(2 - 2 * threshold).

Index: coarse centroids split the unit vectors into inverted lists; a vector's residual
is coded per subspace by its nearest codeword. Both are fitted on a bounded sample
(``SAMPLE`` distinct vectors, the first by hash); every vector is indexed. The error of
its code is stored with each vector.

Search: every distinct vector is a query.
* Probes: a vector in list c is nearer to c than to the query's own centroid c0, so if
  it is within r of the query, the query is within r of c's side of the plane between
  them: d(q,c)^2 - d(q,c0)^2 <= 2 r |c - c0|. All lists that meet this are probed.
* Table lookups: per query and list, a table of squared distances between the query's
  residual and all codewords gives distances to coded vectors; a vector can be within r
  only if that distance is at most r plus its stored error.
* Rerank: what remains is compared by cosine in double precision.
Both bounds are exact, so recall is 1, not an estimate.

Equal vectors are one node with a multiplicity. A list's rows are split by hash into
blocks, its visiting queries into parts, so no task holds an unbounded list; groups
emit link counts per query and a spanning forest of their links, never all pairs.

Defined cases: null, empty and zero vectors, vectors with null or non-finite parts,
rows with a null label or null vec_id link with nothing (component_id is their own
vec_id, kept is true); rows with equal vec_id are rows of their own; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import Groups, key_groups, shuffle_width, stage_table
from vigil.llm.components import connected_components

SAMPLE, MAX_LISTS = 20_000, 1024
SUBSPACES, CODEWORDS = 8, 64
HOME, VISITORS = 1024, 8192
#: Slack for rounding in the two bounds; the rerank decides.
EPS = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; empty ones keep their place."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])


@dataclass
class Index:
    """Coarse centroids and subspace codewords for vectors of one length."""

    centres: np.ndarray
    cuts: list[int]
    words: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> "Index":
        centres = _kmeans(x, lists)
        rest = x - centres[_nearest(x, centres)]
        cuts = np.unique(np.linspace(0, x.shape[1], SUBSPACES + 1).astype(int)).tolist()
        words = [_kmeans(rest[:, a:b], CODEWORDS) for a, b in zip(cuts, cuts[1:])]
        return cls(centres, cuts, words)

    @classmethod
    def plain(cls, length: int) -> "Index":
        """For a length that the sample does not hold: one list, one zero codeword."""
        return cls(np.zeros((1, length)), [0, length], [np.zeros((1, length))])

    def encode(self, x: np.ndarray):
        """List, codes and code error of every row."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, a:b], w) for a, b, w in zip(self.cuts, self.cuts[1:], self.words)], 1)
        decoded = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], 1)
        return own, codes.astype(np.uint8), np.linalg.norm(rest - decoded, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, r: float) -> np.ndarray:
        """Whether each row must look into each list."""
        d = _distances(x, self.centres)
        apart = np.sqrt(_distances(self.centres, self.centres))
        return d - d[np.arange(len(x)), own][:, None] <= 2 * r * apart[own] + EPS

    def table_distances(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of one list, by table lookup."""
        rest = x - self.centres[own]
        total = np.zeros((len(x), len(codes)))
        for m, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.words)):
            total += _distances(rest[:, a:b], w)[:, codes[:, m]]
        return np.sqrt(total)


def _matrix(column, length: int | None = None) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def fit_indexes(nodes: DataFrame, lists: int | None) -> dict[int, Index]:
    """An index per vector length, from at most ``SAMPLE`` distinct vectors."""
    n = nodes.count()
    rows = nodes.orderBy(F.xxhash64("vector", "label"), "nid").select("vector").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for (vector,) in rows:
        by_length.setdefault(len(vector), []).append(vector)
    k = lists or int(min(MAX_LISTS, max(1, np.sqrt(n))))
    return {
        length: Index.fit(_unit(np.array(vectors, np.float64)), max(1, k * len(vectors) // len(rows)))
        for length, vectors in by_length.items()
    }


def _split(lists: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Keys with more rows than ``size`` and the number of pieces they are dealt in."""
    n = lists.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    return n.where(F.col(name) > 1)


def _links(nodes: DataFrame, threshold: float, lists: int | None) -> DataFrame:
    """(u, v, n): rows with v null give node u's number of linked vectors in one list,
    the others are edges that connect all linked nodes."""
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + EPS
    indexes = fit_indexes(nodes, lists)
    index_of = lambda length: indexes.get(length) or Index.plain(length)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pa.compute.list_value_length(b.column(2)).to_numpy()
            for length in np.unique(lengths):
                part = b.filter(pa.array(lengths == length))
                for low in range(0, part.num_rows, 2048):
                    p = part.slice(low, 2048)
                    x = _unit(_matrix(p.column(2)))
                    index = index_of(int(length))
                    own, codes, error = index.encode(x)
                    probes = [np.flatnonzero(row).astype(np.int32) for row in index.probes(x, own, r)]
                    cols = [
                        pa.array(np.full(len(x), length, np.int32)), pa.array(own.astype(np.int32)),
                        pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                        pa.array(probes, pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays([*p.columns, *cols], assigned.names)

    assigned = nodes.select("nid", "label", "vector", "copies").schema
    for name, kind in (
        ("length", T.IntegerType()), ("list", T.IntegerType()), ("codes", T.BinaryType()),
        ("error", T.DoubleType()), ("probes", T.ArrayType(T.IntegerType())),
    ):
        assigned = assigned.add(name, kind)
    base = stage_table(nodes.select("nid", "label", "vector", "copies").mapInArrow(assign, assigned), "assigned")
    keys = ["label", "length", "list"]
    queries = base.select("nid", "label", "length", "vector", F.explode("probes").alias("list"))
    blocks = stage_table(_split(base, keys, HOME, "blocks"), "blocks")
    parts = stage_table(_split(queries, keys, VISITORS, "parts"), "parts")
    h = F.xxhash64("nid")
    one = F.lit(1)
    home = (
        base.join(blocks, keys, "left").join(parts, keys, "left")
        .withColumn("block", F.pmod(h, F.coalesce("blocks", one)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1)))
        .select(*keys, "block", "part", "nid", "vector", F.lit(True).alias("home"), "copies", "codes", "error")
    )
    visitors = (
        queries.join(blocks, keys, "left").join(parts, keys, "left")
        .withColumn("part", F.pmod(h, F.coalesce("parts", one)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", one) - 1)))
        .select(
            *keys, "block", "part", "nid", "vector", F.lit(False).alias("home"), F.lit(0).cast("long").alias("copies"),
            F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"),
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_groups(batches, ["label", "length", "list", "block", "part"]):
            is_home = t.column("home").to_numpy()
            if is_home.all() or not is_home.any():
                continue
            homes, guests = t.filter(pa.array(is_home)), t.filter(pa.array(~is_home))
            index = index_of(t.column("length")[0].as_py())
            own = t.column("list")[0].as_py()
            v, q = _matrix(homes.column("vector")), _matrix(guests.column("vector"))
            v_norm, q_norm = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
            unit = q / q_norm[:, None]
            codes = np.frombuffer(b"".join(homes.column("codes").to_pylist()), np.uint8).reshape(len(v), -1)
            reach = homes.column("error").to_numpy() + r
            copies = homes.column("copies").to_numpy()
            ids = np.concatenate([homes.column("nid").to_numpy(), guests.column("nid").to_numpy()])
            groups = Groups(len(ids))
            found = np.zeros(len(q), np.int64)
            step = max(1, 2**19 // len(v))
            for low in range(0, len(q), step):
                near = index.table_distances(unit[low : low + step], own, codes) <= reach + EPS
                near &= ids[len(v) + low : len(v) + low + len(near), None] != ids[None, : len(v)]
                for i in np.flatnonzero(near.any(1)):
                    at = np.flatnonzero(near[i])
                    linked = at[v[at] @ q[low + i] / (v_norm[at] * q_norm[low + i]) >= threshold]
                    if len(linked):
                        found[low + i] += copies[linked].sum()
                        groups.merge(np.append(linked, len(v) + low + i))
            has = np.flatnonzero(found)
            at, root = groups.spanning()
            u = np.concatenate([ids[len(v) + has], ids[at]])
            other = pa.array(np.concatenate([np.zeros(len(has), np.int64), ids[root]]),
                             mask=np.arange(len(u)) < len(has))
            n = np.concatenate([found[has], np.zeros(len(at), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(u), other, pa.array(n)], ["u", "v", "n"])

    width = shuffle_width(nodes.sparkSession)
    order = [*keys, "block", "part"]
    return (
        home.unionByName(visitors)
        .repartition(width, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(compare, "u long, v long, n long")
    )


def link_embeddings(vectors: DataFrame, threshold: float = 0.98, lists: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(some & ~odd, F.lit(False))
    rows = rows.withColumn("usable", usable)
    nodes = stage_table(
        rows.where("usable")
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("nid", F.monotonically_increasing_id()),  # kept by the written table
        "nodes",
    )
    links = stage_table(_links(nodes, threshold, lists), "links")
    counts = links.where("v is null").groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "nid")
    roots = connected_components(links.where("v is not null").select("u", "v")).withColumnRenamed("node", "nid")
    named = (
        nodes.join(counts, "nid", "left").join(roots, "nid", "left")
        .withColumn("root", F.coalesce("root", "nid"))
        .withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "vector", "n_links", "component_id")
    linked = rows.where("usable").join(named, ["label", "vector"])
    alone = rows.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")
    )
    return (
        linked.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
