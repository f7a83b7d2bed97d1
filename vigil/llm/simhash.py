"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

A fingerprint is built from the XXH64 hashes of a text's word shingles. Equal
fingerprints are one node. Nodes are put in tiles by the population counts of their
four 16-bit quarters; the counts of two fingerprints within ``radius`` bits differ
by at most ``radius`` in sum, so only tile pairs that near are compared, each pair
with numpy exclusive-or and bit counts. All such pairs are compared: no bands, no
caps.

A tile holds its own rows once ("home") and gets the rows of near tiles as
visitors. A large tile is split by hash into home blocks, a large crowd of visitors
into several groups, so a task holds bounded blocks however many copies there are.
Each group merges its links into a spanning forest before anything is emitted.

Defined cases: a text without words (null and empty ones, too) has fingerprint
zero and links like any other; rows with a null doc_id are fingerprinted and their
component's smallest known id is given (null if there is none); repeated rows are
linked with each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import Groups, key_groups, shuffle_width, stage_table
from vigil.llm.components import connected_components

SEED = 42
QUARTERS, COUNTS = 4, 17  # a 16-bit quarter has 0..16 bits set: at most 17**4 tiles
HOME, VISITORS = 2048, 16_384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash; bits are set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total = len(words) - k + 1
    bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, 8192):  # blocks bound the memory of a long text
        high = min(total, low + 8192)
        hashes = np.array(
            [digest(joined[s : e - 1], SEED) for s, e in zip(starts[low:high], ends[low + k - 1 : high + k - 1])],
            dtype="<u8",
        )
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, ``digest`` (64-bit hash of the text) and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            cols = [b.column(0), b.column(1), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "fp"])

    text = F.col("text").cast("string")
    slim = docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text"))
    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"]]).add("digest", "long").add("fp", "long"))


def _tile(fp):
    """Tile number from the population counts of the quarters."""
    tile = F.lit(0)
    for q in range(QUARTERS):
        quarter = F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))
        tile = tile * COUNTS + F.bit_count(quarter)
    return tile.cast("int")


def near_tiles(radius: int) -> np.ndarray:
    """All differences of quarter counts whose absolute values sum to at most ``radius``."""
    steps = np.array(np.meshgrid(*[np.arange(-radius, radius + 1)] * QUARTERS)).reshape(QUARTERS, -1).T
    return steps[np.abs(steps).sum(1) <= radius]


def _mix(values: np.ndarray) -> np.ndarray:
    """A hash of fingerprints that is independent of their tile."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def deal(counts: np.ndarray, radius: int):
    """A function that deals nodes to comparison groups; ``counts`` is the size of every tile."""
    steps = near_tiles(radius)
    scale = COUNTS ** np.arange(QUARTERS - 1, -1, -1)
    digits = np.arange(len(counts))[:, None] // scale % COUNTS

    def around(tile: int) -> np.ndarray:
        d = digits[tile] + steps
        at = d[((d >= 0) & (d < COUNTS)).all(1)] @ scale
        return at[counts[at] > 0]

    blocks = -(-counts // HOME)  # home blocks of a tile
    crowd = np.zeros(len(counts), np.int64)  # visitors of each of its blocks, at most
    for t in np.flatnonzero(counts):
        near = around(t)
        crowd[t] = counts[near[near >= t]].sum()
    parts = np.maximum(1, -(-crowd // VISITORS))

    def rows(fps: np.ndarray, tiles: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(tiles, kind="stable")
        fps, tiles = fps[order], tiles[order]
        h = _mix(fps)
        cuts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            own, f, x = int(tiles[start]), fps[start:end], h[start:end]
            block = (x % np.uint64(blocks[own])).astype(np.int64)
            for part in range(parts[own]):
                yield own, block, part, True, f
            for t in around(own):
                if t > own:
                    continue
                part = ((x >> np.uint64(16)) % np.uint64(parts[t])).astype(np.int64)
                for b in range(blocks[t]):
                    if t < own:
                        yield int(t), b, part, False, f
                    else:  # later blocks of a tile visit its earlier ones
                        later = block > b
                        if later.any():
                            yield int(t), b, part[later], False, f[later]

    return rows


def _links(home: np.ndarray, visitors: np.ndarray, inside: bool, radius: int):
    """Spanning forest of the links among home rows and between home rows and visitors."""
    groups = Groups(len(home) + len(visitors))
    other = np.concatenate([home, visitors]) if inside else visitors
    base = 0 if inside else len(home)
    step = max(1, 2**20 // max(1, len(other)))
    for low in range(0, len(home), step):
        near = np.bitwise_count(home[low : low + step, None] ^ other[None, :]) <= radius
        if inside:
            near[np.arange(len(near)), np.arange(low, low + len(near))] = False
        for i in np.flatnonzero(near.any(1)):
            groups.merge(np.append(np.flatnonzero(near[i]) + base, low + i))
    return groups.spanning()


def link_fingerprints(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within ``radius`` bits.

    ``nodes`` has a column ``fp`` without repeats. The tile sizes that go to the driver
    are at most 17**4 numbers.
    """
    width = shuffle_width(nodes.sparkSession)
    tiled = nodes.select("fp", _tile(F.col("fp")).alias("tile"))
    counts = np.zeros(COUNTS**QUARTERS, np.int64)
    for tile, n in tiled.groupBy("tile").count().collect():
        counts[tile] = n

    names = ["tile", "block", "part", "home", "fp"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = deal(counts, radius)
        for b in batches:
            out, held = [], 0
            for row in rows(b.column(0).to_numpy(), b.column(1).to_numpy()):
                n = len(row[-1])
                out.append([np.broadcast_to(x, n) for x in row])
                held += n
                if held > 100_000:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    def _batch(rows: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_groups(batches, ["tile", "block", "part"]):
            home = t.column("home").to_numpy()
            fps = t.column("fp").to_numpy()
            h, v = fps[home], fps[~home]
            at, root = _links(h.view(np.uint64), v.view(np.uint64), t.column("part")[0].as_py() == 0, radius)
            if len(at):
                both = np.concatenate([h, v])
                yield pa.RecordBatch.from_arrays([pa.array(both[at]), pa.array(both[root])], ["u", "v"])

    return (
        tiled.mapInArrow(dealt, "tile int, block int, part int, home boolean, fp long")
        .repartition(width, "tile", "block", "part")
        .sortWithinPartitions("tile", "block", "part")
        .mapInArrow(compare, "u long, v long")
    )


def _components(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """doc_id, digest, fp, root (names the component) and component_id per document."""
    rows = stage_table(fingerprints(docs, shingle), "fingerprints")
    nodes = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) per document."""
    return _components(docs, shingle, radius).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id
    (null last), of several with that doc_id the one with the smallest text hash.

    Rows with the same doc_id and text, null ones too, are one document and stay once.
    """
    found = stage_table(_components(docs, shingle, radius).select("doc_id", "digest", "root"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    kept = found.groupBy("root").agg(first).select("root", "first.*").select(
        "root", F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")
    )
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    # What goes is little; written, Spark sees its size and need not shuffle the texts if it is small.
    gone = stage_table(found.join(kept, "root").where(~is_kept).select("doc_id", "digest").distinct(), "gone")
    many = stage_table(
        found.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "digest"), "many"
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(F.col("text").cast("string")).alias("text_digest"),
    )
    is_one = lambda ids: F.col("row.doc_id").eqNullSafe(ids["doc_id"]) & (F.col("text_digest") == ids["digest"])
    left = whole.join(gone, is_one(gone), "left_anti")
    once = (
        left.join(many, is_one(many), "left_semi")
        .select("row", F.col("row.doc_id").alias("id"), "text_digest")
        .dropDuplicates(["id", "text_digest"])
        .select("row")
    )
    return left.join(many, is_one(many), "left_anti").select("row").unionByName(once).select("row.*")
