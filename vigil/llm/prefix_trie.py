"""Conversation prefix trie, rolled up by centroid decomposition.

**Trie.** Turns are numbered in order within their conversation; a prefix of d turns is
named by the exclusive-or of two 64-bit hashes of (position, role, text) over its turns,
so names come from running aggregates, and a prefix's parent from one more exclusive-or.
Equal prefixes of all conversations are one node, found by one grouping. A conversation
of any length is never one group: turns are numbered over ordered ranges, and the
running aggregates work on blocks of ``RUN`` turns with a carry from the blocks before.

**Rollup.** Sums over a node's subtree come from the forest of parent edges by centroid
decomposition. A node's weight is the number of conversations through it, so the weight
of a whole subtree is known from the grouping: the turns its members have from there on.
In a component of weight T, the nodes whose subtree weighs at least T / 2 are the path
from the component's top to its centroid, the lowest of them. A step takes the centroid
out of each component at once. The total of the centroid and everything below it is
added to all nodes on the path, whose weights fall by that of the centroid's subtree;
what lies below each child of the centroid, and what is left above, are components of
their own, none heavier than T / 2. So the steps grow with the logarithm of all turns,
however deep or broad the trie is, and each is a few groupings and equi-joins of the whole
state. A component of at most ``SMALL`` turns is finished in one task, by the same
decomposition.

Node below a centroid: the conversation that names the node (its smallest member) is also
a member of the centroid's child, so the cut is an equi-join on component and
conversation; the join tells the child, too.

Defined cases: null roles and texts are empty; a null turn comes first; turns with the
same number are ordered by role, then text (so repeated rows count as turns); rows without
a conv_id belong to no conversation and are left out; an empty table gives no nodes, not
even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import shuffle_width, stage_table

RUN = 1024
SMALL = 2048
IDS_PER_CHUNK = 20_000
NODE = ["p0", "p1"]
PARENT = ["q0", "q1"]
PART = ["c0", "c1"]


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t0, t1 (hashes of role and text), chars (code points of the text)."""
    width = shuffle_width(conversations.sparkSession)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    hashed = ranged.select(
        F.spark_partition_id().alias("part"),
        "conv_id",
        F.xxhash64(F.lit(1), "role", "text").alias("t0"),
        F.xxhash64(F.lit(2), "role", "text").alias("t1"),
        F.length("text").cast("long").alias("chars"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(1).to_numpy()
            heads = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            pos = np.arange(b.num_rows) - np.repeat(heads, np.diff(np.r_[heads, b.num_rows])) + 1
            if conv[0] == last:
                pos[: heads[1] if len(heads) > 1 else b.num_rows] += done
            last, done = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos)], [*b.schema.names, "k"])

    local = stage_table(
        hashed.mapInArrow(count, "part int, conv_id long, t0 long, t1 long, chars long, k long"), "turns"
    )
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only a conversation that goes on from the range before has turns ahead: at most one in each range
    carried = (
        local.groupBy("conv_id", "part")
        .agg(F.max("k").alias("n"))
        .select("conv_id", "part", F.sum("n").over(ahead).alias("ahead"))
        .where(F.col("ahead").isNotNull())
    )
    return local.join(carried, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("k") + F.coalesce("ahead", F.lit(0))).alias("pos"), "t0", "t1", "chars"
    )


def graft(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as the first of their hundred does, and their ids.

    The first h turns (or as many as there are) of conversation c - c % ``group`` stand before
    c's own turns after its first h; h is the CRC-32 of the decimal c modulo ``most``.
    """
    turns = stage_table(turns, "numbered")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = stage_table(turns.select("conv_id").distinct().withColumns({"h": h, "base": base}), "convs")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most))
    found = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("pos").alias("found"))
    taken = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").where(F.col("pos") <= F.col("h"))
    own = turns.withColumns({"h": h, "base": base}).where(F.col("pos") > F.col("h")).join(found, "base", "left")
    before = F.least("h", F.coalesce("found", F.lit(0)))
    own = own.withColumn("pos", F.col("pos") - F.col("h") + before)
    columns = ["conv_id", "pos", "t0", "t1", "chars"]
    return taken.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id")


def _prefixes(turns: DataFrame, run: int) -> DataFrame:
    """conv_id, depth, node, parent, chars, and the length of the conversation, of every turn."""
    name = lambda seed, t: F.xxhash64(F.lit(seed), "pos", t)
    rows = turns.select(
        "conv_id",
        F.col("pos").alias("depth"),
        name(3, "t0").alias("z0"),
        name(4, "t1").alias("z1"),
        "chars",
        F.floor((F.col("pos") - 1) / run).alias("block"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.bit_xor("z0").over(upto).alias("l0"), F.bit_xor("z1").over(upto).alias("l1"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy("conv_id", "block")
        .agg(F.bit_xor("z0").alias("x0"), F.bit_xor("z1").alias("x1"), F.max("depth").alias("end"))
        .select(
            "conv_id",
            "block",
            F.coalesce(F.bit_xor("x0").over(before), F.lit(0)).alias("x0"),
            F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("x1"),
            F.max("end").over(whole).alias("turns"),
        )
    )
    node = lambda i: F.col(f"l{i}").bitwiseXOR(F.col(f"x{i}"))
    return rows.join(carry, ["conv_id", "block"]).select(
        "conv_id",
        "depth",
        node(0).alias("p0"),
        node(1).alias("p1"),
        node(0).bitwiseXOR(F.col("z0")).alias("q0"),
        node(1).bitwiseXOR(F.col("z1")).alias("q1"),
        "chars",
        "turns",
    )


def build_trie(turns: DataFrame, convs: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the turns as places in the trie, the root at depth 0 among them.

    ``turns`` has conv_id, pos (1, 2, ...), t0, t1, chars; ``convs`` every conv_id.
    """
    placed = _prefixes(turns, run)
    lengths = placed.where(F.col("depth") == F.col("turns")).select("conv_id", "turns")
    none = F.lit(0).cast("long")
    roots = convs.join(lengths, "conv_id", "left").select(
        "conv_id",
        none.alias("depth"),
        none.alias("p0"),
        none.alias("p1"),
        F.lit(None).cast("long").alias("q0"),
        F.lit(None).cast("long").alias("q1"),
        none.alias("chars"),
        F.coalesce("turns", none).alias("turns"),
    )
    places = stage_table(placed.unionByName(roots), "places")
    nodes = places.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("q0").alias("q0"),
        F.min("q1").alias("q1"),
        F.min("chars").alias("chars"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
    )
    return stage_table(nodes, "nodes"), places


def roll_up(nodes: DataFrame, places: DataFrame, values: list[str], small: int = SMALL) -> DataFrame:
    """p0, p1 and the sums of ``values`` over the node's subtree, itself included."""
    start = {"c0": F.lit(0).cast("long"), "c1": F.lit(0).cast("long")}
    start |= {f"sum_{v}": F.lit(0).cast("long") for v in values}
    state = nodes.select(*NODE, *PARENT, "conv_id", "depth", "weight", *values).withColumns(start)
    sums = [f"sum_{v}" for v in values]
    columns = state.columns
    settled, named = [], None
    while True:
        state = stage_table(state, "parts")
        totals = state.groupBy(*PART).agg(F.max("weight").alias("total"))
        heavy = totals.where(F.col("total") > small)
        settled.append(state.join(heavy, PART, "left_anti"))
        if heavy.isEmpty():
            break
        if named is None:  # only conversations that name a node are asked for, so no exact copies
            names = nodes.select("conv_id").distinct()
            named = stage_table(
                places.where(F.col("depth") > 0).join(names, "conv_id", "left_semi").select("conv_id", *NODE, *PARENT),
                "named",
            )
        state = state.join(heavy, PART)
        on_path = 2 * F.col("weight") >= F.col("total")
        centroids = state.where(on_path).groupBy(*PART).agg(
            F.max_by(F.struct(*NODE, "depth", "weight"), "depth").alias("c")
        )
        centroids = stage_table(
            centroids.select(*PART, *[F.col(f"c.{x}").alias(f"c_{x}") for x in (*NODE, "depth", "weight")]), "centroids"
        )
        below = centroids.join(
            named.select(F.col("q0").alias("c_p0"), F.col("q1").alias("c_p1"), "conv_id", *NODE), ["c_p0", "c_p1"]
        ).select(*PART, "conv_id", F.col("p0").alias("child0"), F.col("p1").alias("child1"))
        state = state.join(centroids, PART).join(below, [*PART, "conv_id"], "left")
        state = stage_table(
            state.withColumns(
                {
                    "path": on_path,
                    "centroid": (F.col("p0") == F.col("c_p0")) & (F.col("p1") == F.col("c_p1")),
                    "below": F.col("child0").isNotNull() & (F.col("depth") > F.col("c_depth")),
                }
            ),
            "cut",
        )
        cut = state.where("centroid OR below").groupBy(*PART).agg(*[F.sum(v).alias(f"cut_{v}") for v in values])
        state = state.join(cut, PART)
        for v in values:
            added = F.when(F.col("path"), F.col(f"cut_{v}")).otherwise(0)
            state = state.withColumn(f"sum_{v}", F.col(f"sum_{v}") + added)
        # the centroid's sums are whole now: it is left as a component of its own, with nothing to add
        nothing = {v: F.lit(0).cast("long") for v in values}
        settled.append(
            state.where("centroid").withColumns({"c0": F.col("p0"), "c1": F.col("p1"), **nothing}).select(*columns)
        )
        state = state.where("NOT centroid").withColumns(
            {
                "c0": F.when(F.col("below"), F.col("child0")).otherwise(F.col("c0")),
                "c1": F.when(F.col("below"), F.col("child1")).otherwise(F.col("c1")),
                "weight": F.when(F.col("path"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")),
            }
        ).select(*columns)
    return _finish(reduce(DataFrame.unionByName, settled), values)


def _finish(parts: DataFrame, values: list[str]) -> DataFrame:
    """The decomposition of small components, each in one task."""
    sums = [f"sum_{v}" for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            table = pa.Table.from_batches(held)
            c0, c1 = (table.column(c).to_numpy() for c in PART)
            inner = np.flatnonzero((c0 != c0[-1]) | (c1 != c1[-1]))
            done = int(inner[-1]) + 1 if len(inner) else 0  # the last component may go on
            if done:
                yield solve(table.slice(0, done))
            held = table.slice(done).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    def solve(table: pa.Table) -> pa.RecordBatch:
        get = lambda names: list(zip(*[table.column(c).to_pylist() for c in names]))
        nodes, parents, parts = get(NODE), get(PARENT), get(PART)
        at = {node: i for i, node in enumerate(nodes)}
        up = [at.get(q, -1) if q[0] is not None else -1 for q in parents]
        up = [u if u >= 0 and parts[u] == parts[i] else -1 for i, u in enumerate(up)]
        own = [table.column(v).to_pylist() for v in values]
        out = [table.column(s).to_pylist() for s in sums]
        low = 0
        for high in range(1, len(parts) + 1):
            if high == len(parts) or parts[high] != parts[low]:
                centroid_sums(list(range(low, high)), up, own, out)
                low = high
        columns = [*table.select(NODE).columns, *[pa.array(o, pa.int64()) for o in out]]
        return pa.table(columns, [*NODE, *sums]).combine_chunks().to_batches()[0]

    width = shuffle_width(parts.sparkSession)
    rows = parts.select(*PART, "depth", *NODE, *PARENT, *values, *sums)
    return (
        rows.repartition(width, *PART)
        .sortWithinPartitions(*PART, "depth")
        .mapInArrow(run, ", ".join(f"{c} long" for c in (*NODE, *sums)))
    )


def centroid_sums(nodes: list[int], up: list[int], own: list[list[int]], out: list[list[int]]) -> None:
    """Add every node's subtree sums of ``own`` to ``out``, by centroid decomposition.

    ``nodes`` stand in order of depth, ``up`` is a node's parent or -1; the first node is the top.
    """
    work = [nodes]
    while work:
        part = work.pop()
        if len(part) == 1:
            for o, s in zip(own, out):
                s[part[0]] += o[part[0]]
            continue
        size = dict.fromkeys(part, 1)
        for i in reversed(part[1:]):
            size[up[i]] += size[i]
        centroid = next(i for i in reversed(part) if 2 * size[i] >= len(part))
        child_of = {centroid: centroid}  # the nodes below, by the centroid's child that they hang from
        pieces: dict[int, list[int]] = {}
        above = []
        for i in part:
            if i == centroid:
                continue
            over = child_of.get(up[i])
            if over is None:
                above.append(i)
                continue
            child_of[i] = i if over == centroid else over
            pieces.setdefault(child_of[i], []).append(i)
        path, i = [], centroid
        while i != part[0]:
            path.append(i)
            i = up[i]
        path.append(i)
        for o, s in zip(own, out):
            total = sum(o[i] for i in child_of)
            for i in path:
                s[i] += total
        work += pieces.values()
        if above:
            work.append(above)


def end_digests(places: DataFrame) -> DataFrame:
    """p0, p1 and the SHA-256 of the ids, in ascending order and joined by commas, of the
    conversations that end at the node.

    Ids are joined in chunks over ordered ranges; the digest runs over a node's chunks in
    order, so a node where very many conversations end is a few rows to its task.
    """
    width = shuffle_width(places.sparkSession)
    ends = places.where(F.col("depth") == F.col("turns")).select(*NODE, "conv_id")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            change = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            ids = columns[2].tolist()
            cuts = np.r_[np.flatnonzero(np.r_[b.num_rows > 0, change]), b.num_rows].tolist()
            spans = [
                (low, min(low + IDS_PER_CHUNK, high))
                for start, high in zip(cuts, cuts[1:])
                for low in range(start, high, IDS_PER_CHUNK)
            ]
            first = [low for low, _ in spans]
            text = [",".join(map(str, ids[low:high])) for low, high in spans]
            taken = [pa.array(c[first]) for c in columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(text, pa.string())], [*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        for b in batches:
            out = []
            for p0, p1, _, ids in zip(*[c.to_pylist() for c in b.columns]):
                if (p0, p1) == last:
                    running.update(b"," + ids.encode())
                    continue
                if last:
                    out.append((*last, running.hexdigest()))
                last, running = (p0, p1), hashlib.sha256(ids.encode())
            yield table(out)
        yield table([(*last, running.hexdigest())] if last else [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [*NODE, "ends_sha256"])

    chunks = (
        ends.repartitionByRange(width, *NODE, "conv_id")
        .sortWithinPartitions(*NODE, "conv_id")
        .mapInArrow(join_ids, "p0 long, p1 long, first long, ids string")
    )
    return (
        chunks.repartition(width, *NODE)
        .sortWithinPartitions(*NODE, "first")
        .mapInArrow(digest, "p0 long, p1 long, ends_sha256 string")
    )


def trie_report(turns: DataFrame, convs: DataFrame, small: int = SMALL, run: int = RUN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of every node of the trie; arguments as of ``build_trie``."""
    nodes, places = build_trie(turns, convs, run)
    children = nodes.groupBy(F.col("q0").alias("p0"), F.col("q1").alias("p1")).agg(F.count("*").alias("n_children"))
    none = F.lit(0).cast("long")
    nodes = stage_table(
        nodes.join(children, NODE, "left").withColumns(
            {
                "n_children": F.coalesce("n_children", none),
                "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
                "saved": (F.col("n_convs") - 1) * F.col("chars"),
            }
        ),
        "counted",
    )
    sums = roll_up(nodes, places, ["leaf", "saved"], small)
    over = nodes.select(F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(over, PARENT, "left")
        .join(sums, NODE)
        .join(end_digests(places), NODE, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("sum_leaf").alias("n_leaves"),
            F.col("sum_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )
