"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no component is ever
gathered in one task; AQE splits the partition of a hub. Each round is written
to the shared folder, which cuts the lineage. Rounds grow with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stage_table


def _state(edges: DataFrame):
    return edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with the smallest of u and its neighbours as ``m``."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns u, v); root is the smallest
    node of its component. Loops and null ends are ignored; no edges give no rows."""
    e = stage_table(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(e)
    while state["n"]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = (
            _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        small = _to_smallest(large)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        e = stage_table(small.where("a != b").distinct(), "edges")
        before, state = state, _state(e)
        if before == state:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
