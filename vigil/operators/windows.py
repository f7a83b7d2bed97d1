"""Skew-safe bounded sliding windows.

A ``RANGE BETWEEN w PRECEDING AND CURRENT ROW`` window partitioned only by
session sends a whole session to one task; a scanner session holding a third
of all rows would then be a single straggler. Because the frame is bounded
by ``w``, the key can be split by time bucket instead.

``sliding_window`` (counts, distinct counts, extremes) never evaluates a frame
per row and never builds a list, so 10^5 rows in one window cost 10^5 steps.
``window_members`` lists the members of given windows only, as a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_US = 1_000_000


def _block(ts_us: str, w_us: int) -> Column:
    return F.floor(F.col(ts_us) / F.lit(max(w_us, 1)))


def sliding_window(
    df: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    window_seconds: int,
    item: str,
    distinct: Mapping[str, Column],
    extremes: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """``df`` plus aggregates over ``[ts - w, ts]`` per ``keys`` (both ends inclusive, ties included).

    ``win_count`` counts rows. Every entry of ``distinct`` counts the distinct non-null values of
    ``item`` for which its condition (a function of the item) holds; every entry of ``extremes``
    is the ``min`` or ``max`` of a value.

    Time is cut into blocks of one window's length, so ``[ts - w, ts]`` is the part of ts's block
    up to ts and the part of the block before from ts - w on. A row stands in its own block at
    ts, and as an expiry at ts + w in the next one, where it belongs to the window of every row
    up to that time. Each part is then a running aggregate: rows in order of time, expiries
    against it. An item is counted by intervals of coverage: its rows of one block cover the rest
    of the block from the first on; its rows of the block before cover up to the last expiry.
    Where the two overlap they are one interval, which goes on at the expiry instead of
    starting anew at the row. One shuffle; a task holds two windows of one key.
    """
    keys = list(keys)
    extremes = extremes or {}
    w_us = int(window_seconds) * _US
    late, at, order = F.col("_sw_late"), F.col("_sw_at"), F.col("_sw_order")
    rows = df.withColumn("_sw_late", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = rows.withColumns(
        {
            "_sw_block": _block(ts_us, w_us) + late.cast("int"),
            "_sw_at": F.col(ts_us) + F.when(late, F.lit(w_us)).otherwise(F.lit(0)),
            # at one instant: rows, then expiries (which reach it), then what the overlap hands on
            **{f"_sw_d_{n}": F.coalesce(c, F.lit(False)) & F.col(item).isNotNull() for n, c in distinct.items()},
            **{f"_sw_v_{n}": c for n, (_, c) in extremes.items()},
        }
    )
    rows = rows.withColumn("_sw_order", at * 2 + late.cast("int")).repartition(*keys, "_sw_block")

    of_item = Window.partitionBy(*keys, "_sw_block", item)
    in_turn = of_item.orderBy("_sw_late", ts_us)
    rows = rows.select(
        "*",
        (F.row_number().over(in_turn) == 1).alias("_sw_first"),
        F.lead(F.lit(True)).over(in_turn).isNull().alias("_sw_last"),
        F.min(F.when(~late, F.col(ts_us))).over(of_item).alias("_sw_on"),
        F.max(F.when(late, at)).over(of_item).alias("_sw_off"),
    )
    first, last = F.col("_sw_first") & ~late, F.col("_sw_last") & late
    overlap = F.coalesce(F.col("_sw_on") <= F.col("_sw_off"), F.lit(False))
    starts = ((first & ~overlap) | (last & overlap)).cast("long")
    ends = last.cast("long")

    part = Window.partitionBy(*keys, "_sw_block")
    upto = part.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = part.orderBy(order.desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fns = {"min": (F.min, F.least), "max": (F.max, F.greatest)}

    def both(now: Column, before: Column) -> tuple[Column, Column]:
        return F.coalesce(now.over(upto), F.lit(0)), F.coalesce(before.over(onward), F.lit(0))

    parts = {"win_count": both(F.sum((~late).cast("long")), F.sum(late.cast("long")))}
    for n in distinct:
        counted = F.col(f"_sw_d_{n}")
        parts[n] = both(F.sum(F.when(counted, starts)), F.sum(F.when(counted, ends)))
    for n, (fn, _) in extremes.items():
        value = F.col(f"_sw_v_{n}")
        agg = fns[fn][0]
        parts[n] = agg(F.when(~late, value)).over(upto), agg(F.when(late, value)).over(onward)
    rows = rows.select("*", *[c.alias(f"_sw_{k}_{n}") for n, (a, b) in parts.items() for k, c in (("a", a), ("b", b))])
    rows = rows.where(~late)
    out = {n: F.col(f"_sw_a_{n}") + F.col(f"_sw_b_{n}") for n in ("win_count", *distinct)}
    for n, (fn, _) in extremes.items():
        out[n] = fns[fn][1](F.col(f"_sw_a_{n}"), F.col(f"_sw_b_{n}"))
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def window_members(
    targets: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    window_seconds: int,
    member: Column,
    name: str = "members",
    order: Column | None = None,
) -> DataFrame:
    """``keys``, ``ts_us`` and the list of ``member`` over ``[ts - w, ts]``, sorted by ``order`` (the
    member itself if none is given), for every distinct (keys, ts) of ``targets``; rows of ``df``
    meet them by (keys, block of time)."""
    keys = list(keys)
    w_us = int(window_seconds) * _US
    t = targets.select(*[F.col(k).alias(f"_wm_{k}") for k in keys], F.col(ts_us).alias("_wm_ts")).distinct()
    here = _block("_wm_ts", w_us)
    t = t.withColumn("_wm_block", F.explode(F.array(here, here - 1)))
    ranked = F.struct((member if order is None else order).alias("o"), *([] if order is None else [member.alias("m")]))
    m = df.select(*keys, F.col(ts_us).alias("_wm_at"), ranked.alias("_wm_member"))
    m = m.withColumn("_wm_own", _block("_wm_at", w_us))
    same = [F.col(f"_wm_{k}").eqNullSafe(F.col(k)) for k in keys]
    inside = F.col("_wm_at").between(F.col("_wm_ts") - F.lit(w_us), F.col("_wm_ts"))
    joined = t.join(m, [*same, F.col("_wm_block") == F.col("_wm_own"), inside])
    ascending = lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)
    field = "o" if order is None else "m"
    listed = F.transform(F.array_sort(F.collect_list("_wm_member"), ascending), lambda x: x[field])
    return joined.groupBy(*[f"_wm_{k}" for k in keys], "_wm_ts").agg(listed.alias(name)).select(
        *[F.col(f"_wm_{k}").alias(k) for k in keys], F.col("_wm_ts").alias(ts_us), name
    )
