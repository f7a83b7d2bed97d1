"""Skew-safe running aggregates along event time within a key.

``Window.partitionBy(key).orderBy(ts)`` with an unbounded frame sends every
row of a key through one task; one user holding a third of all rows would
serialise the job. Running ``max``/``sum`` are associative, so they split:

1. local running value inside ``(key, time bucket)`` partitions;
2. one summary row per ``(key, bucket)`` (a partial aggregate, map-side
   combined), prefix-aggregated over earlier buckets of the same key;
3. equi-join the carry back and combine.

Step 2 works on ``#keys × #buckets`` rows, not on events, so a hot key
costs one summary row per bucket of its lifetime.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Six hours of event time in one task of a key.
BUCKET_US = 6 * 3600 * 1_000_000


def with_bucket(df: DataFrame, ts_us: str, bucket_us: int = BUCKET_US) -> DataFrame:
    return df.withColumn("_tb", F.floor(F.col(ts_us) / F.lit(bucket_us)))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    values: dict[str, tuple[str, Column]],
    ts_us: str,
    bucket_us: int = BUCKET_US,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates per key in ``order`` (which must start with ``ts_us``).

    ``values`` maps output name → (``"max"`` | ``"sum"``, value column).
    ``exclusive=True`` aggregates strictly preceding rows only.
    Returns ``df`` plus the named columns (NULL where nothing precedes).
    """
    b = with_bucket(df, ts_us, bucket_us)
    local_frame = (
        Window.partitionBy(*keys, "_tb").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    fns = {"max": F.max, "sum": F.sum}
    b = b.select("*", *[col.alias(f"_v_{name}") for name, (_, col) in values.items()])
    b = b.select("*", *[fns[fn](f"_v_{name}").over(local_frame).alias(f"_l_{name}") for name, (fn, _) in values.items()])
    # the bucket summary is read from the windowed rows themselves, so the
    # input is planned (and shuffled) once
    summary = b.groupBy(*keys, "_tb").agg(*[fns[fn](f"_v_{n}").alias(f"_s_{n}") for n, (fn, _) in values.items()])
    prev_frame = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_tb", *[fns[fn](f"_s_{n}").over(prev_frame).alias(f"_c_{n}") for n, (fn, _) in values.items()]
    )
    out = b.join(carry, [*keys, "_tb"], "left")
    for name, (fn, _) in values.items():
        loc, car = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if fn == "max":
            comb = F.greatest(loc, car)  # greatest skips NULLs
        else:
            comb = F.when(loc.isNull() & car.isNull(), F.lit(None)).otherwise(
                F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
            )
        out = out.withColumn(name, comb)
    drop = ["_tb"] + [c for n in values for c in (f"_v_{n}", f"_l_{n}", f"_c_{n}")]
    return out.drop(*drop)
