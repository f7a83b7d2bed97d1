"""KPIs, dashboards and monitoring aggregates.

Percentiles are exact and scale-safe: values are first reduced to a
histogram (one row per distinct integer value, a partial aggregate), and the
nearest-rank percentile is read off the cumulative counts — no task ever
holds all raw values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles_disc(
    df: DataFrame, value: str, ps: dict[str, float], keys: list[str] | None = None,
    with_count_mean: tuple[str, str, int] | None = None,
) -> DataFrame:
    """Nearest-rank percentile: smallest value whose cumulative count ≥ ceil(p·N).
    ``value`` must be integral (seconds, ms). ``with_count_mean=(n, mean, digits)``
    also returns the count and the rounded mean, read off the same histogram."""
    keys = keys or []
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy(*keys)
    h = hist.withColumn("_cum", F.sum("_n").over(w)).withColumn("_tot", F.sum("_n").over(wt))
    aggs = [
        F.min(F.when(F.col("_cum") >= F.ceil(F.col("_tot") * F.lit(p)), F.col(value))).alias(name) for name, p in ps.items()
    ]
    if with_count_mean:
        n, mean, digits = with_count_mean
        aggs = [F.sum("_n").alias(n), F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), digits).alias(mean)] + aggs
    return h.groupBy(*keys).agg(*aggs)


def share(df: DataFrame, count_col: str) -> Column:
    """Share of the total: the total is one aggregate scalar (no single-partition
    window, no join)."""
    total = df.agg(F.sum(count_col)).first()[0] or 0
    return F.col(count_col) / F.lit(float(total)) if total else F.lit(None).cast("double")


def rolling_mean(df: DataFrame, value: str, order: str, rows: int = 7) -> DataFrame:
    """K5: mean of the last ``rows`` rows (one row per day: a bounded table)."""
    w = Window.orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(f"{value}_roll{rows}", F.avg(value).over(w))


def week_over_week(df: DataFrame, value: str, order: str) -> DataFrame:
    """Previous week's value and the change."""
    w = Window.orderBy(order)
    return df.withColumn("prev_" + value, F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("prev_" + value))
