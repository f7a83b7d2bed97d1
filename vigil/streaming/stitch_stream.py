"""E17 on streams: backend failures joined with frontend page loads of their session.

Both sides are streams with a watermark on ``event_time``. The join is an equi-join on
``(session, time bucket)`` with a time range, so a hot session is split by time, and Spark
evicts a page load once no failure within its window can arrive any more, and a failure
once no page load of its window can. A failure's pairs are then counted per failure; its
row is final when the watermark has passed it by the window.

Rows may come in any order as long as they are not behind the watermark: a page load that
arrives after its failure still counts. Spark drops rows behind the watermark;
``ownership_stream.route_late`` in front of either side keeps them in a table of their own.
Rows without a session or a time: such a failure has no page loads, such a page load
belongs to no failure (a failure without a time never leaves the state of the count and
gives no row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_US = 1_000_000


def _bucket(time: Column, window_seconds: int) -> Column:
    return F.floor(F.unix_micros(time) / F.lit(window_seconds * _US))


def stitch_stream(failures: DataFrame, views: DataFrame, window_seconds: int) -> DataFrame:
    """Per failure (``event_id, session_id, event_time``), the number and the last time of its
    session's page loads (``session_id, event_time``) in ``[t - window, t]``.

    Both sides carry a watermark on ``event_time``."""
    now = _bucket(F.col("event_time"), window_seconds)
    back = failures.select(
        "event_id", "session_id", "event_time", F.explode(F.array(now, now - 1)).alias("bucket")
    ).alias("b")
    front = views.select(
        F.col("session_id").alias("view_session"), F.col("event_time").alias("view_time"),
        _bucket(F.col("event_time"), window_seconds).alias("view_bucket"),
    ).alias("v")
    within = F.expr(
        f"session_id = view_session AND bucket = view_bucket AND view_time <= event_time"
        f" AND view_time >= event_time - INTERVAL {window_seconds} SECONDS"
    )
    return (
        back.join(front, within, "left_outer")
        .groupBy("event_id", "session_id", "event_time")
        .agg(F.count("view_time").alias("page_loads_in_window"), F.unix_micros(F.max("view_time")).alias("last_page_load_us"))
        .select("event_id", "session_id", F.unix_micros("event_time").alias("ts_us"), "page_loads_in_window", "last_page_load_us")
    )
