"""Streaming IDOR detection (E15) and stateful suppression (F7, stream form).

Event time is ``event_time`` (TIMESTAMP; parquet NTZ is cast first). State is
keyed by slot (a hash of the session) and time bucket, so a hot session is spread
over many keys and a key's call judges many sessions at once;
each failure goes to its own bucket and, as context, to those its window
reaches into. A key holds the rows of its bucket and of one window before it
until the watermark passes the bucket's end: up to then a row may arrive out
of order, and every verdict whose window it falls into is given again with a
higher ``revision`` (``newest_verdicts`` reads the last one). Rows behind the
watermark are dropped by Spark, which counts them in the query's progress.
Failures without a session belong to no window and are LOG_ONLY.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.functions import idor as X
from vigil.session import checkpoint_dir
from vigil.sources.fixtures import access_log_from_events
from vigil.streaming import kernels as K

_US = 1_000_000

OUT_SCHEMA = (
    "event_id long, ts_us long, user_id string, session_id string, win_distinct long, win_count long, "
    "is_sequential boolean, severity string, has_event boolean, failed_resources string, resource_owners string, "
    "time_window_seconds long, revision long"
)
#: Keys that sessions are dealt to: a call per session costs more than the work in it. Part of the
#: state's layout, so it must not change between restarts of one query.
SLOTS = 256
_ROW = ["event_id", "ts_us", "user_id", "session_id", "resource_id", "resource_owner_id", "number"]
STATE_SCHEMA = (
    "revision long, event_id array<long>, ts_us array<long>, user_id array<string>, session_id array<string>, resource_id array<string>, "
    "resource_owner_id array<string>, number array<double>"
)


def slot_of(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot")


def buckets_of(window_us: int, bucket_us: int) -> Column:
    """The bucket of a row and those that its window reaches into, one row each."""
    bucket = lambda us: F.floor((F.col("ts_us") + F.lit(us)) / F.lit(bucket_us))
    return F.explode(F.sequence(bucket(0), bucket(window_us))).alias("bucket")


#: Rows of a replayed file: a micro-batch of more rows has several files, read by as many tasks.
FILE_ROWS = 200_000


def replayed(spark: SparkSession, table: DataFrame, part: Column, batches: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """A table as a stream of ``batches`` micro-batches: ``part`` (0 to ``batches`` - 1) tells a row's.

    The parts are written one after the other into the shared checkpoint folder, all as the same
    number of files (as many as the largest part needs; empty ones fill a part up); the file source
    takes the oldest files first, those of one part per trigger."""
    path = os.path.join(checkpoint_dir(spark), "streams", f"replay-{uuid.uuid4().hex[:8]}")
    sizes = table.groupBy(part.alias("part")).count().filter(F.col("part").between(0, batches - 1))
    files = -(-(sizes.agg(F.max("count")).first()[0] or 1) // file_rows)
    for i in range(batches):
        rows = table.filter(part == i)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
        missing = files * (i + 1) - len(spark.read.schema(table.schema).parquet(path).inputFiles()) if files > 1 else 0
        for _ in range(missing):  # a part of few rows
            table.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def events_stream(spark: SparkSession, sf_dir: str, batches: int = 5) -> DataFrame:
    """``events`` as a stream of ``batches`` micro-batches in no order of time."""
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    return replayed(spark, events, F.pmod(F.xxhash64("event_id"), F.lit(batches)), batches)


def _listed(rows: dict, ts: np.ndarray, low: int, high: int) -> tuple[str, str]:
    """The resources of a window's rows in their order, and their distinct owners."""
    known = lambda x: (x is not None, x or "")
    resource, owner, event = (rows[c][low:high] for c in ("resource_id", "resource_owner_id", "event_id"))
    turn = sorted(range(high - low), key=lambda i: (ts[low + i], known(resource[i]), known(owner[i]), event[i]))
    return (
        ",".join(resource[i] for i in turn if resource[i] is not None),
        ",".join(sorted({o for o in owner if o})),
    )


def _make_fn(window_s: int, threshold: int, gap: int, bucket_s: int):
    w_us, b_us = window_s * _US, bucket_s * _US
    names = [c.split()[0] for c in OUT_SCHEMA.split(", ")]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = int(key[1])
        new = list(pdfs)  # the sessions of one slot, one bucket and one window of time
        revision, *held = state.get if state.exists else (0, *([] for _ in _ROW))
        rows = {}
        for c, old in zip(_ROW, held):
            kind = {"event_id": "int64", "ts_us": "int64", "number": "float64"}.get(c, object)
            rows[c] = np.concatenate([np.array(old, kind), *[p[c].to_numpy(kind) for p in new]])
        is_new = np.arange(len(rows["ts_us"])) >= len(held[0])
        order, line = K.apart(rows["session_id"], rows["ts_us"], w_us)
        rows = {c: v[order] for c, v in rows.items()}
        state.update((revision + 1, *(v.tolist() for v in rows.values())))
        # no row of this bucket's windows can arrive once the watermark has passed its end
        state.setTimeoutTimestamp((bucket + 1) * b_us // 1000)
        ts = rows["ts_us"]
        # a verdict is new or changes if a row arrived in its window
        mine = np.flatnonzero(K.touched(line, line[is_new[order]], w_us) & (ts >= bucket * b_us))
        if not len(mine):
            return
        v = K.window_verdicts(line, rows["resource_id"], rows["number"], w_us, threshold, gap)
        # only a detection lists its window, and rows of one session and instant share it
        lists = {}
        for i in mine[v["has_event"][mine]]:
            if line[i] not in lists:
                lists[line[i]] = _listed(rows, ts, v["lo"][i], v["hi"][i])
        listed = [lists[line[i]] if v["has_event"][i] else ("", "") for i in mine]
        out = {c: rows[c][mine] for c in ("event_id", "ts_us", "user_id", "session_id")}
        out |= {c: v[c][mine] for c in ("win_distinct", "win_count", "is_sequential", "severity", "has_event")}
        out |= {"failed_resources": [f for f, _ in listed], "resource_owners": [o for _, o in listed]}
        out |= {"time_window_seconds": v["span_us"][mine] // _US, "revision": revision + 1}
        yield pd.DataFrame(out)[names]

    return fn


def detect_stream(
    log: DataFrame,
    window_seconds: int = X.DEFAULT_WINDOW_SECONDS,
    threshold: int = X.DEFAULT_THRESHOLD,
    sequential_gap: int = X.DEFAULT_SEQUENTIAL_GAP,
    id_mode: str = "suffix",
    watermark: str = "10 minutes",
    bucket_seconds: int | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """Other-user failures of a streaming access log → verdicts per failure.

    ``bucket_seconds`` (default: sixty windows) is the time span of one state key: longer ones
    mean fewer keys and context copies, shorter ones split a hot session further. Sessions are
    dealt to ``slots`` keys: more of them for more sessions live at a time."""
    fails = log.filter(~F.col("success") & (F.col("resource_owner_id").isNull() | (F.col("resource_owner_id") != F.col("user_id"))))
    number = X.numeric_id(F.col("resource_id"), id_mode).cast("double").alias("number")
    fails = fails.select(
        "event_id", "ts_us", "user_id", "session_id", "resource_id", "resource_owner_id", number, "event_time"
    )
    in_session = F.coalesce(F.col("session_id") != "", F.lit(False))
    bucket_s = bucket_seconds or 60 * window_seconds
    in_window = (
        fails.filter(in_session)
        .withWatermark("event_time", watermark)
        .select("*", slot_of(F.col("session_id"), slots), buckets_of(window_seconds * _US, bucket_s * _US))
        .groupBy("slot", "bucket")
        .applyInPandasWithState(
            _make_fn(window_seconds, threshold, sequential_gap, bucket_s),
            OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout,
        )
    )
    alone = {
        "win_distinct": F.lit(1), "win_count": F.lit(1), "is_sequential": F.lit(False), "severity": F.lit(X.LOG_ONLY),
        "has_event": F.lit(False), "failed_resources": F.lit(""), "resource_owners": F.lit(""),
        "time_window_seconds": F.lit(0), "revision": F.lit(1),
    }
    types = dict(c.split() for c in OUT_SCHEMA.split(", "))
    without = fails.filter(~in_session).select(
        *[alone.get(name, F.col(name)).cast(kind).alias(name) for name, kind in types.items()]
    )
    return in_window.unionByName(without)


def newest_verdicts(out: DataFrame) -> DataFrame:
    """The last revision of every failure's verdict."""
    newest = out.groupBy("event_id").agg(F.max_by(F.struct(*out.columns), "revision").alias("v"))
    return newest.select("v.*")


def run_available_now(spark: SparkSession, df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Run a streaming DataFrame over everything available now into a table in
    the shared checkpoint folder; return the table as a batch DataFrame."""
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    q = (
        df.writeStream.format(fmt)
        .option("path", os.path.join(base, "out"))
        .option("checkpointLocation", os.path.join(base, "ckpt"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.format(fmt).load(os.path.join(base, "out"))


def idor_stream(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    log = access_log_from_events(events_stream(spark, sf_dir))
    return detect_stream(log, **params)


def suppress_stream(alerts: DataFrame, key: str, ts_col: str, suppress_s: int, watermark: str = "1 hour") -> DataFrame:
    """F7 (stream): exact greedy suppression with one timestamp of state per entity."""
    s_us = suppress_s * _US
    schema = alerts.select("event_id", key, "ts_us").schema.simpleString()[len("struct<"):-1] + ",fired boolean"

    def fn(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_us", "event_id"], kind="mergesort")
        fired = []
        for t in rows["ts_us"].astype("int64"):
            f = last is None or t >= last + s_us
            if f:
                last = int(t)
            fired.append(f)
        rows = rows[["event_id", key, "ts_us"]].assign(fired=fired)
        state.update((int(last),))
        state.setTimeoutTimestamp(int(last // 1000) + suppress_s * 1000 + 1)
        yield rows

    return (
        alerts.withWatermark(ts_col, watermark)
        .groupBy(key)
        .applyInPandasWithState(fn, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def run_available_now_update(spark: SparkSession, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream in ``update`` mode over everything available:
    every micro-batch appends its changed rows tagged with the batch id, and
    the result is the newest version of each key (an upsert outbox). Windows
    still open at the end of the input are included with their current value."""
    from pyspark.sql import Window

    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    out = os.path.join(base, "out")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (
        df.writeStream.foreachBatch(sink)
        .option("checkpointLocation", os.path.join(base, "ckpt"))
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    res = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return res.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch")
