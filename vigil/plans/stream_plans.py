"""Plans that run Structured Streaming queries to completion (E15, F7, F1 stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import detection as D
from vigil.operators import rules as R
from vigil.plans import register
from vigil.plans.detection_plans import GAP, IDOR_EVENTS_SQL, RUM_STITCH_SQL, STITCH_S, THRESHOLD, WINDOW_S
from vigil.plans.rules_plans import RULE_SCALE, _rule_sql
from vigil.sources.fixtures import access_log_from_events
from vigil.streaming import idor_stream as ST
from vigil.streaming import ownership_stream as OS
from vigil.streaming import stitch_stream as SS

#: The replayed micro-batches are in no order of time: no row of them is late.
ANY_ORDER = "3650 days"


@register("idor_stream", IDOR_EVENTS_SQL)
def q_idor_stream(spark, sf):
    """The detection stream over the events in five shuffled micro-batches; equal to the batch
    ``idor_events`` (same oracle)."""
    stream = ST.idor_stream(spark, sf, window_seconds=WINDOW_S, threshold=THRESHOLD, sequential_gap=GAP, watermark=ANY_ORDER)
    out = ST.run_available_now(spark, stream, "idor_stream")
    ev = ST.newest_verdicts(out).filter("has_event")
    seq, d = F.col("is_sequential"), F.col("win_distinct")
    return ev.select(
        F.concat(F.lit("idor_evt_"), F.substring(F.sha2(F.concat_ws(":", "session_id", F.col("ts_us").cast("string"),
                                                                     F.col("event_id").cast("string")), 256), 1, 16)).alias("event_id"),
        F.col("ts_us").alias("detection_ts_us"), "user_id", "session_id", "severity",
        d.alias("distinct_resources_accessed"), "is_sequential", "time_window_seconds", "failed_resources", "resource_owners",
        F.when(~seq & (d >= 3), F.lit("TA0009,TA0006")).otherwise(F.lit("TA0009")).alias("mitre_tactics"),
        F.when(~seq & (d >= 3), F.lit("T1213,T1078.004")).otherwise(F.lit("T1213")).alias("mitre_techniques"),
        F.when(seq, F.lit("T1213.002")).otherwise(F.lit("")).alias("mitre_sub_techniques"),
    )


@register("rule_seq_enum_stream", _rule_sql(R.SEQ_ENUM.scaled(RULE_SCALE)))
def q_rule_stream(spark, sf):
    """F1 on a stream: hop windows with a watermark; the distinct count is
    ``size(collect_set)`` (distinct aggregates are not allowed on streams)."""
    rule = R.SEQ_ENUM.scaled(RULE_SCALE)
    log = access_log_from_events(ST.events_stream(spark, sf))
    ev = R.rule_candidates(log, rule).withWatermark("event_time", ANY_ORDER)
    w = F.window("event_time", f"{rule.window_s} seconds", f"{rule.slide_s} seconds")
    g = ev.groupBy(w.alias("w"), "session_id").agg(
        F.size(F.collect_set("request_path")).cast("bigint").alias("distinct_urls"),
        F.count(F.lit(1)).alias("total_attempts"), F.max("user_id").alias("user_id"),
    )
    out = ST.run_available_now_update(spark, g, "rule_seq_enum_stream", ["w", "session_id"])
    return out.filter(F.col("distinct_urls") >= rule.min_distinct).select(
        F.lit(rule.name).alias("rule_name"), F.unix_micros("w.start").alias("window_start_us"), "session_id", "user_id",
        "distinct_urls", "total_attempts", F.lit(rule.risk_score).alias("risk_score"), F.lit(rule.severity).alias("severity"),
    )


def _classify_sql():
    from vigil.plans.detection_plans import _access_classify_sql

    return _access_classify_sql()


@register("access_classify_stream", _classify_sql())
def q_classify_stream(spark, sf):
    """E15 + E1/D2 on a stream of five shuffled micro-batches: ownership state per user, chained with the
    window state per session; equals the batch ``access_classify`` (same oracle)."""
    from vigil.plans.detection_plans import TTL_S

    log = access_log_from_events(ST.events_stream(spark, sf))
    out = OS.classify_stream(log, WINDOW_S, THRESHOLD, GAP, TTL_S, ANY_ORDER)
    with OS.rocksdb_state(spark):
        results = ST.run_available_now(spark, out, "classify_stream")
    return OS.newest_results(results).select("event_id", "user_id", "owner_known", "result")


LATE_BATCHES, LATE_DELAY_S = 5, 20 * 86400

_LATE_SQL = f"""
WITH dealt AS (
  SELECT event_id, epoch_us(ts) AS ts_us, event_id % {LATE_BATCHES} AS batch FROM events
), marks AS (
  SELECT batch, max(max(ts_us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM dealt GROUP BY batch
)
SELECT d.event_id, d.batch::BIGINT AS batch, coalesce(d.ts_us < m.newest - {LATE_DELAY_S * 1_000_000}, false) AS late
FROM dealt d JOIN marks m ON m.batch = d.batch
"""


@register("stream_late_rows", _LATE_SQL)
def q_late_rows(spark, sf):
    """The log in five micro-batches (``event_id`` modulo five, in that order), divided into on-time and late rows."""
    from vigil.sources.fixtures import epoch_us
    from vigil.sources.tables import table

    events = table(spark, sf, "events").select("event_id", epoch_us("ts").alias("ts_us"), "ts")
    stream = ST.replayed(spark, events, F.col("event_id") % LATE_BATCHES, LATE_BATCHES)
    on_time, late = OS.route_late(
        spark, stream.withColumn("event_time", F.col("ts").cast("timestamp")), "late_rows", LATE_DELAY_S
    )
    columns = ["event_id", F.col("batch_id").cast("long").alias("batch")]
    return spark.read.parquet(on_time).select(*columns, F.lit(False).alias("late")).unionByName(
        spark.read.parquet(late).select(*columns, F.lit(True).alias("late"))
    )


STITCH_BATCHES, STITCH_DELAY_S = 5, 14 * 86400


@register("rum_stitch_stream", RUM_STITCH_SQL)
def q_rum_stitch_stream(spark, sf):
    """E17 on two watermarked streams over the events in micro-batches; equal to the batch ``rum_stitch`` (same oracle).

    Rows come up to half the watermark's delay out of order, so a page load may follow its failure by batches;
    a last failure and page load of a session of their own, beyond every window, move the watermark past the others
    and stay in the state themselves."""
    from vigil.sources.fixtures import epoch_us
    from vigil.sources.tables import table

    events = table(spark, sf, "events")
    # one row: bounds of time
    low, high = events.agg(F.min(epoch_us("ts")), F.max(epoch_us("ts"))).first()
    low, high = low or 0, high or 0
    past = F.timestamp_micros(F.lit(high + 2 * (STITCH_DELAY_S + STITCH_S) * 1_000_000)).cast("timestamp_ntz")
    side = F.when(F.col("id") == 0, "error").otherwise("view")
    closing = spark.range(2).select(
        *[
            {"ts": past, "event_type": side, "user_id": F.lit(-1), "event_id": F.lit(-1)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in events.schema.fields
        ]
    )
    # up to a week's delay in arrival, then five spans of arrival
    arrival = epoch_us("ts") + F.pmod(F.xxhash64("event_id"), F.lit(STITCH_DELAY_S * 500_000))
    span = (high - low + STITCH_DELAY_S * 500_000) // STITCH_BATCHES + 1
    part = F.when(F.col("ts") == past, STITCH_BATCHES).otherwise(F.floor((arrival - F.lit(low)) / F.lit(span)))
    stream = ST.replayed(spark, events.unionByName(closing), part, STITCH_BATCHES + 1)
    delay = f"{STITCH_DELAY_S} seconds"
    log = access_log_from_events(stream).withWatermark("event_time", delay)
    fails = D.classify_access(log).filter("other_failure")
    views = stream.filter(F.col("event_type") == "view").select(
        F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )
    views = views.withWatermark("event_time", delay)
    return ST.run_available_now(spark, SS.stitch_stream(fails, views, STITCH_S), "rum_stitch_stream")
