"""IDOR detection (E1–E9, E13, E14) as set operations over an access log.

Input contract (``access_log``): one row per request with ``event_id``,
``ts_us`` (event time, epoch µs), ``user_id``, ``session_id``,
``resource_id``, ``resource_owner_id`` (nullable), ``success``.

The reference decides per request against a key-value store at arrival
time. Here the same decision is a declarative plan: a ``when`` ladder for
the classification, an equi-join for the ownership lookup, and a bounded
``RANGE`` window per session for the sliding failure count. Event time plus
an explicit ``as_of`` replaces wall-clock ``now`` so results reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import idor as X
from vigil.operators.ownership import is_owner_asof
from vigil.operators.windows import sliding_window, window_members

_US = 1_000_000


def own_resource(df: DataFrame) -> DataFrame:
    """Tri-state ``is_own`` — NULL owner gives NULL, else equality."""
    return df.withColumn("is_own", F.col("user_id") == F.col("resource_owner_id"))


def _unknown_owner() -> Column:
    return F.coalesce(~F.col("success"), F.lit(False)) & F.col("resource_owner_id").isNull()


def classify_access(
    log: DataFrame,
    ownership_ops: DataFrame | None = None,
    ttl_seconds: int = X.DEFAULT_OWNERSHIP_TTL_SECONDS,
    require_session: bool = True,
) -> DataFrame:
    """Classify each request.

    Order of the checks follows the reference: no session → LOG_ONLY (before
    success); success → LEGITIMATE_ACCESS; failure on own resource → LOG_ONLY;
    unknown owner → ownership lookup (in ``ownership_ops``, if given; see
    ``vigil.operators.ownership.is_owner_asof``);
    otherwise the row is an other-user failure (``other_failure``) that feeds
    the sliding window. Only failures of unknown owner are looked up; other rows
    pass by the lookup, and no join brings the two together.
    """
    df = own_resource(log)
    known = F.coalesce(F.col("is_own"), F.lit(False))
    if ownership_ops is not None:
        looked_up = is_owner_asof(ownership_ops, df.filter(_unknown_owner()), ttl_seconds)
        df = df.filter(~_unknown_owner()).withColumn("owned", F.lit(False)).unionByName(looked_up)
        known = known | F.col("owned")
    no_session = F.col("session_id").isNull() | (F.col("session_id") == "")
    cls = (
        F.when(no_session if require_session else F.lit(False), F.lit("NO_SESSION"))
        .when(F.col("success"), F.lit(X.LEGITIMATE_ACCESS))
        .when(F.col("owner_known"), F.lit("OWN_FAILURE"))
        .otherwise(F.lit("OTHER_FAILURE"))
    )
    df = df.withColumn("owner_known", known).withColumn("access_class", cls).drop("owned")
    return df.withColumn("other_failure", F.col("access_class") == "OTHER_FAILURE")


def access_results(
    log: DataFrame,
    ownership_ops: DataFrame,
    ttl_seconds: int = X.DEFAULT_OWNERSHIP_TTL_SECONDS,
    window_seconds: int = X.DEFAULT_WINDOW_SECONDS,
    threshold: int = X.DEFAULT_THRESHOLD,
    sequential_gap: int = X.DEFAULT_SEQUENTIAL_GAP,
) -> DataFrame:
    """``event_id, user_id, owner_known, result`` of every request: the severity of its window for
    an other-user failure, LEGITIMATE_ACCESS or LOG_ONLY for the rest.

    Failures go through the windows only, and through the lookup first if their owner is unknown
    (those found owned bring no resource into a window): six shuffles, no join."""
    columns = ["event_id", "user_id", "owner_known", "other_failure"]
    known = classify_access(log.filter(~_unknown_owner()))
    asked = classify_access(log.filter(_unknown_owner()), ownership_ops, ttl_seconds)
    result = F.when(F.col("access_class") == X.LEGITIMATE_ACCESS, X.LEGITIMATE_ACCESS).otherwise(X.LOG_ONLY)
    passed = known.filter(~F.col("other_failure")).select(*columns[:3], result.alias("result"))
    counted = F.when(F.col("other_failure"), F.col("resource_id")).alias("resource_id")
    rows = known.filter("other_failure").unionByName(asked).select(*columns, "session_id", "ts_us", counted)
    scored = analyze_failures(failure_window(rows, window_seconds), threshold, sequential_gap)
    severity = F.when(F.col("other_failure"), F.col("severity")).otherwise(X.LOG_ONLY)
    return passed.unionByName(scored.select(*columns[:3], severity.alias("result")))


def failure_window(
    failures: DataFrame,
    window_seconds: int = X.DEFAULT_WINDOW_SECONDS,
    keys: tuple[str, ...] = ("session_id",),
    id_mode: str = "suffix",
) -> DataFrame:
    """Per other-user failure, the session's failures in ``[t - w, t]``.

    Adds ``win_count``, ``win_first_us``, ``win_last_us``, ``win_distinct`` (distinct resources),
    ``win_numeric`` (those of them with a numeric id), ``win_id_min`` and ``win_id_max``. No list
    is built: see ``vigil.operators.windows.sliding_window``.
    """
    number = X.numeric_id(F.col("resource_id"), id_mode)
    out = sliding_window(
        failures,
        keys,
        "ts_us",
        window_seconds,
        "resource_id",
        {"win_distinct": F.lit(True), "win_numeric": number.isNotNull()},
        {"win_first_us": ("min", F.col("ts_us")), "win_id_min": ("min", number), "win_id_max": ("max", number)},
    )
    return out.withColumn("win_last_us", F.col("ts_us"))


def analyze_failures(
    windowed: DataFrame,
    threshold: int = X.DEFAULT_THRESHOLD,
    sequential_gap: int = X.DEFAULT_SEQUENTIAL_GAP,
) -> DataFrame:
    """Sequential test, severity ladder and MITRE mapping per failure."""
    d = F.col("win_distinct")
    dense = X.is_dense(F.col("win_numeric"), F.col("win_id_min"), F.col("win_id_max"), sequential_gap)
    return (
        windowed.withColumn("is_sequential", (d >= 3) & dense)
        .withColumn("severity", X.severity(d, F.col("is_sequential"), threshold))
        .withColumn("has_event", X.emits_event(d, threshold))
        .withColumn("mitre_tactics", X.mitre_tactics(F.col("is_sequential"), d))
        .withColumn("mitre_techniques", X.mitre_techniques(F.col("is_sequential"), d))
        .withColumn("mitre_sub_techniques", X.mitre_sub_techniques(F.col("is_sequential")))
    )


def detection_events(
    analyzed: DataFrame,
    failures: DataFrame,
    window_seconds: int = X.DEFAULT_WINDOW_SECONDS,
) -> DataFrame:
    """One detection event per failure that crossed the threshold. Only these windows are listed,
    once per session and instant, from ``failures`` (the rows that ``analyzed`` was made of)."""
    ev = analyzed.filter("has_event")
    member = F.struct("ts_us", "resource_id", "resource_owner_id", "event_id")
    listed = window_members(ev, failures, ["session_id"], "ts_us", window_seconds, member, "win_events")
    ev = ev.join(
        listed.withColumnsRenamed({"session_id": "_session", "ts_us": "_ts"}),
        F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("ts_us") == F.col("_ts")),
    )
    owners = F.transform("win_events", lambda e: e["resource_owner_id"])
    event_id = F.concat(
        F.lit("idor_evt_"),
        F.substring(
            F.sha2(F.concat_ws(":", "session_id", F.col("ts_us").cast("string"), F.col("event_id").cast("string")), 256),
            1,
            16,
        ),
    )
    return ev.select(
        event_id.alias("event_id"),
        F.col("event_id").alias("source_event_id"),
        F.col("ts_us").alias("detection_ts_us"),
        "user_id",
        "session_id",
        "severity",
        F.col("win_distinct").alias("distinct_resources_accessed"),
        "is_sequential",
        ((F.col("win_last_us") - F.col("win_first_us")) / F.lit(_US)).cast("bigint").alias("time_window_seconds"),
        F.transform("win_events", lambda e: e["resource_id"]).alias("failed_resources"),
        F.transform("win_events", lambda e: F.coalesce(e["resource_owner_id"], F.lit("unknown"))).alias("failed_owners"),
        F.transform("win_events", lambda e: e["event_id"]).alias("window_event_ids"),
        F.array_sort(F.array_distinct(F.filter(owners, lambda o: o.isNotNull()))).alias("resource_owners"),
        "mitre_tactics",
        "mitre_techniques",
        "mitre_sub_techniques",
        F.struct(
            "user_id", "session_id", "resource_id", "resource_owner_id", "request_path",
            "user_email", "client_ip", "user_agent", "http_method", "ts_us",
        ).alias("telemetry_snapshot"),
    )


def detect(
    log: DataFrame,
    window_seconds: int = X.DEFAULT_WINDOW_SECONDS,
    threshold: int = X.DEFAULT_THRESHOLD,
    sequential_gap: int = X.DEFAULT_SEQUENTIAL_GAP,
    id_mode: str = "suffix",
    ownership_ops: DataFrame | None = None,
) -> DataFrame:
    """E1→E6 on a log: every other-user failure with its window verdict."""
    failures = classify_access(log, ownership_ops).filter("other_failure")
    return analyze_failures(failure_window(failures, window_seconds, id_mode=id_mode), threshold, sequential_gap)


def idor_events(
    log: DataFrame,
    window_seconds: int = X.DEFAULT_WINDOW_SECONDS,
    ownership_ops: DataFrame | None = None,
    **params,
) -> DataFrame:
    """E1→E7: detection events (the flagship)."""
    failures = classify_access(log, ownership_ops).filter("other_failure")
    analyzed = detect(log, window_seconds, ownership_ops=ownership_ops, **params)
    return detection_events(analyzed, failures, window_seconds)


def session_stats(failures: DataFrame, as_of_us, window_seconds: int) -> DataFrame:
    """Per session, failures inside ``[as_of - w, as_of]``."""
    w = F.lit(int(window_seconds) * _US)
    sel = failures.filter((F.col("ts_us") >= F.lit(as_of_us) - w) & (F.col("ts_us") <= F.lit(as_of_us)))
    return sel.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("failure_count"),
        F.count_distinct("resource_id").alias("distinct_resources"),
        F.count_distinct("resource_owner_id").alias("distinct_owners"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(_US)).alias("time_span_seconds"),
        F.min("ts_us").alias("first_failure_us"),
        F.max("ts_us").alias("last_failure_us"),
    )


def assign_clear_epoch(failures: DataFrame, clears: DataFrame) -> DataFrame:
    """Tag each failure with the time of the latest clear of its session at
    or before it (``clear_epoch``, -1 if none). A clear at the same instant
    comes first. Windows keyed by ``(session_id, clear_epoch)`` then forget
    everything before the clear."""
    from vigil.operators.sequence import running

    c = clears.select("session_id", "ts_us", F.lit(True).alias("_is_clear"))
    f = failures.withColumn("_is_clear", F.lit(False))
    u = f.unionByName(c, allowMissingColumns=True)
    u = running(
        u,
        ["session_id"],
        [F.col("ts_us"), F.col("_is_clear").desc()],
        {"clear_epoch": ("max", F.when(F.col("_is_clear"), F.col("ts_us")))},
        "ts_us",
    )
    return u.filter(~F.col("_is_clear")).withColumn("clear_epoch", F.coalesce("clear_epoch", F.lit(-1))).drop("_is_clear")


def stitch_frontend(
    backend: DataFrame,
    frontend: DataFrame,
    window_seconds: int,
) -> DataFrame:
    """Per backend failure, the session's frontend page loads in
    ``[t - w, t]``. Interval join made an equi-join on ``(session, time
    bucket)``: each failure probes its own bucket and the previous one, so a
    hot session is split by time instead of landing in one task."""
    w_us = int(window_seconds) * _US
    fb = frontend.select("session_id", F.col("ts_us").alias("view_us")).withColumn(
        "_b", F.floor(F.col("view_us") / F.lit(w_us))
    )
    bk = backend.withColumn("_b0", F.floor(F.col("ts_us") / F.lit(w_us))).withColumn(
        "_b", F.explode(F.array(F.col("_b0"), F.col("_b0") - 1))
    )
    cond = (
        (bk["session_id"] == fb["session_id"])
        & (bk["_b"] == fb["_b"])
        & (fb["view_us"] >= bk["ts_us"] - F.lit(w_us))
        & (fb["view_us"] <= bk["ts_us"])
    )
    j = bk.join(fb, cond, "left").select(bk["event_id"], bk["session_id"], bk["ts_us"], fb["view_us"])
    return j.groupBy("event_id", "session_id", "ts_us").agg(
        F.count("view_us").alias("page_loads_in_window"), F.max("view_us").alias("last_page_load_us")
    )
