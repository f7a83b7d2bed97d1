"""Plans for IDOR detection (E*) over the ``access_log`` fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import detection as D
from vigil.plans import register
from vigil.plans.oracle_views import access_log_sql, with_views
from vigil.sources.fixtures import access_log

# Parameters of the registered plans: a 60 s window is almost always one row
# on this data, so the checked plans use a 3-day window (FIXTURES.md).
WINDOW_S = 3 * 86400
THRESHOLD = 3
GAP = 10
W_US = WINDOW_S * 1_000_000


def _join(c: str) -> F.Column:
    return F.array_join(F.col(c), ",").alias(c)


def events_projection(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id",
        "detection_ts_us",
        "user_id",
        "session_id",
        "severity",
        "distinct_resources_accessed",
        "is_sequential",
        "time_window_seconds",
        _join("failed_resources"),
        _join("resource_owners"),
        _join("mitre_tactics"),
        _join("mitre_techniques"),
        _join("mitre_sub_techniques"),
    )


def idor_events_df(spark, sf_dir: str, **params) -> DataFrame:
    p = dict(window_seconds=WINDOW_S, threshold=THRESHOLD, sequential_gap=GAP)
    p.update(params)
    return D.idor_events(access_log(spark, sf_dir), **p)


# --- oracle pieces -----------------------------------------------------------------

# Other-user failures with the explicit-owner rule: own failures removed,
# unknown owner counted as other.
_FAILS = "SELECT * FROM access_log WHERE NOT success AND (resource_owner_id IS NULL OR resource_owner_id <> user_id)"


def _window_sql(w_us: int, threshold: int, gap: int, fails: str = _FAILS, views: dict | None = None) -> str:
    v = dict(access_log=access_log_sql())
    if views:
        v.update(views)
    v["fails"] = fails
    v["win"] = f"""
        SELECT f.event_id, f.ts_us, f.user_id, f.session_id,
               count(DISTINCT g.resource_id) AS d,
               count(DISTINCT g.resource_id) FILTER (
                   WHERE TRY_CAST(NULLIF(regexp_extract(g.resource_id, '(\\d+)$', 1), '') AS BIGINT) IS NOT NULL) AS n_num,
               max(TRY_CAST(NULLIF(regexp_extract(g.resource_id, '(\\d+)$', 1), '') AS BIGINT)) AS id_max,
               min(TRY_CAST(NULLIF(regexp_extract(g.resource_id, '(\\d+)$', 1), '') AS BIGINT)) AS id_min,
               string_agg(g.resource_id, ',' ORDER BY g.ts_us, g.resource_id) AS failed_resources,
               list({{'r': g.resource_id, 'o': coalesce(g.resource_owner_id, 'unknown'), 'e': g.event_id}}
                    ORDER BY g.ts_us, g.resource_id, g.resource_owner_id NULLS FIRST, g.event_id) AS pairs,
               coalesce(string_agg(DISTINCT g.resource_owner_id, ',' ORDER BY g.resource_owner_id), '') AS resource_owners,
               count(*) AS win_count,
               min(g.ts_us) AS first_us, max(g.ts_us) AS last_us
        FROM fails f JOIN fails g
          ON g.session_id = f.session_id AND g.ts_us BETWEEN f.ts_us - {w_us} AND f.ts_us
        GROUP BY f.event_id, f.ts_us, f.user_id, f.session_id"""
    v["scored"] = f"""
        SELECT *, (d >= 3 AND n_num >= 3 AND (id_max - id_min) <= {gap} * (n_num - 1)) AS is_sequential
        FROM win"""
    v["laddered"] = f"""
        SELECT *, CASE WHEN d < 2 THEN 'LOG_ONLY' WHEN d = 2 THEN 'ALERT_LOW'
                       WHEN d >= {threshold} AND is_sequential THEN 'CRITICAL_IDOR_ATTACK'
                       ELSE 'ALERT_MEDIUM' END AS severity,
                  (d >= {threshold} AND d >= 3) AS has_event
        FROM scored"""
    return with_views(**v)


IDOR_EVENTS_SQL = _window_sql(W_US, THRESHOLD, GAP) + """
SELECT 'idor_evt_' || substr(sha256(session_id || ':' || ts_us || ':' || event_id), 1, 16) AS event_id,
       ts_us AS detection_ts_us, user_id, session_id, severity,
       d AS distinct_resources_accessed, is_sequential,
       (last_us - first_us) // 1000000 AS time_window_seconds,
       failed_resources, resource_owners,
       CASE WHEN NOT is_sequential AND d >= 3 THEN 'TA0009,TA0006' ELSE 'TA0009' END AS mitre_tactics,
       CASE WHEN NOT is_sequential AND d >= 3 THEN 'T1213,T1078.004' ELSE 'T1213' END AS mitre_techniques,
       CASE WHEN is_sequential THEN 'T1213.002' ELSE '' END AS mitre_sub_techniques
FROM laddered WHERE has_event
"""


@register("idor_events", IDOR_EVENTS_SQL)
def q_idor_events(spark, sf_dir):
    return events_projection(idor_events_df(spark, sf_dir))


# --- E2–E6: the window, one projection each -----------------------------------------
def _analyzed(spark, sf, **params):
    p = dict(window_seconds=WINDOW_S, threshold=THRESHOLD, sequential_gap=GAP)
    p.update(params)
    return D.detect(access_log(spark, sf), **p)


_BASE = _window_sql(W_US, THRESHOLD, GAP)


@register("failure_window", _BASE + "SELECT event_id, win_count, first_us AS win_first_us, last_us AS win_last_us FROM win")
def q_failure_window(spark, sf):
    a = _analyzed(spark, sf)
    return a.select("event_id", F.col("win_count").cast("bigint").alias("win_count"), "win_first_us", "win_last_us")


@register("distinct_in_window", _BASE + "SELECT event_id, session_id, d AS win_distinct FROM win")
def q_distinct(spark, sf):
    return _analyzed(spark, sf).select("event_id", "session_id", "win_distinct")


@register("sequential_check", _BASE + "SELECT event_id, d AS win_distinct, n_num AS numeric_ids, is_sequential FROM scored")
def q_sequential(spark, sf):
    return _analyzed(spark, sf).select("event_id", "win_distinct", F.col("win_numeric").alias("numeric_ids"), "is_sequential")


@register("idor_severity", _BASE + "SELECT event_id, severity, has_event FROM laddered")
def q_severity(spark, sf):
    return _analyzed(spark, sf).select("event_id", "severity", "has_event")


_MITRE_SQL = """
    CASE WHEN NOT is_sequential AND d >= 3 THEN 'TA0009,TA0006' ELSE 'TA0009' END AS mitre_tactics,
    CASE WHEN NOT is_sequential AND d >= 3 THEN 'T1213,T1078.004' ELSE 'T1213' END AS mitre_techniques,
    CASE WHEN is_sequential THEN 'T1213.002' ELSE '' END AS mitre_sub_techniques"""


@register("mitre_map", _BASE + f"SELECT event_id, {_MITRE_SQL} FROM laddered")
def q_mitre(spark, sf):
    a = _analyzed(spark, sf)
    return a.select("event_id", _join("mitre_tactics"), _join("mitre_techniques"), _join("mitre_sub_techniques"))


# --- E1 with the ownership lookup ---------------------------------------------------
TTL_S = 86400


def _access_classify_sql() -> str:
    from vigil.plans.oracle_views import is_owner_sql, ownership_ops_sql, ownership_state_sql

    views = dict(ops=ownership_ops_sql())
    views.update(ownership_state_sql(TTL_S * 1_000_000))
    views["probes"] = (
        "SELECT event_id AS probe_id, user_id, resource_id, ts_us FROM access_log WHERE NOT success AND resource_owner_id IS NULL"
    )
    views["owned"] = is_owner_sql(TTL_S * 1_000_000, "probes")
    views["cls"] = """
        SELECT a.*, coalesce(a.user_id = a.resource_owner_id, o.owned, false) AS owner_known
        FROM access_log a LEFT JOIN owned o ON o.probe_id = a.event_id"""
    fails = "SELECT * FROM cls WHERE NOT success AND NOT owner_known"
    return _window_sql(W_US, THRESHOLD, GAP, fails=fails, views=views) + """
SELECT c.event_id, c.user_id, c.owner_known,
       CASE WHEN c.success THEN 'LEGITIMATE_ACCESS' WHEN c.owner_known THEN 'LOG_ONLY' ELSE l.severity END AS result
FROM cls c LEFT JOIN laddered l ON l.event_id = c.event_id
"""


@register("access_classify", _access_classify_sql())
def q_access_classify(spark, sf):
    from vigil.sources.fixtures import ownership_ops

    return D.access_results(access_log(spark, sf), ownership_ops(spark, sf), TTL_S, WINDOW_S, THRESHOLD, GAP)


# --- E8 / E9 ------------------------------------------------------------------------
@register(
    "session_stats",
    with_views(access_log=access_log_sql(), fails=_FAILS, asof_t="SELECT max(ts_us) AS t FROM access_log")
    + f"""
SELECT s.session_id,
       count(f.event_id) AS failure_count,
       count(DISTINCT f.resource_id) AS distinct_resources,
       count(DISTINCT f.resource_owner_id) AS distinct_owners,
       (max(f.ts_us) - min(f.ts_us)) / 1000000.0 AS time_span_seconds,
       min(f.ts_us) AS first_failure_us, max(f.ts_us) AS last_failure_us
FROM (SELECT DISTINCT session_id FROM access_log) s CROSS JOIN asof_t a
LEFT JOIN fails f ON f.session_id = s.session_id AND f.ts_us BETWEEN a.t - {W_US} AND a.t
GROUP BY s.session_id""",
)
def q_session_stats(spark, sf):
    log = access_log(spark, sf)
    fails = D.classify_access(log).filter("other_failure")
    as_of = log.agg(F.max("ts_us")).first()[0]
    stats = D.session_stats(fails, as_of, WINDOW_S)
    sessions = log.select("session_id").distinct()
    out = sessions.join(stats, "session_id", "left")
    return out.select(
        "session_id",
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
        F.coalesce("distinct_resources", F.lit(0)).alias("distinct_resources"),
        F.coalesce("distinct_owners", F.lit(0)).alias("distinct_owners"),
        "time_span_seconds", "first_failure_us", "last_failure_us",
    )


_CLEARS_SQL = """SELECT 'sess_' || user_id AS session_id, epoch_us(ts) AS ts_us FROM events
                 WHERE event_type = 'signup' AND event_id % 11 = 4"""


def _clears_df(spark, sf):
    from vigil.sources.fixtures import epoch_us
    from vigil.sources.tables import table

    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return ev.filter((F.col("event_type") == "signup") & (F.col("event_id") % 11 == 4)).select(
        F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"), epoch_us("ts").alias("ts_us")
    )


@register(
    "session_clear",
    _window_sql(
        W_US, THRESHOLD, GAP,
        fails="""SELECT f.*, coalesce((SELECT max(c.ts_us) FROM clears c WHERE c.session_id = f.session_id
                                        AND c.ts_us <= f.ts_us), -1) AS clear_epoch FROM (""" + _FAILS + ") f",
        views=dict(clears=_CLEARS_SQL),
    ).replace(
        "ON g.session_id = f.session_id AND", "ON g.session_id = f.session_id AND g.clear_epoch = f.clear_epoch AND"
    )
    + "SELECT event_id, d AS win_distinct, severity, has_event FROM laddered",
)
def q_session_clear(spark, sf):
    log = access_log(spark, sf)
    fails = D.classify_access(log).filter("other_failure")
    tagged = D.assign_clear_epoch(fails, _clears_df(spark, sf))
    win = D.failure_window(tagged, WINDOW_S, keys=("session_id", "clear_epoch"))
    return D.analyze_failures(win, THRESHOLD, GAP).select("event_id", "win_distinct", "severity", "has_event")


# --- E10 / E11: routing -------------------------------------------------------------
ESCALATE_CONFIDENCE = 0.85


def _verdicts(spark, sf):
    """Reviewer verdicts keyed by access event id, from ``labels``."""
    from vigil.sources.tables import table

    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return lab.select(
        F.col("doc_id").alias("source_event_id"),
        F.when(F.col("quality") == 1, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("verdict"),
        F.when(F.col("toxic") == 1, 0.9).otherwise(0.7).alias("verdict_confidence"),
    )


_VERDICTS_SQL = """SELECT doc_id AS source_event_id,
    CASE WHEN quality = 1 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS verdict,
    CASE WHEN toxic = 1 THEN 0.9 ELSE 0.7 END AS verdict_confidence FROM labels"""

_ROUTE_SQL = """CASE WHEN l.severity = 'CRITICAL_IDOR_ATTACK' THEN 'soar'
                    WHEN l.severity = 'ALERT_MEDIUM' AND l.has_event AND v.verdict = 'TRUE_POSITIVE'
                         AND v.verdict_confidence > 0.85 THEN 'escalate'
                    WHEN l.severity = 'ALERT_MEDIUM' AND l.has_event THEN 'llm_review'
                    ELSE 'none' END"""


def route_column() -> F.Column:
    sev, ev = F.col("severity"), F.col("has_event")
    return (
        F.when(sev == "CRITICAL_IDOR_ATTACK", "soar")
        .when((sev == "ALERT_MEDIUM") & ev & (F.col("verdict") == "TRUE_POSITIVE")
              & (F.col("verdict_confidence") > ESCALATE_CONFIDENCE), "escalate")
        .when((sev == "ALERT_MEDIUM") & ev, "llm_review")
        .otherwise("none")
    )


def _routed(spark, sf):
    a = _analyzed(spark, sf).select("event_id", "severity", "has_event")
    return a.join(_verdicts(spark, sf), a.event_id == F.col("source_event_id"), "left").withColumn("route", route_column())


@register(
    "alert_route",
    _window_sql(W_US, THRESHOLD, GAP, views=dict(verdicts=_VERDICTS_SQL))
    + f"SELECT l.event_id, l.severity, {_ROUTE_SQL} AS route FROM laddered l LEFT JOIN verdicts v ON v.source_event_id = l.event_id",
)
def q_alert_route(spark, sf):
    return _routed(spark, sf).select("event_id", "severity", "route")


MODES = ["shadow", "alert_queue", "active"]


def mode_route(route: F.Column, mode: F.Column) -> F.Column:
    """Shadow logs only; alert_queue sends everything routed to a human
    queue without auto-hold; active routes as computed, auto-hold on CRITICAL."""
    return F.when(mode == "shadow", F.lit("log_only")).when(
        (mode == "alert_queue") & (route != "none"), F.lit("review_queue")
    ).otherwise(route)


@register(
    "alert_mode",
    _window_sql(W_US, THRESHOLD, GAP, views=dict(verdicts=_VERDICTS_SQL))
    + f"""SELECT l.event_id, m.mode,
       CASE WHEN m.mode = 'shadow' THEN 'log_only'
            WHEN m.mode = 'alert_queue' AND {_ROUTE_SQL} <> 'none' THEN 'review_queue'
            ELSE {_ROUTE_SQL} END AS route,
       (m.mode = 'active' AND l.severity = 'CRITICAL_IDOR_ATTACK') AS auto_hold
FROM laddered l LEFT JOIN verdicts v ON v.source_event_id = l.event_id
CROSS JOIN (VALUES ('shadow'), ('alert_queue'), ('active')) m(mode)""",
)
def q_alert_mode(spark, sf):
    r = _routed(spark, sf)
    # one output row per deployment mode: a fan-out over a literal list
    j = r.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    return j.select(
        "event_id", "mode", mode_route(F.col("route"), F.col("mode")).alias("route"),
        ((F.col("mode") == "active") & (F.col("severity") == "CRITICAL_IDOR_ATTACK")).alias("auto_hold"),
    )


# --- E12: threshold presets ---------------------------------------------------------
# Published presets (threshold, window seconds, sequential gap), plus the
# 3-day window the checked plans use so the sweep has detections on this data.
PRESETS = [(3, 60, 10), (5, 120, 10), (5, 300, 20), (3, WINDOW_S, 10)]


def _sweep_sql() -> str:
    parts = []
    for i, (t, w, g) in enumerate(PRESETS):
        body = _window_sql(w * 1_000_000, t, g)
        parts.append(
            f"SELECT * FROM ({body} SELECT {t} AS threshold, {w} AS window_seconds, {g} AS sequential_gap, severity, "
            f"count(*) AS failures, count(*) FILTER (WHERE has_event) AS events FROM laddered GROUP BY severity)"
        )
    return " UNION ALL ".join(parts)


@register("threshold_sweep", _sweep_sql())
def q_sweep(spark, sf):
    out = None
    for t, w, g in PRESETS:
        a = _analyzed(spark, sf, window_seconds=w, threshold=t, sequential_gap=g)
        part = a.groupBy("severity").agg(
            F.count(F.lit(1)).alias("failures"), F.count_if("has_event").alias("events")
        ).select(
            F.lit(t).alias("threshold"), F.lit(w).alias("window_seconds"), F.lit(g).alias("sequential_gap"),
            "severity", "failures", "events",
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- E13: naive vs ownership-aware --------------------------------------------------
@register(
    "naive_vs_aware",
    _window_sql(
        W_US, THRESHOLD, GAP,
        views=dict(nwin="SELECT a.event_id, count(DISTINCT b.resource_id) AS naive_distinct "
                   "FROM access_log a JOIN access_log b ON b.session_id = a.session_id "
                   f"AND b.ts_us BETWEEN a.ts_us - {W_US} AND a.ts_us GROUP BY a.event_id"),
    )
    + """SELECT coalesce(n.event_id, l.event_id) AS event_id, n.naive_distinct, n.naive_distinct >= 3 AS naive_alert,
       l.d AS aware_distinct, coalesce(l.has_event, false) AS aware_alert
FROM nwin n FULL OUTER JOIN laddered l ON l.event_id = n.event_id""",
)
def q_naive_vs_aware(spark, sf):
    from vigil.operators.windows import sliding_window

    log = access_log(spark, sf).select("event_id", "session_id", "ts_us", "resource_id")
    naive = sliding_window(log, ["session_id"], "ts_us", WINDOW_S, "resource_id", {"naive_distinct": F.lit(True)}).select(
        "event_id", "naive_distinct"
    )
    aware = _analyzed(spark, sf).select("event_id", F.col("win_distinct").alias("aware_distinct"), "has_event")
    j = naive.join(aware, "event_id", "full_outer")
    return j.select(
        "event_id", "naive_distinct", (F.col("naive_distinct") >= 3).alias("naive_alert"),
        "aware_distinct", F.coalesce("has_event", F.lit(False)).alias("aware_alert"),
    )


# --- E14: attack pattern label -----------------------------------------------------
SPRAY_GAP = 100
MANUAL_SECONDS = 10


def attack_pattern_column() -> F.Column:
    n = F.col("win_numeric")
    id_gap = F.when(n >= 2, (F.col("win_id_max") - F.col("win_id_min")) / (n - 1))
    t_gap = F.when(F.col("win_count") >= 2, (F.col("win_last_us") - F.col("win_first_us")) / F.lit(1e6) / (F.col("win_count") - 1))
    return (
        F.when(F.col("is_sequential"), "sequential")
        .when(id_gap > SPRAY_GAP, "spray")
        .when(t_gap > MANUAL_SECONDS, "manual")
        .otherwise("unclassified")
    )


@register(
    "attack_pattern",
    _BASE
    + f"""SELECT event_id, CASE WHEN is_sequential THEN 'sequential'
             WHEN n_num >= 2 AND (id_max - id_min) / (n_num - 1) > {SPRAY_GAP} THEN 'spray'
             WHEN win_count >= 2 AND (last_us - first_us) / 1e6 / (win_count - 1) > {MANUAL_SECONDS} THEN 'manual'
             ELSE 'unclassified' END AS attack_pattern
FROM scored WHERE d >= 3""",
)
def q_attack_pattern(spark, sf):
    a = _analyzed(spark, sf).filter(F.col("win_distinct") >= 3)
    return a.select("event_id", attack_pattern_column().alias("attack_pattern"))


# --- E17: frontend/backend stitch ---------------------------------------------------
STITCH_S = 3600


RUM_STITCH_SQL = (
    with_views(access_log=access_log_sql(), fails=_FAILS,
               views="SELECT 'sess_' || user_id AS session_id, epoch_us(ts) AS view_us FROM events WHERE event_type = 'view'")
    + f"""SELECT f.event_id, f.session_id, f.ts_us, count(v.view_us) AS page_loads_in_window, max(v.view_us) AS last_page_load_us
FROM fails f LEFT JOIN views v ON v.session_id = f.session_id AND v.view_us BETWEEN f.ts_us - {STITCH_S * 1_000_000} AND f.ts_us
GROUP BY f.event_id, f.session_id, f.ts_us"""
)


@register("rum_stitch", RUM_STITCH_SQL)
def q_rum_stitch(spark, sf):
    from vigil.sources.fixtures import epoch_us
    from vigil.sources.tables import table

    log = access_log(spark, sf)
    fails = D.classify_access(log).filter("other_failure").select("event_id", "session_id", "ts_us")
    ev = table(spark, sf, "events").select("ts", "user_id", "event_type")
    views = ev.filter(F.col("event_type") == "view").select(
        F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"), epoch_us("ts").alias("ts_us")
    )
    return D.stitch_frontend(fails, views, STITCH_S)
