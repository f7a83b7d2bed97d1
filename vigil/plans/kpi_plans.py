"""Plans for EDR analytics (J*) and KPIs / dashboards / monitoring (K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import edr as J
from vigil.operators import kpi as K
from vigil.plans import register
from vigil.plans.detection_plans import THRESHOLD, GAP, W_US, _VERDICTS_SQL, _analyzed, _routed, _window_sql, attack_pattern_column
from vigil.plans.oracle_views import _lit, edr_events_sql, llm_responses_sql, alerts_sql, with_views
from vigil.sources import fixtures as FX
from vigil.sources.tables import table

_US = 1_000_000
HOUR, DAY, WEEK = 3600 * _US, 86400 * _US, 7 * 86400 * _US
EDR = with_views(e=edr_events_sql())


# --- J ------------------------------------------------------------------------------
@register(
    "edr_summary",
    EDR + """SELECT endpoint_id, alert_id, count(*) AS total_events, count(DISTINCT process_name) AS unique_processes,
       count(DISTINCT file_path) AS unique_files, count(DISTINCT remote_ip) AS unique_remote_ips,
       min(ts_us) AS first_event_us, max(ts_us) AS last_event_us, (max(ts_us) - min(ts_us)) // 1000000 AS duration_seconds,
       array_to_string(list_sort(list(DISTINCT threat_name)), ',') AS threat_names,
       array_to_string(list_sort(list(DISTINCT tactic)), ',') AS mitre_tactics
FROM e GROUP BY endpoint_id, alert_id""",
)
def q_edr_summary(spark, sf):
    s = J.edr_summary(FX.edr_events(spark, sf))
    return s.withColumn("threat_names", F.array_join("threat_names", ",")).withColumn("mitre_tactics", F.array_join("mitre_tactics", ","))


@register(
    "edr_flags",
    EDR + """SELECT endpoint_id, alert_id, bool_or(action = 'process_injected') AS code_injection_detected,
       bool_or(tactic = 'TA0004') AS privilege_escalation_detected,
       bool_or(tactic = 'TA0003' OR technique = 'T1547' OR action = 'registry_value_set') AS persistence_detected,
       bool_or(tactic = 'TA0010') AS exfiltration_detected,
       bool_or(tactic = 'TA0008' OR technique = 'T1021') AS lateral_movement_detected
FROM e GROUP BY endpoint_id, alert_id""",
)
def q_edr_flags(spark, sf):
    return J.edr_flags(FX.edr_events(spark, sf))


@register(
    "edr_parent",
    EDR.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """, procs AS (
  SELECT row_number() OVER () AS id, * FROM (
    SELECT endpoint_id, process_id, parent_process_id, process_name, min(ts_us) AS start_us FROM e GROUP BY ALL)
), parents AS (
  SELECT c.id, p.id AS up, p.process_name AS up_name
  FROM procs c JOIN procs p ON p.endpoint_id = c.endpoint_id AND p.process_id = c.parent_process_id
  QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY p.start_us <= c.start_us DESC,
    CASE WHEN p.start_us <= c.start_us THEN p.start_us END DESC, CASE WHEN p.start_us <= c.start_us THEN p.process_name END DESC,
    p.start_us, p.process_name) = 1
), line AS (
  SELECT id, id AS at, 0 AS depth, []::VARCHAR[] AS names FROM procs
  UNION ALL SELECT l.id, p.up, l.depth + 1, list_append(l.names, p.up_name) FROM line l JOIN parents p ON p.id = l.at
), whole AS (
  SELECT id, arg_max(names, depth) AS names, max(depth) AS depth FROM line GROUP BY id
)
SELECT endpoint_id, process_id, process_name, start_us, array_to_string(names, '>') AS ancestors, depth, false AS cyclic
FROM procs JOIN whole USING (id)""",
)
def q_edr_parent(spark, sf):
    return J.process_ancestry(FX.edr_events(spark, sf)).withColumn("ancestors", F.array_join("ancestors", ">"))


# --- K ------------------------------------------------------------------------------
BASE = _window_sql(W_US, THRESHOLD, GAP)
LBL = BASE.rstrip() + """,
lab AS (SELECT l.*, b.quality FROM laddered l JOIN labels b ON b.doc_id = l.event_id)
"""


def _labelled(spark, sf):
    a = _analyzed(spark, sf)
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), "quality")
    return a.join(lab, "event_id")


@register(
    "kpi_rates",
    LBL + """SELECT count(*) AS n_labelled, count(*) FILTER (WHERE has_event) AS n_alerts,
       round(count(*) FILTER (WHERE has_event AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS detection_rate,
       round(count(*) FILTER (WHERE has_event AND quality = 0) / nullif(count(*) FILTER (WHERE has_event), 0), 6) AS false_positive_rate,
       round(count(*) FILTER (WHERE NOT has_event AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS false_negative_rate
FROM lab""",
)
def q_rates(spark, sf):
    l = _labelled(spark, sf)
    tp, fp = F.col("quality") == 1, F.col("quality") == 0
    ev = F.col("has_event")
    return l.agg(
        F.count(F.lit(1)).alias("n_labelled"), F.count_if(ev).alias("n_alerts"),
        F.round(F.try_divide(F.count_if(ev & tp), F.count_if(tp)), 6).alias("detection_rate"),
        F.round(F.try_divide(F.count_if(ev & fp), F.count_if(ev)), 6).alias("false_positive_rate"),
        F.round(F.try_divide(F.count_if(~ev & tp), F.count_if(tp)), 6).alias("false_negative_rate"),
    )


def _pct_sql(src: str, v: str, ps: dict[str, float]) -> str:
    cols = ", ".join(f"min(CASE WHEN cum >= ceil(tot * {p}) THEN {v} END) AS {n}" for n, p in ps.items())
    return f"""(SELECT {cols} FROM (
        SELECT {v}, sum(n) OVER (ORDER BY {v} ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS tot
        FROM (SELECT {v}, count(*) AS n FROM {src} GROUP BY {v})))"""


@register(
    "kpi_ttd",
    BASE.rstrip() + """,
t AS (SELECT (ts_us - first_us) // 1000000 AS ttd_s FROM laddered WHERE has_event)
SELECT a.n, a.avg_ttd_s, p.p50_s, p.p95_s FROM (SELECT count(*) AS n, round(avg(ttd_s), 3) AS avg_ttd_s FROM t) a, """
    + _pct_sql("t", "ttd_s", {"p50_s": 0.5, "p95_s": 0.95})
    + " p",
)
def q_ttd(spark, sf):
    ev = _analyzed(spark, sf).filter("has_event").select(
        ((F.col("ts_us") - F.col("win_first_us")) / F.lit(_US)).cast("bigint").alias("ttd_s")
    )
    return K.percentiles_disc(ev, "ttd_s", {"p50_s": 0.5, "p95_s": 0.95}, with_count_mean=("n", "avg_ttd_s", 3))


@register(
    "kpi_mttr",
    _window_sql(W_US, THRESHOLD, GAP, views=dict(verdicts=_VERDICTS_SQL)).rstrip() + """,
r AS (SELECT l.event_id, CASE WHEN l.severity = 'CRITICAL_IDOR_ATTACK' THEN 'soar'
                              WHEN l.severity = 'ALERT_MEDIUM' AND l.has_event AND v.verdict = 'TRUE_POSITIVE' AND v.verdict_confidence > 0.85 THEN 'escalate'
                              WHEN l.severity = 'ALERT_MEDIUM' AND l.has_event THEN 'llm_review' ELSE 'none' END AS route,
             v.verdict FROM laddered l LEFT JOIN verdicts v ON v.source_event_id = l.event_id),
esc AS (SELECT *, 1 + event_id % 3 AS n_att FROM r WHERE route IN ('soar', 'escalate'))
SELECT count(*) AS escalations, round(avg(pow(2, n_att - 1) - 1 + n_att), 6) AS avg_mttr_s,
       count(*) FILTER (WHERE verdict = 'TRUE_POSITIVE') AS confirmed,
       round(count(*) FILTER (WHERE verdict = 'TRUE_POSITIVE') / nullif(count(*), 0), 6) AS escalation_accuracy
FROM esc""",
)
def q_mttr(spark, sf):
    r = _routed(spark, sf).filter(F.col("route").isin("soar", "escalate"))
    n = F.lit(1) + F.col("event_id") % 3
    mttr = F.pow(F.lit(2.0), n - 1) - 1 + n
    return r.agg(
        F.count(F.lit(1)).alias("escalations"), F.round(F.avg(mttr), 6).alias("avg_mttr_s"),
        F.count_if(F.col("verdict") == "TRUE_POSITIVE").alias("confirmed"),
        F.round(F.try_divide(F.count_if(F.col("verdict") == "TRUE_POSITIVE"), F.count(F.lit(1))), 6).alias("escalation_accuracy"),
    )


@register(
    "dash_hourly",
    BASE + f"SELECT (ts_us // {HOUR}) * {HOUR} AS hour_us, severity, count(*) AS detections FROM laddered WHERE has_event GROUP BY ALL",
)
def q_hourly(spark, sf):
    a = _analyzed(spark, sf).filter("has_event")
    return a.groupBy((F.floor(F.col("ts_us") / F.lit(HOUR)) * F.lit(HOUR)).cast("bigint").alias("hour_us"), "severity").agg(
        F.count(F.lit(1)).alias("detections")
    )


@register(
    "dash_fp_roll7",
    LBL + f"""SELECT day_us, alerts, fps, round(fp_rate, 6) AS fp_rate,
       round(avg(fp_rate) OVER (ORDER BY day_us ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS fp_rate_roll7
FROM (SELECT (ts_us // {DAY}) * {DAY} AS day_us, count(*) AS alerts, count(*) FILTER (WHERE quality = 0) AS fps,
             count(*) FILTER (WHERE quality = 0) / count(*) AS fp_rate FROM lab WHERE has_event GROUP BY 1)""",
)
def q_fp_roll(spark, sf):
    l = _labelled(spark, sf).filter("has_event")
    d = l.groupBy((F.floor(F.col("ts_us") / F.lit(DAY)) * F.lit(DAY)).cast("bigint").alias("day_us")).agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("quality") == 0).alias("fps"),
    ).withColumn("fp_rate", F.col("fps") / F.col("alerts"))
    r = K.rolling_mean(d, "fp_rate", "day_us", 7)
    return r.select("day_us", "alerts", "fps", F.round("fp_rate", 6).alias("fp_rate"), F.round("fp_rate_roll7", 6).alias("fp_rate_roll7"))


TOP_USERS = 10


@register(
    "dash_top_users",
    BASE + f"""SELECT user_id, failures, round(share, 6) AS share FROM (
  SELECT user_id, count(*) AS failures, count(*) / sum(count(*)) OVER () AS share FROM laddered GROUP BY user_id)
ORDER BY failures DESC, user_id LIMIT {TOP_USERS}""",
)
def q_top_users(spark, sf):
    a = _analyzed(spark, sf)
    c = a.groupBy("user_id").agg(F.count(F.lit(1)).alias("failures"))
    # a top-N dashboard panel: the limit is the feature
    return c.withColumn("share", F.round(K.share(c, "failures"), 6)).orderBy(F.col("failures").desc(), "user_id").limit(TOP_USERS)


@register(
    "dash_geo",
    BASE.rstrip() + """,
geo AS (SELECT coalesce(n.n_name, 'UNKNOWN') AS location FROM laddered l
        LEFT JOIN customer c ON 'user_' || c.c_custkey = l.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE l.has_event)
SELECT location, count(*) AS detections, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM geo GROUP BY location""",
)
def q_geo(spark, sf):
    a = _analyzed(spark, sf).filter("has_event").select("user_id")
    cu = table(spark, sf, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("user_id"), "c_nationkey")
    na = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = a.join(cu, "user_id", "left").join(F.broadcast(na), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    g = j.groupBy(F.coalesce("n_name", F.lit("UNKNOWN")).alias("location")).agg(F.count(F.lit(1)).alias("detections"))
    return g.withColumn("share", F.round(K.share(g, "detections"), 6))


@register(
    "dash_pattern",
    BASE + """SELECT attack_pattern, count(*) AS detections, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (
  SELECT CASE WHEN is_sequential THEN 'sequential'
              WHEN n_num >= 2 AND (id_max - id_min) / (n_num - 1) > 100 THEN 'spray'
              WHEN win_count >= 2 AND (last_us - first_us) / 1e6 / (win_count - 1) > 10 THEN 'manual'
              ELSE 'unclassified' END AS attack_pattern FROM scored WHERE d >= 3 AND d >= 3) GROUP BY attack_pattern""",
)
def q_pattern(spark, sf):
    a = _analyzed(spark, sf).filter("has_event")
    g = a.groupBy(attack_pattern_column().alias("attack_pattern")).agg(F.count(F.lit(1)).alias("detections"))
    return g.withColumn("share", F.round(K.share(g, "detections"), 6))


@register(
    "dash_delivery",
    """SELECT count(*) AS deliveries, count(*) FILTER (WHERE o_orderstatus <> 'F') AS delivered,
       round(count(*) FILTER (WHERE o_orderstatus <> 'F') / count(*), 6) AS success_rate,
       count(*) FILTER (WHERE 1 + o_orderkey % 3 > 1) AS retried,
       round(count(*) FILTER (WHERE 1 + o_orderkey % 3 > 1) / count(*), 6) AS retry_rate FROM orders""",
)
def q_delivery_health(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    ok, retried = F.col("o_orderstatus") != "F", (F.lit(1) + F.col("o_orderkey") % 3) > 1
    return o.agg(
        F.count(F.lit(1)).alias("deliveries"), F.count_if(ok).alias("delivered"),
        F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("success_rate"),
        F.count_if(retried).alias("retried"), F.round(F.count_if(retried) / F.count(F.lit(1)), 6).alias("retry_rate"),
    )


@register(
    "dash_weekly",
    BASE + """SELECT epoch_us(date_trunc('week', make_timestamp(ts_us))) AS week_us, severity, count(*) AS detections
FROM laddered WHERE has_event GROUP BY ROLLUP (epoch_us(date_trunc('week', make_timestamp(ts_us))), severity)""",
)
def q_weekly(spark, sf):
    a = _analyzed(spark, sf).filter("has_event")
    wk = F.unix_micros(F.date_trunc("week", F.timestamp_micros("ts_us")))
    return a.rollup(wk.alias("week_us"), "severity").agg(F.count(F.lit(1)).alias("detections"))


@register(
    "mon_latency",
    "WITH t AS (SELECT CAST(floor(value * 100) AS BIGINT) AS latency_ms FROM events) SELECT * FROM "
    + _pct_sql("t", "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}),
)
def q_latency(spark, sf):
    ev = table(spark, sf, "events").select(F.floor(F.col("value") * 100).cast("bigint").alias("latency_ms"))
    return K.percentiles_disc(ev, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})


RATE_WINDOW = HOUR
RATE_THRESHOLD = 0.01


@register(
    "mon_rate_alert",
    with_views(access_log=__import__("vigil.plans.oracle_views", fromlist=["access_log_sql"]).access_log_sql())
    + f"""SELECT (ts_us // {RATE_WINDOW}) * {RATE_WINDOW} AS window_start_us, count(*) AS requests,
       count(*) FILTER (WHERE NOT success) AS failures,
       round(count(*) FILTER (WHERE NOT success) / count(*), 6) AS failure_rate,
       count(*) FILTER (WHERE NOT success) / count(*) > {RATE_THRESHOLD} AS alert
FROM access_log GROUP BY 1""",
)
def q_rate_alert(spark, sf):
    log = FX.access_log(spark, sf)
    g = log.groupBy((F.floor(F.col("ts_us") / F.lit(RATE_WINDOW)) * F.lit(RATE_WINDOW)).cast("bigint").alias("window_start_us")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("success")).alias("failures"),
    )
    rate = F.col("failures") / F.col("requests")
    return g.select("window_start_us", "requests", "failures", F.round(rate, 6).alias("failure_rate"), (rate > RATE_THRESHOLD).alias("alert"))


@register(
    "kpi_wow",
    BASE + """SELECT week_us, detections, lag(detections) OVER (ORDER BY week_us) AS prev_detections,
       detections - lag(detections) OVER (ORDER BY week_us) AS change
FROM (SELECT epoch_us(date_trunc('week', make_timestamp(ts_us))) AS week_us, count(*) AS detections FROM laddered WHERE has_event GROUP BY 1)""",
)
def q_wow(spark, sf):
    a = _analyzed(spark, sf).filter("has_event")
    w = a.groupBy(F.unix_micros(F.date_trunc("week", F.timestamp_micros("ts_us"))).alias("week_us")).agg(F.count(F.lit(1)).alias("detections"))
    return K.week_over_week(w, "detections", "week_us").withColumnRenamed("prev_detections", "prev_detections")


UNIT_COST = 0.002


@register(
    "kpi_cost",
    _window_sql(W_US, THRESHOLD, GAP, views=dict(verdicts=_VERDICTS_SQL))
    + f"""SELECT epoch_us(date_trunc('month', make_timestamp(ts_us))) AS month_us, count(*) AS llm_calls,
       CAST(round(count(*) * {UNIT_COST}, 6) AS DOUBLE) AS cost_usd
FROM laddered WHERE severity = 'ALERT_MEDIUM' AND has_event GROUP BY 1""",
)
def q_cost(spark, sf):
    a = _analyzed(spark, sf).filter((F.col("severity") == "ALERT_MEDIUM") & F.col("has_event"))
    g = a.groupBy(F.unix_micros(F.date_trunc("month", F.timestamp_micros("ts_us"))).alias("month_us")).agg(
        F.count(F.lit(1)).alias("llm_calls")
    )
    return g.withColumn("cost_usd", F.round(F.col("llm_calls") * F.lit(UNIT_COST), 6))


def _hit_rate_sql() -> str:
    from vigil.plans.oracle_views import access_log_sql, ownership_ops_sql, ownership_state_sql

    v = dict(access_log=access_log_sql(), ops=ownership_ops_sql())
    v.update(ownership_state_sql(86400 * _US))
    v["probes"] = "SELECT event_id AS probe_id, resource_id, ts_us FROM access_log WHERE NOT success AND resource_owner_id IS NULL"
    return with_views(**v) + f"""SELECT count(*) AS lookups, count(owner) AS hits, round(count(owner) / count(*), 6) AS hit_rate FROM (
  SELECT CASE WHEN l.op = 'record' AND p.ts_us - l.seq // 4 < {86400 * _US} THEN l.user_id END AS owner
  FROM probes p LEFT JOIN LATERAL (
      SELECT o.op, o.seq, o.user_id FROM ops_s o
      WHERE o.resource_id = p.resource_id AND o.op IN ('record', 'remove') AND o.seq <= p.ts_us * 4 + 3
      ORDER BY o.seq DESC, o.user_id DESC LIMIT 1) l ON true)"""


@register("kpi_hit_rate", _hit_rate_sql())
def q_hit_rate(spark, sf):
    """Share of unknown-owner lookups answered by the reverse ownership map."""
    from vigil.operators.ownership import resource_owner_asof

    log = FX.access_log(spark, sf)
    probes = log.filter(~F.col("success") & F.col("resource_owner_id").isNull()).select(
        F.col("event_id").alias("probe_id"), "resource_id", "ts_us"
    )
    got = resource_owner_asof(FX.ownership_ops(spark, sf), probes, 86400)
    return got.agg(
        F.count(F.lit(1)).alias("lookups"), F.count("owner").alias("hits"),
        F.round(F.count("owner") / F.count(F.lit(1)), 6).alias("hit_rate"),
    )


@register(
    "kpi_audit_cover",
    with_views(alerts=alerts_sql(), r=llm_responses_sql())
    + """SELECT count(*) AS alerts, count(*) - count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.alert_id = a.alert_id)) AS audited,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.alert_id = a.alert_id)) AS missing,
       round(1 - count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.alert_id = a.alert_id)) / count(*), 6) AS coverage
FROM alerts a""",
)
def q_audit_cover(spark, sf):
    a = FX.alerts(spark, sf).select("alert_id")
    audit = FX.llm_responses(spark, sf).select("alert_id", F.lit(True).alias("_audited")).dropDuplicates(["alert_id"])
    j = a.join(audit, "alert_id", "left")
    miss = F.count_if(F.col("_audited").isNull())
    return j.agg(F.count(F.lit(1)).alias("alerts"), (F.count(F.lit(1)) - miss).alias("audited"), miss.alias("missing"),
                 F.round(1 - miss / F.count(F.lit(1)), 6).alias("coverage"))
