"""Plans for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scrub as S
from vigil.operators import sinks as X
from vigil.operators import triage as T
from vigil.plans import register
from vigil.plans.cases_plans import EVX
from vigil.plans.oracle_views import _lit, access_log_sql, alerts_sql, edr_events_sql, llm_responses_sql, scrub_sql, with_views
from vigil.plans.rules_plans import events_df
from vigil.sources import fixtures as FX
from vigil.sources import udm as U
from vigil.sources.tables import table

_US = 1_000_000
WEBHOOK_SECRET = "vigil-webhook-secret"


@register("udm_alert_parse")
def q_udm_parse(spark, sf):
    p = U.parse_udm(U.udm_json(spark, sf))
    return p.select("rule_id", "rule_name", "timestamp", "severity", "risk_score", "session_id",
                    F.size("udm_events").alias("udm_event_count"), F.array_join("errors", "|").alias("errors"))


@register("udm_flatten")
def q_udm_flatten(spark, sf):
    return U.flatten_udm(U.parse_udm(U.udm_json(spark, sf)))


@register("udm_to_alert")
def q_udm_to_alert(spark, sf):
    a = U.udm_to_alert(U.parse_udm(U.udm_json(spark, sf)))
    return a.select("alert_id", "severity", "source", "title", "description", "timestamp", "affected_user",
                    F.col("raw_data.udm_event_count").alias("udm_event_count"),
                    F.size("raw_data.udm_sample_events").alias("udm_samples"))


@register("pii_scrub_udm")
def q_scrub_udm(spark, sf):
    s = U.scrub_udm(U.parse_udm(U.udm_json(spark, sf)).drop("body", "errors"))
    return s.select("session_id", "timestamp", F.to_json("udm_events").alias("udm_events"))


@register("signature_flag")
def q_signature(spark, sf):
    """Bodies signed with the shared secret; every 10th signature corrupted
    and flagged (a mismatch is only flagged, not rejected)."""
    b = U.udm_json(spark, sf)
    good = F.concat(F.lit("sha256="), X.hmac_sha256_hex(WEBHOOK_SECRET, F.col("body")))
    hdr = F.when(F.pmod(F.xxhash64("body"), F.lit(10)) == 0, F.concat(good, F.lit("00"))).otherwise(good)
    return b.select(F.sha2("body", 256).alias("body_sha256"), X.signature_valid(F.col("body"), hdr, WEBHOOK_SECRET).alias("signature_valid"))


@register(
    "edr_scan",
    with_views(e=edr_events_sql())
    + "SELECT endpoint_id, alert_id, process_id, process_name, action, remote_ip, ts_us FROM e WHERE endpoint_id IS NOT NULL AND ts_us IS NOT NULL",
)
def q_edr_scan(spark, sf):
    e = FX.edr_events(spark, sf)
    return e.filter(F.col("endpoint_id").isNotNull() & F.col("ts_us").isNotNull()).select(
        "endpoint_id", "alert_id", "process_id", "process_name", "action", "remote_ip", "ts_us"
    )


SEARCH_PREDICATE = "http_status = 403 AND request_path LIKE '/api/v1/%'"
SEARCH_RANGE = "7d"
SEARCH_MAX = 100


@register(
    "event_search",
    with_views(access_log=access_log_sql())
    + f"""SELECT event_id, ts_us, {scrub_sql('user_id')} AS user_id, {scrub_sql('user_email')} AS user_email,
       {scrub_sql('client_ip')} AS client_ip, {scrub_sql('request_path')} AS request_path
FROM access_log WHERE http_status = 403 AND request_path LIKE '/api/v1/%'
  AND ts_us >= (SELECT max(ts_us) FROM access_log) - 7 * 86400000000 AND ts_us <= (SELECT max(ts_us) FROM access_log)
ORDER BY ts_us DESC, event_id DESC LIMIT {SEARCH_MAX}""",
)
def q_search(spark, sf):
    end = FX.max_time_us(spark, sf, "events", "ts")
    # prune the scan to the searched range (7 days back from the end); the
    # operator applies the exact time-range rule on top
    log = FX.access_log(spark, sf, since_us=end - 7 * 86400 * _US, until_us=end).select(
        "event_id", "ts_us", "user_id", "user_email", "client_ip", "request_path", "http_status"
    )
    r = X.event_search(log, SEARCH_PREDICATE, SEARCH_RANGE, SEARCH_MAX, end_us=end)
    return r.drop("http_status")


_URLS_ALL = ("list_transform(string_split(mitre_techniques, ',') || CASE WHEN is_sequential THEN ['T1213.002'] ELSE [] END, "
             "lambda t: 'https://attack.mitre.org/techniques/' || replace(t, '.', '/') || '/')")


@register(
    "siem_export",
    EVX + f"""SELECT event_id, CAST(make_timestamp(detection_ts_us) AS DATE) AS event_date, CAST(to_json({{
  'timestamp': strftime(make_timestamp(detection_ts_us), '%Y-%m-%dT%H:%M:%S.%gZ'),
  'source': 'vigil', 'sourcetype': 'idor_detection', 'event_type': 'idor_detection_event',
  'event_id': event_id, 'severity': severity, 'user_id': user_id, 'session_id': session_id,
  'distinct_resources_accessed': distinct_resources_accessed, 'is_sequential': is_sequential,
  'time_window_seconds': time_window_seconds,
  'failed_resources': string_split(failed_resources, ','),
  'resource_owners': CASE WHEN resource_owners = '' THEN [] ELSE string_split(resource_owners, ',') END,
  'mitre_tactics': string_split(mitre_tactics, ','), 'mitre_techniques': string_split(mitre_techniques, ','),
  'mitre_sub_techniques': CASE WHEN is_sequential THEN ['T1213.002'] ELSE [] END,
  'mitre_attack_urls': {_URLS_ALL},
  'user_email': {scrub_sql('user_email')}, 'client_ip': {scrub_sql('client_ip')}, 'user_agent': user_agent,
  'auto_hold_triggered': severity = 'CRITICAL_IDOR_ATTACK'}}) AS VARCHAR) AS json FROM evx""",
)
def q_siem_export(spark, sf):
    return X.siem_record(events_df(spark, sf))


MODEL = "triage-model-v1"
TEMPLATE_VERSION = "v1"


@register(
    "audit_log",
    with_views(alerts=alerts_sql(), r=llm_responses_sql())
    + f"""SELECT a.alert_id, a.timestamp, coalesce(CASE WHEN regexp_matches(r.response_text, '(?s)<result>(.*?)</result>')
              THEN regexp_replace(regexp_extract(r.response_text, '(?s)<result>(.*?)</result>', 1), '^\\s+|\\s+$', '', 'g') END,
              'NEEDS_INVESTIGATION') AS triage_decision,
       {_lit(MODEL)} AS model_used, {_lit(TEMPLATE_VERSION)} AS prompt_template_version,
       sha256({scrub_sql('a.description')}) AS raw_alert_sha256, sha256(r.response_text) AS llm_raw_response_sha256,
       'business_context' AS rag_sources, CAST(make_timestamp(epoch_us(strptime(a.timestamp, '%Y-%m-%dT%H:%M:%SZ'))) AS DATE) AS audit_date
FROM alerts a JOIN r ON r.alert_id = a.alert_id""",
)
def q_audit(spark, sf):
    """One audit row per triaged alert (decision, model, prompt and response
    fingerprints), partitioned by day when written."""
    a = FX.alerts(spark, sf).select("alert_id", "timestamp", "description")
    p = T.parse_response(FX.llm_responses(spark, sf))
    j = a.join(p, "alert_id")
    ts = F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return j.select(
        "alert_id", "timestamp", F.coalesce("p_result", F.lit("NEEDS_INVESTIGATION")).alias("triage_decision"),
        F.lit(MODEL).alias("model_used"), F.lit(TEMPLATE_VERSION).alias("prompt_template_version"),
        F.sha2(S.scrub_text("description"), 256).alias("raw_alert_sha256"), F.sha2("response_text", 256).alias("llm_raw_response_sha256"),
        F.lit("business_context").alias("rag_sources"), F.to_date(ts).alias("audit_date"),
    )


@register(
    "retention_tier",
    """WITH a AS (SELECT max(epoch_us(o_orderdate)) + 365 * 86400000000 AS t FROM orders)
SELECT o_orderkey, CASE WHEN (a.t - epoch_us(o_orderdate)) // 86400000000 <= 90 THEN 'hot'
                        WHEN (a.t - epoch_us(o_orderdate)) // 86400000000 <= 2555 THEN 'cold' ELSE 'drop' END AS tier
FROM orders, a""",
)
def q_retention(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", FX.epoch_us("o_orderdate").alias("ts_us"))
    as_of = o.agg(F.max("ts_us")).first()[0] + 365 * 86400 * _US
    return o.select("o_orderkey", X.retention_tier(F.col("ts_us"), as_of).alias("tier"))
