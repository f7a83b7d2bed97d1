"""Plans for case, SOAR and annotation outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import cases as K
from vigil.plans import register
from vigil.plans.detection_plans import THRESHOLD, GAP, W_US, _window_sql
from vigil.plans.oracle_views import _lit, scrub_sql, with_views
from vigil.plans.rules_plans import events_df
from vigil.sources.tables import table

NL = "chr(10)"

EVX = _window_sql(W_US, THRESHOLD, GAP).rstrip() + """,
evx AS (
  SELECT 'idor_evt_' || substr(sha256(l.session_id || ':' || l.ts_us || ':' || l.event_id), 1, 16) AS event_id,
         l.ts_us AS detection_ts_us, l.user_id, l.session_id, l.severity, l.d AS distinct_resources_accessed, l.is_sequential,
         (l.last_us - l.first_us) // 1000000 AS time_window_seconds, l.failed_resources, l.resource_owners, l.win_count, l.pairs,
         a.client_ip, a.user_agent, a.request_path, a.user_email,
         CASE WHEN NOT l.is_sequential AND l.d >= 3 THEN 'TA0009,TA0006' ELSE 'TA0009' END AS mitre_tactics,
         CASE WHEN NOT l.is_sequential AND l.d >= 3 THEN 'T1213,T1078.004' ELSE 'T1213' END AS mitre_techniques
  FROM laddered l JOIN access_log a ON a.event_id = l.event_id WHERE l.has_event)
"""

_SOAR_SEV = "CASE severity WHEN 'CRITICAL_IDOR_ATTACK' THEN 'critical' WHEN 'ALERT_MEDIUM' THEN 'high' WHEN 'ALERT_LOW' THEN 'medium' ELSE 'high' END"
_DESC = f"""concat_ws({NL},
    'IDOR enumeration attack detected against user ' || user_id || '.', '', 'Attack Pattern:',
    '- Accessed ' || distinct_resources_accessed || ' distinct resources owned by other users',
    '- Sequential access: ' || CASE WHEN is_sequential THEN 'YES (high confidence)' ELSE 'NO' END,
    '- Time window: ' || time_window_seconds || ' seconds', '- Session: ' || session_id, '', 'Failed Resources:',
    CASE WHEN len(pairs) > 0 THEN array_to_string(list_transform(pairs[1:5], lambda p: '  - ' || p.r || ' (owner: ' || p.o || ')'), {NL}) END,
    CASE WHEN win_count > 5 THEN '  ... and ' || (win_count - 5) || ' more' END,
    '', 'Evidence:', '- Request path: ' || coalesce(request_path, 'None'),
    '- Client IP: ' || coalesce(nullif(client_ip, ''), 'unknown'), '- User Agent: ' || coalesce(nullif(user_agent, ''), 'unknown'))"""
_URLS = "array_to_string(list_transform(string_split(mitre_techniques, ','), lambda t: 'https://attack.mitre.org/techniques/' || replace(t, '.', '/') || '/'), '|')"
_ISO = ("strftime(make_timestamp(detection_ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN detection_ts_us % 1000000 = 0 THEN '' "
        "ELSE '.' || lpad(CAST(detection_ts_us % 1000000 AS VARCHAR), 6, '0') END")


def _common(spark, sf):
    return K.common_payload(events_df(spark, sf))


@register(
    "soar_generic",
    EVX + f"""SELECT event_id, 'IDOR Attack Detected: ' || user_id AS title, {_SOAR_SEV} AS soar_severity, {_lit(K.SOURCE)} AS source,
       {_ISO} AS timestamp, user_id, session_id, distinct_resources_accessed AS distinct_resources, is_sequential, time_window_seconds,
       user_email, client_ip, request_path, severity = 'CRITICAL_IDOR_ATTACK' AS auto_hold, {_URLS} AS mitre_attack_urls FROM evx""",
)
def q_generic(spark, sf):
    c = _common(spark, sf)
    return c.select("event_id", "title", "soar_severity", "source", "timestamp", "user_id", "session_id", "distinct_resources",
                    "is_sequential", "time_window_seconds", "user_email", "client_ip", "request_path", "auto_hold",
                    F.array_join("mitre_attack_urls", "|").alias("mitre_attack_urls"))


@register("mitre_urls", EVX + f"SELECT event_id, {_URLS} AS mitre_attack_urls FROM evx")
def q_mitre_urls(spark, sf):
    ev = events_df(spark, sf)
    return ev.select("event_id", F.array_join(K.mitre_urls(F.col("mitre_techniques")), "|").alias("mitre_attack_urls"))


@register("soar_description", EVX + f"SELECT event_id, {_DESC} AS description FROM evx")
def q_description(spark, sf):
    ev = events_df(spark, sf)
    return ev.select("event_id", K.description(ev).alias("description"))


@register("soar_splunk")
def q_splunk(spark, sf):
    return K.splunk_container(_common(spark, sf)).select("event_id", F.to_json("payload").alias("payload"))


@register("soar_xsoar")
def q_xsoar(spark, sf):
    return K.xsoar_incident(_common(spark, sf)).select("event_id", F.to_json("payload").alias("payload"))


@register(
    "soar_servicenow",
    EVX + f"""SELECT 'IDOR Attack Detected: ' || user_id AS short_description, {_DESC} AS description,
       CASE {_SOAR_SEV} WHEN 'critical' THEN '1' WHEN 'high' THEN '1' WHEN 'medium' THEN '2' WHEN 'low' THEN '3' ELSE '1' END AS urgency,
       '2' AS impact, 'Security' AS category, 'Unauthorized Access' AS subcategory,
       event_id AS u_event_id, user_id AS u_user_id, session_id AS u_session_id FROM evx""",
)
def q_servicenow(spark, sf):
    return K.servicenow_incident(_common(spark, sf))


@register(
    "case_rows",
    EVX + f"""SELECT event_id AS alert_id, 'IDOR Attack Detected: ' || severity AS title,
       'Ownership-aware monitor detected IDOR enumeration attack.' || {NL} || {NL} || 'User: ' || user_id || {NL} ||
       'Session: ' || session_id || {NL} || 'Distinct Resources: ' || distinct_resources_accessed || {NL} ||
       'Time Window: ' || time_window_seconds || 's' || {NL} || {NL} ||
       'Failed Resources: ' || replace(failed_resources, ',', ', ') || {NL} || 'Resource Owners: ' || replace(resource_owners, ',', ', ') ||
       {NL} || {NL} || 'Detection Logic: ' || CASE WHEN is_sequential THEN 'Sequential' ELSE 'Non-sequential' END || ' access pattern detected.'
         AS description,
       'CRITICAL' AS severity, user_id AS affected_user,
       'Ownership-aware IDOR detection: ' || distinct_resources_accessed || ' unauthorized access attempts to other users'' resources.' AS ai_reasoning,
       CAST(CASE WHEN is_sequential THEN 0.95 ELSE 0.80 END AS DOUBLE) AS confidence_score, mitre_tactics, mitre_techniques,
       'soc_tier2' AS assigned_to, 'high' AS priority
FROM evx WHERE severity = 'CRITICAL_IDOR_ATTACK'""",
)
def q_cases(spark, sf):
    c = K.case_rows(events_df(spark, sf))
    return c.withColumn("mitre_tactics", F.array_join("mitre_tactics", ",")).withColumn("mitre_techniques", F.array_join("mitre_techniques", ","))


_ANN_TEXT = ("'IDOR Attack Detected (AI Confidence: 95%): User attempted unauthorized access to ' || distinct_resources_accessed || "
             "' resources owned by other users. Pattern: ' || CASE WHEN is_sequential THEN 'Sequential' ELSE 'Non-sequential' END || "
             "'. MITRE: ' || replace(mitre_techniques, ',', ', ') || '.'")


@register(
    "annotation_rows",
    EVX + f"""SELECT event_id, pos, pairs[pos].e AS udm_event_id, 'ai_idor_detection' AS annotation_type,
       {scrub_sql(_ANN_TEXT)} AS annotation_text, severity AS triage_result,
       CAST(CASE WHEN is_sequential THEN 0.95 ELSE 0.80 END AS DOUBLE) AS confidence, 'idor_attack,ownership_violation,automated_detection' AS tags,
       'vigil-idor-monitor' AS annotated_by
FROM (SELECT *, unnest(range(1, least(len(pairs), 5) + 1)) AS pos FROM evx)""",
)
def q_annotations(spark, sf):
    a = K.annotation_rows(events_df(spark, sf))
    return a.withColumn("pos", F.col("pos").cast("bigint")).withColumn("tags", F.array_join("tags", ","))


# Delivery responses, one JSON document per order, id under a platform-specific key.
def _responses(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    doc = (
        F.when(k % 7 == 0, F.concat(F.lit('{"id": "INC'), ks, F.lit('", "status": "new"}')))
        .when(k % 7 == 1, F.concat(F.lit('{"incident_id": '), ks, F.lit("}")))
        .when(k % 7 == 2, F.concat(F.lit('{"incidentId": "X-'), ks, F.lit('"}')))
        .when(k % 7 == 3, F.concat(F.lit('{"container_id": '), ks, F.lit(', "message": "ok"}')))
        .when(k % 7 == 4, F.concat(F.lit('{"result": {"x": 1}, "sys_id": "sn'), ks, F.lit('"}')))
        .when(k % 7 == 5, F.concat(F.lit('{"data": {"id": "d'), ks, F.lit('"}}')))
        .otherwise(F.lit('{"status": "queued"}'))
    )
    return o.select(F.col("o_orderkey").alias("delivery_id"), doc.alias("response"))


@register(
    "incident_id",
    """SELECT o_orderkey AS delivery_id, coalesce(json_extract_string(r, '$.id'), json_extract_string(r, '$.incident_id'),
       json_extract_string(r, '$.incidentId'), json_extract_string(r, '$.container_id'), json_extract_string(r, '$.sys_id'),
       json_extract_string(r, '$.incidentNumber'), json_extract_string(r, '$.data.id')) AS incident_id
FROM (SELECT o_orderkey, CASE o_orderkey % 7
        WHEN 0 THEN '{"id": "INC' || o_orderkey || '", "status": "new"}'
        WHEN 1 THEN '{"incident_id": ' || o_orderkey || '}'
        WHEN 2 THEN '{"incidentId": "X-' || o_orderkey || '"}'
        WHEN 3 THEN '{"container_id": ' || o_orderkey || ', "message": "ok"}'
        WHEN 4 THEN '{"result": {"x": 1}, "sys_id": "sn' || o_orderkey || '"}'
        WHEN 5 THEN '{"data": {"id": "d' || o_orderkey || '"}}'
        ELSE '{"status": "queued"}' END AS r FROM orders)""",
)
def q_incident_id(spark, sf):
    r = _responses(spark, sf)
    return r.select("delivery_id", K.incident_id(F.col("response")).alias("incident_id"))


@register(
    "delivery_attempts",
    """SELECT o_orderkey AS delivery_id, a AS attempt,
       CASE WHEN o_orderstatus <> 'F' AND a = 1 + o_orderkey % 5 THEN 'delivered' ELSE 'failed' END AS outcome,
       CASE WHEN a > 1 THEN CAST(pow(2, a - 2) AS INTEGER) ELSE 0 END AS backoff_before_s, a > 3 AS over_limit
FROM (SELECT *, unnest(range(1, o_orderkey % 5 + 2)) AS a FROM orders)""",
)
def q_delivery(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    d = o.select(F.col("o_orderkey").alias("delivery_id"), (F.lit(1) + F.col("o_orderkey") % 5).alias("attempts"),
                 (F.col("o_orderstatus") != "F").alias("success"))
    return K.delivery_attempts(d).withColumn("attempt", F.col("attempt").cast("bigint"))


@register(
    "incident_template",
    EVX + """SELECT event_id, 'IDOR Attack: ' || user_id || ' - ' || distinct_resources_accessed || ' resources' AS sn_short_description,
       'IDOR Enumeration Attack - ' || user_id AS xsoar_name,
       'MITRE_Tactic:TA0009|MITRE_Technique:T1213.002|User:' || user_id || '|Session:' || session_id AS labels
FROM evx WHERE severity = 'CRITICAL_IDOR_ATTACK'""",
)
def q_templates(spark, sf):
    t = K.incident_templates(events_df(spark, sf))
    return t.select("event_id", "sn_short_description", "xsoar_name",
                    F.array_join(F.transform("labels", lambda l: F.concat(l["type"], F.lit(":"), l["value"])), "|").alias("labels"))
