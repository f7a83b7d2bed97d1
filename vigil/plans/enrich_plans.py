"""Plans for business-context enrichment and deterministic triage."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vigil.operators import enrich as E
from vigil.plans import register
from vigil.plans.oracle_views import _lit, alerts_sql, with_views
from vigil.sources import fixtures as FX
from vigil.sources.context import load_context

# The business-context document (default: the bundled sample; a path in
# VIGIL_CONTEXT_PATH overrides it; a missing file gives empty sections)
CTX = load_context(os.environ.get("VIGIL_CONTEXT_PATH"))

A = with_views(alerts=alerts_sql())


# --- SQL ladders built from the same context document --------------------------------
def _sql_first(text: str, pats: list[str], out=None) -> str:
    out = out or pats
    return "CASE " + " ".join(f"WHEN contains({text}, {_lit(p.lower())}) THEN {_lit(o)}" for p, o in zip(pats, out)) + " END"


def _sql_any(text: str, pats: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(p)})" for p in pats) + ")" if pats else "false"


def _sql_map(key: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items()) + " END"


_SERVERS = CTX["critical_assets"]["servers"]
_ASSETS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_lit(s['hostname'].lower())}, {_lit(s['role'])}, {_lit(s['risk_level'])}, {_lit(', '.join(s['allowed_users']))})"
    for s in _SERVERS
) + ") t(hkey, asset_role, asset_risk_level, allowed_users)"
_ROLES = [v["user_role"] for v in CTX["vip_users"]]
_VIP_SQL = (
    "CASE WHEN affected_user IS NULL OR affected_user = '' OR "
    + _sql_any("affected_user", E.REDACTED_MARKERS)
    + " THEN NULL ELSE "
    + _sql_first("lower(affected_user)", _ROLES)
    + " END"
)
_TOOLS = [t["process"] for t in CTX["approved_admin_tools"]]
_TOOL_SQL = (
    f"CASE WHEN {_sql_any('lower(description)', E.TOOL_GATE)} THEN "
    + _sql_first(
        "list_filter(string_split_regex(lower(description), '\\s+'), lambda w: "
        + _sql_any("w", [t.lower() for t in _TOOLS])
        + ")[1]",
        _TOOLS,
    )
    + " END"
)
_FP = CTX["known_false_positives"]
_FP_SQL = _sql_first("lower(coalesce(description, ''))", [p["pattern"] for p in _FP])
_RISK_TEXT = "lower(coalesce(description, '')) || ' ' || lower(array_to_string(iocs, ' '))"
_RISK_SQL = "CAST(greatest(1.0, " + ", ".join(
    f"CASE WHEN contains({_RISK_TEXT}, {_lit(p['indicator'].lower())}) THEN {float(p['severity_multiplier'])} ELSE 1.0 END"
    for p in CTX["high_risk_patterns"]
) + ") AS DOUBLE)"
_IDOR_COND = "contains(lower(coalesce(description, '')), 'sequential') AND coalesce(distinct_resources, 0) >= 3"
_ST = "lower(concat_ws(' ', coalesce(affected_user, ''), coalesce(description, '')))"
_QA = CTX["qa_infrastructure"]
_QA_SQL = (
    "CASE "
    + " ".join(f"WHEN contains({_ST}, {_lit(p.lower())}) THEN {_lit(E.QA_REASON_PRODUCT.format(p))}" for p in _QA["test_product_names"])
    + " "
    + " ".join(f"WHEN contains({_ST}, {_lit(p.lower())}) THEN {_lit(E.QA_REASON_DISPLAY.format(p))}" for p in _QA["test_display_names"])
    + " "
    + " ".join(f"WHEN contains({_ST}, {_lit(p.lower())}) THEN {_lit(E.QA_REASON_USER.format(p))}" for p in _QA["test_user_ids"])
    + " END"
)
_INS = CTX["insider_threat_indicators"]
_INSIDER_SQL = (
    "(("
    + _sql_any(_ST, [p.lower() for p in _INS["employee_hostnames"]])
    + " OR "
    + _sql_any(_ST, [p.lower() for p in _INS["employee_user_ids"]])
    + ") AND "
    + _sql_any(_ST, [p.lower() for p in _INS["suspicious_patterns"]])
    + ")"
)
_VERDICT_SQL = (
    f"coalesce(CASE WHEN ({_QA_SQL}) IS NOT NULL THEN 'FALSE_POSITIVE' END, CASE WHEN {_INSIDER_SQL} THEN 'INSIDER_THREAT' END, "
    f"CASE WHEN {_IDOR_COND} THEN 'CRITICAL_IDOR_ATTACK' END, 'NEEDS_INVESTIGATION')"
)


def _enriched(spark, sf):
    return E.enrich_alerts(spark, FX.alerts(spark, sf), CTX)


@register(
    "enrich_asset",
    A + f"SELECT a.alert_id, s.asset_role IS NOT NULL AS is_critical, s.asset_role, s.asset_risk_level, s.allowed_users "
    f"FROM alerts a LEFT JOIN ({_ASSETS_SQL}) s ON lower(a.affected_host) = s.hkey",
)
def q_asset(spark, sf):
    df = E.critical_asset(spark, FX.alerts(spark, sf), CTX)
    return df.select("alert_id", "is_critical", "asset_role", "asset_risk_level", F.array_join("allowed_users", ", ").alias("allowed_users"))


@register("enrich_vip", A + f"SELECT alert_id, {_VIP_SQL} AS vip_role FROM alerts")
def q_vip(spark, sf):
    return FX.alerts(spark, sf).select("alert_id", E.vip_role(F.col("affected_user"), CTX).alias("vip_role"))


@register("enrich_tool", A + f"SELECT alert_id, {_TOOL_SQL} AS approved_tool FROM alerts")
def q_tool(spark, sf):
    return FX.alerts(spark, sf).select("alert_id", E.approved_tool(F.col("description"), CTX).alias("approved_tool"))


@register(
    "enrich_known_fp",
    A + f"SELECT alert_id, kp AS known_fp_pattern, {_sql_map('kp', {p['pattern']: p['reason'] for p in _FP})} AS reason "
    f"FROM (SELECT alert_id, {_FP_SQL} AS kp FROM alerts)",
)
def q_known_fp(spark, sf):
    a = FX.alerts(spark, sf).select("alert_id", E.known_false_positive(F.col("description"), CTX).alias("known_fp_pattern"))
    return a.select("alert_id", "known_fp_pattern", E._fp_field(F.col("known_fp_pattern"), "reason", CTX).alias("reason"))


@register("enrich_risk", A + f"SELECT alert_id, {_RISK_SQL} AS risk_multiplier FROM alerts")
def q_risk(spark, sf):
    return FX.alerts(spark, sf).select("alert_id", E.risk_multiplier(F.col("description"), F.col("iocs"), CTX).alias("risk_multiplier"))


@register(
    "enrich_idor",
    A + f"""SELECT alert_id, CASE WHEN {_IDOR_COND} THEN 'sequential_enumeration' END AS pattern_type,
       CASE WHEN {_IDOR_COND} THEN distinct_resources END AS resource_count,
       CASE WHEN {_IDOR_COND} THEN CASE WHEN distinct_resources >= 4 THEN 'high' ELSE 'medium' END END AS idor_severity,
       CASE WHEN {_IDOR_COND} THEN 'CRITICAL_IDOR_ATTACK' END AS recommended_verdict FROM alerts""",
)
def q_idor(spark, sf):
    a = FX.alerts(spark, sf).select("alert_id", E.idor_hint(F.col("description"), F.col("distinct_resources"), CTX).alias("h"))
    return a.select(
        "alert_id", F.col("h.pattern_type").alias("pattern_type"), F.col("h.resource_count").alias("resource_count"),
        F.col("h.severity").alias("idor_severity"), F.col("h.recommended_verdict").alias("recommended_verdict"),
    )


@register("enrich_qa", A + f"SELECT alert_id, {_QA_SQL} AS qa_reason FROM alerts")
def q_qa(spark, sf):
    a = FX.alerts(spark, sf)
    st = E.search_text({"affected_user": F.col("affected_user"), "description": F.col("description")})
    return a.select("alert_id", E.qa_reason(st, CTX).alias("qa_reason"))


@register("enrich_insider", A + f"SELECT alert_id, {_INSIDER_SQL} AS insider FROM alerts")
def q_insider(spark, sf):
    a = FX.alerts(spark, sf)
    st = E.search_text({"affected_user": F.col("affected_user"), "description": F.col("description")})
    return a.select("alert_id", E.insider_flag(st, CTX).alias("insider"))


@register(
    "enrich_alert",
    A
    + f"""SELECT a.alert_id, s.asset_role IS NOT NULL AS is_critical, {_VIP_SQL} AS vip_role, {_TOOL_SQL} AS approved_tool,
       {_FP_SQL} AS known_fp_pattern, {_RISK_SQL} AS risk_multiplier,
       CASE WHEN {_IDOR_COND} THEN 'sequential_enumeration' END AS idor_pattern,
       {_QA_SQL} AS qa_reason, {_INSIDER_SQL} AS insider,
       {CTX['compliance_requirements']['data_retention_days']} AS retention_days
FROM alerts a LEFT JOIN ({_ASSETS_SQL}) s ON lower(a.affected_host) = s.hkey""",
)
def q_enrich_alert(spark, sf):
    e = _enriched(spark, sf)
    return e.select(
        "alert_id", "is_critical", "vip_role", "approved_tool", "known_fp_pattern", "risk_multiplier",
        F.col("idor.pattern_type").alias("idor_pattern"), "qa_reason", "insider",
        F.col("compliance.data_retention_days").alias("retention_days"),
    )


@register("risk_adjust", A + f"SELECT alert_id, least(100, CAST(floor(50 * {_RISK_SQL}) AS INTEGER)) AS risk_score FROM alerts")
def q_risk_adjust(spark, sf):
    a = FX.alerts(spark, sf)
    return a.select("alert_id", E.adjusted_risk(None, E.risk_multiplier(F.col("description"), F.col("iocs"), CTX)).alias("risk_score"))


@register("triage_verdict", A + f"SELECT alert_id, {_VERDICT_SQL} AS verdict FROM alerts")
def q_verdict(spark, sf):
    e = _enriched(spark, sf)
    return e.select("alert_id", E.recommended_verdict(e).alias("verdict"))


def _context_text_sql() -> str:
    def tpl(cond, *parts):
        return f"CASE WHEN {cond} THEN " + " || chr(10) || ".join(parts) + " END"

    roles = {v["user_role"]: v for v in CTX["vip_users"]}
    tools = {t["process"]: t for t in CTX["approved_admin_tools"]}
    fps = {p["pattern"]: p for p in _FP}
    asset = tpl("s.asset_role IS NOT NULL", "'- **Critical Asset Involved**: ' || s.asset_role || ' (Risk Level: ' || s.asset_risk_level || ')'",
                "'  - Allowed users: ' || s.allowed_users")
    vip = tpl("vr IS NOT NULL", "'- **Privileged User**: ' || " + _sql_map("vr", {k: v["justification"] for k, v in roles.items()}),
              "'  - Approved privileges: ' || " + _sql_map("vr", {k: ", ".join(v["privileges"]) for k, v in roles.items()}))
    tool = tpl("tl IS NOT NULL", "'- **Approved Admin Tool**: ' || " + _sql_map("tl", {k: v["risk_notes"] for k, v in tools.items()}),
               "'  - Allowed contexts: ' || " + _sql_map("tl", {k: ", ".join(v["allowed_contexts"]) for k, v in tools.items()}))
    fp = tpl("kp IS NOT NULL", "'- **Known False Positive Pattern**: ' || " + _sql_map("kp", {k: v["reason"] for k, v in fps.items()}),
             "'  - Recommended action: ' || " + _sql_map("kp", {k: v["recommended_action"] for k, v in fps.items()}),
             "'  - Last reviewed: ' || " + _sql_map("kp", {k: v["last_reviewed"] for k, v in fps.items()}))
    risk = tpl("rm > 1.0", "'- **Risk Multiplier**: ' || printf('%.1f', rm) || 'x (high-risk indicators present)'")
    idor = tpl(_IDOR_COND, "''", "'**⚠️ IDOR ATTACK PATTERN DETECTED ⚠️**'",
               "'- Pattern: sequential_enumeration (' || distinct_resources || ' resources)'",
               "'- Severity: ' || CASE WHEN distinct_resources >= 4 THEN 'HIGH' ELSE 'MEDIUM' END",
               "'- **STRONG RECOMMENDATION: Classify as CRITICAL_IDOR_ATTACK**'", "'- This matches known IDOR exploitation techniques'")
    qa = tpl("qr IS NOT NULL", "''", "'**✓ QA Testing Activity Detected**'", "'- ' || qr",
             "'- **STRONG RECOMMENDATION: Classify as FALSE_POSITIVE**'", "'- This is legitimate automated testing, not a real attack'")
    ins = tpl("ins", "''", "'**⚠️ INSIDER THREAT INDICATORS ⚠️**'", _lit(f"- {E.INSIDER_REASON}"),
              "'- **STRONG RECOMMENDATION: Classify as INSIDER_THREAT**'", _lit(f"- Immediate actions: {', '.join(E.INSIDER_ACTIONS[:2])}"))
    return (
        A
        + f"""SELECT alert_id, concat_ws(chr(10), '### Business Context', {asset}, {vip}, {tool}, {fp}, {risk}, {idor}, {qa}, {ins}) AS context_text
FROM (SELECT a.*, s.*, {_VIP_SQL} AS vr, {_TOOL_SQL} AS tl, {_FP_SQL} AS kp, {_RISK_SQL} AS rm, {_QA_SQL} AS qr, {_INSIDER_SQL} AS ins
      FROM alerts a LEFT JOIN ({_ASSETS_SQL}) s ON lower(a.affected_host) = s.hkey) s"""
    )


@register("context_text", _context_text_sql())
def q_context_text(spark, sf):
    e = _enriched(spark, sf)
    return e.select("alert_id", E.context_text(e, CTX).alias("context_text"))
