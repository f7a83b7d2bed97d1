"""Business-context enrichment (G1–G10, G18) and deterministic verdicts (H5–H6).

Pattern lists (tens of entries, bounded by configuration) become literal
arrays inside the plan, so every substring "theta join" is a per-row
expression (``exists`` / ``filter`` over the literal array): no shuffle of
the alert side and no nested-loop join. The asset lookup is an equi-join
against a broadcast dimension.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.context import DEFAULT_CONTEXT, dimension

# Fixed values that must equal the reference's results: verdict labels,
# recommendation texts and the business-context text templates.
V_CRITICAL = "CRITICAL_IDOR_ATTACK"
V_FALSE_POSITIVE = "FALSE_POSITIVE"
V_INSIDER = "INSIDER_THREAT"
V_NEEDS_INVESTIGATION = "NEEDS_INVESTIGATION"
QA_ACTION = "close_as_expected_qa_activity"
INSIDER_REASON = "Employee accessing unauthorized customer resources"
INSIDER_ACTIONS = ["create_hr_case", "notify_security_team", "audit_access", "pull_full_audit_log"]
IDOR_PATTERN_TYPE = "sequential_enumeration"
QA_REASON_PRODUCT = "QA testing infrastructure detected: {}"
QA_REASON_DISPLAY = "QA account detected: {}"
QA_REASON_USER = "QA user ID detected: contains '{}'"
TOOL_GATE = ["powershell", "psexec"]
REDACTED_MARKERS = ["[EMAIL_REDACTED]", "[REDACTED]"]
NO_CONTEXT_TEXT = "No additional business context available."
# Business-context text block: header and per-signal line templates, in order.
CTX_HEADER = "### Business Context"
CTX_ASSET = ["- **Critical Asset Involved**: {role} (Risk Level: {risk})", "  - Allowed users: {users}"]
CTX_VIP = ["- **Privileged User**: {justification}", "  - Approved privileges: {privileges}"]
CTX_TOOL = ["- **Approved Admin Tool**: {notes}", "  - Allowed contexts: {contexts}"]
CTX_FP = ["- **Known False Positive Pattern**: {reason}", "  - Recommended action: {action}", "  - Last reviewed: {reviewed}"]
CTX_RISK = ["- **Risk Multiplier**: {m}x (high-risk indicators present)"]
CTX_IDOR = [
    "", "**⚠️ IDOR ATTACK PATTERN DETECTED ⚠️**", "- Pattern: {pattern} ({count} resources)", "- Severity: {severity}",
    "- **STRONG RECOMMENDATION: Classify as {verdict}**", "- This matches known IDOR exploitation techniques",
]
CTX_QA = [
    "", "**✓ QA Testing Activity Detected**", "- {reason}", "- **STRONG RECOMMENDATION: Classify as {verdict}**",
    "- This is legitimate automated testing, not a real attack",
]
CTX_INSIDER = [
    "", "**⚠️ INSIDER THREAT INDICATORS ⚠️**", "- {reason}", "- **STRONG RECOMMENDATION: Classify as {verdict}**",
    "- Immediate actions: {actions}",
]


def _lit_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _first_contained(text: Column, patterns: list[str], lower_patterns: bool = True) -> Column:
    """First pattern (list order) that is a substring of ``text``; NULL if none."""
    pats = [p.lower() if lower_patterns else p for p in patterns]
    out = F.lit(None).cast("string")
    for orig, p in reversed(list(zip(patterns, pats))):
        out = F.when(text.contains(p), F.lit(orig)).otherwise(out)
    return out


def _any_contained(text: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.exists(_lit_array(patterns), lambda p: F.instr(text, p) > 0)


def critical_asset(spark: SparkSession, alerts: DataFrame, ctx=DEFAULT_CONTEXT) -> DataFrame:
    """G1: case-insensitive equality on hostname (left equi-join)."""
    servers = ctx.get("critical_assets", {}).get("servers", [])
    dim = dimension(
        spark,
        [dict(s, _k=s["hostname"].lower(), _pos=i) for i, s in enumerate(servers)],
        "_k string, _pos int, role string, risk_level string, allowed_users array<string>",
    )
    # first server in list order wins when two share a lower-cased hostname
    from pyspark.sql import Window

    dim = dim.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_pos"))).filter("_r = 1")
    a = alerts.withColumn("_k", F.lower("affected_host"))
    j = a.join(dim.drop("_pos", "_r"), "_k", "left").drop("_k")
    return j.withColumn("is_critical", F.col("role").isNotNull()).withColumnRenamed("role", "asset_role").withColumnRenamed(
        "risk_level", "asset_risk_level"
    )


def vip_role(user: Column, ctx=DEFAULT_CONTEXT) -> Column:
    """First privileged role contained in the user name; redacted names never match."""
    roles = [v["user_role"] for v in ctx.get("vip_users", [])]
    lu = F.lower(user)
    redacted = _any_contained(user, REDACTED_MARKERS)
    return F.when(user.isNull() | (user == "") | redacted, F.lit(None)).otherwise(_first_contained(lu, roles))


def _role_field(role: Column, field: str, ctx=DEFAULT_CONTEXT) -> Column:
    out = F.lit(None)
    for v in ctx.get("vip_users", []):
        val = v[field]
        lit = _lit_array(val) if isinstance(val, list) else F.lit(val)
        out = F.when(role == v["user_role"], lit).otherwise(out)
    return out


def approved_tool(desc: Column, ctx=DEFAULT_CONTEXT, lowered: bool = False) -> Column:
    """Only when the description mentions powershell/psexec; the first
    whitespace-separated word that contains a tool name, then the first tool
    (list order) contained in that word."""
    tools = [t["process"] for t in ctx.get("approved_admin_tools", [])]
    if not tools:
        return F.lit(None).cast("string")
    ld = desc if lowered else F.lower(desc)
    gate = _any_contained(ld, TOOL_GATE)
    alt = "|".join(re.escape(t.lower()) for t in tools)
    word = F.regexp_extract(ld, rf"(\S*(?:{alt})\S*)", 1)
    return F.when(gate & (word != ""), _first_contained(word, tools))


def _tool_field(tool: Column, field: str, ctx=DEFAULT_CONTEXT) -> Column:
    out = F.lit(None)
    for t in ctx.get("approved_admin_tools", []):
        val = t[field]
        lit = _lit_array(val) if isinstance(val, list) else F.lit(val)
        out = F.when(tool == t["process"], lit).otherwise(out)
    return out


def known_false_positive(desc: Column, ctx=DEFAULT_CONTEXT, lowered: bool = False) -> Column:
    """First false-positive pattern contained in the description."""
    pats = [p["pattern"] for p in ctx.get("known_false_positives", [])]
    return _first_contained(desc if lowered else F.lower(F.coalesce(desc, F.lit(""))), pats)


def _fp_field(pattern: Column, field: str, ctx=DEFAULT_CONTEXT) -> Column:
    out = F.lit(None).cast("string")
    for p in ctx.get("known_false_positives", []):
        out = F.when(pattern == p["pattern"], F.lit(p[field])).otherwise(out)
    return out


def risk_text(desc: Column, iocs: Column) -> Column:
    return F.concat(F.lower(F.coalesce(desc, F.lit(""))), F.lit(" "), F.lower(F.array_join(F.coalesce(iocs, F.array()), " ")))


def risk_multiplier(desc: Column, iocs: Column | None, ctx=DEFAULT_CONTEXT, text: Column | None = None) -> Column:
    """Max multiplier over indicators contained in ``desc + ' ' + join(iocs)``, at least 1.0."""
    text = text if text is not None else risk_text(desc, iocs)
    out = F.lit(1.0)
    for p in ctx.get("high_risk_patterns", []):
        out = F.when(text.contains(p["indicator"].lower()), F.greatest(out, F.lit(float(p["severity_multiplier"])))).otherwise(out)
    return out


def idor_hint(desc: Column, distinct: Column, ctx=DEFAULT_CONTEXT, lowered: bool = False) -> Column:
    """struct(pattern_type, resource_count, severity, recommended_verdict) or NULL."""
    thr = ctx.get("idor_detection_rules", {}).get("sequential_threshold", 3)
    d = F.coalesce(distinct, F.lit(0))
    hit = (desc if lowered else F.lower(F.coalesce(desc, F.lit("")))).contains("sequential") & (d >= thr)
    return F.when(
        hit,
        F.struct(
            F.lit(IDOR_PATTERN_TYPE).alias("pattern_type"),
            d.alias("resource_count"),
            F.when(d >= 4, "high").otherwise("medium").alias("severity"),
            F.lit(V_CRITICAL).alias("recommended_verdict"),
        ),
    )


def qa_reason(search_text: Column, ctx=DEFAULT_CONTEXT) -> Column:
    """Reason text of the first QA hit — product names, then display
    names, then user-id fragments (each list in order)."""
    qa = ctx.get("qa_infrastructure", {})
    out = F.lit(None).cast("string")
    groups = [
        (qa.get("test_product_names", []), QA_REASON_PRODUCT),
        (qa.get("test_display_names", []), QA_REASON_DISPLAY),
        (qa.get("test_user_ids", []), QA_REASON_USER),
    ]
    for pats, tmpl in reversed(groups):
        for p in reversed(pats):
            out = F.when(search_text.contains(p.lower()), F.lit(tmpl.format(p))).otherwise(out)
    return out


def insider_flag(search_text: Column, ctx=DEFAULT_CONTEXT, fold_case: bool = True) -> Column:
    """(employee host pattern OR employee user pattern) AND a suspicious phrase.
    ``fold_case`` lower-cases the patterns too (an upper-case host pattern could
    otherwise never match the lower-cased text)."""
    ins = ctx.get("insider_threat_indicators", {})

    def norm(ps):
        return [p.lower() for p in ps] if fold_case else list(ps)

    employee = _any_contained(search_text, norm(ins.get("employee_hostnames", []))) | _any_contained(
        search_text, norm(ins.get("employee_user_ids", []))
    )
    suspicious = _any_contained(search_text, norm(ins.get("suspicious_patterns", [])))
    return employee & suspicious


def search_text(df_cols: dict[str, Column]) -> Column:
    """``lower(affected_user + ' ' + description [+ sample UDM fields])``."""
    parts = [F.coalesce(df_cols["affected_user"], F.lit("")), F.coalesce(df_cols["description"], F.lit(""))]
    extra = df_cols.get("udm_text")
    txt = F.concat_ws(" ", *parts)
    if extra is not None:
        txt = F.concat(txt, extra)
    return F.lower(txt)


def enrich_alerts(spark: SparkSession, alerts: DataFrame, ctx=DEFAULT_CONTEXT, fold_case: bool = True) -> DataFrame:
    """Every business-context signal as columns (+ a compliance struct)."""
    df = critical_asset(spark, alerts, ctx)
    st = search_text({"affected_user": F.col("affected_user"), "description": F.col("description"),
                      "udm_text": F.col("udm_text") if "udm_text" in alerts.columns else None})
    # lower-case each long text once; every pattern test reads these columns
    df = df.select("*", F.lower(F.coalesce(F.col("description"), F.lit(""))).alias("_ld"), st.alias("_st"),
                   risk_text(F.col("description"), F.col("iocs")).alias("_rt"))
    ld = F.col("_ld")
    df = df.select(
        "*",
        vip_role(F.col("affected_user"), ctx).alias("vip_role"),
        approved_tool(ld, ctx, lowered=True).alias("approved_tool"),
        known_false_positive(ld, ctx, lowered=True).alias("known_fp_pattern"),
        risk_multiplier(None, None, ctx, text=F.col("_rt")).alias("risk_multiplier"),
        idor_hint(ld, F.col("distinct_resources"), ctx, lowered=True).alias("idor"),
        qa_reason(F.col("_st"), ctx).alias("qa_reason"),
        insider_flag(F.col("_st"), ctx, fold_case).alias("insider"),
    ).drop("_ld", "_st", "_rt")
    comp = ctx.get("compliance_requirements", {})
    sla = comp.get("escalation_sla", {})
    return df.withColumn(
        "compliance",
        F.struct(
            F.lit(comp.get("data_retention_days")).alias("data_retention_days"),
            F.lit(comp.get("pii_handling")).alias("pii_handling"),
            F.lit(comp.get("audit_trail")).alias("audit_trail"),
            F.create_map(*[x for k, v in sla.items() for x in (F.lit(k), F.lit(v))]).alias("escalation_sla"),
        ),
    )


def recommended_verdict(df: DataFrame) -> Column:
    """H6: QA > insider > IDOR recommendation, else NEEDS_INVESTIGATION."""
    return F.coalesce(
        F.when(F.col("qa_reason").isNotNull(), F.lit(V_FALSE_POSITIVE)),
        F.when(F.col("insider"), F.lit(V_INSIDER)),
        F.col("idor.recommended_verdict"),
        F.lit(V_NEEDS_INVESTIGATION),
    )


def adjusted_risk(base: Column | None, multiplier: Column) -> Column:
    """H5: ``min(100, int(base × multiplier))``, base default 50, multiplier default 1.0."""
    b = F.coalesce(base, F.lit(50)) if base is not None else F.lit(50)
    return F.least(F.lit(100), F.floor(b * F.coalesce(multiplier, F.lit(1.0))).cast("int"))


def _fmt_num(x: Column) -> Column:
    """Python ``str(float)`` for the multipliers we produce (e.g. 2.5, 3.0)."""
    return F.when(x == F.floor(x), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def context_text(df: DataFrame, ctx=DEFAULT_CONTEXT) -> Column:
    """The business-context block, one group of lines per present signal."""
    from vigil.functions.text import fmt

    def block(cond: Column, lines: list[str], **cols: Column) -> Column:
        return F.when(cond, F.concat_ws("\n", *[fmt(line, **cols) for line in lines]))

    role, tool, fp = F.col("vip_role"), F.col("approved_tool"), F.col("known_fp_pattern")
    parts = [
        F.lit(CTX_HEADER),
        block(F.col("is_critical"), CTX_ASSET, role=F.col("asset_role"), risk=F.col("asset_risk_level"),
              users=F.array_join("allowed_users", ", ")),
        block(role.isNotNull(), CTX_VIP, justification=_role_field(role, "justification", ctx),
              privileges=F.array_join(_role_field(role, "privileges", ctx), ", ")),
        block(tool.isNotNull(), CTX_TOOL, notes=_tool_field(tool, "risk_notes", ctx),
              contexts=F.array_join(_tool_field(tool, "allowed_contexts", ctx), ", ")),
        block(fp.isNotNull(), CTX_FP, reason=_fp_field(fp, "reason", ctx), action=_fp_field(fp, "recommended_action", ctx),
              reviewed=_fp_field(fp, "last_reviewed", ctx)),
        block(F.col("risk_multiplier") > 1.0, CTX_RISK, m=_fmt_num(F.col("risk_multiplier"))),
        block(F.col("idor").isNotNull(), CTX_IDOR, pattern=F.col("idor.pattern_type"), count=F.col("idor.resource_count"),
              severity=F.upper(F.col("idor.severity")), verdict=F.col("idor.recommended_verdict")),
        block(F.col("qa_reason").isNotNull(), CTX_QA, reason=F.col("qa_reason"), verdict=F.lit(V_FALSE_POSITIVE)),
        block(F.col("insider"), CTX_INSIDER, reason=F.lit(INSIDER_REASON), verdict=F.lit(V_INSIDER),
              actions=F.lit(", ".join(INSIDER_ACTIONS[:2]))),
    ]
    return F.concat_ws("\n", *parts)
