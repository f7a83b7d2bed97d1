"""Plans for triage input/output."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scrub as S
from vigil.operators import triage as T
from vigil.plans import register
from vigil.plans.oracle_views import _lit, alerts_sql, llm_responses_sql, raw_alerts_sql, with_views
from vigil.sources import fixtures as FX
from vigil.sources.tables import table

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _first_sql(tag: str) -> str:
    p = _lit(f"(?s)<{tag}>(.*?)</{tag}>")
    return f"CASE WHEN regexp_matches(response_text, {p}) THEN {_strip(f'regexp_extract(response_text, {p}, 1)')} END"


def _all_sql(tag: str) -> str:
    p = _lit(f"(?s)<{tag}>(.*?)</{tag}>")
    return f"list_transform(regexp_extract_all(response_text, {p}, 1), lambda x: {_strip('x')})"


PARSED = with_views(
    r=llm_responses_sql(),
    p=f"""SELECT alert_id, response_text, {_first_sql('result')} AS p_result, {_first_sql('confidence')} AS p_conf_text,
                 TRY_CAST({_first_sql('confidence')} AS DOUBLE) AS p_confidence, {_first_sql('reasoning')} AS p_reasoning,
                 {_all_sql('action')} AS p_actions, {_all_sql('ioc')} AS p_iocs FROM r""",
    v=f"""SELECT *, coalesce(p_result, 'NEEDS_INVESTIGATION') AS triage_result,
                 CASE WHEN p_conf_text IS NULL THEN 0.0 ELSE p_confidence END AS confidence,
                 {_strip('coalesce(p_reasoning, response_text)')} AS reasoning,
                 list_filter(p_actions, lambda a: a <> '') AS next_actions, list_filter(p_iocs, lambda a: a <> '') AS iocs_clean
          FROM p""",
    e=f"""SELECT *, list_filter([
              CASE WHEN triage_result NOT IN ({', '.join(_lit(x) for x in T.TRIAGE_RESULTS)}) THEN 'Invalid triage_result: ' || triage_result END,
              CASE WHEN confidence IS NULL THEN {_lit(T.ERR_CONF_PARSE)} END,
              CASE WHEN confidence < 0 OR confidence > 1 THEN 'Confidence must be between 0 and 1, got ' || CAST(confidence AS VARCHAR) END,
              CASE WHEN length(reasoning) < 10 THEN {_lit(T.ERR_REASONING)} END,
              CASE WHEN len(p_actions) = 0 THEN {_lit(T.ERR_NO_ACTIONS)} WHEN len(next_actions) = 0 THEN {_lit(T.ERR_BLANK_ACTIONS)} END],
              lambda x: x IS NOT NULL) AS errors FROM v""",
)


def _validated(spark, sf):
    r = FX.llm_responses(spark, sf)
    return T.validate_response(T.parse_response(r))


@register(
    "response_parse",
    PARSED + "SELECT alert_id, p_result, p_confidence, p_reasoning, array_to_string(p_actions, '|') AS p_actions, "
    "array_to_string(p_iocs, '|') AS p_iocs FROM p",
)
def q_parse(spark, sf):
    p = T.parse_response(FX.llm_responses(spark, sf))
    return p.select("alert_id", "p_result", "p_confidence", "p_reasoning",
                    F.array_join("p_actions", "|").alias("p_actions"), F.array_join("p_iocs", "|").alias("p_iocs"))


@register(
    "response_validate",
    PARSED + "SELECT alert_id, triage_result, confidence, reasoning, array_to_string(next_actions, '|') AS next_actions, "
    "array_to_string(iocs_clean, '|') AS iocs, len(errors) = 0 AS is_valid, array_to_string(errors, '|') AS errors FROM e",
)
def q_validate(spark, sf):
    v = _validated(spark, sf)
    return v.select("alert_id", "triage_result", "confidence", "reasoning", F.array_join("next_actions", "|").alias("next_actions"),
                    F.array_join("iocs_clean", "|").alias("iocs"), "is_valid", F.array_join("errors", "|").alias("errors"))


@register(
    "triage_result_record",
    PARSED + "SELECT len(errors) = 0 AS success, alert_id, triage_result AS result, confidence, false AS case_created, "
    "errors[1] AS error FROM e",
)
def q_record(spark, sf):
    v = _validated(spark, sf)
    return v.select(F.col("is_valid").alias("success"), "alert_id", F.col("triage_result").alias("result"), "confidence",
                    F.lit(False).alias("case_created"), F.try_element_at("errors", F.lit(1)).alias("error"))


@register(
    "disposition_route",
    PARSED + "SELECT alert_id, triage_result, CASE triage_result "
    + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in T.PLAYBOOKS.items())
    + " END AS playbook FROM e WHERE len(errors) = 0",
)
def q_disposition(spark, sf):
    valid, _ = T.quarantine_split(_validated(spark, sf))
    return valid.select("alert_id", "triage_result", T.disposition_playbook(F.col("triage_result")).alias("playbook"))


@register(
    "alert_validate",
    with_views(ra=raw_alerts_sql())
    + "SELECT alert_id, len(errs) = 0 AS is_valid, array_to_string(errs, '|') AS errors FROM (SELECT alert_id, list_filter(["
    + ", ".join(f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'missing {c}' END" for c in T.ALERT_REQUIRED)
    + ", CASE WHEN severity IS NOT NULL AND severity NOT IN ('LOW','MEDIUM','HIGH','CRITICAL') THEN 'invalid severity' END"
    + ", CASE WHEN timestamp IS NOT NULL AND try_strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ') IS NULL THEN 'invalid timestamp' END"
    + "], lambda x: x IS NOT NULL) AS errs FROM ra)",
)
def q_alert_validate(spark, sf):
    v = T.validate_alerts(FX.raw_alerts(spark, sf))
    return v.select("alert_id", "is_valid", F.array_join("errors", "|").alias("errors"))


@register(
    "prompt_boundary",
    with_views(alerts=alerts_sql())
    + "SELECT alert_id, ("
    + " OR ".join(f"contains(lower(coalesce(description, '')), {_lit(p)})" for p in T.INJECTION_PHRASES)
    + ") AS injection_flag, NOT contains(replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</alert>') "
    "AS boundary_intact FROM alerts",
)
def q_boundary(spark, sf):
    a = FX.alerts(spark, sf)
    return a.select("alert_id", T.injection_flag(F.col("description")).alias("injection_flag"),
                    (F.instr(T.escape_markup(F.col("description")), "</alert>") == 0).alias("boundary_intact"))


@register("prompt_render")
def q_prompt(spark, sf):
    """H1: prompt column per alert (scrubbed alert JSON + business-context text)."""
    from vigil.operators import enrich as E

    e = E.enrich_alerts(spark, FX.alerts(spark, sf))
    doc = F.to_json(F.struct(*[S.scrub_text(c).alias(c) for c in ("alert_id", "severity", "source", "title", "description", "timestamp")]))
    return e.select("alert_id", T.render_prompt(doc, E.context_text(e)).alias("prompt"))


_SLA_CASE = "CASE upper(severity) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.SLA_SECONDS.items()) + " END"


@register(
    "sla_due",
    with_views(alerts=alerts_sql())
    + f"""SELECT alert_id, severity, ts_us + CAST({_SLA_CASE} AS BIGINT) * 1000000 AS due_us, triaged_us,
       triaged_us > ts_us + CAST({_SLA_CASE} AS BIGINT) * 1000000 AS breached
FROM (SELECT *, epoch_us(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')) AS ts_us,
             epoch_us(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')) + (doc_id % 300) * 60000000 AS triaged_us FROM alerts)""",
)
def q_sla(spark, sf):
    a = FX.alerts(spark, sf)
    ts = F.unix_micros(F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    triaged = ts + (F.col("doc_id") % 300) * F.lit(60_000_000)
    due = T.sla_due(F.col("severity"), ts)
    return a.select("alert_id", "severity", due.alias("due_us"), triaged.alias("triaged_us"), (triaged > due).alias("breached"))


@register(
    "tier_route",
    f"""SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_discount * 100) AS BIGINT) AS value_cents,
       CASE WHEN l_extendedprice * l_discount < {T.TIER_THRESHOLD} THEN 'fast' ELSE 'premium' END AS tier FROM lineitem""",
)
def q_tier(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    v = F.col("l_extendedprice") * F.col("l_discount")
    cents = F.floor(v * 100).cast("bigint")
    return li.select("l_orderkey", "l_linenumber", cents.alias("value_cents"), T.tier(v).alias("tier"))


_CC = [p for p in S.PATTERNS if p[0] == "CREDIT_CARD"][0][1]
_EM = [p for p in S.PATTERNS if p[0] == "EMAIL_ADDRESS"][0][1]


@register(
    "regulatory_flags",
    with_views(alerts=alerts_sql())
    + f"""SELECT alert_id, array_to_string(list_filter([
        CASE WHEN regexp_matches(coalesce(description, ''), {_lit(_CC)}) THEN 'PCI_SCOPE' END,
        CASE WHEN regexp_matches(coalesce(description, ''), {_lit(_EM)}) THEN 'GDPR_SCOPE' END,
        CASE WHEN lower(affected_host) IN ('ledger-pg-2.lan', 'edge-proxy-1.lan', 'recon-batch-3.lan')
             THEN 'CRITICAL_ASSET' END], lambda x: x IS NOT NULL), ',') AS regulatory_flags FROM alerts""",
)
def q_flags(spark, sf):
    from vigil.sources.context import DEFAULT_CONTEXT

    hosts = [s["hostname"].lower() for s in DEFAULT_CONTEXT["critical_assets"]["servers"]]
    a = FX.alerts(spark, sf)
    d = F.coalesce(F.col("description"), F.lit(""))
    flags = F.array(
        F.when(d.rlike(_CC), F.lit("PCI_SCOPE")),
        F.when(d.rlike(_EM), F.lit("GDPR_SCOPE")),
        F.when(F.lower("affected_host").isin(*hosts), F.lit("CRITICAL_ASSET")),
    )
    return a.select("alert_id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("regulatory_flags"))
