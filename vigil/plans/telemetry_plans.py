"""Plans for request telemetry, URL patterns and projections (B*, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import telemetry as T
from vigil.operators import telemetry as OT
from vigil.operators.detection import own_resource
from vigil.plans import register
from vigil.plans.oracle_views import _lit, access_log_sql, alerts_sql, http_requests_sql, url_resource_sql, with_views
from vigil.sources import fixtures as FX
from vigil.sources.tables import table

REQ = with_views(req=http_requests_sql())
# Custom pattern for page URLs (``/<lang>/<n>``), appended after the built-ins.
PAGE_PATTERN = ("document", r"/[a-z]{2}/(\d+)")

_TYPE_SQL, _ID_SQL = url_resource_sql("path")
_SESSION_SQL = "coalesce(nullif(h_x_datadog_session_id, ''), nullif(h_cf_ray, ''))"
_CLIENT_IP_SQL = "CASE WHEN nullif(h_x_forwarded_for, '') IS NOT NULL THEN trim(split_part(h_x_forwarded_for, ',', 1)) ELSE client_host END"


@register(
    "telemetry_extract",
    REQ
    + f"""SELECT request_id, coalesce(nullif(h_x_user_id, ''), 'unknown') AS user_id, nullif(h_x_user_email, '') AS user_email,
       nullif(h_x_datadog_session_id, '') AS datadog_session_id, nullif(h_x_datadog_view_id, '') AS datadog_view_id,
       nullif(h_x_datadog_application_id, '') AS datadog_application_id, nullif(h_cf_ray, '') AS cf_ray_id,
       nullif(h_x_pageload_id, '') AS cf_pageload_id, nullif(h_user_agent, '') AS user_agent,
       {_CLIENT_IP_SQL} AS client_ip,
       coalesce({_TYPE_SQL}, 'other') AS resource_type, coalesce({_ID_SQL}, 'unknown') AS resource_id,
       method AS http_method, path AS request_path, {_SESSION_SQL} AS session_id
FROM req""",
)
def q_telemetry(spark, sf):
    t = OT.extract_telemetry(FX.http_requests(spark, sf))
    return t.select(
        "request_id", "user_id", "user_email", "datadog_session_id", "datadog_view_id", "datadog_application_id",
        "cf_ray_id", "cf_pageload_id", "user_agent", "client_ip", "resource_type", "resource_id",
        F.col("method").alias("http_method"), F.col("path").alias("request_path"), "session_id",
    )


@register("url_resource", REQ + f"SELECT request_id, path, {_TYPE_SQL} AS resource_type, {_ID_SQL} AS resource_id FROM req")
def q_url_resource(spark, sf):
    r = FX.http_requests(spark, sf)
    t, i = T.url_resource(F.col("path"))
    return r.select("request_id", "path", t.alias("resource_type"), i.alias("resource_id"))


_PT, _PI = url_resource_sql("url", [PAGE_PATTERN])


@register("url_resource_custom", f"SELECT page_id, {_PT} AS resource_type, {_PI} AS resource_id FROM pages")
def q_url_custom(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    t, i = T.url_resource(F.col("url"), [PAGE_PATTERN])
    return p.select("page_id", t.alias("resource_type"), i.alias("resource_id"))


@register("client_ip", REQ + f"SELECT request_id, {_CLIENT_IP_SQL} AS client_ip FROM req")
def q_client_ip(spark, sf):
    r = FX.http_requests(spark, sf)
    return r.select("request_id", T.client_ip(T.lower_keys(F.col("headers")), F.col("client_host")).alias("client_ip"))


@register(
    "telemetry_validate",
    REQ
    + f"""SELECT request_id, len(issues) = 0 AS is_valid, array_to_string(issues, '|') AS issues FROM (
  SELECT request_id, list_filter([
      CASE WHEN coalesce(nullif(h_x_user_id, ''), 'unknown') = 'unknown' THEN {_lit(T.ISSUE_USER)} END,
      CASE WHEN {_SESSION_SQL} IS NULL THEN {_lit(T.ISSUE_SESSION)} END,
      CASE WHEN coalesce({_ID_SQL}, 'unknown') = 'unknown' THEN {_lit(T.ISSUE_RESOURCE)} END,
      CASE WHEN coalesce({_TYPE_SQL}, 'other') = 'other' THEN {_lit(T.ISSUE_TYPE)} END], lambda x: x IS NOT NULL) AS issues
  FROM req)""",
)
def q_validate(spark, sf):
    v = OT.validate_telemetry(OT.extract_telemetry(FX.http_requests(spark, sf)))
    return v.select("request_id", "is_valid", F.array_join("issues", "|").alias("issues"))


@register("session_id", REQ + f"SELECT request_id, {_SESSION_SQL} AS session_id FROM req")
def q_session_id(spark, sf):
    r = FX.http_requests(spark, sf)
    h = T.lower_keys(F.col("headers"))
    return r.select("request_id", T.session_identifier(T.header(h, T.H_DD_SESSION), T.header(h, T.H_CF_RAY)).alias("session_id"))


@register(
    "own_resource",
    with_views(access_log=access_log_sql()) + "SELECT event_id, user_id = resource_owner_id AS is_own FROM access_log",
)
def q_own(spark, sf):
    return own_resource(FX.access_log(spark, sf)).select("event_id", "is_own")


@register(
    "session_from_headers",
    REQ
    + f"""SELECT request_id, coalesce(
        nullif(regexp_extract(coalesce(nullif(h_cookie, ''), ''), {_lit(T.COOKIE_SESSION)}, 1), ''),
        nullif(h_x_acme_id, ''), nullif(h_x_datadog_session_id, ''),
        nullif(regexp_extract(coalesce(nullif(h_authorization, ''), ''), {_lit(T.BEARER_TOKEN)}, 1), '')) AS session_id
FROM req""",
)
def q_session_headers(spark, sf):
    r = FX.http_requests(spark, sf)
    return r.select("request_id", T.session_from_headers(T.lower_keys(F.col("headers"))).alias("session_id"))


@register(
    "url_rule_match",
    REQ + "SELECT request_id, " + ", ".join(f"regexp_matches(path, {_lit(p)}) AS {n}" for n, p in T.URL_RULES.items()) + " FROM req",
)
def q_url_rules(spark, sf):
    r = FX.http_requests(spark, sf)
    return r.select("request_id", *[F.col("path").rlike(p).alias(n) for n, p in T.URL_RULES.items()])


def _ioc_sql(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, {_lit(T.IP_RE)}) THEN 'ip' WHEN regexp_matches({x}, {_lit(T.DOMAIN_RE)}) THEN 'domain' "
        f"WHEN length({x}) IN (32, 40, 64) AND regexp_matches({x}, {_lit(T.HEX_RE)}) THEN 'hash' "
        f"WHEN starts_with({x}, 'http') THEN 'url' ELSE 'hash' END"
    )


@register(
    "ioc_type",
    with_views(alerts=alerts_sql())
    + f"SELECT alert_id, pos, ioc, {_ioc_sql('ioc')} AS ioc_type FROM (SELECT alert_id, unnest(iocs) AS ioc, "
    "unnest(range(1, len(iocs) + 1)) AS pos FROM alerts)",
)
def q_ioc_type(spark, sf):
    a = FX.alerts(spark, sf).select("alert_id", F.posexplode("iocs").alias("p0", "ioc"))
    return a.select("alert_id", (F.col("p0") + 1).cast("bigint").alias("pos"), "ioc", T.ioc_type(F.col("ioc")).alias("ioc_type"))


def _sev_sql(col: str, mapping: dict, default) -> str:
    def v(x):
        return _lit(x) if isinstance(x, str) else str(x)

    return "CASE " + " ".join(f"WHEN {col} = {_lit(k)} THEN {v(x)}" for k, x in mapping.items()) + f" ELSE {v(default)} END"


def _severity_map_sql() -> str:
    from vigil.plans.detection_plans import _BASE

    soar = _sev_sql("severity", T.SOAR_SEVERITY, "high")
    return (
        _BASE
        + f"SELECT event_id, result, soar, {_sev_sql('soar', T.XSOAR_SEVERITY, 3)} AS xsoar, "
        + f"{_sev_sql('soar', T.SERVICENOW_URGENCY, '1')} AS urgency "
        + f"FROM (SELECT event_id, severity AS result, {soar} AS soar FROM laddered)"
    )


@register("severity_map", _severity_map_sql())
def q_severity_map(spark, sf):
    from vigil.plans.detection_plans import _analyzed

    res = _analyzed(spark, sf).select("event_id", F.col("severity").alias("result"))
    s = T.soar_severity(F.col("result"))
    return res.select("event_id", "result", s.alias("soar"), T.xsoar_severity(s).alias("xsoar"), T.servicenow_urgency(s).alias("urgency"))


@register(
    "status_route",
    REQ + "SELECT request_id, status, status = 200 AS success FROM req WHERE status IN (200, 403)",
)
def q_status_route(spark, sf):
    r = OT.route_status(FX.http_requests(spark, sf))
    return r.select("request_id", "status", "success")


# Time-range literals made from events (N and unit chosen by event id).
_UNITS = ["h", "d", "m", "x", "w"]


@register(
    "time_range_parse",
    "SELECT event_id, tr AS time_range, epoch_us(ts) - CASE WHEN regexp_matches(tr, '^-?\\d+[hdm]$') THEN "
    "CAST(regexp_extract(tr, '^(-?\\d+)', 1) AS BIGINT) * CASE right(tr, 1) WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 60 END "
    "ELSE 3600 END * 1000000 AS start_us FROM (SELECT event_id, ts, (event_id % 50) || "
    + "(['h', 'd', 'm', 'x', 'w'])[(event_id % 5) + 1] AS tr FROM events)",
)
def q_time_range(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    tr = F.concat((F.col("event_id") % 50).cast("string"), F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("event_id") % 5 + 1).cast("int")))
    return ev.select("event_id", tr.alias("time_range"), T.time_range_start(tr, FX.epoch_us("ts")).alias("start_us"))


# --- B12: normalized alert fields ---------------------------------------------------------
# Fixed values of the normalized schema: severity labels, technique-id pattern,
# hash algorithms by digest length.
NORM_SEVERITY = {"LOW": "Low", "MEDIUM": "Med", "HIGH": "High", "CRITICAL": "Crit"}
TECHNIQUE_RE = r"^T[0-9]{4}(\.[0-9]{3})?$"
HASH_ALGOS = {32: "md5", 40: "sha1", 64: "sha256"}


@register(
    "alert_normalize",
    with_views(alerts=alerts_sql())
    + "SELECT alert_id, CASE severity "
    + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in NORM_SEVERITY.items())
    + " END AS norm_severity, array_to_string(list_transform(list_filter(iocs, lambda x: length(x) IN (32, 40, 64) AND "
    f"regexp_matches(x, {_lit(T.HEX_RE)})), lambda x: CASE length(x) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END), ',') "
    "AS hash_algorithms, list_bool_and(list_transform(['T1213', 'T1213.002', 'T1078.004'] || "
    "CASE WHEN doc_id % 9 = 0 THEN ['T12'] ELSE [] END, lambda t: regexp_matches(t, "
    + _lit(TECHNIQUE_RE)
    + "))) AS techniques_valid FROM alerts",
)
def q_normalize(spark, sf):
    a = FX.alerts(spark, sf)
    m = F.create_map(*[x for k, v in NORM_SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    hashes = F.filter("iocs", lambda x: F.length(x).isin(32, 40, 64) & x.rlike(T.HEX_RE))
    algo = F.transform(hashes, lambda x: F.when(F.length(x) == 32, "md5").when(F.length(x) == 40, "sha1").otherwise("sha256"))
    techs = F.concat(F.array(F.lit("T1213"), F.lit("T1213.002"), F.lit("T1078.004")),
                     F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("T12"))).otherwise(F.array().cast("array<string>")))
    return a.select("alert_id", F.element_at(m, F.col("severity")).alias("norm_severity"),
                    F.array_join(algo, ",").alias("hash_algorithms"),
                    F.forall(techs, lambda t: t.rlike(TECHNIQUE_RE)).alias("techniques_valid"))


# --- B14: observables -------------------------------------------------------------------
OBSERVABLE_PATTERNS = {
    "ips": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "domains": r"\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|internal)\b",
    "hashes": r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b",
    "processes": r"\b[A-Za-z0-9_-]+\.exe\b",
}


@register(
    "observables_extract",
    with_views(alerts=alerts_sql())
    + "SELECT alert_id, "
    + ", ".join(
        f"array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(description, ''), {_lit(p)}))), ',') AS {n}"
        for n, p in OBSERVABLE_PATTERNS.items()
    )
    + ", affected_user AS usernames, affected_host AS hostnames FROM alerts",
)
def q_observables(spark, sf):
    a = FX.alerts(spark, sf)
    d = F.coalesce(F.col("description"), F.lit(""))
    cols = [F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(d, F.lit(p), 0))), ",").alias(n)
            for n, p in OBSERVABLE_PATTERNS.items()]
    return a.select("alert_id", *cols, F.col("affected_user").alias("usernames"), F.col("affected_host").alias("hostnames"))
