"""Request-telemetry expressions (B1–B14, A8): header maps, URL patterns,
IOC typing, severity maps. All are Catalyst expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's results.
# Header names read from a request (lower case; lookups are case-insensitive).
H_USER_ID = "x-user-id"
H_USER_EMAIL = "x-user-email"
H_DD_SESSION = "x-datadog-session-id"
H_DD_VIEW = "x-datadog-view-id"
H_DD_APP = "x-datadog-application-id"
H_CF_RAY = "cf-ray"
H_CF_PAGELOAD = "x-pageload-id"
H_USER_AGENT = "user-agent"
H_FORWARDED_FOR = "x-forwarded-for"
# Resource URL patterns, tried in this order; the first search hit wins.
RESOURCE_PATTERNS: list[tuple[str, str]] = [
    ("loan_application", r"/consumer/loan_applications/(\d+)"),
    ("loan_application", r"/api/v\d+/loans/([a-zA-Z0-9_-]+)"),
    ("account", r"/accounts/([a-zA-Z0-9_-]+)"),
    ("document", r"/documents/([a-zA-Z0-9_-]+)"),
]
# Session-id sources from rule options, in precedence order.
COOKIE_SESSION = r"session_id=([a-zA-Z0-9\-]+)"
H_CUSTOM_ID = "x-acme-id"
BEARER_TOKEN = r"Bearer\s+([a-zA-Z0-9\-\.]+)"
# URL rule variants.
URL_RULES = {
    "versioned_numeric": r"/api/v[12]/consumer/loan_applications/\d+",
    "uuid": r"/api/loans/[a-f0-9\-]{36}",
    "multi_type": r"/api/(loans|accounts|documents)/\d+",
}
# IOC typing.
IP_RE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
DOMAIN_RE = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$"
HEX_RE = r"^[0-9a-fA-F]+$"
# Severity maps: detection result → SOAR text (default "high"), text → XSOAR
# level (default 3), text → ServiceNow urgency (default "1").
SOAR_SEVERITY = {"CRITICAL_IDOR_ATTACK": "critical", "ALERT_MEDIUM": "high", "ALERT_LOW": "medium"}
XSOAR_SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SERVICENOW_URGENCY = {"critical": "1", "high": "1", "medium": "2", "low": "3"}
# Telemetry validation messages.
ISSUE_USER = "Missing user_id (required for ownership checks)"
ISSUE_SESSION = "Missing session identifier (datadog_session_id or cf_ray_id)"
ISSUE_RESOURCE = "Missing resource_id (cannot track access)"
ISSUE_TYPE = "Unknown resource_type (pattern matching failed)"


def lower_keys(headers: Column) -> Column:
    """Case-insensitive header map: keys lower-cased."""
    return F.map_from_entries(
        F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    )


def header(headers: Column, name: str) -> Column:
    """Header value or NULL when absent or empty."""
    return F.nullif(F.element_at(headers, F.lit(name)), F.lit(""))


def url_resource(path: Column, patterns: list[tuple[str, str]] | None = None) -> tuple[Column, Column]:
    """(resource_type, resource_id) of the first matching pattern; NULLs if none."""
    pats = list(RESOURCE_PATTERNS) + list(patterns or [])
    rtype: Column | None = None
    rid: Column | None = None
    for t, p in reversed(pats):
        hit = path.rlike(p)
        rtype = F.when(hit, F.lit(t)) if rtype is None else F.when(hit, F.lit(t)).otherwise(rtype)
        ext = F.regexp_extract(path, p, 1)
        rid = F.when(hit, ext) if rid is None else F.when(hit, ext).otherwise(rid)
    return rtype, rid


def client_ip(headers: Column, peer: Column) -> Column:
    """First X-Forwarded-For element (trimmed), else the peer address."""
    xff = header(headers, H_FORWARDED_FOR)
    return F.when(xff.isNotNull(), F.trim(F.split(xff, ",").getItem(0))).otherwise(peer)


def session_identifier(dd_session: Column, cf_ray: Column) -> Column:
    """RUM session, else CDN ray id; empty strings count as missing."""
    return F.coalesce(F.nullif(dd_session, F.lit("")), F.nullif(cf_ray, F.lit("")))


def session_from_headers(headers: Column) -> Column:
    """Cookie session, custom header, RUM header, bearer token — first present."""
    cookie = F.nullif(F.regexp_extract(F.coalesce(header(headers, "cookie"), F.lit("")), COOKIE_SESSION, 1), F.lit(""))
    bearer = F.nullif(F.regexp_extract(F.coalesce(header(headers, "authorization"), F.lit("")), BEARER_TOKEN, 1), F.lit(""))
    return F.coalesce(cookie, header(headers, H_CUSTOM_ID), header(headers, H_DD_SESSION), bearer)


def validation_issues(user_id: Column, session_id: Column, resource_id: Column, resource_type: Column) -> Column:
    """List of issues (empty = valid)."""
    issues = F.array(
        F.when(user_id.isNull() | (user_id == "") | (user_id == "unknown"), F.lit(ISSUE_USER)),
        F.when(session_id.isNull(), F.lit(ISSUE_SESSION)),
        F.when(resource_id.isNull() | (resource_id == "") | (resource_id == "unknown"), F.lit(ISSUE_RESOURCE)),
        F.when(resource_type == "other", F.lit(ISSUE_TYPE)),
    )
    return F.filter(issues, lambda x: x.isNotNull())


def ioc_type(ioc: Column, hash_first: bool = False) -> Column:
    """Ip → domain → hash → url → default hash (the domain test also
    accepts 32/40-hex strings; ``hash_first=True`` tests hashes before domains)."""
    is_ip = ioc.rlike(IP_RE)
    is_dom = ioc.rlike(DOMAIN_RE)
    is_hash = F.length(ioc).isin(32, 40, 64) & ioc.rlike(HEX_RE)
    is_url = ioc.startswith("http")
    if hash_first:
        return F.when(is_ip, "ip").when(is_hash, "hash").when(is_dom, "domain").when(is_url, "url").otherwise("hash")
    return F.when(is_ip, "ip").when(is_dom, "domain").when(is_hash, "hash").when(is_url, "url").otherwise("hash")


def _map_lookup(mapping: dict, key: Column, default) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def soar_severity(result: Column) -> Column:
    return _map_lookup(SOAR_SEVERITY, result, "high")


def xsoar_severity(text: Column) -> Column:
    return _map_lookup(XSOAR_SEVERITY, text, 3)


def servicenow_urgency(text: Column) -> Column:
    return _map_lookup(SERVICENOW_URGENCY, text, "1")


def time_range_start(time_range: Column, end_us: Column) -> Column:
    """``Nh`` / ``Nd`` / ``Nm`` back from ``end``; anything else → 1 hour."""
    n = F.regexp_extract(time_range, r"^(-?\d+)[hdm]$", 1).try_cast("bigint")
    unit = F.substring(time_range, -1, 1)
    sec = F.when(n.isNull(), F.lit(3600)).otherwise(
        F.when(unit == "h", n * 3600).when(unit == "d", n * 86400).otherwise(n * 60)
    )
    return end_us - sec * F.lit(1_000_000)
