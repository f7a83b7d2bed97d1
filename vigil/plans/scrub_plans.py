"""Plans for PII scrubbing (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scrub as S
from vigil.plans import register
from vigil.plans.detection_plans import IDOR_EVENTS_SQL, idor_events_df
from vigil.plans.oracle_views import (
    _lit,
    access_log_sql,
    alerts_sql,
    customer_pii_sql,
    entity_counts_sql,
    has_pii_sql,
    scrub_sql,
    with_views,
)
from vigil.sources import fixtures as FX
from vigil.sources.tables import table

SALT = "vigil-demo-salt"
SUBSET = ["EMAIL_ADDRESS", "CREDIT_CARD"]


@register(
    "pii_scrub_text",
    f"SELECT doc_id, {scrub_sql('text')} AS scrubbed, {scrub_sql('text')} IS DISTINCT FROM text AS changed FROM documents",
)
def q_scrub_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    s = S.scrub_text("text")
    return d.select("doc_id", s.alias("scrubbed"), (~s.eqNullSafe(F.col("text"))).alias("changed"))


@register(
    "pii_scrub_subset",
    f"SELECT doc_id, {scrub_sql('text', SUBSET)} AS scrubbed FROM documents",
)
def q_scrub_subset(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", S.scrub_text("text", entities=SUBSET).alias("scrubbed"))


_ALERT_COLS = ["alert_id", "severity", "source", "title", "description", "timestamp", "affected_user", "affected_host"]


@register(
    "pii_scrub_alert",
    with_views(alerts=alerts_sql())
    + "SELECT "
    + ", ".join(f"{scrub_sql(c)} AS {c}" for c in _ALERT_COLS)
    + f", array_to_string(list_transform(iocs, lambda x: {scrub_sql('x')}), ',') AS iocs, distinct_resources FROM alerts",
)
def q_scrub_alert(spark, sf):
    a = FX.alerts(spark, sf).select(*_ALERT_COLS, "iocs", "distinct_resources")
    s = S.scrub_columns(a)
    return s.withColumn("iocs", F.array_join("iocs", ","))


@register(
    "pii_entity_counts",
    "SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in entity_counts_sql("text")) + " FROM documents",
)
def q_entity_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", S.entity_counts("text").alias("c")).select("doc_id", "c.*")


@register(
    "pii_tiered",
    with_views(cp=customer_pii_sql())
    + f"SELECT c_custkey, {scrub_sql('text', tokens=S.TIERED_TOKENS)} AS masked FROM cp",
)
def q_tiered(spark, sf):
    c = FX.customer_pii(spark, sf)
    return c.select("c_custkey", S.scrub_text("text", tokens=S.TIERED_TOKENS).alias("masked"))


@register(
    "pii_tokenize",
    with_views(access_log=access_log_sql())
    + f"SELECT user_id, 'usr_' || substr(sha256({_lit(SALT)} || user_id), 1, 8) AS user_token FROM (SELECT DISTINCT user_id FROM access_log)",
)
def q_tokenize(spark, sf):
    users = FX.access_log(spark, sf).select("user_id").distinct()
    return users.select("user_id", S.tokenize("user_id", SALT).alias("user_token"))


@register(
    "geo_generalize",
    """SELECT c_custkey, n_name || ', ' || r_name AS location, split_part(n_name || ', ' || r_name, ',', 1) AS generalized
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def q_geo(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    # nation/region are fixed-size dimensions (25 / 5 rows): broadcast is size-bounded
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    loc = F.concat_ws(", ", "n_name", "r_name")
    return j.select("c_custkey", loc.alias("location"), S.generalize_location(loc).alias("generalized"))


def _telemetry_oracle(scrub_event: bool) -> str:
    base = IDOR_EVENTS_SQL.rstrip()
    head, _, _ = base.rpartition("SELECT 'idor_evt_'")
    ev = (lambda c: scrub_sql(c)) if scrub_event else (lambda c: c)
    return (
        head
        + f"""
SELECT 'idor_evt_' || substr(sha256(l.session_id || ':' || l.ts_us || ':' || l.event_id), 1, 16) AS event_id,
       {ev('l.user_id')} AS user_id, {ev('l.session_id')} AS session_id, {ev('l.failed_resources')} AS failed_resources,
       {scrub_sql('a.user_email')} AS user_email, {scrub_sql('a.client_ip')} AS client_ip,
       {scrub_sql('a.request_path')} AS request_path, {scrub_sql('a.user_agent')} AS user_agent,
       {scrub_sql('a.resource_id')} AS resource_id
FROM laddered l JOIN access_log a ON a.event_id = l.event_id WHERE l.has_event
"""
    )


def _telemetry_df(spark, sf, scrub_event: bool):
    ev = idor_events_df(spark, sf)
    snap = S.scrub_value(F.col("telemetry_snapshot"), ev.schema["telemetry_snapshot"].dataType)
    out = ev.withColumn("telemetry_snapshot", snap).withColumn("failed_resources", F.array_join("failed_resources", ","))
    if scrub_event:
        out = S.scrub_columns(out, ["user_id", "session_id", "failed_resources"])
    return out.select(
        "event_id", "user_id", "session_id", "failed_resources",
        F.col("telemetry_snapshot.user_email").alias("user_email"),
        F.col("telemetry_snapshot.client_ip").alias("client_ip"),
        F.col("telemetry_snapshot.request_path").alias("request_path"),
        F.col("telemetry_snapshot.user_agent").alias("user_agent"),
        F.col("telemetry_snapshot.resource_id").alias("resource_id"),
    )


@register("pii_scrub_telemetry", _telemetry_oracle(True))
def q_scrub_telemetry(spark, sf):
    return _telemetry_df(spark, sf, True)


@register("pii_scrub_snapshot", _telemetry_oracle(False))
def q_scrub_snapshot(spark, sf):
    return _telemetry_df(spark, sf, False)


# Which boundary gets scrubbed text. Defaults follow the documented policy:
# inbound and context always, case off, annotation always, SOAR off.
POLICY = [("inbound", True), ("context", True), ("case", False), ("annotation", True), ("soar", False)]


@register(
    "pii_policy",
    with_views(access_log=access_log_sql())
    + "SELECT a.event_id, p.sink, p.scrub AS scrubbed, CASE WHEN p.scrub THEN "
    + scrub_sql("a.user_email")
    + " ELSE a.user_email END AS user_email, CASE WHEN p.scrub THEN "
    + scrub_sql("a.client_ip")
    + " ELSE a.client_ip END AS client_ip FROM access_log a CROSS JOIN (VALUES "
    + ", ".join(f"('{s}', {str(b).lower()})" for s, b in POLICY)
    + ") p(sink, scrub) WHERE NOT a.success",
)
def q_policy(spark, sf):
    log = FX.access_log(spark, sf).filter(~F.col("success"))
    # one row per sink: a fan-out over the literal policy list
    pol = F.array(*[F.struct(F.lit(s).alias("sink"), F.lit(b).alias("scrub")) for s, b in POLICY])
    j = log.withColumn("_p", F.explode(pol)).select("*", "_p.sink", "_p.scrub").drop("_p")
    pick = lambda c: F.when(F.col("scrub"), S.scrub_text(c)).otherwise(F.col(c)).alias(c)
    return j.select("event_id", "sink", F.col("scrub").alias("scrubbed"), pick("user_email"), pick("client_ip"))


_BOUNDARY_SQL = {
    "documents": ("documents", "text"),
    "alerts": ("alerts", "description"),
    "customers": ("cp", "text"),
}


@register(
    "pii_leak_audit",
    with_views(alerts=alerts_sql(), cp=customer_pii_sql())
    + " UNION ALL ".join(
        f"SELECT '{b}' AS boundary, count(*) AS rows_checked, "
        f"count(*) FILTER (WHERE {has_pii_sql(scrub_sql(c))}) AS leaked_rows, "
        f"count(*) FILTER (WHERE {has_pii_sql(c)}) AS raw_rows_with_pii FROM {t}"
        for b, (t, c) in _BOUNDARY_SQL.items()
    ),
)
def q_leak_audit(spark, sf):
    srcs = {
        "documents": table(spark, sf, "documents").select(F.col("text").alias("v")),
        "alerts": FX.alerts(spark, sf).select(F.col("description").alias("v")),
        "customers": FX.customer_pii(spark, sf).select(F.col("text").alias("v")),
    }
    out = None
    for b, df in srcs.items():
        part = df.agg(
            F.count(F.lit(1)).alias("rows_checked"),
            F.count_if(S.has_pii(S.scrub_text("v"))).alias("leaked_rows"),
            F.count_if(S.has_pii("v")).alias("raw_rows_with_pii"),
        ).select(F.lit(b).alias("boundary"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_HOST_SQL = "lower(replace(s_name, '#', '-')) || '.corp.example.com'"
_IP_SQL = "'10.7.' || s_nationkey || '.' || (s_suppkey % 256)"


@register(
    "pii_scrub_hosts",
    f"SELECT s_suppkey, array_to_string(list_transform([{_HOST_SQL}, {_IP_SQL}, {_HOST_SQL} || ' ' || {_IP_SQL}], "
    f"lambda x: {scrub_sql('x')}), '|') AS asset_names FROM supplier",
)
def q_scrub_hosts(spark, sf):
    """C14: each asset name of a list scrubbed (plain hostnames survive regex mode)."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    host = F.concat(F.lower(F.regexp_replace("s_name", "#", "-")), F.lit(".corp.example.com"))
    ip = F.concat(F.lit("10.7."), F.col("s_nationkey").cast("string"), F.lit("."), (F.col("s_suppkey") % 256).cast("string"))
    names = F.array(host, ip, F.concat_ws(" ", host, ip))
    return s.select("s_suppkey", F.array_join(F.transform(names, lambda x: S.scrub_text(x)), "|").alias("asset_names"))


@register(
    "pii_scrub_nested",
    f"""SELECT conv_id, turn, {scrub_sql('role')} AS role, {scrub_sql('text')} AS text,
       array_to_string(list_transform(string_split(text, chr(10)), lambda x: {scrub_sql('x')}), chr(10)) AS lines,
       {scrub_sql("split_part(text, chr(10), 1)")} AS meta_first_line, 'role' AS meta_keys
FROM conversations""",
)
def q_scrub_nested(spark, sf):
    """The nested message scrubbed leaf by leaf (struct, array and map
    values; map keys untouched), then flattened for the comparison."""
    conv = FX.conversations_nested(spark, sf)
    s = S.scrub_columns(conv, ["msg"])
    return s.select(
        "conv_id", "turn", F.col("msg.role").alias("role"), F.col("msg.body.text").alias("text"),
        F.array_join("msg.body.lines", "\n").alias("lines"),
        F.element_at("msg.meta", F.lit("first_line")).alias("meta_first_line"),
        F.array_join(F.array_sort(F.filter(F.map_keys("msg.meta"), lambda k: k == "role")), ",").alias("meta_keys"),
    )


# C2 without a schema: raw JSON texts of mixed types, and the paths the check reads their leaves from.
_JSON_LEAVES = {
    "$.id": "CAST(c_custkey AS VARCHAR)",
    "$.note": scrub_sql("text"),
    "$.pan": "CAST(4111000000000000 + c_custkey AS VARCHAR)",  # a number: stays
    "$['ops@bank.example.com']": scrub_sql("passport"),  # the key stays
    "$.log[0]": "'12.25'",
    "$.log[1]": scrub_sql("card || chr(9) || email"),
    "$.log[2].seen": "'true'",
    "$.log[2].raw[0][0]": scrub_sql("""'"' || email || '"' || chr(10) || ssn || '\\'"""),
    "$.log[2].raw[1]": "c_custkey || '.5'",
    "$.log[3]": "'null'",  # as a JSON path reads it
    "$.log[4]": scrub_sql("phone"),
}


def _raw_json(p) -> F.Column:
    """A customer's personal data as a raw JSON text: keys of any name, mixed arrays, escapes, white space."""
    string = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    key = F.col("c_custkey").cast("string")
    quoted = F.concat(F.lit('"'), p["email"], F.lit('"\n'), p["ssn"], F.lit("\\"))
    return F.concat(
        F.lit('{"id":'), key, F.lit(', "note" : '), string(p["text"]),
        F.lit(',"pan":'), (F.lit(4111000000000000) + F.col("c_custkey")).cast("string"),
        F.lit(',\n"ops@bank.example.com"\n:'), string(p["passport"]),
        F.lit(',"log":[12.25,'), string(F.concat(p["card"], F.lit("\t"), p["email"])),
        F.lit(',{"seen":true,"raw":[['), string(quoted), F.lit("],"), key, F.lit(".5]},null,"), string(p["phone"]), F.lit("]}"),
    )


@register(
    "pii_scrub_json",
    with_views(cp=customer_pii_sql())
    + " UNION ALL ".join(
        f"SELECT c_custkey, {_lit(path)} AS path, {leaf} AS leaf FROM cp" for path, leaf in _JSON_LEAVES.items()
    ),
)
def q_scrub_json(spark, sf):
    """C2/C3 on a raw JSON column without a schema: one row per leaf of the scrubbed text."""
    cp = FX.customer_pii(spark, sf)
    done = cp.select("c_custkey", S.scrub_json(_raw_json(cp)).alias("scrubbed"))
    leaves = [F.struct(F.lit(p).alias("path"), F.get_json_object("scrubbed", p).alias("leaf")) for p in _JSON_LEAVES]
    return done.select("c_custkey", F.inline(F.array(*leaves)))
