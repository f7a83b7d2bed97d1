"""Plans for context aggregates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vigil.functions.telemetry import IP_RE
from vigil.operators import context_aggs as C
from vigil.plans import register
from vigil.plans.oracle_views import (
    _lit,
    access_log_sql,
    alerts_sql,
    ioc_sightings_sql,
    logins_sql,
    network_sql,
    reputation_sql,
    with_views,
)
from vigil.sources import fixtures as FX
from vigil.sources.context import DEFAULT_CONTEXT as CTX
from vigil.sources.tables import table

DAY_US = C.DAY_US
PREV_DAYS, NET_DAYS, BASE_DAYS = 30, 90, 30


def _max(df, col="ts_us"):
    # one aggregate scalar to the driver: the as_of instant
    return df.agg(F.max(col)).first()[0]


# --- G11 / G15 ------------------------------------------------------------------------
_PREV_V = dict(
    s=ioc_sightings_sql(),
    a="SELECT max(ts_us) AS t FROM s",
    p=f"""SELECT indicator, count(DISTINCT asset) AS affected_asset_count, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us
          FROM s, a WHERE ts_us BETWEEN a.t - {PREV_DAYS * DAY_US} AND a.t GROUP BY indicator""",
)
_PREV_SQL = with_views(**_PREV_V)


def _prevalence(spark, sf):
    t = FX.max_time_us(spark, sf, "lineitem", "l_shipdate")
    return C.prevalence(FX.ioc_sightings(spark, sf, t - PREV_DAYS * DAY_US, t))


@register("ctx_prevalence", _PREV_SQL + "SELECT * FROM p")
def q_prevalence(spark, sf):
    return _prevalence(spark, sf)


def _fmt_prev_sql(n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN {_lit(C.PREV_NEW)} WHEN {n} = 1 THEN {_lit(C.PREV_ONE)} "
            f"WHEN {n} < 5 THEN format({_lit(C.PREV_FEW)}, {n}) WHEN {n} < 20 THEN format({_lit(C.PREV_MODERATE)}, {n}) "
            f"ELSE format({_lit(C.PREV_WIDE)}, {n}) END")


@register("fmt_prevalence", _PREV_SQL + f"SELECT indicator, {_fmt_prev_sql('affected_asset_count')} AS prevalence_text FROM p")
def q_fmt_prevalence(spark, sf):
    p = _prevalence(spark, sf)
    return p.select("indicator", C.fmt_prevalence(F.col("affected_asset_count")).alias("prevalence_text"))


# --- G12 / G16 ------------------------------------------------------------------------
def _topk_sql(attr: str, k: int) -> str:
    return f"""SELECT user_id, string_agg({attr}, ',' ORDER BY n DESC, {attr}) AS v FROM (
      SELECT user_id, {attr}, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {attr}) AS r
      FROM (SELECT user_id, {attr}, count(*) AS n FROM lw GROUP BY user_id, {attr})) WHERE r <= {k} GROUP BY user_id"""


_BASE_SQL = with_views(
    l=logins_sql(),
    a="SELECT max(ts_us) AS t FROM l",
    lw=f"SELECT l.* FROM l, a WHERE ts_us BETWEEN a.t - {BASE_DAYS * DAY_US} AND a.t",
    tl=_topk_sql("location", 3),
    ti=_topk_sql("ip", 3),
    ta=_topk_sql("agent", 5),
    b=f"""SELECT u.user_id, u.n / {float(BASE_DAYS)} AS average_daily_logins, tl.v AS typical_locations,
                 ti.v AS typical_source_ips, ta.v AS typical_user_agents
          FROM (SELECT user_id, count(*) AS n FROM lw GROUP BY user_id) u
          LEFT JOIN tl USING (user_id) LEFT JOIN ti USING (user_id) LEFT JOIN ta USING (user_id)""",
)


def _baseline(spark, sf):
    t = FX.max_time_us(spark, sf, "events", "ts")
    return C.user_baseline(FX.logins(spark, sf, t - BASE_DAYS * DAY_US, t), BASE_DAYS)


@register("ctx_user_baseline", _BASE_SQL + "SELECT user_id, round(average_daily_logins, 6) AS average_daily_logins, typical_locations, typical_source_ips, typical_user_agents FROM b")
def q_baseline(spark, sf):
    b = _baseline(spark, sf)
    return b.select(
        "user_id", F.round("average_daily_logins", 6).alias("average_daily_logins"),
        *[F.array_join(c, ",").alias(c) for c in ("typical_locations", "typical_source_ips", "typical_user_agents")],
    )


@register(
    "fmt_baseline",
    _BASE_SQL
    + f"""SELECT user_id, CASE WHEN typical_locations IS NULL THEN {_lit(C.BASELINE_NONE)}
       ELSE 'User typically logs in from: ' || array_to_string(list_slice(string_split(typical_locations, ','), 1, 3), ', ')
            || '. Average ' || printf('%.1f', average_daily_logins) || ' logins/day.' END AS baseline_text FROM b""",
)
def q_fmt_baseline(spark, sf):
    b = _baseline(spark, sf)
    return b.select("user_id", C.fmt_baseline(F.col("typical_locations"), F.col("average_daily_logins")).alias("baseline_text"))


# --- G13 / G17 ------------------------------------------------------------------------
_NET_V = dict(
    c=network_sql(),
    rep=reputation_sql(),
    a2="SELECT max(ts_us) AS t FROM c",
    n=f"""SELECT ip, count(*) AS connection_count, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
                 count(DISTINCT asset) AS connected_asset_count
          FROM c, a2 WHERE ts_us BETWEEN a2.t - {NET_DAYS * DAY_US} AND a2.t GROUP BY ip""",
    nr="SELECT n.*, rep.reputation_score FROM n LEFT JOIN rep USING (ip)",
)
_NET_SQL = with_views(**_NET_V)


def _network(spark, sf):
    t = FX.max_time_us(spark, sf, "lineitem", "l_shipdate")
    return C.network_context(FX.network_connections(spark, sf, t - NET_DAYS * DAY_US, t), FX.ip_reputation(spark, sf))


@register("ctx_network", _NET_SQL + "SELECT * FROM nr")
def q_network(spark, sf):
    return _network(spark, sf)


def _fmt_net_sql(n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN {_lit(C.NET_NEW)} WHEN {n} < 5 THEN format({_lit(C.NET_RARE)}, {n}) "
            f"WHEN {n} < 50 THEN format({_lit(C.NET_UNCOMMON)}, {n}) ELSE format({_lit(C.NET_KNOWN)}, {n}) END")


@register("fmt_network", _NET_SQL + f"SELECT ip, {_fmt_net_sql('connection_count')} AS network_text FROM nr")
def q_fmt_network(spark, sf):
    return _network(spark, sf).select("ip", C.fmt_network(F.col("connection_count")).alias("network_text"))


# --- G14: fan-out per alert -----------------------------------------------------------
@register(
    "ctx_fanout",
    with_views(alerts=alerts_sql(), **_PREV_V, **_NET_V)
    + f"""
SELECT alert_id, 'prevalence' AS kind, pos, substr(ioc, 1, 20) AS key, {_fmt_prev_sql('coalesce(p.affected_asset_count, 0)')} AS text
FROM (SELECT alert_id, unnest(list_slice(iocs, 1, 5)) AS ioc, unnest(range(1, len(list_slice(iocs, 1, 5)) + 1)) AS pos FROM alerts) x
LEFT JOIN p ON p.indicator = x.ioc
UNION ALL
SELECT alert_id, 'network', pos, ip, {_fmt_net_sql('coalesce(nr.connection_count, 0)')}
FROM (SELECT alert_id, unnest(list_slice(list_filter(iocs, lambda i: regexp_matches(i, {_lit(IP_RE)})), 1, 3)) AS ip,
             unnest(range(1, len(list_slice(list_filter(iocs, lambda i: regexp_matches(i, {_lit(IP_RE)})), 1, 3)) + 1)) AS pos
      FROM alerts) y LEFT JOIN nr USING (ip)""",
)
def q_fanout(spark, sf):
    a = FX.alerts(spark, sf).select("alert_id", "iocs")
    prev = _prevalence(spark, sf)
    net = _network(spark, sf)
    iocs = a.select("alert_id", F.posexplode(F.slice("iocs", 1, 5)).alias("p0", "ioc"))
    pj = iocs.join(prev, iocs.ioc == prev.indicator, "left").select(
        "alert_id", F.lit("prevalence").alias("kind"), (F.col("p0") + 1).cast("bigint").alias("pos"),
        F.substring("ioc", 1, 20).alias("key"),
        C.fmt_prevalence(F.coalesce(F.col("affected_asset_count"), F.lit(0))).alias("text"),
    )
    ips = a.select("alert_id", F.posexplode(F.slice(F.filter("iocs", lambda x: x.rlike(IP_RE)), 1, 3)).alias("p0", "ip"))
    nj = ips.join(net, "ip", "left").select(
        "alert_id", F.lit("network").alias("kind"), (F.col("p0") + 1).cast("bigint").alias("pos"),
        F.col("ip").alias("key"), C.fmt_network(F.coalesce(F.col("connection_count"), F.lit(0))).alias("text"),
    )
    return pj.unionByName(nj)


# --- G19: similar historical cases ----------------------------------------------------
K_SIMILAR = 3


@register(
    "similar_topk",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 10 = 0),
c AS (SELECT vec_id, v, (['TP', 'FP', 'BTP', 'Escalated'])[(label % 4) + 1] AS disposition FROM e WHERE vec_id % 10 <> 0),
s AS (SELECT query_id, vec_id, disposition,
             CASE WHEN list_dot_product(qv, qv) > 0 AND list_dot_product(v, v) > 0
                  THEN round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 12) END AS sim
      FROM q, c)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity, disposition FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, vec_id) AS rank FROM s) WHERE rank <= {K_SIMILAR}""",
)
def q_similar(spark, sf):
    queries, corpus = FX.history_vectors(spark, sf)
    t = C.similar_topk(queries, corpus, K_SIMILAR)
    return t.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"), "disposition")


# --- G20: baseline anomaly -----------------------------------------------------------
@register(
    "ctx_anomaly",
    with_views(
        l=logins_sql(),
        a="SELECT max(ts_us) AS t FROM l",
        lw=f"SELECT l.* FROM l, a WHERE ts_us >= a.t - {(BASE_DAYS + 1) * DAY_US} AND ts_us < a.t - {DAY_US}",
        rec=f"SELECT l.* FROM l, a WHERE ts_us >= a.t - {DAY_US}",
        tl="SELECT user_id, location FROM (SELECT user_id, location, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, location) AS r "
        "FROM (SELECT user_id, location, count(*) AS n FROM lw GROUP BY ALL)) WHERE r <= 3",
        ta="SELECT user_id, agent FROM (SELECT user_id, agent, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, agent) AS r "
        "FROM (SELECT user_id, agent, count(*) AS n FROM lw GROUP BY ALL)) WHERE r <= 5",
    )
    + """SELECT r.event_id, r.user_id, tl.location IS NULL AS unusual_location, ta.agent IS NULL AS new_agent
FROM rec r LEFT JOIN tl ON tl.user_id = r.user_id AND tl.location = r.location
LEFT JOIN ta ON ta.user_id = r.user_id AND ta.agent = r.agent""",
)
def q_anomaly(spark, sf):
    lg = FX.logins(spark, sf)
    t = _max(lg)
    hist = lg.filter((F.col("ts_us") >= F.lit(t - (BASE_DAYS + 1) * DAY_US)) & (F.col("ts_us") < F.lit(t - DAY_US)))
    recent = lg.filter(F.col("ts_us") >= F.lit(t - DAY_US))

    def top(attr, k):
        c = hist.groupBy("user_id", attr).agg(F.count(F.lit(1)).alias("n"))
        return C.top_k_per_key(c, "user_id", [F.col("n").desc(), F.col(attr)], k, salt_col=attr).select(
            "user_id", attr, F.lit(True).alias(f"_known_{attr}")
        )

    j = recent.join(top("location", 3), ["user_id", "location"], "left").join(top("agent", 5), ["user_id", "agent"], "left")
    return j.select(
        "event_id", "user_id", F.col("_known_location").isNull().alias("unusual_location"), F.col("_known_agent").isNull().alias("new_agent")
    )


# --- G21: deployments before an alert ---------------------------------------------------
@register(
    "ctx_deployments",
    f"""WITH d AS (SELECT 'ep-' || (o_custkey % 10) AS endpoint, epoch_us(o_orderdate) AS ts_us FROM orders WHERE o_orderpriority = '1-URGENT'),
al AS (SELECT l_orderkey * 10 + l_linenumber AS alert_key, 'ep-' || (l_suppkey % 10) AS endpoint, epoch_us(l_shipdate) AS ts_us
       FROM lineitem WHERE l_returnflag = 'R')
SELECT al.alert_key, al.endpoint, al.ts_us, count(d.ts_us) AS events_in_window, max(d.ts_us) AS last_event_us
FROM al LEFT JOIN d ON d.endpoint = al.endpoint AND d.ts_us BETWEEN al.ts_us - {DAY_US} AND al.ts_us
GROUP BY al.alert_key, al.endpoint, al.ts_us""",
)
def q_deployments(spark, sf):
    return C.interval_join_counts(FX.endpoint_alerts(spark, sf), FX.deployments(spark, sf), "endpoint", DAY_US)


# --- G22: user history features ---------------------------------------------------------
@register(
    "ctx_user_features",
    with_views(access_log=access_log_sql(), a="SELECT max(ts_us) AS t FROM access_log")
    + f"""SELECT u.user_id, (a.t - u.first_us) // {DAY_US} AS account_age_days, u.active_days, round(d.avg_res, 6) AS avg_resources_per_session,
       u.failures, u.failures > 10 AS seen_many_before, c.c_mktsegment AS segment
FROM (SELECT user_id, min(ts_us) AS first_us, count(DISTINCT ts_us // {DAY_US}) AS active_days,
             count(*) FILTER (WHERE NOT success) AS failures FROM access_log GROUP BY user_id) u
JOIN (SELECT user_id, avg(n) AS avg_res FROM (SELECT user_id, ts_us // {DAY_US} AS dday, count(DISTINCT resource_id) AS n
      FROM access_log GROUP BY ALL) GROUP BY user_id) d USING (user_id)
CROSS JOIN a
LEFT JOIN customer c ON 'user_' || c.c_custkey = u.user_id""",
)
def q_user_features(spark, sf):
    log = FX.access_log(spark, sf)
    t = _max(log)
    day = F.floor(F.col("ts_us") / F.lit(DAY_US))
    per_day = log.groupBy("user_id", day.alias("dday")).agg(F.count_distinct("resource_id").alias("n"))
    d = per_day.groupBy("user_id").agg(F.avg("n").alias("avg_res"))
    u = log.groupBy("user_id").agg(
        F.min("ts_us").alias("first_us"), F.count_distinct(day).alias("active_days"), F.count_if(~F.col("success")).alias("failures")
    )
    cu = table(spark, sf, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("user_id"), F.col("c_mktsegment").alias("segment"))
    j = u.join(d, "user_id").join(cu, "user_id", "left")
    return j.select(
        "user_id", F.floor((F.lit(t) - F.col("first_us")) / F.lit(DAY_US)).cast("bigint").alias("account_age_days"),
        "active_days", F.round("avg_res", 6).alias("avg_resources_per_session"), "failures",
        (F.col("failures") > 10).alias("seen_many_before"), "segment",
    )


# --- G5: CIDR-aware matching ------------------------------------------------------------
def _cidr_rows():
    rows = []
    for p in CTX["known_false_positives"]:
        for m in re.findall(r"\d{1,3}(?:\.\d{1,3}){3}/\d{1,2}", p["pattern"]):
            rows.append((m, "known_false_positive"))
    for s in CTX["qa_infrastructure"].get("test_subnets", []):
        rows.append((s, "qa_subnet"))
    return rows


_IPV4_FIND = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def _ip_long_sql(x: str) -> str:
    return (f"(CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 + "
            f"CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT))")


@register(
    "enrich_cidr",
    with_views(
        alerts=alerts_sql(),
        ips=f"""SELECT DISTINCT alert_id, ip FROM (
                  SELECT alert_id, unnest(list_concat(list_filter(iocs, lambda i: regexp_matches(i, {_lit(IP_RE)})),
                                                      regexp_extract_all(description, {_lit(_IPV4_FIND)}))) AS ip FROM alerts)""",
        cidrs="SELECT * FROM (VALUES " + ", ".join(f"({_lit(c)}, {_lit(l)})" for c, l in _cidr_rows()) + ") t(cidr, label)",
        r=f"""SELECT cidr, label, ({_ip_long_sql("split_part(cidr, '/', 1)")} // (1 << (32 - CAST(split_part(cidr, '/', 2) AS INTEGER))))
                      * (1 << (32 - CAST(split_part(cidr, '/', 2) AS INTEGER))) AS lo,
                      (1 << (32 - CAST(split_part(cidr, '/', 2) AS INTEGER))) AS size FROM cidrs""",
    )
    + f"SELECT i.alert_id, i.ip, r.cidr, r.label FROM ips i JOIN r ON {_ip_long_sql('i.ip')} BETWEEN r.lo AND r.lo + r.size - 1",
)
def q_cidr(spark, sf):
    from vigil.functions.telemetry import IP_RE as IPX

    a = FX.alerts(spark, sf)
    cand = F.concat(F.filter("iocs", lambda i: i.rlike(IPX)), F.regexp_extract_all("description", F.lit(_IPV4_FIND), 0))
    ips = a.select("alert_id", F.explode(cand).alias("ip")).distinct()
    ranges = C.cidr_ranges(spark.createDataFrame(_cidr_rows(), "cidr string, label string"))
    return C.cidr_match(ips, ranges).select("alert_id", "ip", "cidr", "label")


# --- G5: both address families, nested ranges, malformed addresses -------------------
FAMILY_RANGES = [
    ("10.0.0.0/8", "internal"), ("10.1.0.0/16", "branch"), ("10.1.2.0/24", "lab"), ("2001:db8::/32", "documentation"),
    ("2001:db8:0:1::/64", "segment"), ("2001:DB8:0:1::7", "host"), ("::ffff:10.1.0.0/112", "mapped"), ("10.1.2.0/40", "malformed"),
    ("gateway", "malformed"),
]


def _hosts(spark, sf):
    """Addresses as sensors write them, from ``supplier``: both families, short forms, and malformed ones."""
    k = F.col("s_suppkey")
    low = F.lower(F.hex(k % 9))
    form = [
        F.concat(F.lit("10."), (k % 3).cast("string"), F.lit("."), (k % 4).cast("string"), F.lit("."), (k % 256).cast("string")),
        F.concat(F.lit("2001:db8:0:"), (k % 3).cast("string"), F.lit("::"), low),
        F.concat(F.lit("2001:0DB8:0000:0001:0:0:0:"), low),
        F.concat(F.lit("::ffff:10.1.2."), (k % 256).cast("string")),
        F.element_at(F.array(*map(F.lit, ["::1", "unknown", "10.1", "300.1.1.1", "1:2:3", ":::", "", "10.1.2.3.4"])), (k % 8 + 1).cast("int")),
    ]
    pick = F.coalesce(*[F.when(k % 7 == i, f) for i, f in enumerate(form)])
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("host_id"), pick.alias("ip"))


def _address_bits_sql(source: str, name: str) -> dict[str, str]:
    """View ``name`` of ``source`` (key, ip): ``bits``, the address as 128 characters, null if malformed."""
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    dotted = rf"{octet}\.{octet}\.{octet}\.{octet}$"
    part = lambda i: f"regexp_extract(ip, '{dotted}', {i})::INTEGER"
    hexed = f"printf('%02x%02x:%02x%02x', {part(1)}, {part(2)}, {part(3)}, {part(4)})"
    return {
        f"{name}_text": f"""SELECT key, ip, CASE WHEN regexp_matches(ip, '^{dotted}') THEN '::ffff:' || {hexed}
            WHEN regexp_matches(ip, ':{dotted}') THEN regexp_replace(ip, '{dotted}', '') || {hexed} ELSE lower(ip) END AS t FROM {source}""",
        f"{name}_halves": f"SELECT *, string_split(t, '::') AS h FROM {name}_text",
        f"{name}_sides": f"""SELECT *, CASE WHEN h[1] = '' THEN []::VARCHAR[] ELSE string_split(h[1], ':') END AS l,
            CASE WHEN len(h) < 2 OR h[2] = '' THEN []::VARCHAR[] ELSE string_split(h[2], ':') END AS r FROM {name}_halves""",
        f"{name}_groups": f"""SELECT *, list_concat(l, list_concat(CASE WHEN len(h) = 2 THEN list_transform(range(8 - len(l) - len(r)),
            lambda i: '0') ELSE []::VARCHAR[] END, r)) AS g FROM {name}_sides""",
        name: f"""SELECT key, ip, CASE WHEN len(g) = 8 AND (len(h) = 1 OR len(h) = 2 AND len(l) + len(r) <= 7)
            AND len(list_filter(g, lambda x: NOT regexp_full_match(x, '[0-9a-f]{{1,4}}'))) = 0 THEN
            array_to_string(list_transform(g, lambda x: right(('0x' || lpad(x, 8, '0'))::INTEGER::BIT::VARCHAR, 16)), '') END AS bits
            FROM {name}_groups""",
    }


def _families_sql() -> str:
    pick = """CASE s_suppkey % 7
      WHEN 0 THEN '10.' || s_suppkey % 3 || '.' || s_suppkey % 4 || '.' || s_suppkey % 256
      WHEN 1 THEN '2001:db8:0:' || s_suppkey % 3 || '::' || s_suppkey % 9
      WHEN 2 THEN '2001:0DB8:0000:0001:0:0:0:' || s_suppkey % 9
      WHEN 3 THEN '::ffff:10.1.2.' || s_suppkey % 256
      WHEN 4 THEN (['::1', 'unknown', '10.1', '300.1.1.1', '1:2:3', ':::', '', '10.1.2.3.4'])[s_suppkey % 8 + 1] END"""
    ranges = ", ".join(f"({_lit(c)}, {_lit(l)})" for c, l in FAMILY_RANGES)
    v = {"hosts": f"SELECT s_suppkey AS key, {pick} AS ip FROM supplier", **_address_bits_sql("hosts", "host_bits")}
    v["ranges"] = f"SELECT cidr AS key, label, split_part(cidr, '/', 1) AS ip FROM (VALUES {ranges}) t(cidr, label)"
    v |= _address_bits_sql("(SELECT key, ip FROM ranges)", "range_bits")
    v["nets"] = """SELECT r.key AS cidr, r.label, b.bits,
        coalesce(TRY_CAST(nullif(split_part(r.key, '/', 2), '') AS INTEGER), CASE WHEN contains(r.ip, ':') THEN 128 ELSE 32 END) AS given,
        CASE WHEN contains(r.ip, ':') THEN 128 ELSE 32 END AS most FROM ranges r JOIN range_bits b ON b.key = r.key"""
    return with_views(**v) + """SELECT h.key AS host_id, h.ip, n.cidr, n.label FROM host_bits h JOIN nets n
        ON h.bits IS NOT NULL AND n.bits IS NOT NULL AND n.given BETWEEN 0 AND n.most
       AND left(h.bits, (n.given + 128 - n.most)::INTEGER) = left(n.bits, (n.given + 128 - n.most)::INTEGER)"""


@register("enrich_cidr_families", _families_sql())
def q_cidr_families(spark, sf):
    """G5 over IPv4, IPv6, nested ranges and malformed addresses."""
    ranges = C.cidr_ranges(spark.createDataFrame(FAMILY_RANGES, "cidr string, label string"))
    return C.cidr_match(_hosts(spark, sf), ranges).select("host_id", "ip", "cidr", "label")
