"""Engine inputs derived from the driver's tables (see FIXTURES.md, part 2).

Each builder returns a lazy DataFrame over the given parquet tables, so its
work grows with them. The matching DuckDB view text lives in
``vigil.plans.oracle_views`` and must describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.tables import table


def raw_time_filter(col: str, since_us: int | None, until_us: int | None) -> Column:
    """A range on a raw (NTZ) timestamp column written with NTZ literals, so
    parquet receives it as ``PushedFilters`` (row-group skipping)."""
    import datetime as _dt

    def lit(us):
        return F.lit(_dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=int(us))).cast("timestamp_ntz")

    cond = F.lit(True)
    if since_us is not None:
        cond = cond & (F.col(col) >= lit(since_us))
    if until_us is not None:
        cond = cond & (F.col(col) <= lit(until_us))
    return cond


def max_time_us(spark: SparkSession, sf_dir: str, name: str, col: str) -> int:
    """``as_of`` default: the latest instant of a table column (one scalar)."""
    return table(spark, sf_dir, name).agg(F.max(epoch_us(col))).first()[0]


def epoch_us(col: Column | str) -> Column:
    """Event time as epoch microseconds (UTC); works for TIMESTAMP and TIMESTAMP_NTZ."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def access_log(spark: SparkSession, sf_dir: str, id_prefix: str = "", since_us=None, until_us=None) -> DataFrame:
    """Web access events: one row per request, event time ``ts_us``, path
    ``/api/v{1|2}/consumer/loan_applications/<id>``.

    user = ``user_<id>``, session = ``sess_<id>``, resource id = ``props.k``
    (optionally prefixed), success = not an error, owner by ``event_id % 5``:
    0 → unknown (NULL), 1 → the requesting user, else ``user_<id+1+k>``.
    """
    ev = table(spark, sf_dir, "events")
    if since_us is not None or until_us is not None:
        ev = ev.filter(raw_time_filter("ts", since_us, until_us))  # pushed into the scan
    return access_log_from_events(ev, id_prefix)


def access_log_from_events(events: DataFrame, id_prefix: str = "") -> DataFrame:
    """The access-log projection of an ``events`` DataFrame (batch or stream)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k")
    kb = k.cast("bigint")
    uid = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return ev.select(
        F.col("event_id"),
        epoch_us("ts").alias("ts_us"),
        uid.alias("user_id"),
        F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit(id_prefix), k).alias("resource_id"),
        F.lit("loan_application").alias("resource_type"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 5 == 1, uid)
        .otherwise(F.concat(F.lit("user_"), (F.col("user_id") + 1 + kb).cast("string")))
        .alias("resource_owner_id"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") != "error", 200).otherwise(403).alias("http_status"),
        F.lit("GET").alias("http_method"),
        F.concat(
            F.lit("/api/v"), (F.col("event_id") % 2 + 1).cast("string"), F.lit("/consumer/loan_applications/"),
            F.lit(id_prefix), k,
        ).alias("request_path"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.example.com")).alias("user_email"),
        F.concat(F.lit("10.20."), (F.col("user_id") % 256).cast("string"), F.lit("."), k).alias("client_ip"),
        F.concat(F.lit("agent/"), F.col("event_type")).alias("user_agent"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


# --- alerts -------------------------------------------------------------------------
# Sample values of our own (not the reference's): description phrases chosen by
# doc_id % 7, hosts by doc_id % 5, users by doc_id % 6.
ALERT_PHRASES = [
    "Port sweep by patch scanner 10.77.8.0/24 observed",
    "powershell.exe launched with -enc by svc_snapshot",
    "Remote service created on a ledger host at night",
    "Sequential enumeration of loan applications",
    "staff member browsing borrowers without a case",
    "Lakeside Regression Pack triggered access checks",
    "Routine authentication event",
]
ALERT_HOSTS = [
    "ledger-pg-2.lan",
    "EDGE-PROXY-1.lan",
    "lake-nb-042",
    "ws-1234.branch.lan",
    "build-agent-7",
]
ALERT_USERS = [
    "ops_db_admin",
    "jdoe",
    "svc_recon",
    "staff_4411",
    "synthetic_07",
    "jane.doe@example.com",
]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security alerts derived from ``documents`` (+ ``labels``); the whole
    document text is part of the description."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    d = F.col("doc_id")
    return docs.select(
        F.concat(F.lit("alert_"), d.cast("string")).alias("alert_id"),
        d.alias("doc_id"),
        _pick(SEVERITIES, d % 4).alias("severity"),
        F.col("source"),
        F.concat(F.lit("Document alert "), d.cast("string"), F.lit(" ("), F.col("lang"), F.lit(")")).alias("title"),
        F.concat(_pick(ALERT_PHRASES, d % 7), F.lit(" "), F.coalesce(F.col("text"), F.lit(""))).alias("description"),
        F.date_format(
            F.timestamp_seconds(F.lit(1704067200) + d * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        ).alias("timestamp"),
        _pick(ALERT_USERS, d % 6).alias("affected_user"),
        _pick(ALERT_HOSTS, d % 5).alias("affected_host"),
        F.array(
            F.concat(F.lit("ioc-"), (d % 500 + 1).cast("string")),
            F.concat(F.lit("10.0.0."), (d % 100 + 1).cast("string")),
            F.md5(d.cast("string")),
            F.concat(F.lit("evil-"), (d % 13).cast("string"), F.lit(".example.net")),
            F.sha2(d.cast("string"), 256),
            F.concat(F.lit("http://bad.example.org/p/"), (d % 17).cast("string")),
        ).alias("iocs"),
        (d % 6).cast("bigint").alias("distinct_resources"),
    )


def customer_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SSN / phone / passport / email strings formatted from ``c_custkey``."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    p9 = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    p10 = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    ssn = F.concat_ws("-", F.substring(p9, 1, 3), F.substring(p9, 4, 2), F.substring(p9, 6, 4))
    sep = F.when(F.col("c_custkey") % 3 == 0, "-").when(F.col("c_custkey") % 3 == 1, ".").otherwise("")
    phone = F.concat(F.substring(p10, 1, 3), sep, F.substring(p10, 4, 3), sep, F.substring(p10, 7, 4))
    passport = F.concat(F.lit("X"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    card = F.concat_ws(" ", F.lit("4111"), F.substring(p10, 1, 4), F.substring(p10, 5, 4), F.lpad(F.substring(p10, 9, 2), 4, "0"))
    email = F.concat(F.lit("cust"), F.col("c_custkey").cast("string"), F.lit("@bank.example.com"))
    text = F.concat(
        F.lit("Customer "), F.col("c_name"), F.lit(" ssn "), ssn, F.lit(" phone "), phone,
        F.lit(" passport "), passport, F.lit(" card "), card, F.lit(" mail "), email,
        F.lit(" from 172.16."), (F.col("c_custkey") % 256).cast("string"), F.lit(".9"),
    )
    return c.select("c_custkey", "c_nationkey", ssn.alias("ssn"), phone.alias("phone"),
                    passport.alias("passport"), card.alias("card"), email.alias("email"), text.alias("text"))


def conversations_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested messages, one row per turn (no grouping: a long conversation never
    gathers in one task): ``msg struct<role, body struct<text, lines array>,
    meta map<string,string>>``."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conv.select(
        "conv_id", "turn",
        F.struct(
            F.col("role"),
            F.struct(F.col("text"), F.split(F.col("text"), "\n").alias("lines")).alias("body"),
            F.create_map(F.lit("role"), F.col("role"), F.lit("first_line"), F.split(F.col("text"), "\n").getItem(0)).alias("meta"),
        ).alias("msg"),
    )


def ownership_ops(spark: SparkSession, sf_dir: str, removes: bool = False, clears: bool = False) -> DataFrame:
    """Ownership log from the access log: successes record; optionally a
    purchase with ``event_id % 7 = 3`` removes that resource (transfer) and a
    signup with ``event_id % 11 = 4`` clears the user's set."""
    log = access_log(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    ops = log.filter("success").select("user_id", "resource_id", "ts_us", F.lit("record").alias("op"))
    if removes or clears:
        tagged = log.join(ev, "event_id")
        if removes:
            ops = ops.unionByName(
                tagged.filter((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 3)).select(
                    "user_id", "resource_id", "ts_us", F.lit("remove").alias("op")
                )
            )
        if clears:
            ops = ops.unionByName(
                tagged.filter((F.col("event_type") == "signup") & (F.col("event_id") % 11 == 4)).select(
                    "user_id", F.lit(None).cast("string").alias("resource_id"), "ts_us", F.lit("clear").alias("op")
                )
            )
    return ops


def ownership_bulk_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk ownership loads: one row per (customer, order date) with the list of
    order keys (bounded: one customer's orders of one day)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.groupBy("o_custkey", "o_orderdate").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("resource_ids")).select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("user_id"),
        "resource_ids",
        epoch_us("o_orderdate").alias("ts_us"),
    )


def _http_parts(k: Column, c: Column, prio: Column, status: Column) -> dict[str, Column]:
    """Column rules of the request fixture (shared by the map and the oracle)."""
    ks, cs = k.cast("string"), c.cast("string")
    hexs = F.md5(ks)
    uuid = F.concat_ws("-", F.substring(hexs, 1, 8), F.substring(hexs, 9, 4), F.substring(hexs, 13, 4),
                       F.substring(hexs, 17, 4), F.substring(hexs, 21, 12))
    path = (
        F.when(k % 10 == 5, F.concat(F.lit("/api/v2/consumer/loan_applications/"), ks))
        .when(k % 10 == 9, F.concat(F.lit("/api/loans/"), uuid))
        .when(k % 5 == 0, F.concat(F.lit("/consumer/loan_applications/"), ks))
        .when(k % 5 == 1, F.concat(F.lit("/api/v"), (k % 2 + 1).cast("string"), F.lit("/loans/L"), ks))
        .when(k % 5 == 2, F.concat(F.lit("/accounts/acc-"), ks))
        .when(k % 5 == 3, F.concat(F.lit("/documents/doc_"), ks))
        .otherwise(F.concat(F.lit("/static/page/"), ks))
    )
    return {
        "path": path,
        "method": F.when(k % 11 == 0, "POST").otherwise("GET"),
        "status": F.when(status == "O", 200).when(status == "F", 403).otherwise(404),
        "client_host": F.concat(F.lit("192.0.2."), (c % 256).cast("string")),
        "X-User-Id": F.when(k % 13 != 0, F.concat(F.lit("cust_"), cs)),
        "x-user-email": F.concat(F.lit("c"), cs, F.lit("@shop.example.com")),
        "X-Datadog-Session-Id": F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("dd-"), cs)),
        "x-datadog-view-id": F.concat(F.lit("view-"), ks),
        "x-datadog-application-id": F.lit("app-1"),
        "CF-Ray": F.when(k % 17 != 0, F.concat(F.lit("ray-"), ks)),
        "x-pageload-id": F.concat(F.lit("pl-"), ks),
        "User-Agent": F.concat(F.lit("Mozilla/5.0 ("), prio, F.lit(")")),
        "X-Forwarded-For": F.when(k % 3 == 0, F.concat(F.lit("203.0.113."), (k % 256).cast("string"), F.lit(", 10.0.0.1"))),
        "Cookie": F.when(k % 4 == 0, F.concat(F.lit("theme=dark; session_id=sid-"), cs, F.lit("; lang=en"))),
        "Authorization": F.when(k % 4 == 1, F.concat(F.lit("Bearer tok."), cs)),
        "X-Acme-Id": F.when(k % 4 == 2, F.concat(F.lit("acme-"), cs)),
    }


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTTP requests (one per order): path, method, status, peer address
    and a header map with mixed-case names; absent headers are left out."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    parts = _http_parts(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus"))
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in parts.items() if n[0].isalpha() and n not in ("path", "method", "status", "client_host")])
    headers = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        parts["path"].alias("path"),
        parts["method"].alias("method"),
        parts["status"].alias("status"),
        parts["client_host"].alias("client_host"),
        headers.alias("headers"),
        epoch_us("o_orderdate").alias("ts_us"),
    )


# --- context histories ----------------------------------------------------------------
def ioc_sightings(spark: SparkSession, sf_dir: str, since_us=None, until_us=None) -> DataFrame:
    """Indicator sightings: indicator ``ioc-<partkey>`` on asset ``host-<suppkey>`` at ship date."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    li = li.filter(raw_time_filter("l_shipdate", since_us, until_us))
    return li.select(
        F.concat(F.lit("ioc-"), F.col("l_partkey").cast("string")).alias("indicator"),
        F.concat(F.lit("host-"), F.col("l_suppkey").cast("string")).alias("asset"),
        epoch_us("l_shipdate").alias("ts_us"),
    )


def supplier_ip(col: Column) -> Column:
    return F.concat(F.lit("10.0."), (F.floor(col / 256) % 256).cast("string"), F.lit("."), (col % 256).cast("string"))


def network_connections(spark: SparkSession, sf_dir: str, since_us=None, until_us=None) -> DataFrame:
    """Connections: remote ip from ``l_suppkey``, local asset ``host-<partkey % 50>``."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    li = li.filter(raw_time_filter("l_shipdate", since_us, until_us))
    return li.select(
        supplier_ip(F.col("l_suppkey")).alias("ip"),
        F.concat(F.lit("host-"), (F.col("l_partkey") % 50).cast("string")).alias("asset"),
        epoch_us("l_shipdate").alias("ts_us"),
    )


def ip_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return s.select(supplier_ip(F.col("s_suppkey")).alias("ip"), (F.abs(F.floor(F.col("s_acctbal"))) % 100).cast("int").alias("reputation_score"))


def logins(spark: SparkSession, sf_dir: str, since_us=None, until_us=None) -> DataFrame:
    """Login history: each event is a login; location = nation of the customer
    with ``c_custkey = user_id``, agent = event type, ip = access-log ip."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    ev = ev.filter(raw_time_filter("ts", since_us, until_us))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = ev.join(cu, ev.user_id == cu.c_custkey, "left").join(F.broadcast(na), F.col("c_nationkey") == na.n_nationkey, "left")
    k = F.get_json_object("props", "$.k")
    return j.select(
        "event_id",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
        epoch_us("ts").alias("ts_us"),
        F.coalesce(F.col("n_name"), F.lit("UNKNOWN")).alias("location"),
        F.concat(F.lit("10.20."), (F.col("user_id") % 256).cast("string"), F.lit("."), (k.cast("int") % 4).cast("string")).alias("ip"),
        F.col("event_type").alias("agent"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return o.filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("deploy_id"),
        F.concat(F.lit("ep-"), (F.col("o_custkey") % 10).cast("string")).alias("endpoint"),
        epoch_us("o_orderdate").alias("ts_us"),
    )


def endpoint_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag")
    return li.filter(F.col("l_returnflag") == "R").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("alert_key"),
        F.concat(F.lit("ep-"), (F.col("l_suppkey") % 10).cast("string")).alias("endpoint"),
        epoch_us("l_shipdate").alias("ts_us"),
    )


DISPOSITIONS = ["TP", "FP", "BTP", "Escalated"]


def history_vectors(spark: SparkSession, sf_dir: str, every: int = 10):
    """(queries, corpus): every ``every``-th ``vec_id`` is an alert under triage, the
    rest is history with a disposition from ``label % 4`` and a note; both grow with the table."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    vec = F.col("embedding").cast("array<double>")
    base = e.select("vec_id", vec.alias("v"), "label")
    queries = base.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    corpus = base.filter(F.col("vec_id") % every != 0).select(
        "vec_id", "v",
        _pick(DISPOSITIONS, F.col("label") % 4).alias("disposition"),
        F.concat(F.lit("Analyst note for case "), F.col("vec_id").cast("string")).alias("analyst_notes"),
    )
    return queries, corpus


def user_tags(user_num: Column) -> Column:
    """Analyst tags of a user: ``qa_automation`` when id % 13 = 0, ``pentester`` when id % 17 = 0."""
    return F.filter(
        F.array(F.when(user_num % 13 == 0, F.lit("qa_automation")), F.when(user_num % 17 == 0, F.lit("pentester"))),
        lambda x: x.isNotNull(),
    )


def cdn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDN firewall blocks: signup events, same session rule as the access log."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return ev.filter(F.col("event_type") == "signup").select(
        "event_id", F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"), epoch_us("ts").alias("ts_us")
    )


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as raw XML-ish text, one per labelled document; a few are
    malformed by modulus (bad enum, out-of-range confidence, short reasoning,
    blank actions, missing result tag, no actions)."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = F.col("doc_id")
    result = (
        F.when(d % 11 == 3, F.lit("MAYBE"))
        .when(F.col("quality") == 0, F.lit("FALSE_POSITIVE"))
        .when(F.col("toxic") == 1, F.lit("CRITICAL_IDOR_ATTACK"))
        .otherwise(F.lit("NEEDS_INVESTIGATION"))
    )
    conf = F.when(d % 13 == 5, F.lit("1.5")).when(d % 13 == 6, F.lit("-0.1")).otherwise(
        F.format_string("%.2f", F.lit(0.5) + (d % 50) / F.lit(100.0))
    )
    reasoning = F.when(d % 17 == 7, F.lit(" short ")).otherwise(
        F.concat(F.lit("\n  Analyst-grade reasoning for document "), d.cast("string"), F.lit(".\n"))
    )
    actions = (
        F.when(d % 19 == 2, F.lit("<action>   </action>"))
        .when(d % 19 == 3, F.lit(""))
        .otherwise(F.concat(F.lit("<action> Review document "), d.cast("string"), F.lit(" </action><action>Notify owner</action>")))
    )
    ioc = F.when(d % 7 == 0, F.lit("<ioc>  </ioc>")).otherwise(F.concat(F.lit("<ioc> ioc-"), d.cast("string"), F.lit(" </ioc>")))
    res_tag = F.when(d % 23 == 4, F.lit("")).otherwise(F.concat(F.lit("<result> "), result, F.lit(" </result>")))
    text = F.concat(
        F.lit("<triage_analysis>\n"), res_tag, F.lit("\n<confidence>"), conf, F.lit("</confidence>\n<reasoning>"), reasoning,
        F.lit("</reasoning>\n"), actions, F.lit("\n"), ioc, F.lit("\n</triage_analysis>"),
    )
    return lab.select(F.concat(F.lit("alert_"), d.cast("string")).alias("alert_id"), d.alias("doc_id"), text.alias("response_text"))


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as received, some broken: unknown severity (doc_id % 23 = 0),
    missing description (% 29 = 0), bad timestamp (% 31 = 0), empty title (% 37 = 0)."""
    a = alerts(spark, sf_dir)
    d = F.col("doc_id")
    return a.select(
        "alert_id", "doc_id",
        F.when(d % 23 == 0, F.lit("SEVERE")).otherwise(F.col("severity")).alias("severity"),
        "source",
        F.when(d % 37 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.when(d % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("description")).alias("description"),
        F.when(d % 31 == 0, F.lit("yesterday")).otherwise(F.col("timestamp")).alias("timestamp"),
        "affected_user", "affected_host", "iocs",
    )


def edr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDR host events from ``lineitem``: endpoint by order (``l_orderkey % 100``,
    so an order's lines form one process tree on one host), process from the
    return flag, remote ip from the part, action/tactic/technique by rule."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                                                  "l_linestatus", "l_shipdate")
    rf, ls, ln = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("ep-"), (F.col("l_orderkey") % 100).cast("string")).alias("endpoint_id"),
        F.col("l_orderkey").alias("alert_id"),
        (F.col("l_orderkey") * 10 + ln).alias("process_id"),
        F.when(ln > 1, F.col("l_orderkey") * 10 + ln - 1).alias("parent_process_id"),
        F.concat(F.lit("proc_"), F.lower(rf), F.lit(".exe")).alias("process_name"),
        F.concat(F.lit("C:\\data\\file_"), ln.cast("string"), F.lit(".dat")).alias("file_path"),
        F.concat(F.lit("198.18."), (F.floor(F.col("l_partkey") / 256) % 256).cast("string"), F.lit("."),
                 (F.col("l_partkey") % 256).cast("string")).alias("remote_ip"),
        F.when((rf == "R") & (ls == "F"), "process_injected").when(rf == "R", "registry_value_set")
        .when(ls == "F", "network_connection").otherwise("process_created").alias("action"),
        F.element_at(F.array(*[F.lit(x) for x in ["TA0004", "TA0003", "TA0010", "TA0008", "TA0002"]]), (ln % 5 + 1).cast("int")).alias("tactic"),
        F.element_at(F.array(*[F.lit(x) for x in ["T1547", "T1021", "T1055", "T1059"]]), (ln % 4 + 1).cast("int")).alias("technique"),
        F.concat(F.lit("threat-"), rf).alias("threat_name"),
        epoch_us("l_shipdate").alias("ts_us"),
    )
