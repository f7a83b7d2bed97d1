"""UDM rule alerts (A2–A4, C6): nested alert documents with an array of events.

``udm_alerts`` derives alert documents from the access log (one per failure
whose trailing window reaches three distinct resources, carrying the
window's events); ``parse_udm`` reads the JSON text form back with an
explicit schema, ``flatten_udm`` explodes to event grain, ``udm_to_alert``
converts to the standard alert shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import scrub as S
from vigil.functions.text import fmt
from vigil.sources.fixtures import access_log, user_tags

_US = 1_000_000
DAY_US = 86_400 * _US

UDM_EVENT = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("event_type", T.StringType()), T.StructField("event_timestamp", T.StringType()),
        T.StructField("product_name", T.StringType()), T.StructField("vendor_name", T.StringType()),
        T.StructField("log_type", T.StringType()),
    ])),
    T.StructField("network", T.StructType([
        T.StructField("session_id", T.StringType()),
        T.StructField("http", T.StructType([
            T.StructField("method", T.StringType()), T.StructField("response_code", T.IntegerType()),
            T.StructField("user_agent", T.StringType()), T.StructField("referrer", T.StringType()),
            T.StructField("request_headers", T.MapType(T.StringType(), T.StringType())),
            T.StructField("response_headers", T.MapType(T.StringType(), T.StringType())),
        ])),
    ])),
    T.StructField("principal", T.StructType([
        T.StructField("user", T.StructType([
            T.StructField("user_id", T.StringType()), T.StructField("email_addresses", T.ArrayType(T.StringType())),
            T.StructField("user_display_name", T.StringType()),
        ])),
        T.StructField("ip", T.ArrayType(T.StringType())), T.StructField("port", T.IntegerType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("location", T.StructType([
            T.StructField("city", T.StringType()), T.StructField("region_code", T.StringType()),
            T.StructField("country_code", T.StringType()),
        ])),
    ])),
    T.StructField("target", T.StructType([
        T.StructField("url", T.StringType()), T.StructField("hostname", T.StringType()), T.StructField("port", T.IntegerType()),
        T.StructField("resource", T.StructType([
            T.StructField("name", T.StringType()), T.StructField("resource_type", T.StringType()),
            T.StructField("resource_subtype", T.StringType()),
        ])),
    ])),
    T.StructField("security_result", T.ArrayType(T.StructType([
        T.StructField("action", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("rule_name", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
    ]))),
])

UDM_ALERT = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("rule_name", T.StringType()),
    T.StructField("rule_version", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("distinct_resources", T.IntegerType()),
    T.StructField("session_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("risk_score", T.IntegerType()), T.StructField("udm_events", T.ArrayType(UDM_EVENT)),
])

# Fixed values of the rule that raises these alerts (ours) and of the
# standard-alert conversion (alert id, title and description formats).
RULE_ID, RULE_NAME, RULE_VERSION = "ru_idor_seq_enum", "idor_sequential_enumeration", "1.0"
STD_ALERT_ID = "chronicle_{rule}_{ts}"
STD_SOURCE = "chronicle"
STD_TITLE = "Chronicle: {rule}"
STD_DESCRIPTION = "Chronicle YARA-L rule '{rule}' triggered. Detected {n} matching events."
UDM_SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _iso(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def udm_alerts(spark: SparkSession, sf_dir: str, window_seconds: int = 3 * 86400) -> DataFrame:
    """Rule alerts with their UDM events: one per failure whose window holds
    ≥3 distinct failed resources (the event list is the window)."""
    log = access_log(spark, sf_dir).filter(~F.col("success"))
    num = F.regexp_extract("user_id", r"(\d+)$", 1).cast("bigint")
    qa = F.array_contains(user_tags(num), "qa_automation")
    ev = F.struct(
        F.struct(F.lit("HTTP_REQUEST").alias("event_type"), _iso(F.col("ts_us")).alias("event_timestamp"),
                 F.when(qa, F.lit("Lakeside Regression Pack")).otherwise(F.lit("loan-portal")).alias("product_name"),
                 F.lit("Lakeside").alias("vendor_name"), F.lit("WEB_ACCESS").alias("log_type")).alias("metadata"),
        F.struct(F.col("session_id"),
                 F.struct(F.col("http_method").alias("method"), F.col("http_status").alias("response_code"),
                          F.col("user_agent"), F.lit(None).cast("string").alias("referrer"),
                          F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x-datadog-session-id"), F.col("session_id"),
                                                                          F.lit("x-user-email"), F.col("user_email"))).alias("request_headers"),
                          F.create_map(F.lit("x-request-id"), F.col("event_id").cast("string")).alias("response_headers")).alias("http")
                 ).alias("network"),
        F.struct(F.struct(F.col("user_id"), F.array(F.col("user_email")).alias("email_addresses"),
                          F.when(qa, F.lit("QA Automation Bot")).otherwise(F.concat(F.lit("User "), F.col("user_id"))).alias("user_display_name")
                          ).alias("user"),
                 F.array(F.col("client_ip")).alias("ip"), F.lit(443).alias("port"),
                 F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("lake-nb-"), (num % 100).cast("string"))).alias("hostname"),
                 F.struct(F.lit("Springfield").alias("city"), F.lit("IL").alias("region_code"), F.lit("US").alias("country_code")).alias("location")
                 ).alias("principal"),
        F.struct(F.col("request_path").alias("url"), F.lit("loans.internal").alias("hostname"), F.lit(443).alias("port"),
                 F.struct(F.col("resource_id").alias("name"), F.col("resource_type"), F.lit("loan").alias("resource_subtype")).alias("resource")
                 ).alias("target"),
        F.array(F.struct(F.lit("BLOCK").alias("action"), F.lit(RULE_ID).alias("rule_id"), F.lit(RULE_NAME).alias("rule_name"),
                         F.lit("ACCESS_DENIED").alias("category"), F.lit("MEDIUM").alias("severity"),
                         F.concat(F.lit("403 for "), F.col("user_email"), F.lit(" from "), F.col("client_ip")).alias("description"))
                ).alias("security_result"),
    )
    # one alert per failure whose trailing window (the detection window) holds
    # three distinct resources; its events are that window — bounded by the
    # window, never a whole session
    from vigil.operators.windows import sliding_window, window_members

    slim = log.select("session_id", "user_id", "ts_us", "resource_id")
    g = sliding_window(slim, ["session_id"], "ts_us", window_seconds, "resource_id", {"distinct_resources": F.lit(True)})
    g = g.filter(F.col("distinct_resources") >= 3)
    listed = window_members(g, log, ["session_id"], "ts_us", window_seconds, ev, "_evs", F.struct("ts_us", "event_id"))
    g = g.join(listed, ["session_id", "ts_us"]).select(
        "session_id", "user_id", "ts_us", "distinct_resources", F.floor(F.col("ts_us") / F.lit(DAY_US)).alias("day"), "_evs"
    )
    d = F.col("distinct_resources")
    return g.select(
        F.lit(RULE_ID).alias("rule_id"), F.lit(RULE_NAME).alias("rule_name"), F.lit(RULE_VERSION).alias("rule_version"),
        _iso(F.col("ts_us")).alias("timestamp"),
        F.when(d >= 5, F.lit("HIGH")).when(d >= 4, F.lit(None).cast("string")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.when(F.col("day") % 2 == 0, d.cast("int")).alias("distinct_resources"),
        "session_id", "user_id",
        F.least(F.lit(100), (d * 20).cast("int")).alias("risk_score"),
        F.col("_evs").alias("udm_events"),
    )


def udm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts as raw JSON text (the webhook body)."""
    a = udm_alerts(spark, sf_dir)
    return a.select(F.to_json(F.struct(*a.columns)).alias("body"))


def parse_udm(bodies: DataFrame) -> DataFrame:
    """A2: JSON → typed alert; severity defaults to MEDIUM; required fields and
    the risk range become ``errors``."""
    p = bodies.select("body", F.from_json("body", UDM_ALERT).alias("a")).select("body", "a.*")
    errs = F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("rule_id", "rule_name", "timestamp", "udm_events")],
        F.when(F.col("risk_score").isNotNull() & ((F.col("risk_score") < 0) | (F.col("risk_score") > 100)), F.lit("risk_score out of range")),
        F.when(F.col("severity").isNotNull() & ~F.col("severity").isin(*UDM_SEVERITIES), F.lit("invalid severity")),
    )
    return p.withColumn("severity", F.coalesce("severity", F.lit("MEDIUM"))).withColumn(
        "errors", F.filter(errs, lambda e: e.isNotNull())
    )


def flatten_udm(alerts: DataFrame) -> DataFrame:
    """A3: one row per UDM event with dotted-path fields."""
    x = alerts.select("rule_id", "timestamp", "session_id", F.posexplode("udm_events").alias("pos", "e"))
    return x.select(
        "rule_id", F.col("timestamp").alias("alert_timestamp"), "session_id", "pos",
        F.col("e.metadata.event_type").alias("event_type"), F.col("e.metadata.event_timestamp").alias("event_timestamp"),
        F.col("e.metadata.product_name").alias("product_name"),
        F.col("e.network.http.method").alias("http_method"), F.col("e.network.http.response_code").alias("response_code"),
        F.element_at(F.col("e.network.http.request_headers"), F.lit("x-datadog-session-id")).alias("dd_session_id"),
        F.col("e.principal.user.user_id").alias("principal_user_id"),
        F.element_at(F.col("e.principal.ip"), 1).alias("principal_ip"),
        F.col("e.principal.hostname").alias("principal_hostname"),
        F.col("e.target.url").alias("target_url"), F.col("e.target.resource.name").alias("resource_name"),
        F.element_at(F.col("e.security_result"), 1)["action"].alias("security_action"),
    )


def scrub_udm(alerts: DataFrame) -> DataFrame:
    """Every string leaf of the nested alert scrubbed before enrichment."""
    return S.scrub_columns(alerts)


def udm_to_alert(alerts: DataFrame, sample: int = 3) -> DataFrame:
    """A4: standard alert with the first three (scrubbed) UDM events."""
    scrubbed = scrub_udm(alerts.select(*[c for c in UDM_ALERT.fieldNames()]))
    n = F.size("udm_events")
    return scrubbed.select(
        fmt(STD_ALERT_ID, rule=F.col("rule_id"), ts=F.col("timestamp")).alias("alert_id"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.lit(STD_SOURCE).alias("source"),
        fmt(STD_TITLE, rule=F.col("rule_name")).alias("title"),
        fmt(STD_DESCRIPTION, rule=F.col("rule_name"), n=F.coalesce(F.nullif(F.col("distinct_resources"), F.lit(0)), n)).alias("description"),
        F.col("timestamp"),
        F.col("user_id").alias("affected_user"),
        F.struct(
            F.col("rule_id").alias("chronicle_rule_id"), F.col("rule_version").alias("chronicle_rule_version"),
            F.col("risk_score").alias("chronicle_risk_score"), n.alias("udm_event_count"), F.col("distinct_resources"),
            F.col("session_id"), F.slice("udm_events", 1, sample).alias("udm_sample_events"),
        ).alias("raw_data"),
    )


def udm_search_text(alert_df: DataFrame) -> Column:
    """Text the QA / insider rules read from sample UDM events (product and
    display names, user ids, hostnames, security-result descriptions)."""
    ev = F.col("raw_data.udm_sample_events")
    parts = F.transform(ev, lambda e: F.concat_ws(
        " ", F.coalesce(e["metadata"]["product_name"], F.lit("")), F.coalesce(e["principal"]["user"]["user_display_name"], F.lit("")),
        F.coalesce(e["principal"]["user"]["user_id"], F.lit("")), F.coalesce(e["principal"]["hostname"], F.lit("")),
        F.array_join(F.transform(F.coalesce(e["security_result"], F.array()), lambda s: F.coalesce(s["description"], F.lit(""))), " "),
    ))
    return F.concat(F.lit(" "), F.array_join(parts, " "))
