"""Request → telemetry projection (B1, B4–B6, B13) over a requests DataFrame.

Input: ``request_id, path, method, status, client_host, headers map`` (+ any
explicit ``resource_id`` / ``resource_type`` / ``resource_owner_id`` columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import telemetry as T


def extract_telemetry(requests: DataFrame, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """B1: headers → user (default ``unknown``), email, RUM/CDN ids, agent,
    client ip; resource from the URL unless explicit values are given;
    defaults resource type ``other`` and id ``unknown``."""
    h = T.lower_keys(F.col("headers"))
    cols = set(requests.columns)
    ex_id = F.col("resource_id") if "resource_id" in cols else F.lit(None).cast("string")
    ex_type = F.col("resource_type") if "resource_type" in cols else F.lit(None).cast("string")
    url_type, url_id = T.url_resource(F.col("path"), patterns)
    need_url = ex_id.isNull() | ex_type.isNull()
    rtype = F.coalesce(ex_type, F.when(need_url, url_type))
    rid = F.coalesce(F.nullif(ex_id, F.lit("")), F.when(need_url, F.nullif(url_id, F.lit(""))))
    out = requests.select(
        "*",
        F.coalesce(T.header(h, T.H_USER_ID), F.lit("unknown")).alias("t_user_id"),
        T.header(h, T.H_USER_EMAIL).alias("user_email"),
        T.header(h, T.H_DD_SESSION).alias("datadog_session_id"),
        T.header(h, T.H_DD_VIEW).alias("datadog_view_id"),
        T.header(h, T.H_DD_APP).alias("datadog_application_id"),
        T.header(h, T.H_CF_RAY).alias("cf_ray_id"),
        T.header(h, T.H_CF_PAGELOAD).alias("cf_pageload_id"),
        T.header(h, T.H_USER_AGENT).alias("user_agent"),
        T.client_ip(h, F.col("client_host")).alias("client_ip"),
        F.coalesce(rtype, F.lit("other")).alias("t_resource_type"),
        F.coalesce(rid, F.lit("unknown")).alias("t_resource_id"),
    )
    drop = [c for c in ("resource_id", "resource_type") if c in cols]
    out = out.drop(*drop).withColumnRenamed("t_resource_type", "resource_type").withColumnRenamed("t_resource_id", "resource_id")
    out = out.withColumnRenamed("t_user_id", "user_id")
    return out.withColumn("session_id", T.session_identifier(F.col("datadog_session_id"), F.col("cf_ray_id")))


def validate_telemetry(tel: DataFrame) -> DataFrame:
    """``issues`` array and ``is_valid``."""
    iss = T.validation_issues(F.col("user_id"), F.col("session_id"), F.col("resource_id"), F.col("resource_type"))
    return tel.withColumn("issues", iss).withColumn("is_valid", F.size("issues") == 0)


def route_status(requests: DataFrame) -> DataFrame:
    """200 → success, 403 → failure; every other status is not tracked."""
    s = F.when(F.col("status") == 200, F.lit(True)).when(F.col("status") == 403, F.lit(False))
    return requests.withColumn("success", s).filter(F.col("success").isNotNull())
