"""Sinks and edge checks (A5, A7, A9–A13): SIEM export rows, audit log,
retention tiers, webhook signatures, event search, outbox writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigil.functions import scrub as S
from vigil.functions.telemetry import time_range_start

_US = 1_000_000
DAY_US = 86_400 * _US

# Fixed values that must equal the reference's results.
SIEM_SOURCE, SIEM_SOURCETYPE, SIEM_EVENT_TYPE = "vigil", "idor_detection", "idor_detection_event"
HOT_DAYS, COLD_DAYS = 90, 7 * 365


def siem_record(ev: DataFrame) -> DataFrame:
    """The flat SIEM event (email and ip redacted) and its JSON text."""
    snap = F.col("telemetry_snapshot")
    urls = F.transform(
        F.concat(F.col("mitre_techniques"), F.col("mitre_sub_techniques")),
        lambda t: F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(t, F.lit("."), F.lit("/")), F.lit("/")),
    )
    rec = F.struct(
        F.date_format(F.timestamp_micros("detection_ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.lit(SIEM_SOURCE).alias("source"), F.lit(SIEM_SOURCETYPE).alias("sourcetype"), F.lit(SIEM_EVENT_TYPE).alias("event_type"),
        "event_id", "severity", "user_id", "session_id", "distinct_resources_accessed", "is_sequential", "time_window_seconds",
        "failed_resources", "resource_owners", "mitre_tactics", "mitre_techniques", "mitre_sub_techniques",
        urls.alias("mitre_attack_urls"),
        S.scrub_text(snap["user_email"]).alias("user_email"), S.scrub_text(snap["client_ip"]).alias("client_ip"),
        snap["user_agent"].alias("user_agent"),
        (F.col("severity") == "CRITICAL_IDOR_ATTACK").alias("auto_hold_triggered"),
    )
    return ev.select(
        "event_id", F.to_date(F.timestamp_micros("detection_ts_us")).alias("event_date"), F.to_json(rec).alias("json")
    )


def write_partitioned(df: DataFrame, path: str, partition_col: str, fmt: str = "json", mode: str = "append") -> None:
    """Batch sink partitioned by day (partition pruning on read)."""
    df.write.mode(mode).partitionBy(partition_col).format(fmt).save(path)


def outbox_foreach_batch(path: str, key: str = "event_id"):
    """Streaming outbox: every ``key`` stands once, whatever is replayed.

    A batch's rows are one partition folder (``batch_id``), which a replay of the batch
    overwrites; keys delivered by earlier batches are left out by an anti-join that reads
    their key column only. Rows without a key are all kept."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        field = batch.schema[key]
        known = StructType([StructField(key, field.dataType), StructField("batch_id", LongType())])
        keyed = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            earlier = batch.sparkSession.read.schema(known).parquet(path).filter(F.col("batch_id") < batch_id)
            keyed = keyed.join(earlier.select(key), key, "left_anti").select(batch.columns)
        except AnalysisException as e:  # the first batch: no outbox yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        keyed.unionByName(batch.filter(F.col(key).isNull())).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink


def retention_tier(ts_us: Column, as_of_us) -> Column:
    """Hot ≤ 90 days, cold ≤ 7 years, else drop."""
    age_days = F.floor((F.lit(as_of_us) - ts_us) / F.lit(DAY_US))
    return F.when(age_days <= HOT_DAYS, "hot").when(age_days <= COLD_DAYS, "cold").otherwise("drop")


def hmac_sha256_hex(secret: str, payload: Column) -> Column:
    """HMAC-SHA256 with built-in ``sha2`` (block size 64): H(K⊕opad ‖ H(K⊕ipad ‖ m))."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), payload.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


def signature_valid(payload: Column, header: Column, secret: str | None) -> Column:
    """No secret → valid; otherwise compare with the ``sha256=``-stripped header."""
    if not secret:
        return F.lit(True)
    provided = F.replace(F.coalesce(header, F.lit("")), F.lit("sha256="), F.lit(""))
    return hmac_sha256_hex(secret, payload) == provided


def event_search(events: DataFrame, predicate: str, time_range: str, max_results: int, ts: str = "ts_us", end_us=None) -> DataFrame:
    """Spark SQL predicate + time range back from ``end`` + newest
    ``max_results`` rows (the limit is the feature), every string scrubbed."""
    if end_us is None:
        end_us = events.agg(F.max(ts)).first()[0]  # one scalar: the search end
    end = F.lit(end_us)
    start = time_range_start(F.lit(time_range), end)
    sel = events.filter(F.expr(predicate)).filter((F.col(ts) >= start) & (F.col(ts) <= end))
    top = sel.orderBy(F.col(ts).desc(), F.col("event_id").desc()).limit(max_results)
    return S.scrub_columns(top)
