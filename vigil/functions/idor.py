"""Column expressions for the IDOR detection ladder (pure, no data access)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's results.
# Severity labels of an access attempt, in ladder order.
LOG_ONLY = "LOG_ONLY"
LEGITIMATE_ACCESS = "LEGITIMATE_ACCESS"
ALERT_LOW = "ALERT_LOW"
ALERT_MEDIUM = "ALERT_MEDIUM"
CRITICAL = "CRITICAL_IDOR_ATTACK"
# MITRE ATT&CK identifiers used by the mapping.
TACTIC_COLLECTION = "TA0009"
TACTIC_CREDENTIAL_ACCESS = "TA0006"
TECH_INFO_REPOSITORIES = "T1213"
SUBTECH_WEB_APPS = "T1213.002"
TECH_CLOUD_ACCOUNTS = "T1078.004"
# Defaults: 60 s failure window, threshold 3, average gap 10, 24 h ownership TTL.
DEFAULT_WINDOW_SECONDS = 60
DEFAULT_THRESHOLD = 3
DEFAULT_SEQUENTIAL_GAP = 10
DEFAULT_OWNERSHIP_TTL_SECONDS = 86400


def numeric_id(resource: Column, id_mode: str = "suffix") -> Column:
    """Bigint id of a resource string; null if it has none.

    ``strict``: the whole (trimmed) string must be an integer, as Python ``int()``.
    ``suffix``: the trailing run of digits is the id (``loan_4395669`` → 4395669).
    """
    if id_mode == "strict":
        return F.trim(resource).try_cast("bigint")
    if id_mode == "suffix":
        return F.nullif(F.regexp_extract(resource, r"(\d+)$", 1), F.lit("")).try_cast("bigint")
    raise ValueError(f"id_mode must be 'strict' or 'suffix', not {id_mode!r}")


def is_dense(n: Column, least: Column, largest: Column, gap: int = DEFAULT_SEQUENTIAL_GAP) -> Column:
    """≥3 numeric ids whose sorted average gap ``(max-min)/(n-1)`` is ≤ ``gap``.

    Compared exactly in integers: ``max - min <= gap * (n - 1)``.
    """
    return F.coalesce((n >= 3) & (largest - least <= F.lit(gap) * (n - 1)), F.lit(False))


def severity(distinct: Column, sequential: Column, threshold: int = DEFAULT_THRESHOLD) -> Column:
    """Severity ladder over the distinct other-user resources in the window."""
    return (
        F.when(distinct < 2, F.lit(LOG_ONLY))
        .when(distinct == 2, F.lit(ALERT_LOW))
        .when((distinct >= threshold) & sequential, F.lit(CRITICAL))
        .otherwise(F.lit(ALERT_MEDIUM))
    )


def emits_event(distinct: Column, threshold: int = DEFAULT_THRESHOLD) -> Column:
    """A detection event is produced only at or above the threshold (and ≥3)."""
    return (distinct >= threshold) & (distinct >= 3)


def mitre_tactics(sequential: Column, distinct: Column) -> Column:
    return F.when(
        ~sequential & (distinct >= 3), F.array(F.lit(TACTIC_COLLECTION), F.lit(TACTIC_CREDENTIAL_ACCESS))
    ).otherwise(F.array(F.lit(TACTIC_COLLECTION)))


def mitre_techniques(sequential: Column, distinct: Column) -> Column:
    return F.when(
        ~sequential & (distinct >= 3), F.array(F.lit(TECH_INFO_REPOSITORIES), F.lit(TECH_CLOUD_ACCOUNTS))
    ).otherwise(F.array(F.lit(TECH_INFO_REPOSITORIES)))


def mitre_sub_techniques(sequential: Column) -> Column:
    return F.when(sequential, F.array(F.lit(SUBTECH_WEB_APPS))).otherwise(F.array().cast("array<string>"))


def confidence(sequential: Column) -> Column:
    return F.when(sequential, F.lit(0.95)).otherwise(F.lit(0.80))
