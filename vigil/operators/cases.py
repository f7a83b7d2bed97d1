"""Case, SOAR and annotation projections (I1–I11) over detection events.

Outputs are append-only outbox tables (delivery over HTTP is not part of
the engine); each is a projection of the detection-event DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import scrub as S
from vigil.functions.telemetry import soar_severity, servicenow_urgency, xsoar_severity
from vigil.functions.text import fmt

# Fixed values that must equal the reference's results: payload constants and
# text templates of the SOAR, case and annotation outputs.
SOURCE = "idor_detection_middleware"
TITLE = "IDOR Attack Detected: {user}"
SN_TEMPLATE_SHORT = "IDOR Attack: {user} - {distinct} resources"
XSOAR_TEMPLATE_NAME = "IDOR Enumeration Attack - {user}"
MITRE_PREFIX = "https://attack.mitre.org/techniques/"
DESC_HEAD = [
    "IDOR enumeration attack detected against user {user}.",
    "",
    "Attack Pattern:",
    "- Accessed {distinct} distinct resources owned by other users",
    "- Sequential access: {seq}",
    "- Time window: {tw} seconds",
    "- Session: {session}",
    "",
    "Failed Resources:",
]
DESC_SEQ_YES, DESC_SEQ_NO = "YES (high confidence)", "NO"
DESC_RESOURCE = "  - {res} (owner: {owner})"
DESC_MORE = "  ... and {n} more"
DESC_TAIL = ["", "Evidence:", "- Request path: {path}", "- Client IP: {ip}", "- User Agent: {agent}"]
SPLUNK_TAGS = ["idor", "enumeration", "ownership-violation"]
XSOAR_TYPE = "IDOR Enumeration"
SN_IMPACT, SN_CATEGORY, SN_SUBCATEGORY = "2", "Security", "Unauthorized Access"
CASE_DESC = (
    "Ownership-aware monitor detected IDOR enumeration attack.\n\nUser: {user}\nSession: {session}\n"
    "Distinct Resources: {distinct}\nTime Window: {tw}s\n\nFailed Resources: {failed}\nResource Owners: {owners}\n\n"
    "Detection Logic: {logic} access pattern detected."
)
CASE_TITLE = "IDOR Attack Detected: {severity}"
CASE_REASONING = "Ownership-aware IDOR detection: {distinct} unauthorized access attempts to other users' resources."
CASE_SEVERITY = {"CRITICAL_IDOR_ATTACK": "CRITICAL", "ALERT_MEDIUM": "MEDIUM", "ALERT_LOW": "LOW"}
ANNOTATION_TEXT = (
    "IDOR Attack Detected (AI Confidence: 95%): User attempted unauthorized access to {distinct} resources owned by "
    "other users. Pattern: {logic}. MITRE: {techs}."
)
LOGIC_SEQ, LOGIC_NON_SEQ = "Sequential", "Non-sequential"
CONFIDENCE_SEQ, CONFIDENCE_OTHER = 0.95, 0.80
CASE_ASSIGNEE = "soc_tier2"
ANNOTATION_TAGS = ["idor_attack", "ownership_violation", "automated_detection"]
ANNOTATION_TYPE = "ai_idor_detection"
ANNOTATED_BY = "vigil-idor-monitor"
MAX_DESCRIBED = 5
MAX_ANNOTATED = 5
INCIDENT_ID_KEYS = ["id", "incident_id", "incidentId", "container_id", "sys_id", "incidentNumber"]


def iso_timestamp(ts_us: Column) -> Column:
    """Python ``datetime.isoformat()`` of a naive UTC instant (micros only when non-zero)."""
    base = F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.pmod(ts_us, F.lit(1_000_000))
    return F.when(frac == 0, base).otherwise(F.concat(base, F.lit("."), F.lpad(frac.cast("string"), 6, "0")))


def mitre_urls(techniques: Column) -> Column:
    """One URL per technique, ``.`` → ``/``."""
    return F.transform(techniques, lambda t: F.concat(F.lit(MITRE_PREFIX), F.replace(t, F.lit("."), F.lit("/")), F.lit("/")))


def description(ev: DataFrame) -> Column:
    """Multi-line text; the first five failed resources each with its own owner."""
    seq = F.when(F.col("is_sequential"), F.lit(DESC_SEQ_YES)).otherwise(F.lit(DESC_SEQ_NO))
    cols = dict(user=F.col("user_id"), distinct=F.col("distinct_resources_accessed"), seq=seq,
                tw=F.col("time_window_seconds"), session=F.col("session_id"))
    head = F.concat_ws("\n", *[fmt(line, **cols) for line in DESC_HEAD])
    pairs = F.slice(F.arrays_zip(F.col("failed_resources").alias("r"), F.col("failed_owners").alias("o")), 1, MAX_DESCRIBED)
    lines = F.array_join(F.transform(pairs, lambda p: fmt(DESC_RESOURCE, res=p["r"], owner=p["o"])), "\n")
    n = F.size("failed_resources")
    more = F.when(n > MAX_DESCRIBED, fmt(DESC_MORE, n=n - MAX_DESCRIBED))
    snap = F.col("telemetry_snapshot")
    tail_cols = dict(
        path=F.coalesce(snap["request_path"], F.lit("None")),
        ip=F.coalesce(F.nullif(snap["client_ip"], F.lit("")), F.lit("unknown")),
        agent=F.coalesce(F.nullif(snap["user_agent"], F.lit("")), F.lit("unknown")),
    )
    tail = F.concat_ws("\n", *[fmt(line, **tail_cols) for line in DESC_TAIL])
    return F.concat_ws("\n", head, F.when(F.size(pairs) > 0, lines), more, tail)


def common_payload(ev: DataFrame, auto_hold: Column | None = None) -> DataFrame:
    """The platform-independent payload."""
    hold = auto_hold if auto_hold is not None else (F.col("severity") == "CRITICAL_IDOR_ATTACK")
    snap = F.col("telemetry_snapshot")
    return ev.select(
        "event_id",
        fmt(TITLE, user=F.col("user_id")).alias("title"),
        description(ev).alias("description"),
        soar_severity(F.col("severity")).alias("soar_severity"),
        F.lit(SOURCE).alias("source"),
        iso_timestamp(F.col("detection_ts_us")).alias("timestamp"),
        "user_id", "session_id", F.col("distinct_resources_accessed").alias("distinct_resources"), "is_sequential",
        "failed_resources", "resource_owners", "time_window_seconds",
        snap["user_email"].alias("user_email"), snap["client_ip"].alias("client_ip"),
        snap["user_agent"].alias("user_agent"), snap["request_path"].alias("request_path"),
        hold.alias("auto_hold"),
        "mitre_tactics", "mitre_techniques", "mitre_sub_techniques",
        mitre_urls(F.col("mitre_techniques")).alias("mitre_attack_urls"),
        "severity",
    )


def splunk_container(common: DataFrame) -> DataFrame:
    """I4."""
    return common.select(
        "event_id",
        F.struct(
            F.struct(F.col("title").alias("name"), "description", F.col("soar_severity").alias("severity"),
                     F.lit("security").alias("label"), F.array(*[F.lit(t) for t in SPLUNK_TAGS]).alias("tags")).alias("container"),
            F.array(F.struct(
                F.lit("IDOR Detection Event").alias("name"),
                F.struct(F.col("user_id").alias("sourceUserId"), F.col("session_id").alias("sessionId"),
                         F.col("request_path").alias("requestPath"), F.col("distinct_resources").alias("resourcesAccessed")).alias("cef"),
                F.lit("event").alias("label"),
            )).alias("artifacts"),
        ).alias("payload"),
    )


def xsoar_incident(common: DataFrame) -> DataFrame:
    """I5."""
    return common.select(
        "event_id",
        F.struct(
            F.col("title").alias("name"), F.lit(XSOAR_TYPE).alias("type"), xsoar_severity(F.col("soar_severity")).alias("severity"),
            F.col("description").alias("details"),
            F.struct(F.col("user_id").alias("userid"), F.col("session_id").alias("sessionid"),
                     F.col("distinct_resources").alias("distinctresources"), F.col("is_sequential").alias("issequential"),
                     F.col("auto_hold").alias("autohold")).alias("customFields"),
        ).alias("payload"),
    )


def servicenow_incident(common: DataFrame) -> DataFrame:
    """I6."""
    return common.select(
        F.col("title").alias("short_description"), "description",
        servicenow_urgency(F.col("soar_severity")).alias("urgency"),
        F.lit(SN_IMPACT).alias("impact"), F.lit(SN_CATEGORY).alias("category"), F.lit(SN_SUBCATEGORY).alias("subcategory"),
        F.col("event_id").alias("u_event_id"), F.col("user_id").alias("u_user_id"), F.col("session_id").alias("u_session_id"),
    )


def _logic(seq: Column) -> Column:
    return F.when(seq, F.lit(LOGIC_SEQ)).otherwise(F.lit(LOGIC_NON_SEQ))


def _confidence(seq: Column) -> Column:
    return F.when(seq, F.lit(CONFIDENCE_SEQ)).otherwise(F.lit(CONFIDENCE_OTHER))


def case_rows(ev: DataFrame, scrub: bool = False) -> DataFrame:
    """I7 (+E16): one case per CRITICAL detection."""
    crit = ev.filter(F.col("severity") == "CRITICAL_IDOR_ATTACK")
    desc = fmt(
        CASE_DESC, user=F.col("telemetry_snapshot.user_id"), session=F.col("session_id"),
        distinct=F.col("distinct_resources_accessed"), tw=F.col("time_window_seconds"),
        failed=F.array_join("failed_resources", ", "), owners=F.array_join("resource_owners", ", "),
        logic=_logic(F.col("is_sequential")),
    )
    sev = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in CASE_SEVERITY.items() for x in (F.lit(k), F.lit(v))]), F.col("severity")), F.lit("INFO")
    )
    out = crit.select(
        F.col("event_id").alias("alert_id"),
        fmt(CASE_TITLE, severity=F.col("severity")).alias("title"),
        desc.alias("description"),
        sev.alias("severity"),
        F.col("user_id").alias("affected_user"),
        fmt(CASE_REASONING, distinct=F.col("distinct_resources_accessed")).alias("ai_reasoning"),
        _confidence(F.col("is_sequential")).alias("confidence_score"),
        "mitre_tactics", "mitre_techniques",
        F.lit(CASE_ASSIGNEE).alias("assigned_to"),
        F.when(F.col("severity") == "CRITICAL_IDOR_ATTACK", F.lit("high")).otherwise(F.lit("medium")).alias("priority"),
    )
    if scrub:
        out = S.scrub_columns(out, ["description", "affected_user", "ai_reasoning"])
    return out


def annotation_rows(ev: DataFrame) -> DataFrame:
    """I8: first five source events of each detection; text always scrubbed."""
    text = fmt(ANNOTATION_TEXT, distinct=F.col("distinct_resources_accessed"), logic=_logic(F.col("is_sequential")),
               techs=F.array_join("mitre_techniques", ", "))
    x = ev.select(
        "event_id", "severity", "is_sequential", "mitre_tactics", "mitre_techniques", "detection_ts_us",
        S.scrub_text(text).alias("annotation_text"),
        F.posexplode(F.slice("window_event_ids", 1, MAX_ANNOTATED)).alias("pos", "udm_event_id"),
    )
    return x.select(
        "event_id", (F.col("pos") + 1).alias("pos"), "udm_event_id", F.lit(ANNOTATION_TYPE).alias("annotation_type"),
        "annotation_text", F.col("severity").alias("triage_result"),
        _confidence(F.col("is_sequential")).alias("confidence"),
        F.array(*[F.lit(t) for t in ANNOTATION_TAGS]).alias("tags"), F.lit(ANNOTATED_BY).alias("annotated_by"),
    )


def incident_id(response_json: Column) -> Column:
    """First present of the id keys, then ``data.id``."""
    return F.coalesce(*[F.get_json_object(response_json, f"$.{k}") for k in INCIDENT_ID_KEYS],
                      F.get_json_object(response_json, "$.data.id"))


def delivery_attempts(deliveries: DataFrame, max_attempts: int = 3) -> DataFrame:
    """One row per attempt made; exponential backoff ``2^(n-1)`` s before retry n+1.

    Attempts beyond ``max_attempts`` keep their rows and outcome and are flagged ``over_limit``."""
    n = F.col("attempts")
    x = deliveries.select("delivery_id", "success", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("attempt"))
    ok = F.col("success") & (F.col("attempt") == F.col("n"))
    return x.select(
        "delivery_id", "attempt",
        F.when(ok, F.lit("delivered")).otherwise(F.lit("failed")).alias("outcome"),
        F.when(F.col("attempt") > 1, F.pow(F.lit(2), F.col("attempt") - 2).cast("int")).otherwise(F.lit(0)).alias("backoff_before_s"),
        (F.col("attempt") > max_attempts).alias("over_limit"),
    )


def incident_templates(ev: DataFrame) -> DataFrame:
    """The documented ServiceNow / XSOAR templates with a labels array."""
    crit = ev.filter(F.col("severity") == "CRITICAL_IDOR_ATTACK")
    labels = F.array(
        F.struct(F.lit("MITRE_Tactic").alias("type"), F.lit("TA0009").alias("value")),
        F.struct(F.lit("MITRE_Technique").alias("type"), F.lit("T1213.002").alias("value")),
        F.struct(F.lit("User").alias("type"), F.col("user_id").alias("value")),
        F.struct(F.lit("Session").alias("type"), F.col("session_id").alias("value")),
    )
    return crit.select(
        "event_id",
        fmt(SN_TEMPLATE_SHORT, user=F.col("user_id"), distinct=F.col("distinct_resources_accessed")).alias("sn_short_description"),
        fmt(XSOAR_TEMPLATE_NAME, user=F.col("user_id")).alias("xsoar_name"),
        labels.alias("labels"),
    )
