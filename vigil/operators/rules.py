"""Detection rules and hunting queries (F1–F14) as parameter rows.

A rule is data — filter, key, window, slide, thresholds, risk, MITRE — and
one generic plan evaluates it: ``groupBy(window(ts, w, slide), key).agg``.
Aggregates are partial (map-side combined), so a hot session costs one
partial row per task, not a shuffle of its events. No rule-language parser.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.telemetry import URL_RULES

_US = 1_000_000


@dataclass(frozen=True)
class WindowRule:
    name: str
    window_s: int
    slide_s: int
    min_distinct: int | None = None
    min_attempts: int | None = None
    risk_score: int = 50
    severity: str = "MEDIUM"
    tactics: tuple[str, ...] = ()
    techniques: tuple[str, ...] = ()
    url_pattern: str = URL_RULES["versioned_numeric"]
    velocity: bool = False
    extra: dict = field(default_factory=dict)

    def scaled(self, factor: int) -> "WindowRule":
        from dataclasses import replace

        return replace(self, window_s=self.window_s * factor, slide_s=self.slide_s * factor)


# Fixed values that must equal the reference's results: the three published
# rule definitions (window, threshold, risk, severity, MITRE).
SEQ_ENUM = WindowRule("idor_sequential_enumeration", 300, 60, min_distinct=3, risk_score=50, severity="MEDIUM",
                      tactics=("TA0009",), techniques=("T1213.002",))
NON_SEQ = WindowRule("idor_nonsequential_exploration", 600, 120, min_distinct=5, risk_score=40, severity="MEDIUM",
                     tactics=("TA0009", "TA0006"), techniques=("T1213", "T1078.004"))
VELOCITY = WindowRule("idor_high_velocity_attack", 60, 60, min_attempts=10, risk_score=75, severity="HIGH",
                      tactics=("TA0009",), techniques=("T1213.002",), velocity=True)


def rule_candidates(log: DataFrame, rule: WindowRule) -> DataFrame:
    """Rule event filter: HTTP GET, status 403, URL pattern, a session (without one, failures
    of unrelated users would pool under one key)."""
    return log.filter(
        (F.col("session_id") != "") &
        (~F.col("success")) & (F.col("http_method") == "GET") & F.col("request_path").rlike(rule.url_pattern)
    )


def evaluate_window_rule(log: DataFrame, rule: WindowRule, key: str = "session_id") -> DataFrame:
    """Per (hop window, key): distinct URLs, attempts, outcome columns;
    keep groups over the thresholds."""
    ev = rule_candidates(log, rule).withColumn("_ts", F.timestamp_micros("ts_us"))
    w = F.window("_ts", f"{rule.window_s} seconds", f"{rule.slide_s} seconds")
    g = ev.groupBy(w.alias("w"), F.col(key)).agg(
        F.count_distinct("request_path").alias("distinct_urls"),
        F.count(F.lit(1)).alias("total_attempts"),
        F.max("user_id").alias("user_id"),
    )
    cond = F.lit(True)
    if rule.min_distinct is not None:
        cond = cond & (F.col("distinct_urls") >= rule.min_distinct)
    if rule.min_attempts is not None:
        cond = cond & (F.col("total_attempts") >= rule.min_attempts)
    out = g.filter(cond).select(
        F.lit(rule.name).alias("rule_name"),
        F.unix_micros("w.start").alias("window_start_us"),
        F.col(key),
        "user_id",
        "distinct_urls",
        "total_attempts",
        F.lit(rule.risk_score).alias("risk_score"),
        F.lit(rule.severity).alias("severity"),
    )
    if rule.velocity:
        out = out.withColumn("attack_velocity", F.col("total_attempts") / F.lit(float(rule.window_s)))
    return out


EXCLUDED_TAGS = ["qa_automation", "pentester"]


def not_tagged(tags: Column, excluded=EXCLUDED_TAGS) -> Column:
    return ~F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in excluded]))


def siem_select(events: DataFrame) -> DataFrame:
    """severity CRITICAL/MEDIUM, ≥3 distinct, sequential, not QA/pentester-tagged."""
    return events.filter(
        F.col("severity").isin("CRITICAL_IDOR_ATTACK", "ALERT_MEDIUM")
        & (F.col("distinct_resources_accessed") >= 3)
        & F.col("is_sequential")
        & not_tagged(F.col("user_tags"))
    )


def siem_velocity(events: DataFrame, threshold: float = 0.05) -> DataFrame:
    """CRITICAL, untagged, ``distinct / time_window_seconds > 0.05``
    (a zero span gives NULL and is not selected)."""
    v = F.try_divide(F.col("distinct_resources_accessed").cast("double"), F.col("time_window_seconds").cast("double"))
    return (
        events.filter((F.col("severity") == "CRITICAL_IDOR_ATTACK") & not_tagged(F.col("user_tags")))
        .withColumn("attack_velocity", v)
        .filter(F.col("attack_velocity") > threshold)
    )


def rule_user_hour(events: DataFrame, window_s: int = 3600) -> DataFrame:
    """CRITICAL & ≥3 distinct & sequential & untagged per user per hour; risk 90, auto_hold."""
    sel = events.filter(
        (F.col("severity") == "CRITICAL_IDOR_ATTACK") & (F.col("distinct_resources_accessed") >= 3)
        & F.col("is_sequential") & not_tagged(F.col("user_tags"))
    )
    w = F.window(F.timestamp_micros("detection_ts_us"), f"{window_s} seconds")
    return sel.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("detections")).select(
        F.unix_micros("w.start").alias("window_start_us"), "user_id", "detections",
        F.lit(90).alias("risk_score"), F.lit("TA0009").alias("mitre_tactic"), F.lit("T1213.002").alias("mitre_technique"),
        F.lit("auto_hold").alias("alert_action"),
    )


def greedy_span_groups(df: DataFrame, key: str, ts: str, span_us: int, id_col: str = "event_id") -> DataFrame:
    """F7/F11 core: within each key, events in ``(ts, id)`` order form groups
    greedily — a group starts at an event and takes every later event within
    ``span`` of that start. Adds ``is_group_start`` and ``group_start_us``.

    Exact and skew-free: each event points to the first event at or after
    ``ts + span + 1µs`` (an as-of lookup with the bucketed running max); the
    group starts are the nodes on the pointer path from each key's first
    event, found by pointer doubling — ``log2(path length)`` rounds of
    equi-joins on the (unique) event id, so no key is ever gathered in one
    task. Each round's state is checkpointed to the shared folder.
    """
    from vigil.operators.ownership import materialize
    from vigil.operators.sequence import running

    gap = span_us + 1
    nodes = df.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col(id_col).alias("_id")).distinct()
    # as-of "next node at or after t + gap": walk time backwards (negated) so the
    # bucketed running max yields the smallest (ts, id) at or after the probe
    alerts = nodes.select("_k", (-F.col("_t")).alias("_nt"), F.lit(0).alias("_rank"), F.col("_id").alias("_id"),
                          F.struct((-F.col("_t")).alias("nt"), (-F.col("_id")).alias("nid")).alias("_v"),
                          F.lit(None).cast("long").alias("_from"))
    probes = nodes.select("_k", (-(F.col("_t") + F.lit(gap))).alias("_nt"), F.lit(1).alias("_rank"),
                          F.lit(None).cast("long").alias("_id"), F.lit(None).cast("struct<nt:bigint,nid:bigint>").alias("_v"),
                          F.col("_id").alias("_from"))
    walked = running(alerts.unionByName(probes), ["_k"], [F.col("_nt"), F.col("_rank"), F.col("_id").desc()],
                     {"_best": ("max", F.col("_v"))}, "_nt")
    nxt = walked.filter(F.col("_from").isNotNull()).select(
        F.col("_from").alias("_id"), (-F.col("_best.nid")).alias("_jump")
    )
    jump = materialize(nxt)
    heads = nodes.groupBy("_k").agg(F.min(F.struct("_t", "_id")).alias("_h")).select(F.col("_h._id").alias("_id"))
    reached = materialize(heads)
    n = reached.count()
    while True:
        step = reached.join(jump, "_id").select(F.col("_jump").alias("_id")).filter(F.col("_id").isNotNull())
        grown = materialize(reached.unionByName(step).distinct())
        m = grown.count()
        if m == n:
            break
        reached, n = grown, m
        j2 = jump.alias("a").join(jump.alias("b"), F.col("a._jump") == F.col("b._id"), "left").select(
            F.col("a._id").alias("_id"), F.col("b._jump").alias("_jump")
        )
        jump = materialize(j2)
    starts = reached.select("_id", F.lit(True).alias("is_group_start"))
    out = df.join(starts, df[id_col] == starts["_id"], "left").drop("_id")
    out = out.withColumn("is_group_start", F.coalesce("is_group_start", F.lit(False)))
    out = running(out, [key], [F.col(ts), F.col(id_col)],
                  {"group_start_us": ("max", F.when(F.col("is_group_start"), F.col(ts)))}, ts)
    return out


def suppress_alerts(alerts: DataFrame, key: str, ts: str, suppress_s: int) -> DataFrame:
    """an alert fires unless a fired alert of the same entity lies in the
    preceding suppression period; fired alerts start suppression periods."""
    g = greedy_span_groups(alerts, key, ts, suppress_s * _US - 1)
    return g.withColumn("fired", F.col("is_group_start"))


# Fixed values of the published playbook: three actions and their texts.
PLAYBOOK_DISABLE_REASON = "IDOR attack detected: {n} unauthorized access attempts"
PLAYBOOK_MAIL_TO = "soc-team@company.com"
PLAYBOOK_MAIL_SUBJECT = "CRITICAL: IDOR Attack by {user}"
PLAYBOOK_MAIL_BODY = "Session {session} attempted enumeration of {n} loans. Auto-hold executed. MITRE: {techs}"
PLAYBOOK_ACTIONS = ["disable user", "send email", "lookup ip"]


def playbook_actions(events: DataFrame) -> DataFrame:
    """CRITICAL → disable user, notify SOC, look up the client IP."""
    from vigil.functions.text import fmt

    n = F.size("failed_resources")
    techs = F.concat(F.lit("['"), F.array_join("mitre_techniques", "', '"), F.lit("']"))  # Python list text
    params = [
        F.to_json(F.struct(F.col("user_id").alias("user_id"), fmt(PLAYBOOK_DISABLE_REASON, n=n).alias("reason"))),
        F.to_json(F.struct(F.lit(PLAYBOOK_MAIL_TO).alias("to"), fmt(PLAYBOOK_MAIL_SUBJECT, user=F.col("user_id")).alias("subject"),
                           fmt(PLAYBOOK_MAIL_BODY, session=F.col("session_id"), n=n, techs=techs).alias("body"))),
        F.to_json(F.struct(F.col("client_ip").alias("ip"))),
    ]
    actions = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("action"), p.alias("parameters"))
        for i, (name, p) in enumerate(zip(PLAYBOOK_ACTIONS, params))
    ])
    crit = events.filter(F.col("severity") == "CRITICAL_IDOR_ATTACK")
    return crit.select("event_id", F.explode(actions).alias("a")).select("event_id", "a.step", "a.action", "a.parameters")
