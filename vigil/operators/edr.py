"""EDR analytics (J1–J3): per-alert summaries, behavioural flags, process parentage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Behavioural rules (ours; the reference only declares the flag names).
PRIV_ESC_TACTIC = "TA0004"
PERSISTENCE_TACTIC, PERSISTENCE_TECH, PERSISTENCE_ACTION = "TA0003", "T1547", "registry_value_set"
EXFIL_TACTIC = "TA0010"
LATERAL_TACTIC, LATERAL_TECH = "TA0008", "T1021"
INJECTION_ACTION = "process_injected"


def edr_summary(ev: DataFrame) -> DataFrame:
    """Per (endpoint, alert) — totals, distinct processes/files/remote ips,
    first/last, duration, threat and tactic sets (distinct values of small
    categorical columns: bounded).

    The rows are shuffled once, by alert. Distinct values are counted at their first row in the
    order of the alert's rows, by windows over that same partitioning: no row is copied per
    distinct column, and no set of unbounded size is held."""
    counted = {"unique_processes": "process_name", "unique_files": "file_path", "unique_remote_ips": "remote_ip"}
    keys = ["endpoint_id", "alert_id"]
    rows = ev.select(*keys, *counted.values(), "ts_us", "threat_name", "tactic").repartition(*keys)
    for name, c in counted.items():
        turn = F.row_number().over(Window.partitionBy(*keys, c).orderBy(c))
        rows = rows.withColumn(name, (F.col(c).isNotNull() & (turn == 1)).cast("bigint")).drop(c)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.sum(name).alias(name) for name in counted],
        F.min("ts_us").alias("first_event_us"),
        F.max("ts_us").alias("last_event_us"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1_000_000)).cast("bigint").alias("duration_seconds"),
        F.array_sort(F.collect_set("threat_name")).alias("threat_names"),
        F.array_sort(F.collect_set("tactic")).alias("mitre_tactics"),
    )


def edr_flags(ev: DataFrame) -> DataFrame:
    """Behavioural flags per (endpoint, alert) with ``bool_or``."""
    return ev.groupBy("endpoint_id", "alert_id").agg(
        F.bool_or(F.col("action") == INJECTION_ACTION).alias("code_injection_detected"),
        F.bool_or(F.col("tactic") == PRIV_ESC_TACTIC).alias("privilege_escalation_detected"),
        F.bool_or((F.col("tactic") == PERSISTENCE_TACTIC) | (F.col("technique") == PERSISTENCE_TECH)
                  | (F.col("action") == PERSISTENCE_ACTION)).alias("persistence_detected"),
        F.bool_or(F.col("tactic") == EXFIL_TACTIC).alias("exfiltration_detected"),
        F.bool_or((F.col("tactic") == LATERAL_TACTIC) | (F.col("technique") == LATERAL_TECH)).alias("lateral_movement_detected"),
    )


def process_ancestry(ev: DataFrame) -> DataFrame:
    """Every process with its whole line of ancestors, nearest first.

    ``endpoint_id, process_id, process_name, start_us, ancestors`` (names), ``depth`` and ``cyclic``.
    A process is one (endpoint, process id, parent id, name), however many events it has; it starts
    at its first event. A process id may be used again: the parent is the one of that id that
    started last at or before the child (of those that all started later, the first: telemetry
    may miss a start; ties: by name). Children and the processes of their parent's id stand in one
    time line per (endpoint, id), so no child meets them all. Lines are found by pointer doubling, so a
    line of n ancestors takes log2(n) rounds of equi-joins; each round takes only the lines that are not
    whole yet and is written to the shared checkpoint folder. A line that comes back to itself is cut
    there and marked ``cyclic``.
    """
    from vigil.operators.ownership import materialize

    process = ["endpoint_id", "process_id", "process_name", "start_us", "_id"]
    procs = materialize(
        ev.groupBy("endpoint_id", "process_id", "parent_process_id", "process_name")
        .agg(F.min("ts_us").alias("start_us"))
        .withColumn("_id", F.xxhash64("endpoint_id", "process_id", "parent_process_id", "process_name"))
    )
    up = F.struct("start_us", "process_name", F.col("parent_process_id").alias("_of"), "_id")
    has_parent = F.col("endpoint_id").isNotNull() & F.col("parent_process_id").isNotNull()
    above = procs.filter(F.col("endpoint_id").isNotNull() & F.col("process_id").isNotNull()).select(
        F.col("process_id").alias("_p"), F.lit(False).alias("_child"), *process, "parent_process_id", up.alias("_up")
    )
    below = procs.filter(has_parent).select(
        F.col("parent_process_id").alias("_p"), F.lit(True).alias("_child"), *process, "parent_process_id", F.lit(None).alias("_up")
    )
    same_id = Window.partitionBy("endpoint_id", "_p")
    in_turn = same_id.orderBy("start_us", "_child", "process_name", "parent_process_id", "_id")
    on_time = F.last(F.when(F.col("_up.start_us").isNotNull(), F.col("_up")), ignorenulls=True).over(
        in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = above.unionByName(below).select(
        *process, "_child", F.when(F.col("start_us").isNotNull(), on_time).alias("_last"), F.min("_up").over(same_id).alias("_first")
    )
    found = found.filter("_child").select(*process, F.coalesce("_last", "_first").alias("_up"))
    none = F.lit(None).cast(found.schema["_up"].dataType).alias("_up")
    found = found.unionByName(procs.filter(~has_parent).select(*process, none))
    no_line = F.array().cast("array<struct<id:bigint,name:string>>")
    line = materialize(
        found.select(
            *process,
            # the line is whole if its last process has no parent's id
            F.when(F.col("_up._of").isNotNull(), F.col("_up._id")).alias("_next"),
            F.when(F.col("_up").isNull(), no_line)
            .otherwise(F.array(F.struct(F.col("_up._id").alias("id"), F.col("_up.process_name").alias("name"))))
            .alias("_line"),
            F.lit(False).alias("cyclic"),
        )
    )
    whole = line.filter(F.col("_next").isNull())
    while not (line := line.filter(F.col("_next").isNotNull())).isEmpty():
        further = whole.unionByName(line).filter(F.size("_line") > 0).select(
            F.col("_id").alias("_next"), F.col("_next").alias("_after"), F.col("_line").alias("_rest"),
        )
        grown = line.join(further, "_next", "left").withColumn("_line", F.concat("_line", F.coalesce("_rest", no_line)))
        ids = F.transform("_line", lambda x: x["id"])
        # a line that meets itself: keep it up to the first process that stands in it twice
        again = F.array_contains(ids, F.col("_id")) | (F.size(F.array_distinct(ids)) < F.size(ids))
        cut = F.filter(
            "_line",
            lambda x, i: (F.array_position(ids, x["id"]) == i + 1) & (x["id"] != F.col("_id")),
        )
        line = materialize(
            grown.select(
                *process,
                F.when(~again, F.col("_after")).alias("_next"),
                F.when(again, cut).otherwise(F.col("_line")).alias("_line"),
                again.alias("cyclic"),
            )
        )
        whole = whole.unionByName(line.filter(F.col("_next").isNull()))
    return whole.select(
        "endpoint_id", "process_id", "process_name", "start_us", F.transform("_line", lambda x: x["name"]).alias("ancestors"),
        F.size("_line").alias("depth"), "cyclic",
    )
