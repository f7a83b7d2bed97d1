"""Ownership-aware classification on a stream (E15 with E1 + D2, D10): two chained stateful operators.

Both are keyed by slot, a hash of the user or session: a call answers many users or sessions at once,
as a call for each costs more than the work in it.

``OwnershipState`` holds the records and lookups of a slot's users that the watermark
has not passed (they may still change), and, as one map entry per user and resource, the last record
before it, with each user's last record and the start of the live set. A record that comes late
gives the lookups after it again, with a higher revision, if their answer changes. A
timer forgets users whose sets have expired.

``WindowState`` is keyed by session slot and time bucket and holds the failures of its bucket and of
one window before it until the watermark has passed them. A failure whose owner turns out
to be known later no longer counts, and every verdict that changes is given again.

No operator reads anything but its own state and the rows of the batch; state lives in
Spark's state store (RocksDB). Rows behind the watermark are dropped by Spark:
``route_late`` puts them into a table of their own first.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.functions import idor as X
from vigil.session import checkpoint_dir
from vigil.streaming import kernels as K
from vigil.streaming.idor_stream import SLOTS, buckets_of, slot_of

_US = 1_000_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LOOKED_UP = (
    "event_id long, user_id string, session_id string, resource_id string, number double, ts_us long, owned boolean, "
    "asked boolean, revision long, event_time timestamp"
)
RESULT = "event_id long, user_id string, owner_known boolean, result string, revision long, event_time timestamp"

LOOKED_UP_FROM = ("event_id", "user_id", "session_id", "resource_id", "number", "ts_us", "owned", "revision")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _joined(held: tuple, pdfs: list[pd.DataFrame], columns: dict[str, type]) -> dict[str, np.ndarray]:
    """The held rows of each column, then the new ones."""
    return {
        c: np.concatenate([np.array(old, kind), *[p[c].to_numpy(kind) for p in pdfs]])
        for (c, kind), old in zip(columns.items(), held)
    }


class OwnershipState(StatefulProcessor):
    """Lookups of the users of one slot, answered from each user's records; see the module's text."""

    RECORD = {"ts_us": "int64", "user_id": object, "resource_id": object}
    LOOKUP = {
        "event_id": "int64", "ts_us": "int64", "user_id": object, "resource_id": object, "session_id": object,
        "number": "float64", "owned": bool, "revision": "int64",
    }

    def __init__(self, ttl_seconds: int):
        self.ttl_us = int(ttl_seconds) * _US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState(
            "live",
            "rec_ts array<long>, rec_user array<string>, rec_resource array<string>, event_id array<long>, ts_us array<long>, "
            "user_id array<string>, resource_id array<string>, session_id array<string>, number array<double>, "
            "owned array<boolean>, revision array<long>, known array<string>, last array<long>, gap array<long>",
        )
        self.before = handle.getMapState("before", "user_id string, resource_id string", "ts_us long")

    def _held(self) -> tuple[tuple, dict]:
        """Open records and lookups, and by user the last record and the last gap behind the watermark."""
        held = self.live.get() if self.live.exists() else None
        held = tuple(held) if held else ([],) * 14
        return held[:11], dict(zip(held[11], zip(held[12], held[13])))

    def _hold(self, records: dict, lookups: dict, marks: dict) -> None:
        columns = [*(records[c] for c in self.RECORD), *(lookups[c] for c in self.LOOKUP)]
        last, gap = ([m[i] for m in marks.values()] for i in (0, 1))
        self.live.update((*(c.tolist() for c in columns), list(marks), last, gap))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [p for p in rows if len(p)]
        held, marks = self._held()
        recorded = [p[p["success"].to_numpy(bool)] for p in new]
        asked = [p[~p["success"].to_numpy(bool)].assign(owned=False, revision=0) for p in new]
        records, lookups = _joined(held[:3], recorded, self.RECORD), _joined(held[3:], asked, self.LOOKUP)
        # rows of users by user, each user's in order of time; a null user is code -1
        n = len(records["ts_us"])
        codes, users = pd.factorize(np.concatenate([records["user_id"], lookups["user_id"]]).astype(object))
        order, turn = np.lexsort((records["ts_us"], codes[:n])), np.argsort(codes[n:], kind="stable")
        records, lookups = ({c: v[o] for c, v in x.items()} for x, o in ((records, order), (lookups, turn)))
        rec_code, ask_code = codes[:n][order], codes[n:][turn]
        owned = np.zeros(len(ask_code), bool)  # a request without a user owns nothing
        fresh = {u for p in new for u in p["user_id"].unique()}  # the other users' answers stay
        for code in np.unique(ask_code[ask_code >= 0]):
            a, b = np.searchsorted(ask_code, (code, code + 1))
            if users[code] not in fresh:
                owned[a:b] = lookups["owned"][a:b]
                continue
            c, d = np.searchsorted(rec_code, (code, code + 1))
            last, gap = marks.get(users[code], (None, None))
            resource = lookups["resource_id"][a:b]
            base = {}
            if last is not None:  # else nothing of the user is behind the watermark
                wanted = [(users[code], r) for r in set(resource) - {None}]
                base = {k[1]: self.before.getValue(k)[0] for k in wanted if self.before.containsKey(k)}
            owned[a:b] = K.owned_at(
                lookups["ts_us"][a:b], resource, records["ts_us"][c:d], records["resource_id"][c:d], base, last, gap, self.ttl_us
            )
        changed = np.flatnonzero((owned != lookups["owned"]) | (lookups["revision"] == 0))
        lookups["owned"] = owned
        lookups["revision"][changed] += 1
        out = {c: lookups[c][changed] for c in LOOKED_UP_FROM}
        out |= {"asked": True, "event_time": pd.to_datetime(out["ts_us"], unit="us")}
        yield pd.DataFrame(out)[_names(LOOKED_UP)]
        self._keep(records, lookups, marks, timerValues.getCurrentWatermarkInMs() * 1000)

    def _keep(self, records: dict, lookups: dict, marks: dict, passed: int) -> None:
        """Hold what the watermark has not passed, older records only as the last of each resource, each
        user's in order of time."""
        never = np.iinfo(np.int64).min // 2
        ts = records["ts_us"]
        old = np.flatnonzero(ts < passed)
        latest: dict = {}
        for user, resource, t in zip(records["user_id"][old], records["resource_id"][old], ts[old].tolist()):
            if user is None:
                continue  # asks nothing
            last, gap = marks.get(user, (never, never))
            marks[user] = (t, t if t - last >= self.ttl_us else gap)
            if resource is not None:
                latest[user, resource] = t
        for k, t in latest.items():
            if t >= marks[k[0]][1]:  # nothing recorded before a gap is owned any more
                self.before.updateValue(k, (t,))
        kept, open_ = ts >= passed, lookups["ts_us"] >= passed
        records = {c: v[kept] for c, v in records.items()}
        lookups = {c: v[open_] for c, v in lookups.items()}
        marks = self._remembered(records, lookups, marks, passed)
        self._hold(records, lookups, marks)
        # when the next set can expire, or all open rows are behind the watermark and forgotten
        rows = [*records["ts_us"].tolist(), *lookups["ts_us"].tolist()]
        due = [t for t, _ in marks.values() if t + self.ttl_us > passed] + ([max(rows)] if rows else [])
        if due:
            self.handle.registerTimer(max(min(due) + self.ttl_us, passed) // 1000 + 1)

    def _remembered(self, records: dict, lookups: dict, marks: dict, passed: int) -> dict:
        """The marks of users whose sets have not expired or who have open rows; forgets the others and
        the records that no set holds any more."""
        expired = {u for u, (last, _) in marks.items() if last + self.ttl_us <= passed}
        expired -= {*records["user_id"], *lookups["user_id"]}
        if not expired:
            return marks
        left = {u: m for u, m in marks.items() if u not in expired}
        for k in [k for k, v in self.before.iterator() if k[0] not in left or v[0] < left[k[0]][1]]:
            self.before.removeKey(tuple(k))
        return left

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, marks = self._held()
        records, lookups = _joined(held[:3], [], self.RECORD), _joined(held[3:], [], self.LOOKUP)
        self._keep(records, lookups, marks, timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())


class WindowState(StatefulProcessor):
    """Verdicts of the failures of one slot's sessions in one time bucket; see the module's text."""

    ROW = {
        "event_id": "int64", "ts_us": "int64", "user_id": object, "session": object, "resource_id": object, "number": "float64", "owned": bool,
        "revision": "int64",
    }

    def __init__(self, window_seconds: int, threshold: int, gap: int, bucket_seconds: int):
        self.w_us, self.b_us = window_seconds * _US, bucket_seconds * _US
        self.threshold, self.gap = threshold, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState(
            "live",
            "event_id array<long>, ts_us array<long>, user_id array<string>, session array<string>, "
            "resource_id array<string>, number array<double>, owned array<boolean>, revision array<long>, given long",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = int(key[1]) * self.b_us
        new = [p for p in rows if len(p)]
        held = tuple(self.live.get()) if self.live.exists() else (*([] for _ in self.ROW), 0)
        given = held[-1] + 1
        row = _joined(held[:-1], new, self.ROW)
        is_new = np.arange(len(row["ts_us"])) >= len(held[0])
        # of each failure the newest answer, in order of time
        order = np.lexsort((row["revision"], row["event_id"]))
        event = row["event_id"][order]
        order = order[np.r_[event[1:] != event[:-1], True]]
        order = order[np.argsort(row["event_id"][order], kind="stable")]
        by_session, line = K.apart(row["session"][order], row["ts_us"][order], self.w_us)
        order = order[by_session]
        row = {c: v[order] for c, v in row.items()}
        ts, counts = row["ts_us"], ~row["owned"]
        result = np.full(len(ts), X.LOG_ONLY, object)
        other = np.flatnonzero(counts)
        if len(other):
            verdicts = K.window_verdicts(
                line[other], row["resource_id"][other], row["number"][other], self.w_us, self.threshold, self.gap
            )
            result[other] = verdicts["severity"]
        # an arrival, or an answer that changed, gives anew every verdict whose window holds it
        mine = np.flatnonzero(K.touched(line, line[is_new[order]], self.w_us) & (ts >= start))
        out = {c: row[c][mine] for c in ("event_id", "user_id")}
        out |= {"owner_known": row["owned"][mine], "result": result[mine], "revision": given}
        out |= {"event_time": pd.to_datetime(ts[mine], unit="us")}
        yield pd.DataFrame(out)[_names(RESULT)]
        self.live.update((*(row[c].tolist() for c in self.ROW), given))
        # once the watermark has passed the bucket's end, none of its verdicts can change
        self.handle.registerTimer(max((start + self.b_us) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if timerValues.getCurrentWatermarkInMs() * 1000 >= (int(key[1]) + 1) * self.b_us:
            self.live.clear()
        return iter(())


def classify_stream(
    log: DataFrame,
    window_seconds: int = X.DEFAULT_WINDOW_SECONDS,
    threshold: int = X.DEFAULT_THRESHOLD,
    sequential_gap: int = X.DEFAULT_SEQUENTIAL_GAP,
    ttl_seconds: int = X.DEFAULT_OWNERSHIP_TTL_SECONDS,
    watermark: str = "10 minutes",
    id_mode: str = "suffix",
    bucket_seconds: int | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """event_id, user_id, owner_known, result, revision of every request of a streaming access log.

    A request is given again with a higher revision when a later row changes its result;
    ``newest_results`` keeps the last. ``log`` needs ``event_time`` (a timestamp equal to ``ts_us``).
    Verdicts may be corrected until the watermark passes them. Users and sessions are dealt to ``slots``
    state keys each.
    """
    bucket_s = bucket_seconds or 60 * window_seconds
    own = F.coalesce(F.col("user_id") == F.col("resource_owner_id"), F.lit(False))
    failed = F.coalesce(~F.col("success"), F.lit(False))
    no_session = F.coalesce(F.col("session_id") == "", F.lit(True))
    number = X.numeric_id(F.col("resource_id"), id_mode).cast("double")
    rows = log.select(
        "event_id", "user_id", "session_id", "resource_id", "resource_owner_id", number.alias("number"), "ts_us", "event_time",
        (~failed).alias("success"),
    ).withWatermark("event_time", watermark)
    looked_up = (
        rows.filter(F.col("success") | F.col("resource_owner_id").isNull())
        .withColumn("slot", slot_of(F.col("user_id"), slots))
        .groupBy("slot")
        .transformWithStateInPandas(
            OwnershipState(ttl_seconds), LOOKED_UP, "append", "EventTime", eventTimeColumnName="event_time"
        )
    )
    other = rows.filter(~F.col("success") & F.col("resource_owner_id").isNotNull() & ~own & ~no_session)
    other = other.withColumns({"owned": F.lit(False), "asked": F.lit(False), "revision": F.lit(1).cast("long")})
    failures = looked_up.unionByName(other.select(*_names(LOOKED_UP)))
    # a failure without a session is LOG_ONLY and in no window: it gets a key of its own
    session = F.when(no_session, F.concat(F.lit("\0"), F.col("event_id").cast("string"))).otherwise(F.col("session_id"))
    judged = (
        failures.withColumn("session", session)
        .select("*", slot_of(F.col("session"), slots), buckets_of(window_seconds * _US, bucket_s * _US))
        .groupBy("slot", "bucket")
        .transformWithStateInPandas(
            WindowState(window_seconds, threshold, sequential_gap, bucket_s),
            RESULT, "append", "EventTime", eventTimeColumnName="event_time",
        )
    )
    passed = rows.filter(F.col("success") | (F.col("resource_owner_id").isNotNull() & (own | no_session)))
    passed = passed.select(
        "event_id", "user_id", own.alias("owner_known"),
        F.when(F.col("success") & ~no_session, X.LEGITIMATE_ACCESS).otherwise(X.LOG_ONLY).alias("result"),
        F.lit(1).cast("long").alias("revision"), "event_time",
    )
    return judged.unionByName(passed).drop("event_time")


def newest_results(out: DataFrame) -> DataFrame:
    """The last revision of every request's result."""
    newest = out.groupBy("event_id").agg(F.max_by(F.struct(*out.columns), "revision").alias("v"))
    return newest.select("v.*")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside the block keep their state in RocksDB, as map state and timers need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def route_late(spark: SparkSession, stream: DataFrame, name: str, delay_seconds: int) -> tuple[str, str]:
    """Divide a stream, until its input is exhausted, into an on-time and a late folder; returns both.

    A row is late if it is more than ``delay_seconds`` older than the newest row of the batches
    before its own: the rows that a watermark of that delay drops. Late rows get a ``reason``,
    the watermark and the batch; rows without an ``event_time`` are on time, as no watermark
    drops them. A batch that is run again overwrites its own folder, and the newest instant
    of every batch is kept beside them, so a restart goes on with the same watermark.
    """
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    on_time, late, marks = (os.path.join(base, d) for d in ("on_time", "late", "marks"))

    def write(df: DataFrame, path: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))

    def divide(batch: DataFrame, batch_id: int) -> None:
        at = F.unix_micros(F.col("event_time").cast("timestamp"))
        passed = None
        if batch_id:
            seen = spark.read.parquet(marks).filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
            passed = None if seen is None else seen - delay_seconds * _US
        behind = F.lit(False) if passed is None else F.coalesce(at < F.lit(passed), F.lit(False))
        write(batch.filter(~behind), on_time, batch_id)
        reason = batch.filter(behind).withColumns(
            {"reason": F.lit("behind the watermark"), "watermark_us": F.lit(passed).cast("long")}
        )
        write(reason, late, batch_id)
        write(batch.agg(F.max(at).alias("newest")), marks, batch_id)

    query = (
        stream.writeStream.foreachBatch(divide)
        .option("checkpointLocation", os.path.join(base, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return on_time, late
