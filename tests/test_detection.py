"""IDOR detection ladder on hand-made access logs (reference examples) and
plan-level invariants (bucketed window = plain window, batch = stream)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import idor as X
from vigil.operators import detection as D
from vigil.operators.windows import sliding_window, window_members

COLS = "event_id long, ts_us long, user_id string, session_id string, resource_id string, resource_owner_id string, success boolean"
US = 1_000_000
BASE = 1_700_000_000 * US


def _log(spark, rows):
    full = []
    for i, r in enumerate(rows):
        ts, user, sess, res, owner, ok = r
        full.append((i, BASE + ts * US, user, sess, res, owner, ok))
    df = spark.createDataFrame(full, COLS)
    return df.select("*", F.lit(None).cast("string").alias("request_path"), F.lit(None).cast("string").alias("user_email"),
                     F.lit(None).cast("string").alias("client_ip"), F.lit(None).cast("string").alias("user_agent"),
                     F.lit("GET").alias("http_method"))


def _last(spark, rows, **kw):
    out = D.detect(_log(spark, rows), **kw).orderBy(F.col("ts_us").desc()).first()
    return out


def test_sequential_attack_is_critical(spark):
    rows = [(0, "user_789", "s1", "4395668", "user_789", True)] + [
        (15 * i, "user_789", "s1", str(4395669 + i), f"user_{456 + i}", False) for i in range(1, 4)
    ]
    r = _last(spark, rows)
    assert r["severity"] == X.CRITICAL and r["has_event"] and r["is_sequential"]
    assert r["mitre_sub_techniques"] == ["T1213.002"] and r["mitre_tactics"] == ["TA0009"]


def test_prefixed_ids_suffix_mode(spark):
    rows = [(i, "u", "s", f"loan_{4395669 + i}", "other", False) for i in range(3)]
    assert _last(spark, rows, id_mode="suffix")["severity"] == X.CRITICAL
    assert _last(spark, rows, id_mode="strict")["severity"] == X.ALERT_MEDIUM


def test_uuid_like_ids_not_sequential(spark):
    rows = [(i, "u", "s", rid, "other", False) for i, rid in enumerate(["uuid-abc-123", "uuid-def-456", "uuid-ghi-789"])]
    r = _last(spark, rows)
    assert r["severity"] == X.ALERT_MEDIUM and not r["is_sequential"]
    assert r["mitre_tactics"] == ["TA0009", "TA0006"] and r["mitre_techniques"] == ["T1213", "T1078.004"]


def test_ladder_low_and_log_only(spark):
    assert _last(spark, [(0, "u", "s", "1", "o", False)])["severity"] == X.LOG_ONLY
    assert _last(spark, [(0, "u", "s", "1", "o", False), (1, "u", "s", "5", "o", False)])["severity"] == X.ALERT_LOW


def test_own_failures_and_successes_not_counted(spark):
    rows = [(0, "u", "s", "1", "u", False), (1, "u", "s", "2", "u", False), (2, "u", "s", "3", "o", True), (3, "u", "s", "4", "o", False)]
    out = D.detect(_log(spark, rows)).collect()
    assert len(out) == 1 and out[0]["severity"] == X.LOG_ONLY


def test_window_expires(spark):
    rows = [(0, "u", "s", "1", "o", False), (30, "u", "s", "2", "o", False), (61, "u", "s", "3", "o", False)]
    # 60 s window, both ends inclusive: at t=61 only t=30 and t=61 remain
    assert _last(spark, rows, window_seconds=60)["win_distinct"] == 2


def test_threshold_above_three_gives_medium_without_event(spark):
    rows = [(i, "u", "s", str(100 + i), "o", False) for i in range(4)]
    r = _last(spark, rows, threshold=5)
    assert r["severity"] == X.ALERT_MEDIUM and not r["has_event"]


def test_no_session_is_log_only(spark):
    rows = [(0, "u", None, "1", "o", False)]
    c = D.classify_access(_log(spark, rows)).first()
    assert c["access_class"] == "NO_SESSION" and not c["other_failure"]


@pytest.mark.parametrize("w", [0, 7, 300])
def test_sliding_window_equals_plain_window(spark, w):
    """Ties, repeated items, null items and null keys, several keys; also the lists of some windows."""
    rnd = random.Random(w)
    rows = [
        (i, BASE + rnd.randrange(0, 900) * US, rnd.choice(["s1", "s2", None]), rnd.choice([*map(str, range(12)), None, "x"]))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "event_id long, ts_us long, session_id string, resource_id string")
    number = X.numeric_id(F.col("resource_id"))
    got = sliding_window(
        df, ["session_id"], "ts_us", w, "resource_id", {"d": F.lit(True), "n": number.isNotNull()},
        {"first": ("min", F.col("ts_us")), "low": ("min", number), "high": ("max", number)},
    )
    assert got.columns == [*df.columns, "win_count", "d", "n", "first", "low", "high"]
    frame = Window.partitionBy("session_id").orderBy("ts_us").rangeBetween(-w * US, 0)
    ids = F.collect_set("resource_id").over(frame)
    want = df.select(
        "*", F.count(F.lit(1)).over(frame), F.size(ids), F.size(F.filter(ids, lambda x: x.rlike("[0-9]$"))),
        F.min("ts_us").over(frame), F.min(number).over(frame), F.max(number).over(frame),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    some = df.where("event_id % 5 = 0")
    listed = window_members(some, df, ["session_id"], "ts_us", w, F.col("event_id")).collect()
    by_key = {(r["session_id"], r["ts_us"]): r["members"] for r in listed}
    assert len(by_key) == len(listed) == some.select("session_id", "ts_us").distinct().count()
    for i, t, s, _ in rows:
        if i % 5 == 0:
            assert by_key[s, t] == [j for j, u, z, _ in rows if z == s and t - w * US <= u <= t]


def test_many_failures_in_one_window(spark):
    """10^5 failures of one session inside one window: running sums, no list per row."""
    n = 100_000
    df = spark.range(n).selectExpr(
        "id AS event_id", f"{BASE} + (id * 7919) % {n} * 100 AS ts_us", "if(id < 0, 't', 's') AS session_id",
        "CAST(id % 30011 AS STRING) AS resource_id",
    )
    out = D.analyze_failures(D.failure_window(df, 3600), 3, 10)
    r = out.agg(F.max("win_count"), F.max("win_distinct"), F.min("win_count"), F.count("*")).first()
    assert tuple(r) == (n, 30011, 1, n)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_batch_and_stream_agree(spark, sf_small):
    from vigil.plans import load_all

    q, _ = load_all()
    batch = {tuple(r) for r in q["idor_events"](spark, sf_small).collect()}
    stream = q["idor_stream"](spark, sf_small)
    stream = stream.select(*q["idor_events"](spark, sf_small).columns)
    assert {tuple(r) for r in stream.collect()} == batch and len(batch) > 0


def test_own_resources_do_not_alert(spark):
    # a multi-loan user touching ten of their own loans: no other-user failures
    rows = [(i, "u", "s", str(100 + i), "u", False) for i in range(10)]
    out = D.detect(_log(spark, rows)).collect()
    assert out == []


def test_clear_session_forgets_earlier_failures(spark):
    rows = [(i, "u", "s", str(100 + i), "o", False) for i in range(3)] + [(10, "u", "s", "200", "o", False)]
    log = _log(spark, rows)
    fails = D.classify_access(log).filter("other_failure")
    clears = spark.createDataFrame([("s", BASE + 5 * US)], "session_id string, clear_ts_us long").withColumnRenamed("clear_ts_us", "ts_us")
    tagged = D.assign_clear_epoch(fails, clears)
    out = D.analyze_failures(D.failure_window(tagged, 3600, keys=("session_id", "clear_epoch")))
    last = out.orderBy(F.col("ts_us").desc()).first()
    assert last["win_distinct"] == 1 and last["severity"] == X.LOG_ONLY
    first_three = out.filter(F.col("ts_us") < BASE + 5 * US).orderBy(F.col("ts_us").desc()).first()
    assert first_three["win_distinct"] == 3


def test_frontend_stitch_counts_views_in_window(spark):
    fails = spark.createDataFrame([(1, "s", BASE + 3600 * US), (2, "t", BASE)], "event_id long, session_id string, ts_us long")
    views = spark.createDataFrame([("s", BASE + 100 * US), ("s", BASE + 3500 * US), ("s", BASE - 10 * US), ("t", BASE + 1)],
                                  "session_id string, ts_us long")
    got = {r["event_id"]: r["page_loads_in_window"] for r in D.stitch_frontend(fails, views, 3600).collect()}
    assert got == {1: 2, 2: 0}


def test_frontend_stitch_stream_equals_batch(spark, tmp_path):
    """Shuffled micro-batches with page loads later than their failures, a null session, and a closing row per side."""
    from vigil.streaming import idor_stream as ST
    from vigil.streaming.stitch_stream import stitch_stream

    rng = random.Random(11)
    session = ["s1"] * 6 + ["s2", None]  # one hot session
    rows = [(rng.randrange(2000), "u", rng.choice(session), "r", "o", rng.random() < 0.5) for _ in range(300)]
    closing = [(90_000, "u", "end", "r", "o", True), (90_000, "u", "end", "r", "o", False)]
    path = _stream_files(spark, str(tmp_path / "log"), [rows[i::4] for i in range(4)] + [closing])
    stored = spark.read.parquet(path)
    log = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = log.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", "1 hour")
    out = ST.run_available_now(spark, stitch_stream(log.filter(~F.col("success")), log.filter("success"), 300), "stitch")
    fails = stored.filter(~F.col("success") & (F.col("ts_us") < BASE + 90_000 * US))
    want = D.stitch_frontend(fails, stored.filter("success"), 300)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.select(out.columns).collect()), key=repr)
    assert out.filter("page_loads_in_window > 5").count() > 10


def test_frontend_stitch_stream_evicts_state(spark, tmp_path):
    """In order of time, with a short delay, neither side's state grows with the stream."""
    from vigil.session import checkpoint_dir
    from vigil.streaming.stitch_stream import stitch_stream

    batches = [[(1000 * i + k, "u", "s", "r", "o", k % 2 == 0) for k in range(40)] for i in range(6)]
    path = _stream_files(spark, str(tmp_path / "log"), batches)
    stored = spark.read.parquet(path)
    log = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = log.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", "10 seconds")
    out = stitch_stream(log.filter(~F.col("success")), log.filter("success"), 60)
    q = (
        out.writeStream.format("noop").option("checkpointLocation", f"{checkpoint_dir(spark)}/{tmp_path.name}-evict")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    assert len(held) >= 6 and max(held) <= 3 * 100


def _stream_files(spark, path, batches):
    """One file per micro-batch; the file source takes the oldest first."""
    import glob
    import os

    for i, rows in enumerate(batches):
        before = set(glob.glob(f"{path}/*.parquet"))
        _log(spark, rows).withColumn("event_id", F.col("event_id") + 1000 * i).coalesce(1).write.mode("append").parquet(path)
        for f in set(glob.glob(f"{path}/*.parquet")) - before:
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def _run_detect(spark, path, **kw):
    from vigil.streaming import idor_stream as ST

    stored = spark.read.parquet(path)
    log = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = log.withColumn("event_time", F.timestamp_micros("ts_us"))
    out = ST.run_available_now(spark, ST.detect_stream(log, **kw), "t")
    return stored, out


def test_stream_corrects_verdicts_out_of_order(spark, tmp_path):
    a = [(900, "u", "s", "r1", "o", False), (910, "u", "s", "r2", "o", False), (1000, "u", "s", "r9", "o", False)]
    stored, out = _run_detect(spark, _stream_files(spark, str(tmp_path / "log"), [a, [(945, "u", "s", "r3", "o", False)]]),
                              window_seconds=60)
    from vigil.streaming.idor_stream import newest_verdicts

    got = {r["ts_us"] - BASE: r["severity"] for r in newest_verdicts(out).collect()}
    assert got[945 * US] == X.CRITICAL and got[900 * US] == X.LOG_ONLY


def test_shuffled_micro_batches_and_null_sessions_equal_batch(spark, tmp_path):
    from vigil.streaming.idor_stream import newest_verdicts

    rng = random.Random(7)
    rows = [
        (rng.randrange(0, 900), "u%d" % rng.randrange(3), rng.choice(["s1", "s2", None, ""]), "loan_%d" % rng.randrange(40),
         rng.choice(["o", None, "u0"]), rng.random() < 0.2)
        for _ in range(240)
    ]
    path = _stream_files(spark, str(tmp_path / "log"), [rows[i::6] for i in range(6)])
    for bucket in (None, 25):
        stored, out = _run_detect(spark, path, window_seconds=60, watermark="1 day", bucket_seconds=bucket)
        got = {r["event_id"]: r for r in newest_verdicts(out).collect()}
        fails = [r for r in stored.collect() if not r["success"] and r["resource_owner_id"] != r["user_id"]]
        assert set(got) == {r["event_id"] for r in fails}
        for f in fails:
            if not f["session_id"]:
                assert got[f["event_id"]]["severity"] == X.LOG_ONLY
                continue
            win = [x for x in fails if x["session_id"] == f["session_id"] and 0 <= f["ts_us"] - x["ts_us"] <= 60 * US]
            assert got[f["event_id"]]["win_count"] == len(win)
            assert got[f["event_id"]]["win_distinct"] == len({x["resource_id"] for x in win})
        in_session = stored.filter("session_id <> ''")
        want = {r["event_id"]: r["severity"] for r in D.detect(in_session, window_seconds=60).collect()}
        assert want and all(got[e]["severity"] == s for e, s in want.items() if e in got)


def test_access_results_shuffles(spark, sf_small):
    from vigil.plans import load_all

    plan = load_all()[0]["access_classify"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6 and "Join" not in plan


def _ownership_rows(rng, n):
    """Requests of users who get, lose by time and probe resources; some without session, user or resource."""
    rows = []
    for _ in range(n):
        user = rng.choice(["u0", "u1", "u2", None])
        rows.append(
            (rng.randrange(0, 3000), user, rng.choice(["s1", "s2", "s2", None, ""]), rng.choice([*map(str, range(8)), None]),
             rng.choice([None, None, "u0", "x"]), rng.random() < 0.4)
        )
    return rows


@pytest.mark.parametrize("shuffled, watermark", [(True, "1 day"), (False, "60 seconds")])
def test_ownership_stream_equals_batch(spark, tmp_path, shuffled, watermark):
    """Five micro-batches in no order: later rows correct earlier results. Five in order of time with a
    short watermark: state is folded and forgotten as it passes, and results stay the same."""
    from vigil.operators.ownership import records_from_log
    from vigil.streaming import idor_stream as ST
    from vigil.streaming import ownership_stream as OS

    rng = random.Random(11)
    rows = _ownership_rows(rng, 400)
    if not shuffled:
        rows.sort(key=lambda r: r[0])
    batches = [rows[i::5] for i in range(5)] if shuffled else [rows[80 * i : 80 * i + 80] for i in range(5)]
    path = _stream_files(spark, str(tmp_path / "log"), batches)
    stored = spark.read.parquet(path)
    log = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = log.withColumn("event_time", F.timestamp_micros("ts_us"))
    with OS.rocksdb_state(spark):
        out = ST.run_available_now(spark, OS.classify_stream(log, 120, 3, 10, 300, watermark, bucket_seconds=200), "t")
    want = D.access_results(stored, records_from_log(stored), 300, 120, 3, 10)
    columns = ["event_id", "user_id", "owner_known", "result"]
    got = OS.newest_results(out).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(columns).collect()))
    assert sum(r["owner_known"] for r in got) > 10
    if shuffled:
        assert out.filter("revision > 1").count() > 10


def test_late_rows_are_kept_apart(spark, tmp_path):
    """On-time and late rows together are the input; late ones tell why."""
    from vigil.streaming import ownership_stream as OS

    batches = [[(100, "u", "s", "1", None, False), (500, "u", "s", "2", None, False)],
               [(439, "u", "s", "3", None, False), (440, "u", "s", "4", None, False), (900, "u", "s", "5", None, True)],
               [(1000, "u", "s", "6", None, False), (830, "u", "s", "7", None, False)]]
    path = _stream_files(spark, str(tmp_path / "log"), batches)
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = stream.withColumn("event_time", F.when(F.col("resource_id") != "6", F.timestamp_micros("ts_us")))
    on_time, late = (spark.read.parquet(p) for p in OS.route_late(spark, stream, "late", 60))
    behind = {r["resource_id"]: (r["reason"], r["watermark_us"]) for r in late.collect()}
    assert behind == {
        "3": ("behind the watermark", BASE + 440 * US),
        "7": ("behind the watermark", BASE + 840 * US),
    }
    both = on_time.select(stored.columns).unionByName(late.select(stored.columns))
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, stored.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_array_kernels(seed):
    """Window verdicts and lookups against plain loops."""
    import numpy as np

    from vigil.streaming import kernels as K

    rng = random.Random(seed)
    n = 200
    ts = np.sort(np.array([rng.randrange(0, 300) for _ in range(n)]))
    resource = np.array([rng.choice([None, "a", *map(str, range(9))]) for _ in range(n)], object)
    number = np.array([float(r) if r and r.isdigit() else np.nan for r in resource])
    v = K.window_verdicts(ts, resource, number, 20, 3, 2)
    for i in range(n):
        inside = [j for j in range(n) if ts[i] - 20 <= ts[j] <= ts[i]]
        items = {resource[j] for j in inside} - {None}
        nums = [int(r) for r in items if r.isdigit()]
        seq = len(items) >= 3 and len(nums) >= 3 and max(nums) - min(nums) <= 2 * (len(nums) - 1)
        assert (v["win_distinct"][i], v["win_count"][i], v["is_sequential"][i]) == (len(items), len(inside), seq)
    rec = sorted(((rng.randrange(0, 400), rng.choice([*map(str, range(5)), None])) for _ in range(60)), key=lambda r: r[0])
    probes = [(rng.randrange(100, 400), rng.choice([*map(str, range(5)), None])) for _ in range(80)]

    def owned(t, r, cut):
        begun, last, member = None, None, {}
        for u, x in rec:
            if u > t:
                break
            if last is None or u - last >= 15:
                member = {}
            member[x], last = u, u
        return r is not None and r in member and t - last < 15

    for cut in (0, 100):  # records before the cut are known by their last of each resource only
        older, live = [x for x in rec if x[0] < cut], [x for x in rec if x[0] >= cut]
        gap = last = None
        for u, _ in older:
            gap = u if last is None or u - last >= 15 else gap
            last = u
        base = {x: u for u, x in older if x is not None}
        got = K.owned_at(
            np.array([t for t, _ in probes]), np.array([r for _, r in probes], object),
            np.array([t for t, _ in live], np.int64), np.array([r for _, r in live], object), base, last, gap, 15,
        )
        assert got.tolist() == [owned(t, r, cut) for t, r in probes]


def test_replayed_parts_of_many_rows_are_several_files(spark):
    """A micro-batch is one part, whole, but no single file or task holds it."""
    from pyspark.sql import functions as F

    from vigil.streaming import idor_stream as ST

    table = spark.range(1000).withColumn("part", F.when(F.col("id") == 7, 2).otherwise(F.col("id") % 2))
    stream = ST.replayed(spark, table, F.col("part"), 3, file_rows=100)
    seen = []

    def sink(batch, batch_id):
        seen.append((sorted(r[0] for r in batch.select("part").distinct().collect()), batch.count(), len(batch.inputFiles())))

    query = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [s[:2] for s in seen] == [([0], 500), ([1], 499), ([2], 1)]
