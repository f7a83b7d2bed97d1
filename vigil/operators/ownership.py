"""Ownership state (D1–D10) as relations over an ownership log.

The reference keeps ``user → set(resource)`` (TTL refreshed for the whole
set on every record) and ``resource → last user`` (own TTL) in a key-value
store. Here the state at any instant is a function of the log:

``ops``: ``user_id, resource_id, ts_us, op`` with ``op`` in
``record | remove | clear`` (``clear`` has no resource).

* a user's *ttl-session* starts at a record whose previous record is ≥ TTL
  older, or which follows a clear; the set is alive at ``t`` while
  ``t - last_record < TTL`` and no clear came after that record;
* ``(user, resource)`` is owned at ``t`` iff the set is alive, and the last
  op on ``(user, resource)`` at or before ``t`` is a record of the current
  ttl-session.

Ties at the same microsecond are ordered clear < record < remove < probe, so a
probe sees everything recorded at its own instant. Running state is kept within
time buckets and carried on over one summary row per bucket, never by a
per-user unbounded window over events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.idor import DEFAULT_OWNERSHIP_TTL_SECONDS
from vigil.operators.sequence import BUCKET_US

_US = 1_000_000
RANK = {"clear": 0, "record": 1, "remove": 2, "probe": 3}


def _seq(ts: str, rank) -> F.Column:
    r = rank if isinstance(rank, F.Column) else F.lit(rank)
    return F.col(ts) * 4 + r


def _rank_col() -> F.Column:
    return (
        F.when(F.col("op") == "clear", 0)
        .when(F.col("op") == "record", 1)
        .when(F.col("op") == "remove", 2)
        .otherwise(3)
    )


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a reused intermediate by writing it once as parquet
    under the session's shared ``spark.checkpoint.dir`` and reading it back
    (one computation; survives executor loss; columnar for the readers)."""
    import os
    import uuid

    from vigil.session import checkpoint_dir

    path = os.path.join(checkpoint_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def records_from_log(log: DataFrame) -> DataFrame:
    """D1 source: every successful access records ownership."""
    return log.filter("success").select("user_id", "resource_id", "ts_us", F.lit("record").alias("op"))


def bulk_records(bulk: DataFrame) -> DataFrame:
    """``user_id, resource_ids array, ts_us`` → one record per resource."""
    return bulk.select("user_id", F.explode("resource_ids").alias("resource_id"), "ts_us", F.lit("record").alias("op"))


def ttl_sessions(ops: DataFrame, ttl_seconds: int = DEFAULT_OWNERSHIP_TTL_SECONDS, bucket_us: int = BUCKET_US) -> DataFrame:
    """Records with ``ttl_session`` (per user) and the set's expiry if
    nothing follows (``expires_us = ts + TTL``).

    One shuffle of the records: inside a ``(user, bucket)`` partition a record's
    predecessor is local unless it is the first record of that bucket; only that
    one record per bucket needs the summary of the buckets before (last record, last
    clear, sessions so far), which is a prefix over one row per (user, bucket).
    """
    ttl = F.lit(int(ttl_seconds) * _US)
    touched = ops.filter(F.col("op").isin("record", "clear")).withColumn("seq", _seq("ts_us", _rank_col()))
    # one row per (user, instant, kind): ties cannot reorder the state
    pts = touched.select("user_id", "seq").distinct().select(
        "user_id", "seq", (F.col("seq") % 4 == 1).alias("is_rec"), F.floor(F.floor(F.col("seq") / 4) / F.lit(bucket_us)).alias("_tb")
    )
    part = Window.partitionBy("user_id", "_tb").orderBy("seq")
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    rec_seq = F.when(F.col("is_rec"), F.col("seq"))
    clear_seq = F.when(~F.col("is_rec"), F.col("seq"))
    w = pts.select(
        "*",
        F.max(rec_seq).over(before).alias("_lp_rec"),
        F.max(clear_seq).over(before).alias("_lp_clear"),
    )
    # flag of records whose predecessor record is in the same day; 0 for the
    # day's first record (resolved from the summary below)
    local_flag = F.when(
        F.col("is_rec") & F.col("_lp_rec").isNotNull(),
        ((F.floor(F.col("seq") / 4) - F.floor(F.col("_lp_rec") / 4) >= ttl)
         | (F.coalesce(F.col("_lp_clear"), F.lit(-1)) > F.col("_lp_rec"))).cast("int"),
    ).otherwise(F.lit(0))
    w = w.select("*", local_flag.alias("_lf"))
    w = w.select("*", F.sum("_lf").over(upto).alias("_lcum"))
    first_rec = F.when(F.col("is_rec") & F.col("_lp_rec").isNull(), F.struct("seq", "_lp_clear"))
    summary = w.groupBy("user_id", "_tb").agg(
        F.max(rec_seq).alias("_max_rec"), F.max(clear_seq).alias("_max_clear"),
        F.sum("_lf").alias("_n_local"), F.min(first_rec).alias("_first"),
    )
    days = Window.partitionBy("user_id").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    s1 = summary.select(
        "*", F.max("_max_rec").over(days).alias("_c_rec"), F.max("_max_clear").over(days).alias("_c_clear")
    )
    prev_clear = F.greatest(F.col("_first._lp_clear"), F.col("_c_clear"))
    first_flag = F.when(
        F.col("_first").isNotNull(),
        (F.col("_c_rec").isNull()
         | (F.floor(F.col("_first.seq") / 4) - F.floor(F.col("_c_rec") / 4) >= ttl)
         | (F.coalesce(prev_clear, F.lit(-1)) > F.col("_c_rec"))).cast("int"),
    ).otherwise(F.lit(0))
    s2 = s1.select("user_id", "_tb", first_flag.alias("_ff"), (first_flag + F.col("_n_local")).alias("_nb"))
    s3 = s2.select("user_id", "_tb", "_ff", F.coalesce(F.sum("_nb").over(days), F.lit(0)).alias("_c_sess"))
    sess = w.filter("is_rec").join(s3, ["user_id", "_tb"]).select(
        "user_id", "seq", (F.col("_c_sess") + F.col("_ff") + F.col("_lcum")).cast("bigint").alias("ttl_session")
    )
    recs = touched.filter(F.col("op") == "record").select("user_id", "resource_id", "ts_us", "seq").distinct()
    return recs.join(sess, ["user_id", "seq"]).select(
        "user_id", "resource_id", "ts_us", "seq", "ttl_session", (F.col("ts_us") + ttl).alias("expires_us")
    )


def _instant(seq) -> F.Column:
    return F.shiftright(seq, 2)


def _span_us(ttl_us: int, bucket_us: int | None) -> int:
    """Length of a time bucket: a quarter of the TTL if none is given, never more than the TTL."""
    if ttl_us <= 0:
        raise ValueError("ttl_seconds must be positive")
    return max(1, min(bucket_us or ttl_us // 4, ttl_us))


def _user_buckets(marks: DataFrame, ttl_us: int) -> DataFrame:
    """One row per (user, bucket) of ``marks`` (``user_id, _b, rec, clear``): its first record, and over all
    buckets before it the last record, the last clear and the last record that began a set anew.

    No bucket is longer than the TTL, so a set can expire between two records only where the
    later one is the first of its bucket: the summary rows tell every such gap.
    """
    past = Window.partitionBy("user_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.max(c).alias(c) for c in marks.columns if c not in ("user_id", "_b", "rec", "clear")]
    per = marks.groupBy("user_id", "_b").agg(
        F.min("rec").alias("first_rec"), F.max("rec").alias("last_rec"), F.max("clear").alias("last_clear"), *extra
    )
    per = per.select("*", F.max("last_rec").over(past).alias("c_rec"), F.max("last_clear").over(past).alias("c_clear"))
    anew = F.col("c_rec").isNull() | (_instant("first_rec") - _instant("c_rec") >= ttl_us)
    per = per.withColumn("gap", F.when(anew, F.col("first_rec")))
    return per.select("*", F.max("gap").over(past).alias("c_gap"))


def _marks(ops: DataFrame, span: int) -> DataFrame:
    seq = _seq("ts_us", _rank_col())
    return ops.select(
        "user_id",
        "resource_id",
        F.floor(F.col("ts_us") / F.lit(span)).alias("_b"),
        seq.alias("seq"),
        "op",
        F.when(F.col("op") == "record", seq).alias("rec"),
        F.when(F.col("op") == "clear", seq).alias("clear"),
    )


def is_owner_asof(
    ops: DataFrame,
    probes: DataFrame,
    ttl_seconds: int = DEFAULT_OWNERSHIP_TTL_SECONDS,
    bucket_us: int | None = None,
) -> DataFrame:
    """D2 (+D5, D8): every row of ``probes`` (``user_id, resource_id, ts_us`` and any other columns)
    with ``owned`` at its instant.

    A probe is owned if the last operation on its (user, resource) is a record that no clear of
    the user and no gap of a TTL came after, and the set still lives; nobody owns a resource without
    an id, and a probe without a user owns nothing. All of it is carried to
    the probe; nothing is joined. Time is cut into buckets of at most one TTL. What went
    before a bucket comes from partial aggregates: per (user, bucket) the first and last record
    and the last clear, per (user, resource, bucket) the last operation, each carried on over
    one row per bucket. These carry rows stand first among the bucket's own rows, and running
    maxima bring both to the probes. Five shuffles, two of them of summary rows; a task holds
    one bucket of a user.
    """
    ttl = int(ttl_seconds) * _US
    span = _span_us(ttl, bucket_us)
    o = _marks(ops, span)
    p = probes.select(
        "user_id",
        "resource_id",
        F.floor(F.col("ts_us") / F.lit(span)).alias("_b"),
        _seq("ts_us", 3).alias("_at"),
        F.struct("*").alias("_p"),
    )
    none = F.lit(None).cast("long")
    here = o.select("user_id", "resource_id", "_b", "op", "seq", "rec", "clear", F.lit(False).alias("probed"))
    asked = p.select(
        "user_id", "resource_id", "_b", F.lit("probe").alias("op"),
        none.alias("seq"), none.alias("rec"), none.alias("clear"), F.lit(True).alias("probed"),
    )
    marks = here.unionByName(asked)
    users = _user_buckets(
        marks.filter(F.col("op") != "remove").select("user_id", "_b", "rec", "clear", "probed"), ttl
    ).filter("probed")
    past = Window.partitionBy("user_id", "resource_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    pairs = (
        marks.filter(F.col("op") != "clear")
        .groupBy("user_id", "resource_id", "_b")
        .agg(F.max("seq").alias("last"), F.max("probed").alias("probed"))
        .select("*", F.max("last").over(past).alias("before"))
        .filter(F.col("probed") & F.col("before").isNotNull())
    )
    first = F.lit(-(1 << 62))
    carried = F.struct("first_rec", "gap", "c_rec", "c_gap", "c_clear")
    stream = (
        p.withColumns({"op_seq": none, "clear_seq": none})
        .unionByName(
            o.select(
                "user_id", "resource_id", "_b", F.col("seq").alias("_at"), F.col("clear").alias("clear_seq"),
                F.when(F.col("op") != "clear", F.col("seq")).alias("op_seq"),
            ),
            allowMissingColumns=True,
        )
        .unionByName(users.select("user_id", "_b", first.alias("_at"), carried.alias("_u")), allowMissingColumns=True)
        .unionByName(
            pairs.select("user_id", "resource_id", "_b", first.alias("_at"), F.col("before").alias("op_seq")),
            allowMissingColumns=True,
        )
        .repartition("user_id", "_b")
    )
    upto = lambda *keys: (
        Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    of_pair, of_user = upto("user_id", "_b", "resource_id"), upto("user_id", "_b")
    seen = stream.select(
        "_at", "_p", F.max("op_seq").over(of_pair).alias("last_op"), F.max("clear_seq").over(of_user).alias("cleared"),
        F.max("_u").over(of_user).alias("u"),
    ).filter(F.col("_p").isNotNull())
    recorded = F.coalesce(F.col("u.first_rec") < F.col("_at"), F.lit(False))
    alive = recorded | F.coalesce(_instant("_at") - _instant("u.c_rec") < ttl, F.lit(False))
    began = F.when(recorded, F.coalesce("u.gap", "u.c_gap")).otherwise(F.col("u.c_gap"))
    last = F.col("last_op")
    named = F.col("_p.user_id").isNotNull() & F.col("_p.resource_id").isNotNull()
    owned = (
        named
        & alive
        & (F.pmod(last, F.lit(4)) == RANK["record"])
        & (last > F.coalesce(F.greatest("cleared", "u.c_clear"), first))
        & (last >= F.coalesce(began, first))
    )
    return seen.select("_p.*", F.coalesce(owned, F.lit(False)).alias("owned"))


def owned_set_asof(
    ops: DataFrame, as_of_us, ttl_seconds: int = DEFAULT_OWNERSHIP_TTL_SECONDS, bucket_us: int | None = None
) -> DataFrame:
    """D3: rows ``(user_id, resource_id)`` owned at one instant ``as_of`` (one
    row per member — a set is never collected into one array).

    At a single instant the running state collapses to plain aggregates: the user's last record,
    last clear and last gap from one row per bucket, and the last op per (user, resource)."""
    ttl = int(ttl_seconds) * _US
    o = _marks(ops.filter(F.col("ts_us") <= F.lit(as_of_us)), _span_us(ttl, bucket_us))
    users = (
        _user_buckets(o.filter(F.col("op") != "remove").select("user_id", "_b", "rec", "clear"), ttl)
        .groupBy("user_id")
        .agg(F.max("last_rec").alias("last_rec"), F.greatest(F.max("gap"), F.max("last_clear")).alias("since"))
        .filter(F.lit(as_of_us) - _instant("last_rec") < ttl)
    )
    last = (
        o.filter(F.col("op") != "clear").groupBy("user_id", "resource_id").agg(F.max("seq").alias("last_op"))
        .filter(F.pmod("last_op", F.lit(4)) == RANK["record"])
    )
    return last.join(users, "user_id").filter(
        (F.col("last_op") >= F.col("since")) & F.col("resource_id").isNotNull()
    ).select("user_id", "resource_id")


def resource_owner_asof(
    ops: DataFrame,
    probes: DataFrame,
    ttl_seconds: int = DEFAULT_OWNERSHIP_TTL_SECONDS,
    bucket_us: int | None = None,
) -> DataFrame:
    """Reverse lookup — last user to record the resource within TTL (per
    resource key), unless a later ``remove`` of that resource deleted the key.
    Every row of ``probes`` (``resource_id, ts_us`` and any other columns) with ``owner``.

    As in ``is_owner_asof``: the last operation before a bucket is carried on over one row per
    (resource, bucket), stands first in the bucket and reaches the probe by a running maximum."""
    ttl = int(ttl_seconds) * _US
    span = _span_us(ttl, bucket_us)
    op = F.struct(_seq("ts_us", _rank_col()).alias("seq"), "user_id")
    none = F.lit(None).cast(T.StructType().add("seq", "long").add("user_id", "string"))
    bucket = F.floor(F.col("ts_us") / F.lit(span)).alias("_b")
    done = ops.filter(F.col("op").isin("record", "remove")).select("resource_id", bucket, op.alias("op"))
    asked = probes.select("resource_id", bucket, _seq("ts_us", 3).alias("_at"), F.struct("*").alias("_p"))
    past = Window.partitionBy("resource_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        done.withColumn("probed", F.lit(False))
        .unionByName(asked.select("resource_id", "_b", none.alias("op"), F.lit(True).alias("probed")))
        .groupBy("resource_id", "_b")
        .agg(F.max("op").alias("last"), F.max("probed").alias("probed"))
        .select("*", F.max("last").over(past).alias("op"))
        .filter(F.col("probed") & F.col("op").isNotNull())
        .select("resource_id", "_b", F.lit(-(1 << 62)).alias("_at"), "op")
    )
    stream = (
        asked.unionByName(done.withColumn("_at", F.col("op.seq")), allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
        .repartition("resource_id", "_b")
    )
    upto = Window.partitionBy("resource_id", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    seen = stream.select("_at", "_p", F.max("op").over(upto).alias("last")).filter(F.col("_p").isNotNull())
    live = F.col("_p.resource_id").isNotNull() & (F.pmod("last.seq", F.lit(4)) == RANK["record"]) & (_instant("_at") - _instant("last.seq") < ttl)
    return seen.select("_p.*", F.when(live, F.col("last.user_id")).alias("owner"))


def user_stats(owned: DataFrame, k: int = 10, salt_buckets: int = 16) -> DataFrame:
    """Per user, owned count and the first ``k`` resources (sorted).

    Top-k is two-phase: ``k`` per ``(user, hash bucket)`` then ``k`` per user,
    so a user owning a third of all resources never lands in one sort.
    """
    from pyspark.sql import Window

    o = owned.select("user_id", "resource_id").distinct()
    counts = o.groupBy("user_id").agg(F.count(F.lit(1)).alias("owned_count"))
    salted = o.withColumn("_s", F.pmod(F.xxhash64("resource_id"), F.lit(salt_buckets)))
    w1 = Window.partitionBy("user_id", "_s").orderBy("resource_id")
    pre = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    # at most k × salt_buckets rows per user remain: bounded collect
    top = pre.groupBy("user_id").agg(
        F.slice(F.array_sort(F.collect_list("resource_id")), 1, k).alias("first_resources")
    )
    return counts.join(top, "user_id")
