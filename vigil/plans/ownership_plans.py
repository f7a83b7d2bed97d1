"""Plans for ownership state (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import ownership as O
from vigil.plans import register
from vigil.plans.oracle_views import (
    access_log_sql,
    is_owner_sql,
    ownership_ops_sql,
    ownership_state_sql,
    with_views,
)
from vigil.sources import fixtures as FX
from vigil.sources.fixtures import epoch_us
from vigil.sources.tables import table

TTL_S = 86400
TTL_US = TTL_S * 1_000_000
BULK_TTL_S = 90 * 86400


def _views(removes=False, clears=False, ttl_us=TTL_US, **extra) -> str:
    v = dict(access_log=access_log_sql(), ops=ownership_ops_sql(removes, clears))
    v.update(ownership_state_sql(ttl_us))
    v.update(extra)
    return with_views(**v)


_PROBES = "SELECT event_id AS probe_id, user_id, resource_id, ts_us FROM access_log WHERE NOT success AND resource_owner_id IS NULL"


def _probe_df(spark, sf):
    log = FX.access_log(spark, sf)
    return log.filter(~F.col("success") & F.col("resource_owner_id").isNull()).select(
        "event_id", "user_id", "resource_id", "ts_us"
    )


def _is_owner_plan(removes, clears):
    def q(spark, sf):
        return O.is_owner_asof(FX.ownership_ops(spark, sf, removes, clears), _probe_df(spark, sf), TTL_S)

    sql = _views(removes, clears, probes=_PROBES) + (
        "SELECT p.probe_id AS event_id, p.user_id, p.resource_id, p.ts_us, o.owned FROM probes p JOIN ("
        + is_owner_sql(TTL_US, "probes")
        + ") o ON o.probe_id = p.probe_id"
    )
    return q, sql


for _name, _rm, _cl in (("ownership_is_owner", False, False), ("ownership_remove", True, False), ("ownership_clear", True, True)):
    _fn, _sql = _is_owner_plan(_rm, _cl)
    register(_name, _sql)(_fn)


@register(
    "ownership_record",
    _views()
    + "SELECT user_id, resource_id, ts_us, ttl_session, ts_us + "
    + str(TTL_US)
    + " AS expires_us FROM recs_s",
)
def q_record(spark, sf):
    ops = FX.ownership_ops(spark, sf)
    return O.ttl_sessions(ops, TTL_S).drop("seq")


def _as_of(df, col="ts_us"):
    # one scalar (an aggregate) is all that reaches the driver
    return df.agg(F.max(col)).first()[0]


_SET_SQL = _views(
    asof_t="SELECT max(ts_us) AS t FROM access_log",
    cand="SELECT DISTINCT r.user_id, r.resource_id, a.t AS ts_us, hash(r.user_id, r.resource_id) AS probe_id "
    "FROM ops r, asof_t a WHERE r.op = 'record' AND r.ts_us <= a.t",
    owned_now="SELECT c.user_id, c.resource_id FROM cand c JOIN (" + is_owner_sql(TTL_US, "cand") + ") o "
    "ON o.probe_id = c.probe_id WHERE o.owned",
)


def _owned_now(spark, sf):
    ops = FX.ownership_ops(spark, sf)
    return O.owned_set_asof(ops, _as_of(FX.access_log(spark, sf)), TTL_S)


@register("ownership_set", _SET_SQL + "SELECT user_id, resource_id FROM owned_now")
def q_set(spark, sf):
    return _owned_now(spark, sf)


@register("ownership_count", _SET_SQL + "SELECT user_id, count(*) AS owned_count FROM owned_now GROUP BY user_id")
def q_count(spark, sf):
    return _owned_now(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("owned_count"))


@register(
    "user_stats",
    _SET_SQL
    + "SELECT user_id, count(*) AS owned_count, array_to_string(list_slice(list_sort(list(resource_id)), 1, 10), ',') "
    "AS first_resources FROM owned_now GROUP BY user_id",
)
def q_user_stats(spark, sf):
    st = O.user_stats(_owned_now(spark, sf), k=10)
    return st.select("user_id", "owned_count", F.array_join("first_resources", ",").alias("first_resources"))


@register(
    "ownership_owner",
    _views(
        removes=True,
        probes="SELECT event_id AS probe_id, resource_id, ts_us FROM access_log WHERE NOT success",
    )
    + f"""
    SELECT p.probe_id AS event_id, p.resource_id, p.ts_us,
           CASE WHEN l.op = 'record' AND p.ts_us - l.seq // 4 < {TTL_US} THEN l.user_id END AS owner
    FROM probes p LEFT JOIN LATERAL (
        SELECT o.op, o.seq, o.user_id FROM ops_s o
        WHERE o.resource_id = p.resource_id AND o.op IN ('record', 'remove') AND o.seq <= p.ts_us * 4 + 3
        ORDER BY o.seq DESC, o.user_id DESC LIMIT 1
    ) l ON true""",
)
def q_owner(spark, sf):
    ops = FX.ownership_ops(spark, sf, removes=True)
    log = FX.access_log(spark, sf).filter(~F.col("success"))
    return O.resource_owner_asof(ops, log.select("event_id", "resource_id", "ts_us"), TTL_S)


_BULK_SQL = with_views(
    bulk="""SELECT 'cust_' || o_custkey AS user_id, CAST(o_orderkey AS VARCHAR) AS resource_id,
                   epoch_us(o_orderdate) AS ts_us, 'record' AS op FROM orders""",
    ops="SELECT * FROM bulk",
    **ownership_state_sql(BULK_TTL_S * 1_000_000),
    asof_t="SELECT max(ts_us) AS t FROM ops",
    cand="SELECT DISTINCT r.user_id, r.resource_id, a.t AS ts_us, hash(r.user_id, r.resource_id) AS probe_id "
    "FROM ops r, asof_t a WHERE r.ts_us <= a.t",
    owned_now="SELECT c.user_id, c.resource_id FROM cand c JOIN ("
    + is_owner_sql(BULK_TTL_S * 1_000_000, "cand")
    + ") o ON o.probe_id = c.probe_id WHERE o.owned",
)


@register("ownership_bulk", _BULK_SQL + "SELECT user_id, count(*) AS owned_count FROM owned_now GROUP BY user_id")
def q_bulk(spark, sf):
    ops = O.bulk_records(FX.ownership_bulk_input(spark, sf))
    as_of = _as_of(table(spark, sf, "orders").select(epoch_us("o_orderdate").alias("ts_us")))
    owned = O.owned_set_asof(ops, as_of, BULK_TTL_S)
    return owned.groupBy("user_id").agg(F.count(F.lit(1)).alias("owned_count"))
