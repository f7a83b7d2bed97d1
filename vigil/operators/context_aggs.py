"""Context aggregates over event history.

The reference asks a remote service per alert; here each lookup is one
aggregate over the whole history, computed once and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.sequence import running

_US = 1_000_000
DAY_US = 86_400 * _US

# Fixed values that must equal the reference's results: the wording of the
# prevalence / baseline / network sentences.
PREV_NEW = "Never seen before in this environment (new IOC)"
PREV_ONE = "Seen on 1 host only (rare)"
PREV_FEW = "Seen on {} hosts in last 30 days (uncommon)"
PREV_MODERATE = "Seen on {} hosts in last 30 days (moderate prevalence)"
PREV_WIDE = "Seen on {}+ hosts in last 30 days (widespread)"
BASELINE_NONE = "No historical baseline available for this user"
BASELINE_TEXT = "User typically logs in from: {}. Average {} logins/day."
NET_NEW = "New IP - 0 prior connections to our infrastructure"
NET_RARE = "Rare IP - only {} prior connections"
NET_UNCOMMON = "Uncommon IP - {} prior connections"
NET_KNOWN = "Known IP - {}+ connections to our infrastructure"


def lookback(df: DataFrame, as_of_us: int, days: int, ts: str = "ts_us") -> DataFrame:
    return df.filter((F.col(ts) >= F.lit(as_of_us - days * DAY_US)) & (F.col(ts) <= F.lit(as_of_us)))


def prevalence(sightings: DataFrame, approx: bool = False) -> DataFrame:
    """Per indicator — distinct assets, first/last seen (aggregates only;
    the asset names are the relation ``prevalence_assets``)."""
    cnt = F.approx_count_distinct("asset") if approx else F.count_distinct("asset")
    return sightings.groupBy("indicator").agg(
        cnt.alias("affected_asset_count"), F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us")
    )


def prevalence_assets(sightings: DataFrame) -> DataFrame:
    return sightings.select("indicator", "asset").distinct()


def top_k_per_key(df: DataFrame, key: str, order: list[Column], k: int, salt_col: str | None = None, buckets: int = 32) -> DataFrame:
    """Rows ranked ``1..k`` per key, two-phase so a hot key is split first:
    top-k within ``(key, hash bucket)``, then top-k of those candidates."""
    hashed = F.xxhash64(F.col(salt_col)) if salt_col else F.xxhash64(*[F.col(c) for c in df.columns])
    salt = F.pmod(hashed, F.lit(buckets))
    s = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    pre = s.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(key).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def user_baseline(logins: DataFrame, days: int = 30, k_loc: int = 3, k_ip: int = 3, k_agent: int = 5) -> DataFrame:
    """Typical locations / ips (top by count), top agents, logins per day."""

    def top(attr: str, k: int, name: str) -> DataFrame:
        c = logins.groupBy("user_id", attr).agg(F.count(F.lit(1)).alias("n"))
        t = top_k_per_key(c, "user_id", [F.col("n").desc(), F.col(attr)], k, salt_col=attr)
        # ≤ k rows per user remain: a bounded collect
        return t.groupBy("user_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", attr))), lambda x: x[attr]).alias(name)
        )

    per_user = logins.groupBy("user_id").agg((F.count(F.lit(1)) / F.lit(float(days))).alias("average_daily_logins"))
    return (
        per_user.join(top("location", k_loc, "typical_locations"), "user_id", "left")
        .join(top("ip", k_ip, "typical_source_ips"), "user_id", "left")
        .join(top("agent", k_agent, "typical_user_agents"), "user_id", "left")
        .withColumn("baseline_period_days", F.lit(days))
    )


def network_context(conns: DataFrame, reputation: DataFrame | None = None) -> DataFrame:
    """Per ip — connection count, first/last seen, distinct connected assets,
    reputation from a dimension (left join)."""
    agg = conns.groupBy("ip").agg(
        F.count(F.lit(1)).alias("connection_count"),
        F.min("ts_us").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.count_distinct("asset").alias("connected_asset_count"),
    )
    if reputation is not None:
        agg = agg.join(reputation, "ip", "left")
    return agg


def fmt_prevalence(n: Column) -> Column:
    """G15."""
    s = n.cast("string")
    return (
        F.when(n == 0, F.lit(PREV_NEW))
        .when(n == 1, F.lit(PREV_ONE))
        .when(n < 5, F.format_string(PREV_FEW.replace("{}", "%s"), s))
        .when(n < 20, F.format_string(PREV_MODERATE.replace("{}", "%s"), s))
        .otherwise(F.format_string(PREV_WIDE.replace("{}", "%s"), s))
    )


def fmt_baseline(locations: Column, avg: Column) -> Column:
    """First three locations and ``%.1f`` logins/day, or the no-baseline text."""
    return F.when(
        locations.isNull() | (F.size(locations) == 0), F.lit(BASELINE_NONE)
    ).otherwise(
        F.format_string(BASELINE_TEXT.replace("{}", "%s", 1).replace("{}", "%.1f"), F.array_join(F.slice(locations, 1, 3), ", "), avg)
    )


def fmt_network(n: Column) -> Column:
    """G17."""
    s = n.cast("string")
    return (
        F.when(n == 0, F.lit(NET_NEW))
        .when(n < 5, F.format_string(NET_RARE.replace("{}", "%s"), s))
        .when(n < 50, F.format_string(NET_UNCOMMON.replace("{}", "%s"), s))
        .otherwise(F.format_string(NET_KNOWN.replace("{}", "%s"), s))
    )


def similar_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, lists: int | None = None, block_rows: int = 4096) -> DataFrame:
    """Cosine similarity of each query vector to the corpus vectors, exact top-k.

    Candidates come from inverted lists that are left out where the triangle inequality rules
    them out (``vigil.operators.similarity``). They are merged by the two-phase top-k, and the
    winners fetch their other columns.

    Scores are compared at 12 decimals, so that equal vectors tie (the smaller ``vec_id``
    first); a vector that has no cosine (null, zero, null or non-finite parts) has a NULL
    score and comes last, so only the ``k`` smallest ``vec_id`` of those can be an answer.
    """
    from vigil.operators.similarity import neighbours, usable

    def least(rows: DataFrame) -> Column:
        ids = [r[0] for r in rows.select("vec_id").orderBy("vec_id").limit(k).collect()]
        return F.array(*map(F.lit, ids)).cast("array<long>")

    has = usable(F.col("v"))
    scored = neighbours(queries.filter(usable(F.col("qv"))), corpus.filter(has), k, lists, block_rows)
    last = F.when(usable(F.col("qv")), least(corpus.filter(~has))).otherwise(least(corpus))
    without = queries.select("query_id", F.explode(last).alias("vec_id"), F.lit(None).cast("double").alias("similarity"))
    cand = scored.filter("pairs is null").drop("pairs").unionByName(without)
    order = [F.col("similarity").desc_nulls_last(), F.col("vec_id")]
    top = top_k_per_key(cand, "query_id", order, k, salt_col="vec_id")
    return top.join(corpus.select("vec_id", "disposition", "analyst_notes"), "vec_id").select(
        "query_id", "vec_id", "disposition", "analyst_notes", "similarity", "rank"
    )


def interval_join_counts(
    alerts: DataFrame, events: DataFrame, key: str, before_us: int, bucket_us: int = DAY_US
) -> DataFrame:
    """Per alert, the number and last time of events on the same key with
    ``alert_ts - before ≤ ts ≤ alert_ts``.

    No alert meets an event: both lie on one time line per key, where every alert reads
    the running count (and latest event) at its end and just before its start. The
    running values split a hot key by time bucket."""
    at_start, an_event, at_end = 0, 1, 2  # order of rows of one instant
    none = F.lit(None)

    def probe(kind: int, ts: Column) -> DataFrame:
        return alerts.select(
            F.col(key).alias("_k"), ts.alias("_t"), F.lit(kind).alias("_o"), "alert_key", F.col("ts_us").alias("_alert_us")
        )

    line = (
        events.filter(F.col(key).isNotNull()).select(
            F.col(key).alias("_k"), F.col("ts_us").alias("_t"), F.lit(an_event).alias("_o"),
            none.cast(alerts.schema["alert_key"].dataType).alias("alert_key"), none.cast("bigint").alias("_alert_us"),
        )
        .unionByName(probe(at_start, F.col("ts_us") - F.lit(before_us)))
        .unionByName(probe(at_end, F.col("ts_us")))
    )
    is_event = F.col("_o") == an_event
    seen = running(
        line, ["_k"], [F.col("_t"), F.col("_o")],
        {"n": ("sum", is_event.cast("bigint")), "last": ("max", F.when(is_event, F.col("_t")))}, "_t", bucket_us,
    ).filter(~is_event)
    n, end = F.col("n"), F.col("_o") == at_end
    both = seen.groupBy("alert_key", F.col("_k").alias(key), F.col("_alert_us").alias("ts_us")).agg(
        # rows repeated in ``alerts`` stand in both sums alike and count once per row
        F.sum(F.when(end, n).otherwise(-n)).alias("events_in_window"), F.max(F.when(end, F.col("last"))).alias("_last")
    )
    return both.select(
        "alert_key", key, "ts_us", "events_in_window", F.when(F.col("events_in_window") > 0, F.col("_last")).alias("last_event_us")
    )


def ip_words(ip: Column) -> Column:
    """An IPv4 or IPv6 address as ``struct<hi: bigint, lo: bigint>`` (its 128 bits); null if malformed.

    An IPv4 address stands at its IPv4-mapped place (``::ffff:a.b.c.d``), so both families share one
    order and one prefix length scale. Nothing raises, whatever the text.
    """
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    dotted = rf"{octet}\.{octet}\.{octet}\.{octet}$"
    parts = [F.regexp_extract(ip, dotted, i).try_cast("int") for i in range(1, 5)]
    pair = lambda a, b: F.lpad(F.lower(F.hex(parts[a] * 256 + parts[b])), 4, "0")
    as_groups = F.concat(pair(0, 1), F.lit(":"), pair(2, 3))
    has_v4 = ip.rlike(r"(^|:)" + dotted)
    text = (
        F.when(ip.rlike("^" + dotted), F.concat(F.lit("::ffff:"), as_groups))
        .when(has_v4, F.concat(F.regexp_replace(ip, dotted, ""), as_groups))
        .otherwise(F.lower(ip))
    )
    halves = F.split(text, "::", -1)
    groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    n = F.size(left) + F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0)))
    every = F.concat(left, F.when(F.size(halves) == 2, zeros).otherwise(F.array().cast("array<string>")), right)
    valid = (
        ((F.size(halves) == 1) & (n == 8) | (F.size(halves) == 2) & (n <= 7))
        & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    )
    digits = F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")
    word = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).try_cast("bigint")
    return F.when(F.coalesce(valid, F.lit(False)), F.struct(word(1).alias("hi"), word(17).alias("lo")))


def _prefix(words: Column, bits: Column) -> Column:
    """The first ``bits`` of the 128, the rest zero."""
    mask = lambda k: F.when(k <= 0, F.lit(0).cast("bigint")).when(k >= 64, F.lit(-1).cast("bigint")).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - k).cast("int"))
    )
    return F.struct(
        words["hi"].bitwiseAND(mask(bits)).alias("hi"), words["lo"].bitwiseAND(mask(bits - F.lit(64))).alias("lo")
    )


def cidr_ranges(cidrs: DataFrame) -> DataFrame:
    """``cidr, label`` → ``cidr, label, bits, prefix``: the prefix index of IPv4 and IPv6 ranges.

    A range without a length is one address. Malformed ranges are left out.
    """
    base = F.split("cidr", "/", -1)
    words = ip_words(F.trim(base.getItem(0)))
    four = ~base.getItem(0).contains(":")
    given = F.when(F.size(base) == 1, F.when(four, 32).otherwise(128)).otherwise(F.trim(F.get(base, F.lit(1))).try_cast("int"))
    most = F.when(four, 32).otherwise(128)
    ok = words.isNotNull() & given.between(0, most) & (F.size(base) <= 2)
    out = cidrs.select("cidr", "label", words.alias("_w"), (given + F.when(four, 96).otherwise(0)).alias("bits"), ok.alias("_ok"))
    return out.filter("_ok").select("cidr", "label", "bits", _prefix(F.col("_w"), F.col("bits")).alias("prefix"))


def cidr_match(ips: DataFrame, ranges: DataFrame, longest: bool = False) -> DataFrame:
    """Every row of ``ips`` (column ``ip``) with every range that holds it (``cidr``, ``label``), or with
    ``longest`` only with the narrowest ones. A malformed address is in no range.

    An address is in a range if their first ``bits`` agree. ``ranges`` has few different lengths (129
    at most, one scalar list), so an address takes one row per length and meets its ranges by an
    equi-join on (length, prefix): nested ranges and both families alike, no range condition.
    """
    lengths = sorted(r["bits"] for r in ranges.select("bits").distinct().collect())
    x = ips.withColumn("_w", ip_words(F.col("ip"))).filter(F.col("_w").isNotNull())
    x = x.withColumn("bits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    x = x.withColumn("prefix", _prefix(F.col("_w"), F.col("bits")))
    j = x.join(ranges, ["bits", "prefix"])
    if longest:
        w = Window.partitionBy("_w", *ips.columns)
        j = j.withColumn("_most", F.max("bits").over(w)).filter(F.col("bits") == F.col("_most")).drop("_most")
    return j.drop("bits", "prefix", "_w")
