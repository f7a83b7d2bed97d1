"""Mixing sources to target weights by weighted sampling without replacement.

Native: only DataFrame functions. Efraimidis-Spirakis: every document gets an
exponential key -ln(u) / weight, where u is a hash of its id and the weight its
quality; inside a source, documents are taken in ascending key order until the
source's token budget is met. A budget above the source's size first takes
complete epochs and spends only the rest by keys.

Nothing sorts a whole source. A monotone bucket function spreads a source's keys
over about sqrt(documents) buckets; a histogram of sizes per bucket, summed up in
bucket order, finds the one bucket in which the budget ends, and only that
bucket's rows are ordered by key. The outcome is one row per source: its epochs
and the last (bucket, key) that its fractional epoch takes. Documents apply it
row by row, so their texts are never shuffled.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; a null doc_id hashes as such; rows with equal doc_id and weight share
their key and so their fate; a source of size 0 has target 0; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import WORD, stage_table

#: No document is taken more often than this.
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Weight in 0.05..1: falls with the share of symbols that are neither letters nor white space."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]"))
    share = odd / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * share)


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an MD5 of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(2.0**52)) / weight


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the source does, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("~"))


def sized_rows(docs: DataFrame, quality=text_quality, seed: str = "mix") -> DataFrame:
    """One slim row per document: id, source key, words, sampling weight and key."""
    rows = docs.select(
        F.col("doc_id").alias("id"),
        source_key(F.col("source")).alias("src"),
        n_words(F.col("text")).alias("words"),
        quality(F.col("text")).alias("weight"),
    )
    return rows.withColumn("key", sampling_key(F.col("id"), F.col("weight"), seed))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Weights by the rank of the source key. ``sources`` has one row per source."""
    rank = F.row_number().over(Window.orderBy("src")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("share", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, cap: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: all sizes shared by weight, at most ``cap`` times a source's size.

    Sharing the excess again and again ends where every source below its cap has the
    same level per weight. Sources meet their caps in the order of cap / share, so the
    level after the first k of them is (total - their caps) / (weights of the others);
    the right k is the first whose level the next source's cap can hold.
    """
    limit = F.lit(float(cap)) * F.col("size")
    order = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    filled = (
        sources.withColumn("ratio", limit / F.col("share"))
        .withColumn("total", F.sum("size").over(all_rows).cast("double"))
        .withColumn("weights", F.sum("share").over(all_rows))
        .withColumn("capped", F.coalesce(F.sum(limit).over(order), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("share").over(order), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone")))
        .withColumn("level", F.max("level").over(all_rows))
    )
    return filled.withColumn("target", F.least(limit, F.col("share") * F.col("level"))).drop("ratio", "total", "weights", "capped", "gone", "level")


def _bucket(key: Column, weights: Column, buckets: Column) -> Column:
    """Monotone in key and about evenly filled: the expected share of keys below, for the
    weight deciles of the source, times the number of buckets."""
    below = F.aggregate(weights, F.lit(0.0), lambda s, w: s + (F.lit(1.0) - F.exp(-w * key))) / F.size(weights)
    return F.floor(below * buckets).cast("long")


def mixing_plan(rows: DataFrame, weights=cyclic_weights, cap: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: src, size, target, epochs, deciles, buckets, and the end of the
    fractional epoch as (end_bucket, end_key). ``rows`` come from ``sized_rows``, staged."""
    deciles = [x / 10 + 0.05 for x in range(10)]
    sources = rows.groupBy("src").agg(
        F.sum("words").alias("size"),
        F.percentile_approx("weight", deciles, 1000).alias("deciles"),
        F.ceil(F.sqrt(F.count("*"))).cast("double").alias("buckets"),
    )
    epochs = F.least(F.floor(F.col("target") / F.col("size")), F.lit(cap)).cast("long")
    plan = stage_table(
        water_fill(weights(sources), cap)
        .withColumn("epochs", F.when(F.col("size") > 0, epochs).otherwise(F.lit(0).cast("long")))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("size")),
        "sources",
    )
    placed = rows.join(plan.where("rest > 0"), "src").select(
        "src", "rest", "words", "key", _bucket(F.col("key"), F.col("deciles"), F.col("buckets")).alias("bucket")
    )
    running = Window.partitionBy("src").orderBy("bucket")
    last = (
        placed.groupBy("src", "rest", "bucket")
        .agg(F.sum("words").alias("words"))
        .withColumn("upto", F.sum("words").over(running))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("src")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
        .select("src", F.col("end.bucket").alias("bucket"), "end.before")
    )
    last = stage_table(last, "last_buckets")
    by_key = Window.partitionBy("src").orderBy("key")
    ends = (
        placed.join(last, ["src", "bucket"])
        .groupBy("src", "rest", "before", "bucket", "key")
        .agg(F.sum("words").alias("words"))
        .withColumn("upto", F.col("before") + F.sum("words").over(by_key))
        # a row is in if at least half of it is inside the budget
        .where(F.col("upto") - F.col("words") / 2 <= F.col("rest"))
        .groupBy("src")
        .agg(F.max("key").alias("end_key"))
    )
    return stage_table(
        plan.join(last.select("src", F.col("bucket").alias("end_bucket")), "src", "left").join(ends, "src", "left"),
        "mixing_plan",
    )


def times_taken(plan: DataFrame) -> Column:
    """How often a row (joined to its plan row, with its key) is in the mix."""
    bucket = _bucket(F.col("key"), F.col("deciles"), F.col("buckets"))
    inside = (
        (F.col("rest") > 0)
        & (
            F.col("end_bucket").isNull()  # the rest covers the whole source
            | (bucket < F.col("end_bucket"))
            | ((bucket == F.col("end_bucket")) & (F.col("key") <= F.coalesce("end_key", F.lit(-1.0))))
        )
    )
    return F.col("epochs") + F.when(inside, 1).otherwise(0)


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, times, taken per document."""
    rows = stage_table(sized_rows(docs, **how), "sized_rows")
    plan = mixing_plan(rows)
    return rows.join(plan, "src").select(
        F.col("id").alias("doc_id"),
        F.col("words").alias("size"),
        F.col("size").alias("source_size"),
        "target",
        times_taken(plan).alias("times"),
        (times_taken(plan) * F.col("words")).alias("taken"),
    )


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    plan = mixing_plan(stage_table(sized_rows(docs, **how), "sized_rows"))
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    quality, seed = how.get("quality", text_quality), how.get("seed", "mix")
    keyed = row.select(
        "row",
        source_key(F.col("row.source")).alias("src"),
        sampling_key(F.col("row.doc_id"), quality(F.col("row.text")), seed).alias("key"),
    )
    return (
        keyed.join(plan, "src")
        .select("row", times_taken(plan).alias("times"))
        .where("times > 0")
        .select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row"))
        .select("row.*")
    )
