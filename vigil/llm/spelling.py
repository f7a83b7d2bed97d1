"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted per task and summed, so a word of a third of all rows is one row per
task. Two words one insertion, deletion or replacement apart agree outside the edited
place. The shorter word's places are divided into ``SEGMENTS`` runs; the words that agree
outside one run (as the shorter word, and as one a letter longer) have one key and stand
in one group. A pair is judged in the group of the run that holds its first difference,
so every pair is found exactly once.

Groups are compared densely: code points of a tile's words stand in padded matrices, once
from the left and once from the right; the common prefix and the common suffix of a pair
are the places before the first unequal column in each. They reach the longer length
minus one if, and only if, the pair is one edit apart, as the words are distinct.
A group of more than ``BLOCK`` words is divided into blocks by hash and every block pair
is a tile of its own, so no task holds more than two blocks of a group. A tile gives one
row per word with a near word (their number, and the best), never its pairs.

A word's form has at least ten times its occurrences, so a chain of forms has at most
log10 of the largest count; pointers are doubled that often.

Defined cases: null texts have no words; a null doc_id reads "null" in the deletion rule;
repeated rows count again; ties of forms go to the smallest word in code-point order; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import shuffle_width, stage_table

#: Fixed value: the letters of a word (ASCII, and Latin-1 from U+00C0 on).
LETTERS = "A-Za-zÀ-ÿ"
LEAST = 7
SEGMENTS = 4
BLOCK = 1024
KEPT_WORDS = 50_000  # counts that a task holds before it hands them on
TILE_ROWS = 20_000  # rows of tiles that a task compares at once
CELLS = 1_000_000  # cells of a matrix, bounding the memory of a comparison


def count_words(docs: DataFrame, least: int = LEAST, deleted: int = 0) -> DataFrame:
    """word, n: runs of letters of at least ``least`` code points, A-Z in lower case.

    With ``deleted``, a run loses a code point where that number divides the CRC-32 of
    ``<doc_id>:<run>``, at that CRC modulo the run's length: planted spelling errors.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                # bytes.lower() changes A-Z alone
                runs = Counter(run_of.findall((text or "").encode().lower().decode()))
                if deleted:
                    head = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                    for run, n in runs.items():
                        h = zlib.crc32(run.encode(), head)
                        if h % deleted == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least:
                                continue
                        total[run] += n
                else:
                    total.update(runs)
                if len(total) > KEPT_WORDS:
                    yield counted(total)
                    total.clear()
        yield counted(total)

    def counted(total: Counter) -> pa.RecordBatch:
        columns = [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame, segments: int) -> DataFrame:
    """One row per word, role (the shorter, or the longer by one) and segment, with the key of
    what lies outside that segment."""
    roles = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = words.select("word", "n", roles.alias("more")).withColumn("short", F.length("word") - F.col("more"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
    start = F.floor(F.col("short") * F.col("segment") / segments).cast("int")
    end = F.floor(F.col("short") * (F.col("segment") + 1) / segments).cast("int")
    outside = F.xxhash64(
        "short",
        "segment",
        F.substring(F.col("word"), F.lit(1), start),
        F.substring(F.col("word"), end + F.col("more") + 1, F.length("word")),
    )
    return rows.where(end > start).select("short", "segment", outside.alias("key"), "word", "n")


def _tiled(keyed: DataFrame, block: int) -> DataFrame:
    """Rows with the tile (a pair of blocks) in which they meet; crowded groups have many."""
    crowded = keyed.groupBy("key").count().where(F.col("count") > block)
    crowded = crowded.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = keyed.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    same = F.col("own") == F.col("other")
    return rows.select("short", "key", tile.cast("long").alias("tile"), "segment", "own", same.alias("same"), "word", "n")


def _matrices(words: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points from the left and from the right, padded with -1 and -2."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<i4")
    width = int(lengths.max())
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(points)) - np.repeat(starts, lengths)
    left = np.full((len(lengths), width), -1, np.int32)
    left[row, column] = points
    right = np.full((len(lengths), width), -1, np.int32)
    right[row, np.repeat(lengths, lengths) - 1 - column] = points
    return left, right


def _common(matrix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of equal columns of rows a and b before the first unequal one, ``most`` at most."""
    unequal = matrix[a] != matrix[b]
    first = unequal.argmax(1)
    return np.where(unequal[np.arange(len(a)), first], np.minimum(first, most), most)


def near_pairs(
    words: pa.Array, a: np.ndarray, b: np.ndarray, short: np.ndarray, segment: np.ndarray, segments: int
) -> np.ndarray:
    """Which of the row pairs (a, b) are one edit apart, have ``short`` code points in the shorter
    word and their first difference in ``segment``."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    left, right = _matrices(words, lengths)
    least, longer = np.minimum(lengths[a], lengths[b]), np.maximum(lengths[a], lengths[b])
    prefix = _common(left, a, b, least)
    suffix = _common(right, a, b, least)
    # the run r of places with floor(short * r / segments) <= place, the last such one
    run = ((np.minimum(prefix, least - 1) + 1) * segments - 1) // short
    one_edit = (prefix + suffix >= longer - 1) & (longer - least <= 1) & (prefix < longer)
    return one_edit & (least == short) & (run == segment)


def _steps(pairs: np.ndarray, width: np.ndarray) -> Iterator[np.ndarray]:
    """The pairs by rising width, divided so that pairs times width stay near ``CELLS``."""
    pairs = pairs[np.argsort(width[pairs], kind="stable")]
    while len(pairs):
        n = max(1, CELLS // int(width[pairs[0]]))
        while n > 1 and min(n, len(pairs)) * int(width[pairs[min(n, len(pairs)) - 1]]) > 2 * CELLS:
            n //= 2
        yield pairs[:n]
        pairs = pairs[n:]


def _compare(rows: pa.Table, segments: int) -> pa.RecordBatch:
    """Near words within each tile of a sorted table: word, n_near, and the best as -n and word."""
    get = lambda name: rows.column(name).to_numpy()
    key, tile, n, short, segment, own, same = map(get, ("key", "tile", "n", "short", "segment", "own", "same"))
    words = rows.column("word").combine_chunks()
    lengths = pc.utf8_length(words).to_numpy()
    cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    ends = np.r_[cuts[1:], len(key)]
    after = np.repeat(ends, ends - cuts) - np.arange(len(key)) - 1  # later rows of a row's tile
    reached = np.r_[0, np.cumsum(after)]
    near: dict[int, list[int]] = {}
    low = 0
    while reached[low] < reached[-1]:
        # the next rows whose pairs together are few enough; at least one row
        high = max(low + 1, int(np.searchsorted(reached, reached[low] + CELLS // 8, side="right")) - 1)
        a = np.repeat(np.arange(low, high), after[low:high])
        b = a + 1 + np.arange(len(a)) - np.repeat(reached[low:high] - reached[low], after[low:high])
        meet = (same[a] | (own[a] != own[b])) & (short[a] == short[b]) & (segment[a] == segment[b])
        meet = np.flatnonzero(meet & (np.minimum(lengths[a], lengths[b]) == short[a]))
        for step in _steps(meet, np.maximum(lengths[a], lengths[b])):
            x, y = a[step], b[step]
            some, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            found = near_pairs(
                words.take(pa.array(some)), place[: len(x)], place[len(x) :], short[x], segment[x], segments
            )
            for i, j in zip(x[found].tolist(), y[found].tolist()):
                near.setdefault(i, []).append(j)
                near.setdefault(j, []).append(i)
        low = high
    text = dict(zip(near, words.take(pa.array(list(near), pa.int64())).to_pylist()))
    count = dict(zip(near, n[list(near)].tolist())) if near else {}
    best = [min((-count[j], text[j]) for j in near[i]) for i in near]
    columns = [list(text.values()), [len(v) for v in near.values()], [m for m, _ in best], [w for _, w in best]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], ["word", "n_near", "minus_n", "best"]
    )


def near_words(words: DataFrame, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """word, n_near (words one edit away), best (the most frequent of them) and best_n.

    ``words`` has distinct words and their n; words without a near word have no row.
    """
    rows = _tiled(_keyed(words, segments), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < TILE_ROWS:
                continue
            table = pa.Table.from_batches(held)
            key, tile = table.column("key").to_numpy(), table.column("tile").to_numpy()
            inner = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
            done = int(inner[-1]) + 1 if len(inner) else 0  # the last tile may go on
            if done:
                yield _compare(table.slice(0, done), segments)
            held = table.slice(done).to_batches()
        if held:
            yield _compare(pa.Table.from_batches(held), segments)

    found = (
        rows.repartition(shuffle_width(words.sparkSession), "key", "tile")
        .sortWithinPartitions("short", "key", "tile")
        .mapInArrow(run, "word string, n_near long, minus_n long, best string")
    )
    best = F.min(F.struct("minus_n", "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus_n")).alias("best_n")
    )


def group_variants(
    counts: DataFrame, least_n: int = 2, factor: int = 10, segments: int = SEGMENTS, block: int = BLOCK
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word with at least ``least_n`` occurrences.

    A word's form is the most frequent near word, if it has at least ``factor`` times the
    word's occurrences; its root is the end of the chain of forms.
    """
    words = stage_table(counts.where(F.col("n") >= least_n), "words")
    judged = words.join(near_words(words, segments, block), "word", "left")
    has_form = F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False))
    judged = stage_table(
        judged.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    chains = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    top = judged.agg(F.max("form_n")).first()[0]  # every step multiplies n by the factor, so this bounds the chain
    steps = math.ceil(math.log(top / least_n, factor)) + 1 if top else 0
    reach = 1
    while reach < steps:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = stage_table(
            chains.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chains"
        )
        reach *= 2
    return judged.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
