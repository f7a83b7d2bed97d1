"""Suffix-array dedup: bytes inside any string of ``window`` bytes that starts elsewhere, too.

One suffix array of a whole corpus fits nowhere, so the corpus is first cut into groups
that can be searched alone, with nothing lost:

* Anchors. Every window of ``window`` bytes picks one of its ``GRAM``-byte grams, the
  first with the smallest hash. Equal windows pick equal grams at the same offset, so all
  copies of a window meet under one gram, each window start under exactly one anchor.
* Contexts. The bytes of all windows that picked an anchor are its context. Equal contexts
  (exact copies) are one row with a count; a context is fetched from one of its texts.
  Grams that stand once in the corpus are dropped before any bytes move.
* Suffix arrays. Contexts of whole gram groups are laid end to end as sequences of 8-byte
  blocks, aligned to the anchor, and sorted by ``suffix_array``. A window is a run of whole
  blocks (its core) and less than a block at either side, so neighbours in the suffix array
  that share the core's blocks form a class; in a class, the eight possible pairs of rims
  are compared as one 64-bit number each. This decides every window exactly.
* Large groups. Contexts of a gram with more than ``TILE`` different ones are dealt to tiles
  by hash. Windows of a tiled gram are also counted across tiles by a 128-bit hash, so a
  gram in a third of all documents takes many tasks and loses nothing.

Texts travel twice: once to fetch contexts, once to cut. Rows with equal text share one
key, and a text's outcome is one row.

Defined cases: a null text is empty; texts shorter than the window keep all bytes; two rows
with the same text are two places, so such a text is removed if it has a whole window;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import key_groups, shuffle_width, stage_table
from vigil.llm.suffix_array import suffix_array

WINDOW, GRAM, BLOCK = 200, 32, 8
TILE, BATCH = 4096, 2048
_POSITION = np.uint64((1 << 28) - 1)

_rng = np.random.default_rng(8)
#: Random odd 64-bit values for bytes; the base of the rolling hash and its inverse.
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling."""
    while len(_powers[base]) < n:
        have = _powers[base]
        _powers[base] = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    return _powers[base][:n]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class SpanHashes:
    """64-bit hashes of any spans of a byte string, from one prefix sum."""

    def __init__(self, raw: np.ndarray):
        terms = _BYTES[raw] * _power(_BASE, len(raw))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.undo = _power(pow(_BASE, -1, 2**64), len(raw) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scramble((self.sums[end] - self.sums[start]) * self.undo[start])


def _first_smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` keys, from running minima of blocks."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, window: int = WINDOW):
    """Anchors of a text: gram hash, context hash, position, window starts before it, their number."""
    n = len(raw)
    if n < window:
        return None
    # A text longer than 2**27 bytes is cut in overlapping pieces; its window starts stay whole.
    step = 1 << 27
    if n > step + window:
        parts = []
        for low in range(0, n - window + 1, step):
            part = anchors(raw[low : low + step + window - 1], window)
            parts.append((part[0], part[1], part[2] + low, part[3], part[4]))
        return tuple(np.concatenate(x) for x in zip(*parts))
    gram = min(GRAM, window)
    spans = SpanHashes(np.frombuffer(raw, np.uint8))
    at = np.arange(n - gram + 1)
    grams = spans(at, at + gram)
    picked = _first_smallest((grams & ~_POSITION) | at.astype(np.uint64), window - gram + 1) & _POSITION
    picked = picked.astype(np.int64)
    first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
    count = np.diff(np.append(first, len(picked)))
    position = picked[first]
    lead = position - first
    shape = (lead * window + count).astype(np.uint64)
    contexts = spans(first, first + count + window - 1) ^ _scramble(shape + np.uint64(1))
    return grams[position], contexts, position, lead, count


def repeated_starts(contexts: list[bytes], leads: np.ndarray, copies: np.ndarray, window: int = WINDOW):
    """For contexts of whole gram groups: whether each of their window starts has a twin.

    Returns (owner, start, repeated, class): one entry per window start, classes in order of
    equal windows.
    """
    rim = BLOCK
    core = (window - rim) // BLOCK  # whole blocks in any window, wherever the grid falls
    lengths = np.array([len(c) for c in contexts])
    counts = lengths - window + 1
    shift = leads % BLOCK  # first place of the anchor's grid
    cores = np.maximum(0, -(-(counts - 1 - shift) // BLOCK)) + 1
    blocks = cores + core - 1
    raw = np.frombuffer(b"\0" * rim + b"".join(contexts) + b"\0" * (2 * rim), np.uint8)
    base = rim + np.cumsum(lengths) - lengths
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)

    def at(places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[places]).view("<u8").ravel()

    def within(sizes: np.ndarray) -> np.ndarray:
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    n = len(contexts)
    block_values = at(np.repeat(base + shift, blocks) + BLOCK * within(blocks))
    symbols = np.unique(block_values, return_inverse=True)[1] + n
    # each context ends with a symbol of its own, below all others, so no run crosses contexts
    ends = np.cumsum(blocks)
    sequence = np.insert(symbols, ends, np.arange(n))
    head = ends - blocks + np.arange(n)  # where each context starts in the sequence

    owner_of = np.repeat(np.arange(n), blocks + 1)
    order = np.array(suffix_array(sequence), dtype=np.int64)
    which = owner_of[order]
    index = order - head[which]
    is_core = index < cores[which]
    order, which, index = order[is_core], which[is_core], index[is_core]
    same = np.ones(max(0, len(order) - 1), bool)
    for d in range(core):
        same &= sequence[order[:-1] + d] == sequence[order[1:] + d]
    group = np.cumsum(np.append(False, ~same))  # runs of suffixes that share a whole core

    place = base[which] + shift[which] + BLOCK * index  # where the core starts, in bytes
    left, right = at(place - rim), at(place + core * BLOCK)
    owners, starts, keys, kinds, rests = [], [], [], [], []
    # bytes of a window outside its core: one block (the key) and, if the window is no multiple of a block, a rest
    rest = window - core * BLOCK - rim
    for t in range(BLOCK):
        start = shift[which] + BLOCK * index - t
        ok = (start >= 0) & (start < counts[which])
        low = np.uint64((1 << (8 * (rim - t))) - 1 if t else 2**64 - 1)
        owners.append(which[ok])
        starts.append(start[ok])
        keys.append((right[ok] & low) | (left[ok] & ~low))
        kinds.append(group[ok] * BLOCK + t)
        if rest:
            after = at(place[ok] + core * BLOCK + rim - t)
            rests.append(after & np.uint64((1 << (8 * rest)) - 1))
    names = [keys, kinds, rests] if rest else [keys, kinds]
    owner, start, *names = map(np.concatenate, (owners, starts, *names))
    by = np.lexsort(names)
    owner, start, names = owner[by], start[by], [x[by] for x in names]
    changes = np.any([x[1:] != x[:-1] for x in names], axis=0)
    fresh = np.append(True, changes) if len(owner) else np.empty(0, bool)
    label = np.cumsum(fresh) - 1
    total = np.bincount(label, weights=copies[owner]) if len(label) else np.empty(0)
    return owner, start, total[label] >= 2 if len(label) else np.empty(0, bool), label


def _runs(owner: np.ndarray, start: np.ndarray):
    """Runs of neighbouring starts of one owner: (owner, first, last)."""
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return owner[first], start[first], start[last]


def _key_and_guard(text: Column) -> tuple[Column, Column]:
    """What names a text in the exchanges: a 64-bit hash and eight bits of its length."""
    return F.xxhash64(text).alias("key"), F.pmod(F.octet_length(text), F.lit(256)).cast("int").alias("guard")


def _place(guard: int, position: np.ndarray, lead: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Guard (8 bits), position (31), lead and count (12 each) of an anchor in one number."""
    return (guard << 55) | (position << 24) | (lead << 12) | count


def _unplace(place: Column) -> dict[str, Column]:
    part = lambda shift, bits: F.shiftright(place, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return {n: part(*at).cast("int") for n, at in
            {"guard": (55, 8), "position": (24, 31), "lead": (12, 12), "count": (0, 12)}.items()}


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """One row per anchor of every text: gram, context, key, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            keys, guards = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, raw in enumerate(b.column(2)):
                found = anchors(raw.as_py(), window)
                if found is None:
                    continue
                grams, contexts, *where = found
                place = _place(guards[i], *where)
                out.append((grams.view(np.int64), contexts.view(np.int64), np.full(len(place), keys[i]), place))
                held += len(place)
                if held > 50_000:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in zip(*out)], ["gram", "context", "key", "place"]
        )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*_key_and_guard(text), text.cast("binary").alias("raw"))
    return rows.mapInArrow(run, "gram long, context long, key long, place long")


def _fetch(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of one text's span per distinct context. ``wanted`` has a list per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, spans in zip(b.column(0), b.column(1)):
                raw = raw.as_py()
                for s in spans.as_py():
                    first = s["position"] - s["lead"]
                    end = first + s["count"] + window - 1
                    out.append((s["gram"], s["context"], s["copies"], s["lead"], s["tiles"], raw[first:end]))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)],
            ["gram", "context", "copies", "lead", "tiles", "bytes"],
        )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(*_key_and_guard(text), text.cast("binary").alias("raw"))
    # one row per text, so that a gram's rows are its distinct contexts however many copies there
    # are; partial aggregation leaves one row of a copied text per partition before the exchange
    return (
        texts.dropDuplicates(["key", "guard"])
        .join(wanted, ["key", "guard"])
        .select("raw", "spans")
        .mapInArrow(run, "gram long, context long, copies long, lead int, tiles int, bytes binary")
    )


def _search(contexts: DataFrame, window: int, batch_size: int) -> DataFrame:
    """Runs of repeated window starts per context (first, last: relative to the anchor), and for
    tiled grams a row per distinct window and tile with its hash (first, last: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for t in key_groups(batches, ["gram", "tile"]):
            held.append(t)
            size += t.num_rows
            if size >= batch_size:
                yield from solve(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from solve(pa.concat_tables(held))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, context = t.column("gram").to_numpy(), t.column("context").to_numpy()
        lead, tiles = t.column("lead").to_numpy(), t.column("tiles").to_numpy()
        raw = t.column("bytes").to_pylist()
        owner, start, twice, label = repeated_starts(raw, lead.astype(np.int64), t.column("copies").to_numpy(), window)
        if twice.any():
            who, first, last = _runs(owner[twice], start[twice])
            yield rows(gram[who], context[who], first - lead[who], last - lead[who])
        tiled = tiles[owner] > 1
        for low in range(0, len(owner), 65_536):
            at = low + np.flatnonzero(tiled[low : low + 65_536])
            if not len(at):
                continue
            digests = [
                hashlib.blake2b(raw[o][s : s + window], digest_size=16).digest()
                for o, s in zip(owner[at].tolist(), start[at].tolist())
            ]
            yield rows(gram[owner[at]], context[owner[at]], start[at] - lead[owner[at]], None, digests, label[at])

    def rows(gram, context, first, last, digests=None, label=None) -> pa.RecordBatch:
        n = len(gram)
        cols = [
            pa.array(gram), pa.array(context), pa.array(first, pa.int32()),
            pa.nulls(n, pa.int32()) if last is None else pa.array(last, pa.int32()),
            pa.nulls(n, pa.binary()) if digests is None else pa.array(digests, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["gram", "context", "first", "last", "digest"])

    width = shuffle_width(contexts.sparkSession)
    return (
        contexts.withColumn("tile", F.pmod(F.xxhash64("context"), F.col("tiles")).cast("int"))
        .repartition(width, "gram", "tile")
        .sortWithinPartitions("gram", "tile")
        .mapInArrow(run, "gram long, context long, first int, last int, digest binary")
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, tile: int = TILE, batch_size: int = BATCH) -> DataFrame:
    """(key, guard, firsts, ends): for every text with repeats, byte spans that together are
    all bytes to remove. Spans may touch or overlap.

    ``window`` is any number of bytes from two blocks (16) to what a place holds (4095);
    others raise a ValueError."""
    if not 2 * BLOCK <= window < 1 << 12:
        raise ValueError(f"window must be {2 * BLOCK} to {(1 << 12) - 1} bytes, not {window}")
    found = stage_table(_scan(docs, window), "anchors")
    # written, so that the join has two plain exchanges and Spark can split a gram's rows
    grams = stage_table(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    shared = stage_table(found.join(grams, "gram"), "shared_anchors")
    contexts = stage_table(
        shared.groupBy("gram", "context").agg(
            F.count("*").alias("copies"), F.min(F.struct("key", "place")).alias("one")
        ).select("gram", "context", "copies", "one.*"),
        "contexts",
    )
    large = stage_table(
        contexts.groupBy("gram").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1"),
        "large_grams",
    )
    place = _unplace(F.col("place"))
    wanted = (
        contexts.join(large, "gram", "left")
        .select("key", "gram", "context", "copies", *[c.alias(n) for n, c in place.items()],
                F.coalesce("tiles", F.lit(1)).alias("tiles"))
        .groupBy("key", "guard")  # the distinct contexts of one text
        .agg(F.collect_list(F.struct("gram", "context", "copies", "position", "lead", "count", "tiles")).alias("spans"))
    )
    searched = stage_table(_search(_fetch(docs, wanted, window), window, batch_size), "searched")
    runs = searched.where("digest is null").select("gram", "context", "first", "last")
    windows = searched.where("digest is not null")
    twins = windows.join(
        windows.groupBy("digest").agg((F.min("context") != F.max("context")).alias("many")).where("many").select("digest"),
        "digest",
    ).select("gram", "context", "first", F.col("first").alias("last"))
    # written, so that no aggregate stands under the join and Spark can split a context of many texts
    runs = stage_table(
        runs.unionByName(twins)
        .groupBy("gram", "context")
        .agg(F.collect_set(F.struct("first", "last")).alias("runs")),
        "runs",
    )
    return (
        shared.distinct()
        .join(runs, ["gram", "context"])
        .select(
            "key", place["guard"].alias("guard"),
            F.transform("runs", lambda r: r["first"] + place["position"]).alias("firsts"),
            F.transform("runs", lambda r: r["last"] + place["position"] + window).alias("ends"),
        )
        .groupBy("key", "guard")
        .agg(F.collect_list(F.struct("firsts", "ends")).alias("spans"))
        .select(
            "key", "guard",
            F.flatten(F.transform("spans", lambda s: s["firsts"])).alias("firsts"),
            F.flatten(F.transform("spans", lambda s: s["ends"])).alias("ends"),
        )
    )


def cut(raw: bytes, firsts, ends) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    left, at, runs = [], 0, 0
    reached = -1
    for first, end in sorted(zip(firsts, ends)):
        if first > reached:
            left.append(raw[at:first])
            runs += 1
        at = reached = max(reached, end)
    left.append(raw[at:])
    return b"".join(left), runs


def passage_report(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", *_key_and_guard(text), text.cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        for b in batches:
            out = []
            for raw, firsts, ends in zip(*b.columns[1:]):
                raw = raw.as_py()
                left, n = cut(raw, firsts.as_py() or (), ends.as_py() or ())
                out.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            made = [pa.array([x[i] for x in out], type=k) for i, (_, k) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", *(n for n, _ in kinds)])

    made = T.StructType([texts.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long")
    return (
        texts.join(repeated_spans(docs, window, **how), ["key", "guard"], "left")
        .select("doc_id", "raw", "firsts", "ends")
        .mapInArrow(run, made.add("n_spans", "long").add("kept_sha256", "string"))
    )


def drop_passages(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """Documents with the repeated bytes cut out of ``text`` and ``n_chars`` set anew.

    A character that is only partly covered is dropped with the rest, so texts stay valid.
    Every document stays, if only with an empty text; one without repeats is unchanged.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = _key_and_guard(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    joined = row.select("row", *key).join(repeated_spans(docs, window, **how), ["key", "guard"], "left")

    @F.pandas_udf("string")
    def left_over(text: pd.Series, firsts: pd.Series, ends: pd.Series) -> pd.Series:
        out = [
            t if f is None else cut(t.encode(), f.tolist(), e.tolist())[0].decode(errors="ignore")
            for t, f, e in zip(text, firsts, ends)
        ]
        return pd.Series(out, dtype=object)

    cut_row = F.col("row").withField("text", left_over("row.text", "firsts", "ends"))
    if "n_chars" in docs.columns:
        length = F.length(F.col("row.text")).cast(docs.schema["n_chars"].dataType)
        changed = F.when(F.col("changed"), length).otherwise(F.col("row.n_chars"))
        out = joined.select(cut_row.alias("row"), F.col("firsts").isNotNull().alias("changed"))
        return out.select(F.col("row").withField("n_chars", changed).alias("row")).select("row.*")
    return joined.select(cut_row.alias("row")).select("row.*")
