"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0 is the most frequent), so frequent ids
take one byte. Each number takes one to four data bytes; its length minus one is a
two-bit field, and the fields of four numbers share one control byte. Control and data
bytes are kept apart, so a numpy table turns control bytes into lengths at once, and
the data bytes are gathered by offset without looking at any of them.

A token file is a Parquet folder (its commit protocol survives lost executors):
``blocks`` has rows of consecutive documents (bucket, block, first, doc_ids, n_tokens,
control, data), where ``first`` counts the bucket's ids before the block; ``ranks`` has
the id of every rank. Documents stand in ascending doc_id order: buckets are ranges of
doc_id from quantiles, each sorted in its own task. Streams of a document start at a
byte in both parts.

Defined cases: null and empty texts have only the end id; a null doc_id comes first;
rows with equal doc_id are ordered by a hash of their text; an empty table gives empty
files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import bucket_of, ordered_bounds, scratch_path, shuffle_width

BLOCK_IDS = 1 << 18

#: Letters that Python lower-cases as the library does and that stay one letter in its normal form
#: (others, as some of Indic scripts, come apart into a letter and a sign).
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LATIN = re.compile(f"[{_LETTERS}]+")

#: Signs (but the apostrophe) between such a letter or a digit and white space are a word of their own to the tokenizer.
_SIGN = r"[!-&(-/:-@\[-`{-~]"
SIGNS = re.compile(rf"({_SIGN}(?<=[0-9{_LETTERS}].){_SIGN}*)(?=[ \n]|$)")

#: The sign by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

#: Parts of more code points (long unbroken signs, encoded data) are not kept.
LONG_PART = 64

#: What Python takes for a kept part besides its code points and ids (two objects and a place in the dictionary).
ENTRY_BYTES = 190

#: The steps before the merges in vocabulary files for which ``WordTokenizer`` may split texts itself.
SPLIT_BY_WORD = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}

#: Lengths of the four numbers of every control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


class WordTokenizer:
    """Ids of whole texts by a tokenizers file that lower-cases, splits runs of letters from
    other signs and drops white space.

    No token spans a space or line break, so a text's ids are those of its parts between them.
    Parts repeat, so their ids are kept. A part of letters only is one word to the library:
    ASCII and Latin ones go straight to its merges. The file's added tokens are cut out of a text first, as the library does. A file whose
    steps before the merges are others than these is left to the library's plain call.

    ``limit`` bounds the bytes of one generation of kept parts; longer parts than ``LONG_PART``
    code points are encoded each time.
    """

    loaded: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str, limit: int = 60_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.known = PartIds(self._part_ids, limit)
        made_of = json.loads(self.tokenizer.to_str())
        added = made_of["added_tokens"]
        self.by_parts = all(made_of[k] == v for k, v in SPLIT_BY_WORD.items()) and all(
            t["special"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added
        )
        # Parts have no added tokens left, so what looks like one after lower-casing is ordinary text.
        self.tokenizer.encode_special_tokens = self.by_parts
        self.added = {(t["content"],): np.array([t["id"]], "<u4").tobytes() for t in added}
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first)) or r"(?!)")

    @classmethod
    def get(cls, path: str) -> "WordTokenizer":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part_ids(self, part) -> bytes:
        if type(part) is tuple:
            return self.added[part]
        # the library's merges alone, where its steps before them are known
        if part.isalpha():
            if part.isascii():
                return array("I", [t.id for t in self.merges(part)]).tobytes()
            if LATIN.fullmatch(part):
                signs = part.lower().encode().decode("latin-1").translate(BYTE_SIGNS)
                return array("I", [t.id for t in self.merges(signs)]).tobytes()
        return self._ids(part)

    @staticmethod
    def _parts(text: str | None) -> list[str]:
        # Only A-Z: the library lower-cases all else by its own rules.
        lowered = (text or "").encode().lower().decode()
        return SIGNS.sub(r" \1 ", lowered).replace("\n", " ").split(" ")

    def _pieces(self, text: str | None) -> list:
        """A text's parts in order; its added tokens stand among them as tuples."""
        if not text or not self.cut.search(text):
            return self._parts(text)
        pieces, at = [], 0
        for token in self.cut.finditer(text):
            pieces += [*self._parts(text[at : token.start()]), (token[0],)]
            at = token.end()
        return pieces + self._parts(text[at:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_parts:
            return [self._ids(t or "") for t in texts]
        return [b"".join(map(self.known.__getitem__, self._pieces(t))) for t in texts]


class PartIds(dict):
    """Ids of parts in two generations of at most ``limit`` bytes each; a dropped one is made again."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.older = make, limit, 0, {}

    def __missing__(self, part) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.make(part)
            if len(part) > LONG_PART:
                return ids
        if self.held > self.limit:
            self.older = None  # let the oldest go before the next is copied
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += ENTRY_BYTES + len(part) + len(ids)
        self[part] = ids
        return ids


def _ends(sizes: np.ndarray) -> np.ndarray:
    """Where each row starts in the joined rows, and the end of the last."""
    return np.append(0, np.cumsum(sizes))


def _control_places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every number's field, as each row starts with a new control byte, and where the rows' bytes start."""
    starts = _ends(-(-counts // 4))
    ahead = starts[:-1] * 4 - _ends(counts)[:-1]
    return np.arange(counts.sum()) + np.repeat(ahead, counts), starts


def pack(numbers: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes per row of unsigned 32-bit numbers; row i has the next ``counts[i]`` of them."""
    size = (1 + (numbers > 0xFF) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)).astype(np.uint8)
    places, starts = _control_places(counts)
    fields = np.zeros(int(starts[-1]) * 4, np.uint8)
    fields[places] = size - 1
    control = (fields.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return _rows(control, starts), _rows(raw[np.arange(4) < size[:, None]], _ends(size)[_ends(counts)])


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all rows of a control and a data byte array."""
    size = LENGTHS[control].ravel()[_control_places(counts)[0]]
    at = np.cumsum(size) - size
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
    out = padded[at]
    for k in (1, 2, 3):
        longer = size > k
        out[longer] |= padded[at[longer] + k] << np.uint32(8 * k)
    return out


def _rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary rows that stand one after the other in ``data``; ``ends`` as of ``_ends``."""
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a binary column, and how many each row has."""
    if not len(column):
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u4")
    return ids, np.diff(ends).astype(np.int64) // 4


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``BLOCK_IDS`` ids each, at least one row."""
    ends, low = _ends(counts), 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK_IDS, side="right")) - 1)
        yield low, high
        low = high


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, tie, ids (little-endian unsigned 32-bit, the end id last) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.get(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                ids = [i + end for i in words.encode(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.binary())], ["doc_id", "tie", "ids"]
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:2]).add("ids", "binary"))


def rank_ids(tokens: DataFrame) -> np.ndarray:
    """Ids by falling corpus frequency, then id; one entry per id in use (at most the vocabulary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            here = np.bincount(_joined(b.column(0))[0], minlength=len(total))
            here[: len(total)] += total
            total = here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Tokenize ``docs`` and write the token files under ``path``."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    staged = scratch_path(spark, "tokens")
    tokens = tokenize(docs, tokenizer, end_id)
    tokens.write.option("compression", "zstd").parquet(staged)
    tokens = spark.read.schema(tokens.schema).parquet(staged)
    ranked = rank_ids(tokens)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 0, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in _slices(_joined(whole.column(3))[1]):  # a few documents at a time bound the memory
                b = whole.slice(low, high - low)
                ids, counts = _joined(b.column(3))
                cols = [pa.array(counts), *pack(rank_of[ids], counts)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], [*b.schema.names[:3], "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, rows = 0, 0, 0, []

        def block():
            b = pa.Table.from_batches(rows)
            cols = [
                pa.array([b.column("bucket")[0].as_py()], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([b.column("doc_id").to_pylist()], pa.list_(b.schema.field("doc_id").type)),
                pa.array([b.column("n").to_pylist()], pa.list_(pa.int64())),
                pa.array([b"".join(b.column("control").to_pylist())], pa.binary()),
                pa.array([b"".join(b.column("data").to_pylist())], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(
                cols, ["bucket", "block", "first", "doc_ids", "n_tokens", "control", "data"]
            )

        for batch in batches:
            ends = np.cumsum(batch.column(2).to_numpy())
            low = 0
            while low < batch.num_rows:
                done = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + BLOCK_IDS - held, side="right")))
                rows.append(batch.slice(low, high - low))
                held += int(ends[high - 1]) - done
                if held >= BLOCK_IDS or high < batch.num_rows:
                    yield block()
                    first, number, held, rows = first + held, number + 1, 0, []
                low = high
        if rows:
            yield block()

    doc_id = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    bounds = ordered_bounds(docs, "doc_id", width)
    head = tokens.select(bucket_of(bounds, F.col("doc_id")).alias("bucket"), "doc_id", "tie", "ids")
    coded = T.StructType(head.schema.fields[:3]).add("n", "long").add("control", "binary").add("data", "binary")
    packed = (
        T.StructType().add("bucket", "integer").add("block", "integer").add("first", "long")
        .add("doc_ids", T.ArrayType(doc_id.dataType)).add("n_tokens", T.ArrayType(T.LongType()))
        .add("control", "binary").add("data", "binary")
    )
    (
        head.mapInArrow(code, coded)
        .repartitionById(width, F.col("bucket"))
        .sortWithinPartitions("doc_id", "tie")
        .select("bucket", "doc_id", "n", "control", "data")
        .mapInArrow(blocks, packed)
        .write.option("compression", "zstd").parquet(f"{path}/blocks")
    )
    spark.createDataFrame(
        [(i, int(t)) for i, t in enumerate(ranked)], "rank int, id long"
    ).coalesce(1).write.parquet(f"{path}/ranks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, end id last)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    rows = spark.read.parquet(f"{path}/ranks").collect()  # one row per id in use: bounded by the vocabulary
    id_of = np.zeros(len(rows), np.uint32)
    for rank, token in rows:
        id_of[rank] = token
    per_bucket = blocks.groupBy("bucket").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n)).alias("ids")
    )  # one row per bucket
    before = per_bucket.select(
        "bucket",
        F.coalesce(
            F.sum("ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    placed = blocks.join(before, "bucket").select(
        (F.col("before") + F.col("first")).alias("start"), "doc_ids", "n_tokens", "control", "data"
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, docs, counts, control, data in zip(*b.columns):
                counts = np.array(counts.as_py(), np.int64)
                control = np.frombuffer(control.as_py(), np.uint8)
                data = np.frombuffer(data.as_py(), np.uint8)
                ids = id_of[unpack(control, data, counts)].astype("<u4")
                starts = start.as_py() + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(starts), pa.array(counts), _rows(ids.view(np.uint8), _ends(counts) * 4)],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    doc_id = blocks.schema["doc_ids"].dataType.elementType
    out = T.StructType().add("doc_id", doc_id).add("start", "long").add("n_tokens", "long").add("ids", "binary")
    return placed.mapInArrow(decode, out)


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

