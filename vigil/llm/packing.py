"""Packing token ids into training windows: the sum-of-squares rule.

A document's ids are cut at whole windows first; what is left (less than a window) goes
to one of the partly filled windows. The packer counts the partly filled windows of each
fill level in an array. An item of s ids may go to any level h with a window in it and
room for s, or start a window of its own; it goes where the sum of the squared counts is
smallest afterwards (ties: the fullest window). A window that becomes full leaves the
array. The rule needs one pass and no knowledge of sizes to come, so each Spark partition
packs its own documents while it tokenizes them: no shuffle, and the array and the ids of
the open windows are all that a task holds.

Windows that stay open cost padding. When ``open_limit`` of them are open, and at the
end, they are settled: the fullest take ids from the emptiest until they are full, with
at most one cut per filled window. Of a partition's last window, which no others can
fill, each power of two in its fill becomes a window of that length, which needs no
padding. So no window needs any, whatever the sizes.

Windows are numbered within partitions (``sequence_id`` = partition * 2^33 + number):
the same table read in the same splits gives the same windows, and a lost task gives its
windows again.

Defined cases: null and empty texts have only the end id; documents with null or equal
doc_id are packed as rows of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.token_files import WordTokenizer


class Packer:
    """Windows of ``capacity`` ids filled by the sum-of-squares rule.

    A piece is (document, its ids before the piece, number of ids, ids as bytes, ids of the
    document); ``full`` has the finished windows as lists of pieces.
    """

    def __init__(self, capacity: int, open_limit: int = 2048):
        if capacity < 1 or open_limit < 2:
            raise ValueError("a window needs room for one id, and two windows must be open to be settled")
        self.capacity, self.open_limit = capacity, open_limit
        self.count = np.zeros(capacity + 1, np.int64)  # open windows by fill level; 0 and capacity stay 0
        self.windows: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.full: list[list[tuple]] = []

    def level(self, size: int) -> int:
        """Fill level that an item of ``size`` ids joins; 0 is a new window."""
        room = self.capacity - size
        have = self.count[: room + 1]
        # moving one window from level h to h + size changes the sum of squares by this much
        change = 2 * (self.count[size:] - have) + 2
        change[room] -= 1  # a full window no longer counts
        change[0] -= 1  # a new window leaves no level
        change[1:][have[1:] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def _open(self, fill: int, window: list[tuple]) -> None:
        if fill == self.capacity:
            self.full.append(window)
            return
        self.windows.setdefault(fill, []).append(window)
        self.count[fill] += 1
        self.n_open += 1

    def add(self, doc, ids: bytes) -> None:
        """Pack all ids (little-endian unsigned 32-bit) of one document."""
        total = len(ids) // 4
        whole = total - total % self.capacity
        for at in range(0, whole, self.capacity):
            self.full.append([(doc, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], total)])
        size = total - whole
        if not size:
            return
        piece = (doc, whole, size, ids[4 * whole :], total)
        at = self.level(size)
        window = []
        if at:
            window = self.windows[at].pop()
            self.count[at] -= 1
            self.n_open -= 1
        window.append(piece)
        self._open(at + size, window)
        if self.n_open >= self.open_limit:
            self.settle()

    def settle(self) -> None:
        """Fill the fullest open windows with the ids of the emptiest; at most one stays open."""
        by_fill = [(fill, w) for fill in sorted(self.windows, reverse=True) for w in self.windows[fill]]
        self.windows, self.n_open = {}, 0
        self.count[:] = 0
        first, last = 0, len(by_fill) - 1
        left = list(by_fill[last][1]) if by_fill else []
        while first < last:
            fill, window = by_fill[first]
            while fill < self.capacity and first < last:
                if not left:
                    last -= 1
                    left = list(by_fill[last][1]) if first < last else []
                    continue
                piece, rest = cut(left.pop(), self.capacity - fill)
                window.append(piece)
                fill += piece[2]
                if rest:
                    left.append(rest)
            if fill == self.capacity:
                self.full.append(window)
            else:
                left = window
            first += 1
        if left:
            self._open(sum(p[2] for p in left), left)

    def finish(self) -> None:
        """Settle, and divide the last open window into windows of powers of two."""
        self.settle()
        for fill, (pieces,) in self.windows.items():
            for power in reversed(range(fill.bit_length())):
                need = fill & 1 << power
                window = []
                while need:
                    piece, rest = cut(pieces.pop(0), need)
                    window.append(piece)
                    need -= piece[2]
                    if rest:
                        pieces.insert(0, rest)
                if window:
                    self.full.append(window)
        self.windows, self.n_open = {}, 0
        self.count[:] = 0


def cut(piece: tuple, size: int) -> tuple[tuple, tuple | None]:
    """The first ``size`` ids of a piece, and the rest of it if there is one."""
    doc, start, length, ids, total = piece
    if length <= size:
        return piece, None
    return (doc, start, size, ids[: 4 * size], total), (doc, start + size, length - size, ids[4 * size :], total)


def pack_documents(
    docs: DataFrame, path: str, end_id: int, capacity: int = 4096, open_limit: int = 2048
) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset of every piece; ``path`` is a tokenizers file, ``end_id`` ends every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_id = rows.schema["doc_id"].dataType
    out = (
        T.StructType().add("doc_id", doc_id).add("start", "long").add("length", "long").add("ids", "binary")
        .add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordTokenizer.get(path), Packer(capacity, open_limit)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for low in range(0, b.num_rows, 64):  # a few texts at a time bound the memory
                part = b.slice(low, 64)
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                    packer.add(doc, ids + end)
                done, packer.full = packer.full, []
                yield table(done, number)
                number += len(done)
        packer.finish()
        yield table(packer.full, number)

    def table(windows: list[list[tuple]], first: int) -> pa.RecordBatch:
        rows = []
        for number, window in enumerate(windows, first):
            offset = 0
            for doc, start, length, ids, total in window:
                rows.append((doc, start, length, ids, total, number, offset))
                offset += length
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = out.names
    kinds = [to_arrow(f.dataType) for f in out.fields]
    return rows.mapInArrow(run, out)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
