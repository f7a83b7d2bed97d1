"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds (multiplies) the
vectors of its letters, the first rolled by two places, the second by one. A text is
the bundle (sum) of its trigram vectors, a language the bundle of its training texts.
A text's language is the prototype with the largest cosine to the text's bundle.

Trigrams are counted first, so a text costs one vector per distinct trigram. Words are
framed by a space, which has a vector like any letter. Letters are told by Unicode
category after lower-casing; each has a vector of its own, drawn from a generator seeded
by its code point when a worker first meets it (about 1 KB a letter, so at most 150 MB for
all letters of Unicode).

Training sums bundles inside tasks and then per language in Spark; the model is one
vector of ``DIM`` numbers per language, which is what travels to the driver and back:
its size depends on the number of languages only. No rows are sampled.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every
text if nothing can be learned; ties go to the first language by name; repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import stage_table, with_text

DIM, SEED = 1024, 20
UNKNOWN = "und"
_BLOCK = 4096
_BITS = 21  # of a code point
_POINT = (1 << _BITS) - 1


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)


class Profiler:
    """Bundles of texts. Built once per Python worker."""

    shared: "Profiler | None" = None

    def __init__(self):
        self.letter = _is_letter()
        self.slots = np.full(0x110000, -1, np.int32)
        self.known = 0
        # a row is a letter's vector with its last two signs repeated in front: the vector
        # rolled by two, by one and by none are three views of it
        self.rows = np.empty((64, DIM + 2), np.int8)
        self._meet(np.zeros(1, np.int64))  # the space

    def _meet(self, points: np.ndarray) -> None:
        """Draw the vectors of letters not met before."""
        for cp in np.unique(points[self.slots[points] < 0]).tolist():
            if self.known == len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            signs = np.random.default_rng((SEED, cp)).choice(np.array([-1, 1], np.int8), DIM)
            self.rows[self.known] = np.concatenate([signs[-2:], signs])
            self.slots[cp] = self.known
            self.known += 1

    @classmethod
    def get(cls) -> "Profiler":
        if cls.shared is None:
            cls.shared = cls()
        return cls.shared

    def trigrams(self, text: str | None):
        """Distinct trigram codes of a whole text and their weights; none if it has no letters.

        A weight is the root of the count, so lines repeated many times don't drown the rest."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        s = np.where(self.letter[points], points, 0).astype(np.int64)
        if not s.any():
            return None
        s = np.concatenate(([0], s, [0]))
        s = s[(s > 0) | np.append(s[1:] > 0, False)]  # one space between words, however much stood there
        s = np.append(s, 0)
        if len(s) < 3:
            return None
        codes, counts = np.unique(s[:-2] << 2 * _BITS | s[1:-1] << _BITS | s[2:], return_counts=True)
        return codes, np.sqrt(counts)

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        self._meet(codes >> _BITS & _POINT)  # each letter stands in the middle of a trigram
        total = np.zeros(DIM)
        for low in range(0, len(codes), _BLOCK):
            c = codes[low : low + _BLOCK]
            vectors = self.rows[self.slots[c >> 2 * _BITS], :DIM]
            vectors *= self.rows[self.slots[c >> _BITS & _POINT], 1 : DIM + 1]
            vectors *= self.rows[self.slots[c & _POINT], 2:]
            total += weights[low : low + _BLOCK].astype(np.float32) @ vectors.astype(np.float32)
        return total


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows of (text, lang) whose lang is not null."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler.get()
        sums: dict[str, dict[int, float]] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                found = profiler.trigrams(text.as_py())
                if found:
                    own = sums.setdefault(lang, {})
                    for code, n in zip(found[0].tolist(), found[1].tolist()):
                        own[code] = own.get(code, 0) + n
        for lang, own in sums.items():
            total = profiler.bundle(np.fromiter(own, np.int64), np.fromiter(own.values(), np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)],
                ["lang", "place", "total"],
            )

    parts = (
        labelled.where(F.col("lang").isNotNull())
        .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .mapInArrow(bundles, "lang string, place int, total double")
    )
    model: dict[str, np.ndarray] = {}
    for lang, place, total in parts.groupBy("lang", "place").agg(F.sum("total")).collect():
        model.setdefault(lang, np.zeros(DIM))[place] = total
    return {k: v / np.linalg.norm(v) for k, v in sorted(model.items()) if v.any()}


def predict(docs: DataFrame, model: dict[str, np.ndarray], *keep: Column) -> DataFrame:
    """``keep`` columns, lang_pred, score (cosine, at least 0) and n_trigrams of every whole text."""
    langs, matrix = list(model), np.array(list(model.values())).reshape(-1, DIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler.get()
        for b in batches:
            best, scores, sizes = [], [], []
            for text in b.column(b.num_columns - 1):
                found = profiler.trigrams(text.as_py())
                lang, score = UNKNOWN, 0.0
                if found and langs:
                    v = profiler.bundle(*found)
                    cosines = matrix @ v / max(np.linalg.norm(v), 1e-300)
                    at = int(cosines.argmax())
                    lang, score = langs[at], float(min(1.0, max(0.0, cosines[at])))
                best.append(lang)
                scores.append(score)
                sizes.append(len(found[0]) if found else 0)
            cols = [*b.columns[:-1], pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "lang_pred", "score", "n_trigrams"])

    rows = with_text(docs, *keep)
    found = T.StructType().add("lang_pred", "string").add("score", "double").add("n_trigrams", "long")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *found.fields]))


def _size_class(n: Column) -> Column:
    """Whole power of two of a number of trigrams; texts of one class have like scores."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def least_scores(told: DataFrame, quantile: float, share: float) -> list[float]:
    """The least score of every size class, from the scores of labelled texts.

    A text of m trigrams scores the higher the larger m is, so each language's labelled texts give
    one low quantile for each size class; ``share`` of the lowest of them is the class's least
    score, as the language told for an odd text may be any. A class without labelled texts has
    the score of the next smaller one that has some, and the classes under the smallest have its
    score. One number per language and class is collected.
    """
    known = told.where(F.col("lang").isNotNull() & (F.col("lang_pred") != UNKNOWN))
    lows = known.groupBy("lang", _size_class(F.col("n_trigrams")).alias("size")).agg(
        F.percentile_approx("score", quantile, 10_000).alias("low")
    )
    by_size: dict[int, float] = {}
    for r in lows.collect():
        by_size[r["size"]] = min(r["low"], by_size.get(r["size"], 1.0))
    out, low = [], by_size[min(by_size)] if by_size else 0.0
    for size in range(64):
        low = by_size.get(size, low)
        out.append(share * low)
    return out


def drop_foreign(docs: DataFrame, quantile: float = 0.01, share: float = 0.5) -> DataFrame:
    """Documents in a language that can be told, with all their columns; learns from their own lang.

    Rejects ``und`` (no letters, or no language to learn) and every text whose cosine to the nearest
    language is under ``share`` of the low ``quantile`` of the labelled texts of like size (see
    ``least_scores``): it shares too few letter patterns with any language. The rule is the
    same for texts of any size; of very short ones even clean texts score little, so few of them
    can be told from chance.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns]
    named = F.struct(*kept).alias("row"), F.col("lang").cast("string").alias("lang")
    told = stage_table(predict(docs, learn(docs), *named), "told")
    least = F.array(*map(F.lit, least_scores(told, quantile, share)))
    near = F.col("score") >= F.get(least, _size_class(F.col("n_trigrams")))
    return told.where((F.col("lang_pred") != UNKNOWN) & near).select("row.*")
