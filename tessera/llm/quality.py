"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each text becomes a short vector of document statistics, by one vectorised pass. Rows with a label
and outside the held-out third fit the model: their statistics are standardised, mapped to random
Fourier features (which approximate a Gaussian kernel), and each partition sums its own Z'Z and Z'y.
The sums are added up in a tree of fixed fan-in, so neither the driver nor a task ever holds more
than a few matrices of D x D. One third of the rows fits the ridge weights, another calibrates its
scores by pool-adjacent-violators over a fixed grid of bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import Stage
from .text_util import blocks, hash_spans, windows, words

FEATURES, SEED, RIDGE, BINS, FAN_IN = 192, 20_266, 1e-3, 512, 32
CLIP = 6.0

NAMES = (
    "log_words", "word_bytes", "log_bytes_a_line", "symbols", "bangs", "bars", "upper", "digits", "stops", "commas",
    "not_ascii", "other", "distinct", "same_as_last", "repeated_trigrams", "commonest",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)


def _class_matrix() -> np.ndarray:
    """Byte value x character class."""
    out = np.zeros((256, 10), np.int64)
    out[_SYMBOLS, 0] = 1
    out[ord("!"), 1] = out[ord("|"), 2] = 1
    out[65:91, 3] = 1
    out[48:58, 4] = 1
    out[[ord("."), ord("?")], 5] = 1
    out[ord(","), 6] = 1
    out[128:, 7] = 1
    out[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&<>!|.?,"], 8] = 1
    out[[*range(65, 91), *range(97, 123)], 9] = 1
    return out


_CLASSES = _class_matrix()


def histograms(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes of each value in each text."""
    return np.stack([np.bincount(buf[a:b], minlength=256) for a, b in zip(offs[:-1], offs[1:], strict=True)])


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text; a text without words has zeros."""
    hist = histograms(buf, offs)
    cls = (hist @ _CLASSES).astype(np.float64)
    starts, ends, first = words(buf, offs)
    n = np.diff(first).astype(np.float64)
    per_word = np.maximum(n, 1)[:, None]
    h = hash_spans(buf, starts, ends)
    total = np.diff(offs).astype(np.float64)
    length = np.add.reduceat(np.append(ends - starts, 0), np.minimum(first[:-1], len(starts))) * (n > 0)
    letters = np.maximum(cls[:, 9] + cls[:, 7] / 2, 1)
    same = np.zeros(len(h) + 1)
    same[1:-1] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = 0  # the first word of a text follows none
    same = np.add.reduceat(same, np.minimum(first[:-1], len(h))) * (n > 0)
    tri, at = windows(h, first, 3)
    distinct, common, repeated = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for k in np.flatnonzero(n):
        _, count = np.unique(h[first[k] : first[k + 1]], return_counts=True)
        distinct[k], common[k] = len(count) / n[k], count.max() / n[k]
        if n[k] > 3:
            repeated[k] = 1 - len(np.unique(tri[at[k] : at[k + 1]])) / (at[k + 1] - at[k])
    out = np.column_stack(
        [
            np.log1p(n), length / per_word[:, 0], np.log1p(total / (hist[:, 10] + 1)),
            cls[:, 0] / per_word[:, 0], cls[:, 1] / per_word[:, 0], cls[:, 2] / per_word[:, 0],
            cls[:, 3] / letters, cls[:, 4] / np.maximum(total, 1), cls[:, 5] / per_word[:, 0], cls[:, 6] / per_word[:, 0],
            cls[:, 7] / np.maximum(total, 1), cls[:, 8] / per_word[:, 0], distinct, same / per_word[:, 0], repeated, common,
        ]
    )
    out[n == 0] = 0
    return out


@dataclass
class Model:
    """All that a score needs; its size depends on the parameters alone."""

    mean: np.ndarray
    scale: np.ndarray
    bins_at: np.ndarray
    bins_score: np.ndarray
    weights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.bins_at, self.bins_score)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones(len(x))])


def with_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, x) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x = statistics(block.buf, block.offs)
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def _normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, stage: Stage) -> np.ndarray:
    """[Z'Z Z'y] over rows (x, y): summed in each partition, then in a tree."""
    side = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((side, side + 1)), False
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = np.array(part.column(0).to_pylist(), np.float64).reshape(-1, len(NAMES))
                z, any_row = fourier(x, mean, scale), True
                total += z.T @ np.column_stack([z, part.column(1).to_numpy()])
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(side * (side + 1)), False
        for batch in batches:
            for m in batch.column(0):
                total, any_row = total + np.frombuffer(m.as_py(), np.float64), True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    part = stage.save(rows.select("x", "y").mapInArrow(sums, "m binary"), "sums")
    while (n := part.count()) > FAN_IN:
        part = stage.save(part.repartition(-(-n // FAN_IN)).mapInArrow(add, "m binary"), "sums")
    return sum((np.frombuffer(r["m"], np.float64) for r in part.collect()), np.zeros(side * (side + 1))).reshape(side, side + 1)


def _isotonic(value: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by value: block centres and their rates."""
    pools: list[list[float]] = []
    for v, g, c in zip(value, good, count, strict=True):
        pools.append([v * c, g, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def fit(stats: DataFrame, labels: DataFrame, stage: Stage, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """A model from (doc_id, x) and labels; rows of the held-out fold and null labels are never seen.

    Without usable labels every score is 0.5; with one class only, that class. Repeated labels count
    as often as they are there.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    rows = stage.save(known.join(stats, "doc_id").select(fold().alias("fold"), "x", "y").where("fold != 1"), "rows")
    at = [F.col("x")[k] for k in range(len(NAMES))]
    got = rows.agg(F.count("*"), F.avg("y"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if not got[0]:
        zero, one = np.zeros(len(NAMES)), np.ones(len(NAMES))
        return Model(zero, one, np.array([0.0, 1.0]), np.array([0.5, 0.5]), np.zeros(FEATURES + 1))
    mean, scale = np.array(got[2 : 2 + len(NAMES)], float), np.array(got[2 + len(NAMES) :], float)
    scale[scale < 1e-9] = 1
    m = _normal_equations(rows.where("fold = 0"), mean, scale, stage)
    seen = max(m[-1, -2], 1)
    weights = np.linalg.solve(m[:, :-1] + RIDGE * seen * np.eye(FEATURES + 1) / FEATURES, m[:, -1])
    model = Model(mean, scale, np.zeros(0), np.zeros(0), weights)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x), pa.float64()), batch.column(1)], ["s", "y"])

    grid = F.least(F.greatest(F.floor((F.col("s") + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = rows.where("fold = 2").select("x", "y").mapInArrow(raw, "s double, y double").groupBy(grid.alias("bin"))
    bins = sorted(bins.agg(F.avg("s").alias("s"), F.sum("y").alias("g"), F.count("*").alias("c")).collect())
    if bins:
        _, s, g, c = (np.array(v, float) for v in zip(*bins, strict=True))
        model.bins_at, model.bins_score = _isotonic(s, g, c)
    else:
        model.bins_at, model.bins_score = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts are scored by statistics of zeros. Null doc_ids are scored, too (fold of an
    empty text). Extra columns, lang and source among them, are never read. An empty table gives none.
    """
    stage = Stage(docs.sparkSession, "quality")
    stats = stage.save(with_statistics(docs, text, doc_id), "stats")
    model = fit(stats, labels, stage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    out = stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the classifier accepts (score >= 0.5), with all their columns."""
    model = fit(with_statistics(docs, text, doc_id), labels, Stage(docs.sparkSession, "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield block.batch.filter(pa.array(model.score(statistics(block.buf, block.offs)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def crc_fold(doc_id: object) -> int:
    """fold() of one id, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3
