"""Substring dedup: content-defined chunking with a gear rolling hash, chunks deduplicated by digest.

The gear hash at a byte depends on the last 32 bytes. A chunk begins where that hash is the smallest
of its surroundings (strictly less than the REACH before, no more than the REACH behind). So cuts
depend on nothing but the bytes around them: an insertion shifts no cut further away, chunks are
longer than REACH bytes, and two texts that share a passage share all chunks but those at its ends.
Chunks without a cut for CHUNK_MOST bytes (periodic text) are divided evenly from their start.

The texts are read once: their chunks, with digests of 128 bits, are written to the shared folder.
Digests are counted with map-side sums, so one passage in a third of all texts costs a row for each
task; the join that marks the chunks is a sort-merge join whose large keys Spark splits. Runs of
marked chunks of a text are its repeated spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .native_util import free_names
from .spark_util import Stage
from .text_util import blocks, hash_spans, mix, words

REACH, WINDOW, CHUNK_MOST = 24, 32, 512
#: Words that a run of marked chunks must have to count as a repeated passage.
MIN_WORDS = 12
_GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(20_261_101)) >> np.uint64(32)).astype(np.uint32)


def _least(h: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of h[i : i + reach] for each i (less at the end)."""
    wide = np.concatenate([h, np.full(reach, 0xFFFFFFFF, np.uint32)])
    size = 1
    while size * 2 <= reach:
        wide[:-size] = np.minimum(wide[:-size], wide[size:])
        size *= 2
    return np.minimum(wide[: len(h)], wide[reach - size : reach - size + len(h)])


def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The first byte of each chunk; each text that is not empty begins one."""
    h = _GEAR[buf]
    size = 1
    while size < WINDOW:
        h[size:] += h[:-size] << np.uint32(size)
        size *= 2
    begin = offs[:-1][np.diff(offs) > 0]
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        h[a : min(a + WINDOW - 1, b)] = 0xFFFFFFFF  # hashes that reach into another text
    low = np.append(_least(h, REACH), np.uint32(0xFFFFFFFF))
    ok = np.zeros(len(h), bool)
    if len(h) > REACH:
        ok[REACH:] = (h[REACH:] < low[: len(h) - REACH]) & (h[REACH:] <= low[REACH + 1 :]) & (h[REACH:] != 0xFFFFFFFF)
    at = np.flatnonzero(ok)
    for _ in range(3):  # to the start of a character
        inside = (at < len(buf)) & ((buf[np.minimum(at, len(buf) - 1)] & 0xC0) == 0x80)
        at = at + inside
    at = np.unique(np.concatenate([at[at < len(buf)], begin]))
    gap = np.diff(np.append(at, len(buf)))
    if (gap > CHUNK_MOST).any():
        n = -(-gap // CHUNK_MOST)
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(at, n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * CHUNK_MOST
        for _ in range(3):
            at = at + ((buf[np.minimum(at, len(buf) - 1)] & 0xC0) == 0x80)
        at = np.unique(np.concatenate([at[at < len(buf)], begin]))
    return at


def chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, doc_id, d1, d2, nth, start, stop, n_words) of each chunk; d1 and d2 are the halves of its digest.

    rid numbers the rows: task, then row of the task; start and stop are code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for block in blocks(batches, "text"):
            buf, offs = block.buf, block.offs
            ids, n_rows, row = block.batch.column(0), block.size, row + block.size
            if not len(buf):
                continue
            lo = cuts(buf, offs)
            hi = np.append(lo[1:], len(buf))
            owner = np.searchsorted(offs, lo, "right") - 1
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            starts, _, _ = words(buf, offs)
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            nth = np.arange(len(lo)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            out = [
                pa.array(row - n_rows + owner),
                ids.take(pa.array(owner)),
                pa.array(hash_spans(buf, lo, hi).view(np.int64)),
                pa.array(hash_spans(buf, lo, hi, 1).view(np.int64)),
                pa.array(nth.astype(np.int32)),
                pa.array((chars[lo] - chars[offs[owner]]).astype(np.int32)),
                pa.array((chars[hi] - chars[offs[owner]]).astype(np.int32)),
                pa.array((np.searchsorted(starts, hi) - np.searchsorted(starts, lo)).astype(np.int32)),
            ]
            for k in range(0, len(lo), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(k, 50_000) for x in out], names)

    names = ["rid", "doc_id", "d1", "d2", "nth", "start", "stop", "n_words"]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "rid long, doc_id long, d1 long, d2 long, nth int, start int, stop int, n_words int"
    )


def _spans(cut: DataFrame, min_words: int) -> DataFrame:
    """The repeated spans of chunks(), with their rid."""
    counts = cut.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min("rid").alias("r0"), F.min("doc_id").alias("d0"))
    counts = counts.where("c > 1").drop("c")
    run = F.col("nth") - F.row_number().over(Window.partitionBy("rid").orderBy("nth"))
    return (
        cut.join(counts, ["d1", "d2"])
        .withColumn("run", run)
        .groupBy("rid", "run")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.sum("n_words").alias("n_words"),
            F.count("*").alias("n_chunks"),
            F.min("d0").alias("first_doc_id"),
            F.bool_or(F.col("rid") != F.col("r0")).alias("is_copy"),
        )
        .where(F.col("n_words") >= min_words)
    )


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per repeated span: doc_id, start, stop, n_words, n_chunks, first_doc_id, is_copy.

    A span is a longest run of chunks of a text each of which stands elsewhere, too (in another row or
    in the same), with at least min_words words. start and stop are code points, the end exclusive; the
    passage shared may reach a little further at both ends. first_doc_id: the smallest doc_id that holds
    one of its chunks; is_copy: not all of its chunks are the first of their kind, in the order of the
    rows read. Repeated rows repeat each other. Texts that share nothing give no row; nor do null, empty
    and short texts. Null doc_ids are rows like others. An empty table gives none.
    """
    cut = Stage(docs.sparkSession, "substring").save(chunks(docs, text, doc_id), "chunks")
    return _spans(cut, min_words).drop("rid", "run")


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the spans that are copies cut out of their texts; all rows and columns stay. doc_id must be unique."""
    key, cut, whole = free_names(docs.columns, ("key", "cut", "whole"))
    spans = repeated_spans(docs, min_words, text, doc_id).where("is_copy").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cut))
    spans = spans.withColumnRenamed("doc_id", key)
    kept = F.expr(
        f"transform(sequence(0, size(`{cut}`)), i -> struct(if(i = 0, 0, `{cut}`[i - 1].stop) as a,"
        f" if(i = size(`{cut}`), char_length(`{whole}`), `{cut}`[i].start) as b))"
    )
    held = docs.withColumn(whole, F.col(text).cast("string")).join(spans, F.col(doc_id).cast("long") == F.col(key), "left")
    pieces = F.transform(kept, lambda p: F.substring(F.col(whole), p["a"] + 1, p["b"] - p["a"]))
    return held.select(*[F.when(F.col(cut).isNull(), F.col(c)).otherwise(F.array_join(pieces, "")).alias(c) if c == text else F.col(c) for c in docs.columns])
