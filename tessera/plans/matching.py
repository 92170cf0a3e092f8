"""Queries of the fingerprint operators: word shingles of documents against those of benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.clock import MICROS
from tessera.functions.shared import fresh_dir
from tessera.operators import fingerprints, ordered

from .catalog import register, table
from .rows import events

WIDTH = 5


def grams(spark: SparkSession, sf_dir: str, name: str, id_: str) -> DataFrame:
    return fingerprints.shingles(table(spark, sf_dir, name), id_, "text", WIDTH)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and the planner knows its size when it joins it."""
    path = fresh_dir(df.sparkSession, "grams")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grams(name: str, id_: str) -> str:
    return f"""SELECT {id_}, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(0, len(w) - 4), lambda i: md5(array_to_string(w[i + 1:i + 5], ' ')))) AS hash
    FROM (SELECT {id_}, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name}) WHERE len(w) >= 5"""


_BOTH = f"WITH d AS ({_grams('documents', 'doc_id')}), b AS ({_grams('benchmark', 'item_id')})"


@register(
    "offset_histogram",
    f"{_BOTH} SELECT item_id, doc_id, d.pos - b.pos AS delta, count(*) AS n FROM b JOIN d USING (hash) GROUP BY ALL",
)
def offset_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.offset_pairs(staged(grams(spark, sf_dir, "benchmark", "item_id")), grams(spark, sf_dir, "documents", "doc_id"))
    pairs = pairs.select(F.col("i_item_id").alias("item_id"), F.col("q_doc_id").alias("doc_id"), "delta")
    return fingerprints.offset_histogram(pairs, ["item_id", "doc_id"])


@register(
    "offset_peaks",
    f"""{_BOTH}, h AS (SELECT item_id, doc_id, d.pos - b.pos AS delta, count(*) AS n FROM b JOIN d USING (hash) GROUP BY ALL),
    m AS (SELECT *, max(n) OVER (PARTITION BY item_id, doc_id ORDER BY delta RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM h) SELECT item_id, doc_id, delta, n FROM m WHERE n >= 3 AND n = m""",
)
def offset_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.local_maxima(offset_histogram(spark, sf_dir), ["item_id", "doc_id"], "delta", "n", 2, 3)


@register(
    "containment_score",
    f"""{_BOTH}, t AS (SELECT item_id, count(DISTINCT hash) AS total FROM b GROUP BY item_id),
    c AS (SELECT doc_id, item_id, count(DISTINCT hash) AS matched FROM d JOIN b USING (hash) GROUP BY ALL) SELECT item_id, doc_id, matched, total FROM c JOIN t USING (item_id) WHERE matched >= total * 0.15""",
)
def containment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.containment(grams(spark, sf_dir, "documents", "doc_id"), staged(grams(spark, sf_dir, "benchmark", "item_id")), "doc_id", "item_id", 0.15)


@register(
    "stop_shingles",
    f"""WITH d AS ({_grams('documents', 'doc_id')}), n AS (SELECT count(DISTINCT doc_id) AS t FROM d)
    SELECT hash, df FROM (SELECT hash, count(DISTINCT doc_id) AS df FROM d GROUP BY hash), n WHERE df > floor(t * 0.01)""",
)
def stop_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.stop_hashes(fingerprints.shingles(table(spark, sf_dir, "documents"), "doc_id", "text", WIDTH, shown=True), "doc_id", 0.01)


@register(
    "stop_anti_join",
    f"""WITH d AS ({_grams('documents', 'doc_id')}), n AS (SELECT count(DISTINCT doc_id) AS t FROM d),
    s AS (SELECT hash FROM (SELECT hash, count(DISTINCT doc_id) AS df FROM d GROUP BY hash), n WHERE df > floor(t * 0.01))
    SELECT doc_id, count(*) AS n_kept FROM d WHERE hash NOT IN (SELECT hash FROM s) GROUP BY doc_id""",
)
def stop_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # cut anew for each pass: the hashes of all documents are larger than their texts
    d = grams(spark, sf_dir, "documents", "doc_id").select("doc_id", "hash")
    stops = staged(fingerprints.stop_hashes(d, "doc_id", 0.01).select("hash"))
    return d.join(stops, "hash", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_kept"))


@register(
    "matched_runs",
    f"""{_BOTH}, p AS (SELECT DISTINCT item_id, doc_id, d.pos AS pos FROM b JOIN d USING (hash)), w AS (SELECT *, pos - lag(pos) OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS g FROM p),
    i AS (SELECT *, sum(CASE WHEN g > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM w)
    SELECT item_id, doc_id, min(pos) AS run_start, max(pos) AS run_end, count(*) AS n_rows FROM i GROUP BY item_id, doc_id, i""",
)
def matched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.offset_pairs(staged(grams(spark, sf_dir, "benchmark", "item_id")), grams(spark, sf_dir, "documents", "doc_id"))
    places = pairs.select(F.col("i_item_id").alias("item_id"), F.col("q_doc_id").alias("doc_id"), F.col("q_pos").alias("pos")).distinct()
    return ordered.contiguous_runs(places, ["item_id", "doc_id"], "pos", 3)


@register(
    "best_run",
    f"""{_BOTH}, p AS (SELECT DISTINCT item_id, doc_id, d.pos AS pos FROM b JOIN d USING (hash)), w AS (SELECT *, pos - lag(pos) OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS g FROM p),
    i AS (SELECT *, sum(CASE WHEN g > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM w),
    r AS (SELECT item_id, doc_id, min(pos) AS run_start, max(pos) AS run_end, count(*) AS n_rows FROM i GROUP BY item_id, doc_id, i)
    SELECT *, run_end - run_start AS length FROM r ORDER BY length DESC, item_id, doc_id, run_start LIMIT 1""",
)
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.best_run(matched_runs(spark, sf_dir), F.col("run_end") - F.col("run_start"), ["item_id", "doc_id", "run_start"])


@register(
    "matched_files",
    f"{_BOTH} SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT b.pos) AS n_anchors FROM b JOIN d USING (hash) GROUP BY item_id",
)
def matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.offset_pairs(staged(grams(spark, sf_dir, "benchmark", "item_id")), grams(spark, sf_dir, "documents", "doc_id"))
    return pairs.groupBy(F.col("i_item_id").alias("item_id")).agg(F.count_distinct("q_doc_id").alias("n_docs"), F.count_distinct("i_pos").alias("n_anchors"))


@register(
    "fanout_pairs",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 60000000 AS m, CAST(floor(value * 10) AS BIGINT) AS v FROM events),
    p AS (SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id, b.m - a.m AS step, a.v AS va, b.v AS vb, row_number() OVER (PARTITION BY a.event_id ORDER BY b.m, b.event_id) AS r
      FROM e a JOIN e b ON a.user_id = b.user_id AND b.m - a.m BETWEEN 60 AND 1440)
    SELECT user_id, left_id, right_id, step, (least(greatest(va, 0), 1023) << 20) | (least(greatest(vb, 0), 1023) << 10) | least(greatest(step, 0), 1023) AS code FROM p WHERE r <= 5""",
)
def fanout_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", F.floor(F.col("us") / (60 * MICROS)).alias("m"), F.floor(F.col("value") * 10).alias("v"))
    return fingerprints.fanout_pairs(rows, ["user_id"], "m", "event_id", F.col("v"), 60, 1440, 5)
