"""Queries of the window, run and span operators on the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.clock import MICROS, micros
from tessera.operators import ordered, spans

from .catalog import register, table

HOUR = 3600 * MICROS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", micros("ts").alias("us"))


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: from the event on, as many minutes as its value says."""
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("us").alias("start"), (F.col("us") + F.floor(F.col("value") * 60) * MICROS).alias("end"))


_SPANS = "SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events"


@register(
    "dedupe_first",
    "SELECT min(doc_id) AS doc_id, lang, source, count(*) AS n FROM (SELECT * FROM documents) GROUP BY lang, source, text",
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    first = ordered.dedupe_first(docs, ["lang", "source", "h"], ["doc_id"])
    n = docs.groupBy("lang", "source", "h").agg(F.count("*").alias("n"))
    return first.join(n, ["lang", "source", "h"]).select("doc_id", "lang", "source", "n")


@register(
    "dedupe_first_line",
    """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
    r AS (SELECT lang, md5(line) AS h, min(doc_id) AS doc_id FROM l WHERE length(line) > 0 GROUP BY ALL) SELECT lang, doc_id, count(*) AS n_lines FROM r GROUP BY ALL""",
)
def dedupe_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 0")
    first = ordered.dedupe_first(lines.select("lang", F.md5(F.col("line").cast("binary")).alias("h"), "doc_id"), ["lang", "h"], ["doc_id"])
    return first.groupBy("lang", "doc_id").agg(F.count("*").alias("n_lines"))


@register(
    "adjacent_dup_drop",
    """WITH w AS (SELECT event_id, user_id, event_type, event_id % 2 = 1 AS m,
      lag(CASE WHEN event_id % 2 = 0 THEN event_type END) OVER o AS p, lead(CASE WHEN event_id % 2 = 0 THEN event_type END) OVER o AS q
      FROM events WINDOW o AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id))
    SELECT event_id, user_id, event_type FROM w WHERE NOT m OR NOT (coalesce(p = event_type, false) OR coalesce(q = event_type, false))""",
)
def adjacent_dup_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.drop_adjacent_duplicates(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type", F.col("event_id") % 2 == 1)
    return out.select("event_id", "user_id", "event_type")


@register(
    "overlap_swap",
    f"""WITH s AS ({_SPANS}), w AS (SELECT *, lead(s) OVER o AS ns, lag(e) OVER o AS pe FROM s WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id))
    SELECT event_id, user_id, CASE WHEN pe - s > 0 AND pe - s <= 7200000000 THEN pe ELSE s END AS "start", CASE WHEN e - ns > 0 AND e - ns <= 7200000000 THEN ns ELSE e END AS "end" FROM w""",
)
def overlap_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minutes(spark, sf_dir).withColumn("at", F.col("start"))
    out = ordered.swap_overlaps(rows, ["user_id"], ["at", "event_id"], "start", "end", 2 * HOUR)
    return out.select("event_id", "user_id", "start", "end")


@register(
    "merge_adjacent_equal",
    f"""WITH s AS ({_SPANS}), w AS (SELECT *, lag(e) OVER o AS pe, lag(event_type) OVER o AS pt FROM s WINDOW o AS (PARTITION BY user_id ORDER BY s, e)),
    i AS (SELECT *, sum(CASE WHEN coalesce(event_type <> pt OR abs(s - pe) >= 21600000000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM w)
    SELECT user_id, min(event_type) AS event_type, min(s) AS run_start, arg_max(e, (s, e)) AS run_end, count(*) AS n_rows FROM i GROUP BY user_id, i""",
)
def merge_adjacent_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.merge_adjacent_equal(minutes(spark, sf_dir), ["user_id"], "start", "end", "event_type", 6 * HOUR)


@register(
    "activity_runs",
    """WITH w AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS d FROM events),
    i AS (SELECT *, sum(CASE WHEN d > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS i FROM w)
    SELECT user_id, greatest(min(us) - 60000000, 0) AS run_start, max(us) + 60000000 AS run_end, count(*) AS n_rows FROM i GROUP BY user_id, i HAVING max(us) - min(us) >= 3600000000""",
)
def activity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ordered.contiguous_runs(events(spark, sf_dir), ["user_id"], "us", 6 * HOUR).where(F.col("run_end") - F.col("run_start") >= HOUR)
    pad = 60 * MICROS
    return runs.select("user_id", F.greatest(F.col("run_start") - pad, F.lit(0)).alias("run_start"), (F.col("run_end") + pad).alias("run_end"), "n_rows")


@register(
    "line_persistence",
    """WITH d AS (SELECT doc_id, source, text, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
    l AS (SELECT DISTINCT source, place, md5(u) AS line FROM (SELECT source, place, unnest(string_split(text, chr(10))) AS u FROM d)),
    i AS (SELECT *, place - row_number() OVER (PARTITION BY source, line ORDER BY place) AS i FROM l)
    SELECT source, line, min(place) AS first_place, max(place) AS last_place FROM i GROUP BY source, line, i HAVING max(place) > min(place)""",
)
def line_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").withColumn("place", F.dense_rank().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint"))
    lines = docs.select("source", "place", F.explode(F.split("text", "\n")).alias("u")).select("source", "place", F.md5(F.col("u").cast("binary")).alias("line"))
    return ordered.line_persistence(lines, ["source"], "place", "line").where("last_place > first_place")


@register(
    "change_events",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""",
)
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.changes_only(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@register(
    "mean_gap",
    """WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS us, count(*) OVER o - 1 AS n, min(epoch_us(ts)) OVER o AS f FROM events
      WINDOW o AS (PARTITION BY user_id ORDER BY epoch_us(ts) ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id, CASE WHEN n > 0 THEN CAST(floor((us - f) / n) AS BIGINT) END AS mean_gap FROM w""",
)
def mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.mean_gap(events(spark, sf_dir), ["user_id"], "us").select("event_id", "user_id", F.floor("mean_gap").alias("mean_gap"))


@register(
    "sliding_rate",
    """WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS n FROM events),
    w AS (SELECT *, min(us) OVER o AS f, min(n) OVER o AS g FROM r WINDOW o AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id, n - g AS gained, us - f AS within_us FROM w""",
)
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = events(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("us")).cast("bigint"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-24 * HOUR, 0)
    out = ordered.sliding_rate(rows, ["user_id"], "us", "n", 24 * HOUR)
    return out.select("event_id", "user_id", (F.col("n") - F.min("n").over(w)).alias("gained"), (F.col("us") - F.min("us").over(w)).alias("within_us"))


@register(
    "interval_union",
    f"""WITH s AS ({_SPANS}), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN coalesce(s > reach, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM w)
    SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n_spans FROM i GROUP BY user_id, i""",
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.union_spans(minutes(spark, sf_dir), ["user_id"])


@register(
    "interval_gaps",
    f"""WITH s AS ({_SPANS}), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
    SELECT user_id, reach AS gap_start, s AS gap_end FROM w WHERE s - reach >= 5000000""",
)
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.gaps(minutes(spark, sf_dir), ["user_id"], 5 * MICROS)


@register(
    "interval_overlap",
    f"""WITH s AS ({_SPANS}) SELECT a.user_id, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end", a.s AS a_start, b.s AS b_start
    FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND least(a.e, b.e) - greatest(a.s, b.s) >= 2000000""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minutes(spark, sf_dir)
    return spans.overlap_join(rows.where("event_type = 'purchase'"), rows.where("event_type = 'error'"), ["user_id"], 6 * HOUR, 2 * MICROS)


@register(
    "interval_pieces",
    f"""WITH s AS ({_SPANS}) SELECT a.user_id, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end"
    FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND least(a.e, b.e) > greatest(a.s, b.s)""",
)
def interval_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minutes(spark, sf_dir)
    return spans.overlap_join(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), ["user_id"], 6 * HOUR).select("user_id", "start", "end")


@register(
    "asof_last",
    """WITH k AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'error')
    SELECT q.user_id, q.event_id AS asked, q.us, (SELECT max(k.event_id) FROM k WHERE k.user_id = q.user_id AND k.us = (SELECT max(us) FROM k k2 WHERE k2.user_id = q.user_id AND k2.us <= q.us)) AS event_id FROM q""",
)
def asof_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    asked = rows.where("event_type = 'error'").select("user_id", "us", F.col("event_id").alias("asked"))
    return spans.last_at_or_before(asked, rows.where("event_type = 'purchase'").select("user_id", "us", "event_id"), ["user_id"], "us", "event_id", "asked")


@register(
    "asof_next",
    """WITH k AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'error')
    SELECT q.user_id, q.event_id AS asked, q.us, (SELECT min(k.event_id) FROM k WHERE k.user_id = q.user_id AND k.us = (SELECT min(us) FROM k k2 WHERE k2.user_id = q.user_id AND k2.us >= q.us)) AS event_id FROM q""",
)
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    asked = rows.where("event_type = 'error'").select("user_id", "us", F.col("event_id").alias("asked"))
    return spans.first_at_or_after(asked, rows.where("event_type = 'purchase'").select("user_id", "us", "event_id"), ["user_id"], "us", "event_id", "asked")


@register("kept_total", f"SELECT user_id, CAST(sum(greatest(e - s, 0)) AS BIGINT) AS kept FROM ({_SPANS}) GROUP BY user_id")
def kept_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.kept_total(minutes(spark, sf_dir), ["user_id"])


@register(
    "kept_position",
    f"SELECT user_id, CAST(sum(greatest(least(e, 1705276800000000) - s, 0)) AS BIGINT) AS kept_before FROM ({_SPANS}) GROUP BY user_id",
)
def kept_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.kept_before(minutes(spark, sf_dir), ["user_id"], F.lit(1_705_276_800 * MICROS))


@register(
    "topk_per_bucket",
    """WITH w AS (SELECT event_id, epoch_us(ts) // 3600000000 AS hour, event_type, value, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000, event_type ORDER BY value DESC, event_id) AS place FROM events)
    SELECT event_id, hour, event_type, value, CAST(place AS INTEGER) AS place FROM w WHERE place <= 5""",
)
def topk_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("us") / HOUR).alias("hour"), "event_type", "value")
    return ordered.top_per_bucket(rows, ["hour", "event_type"], "value", "event_id", 5)


@register(
    "local_maxima",
    """WITH c AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 100) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
    m AS (SELECT *, max(n) OVER (PARTITION BY l_returnflag ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM c) SELECT l_returnflag, bin, n FROM m WHERE n >= 5 AND n = m""",
)
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_extendedprice") / 100).alias("bin")).agg(F.count("*").alias("n"))
    return ordered.local_maxima(bins, ["l_returnflag"], "bin", "n", 2, 5)


@register(
    "lru_prune",
    """WITH w AS (SELECT source, doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents)
    SELECT source, doc_id, n_chars, running FROM w WHERE running <= 40000""",
)
def lru_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ordered.within_budget(docs, ["source"], [F.desc("doc_id")], "n_chars", 40_000)


@register(
    "threshold_suffix",
    """WITH t AS (SELECT unnest(range(0, 20)) AS t), c AS (SELECT lang, t, avg(CASE WHEN n_chars <= (t + 1) * 1000 THEN 1.0 ELSE 0.0 END) >= 0.5 AS ok FROM documents, t GROUP BY lang, t),
    r AS (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS s FROM c) SELECT lang, min(t) AS floor_at FROM r WHERE s = 1 GROUP BY lang""",
)
def threshold_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("t"), "n_chars")
    rate = docs.groupBy("lang", "t").agg(F.avg((F.col("n_chars") <= (F.col("t") + 1) * 1000).cast("int")).alias("rate"))
    return ordered.unbroken_suffix(rate, ["lang"], "t", F.col("rate") >= 0.5)


@register(
    "widest_run",
    """WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
    r AS (SELECT user_id, min(day) AS a, max(day) AS b FROM i GROUP BY user_id, i), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b - a DESC, a DESC) AS n FROM r)
    SELECT user_id, a AS run_start, b AS run_end FROM n WHERE n = 1""",
)
def widest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("day"))
    return ordered.widest_run(days, ["user_id"], "day")


@register(
    "baseline_clusters",
    """WITH w AS (SELECT p_brand, p_retailprice AS p, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS d FROM part),
    i AS (SELECT *, sum(CASE WHEN d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM w),
    c AS (SELECT p_brand, min(p) AS lo, max(p) AS hi, count(*) AS n FROM i GROUP BY p_brand, i), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, lo) AS r FROM c)
    SELECT p_brand, lo AS run_start, hi AS run_end, n AS n_rows FROM r WHERE r = 1""",
)
def baseline_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ordered.contiguous_runs(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 3.0)
    return ordered.top_per_bucket(runs, ["p_brand"], "n_rows", "run_start", 1).drop("place")


@register(
    "smoothing_two_of_three",
    """WITH w AS (SELECT event_id, user_id, sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events)
    SELECT event_id, user_id, n >= 2 AS smooth FROM w""",
)
def smoothing_two_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(-2, 0)
    return events(spark, sf_dir).select("event_id", "user_id", (F.sum((F.col("value") >= 20).cast("int")).over(w) >= 2).alias("smooth"))
