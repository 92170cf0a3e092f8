"""Queries of folds, components and streams. Folds that SQL cannot express have plain twins in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import fresh_dir
from tessera.operators import folds, graph
from tessera.streaming import pipelines

from .catalog import register, table
from .rows import HOUR, events, minutes

CENTI = 10_000


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dialogue rows of their users, an hour as a centisecond's hundredth."""
    return minutes(spark, sf_dir).select("user_id", F.floor(F.col("start") / HOUR).alias("start"), F.floor(F.col("end") / HOUR + 1).alias("end"), F.col("event_type").alias("text"), "event_id")


@register("subtitle_merge")
def subtitle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).join(events(spark, sf_dir).select("event_id", F.col("value").alias("confidence")), "event_id")
    return folds.run(rows, ["user_id"], ["start", "event_id"], folds.merge_readings(12, 80), "user_id long, start long, end long, text string, confidence double, n_rows int")


@register(
    "nms_greedy",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS "at", value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, epoch_us(ts)) AS k FROM events),
    s AS (SELECT user_id, k, "at", value, true AS took, ["at"] AS kept FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, e."at", e.value, ok, CASE WHEN ok THEN list_append(s.kept, e."at") ELSE s.kept END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1,
        LATERAL (SELECT len(s.kept) < 20 AND len(list_filter(s.kept, lambda a: abs(a - e."at") <= 86400000000)) = 0 AS ok))
    SELECT user_id, "at", value FROM s WHERE took""",
)
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("us").alias("at"), "value")
    return folds.run(rows, ["user_id"], ["at"], folds.suppress(24 * HOUR, 20), "user_id long, at long, value double")


@register(
    "farthest_order",
    """WITH RECURSIVE d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS "at" FROM events), g AS (SELECT user_id, list("at" ORDER BY "at") AS "left" FROM d GROUP BY user_id),
    s AS (SELECT user_id, 0 AS place, "left"[1] AS "at", "left"[2:] AS "left", ["left"[1]] AS taken FROM g
      UNION ALL SELECT user_id, place + 1, best, list_filter("left", lambda a: a <> best), list_append(taken, best) FROM s,
        LATERAL (SELECT list_sort(list_transform("left", lambda a: [-list_min(list_transform(taken, lambda t: abs(a - t))), a]))[1][2] AS best) WHERE len("left") > 0)
    SELECT user_id, "at", place FROM s""",
)
def farthest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("at")).distinct()
    return folds.run(days, ["user_id"], ["at"], folds.spread_order, "user_id long, at long, place int")


@register(
    "online_cluster",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS "at", value AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS k FROM events),
    s AS (SELECT user_id, k, [{'first': "at", 'last': "at", 'total': x, 'n': 1}] AS c FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(s.c, {'first': e."at", 'last': e."at", 'total': e.x, 'n': 1})
        ELSE list_transform(s.c, lambda o, i: CASE WHEN i = hit THEN {'first': o.first, 'last': e."at", 'total': o.total + e.x, 'n': o.n + 1} ELSE o END) END
      FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1,
        LATERAL (SELECT list_position(list_transform(s.c, lambda o: abs(o.total / o.n - e.x) <= 15 AND e."at" - o.last <= 345600000000), true) AS hit)),
    l AS (SELECT user_id, unnest(c) AS o FROM (SELECT user_id, arg_max(c, k) AS c FROM s GROUP BY user_id))
    SELECT user_id, o.first AS "first", o.last AS "last", o.n AS n_rows FROM l""",
)
def online_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("us").alias("at"), F.col("value").alias("x"))
    return folds.run(rows, ["user_id"], ["at"], folds.online_clusters(15.0, 96 * HOUR), "user_id long, first long, last long, n_rows int")


@register("dup_fixpoint")
def dup_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minutes(spark, sf_dir).join(events(spark, sf_dir).select("event_id", F.col("value").alias("x")), "event_id")
    return folds.run(rows, ["user_id"], ["start", "event_id"], folds.drop_duplicates_to_fixpoint(30.0), "user_id long, start long, end long, x double, n_rows int")


@register("near_pairs_indel")
def near_pairs_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.ship import ship

    names = table(ship(spark), sf_dir, "part").select("p_type", "p_name").distinct()
    a, b = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    pairs = a.join(b, "p_type").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("ratio", folds.ratio_column("a", "b")).where("ratio >= 60")


@register(
    "components",
    """WITH RECURSIVE t AS (SELECT DISTINCT md5(text) AS h, doc_id FROM documents), e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (h))
    SELECT a AS node, min(b) AS comp FROM e GROUP BY a HAVING count(*) > 1""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    hub = docs.groupBy("h").agg(F.min("doc_id").alias("hub"))
    edges = docs.join(hub, "h").where("doc_id > hub")
    return graph.components(edges, "doc_id", "hub")


@register(
    "overlap_groups",
    """WITH RECURSIVE s AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events WHERE value * 60 >= 1),
    w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM w),
    g AS (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, i) AS comp, count(*) OVER (PARTITION BY user_id, i) AS n FROM i) SELECT event_id AS node, comp FROM g WHERE n > 1""",
)
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import spans

    rows = minutes(spark, sf_dir).where(F.col("end") > F.col("start"))
    edges = spans.overlap_join(rows, rows, ["user_id"], 6 * HOUR, id_="event_id").where("a_id < b_id")
    return graph.components(edges, "a_id", "b_id")


def _drained(spark: SparkSession, sf_dir: str, make, mode: str) -> DataFrame:
    return pipelines.drain(make, spark, sf_dir, mode, fresh_dir(spark, "stream"))


@register(
    "stream_run_states",
    "SELECT user_id, arg_max(event_type, event_id) AS last_event, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id",
)
def stream_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, pipelines.run_states, "complete")


@register(
    "stream_hourly",
    "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS hour_us, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL",
)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, pipelines.hourly, "complete")


@register(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY user_id, i""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, pipelines.sessions, "append").select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


@register(
    "stream_until_terminal",
    """WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS stop FROM events GROUP BY user_id) SELECT user_id, event_id, event_type FROM events JOIN f USING (user_id) WHERE stop IS NULL OR event_id <= stop""",
)
def stream_until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, pipelines.until_terminal, "append").where("user_id is not null")


@register("stream_first_of_each", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event comes first is the order of arrival; that each key comes once is what can be compared."""
    out = _drained(spark, sf_dir, lambda events: pipelines.first_of_each(events, ["user_id", "event_type"]), "append")
    return out.where("user_id is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


_TRACK = """WITH RECURSIVE e AS (SELECT user_id, event_id AS "at", value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    s AS (SELECT user_id, k, "at", x AS base, CAST(NULL AS BIGINT) AS done, 0 AS seen, 0 AS cand, 'frame' AS kind FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, e."at", CASE WHEN near THEN s.base ELSE e.x END, CASE WHEN near THEN NULL ELSE s."at" END, CASE WHEN near THEN s.seen + 1 ELSE 0 END,
        CASE WHEN NOT near THEN 0 WHEN (s.seen + 1) % 3 = 0 AND s.cand < 8 THEN s.cand + 1 ELSE s.cand END,
        CASE WHEN NOT near THEN 'frame' WHEN (s.seen + 1) % 3 = 0 AND s.cand < 8 THEN 'candidate' ELSE 'extend' END
      FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1, LATERAL (SELECT abs(e.x - s.base) <= 10.0 AS near))
    SELECT user_id, "at", kind FROM s UNION ALL SELECT user_id, done, 'done' FROM s WHERE done IS NOT NULL
    UNION ALL SELECT user_id, max("at"), 'done' FROM e GROUP BY user_id"""


@register("stream_state_machine", _TRACK)
def stream_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, pipelines.tracked, "append")


@register("frame_state_machine", _TRACK)
def frame_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("at"), F.col("value").alias("x"))
    return folds.run(rows, ["user_id"], ["at"], folds.track(10.0, 3, 8), "user_id long, at long, kind string")


@register(
    "admission",
    """WITH RECURSIVE e AS (SELECT source, doc_id AS id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    s AS (SELECT source, k, id, CASE WHEN size <= 40000 THEN size ELSE 0 END AS used, size <= 40000 AS took FROM e WHERE k = 1
      UNION ALL SELECT e.source, e.k, e.id, CASE WHEN s.used + e.size <= 40000 THEN s.used + e.size ELSE s.used END, s.used + e.size <= 40000 FROM s JOIN e ON e.source = s.source AND e.k = s.k + 1)
    SELECT source, id, used FROM s WHERE took""",
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return folds.run(rows, ["source"], ["id"], folds.admit(40_000), "source string, id long, used long")


@register("seeded_draw")
def seeded_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("us").alias("at"))
    return folds.run(rows, ["user_id"], ["at"], folds.draw(5, 24 * HOUR, 64, 1), "user_id long, at long")


@register("spatial_batches")
def spatial_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minutes(spark, sf_dir).join(events(spark, sf_dir).select("event_id", F.col("value").alias("x")), "event_id")
    return folds.run(rows, ["user_id"], ["start", "event_id"], folds.batches(25.0), "user_id long, start long, end long, n_rows int")


@register("spectrum_peaks")
def spectrum_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import signals

    def found(x) -> list:
        return [t * 1000 + f for t, f, _ in signals.peaks(signals.spectrum(x, 16, 8), 0.1, 3, 3)]

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return signals.per_row(rows, "embedding", "peaks", "array<int>", found).select("vec_id", F.explode("peaks").alias("peak"))


@register(
    "speech_activity",
    """WITH o AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS d FROM events WHERE value >= 10),
    i AS (SELECT *, sum(CASE WHEN d > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS i FROM o)
    SELECT user_id, min(us) AS "start", max(us) AS "end", count(*) AS n_rows FROM i GROUP BY user_id, i HAVING max(us) - min(us) >= 3600000000""",
)
def speech_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import signals

    return signals.activity(events(spark, sf_dir), ["user_id"], "us", F.col("value") >= 10, 12 * HOUR, HOUR)
