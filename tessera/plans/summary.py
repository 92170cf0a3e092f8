"""Queries of the aggregating operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import ordered, summaries

from .catalog import register, table
from .rows import HOUR, events


@register(
    "lower_median",
    "SELECT c_nationkey, CASE WHEN count(*) >= 3 THEN quantile_disc(c_acctbal, 0.5) END AS median FROM customer GROUP BY c_nationkey",
)
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.lower_median(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal")


@register(
    "percentile_band",
    "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.2), 4) AS p20, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY ALL",
)
def percentile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.percentile_band(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.2, 0.99])
    return out.select("l_returnflag", "l_linestatus", F.round("p20", 4).alias("p20"), F.round("p99", 4).alias("p99"))


@register(
    "consensus_median",
    """WITH m AS (SELECT p_brand, quantile_cont(p_size, 0.5) AS consensus FROM part GROUP BY p_brand)
    SELECT p_partkey, p_brand, consensus, p_size <= consensus * 1.5 AND consensus <= p_size * 1.5 AS consistent FROM part JOIN m USING (p_brand)""",
)
def consensus_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.consistent_with_median(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 1.5).select("p_partkey", "p_brand", "consensus", "consistent")


@register(
    "plateau_intersection",
    """WITH r AS (SELECT event_type, user_id, CAST(floor(value) AS BIGINT) AS lo, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) + 150 END AS hi FROM events)
    SELECT user_id, event_type, CASE WHEN NOT bool_or(lo IS NULL OR hi IS NULL) AND max(lo) <= min(hi) THEN max(lo) END AS lo,
      CASE WHEN NOT bool_or(lo IS NULL OR hi IS NULL) AND max(lo) <= min(hi) THEN min(hi) END AS hi FROM r GROUP BY ALL""",
)
def plateau_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.floor("value")
    rows = events(spark, sf_dir).select("event_type", "user_id", lo.alias("lo"), F.when(F.col("event_id") % 97 != 0, lo + 150).alias("hi"))
    return summaries.plateau_intersection(rows, ["user_id", "event_type"], "lo", "hi")


@register(
    "bounding_union",
    """SELECT label, min(embedding[1]) AS x0, max(embedding[1]) AS x1, min(embedding[2]) AS y0, max(embedding[2]) AS y1 FROM embeddings GROUP BY label""",
)
def bounding_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("embedding")[0], F.col("embedding")[1]
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


@register(
    "steady_share",
    """WITH g AS (SELECT user_id, event_type, arg_min(value, event_id) AS f, min(value) AS lo, max(value) AS hi, max(epoch_us(ts)) - min(epoch_us(ts)) AS s, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, n, CASE WHEN NOT (hi - f <= 20 AND f - lo <= 20) THEN 'no' WHEN s >= 36000000000 THEN 'yes' ELSE 'unknown' END AS status FROM g""",
)
def steady_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.steady_share(events(spark, sf_dir), ["user_id", "event_type"], "event_id", "value", 20, "us", 10 * HOUR)


@register(
    "modal_vote",
    """WITH v AS (SELECT user_id, event_type, count(*) AS votes, sum(CAST(round(value * 100) AS BIGINT)) AS w, min(event_id) AS o FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, w DESC, o) AS r FROM v) SELECT user_id, event_type, votes FROM r WHERE r = 1""",
)
def modal_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return summaries.modal(rows, ["user_id"], "event_type", "cents", "event_id")


@register(
    "best_reading",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type) DESC, value DESC, event_id) AS r FROM events),
    s AS (SELECT user_id, min(event_id) AS first_place, max(event_id) AS last_place FROM events GROUP BY user_id)
    SELECT user_id, event_type, event_id AS chosen, first_place, last_place FROM r JOIN s USING (user_id) WHERE r = 1""",
)
def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.best_reading(events(spark, sf_dir), ["user_id"], "event_type", "value", "event_id")


@register(
    "rms_envelope",
    """WITH r AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, CASE WHEN n // 60 = 0 THEN 59 ELSE least(i // (n // 60), 59) END AS bin, CAST(sum(q * q) AS BIGINT) AS square_sum, count(*) AS n_values FROM r GROUP BY ALL""",
)
def rms_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = ordered.placed(items.select("l_returnflag", *order, F.col("l_quantity").cast("bigint").alias("q")), ["l_returnflag"], order, ordered.parts(items))
    return summaries.envelope(rows, ["l_returnflag"], "__i", "__n", "q", 60)


@register(
    "clutter_curve",
    "SELECT lang, CAST(t AS INTEGER) AS t, count(*) FILTER (n_chars >= t) AS fired, count(*) AS n FROM documents, (SELECT unnest([500, 1000, 2000, 4000, 8000]) AS t) GROUP BY lang, t",
)
def clutter_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return summaries.threshold_curve(docs, ["lang"], [500, 1000, 2000, 4000, 8000], F.col("n_chars") >= F.col("t"))


@register(
    "choose_tiles",
    """SELECT user_id, 'lowest' AS kind, arg_min(us, (value, us)) AS at FROM (SELECT user_id, value, epoch_us(ts) AS us FROM events) GROUP BY user_id
    UNION ALL SELECT user_id, 'highest', arg_min(us, (-value, us)) FROM (SELECT user_id, value, epoch_us(ts) AS us FROM events) GROUP BY user_id""",
)
def choose_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.extremes(events(spark, sf_dir), ["user_id"], {"lowest": ("min", "value"), "highest": ("max", "value")}, "us")


@register(
    "median_row",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM r WHERE r = n // 2 + 1""",
)
def median_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.median_row(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice", "o_orderkey")


@register("events_digest", "SELECT user_id, sha256(string_agg(event_type, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def events_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.digest(events(spark, sf_dir), ["user_id"], "event_type", "event_id")


@register(
    "run_reducer",
    """SELECT user_id, arg_max(event_type, event_id) AS last_event, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id""",
)
def run_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last_event"),
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.max("us").alias("last_us"),
    )


@register(
    "chip_counts",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY o_orderpriority""",
)
def chip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda s, n: F.count_if(F.col("o_orderstatus") == s).alias(n)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(count("F", "finished"), count("O", "open"), count("P", "pending"))


@register(
    "eta",
    """WITH g AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS cents, count(*) FILTER (o_orderstatus = 'F') AS done,
      count(*) FILTER (o_orderstatus <> 'F') AS left_, count(*) FILTER (o_orderstatus = 'P') AS active FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN done > 0 AND left_ > 0 THEN CAST(cents * left_ // (done * greatest(active, 1)) AS BIGINT) END AS eta_cents FROM g""",
)
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(status == "F", cents)).alias("cents"), F.count_if(status == "F").alias("done"), F.count_if(status != "F").alias("left_"), F.count_if(status == "P").alias("active")
    )
    return g.selectExpr("o_custkey", "CASE WHEN done > 0 AND left_ > 0 THEN cents * left_ div (done * greatest(active, 1)) END AS eta_cents")


@register(
    "verification_curve",
    """WITH c AS (SELECT lang, n_chars // 500 AS t, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
    b AS (SELECT *, max(good * 1000 // n) OVER (PARTITION BY lang) AS best FROM c) SELECT lang, t, n, good, good * 1000 // n >= best - 20 AS valid FROM b""",
)
def verification_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 500).alias("t"))
    c = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "t").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    share = F.floor(F.col("good") * 1000 / F.col("n"))
    return c.select("lang", "t", "n", "good", (share >= F.max(share).over(Window.partitionBy("lang")) - 20).alias("valid"))


@register(
    "first_losing_threshold",
    """WITH c AS (SELECT source, n_chars // 250 AS t, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY t ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER (PARTITION BY source) AS a FROM c)
    SELECT source, min(t) AS losing FROM r WHERE s * 100 >= a * 20 GROUP BY source""",
)
def first_losing_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("n_chars") / 250).alias("t")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    c = c.withColumn("s", F.sum("n").over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.sum("n").over(w))
    return c.where(F.col("s") * 100 >= F.col("a") * 20).groupBy("source").agg(F.min("t").alias("losing"))
