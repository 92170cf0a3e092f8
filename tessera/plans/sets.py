"""Queries of set operations, ladders, reconciliation and nearness joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.clock import micros
from tessera.operators import tables

from .catalog import register, table


@register("scan_filter_project", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@register(
    "reconcile_full_outer",
    """SELECT coalesce(c.k, o.k) AS c_custkey, CASE WHEN c.k IS NULL THEN 'added' WHEN o.k IS NULL THEN 'removed' ELSE 'kept' END AS status
    FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 10 <> 3) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') o ON c.k = o.k""",
)
def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select("c_custkey")
    incoming = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.reconcile(existing, incoming, "c_custkey")


@register("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_semi")


@register("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(ordered, "c_custkey", "left_anti")


@register("set_difference", "SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.subtract(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")))


@register(
    "union_sorted",
    """WITH u AS (SELECT event_id, 'click' AS doc, epoch_us(ts) AS us FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'error', epoch_us(ts) FROM events WHERE event_type = 'error')
    SELECT event_id, doc, row_number() OVER (PARTITION BY us // 86400000000 ORDER BY us, event_id) AS place FROM u""",
)
def union_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", micros("ts").alias("us"))
    parts = [rows.where(F.col("event_type") == t).select("event_id", F.lit(t).alias("doc"), "us") for t in ("click", "error")]
    w = Window.partitionBy(F.floor(F.col("us") / 86_400_000_000)).orderBy("us", "event_id")
    return parts[0].unionByName(parts[1]).select("event_id", "doc", F.row_number().over(w).cast("bigint").alias("place"))


@register(
    "review_ladder",
    """SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'pending' WHEN o_orderstatus = 'F' AND o_totalprice < 5000 THEN 'flagged' WHEN o_orderstatus = 'F' THEN 'reviewed'
      WHEN o_orderpriority = '1-URGENT' THEN 'flagged' WHEN o_orderstatus = 'P' THEN 'proposed' ELSE 'pending' END AS state FROM orders""",
)
def review_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    rungs = [
        (F.col("o_totalprice").isNull(), "pending"),
        (done & (F.col("o_totalprice") < 5000), "flagged"),
        (done, "reviewed"),
        (F.col("o_orderpriority") == "1-URGENT", "flagged"),
        (F.col("o_orderstatus") == "P", "proposed"),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", tables.ladder(rungs, "pending").alias("state"))


@register(
    "upsert_guarded",
    """WITH r AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND r.o_custkey IS NOT NULL THEN r.v ELSE c_mktsegment END AS c_mktsegment,
      (CASE WHEN c_acctbal >= 0 AND r.o_custkey IS NOT NULL THEN r.v ELSE c_mktsegment END) IS DISTINCT FROM c_mktsegment AS changed FROM customer LEFT JOIN r ON c_custkey = r.o_custkey""",
)
def upsert_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return tables.upsert(target, results, "c_custkey", "c_mktsegment", F.col("c_acctbal") >= 0).select("c_custkey", "c_mktsegment", "changed")


@register(
    "flag_algebra",
    """SELECT event_id, event_type || CASE WHEN event_type = 'error' THEN '' ELSE '+error' END AS added, CASE WHEN event_type = 'click' THEN 'seen' ELSE event_type || '+seen' END AS removed, event_type IN ('view', 'click') AS informational FROM events""",
)
def flag_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        tables.flag_add(f, F.lit("error")).alias("added"),
        tables.flag_remove(tables.flag_add(f, F.lit("seen")), F.lit("click")).alias("removed"),
        tables.flag_subset(f, F.lit("view+click")).alias("informational"),
    )


@register(
    "spread_pick",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id FROM r WHERE n <= 6 OR i IN (SELECT CAST(round_even(k * (n - 1) / 5.0, 0) AS BIGINT) FROM range(0, 6) t(k))""",
)
def spread_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread_pick(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 6)


@register(
    "descending_ladder",
    """SELECT p_partkey, unnest(CASE WHEN p_size > 14 THEN list_append(range(p_size, 14, -10), 14) ELSE [p_size] END) AS rung FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""",
)
def descending_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tables.descending_ladder(F.col("p_size").cast("bigint"), 14, 10)).alias("rung"))


@register(
    "first_passing_rung",
    """WITH r AS (SELECT p_partkey, p_retailprice, unnest(CASE WHEN p_size > 14 THEN list_append(range(p_size, 14, -10), 14) ELSE [p_size] END) AS rung FROM (SELECT p_partkey, p_retailprice, CAST(p_size AS BIGINT) AS p_size FROM part))
    SELECT p_partkey, max(rung) AS rung FROM r WHERE CAST(floor(p_retailprice) AS BIGINT) % (rung + 1) < 10 GROUP BY p_partkey""",
)
def first_passing_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").alias("p"), F.explode(tables.descending_ladder(F.col("p_size").cast("bigint"), 14, 10)).alias("rung"))
    return rungs.where(F.col("p") % (F.col("rung") + 1) < 10).groupBy("p_partkey").agg(F.max("rung").alias("rung"))


@register(
    "nearest_centre",
    """WITH c AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal FROM supplier), d AS (SELECT c_custkey, s_suppkey, abs(s_acctbal - c_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey) AS r FROM customer LEFT JOIN c ON c_nationkey = k)
    SELECT c_custkey, CASE WHEN d <= 500 THEN s_suppkey END AS centre FROM d WHERE r = 1""",
)
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("k"), "c_acctbal")
    centres = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("k"), "s_acctbal")
    return tables.nearest(points, centres, ["k"], "c_acctbal", "s_acctbal", "s_suppkey", 500).select("c_custkey", "centre")


@register(
    "array_wanted",
    "SELECT user_id, count(DISTINCT epoch_us(ts) // 3600000000) AS wanted, count(DISTINCT CASE WHEN event_type = 'error' THEN epoch_us(ts) // 3600000000 END) AS cached FROM events GROUP BY user_id",
)
def array_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(micros("ts") / 3_600_000_000).alias("h"))
    return hours.groupBy("user_id").agg(F.count_distinct("h").alias("wanted"), F.count_distinct(F.when(F.col("event_type") == "error", F.col("h"))).alias("cached"))


@register(
    "cached_then_missing",
    """SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS h FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND epoch_us(c.ts) // 3600000000 = epoch_us(e.ts) // 3600000000)""",
)
def cached_then_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(micros("ts") / 3_600_000_000).alias("h"))
    of = lambda t: rows.where(F.col("event_type") == t).select("user_id", "h")
    return of("view").distinct().join(of("click"), ["user_id", "h"], "left_anti")


@register(
    "priority_queue",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS place FROM orders) SELECT o_orderkey, o_orderstatus, place FROM r WHERE place <= 10""",
)
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority", "o_orderkey")
    out = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.row_number().over(w).cast("bigint").alias("place"))
    return out.where("place <= 10")


@register("shared_outputs", "SELECT lower(p_name) AS name, count(DISTINCT p_type) AS n FROM part GROUP BY lower(p_name) HAVING count(DISTINCT p_type) > 1")
def shared_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count_distinct("p_type").alias("n")).where("n > 1")


@register(
    "clamp_boxes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(x, 1000 - w), 0) AS x, least(w, 1000) AS w FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 1200 AS x, CAST(l_quantity AS BIGINT) * 10 AS w FROM lineitem)""",
)
def clamp_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.floor("l_extendedprice") % 1200).alias("x0"), (F.col("l_quantity").cast("bigint") * 10).alias("w0"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest(F.least(F.col("x0"), 1000 - F.col("w0")), F.lit(0)).alias("x"), F.least(F.col("w0"), F.lit(1000)).alias("w"))
