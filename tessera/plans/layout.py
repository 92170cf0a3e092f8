"""Queries of box and line layout, on boxes made from order lines and readings made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import boxes, folds, ordered

from .catalog import register, table
from .rules import _readings

_BOXES = """b AS (SELECT l_orderkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id, l_partkey % 60 AS x0, l_suppkey % 7 * 20 AS y0, l_partkey % 60 + l_quantity AS x1, l_suppkey % 7 * 20 + l_quantity * (0.5 + l_partkey % 4 * 0.75) AS y1 FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, q = F.col("l_partkey"), F.col("l_quantity")
    top = F.col("l_suppkey") % 7 * 20
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    items = table(spark, sf_dir, "lineitem")
    # dealt once, by the size of the table: all steps by frame keep to it, and a task's share does not grow
    dealt = items.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").repartition(ordered.parts(items), "l_orderkey")
    return dealt.select(
        F.col("l_orderkey").alias("f"), nth.alias("id"), (part % 60).alias("x0"), top.alias("y0"), (part % 60 + q).alias("x1"), (top + q * (0.5 + part % 4 * 0.75)).alias("y1")
    )


@register(
    "stacked_boxes",
    f"""WITH {_BOXES}, r AS (SELECT *, (x0 + x1) / 2.0 AS c, x1 > x0 AND y1 - y0 >= 2 * (x1 - x0) AS a, x1 > x0 AND y1 > y0 AND greatest(x1 - x0, y1 - y0) <= 2 * least(x1 - x0, y1 - y0) AS sq FROM b),
    q AS (SELECT * FROM r WHERE sq AND NOT a AND EXISTS (SELECT 1 FROM r o WHERE o.f = r.f AND o.a AND abs(o.c - r.c) < 10)),
    s AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY f ORDER BY c, id) > 2 THEN 1 ELSE 0 END AS n FROM q),
    g AS (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY c, id ROWS UNBOUNDED PRECEDING) AS g FROM s), m AS (SELECT *, count(*) OVER (PARTITION BY f, g) AS m FROM g)
    SELECT f, x0, y0, x1, y1, 1 AS n_boxes, id FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.f = b.f AND m.id = b.id AND m.m > 1)
    UNION ALL SELECT f, min(x0), min(y0), max(x1), max(y1), count(*), min(id) FROM m WHERE m > 1 GROUP BY f, g""",
)
def stacked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.stacked(_boxes(spark, sf_dir), ["f"], "id", 100)


@register(
    "baseline_union",
    f"""WITH {_BOXES}, s AS (SELECT *, CASE WHEN y1 - lag(y1) OVER (PARTITION BY f ORDER BY y1, id) > 15 THEN 1 ELSE 0 END AS n FROM b),
    g AS (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY y1, id ROWS UNBOUNDED PRECEDING) AS g FROM s),
    k AS (SELECT f, g, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, median(y1 - y0) AS h FROM g GROUP BY f, g),
    d AS (SELECT f, n AS dn, y0 AS t, y1 AS b, h AS dh, g AS dg FROM k QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, g) = 1),
    j AS (SELECT k.*, dn >= 3 AS sure, g = dg AS own, dn < 3 OR g = dg OR n > 1 OR CASE WHEN y1 <= t THEN t - y1 WHEN y0 >= b THEN y0 - b ELSE 0 END <= dh AS kept FROM k JOIN d USING (f))
    SELECT f, min(x0) FILTER (kept) AS x0, min(y0) FILTER (kept) AS y0, max(x1) FILTER (kept) AS x1, max(y1) FILTER (kept) AS y1, CAST(sum(n) FILTER (kept) AS BIGINT) AS n_kept,
      bool_or(sure AND kept AND NOT own) AS multiple, bool_or(NOT kept) AS discarded FROM j GROUP BY f""",
)
def baseline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.baseline_union(_boxes(spark, sf_dir), ["f"], "id", 15.0)


@register(
    "steady_unions",
    f"""WITH {_BOXES}, u AS (SELECT f // 8 AS f, f % 8 AS batch, min(y0) AS t, max(y1) AS b FROM b GROUP BY ALL)
    SELECT f, batch, abs(t - first_value(t) OVER w) <= 20 AND abs(b - first_value(b) OVER w) <= 20 AS steady FROM u WINDOW w AS (PARTITION BY f ORDER BY batch)""",
)
def steady_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    unions = _boxes(spark, sf_dir).groupBy(F.floor(F.col("f") / 8).alias("g"), (F.col("f") % 8).alias("batch")).agg(F.min("y0").alias("t"), F.max("y1").alias("b"))
    first = lambda c: F.first(c).over(Window.partitionBy("g").orderBy("batch"))
    return unions.select(F.col("g").alias("f"), "batch", boxes.stays(F.col("t"), F.col("b"), first("t"), first("b"), 20).alias("steady"))


@register(
    "crop_axes",
    """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 16 AS o, CAST(p_size AS BIGINT) * 16 * (p_partkey % 5 + 1) // (1 + p_partkey % 3) AS n FROM part), g AS (SELECT *, o // gcd(o, n) AS os, n // gcd(o, n) AS ns FROM p),
    a AS (SELECT *, CASE WHEN ns % 2 = 0 THEN os ELSE 2 * os END AS align FROM g) SELECT p_partkey, CASE WHEN (os & (os - 1)) = 0 AND align <= 64 THEN align END AS align, CASE WHEN (os & (os - 1)) = 0 AND align <= 64 THEN ns END AS native_step FROM a""",
)
def crop_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("p_size").cast("bigint") * 16
    native = F.expr("cast(p_size as bigint) * 16 * (p_partkey % 5 + 1) div (1 + p_partkey % 3)")
    plan = table(spark, sf_dir, "part").select("p_partkey", boxes.crop_axis(out, native).alias("p"))
    return plan.select("p_partkey", "p.align", "p.native_step")


@register(
    "padded_runs",
    "SELECT l_orderkey, l_linenumber, greatest(l_suppkey % 9 - 3, 0) AS s, l_suppkey % 9 + CAST(l_quantity AS BIGINT) + 2 AS e, CAST(l_quantity AS BIGINT) AS length FROM lineitem WHERE l_quantity >= 20",
)
def padded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 9).alias("s"), (F.col("l_suppkey") % 9 + F.col("l_quantity").cast("bigint")).alias("e"))
    return ordered.padded_runs(runs, "s", "e", 20, 3, 2)


@register("text_lines")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir).select("f", "id", ((F.col("y0") + F.col("y1")) / 2).alias("center"), (F.col("y1") - F.col("y0")).alias("size"))
    return folds.run(words, ["f"], ["id"], folds.text_lines, "f long, id int, line int", ordered.parts(table(spark, sf_dir, "lineitem")))


@register("content_segments")
def content_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).select("user_id", (F.col("strip") * 8 + F.col("place")).alias("at"), "text", "confidence")
    return folds.run(rows, ["user_id"], ["at"], folds.content_segments(60), "user_id long, start long, end long, text string, confidence double, n_rows int")
