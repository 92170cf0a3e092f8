"""Operators over boxes (x0, y0, x1, y1) of a frame: fragments, clusters, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]
SIDES = ("x0", "y0", "x1", "y1")


def _islands(df: DataFrame, keys: Keys, by: str, ties: Sequence[str], apart: Column | float, out: str) -> DataFrame:
    """Rows numbered by runs along `by` whose steps are no more than `apart`."""
    w = Window.partitionBy(*keys).orderBy(by, *ties)
    new = F.coalesce((F.col(by) - F.lag(by).over(w) > apart).cast("int"), F.lit(0))
    return df.withColumn("__n", new).withColumn(out, F.sum("__n").over(w)).drop("__n")


def _bounds() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def stacked(df: DataFrame, keys: Keys, id_: str, width: float, near: float = 0.1, align: float = 0.02) -> DataFrame:
    """Boxes of each frame with the stacked parts of upright texts made one: keys, sides, n_boxes, first id.

    An anchor is at least twice as high as wide. Where one is there, roughly square boxes (sides no more
    than two to one) whose middle lies within `near` of the width from an anchor's are fragments; those
    whose middles follow each other within `align` of the width are one text. Boxes without area stay.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    anchor = (w > 0) & (h >= 2 * w)
    square = ~anchor & (w > 0) & (h > 0) & (F.greatest(w, h) <= 2 * F.least(w, h))
    rows = df.select(*keys, F.col(id_).alias("id"), *SIDES, ((F.col("x0") + F.col("x1")) / 2).alias("__c"), anchor.alias("__a"), square.alias("__q"))
    anchors = rows.where("__a").select(*keys, F.col("__c").alias("__ac")).distinct()
    mine = rows.where("__q").join(anchors, [*keys]).where(F.abs(F.col("__c") - F.col("__ac")) < near * width).select(*keys, "id").distinct()
    parts = _islands(rows.join(mine, [*keys, "id"]), keys, "__c", ["id"], align * width, "__g")
    parts = parts.withColumn("__m", F.count("*").over(Window.partitionBy(*keys, "__g"))).where("__m > 1")
    whole = parts.groupBy(*keys, "__g").agg(*_bounds(), F.count("*").alias("n_boxes"), F.min("id").alias("id")).drop("__g")
    alone = rows.join(parts.select(*keys, "id"), [*keys, "id"], "left_anti").select(*keys, *SIDES, F.lit(1).cast("bigint").alias("n_boxes"), "id")
    return alone.unionByName(whole)


def baseline_union(df: DataFrame, keys: Keys, id_: str, tolerance: float, least: int = 3, adjacent: float = 1.0) -> DataFrame:
    """The bounds of the boxes that belong to the commonest baseline: keys, sides, n_kept, multiple, discarded.

    Baselines (y1) within `tolerance` of the next are one cluster; the dominant one is the largest, the
    upper one on ties. With fewer than `least` members every box counts. Else other clusters of two and
    more count too (multiple), and so does a lone box no further from the dominant bounds than `adjacent`
    median heights of its boxes (multiple); other lone boxes do not (discarded).
    """
    rows = _islands(df.select(*keys, F.col(id_).alias("__id"), *SIDES), keys, "y1", ["__id"], tolerance, "__g")
    cluster = rows.groupBy(*keys, "__g").agg(F.count("*").alias("__n"), F.min("y0").alias("__t"), F.max("y1").alias("__b"), F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("__h"), *_bounds())
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), "__g"))
    cluster = cluster.withColumn("__z", first)
    whole = Window.partitionBy(*keys)
    top = lambda c: F.max(F.when(F.col("__z") == 1, F.col(c))).over(whole)
    cluster = cluster.select("*", top("__n").alias("__dn"), top("__t").alias("__dt"), top("__b").alias("__db"), top("__h").alias("__dh"))
    gap = F.when(F.col("y1") <= F.col("__dt"), F.col("__dt") - F.col("y1")).when(F.col("y0") >= F.col("__db"), F.col("y0") - F.col("__db")).otherwise(0.0)
    sure = F.col("__dn") >= least
    kept = ~sure | (F.col("__z") == 1) | (F.col("__n") > 1) | (gap <= adjacent * F.col("__dh"))
    cluster = cluster.withColumn("__k", kept).withColumn("__s", sure)
    of = lambda c, f: f(F.when(F.col("__k"), F.col(c)))
    return cluster.groupBy(*keys).agg(
        of("x0", F.min).alias("x0"), of("y0", F.min).alias("y0"), of("x1", F.max).alias("x1"), of("y1", F.max).alias("y1"), of("__n", F.sum).alias("n_kept"),
        F.bool_or(F.col("__s") & F.col("__k") & (F.col("__z") > 1)).alias("multiple"), F.bool_or(~F.col("__k")).alias("discarded"),
    )


def stays(top: Column, bottom: Column, first_top: Column, first_bottom: Column, tolerance: Column | float) -> Column:
    """Whether a union's upper and lower edge are both still where its streak began; widths do not count."""
    return (F.abs(top - first_top) <= tolerance) & (F.abs(bottom - first_bottom) <= tolerance)


def crop_axis(out: Column, native: Column, most: int = 64) -> Column:
    """struct(align, native_step, out_step): out sizes that are multiples of align have exact, even native ones.

    Null where the reduced out size is no power of two, or align would be more than `most`.
    """
    both = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(out.cast("bigint").alias("a"), native.cast("bigint").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))),
        lambda s: s["a"],
    )
    o, n = (out / both).cast("bigint"), (native / both).cast("bigint")
    align = F.when(n % 2 == 0, o).otherwise(2 * o)
    return F.when((o.bitwiseAND(o - 1) == 0) & (align <= most), F.struct(align.alias("align"), n.alias("native_step"), o.alias("out_step")))
