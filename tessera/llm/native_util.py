"""DataFrame-only helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window of running sums sees at most, but for the last level; values one array of spread() holds.
RADIX, SPREAD = 1024, 4096


def byte_size(text: str) -> Column:
    """UTF-8 bytes of a text; none for a null."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")


def free_names(taken: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """The wanted names, with underscores before those that are taken (in either case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def offsets(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """keys, order and the sum of `value` over the rows of the same keys and a smaller `order`.

    order: whole numbers from 0, unique among rows of the same keys. Three levels, so no window sees more
    than RADIX rows, and the last one a RADIX-square-th of the rows of its keys.
    """
    level = [df.select(*keys, F.col(order).alias("_o0"), F.col(value).alias("_v0"))]
    level[0] = level[0].withColumn("_o1", F.expr(f"_o0 div {RADIX}L")).withColumn("_o2", F.expr(f"_o1 div {RADIX}L"))
    level.append(level[0].groupBy(*keys, "_o2", "_o1").agg(F.sum("_v0").alias("_v1")))
    level.append(level[1].groupBy(*keys, "_o2").agg(F.sum("_v1").alias("_v2")))
    got = None
    for k in (2, 1, 0):
        above = [*keys, *[f"_o{j}" for j in (2, 1) if j > k]]
        before = Window.partitionBy(*above).orderBy(f"_o{k}").rowsBetween(Window.unboundedPreceding, -1)
        here = level[k].withColumn(f"_s{k}", F.coalesce(F.sum(f"_v{k}").over(before), F.lit(0)))
        got = here if got is None else here.join(got.drop(f"_v{k + 1}", *([] if k else ["_o2"])), [c for c in above if k or c != "_o2"])
    return got.select(*keys, F.col("_o0").alias(order), (F.col("_s0") + F.col("_s1") + F.col("_s2")).alias(out))


def spread(df: DataFrame, many: str, out: str) -> DataFrame:
    """Each row `many` times (0 and more), numbered from 0; a large number is dealt over tasks before it is written out."""
    parts = df.withColumn("_at", F.explode(F.expr(f"if({many} > 0, sequence(0L, {many} - 1, {SPREAD}L), array())")))
    parts = parts.repartition(*[c for c in df.columns], "_at")
    return parts.withColumn(out, F.explode(F.expr(f"sequence(_at, least(_at + {SPREAD}, {many}) - 1)"))).drop("_at")
