"""Operators over spans of time: union, complement, overlap, as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds

Keys = Sequence[str]


def union_spans(df: DataFrame, keys: Keys, start: str = "start", end: str = "end") -> DataFrame:
    """The union of each key's spans; spans that touch become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("__n", F.coalesce(F.col(start) > reach, F.lit(False)).cast("int"))
    out = out.withColumn("__i", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("__i")


def gaps(df: DataFrame, keys: Keys, least: float, start: str = "start", end: str = "end") -> DataFrame:
    """What lies between each key's united spans, if it is at least that long."""
    united = union_spans(df, keys, start, end)
    w = Window.partitionBy(*keys).orderBy(start)
    out = united.select(*keys, F.lag(end).over(w).alias("gap_start"), F.col(start).alias("gap_end"))
    return out.where(F.col("gap_end") - F.col("gap_start") >= least)


def clock(seconds: Column) -> Column:
    """MM:SS of whole seconds, hours as minutes."""
    whole = F.floor(seconds).cast("bigint")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat_ws(":", F.when(F.length(minutes) < 2, F.concat(F.lit("0"), minutes)).otherwise(minutes), F.lpad((whole % 60).cast("string"), 2, "0"))


def keep_ranges(skips: DataFrame, keys: Keys, duration: str, least: float = 5, start: str = "start", end: str = "end") -> DataFrame:
    """What is left of each key when its skipped spans are united: keys, keep_start, keep_end, from_text, to_text.

    Also what lies before the first span and, where the duration is known (above 0), behind the last. Only
    ranges of `least` and more. A range that begins with the file has no from_text, one that ends with it
    no keep_end and no to_text. Keys without skipped spans, or without a range, are absent.
    """
    united = union_spans(skips, keys, start, end)
    before = F.coalesce(F.lag(end).over(Window.partitionBy(*keys).orderBy(start)), F.lit(0)).cast("double")
    inner = united.select(*keys, before.alias("keep_start"), F.col(start).cast("double").alias("keep_end"))
    inner = inner.where(F.col("keep_end") - F.col("keep_start") >= least)
    tail = skips.groupBy(*keys).agg(F.max(end).cast("double").alias("keep_start"), F.max(duration).alias("__d"))
    tail = tail.where((F.col("__d") > 0) & (F.col("__d") - F.col("keep_start") >= least))
    out = inner.unionByName(tail.select(*keys, "keep_start", F.lit(None).cast("double").alias("keep_end")))
    return out.select("*", F.when(F.col("keep_start") > 0, clock(F.col("keep_start"))).alias("from_text"), F.when(F.col("keep_end").isNotNull(), clock(F.col("keep_end"))).alias("to_text"))


def bridged(skips: DataFrame, group: Keys, file: str, reach: float = 10, most: float = 30, share: float = 0.5, start: str = "start", end: str = "end") -> DataFrame:
    """Each file's united spans, with the gaps closed that recur at one place in enough files of its group.

    A gap of up to `most` belongs by its middle to a cluster: it joins the open one while it lies within
    `reach` of that one's first middle and its file is not in it yet. A cluster counts with two files and
    with that share of the group's files (rounded down).
    """
    keys = [*group, file]
    united = union_spans(skips, keys, start, end).drop("n_spans")
    by = Window.partitionBy(*keys).orderBy(start)
    united = united.withColumn("__next", F.lead(start).over(by))
    gaps_ = united.where(F.col("__next") - F.col(end) <= most).select(*keys, F.col(end).cast("double").alias("at"), ((F.col(end) + F.col("__next")) / 2).cast("double").alias("middle"))
    types = {f.name: f.dataType.simpleString() for f in gaps_.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*group, file, "at"]) + ", cluster int"
    marked = folds.run(gaps_, group, ["middle", file, "at"], folds.gap_clusters(reach, file), schema)
    files = united.groupBy(*group).agg(F.greatest(F.lit(2), F.floor(F.count_distinct(file) * share)).alias("__least"))
    often = marked.groupBy(*group, "cluster").agg(F.count("*").alias("__n")).join(files, [*group]).where("__n >= __least").select(*group, "cluster")
    closed = marked.join(often, [*group, "cluster"]).select(*keys, F.col("at").alias("__at"), F.lit(1).alias("__closed"))
    rows = united.withColumn("__at", F.col(end).cast("double")).join(closed, [*keys, "__at"], "left")
    rows = rows.withColumn("__new", F.coalesce(F.lag("__closed").over(by), F.lit(0)) == 0)
    rows = rows.withColumn("__i", F.sum(F.col("__new").cast("int")).over(by))
    return rows.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_blocks")).drop("__i")


def overlap_join(a: DataFrame, b: DataFrame, keys: Keys, width: float, least: float = 0, start: str = "start", end: str = "end", id_: str | None = None) -> DataFrame:
    """The common parts of a's and b's spans of equal keys that are longer than (least > 0: at least as long as) least.

    Both sides are cut into time buckets of `width`, so that a key with many spans is spread over many
    tasks and no pair is looked at but those that share a bucket; a pair counts in the bucket in which
    its common part begins. id_: a column of both that comes out as a_id and b_id.
    """

    def bucketed(df: DataFrame, s: str, e: str, named: str) -> DataFrame:
        buckets = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
        own = [F.col(id_).alias(named)] if id_ else []
        return df.where(F.col(end) >= F.col(start)).select(*keys, F.col(start).alias(s), F.col(end).alias(e), *own, F.explode(buckets).alias("__b"))

    lo, hi = F.greatest("__s1", "__s2"), F.least("__e1", "__e2")
    long_enough = hi - lo >= least if least > 0 else hi > lo
    out = bucketed(a, "__s1", "__e1", "a_id").join(bucketed(b, "__s2", "__e2", "b_id"), [*keys, "__b"]).where(long_enough & (F.floor(lo / width) == F.col("__b")))
    return out.select(*keys, lo.alias(start), hi.alias(end), F.col("__s1").alias("a_start"), F.col("__s2").alias("b_start"), *(["a_id", "b_id"] if id_ else []))


def last_at_or_before(asked: DataFrame, known: DataFrame, keys: Keys, at: str, value: str, id_: str) -> DataFrame:
    """As-of join: for each asked row the value of the last known row at or before it, by one sort of both sides.

    asked has keys, id_ and at; known has keys, at, value. Equal times of known rows: the largest value.
    """
    both = asked.select(*keys, at, F.lit(None).cast(known.schema[value].dataType).alias("__v"), F.col(id_).alias("__id"), F.lit(1).alias("__q")).unionByName(
        known.select(*keys, at, F.col(value).alias("__v"), F.lit(None).cast(asked.schema[id_].dataType).alias("__id"), F.lit(0).alias("__q"))
    )
    w = Window.partitionBy(*keys).orderBy(at, "__q", "__v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__l", F.last("__v", ignorenulls=True).over(w)).where("__q = 1")
    return out.select(*keys, F.col("__id").alias(id_), at, F.col("__l").alias(value))


def first_at_or_after(asked: DataFrame, known: DataFrame, keys: Keys, at: str, value: str, id_: str) -> DataFrame:
    """For each asked row the value of the first known row at or after it; of equal times the smallest value."""
    both = asked.select(*keys, at, F.lit(None).cast(known.schema[value].dataType).alias("__v"), F.col(id_).alias("__id"), F.lit(1).alias("__q")).unionByName(
        known.select(*keys, at, F.col(value).alias("__v"), F.lit(None).cast(asked.schema[id_].dataType).alias("__id"), F.lit(0).alias("__q"))
    )
    w = Window.partitionBy(*keys).orderBy(F.desc(at), "__q", F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__l", F.last("__v", ignorenulls=True).over(w)).where("__q = 1")
    return out.select(*keys, F.col("__id").alias(id_), at, F.col("__l").alias(value))


def kept_total(df: DataFrame, keys: Keys, start: str = "start", end: str = "end") -> DataFrame:
    """The summed length of each key's spans; spans that end before they start count nothing."""
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0))).alias("kept"))


def kept_before(df: DataFrame, keys: Keys, at: Column, start: str = "start", end: str = "end") -> DataFrame:
    """How much of each key's spans lies before a time."""
    part = F.greatest(F.least(F.col(end), at) - F.col(start), F.lit(0))
    return df.groupBy(*keys).agg(F.sum(part).alias("kept_before"))
