"""Operators over ordered rows: neighbours, runs and islands, as window expressions.

All are keyed: rows are dealt by key, and one key's rows are sorted in one task (spilling to disk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]

#: Rows of a part of a table: what a task sorts does not grow with the table.
PART_ROWS = 250_000


def parts(df: DataFrame) -> int:
    """How many parts of PART_ROWS rows a table has. The rows are counted at once, so df should be a stored table."""
    return 1 + df.count() // PART_ROWS


def dedupe_first(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """Of the rows with equal keys, the first by order. Null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def drop_adjacent_duplicates(df: DataFrame, keys: Keys, order: Keys, value: str, marked: Column) -> DataFrame:
    """Without the marked rows whose value equals that of an unmarked row next to them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = F.when(~marked, F.col(value))
    same = lambda x: F.coalesce(x == F.col(value), F.lit(False))
    out = df.withColumn("__p", F.lag(plain).over(w)).withColumn("__q", F.lead(plain).over(w)).withColumn("__m", marked)
    return out.where(~F.col("__m") | ~(same(F.col("__p")) | same(F.col("__q")))).drop("__p", "__q", "__m")


def swap_overlaps(df: DataFrame, keys: Keys, order: Keys, start: str, end: str, most: float) -> DataFrame:
    """Where a row ends after the next one's start by no more than `most`, these two times are exchanged."""
    w = Window.partitionBy(*keys).orderBy(*order)
    nxt, prv = F.lead(start).over(w), F.lag(end).over(w)
    fits = lambda e, s: (e - s > 0) & (e - s <= most)
    out = df.withColumn("__s", nxt).withColumn("__e", prv)
    new_end = F.when(fits(F.col(end), F.col("__s")), F.col("__s")).otherwise(F.col(end))
    new_start = F.when(fits(F.col("__e"), F.col(start)), F.col("__e")).otherwise(F.col(start))
    return out.withColumn("__x", new_end).withColumn("__y", new_start).withColumn(end, F.col("__x")).withColumn(start, F.col("__y")).drop("__s", "__e", "__x", "__y")


def islands(df: DataFrame, keys: Keys, order: Keys, breaks: Column, name: str = "island") -> DataFrame:
    """df with the number (from 0) of the run each row is in; `breaks` may use lag over the same order, true at a new run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__b", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def before(column: str, keys: Keys, order: Keys) -> Column:
    """The value of the row before."""
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def contiguous_runs(df: DataFrame, keys: Keys, at: str, gap: float) -> DataFrame:
    """Keys, first and last position and number of rows of each run without a step of more than gap."""
    out = islands(df, keys, [at], F.col(at) - before(at, keys, [at]) > gap)
    return out.groupBy(*keys, "island").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count("*").alias("n_rows")).drop("island")


def merge_adjacent_equal(df: DataFrame, keys: Keys, start: str, end: str, value: str, gap: float) -> DataFrame:
    """Runs of equal values that follow each other within gap; the end is the last row's, not the largest."""
    order = [start, end]
    new = (F.col(value) != before(value, keys, order)) | (F.abs(F.col(start) - before(end, keys, order)) >= gap)
    out = islands(df, keys, order, new)
    last = F.max_by(end, F.struct(start, end))
    return out.groupBy(*keys, "island").agg(F.first(value).alias(value), F.min(start).alias("run_start"), last.alias("run_end"), F.count("*").alias("n_rows")).drop("island")


def changes_only(df: DataFrame, keys: Keys, order: Keys, value: str) -> DataFrame:
    """The rows whose value differs from that of the row before."""
    return df.withColumn("__p", before(value, keys, order)).where(~F.col(value).eqNullSafe(F.col("__p")) | F.col("__p").isNull()).drop("__p")


def mean_gap(df: DataFrame, keys: Keys, at: str, last: int = 8, name: str = "mean_gap") -> DataFrame:
    """df with the mean of the last `last` steps (fewer at the beginning; null for a first row)."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-last, 0)
    n = F.count(at).over(w) - 1
    return df.withColumn(name, F.when(n > 0, (F.col(at) - F.min(at).over(w)) / n))


def sliding_rate(df: DataFrame, keys: Keys, at: str, value: str, width: float, name: str = "rate") -> DataFrame:
    """df with the change of value a unit of time over the last `width`; null where there is no time between."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-width, 0)
    span = F.col(at) - F.min(at).over(w)
    return df.withColumn(name, F.when(span > 0, (F.col(value) - F.first(value).over(w)) / span))


def line_persistence(df: DataFrame, keys: Keys, place: str, line: str) -> DataFrame:
    """Spans of consecutive places (a dense number) over which a line stays; a line counts once a place."""
    once = df.select(*keys, place, line).distinct()
    w = Window.partitionBy(*keys, line).orderBy(place)
    out = once.withColumn("__i", F.col(place) - F.row_number().over(w))
    return out.groupBy(*keys, line, "__i").agg(F.min(place).alias("first_place"), F.max(place).alias("last_place")).drop("__i")


def local_maxima(df: DataFrame, keys: Keys, bin_: str, count: str, reach: int, least: int) -> DataFrame:
    """Bins of at least `least` whose count no bin within reach exceeds."""
    w = Window.partitionBy(*keys).orderBy(bin_).rangeBetween(-reach, reach)
    return df.withColumn("__m", F.max(count).over(w)).where((F.col(count) >= least) & (F.col(count) == F.col("__m"))).drop("__m")


def top_per_bucket(df: DataFrame, keys: Keys, value: str, tie: str, k: int) -> DataFrame:
    """The k largest values of each bucket, ties by the smaller `tie`. Spark limits each task's groups first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def within_budget(df: DataFrame, keys: Keys, order: list, size: str, budget: float) -> DataFrame:
    """The newest rows (by order) while their sizes add up to no more than the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def unbroken_suffix(df: DataFrame, keys: Keys, at: str, ok: Column) -> DataFrame:
    """Keys and the lowest position from which on all positions up to the highest are ok; no row without one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.min(ok.cast("int")).over(w)).where("__ok = 1").groupBy(*keys).agg(F.min(at).alias("floor_at"))


def widest_run(df: DataFrame, keys: Keys, at: str) -> DataFrame:
    """The longest run of consecutive whole positions of each key; the higher one of equally long."""
    out = df.select(*keys, at).distinct().withColumn("__i", F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    runs = out.groupBy(*keys, "__i").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"))
    runs = runs.withColumn("__k", F.struct(F.col("run_end") - F.col("run_start"), "run_start"))
    return runs.groupBy(*keys).agg(F.max_by("run_start", "__k").alias("run_start"), F.max_by("run_end", "__k").alias("run_end"))


def padded_runs(runs: DataFrame, start: str, end: str, least: int, before: int, behind: int) -> DataFrame:
    """Runs of at least that length with pads on both sides, the start not below 0, and their length without them."""
    size = F.col(end) - F.col(start)
    out = runs.withColumn("length", size).where(F.col("length") >= least)
    return out.withColumn(start, F.greatest(F.col(start) - before, F.lit(0))).withColumn(end, F.col(end) + behind)


def placed(df: DataFrame, keys: Keys, order: Keys, count: int) -> DataFrame:
    """df with each row's place (__i, from 0) in its key's order and the key's number of rows (__n), for a few keys
    with many rows: sorted in `count` parts over all tasks, written, and numbered by the rows of the parts before."""
    from tessera.functions.shared import fresh_dir

    spark, by = df.sparkSession, [F.asc(k) for k in keys] + [F.asc_nulls_last(c) for c in order]
    row = F.monotonically_increasing_id()  # the part, and from bit 33 down the place in it
    dealt = df.repartitionByRange(count, *by).sortWithinPartitions(*by).withColumn("__r", row)
    path = fresh_dir(spark, "placed")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path).withColumn("__p", F.shiftright("__r", 33))
    held = rows.groupBy(*keys, "__p").agg(F.count("*").alias("__c"), F.min("__r").alias("__first"))
    all_ = Window.partitionBy(*keys)
    before = F.sum("__c").over(all_.orderBy("__p")) - F.col("__c") - F.col("__first")
    starts = held.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__p").alias("__q"), before.alias("__before"), F.sum("__c").over(all_).alias("__n"))
    same = F.col("__p") == F.col("__q")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    out = rows.join(F.broadcast(starts), same)  # bounded: no more rows than parts and keys together
    return out.withColumn("__i", F.col("__r") + F.col("__before")).select(*df.columns, "__i", "__n")
