"""Aggregations: medians, votes, bounds, envelopes, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import supports

Keys = Sequence[str]


def lower_median(df: DataFrame, keys: Keys, value: str, least: int = 3) -> DataFrame:
    """The lower of the middle values (always one that is there); null for fewer than `least` values."""
    n = F.count(value)
    mid = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*keys).agg(F.when(n >= least, mid).alias("median"))


def percentile_band(df: DataFrame, keys: Keys, value: str, parts: Sequence[float]) -> DataFrame:
    """Exact percentiles, linearly interpolated."""
    return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in parts])


def consistent_with_median(df: DataFrame, keys: Keys, value: str, ratio: float) -> DataFrame:
    """df with the median of its group and whether the value is within the ratio of it, both ways."""
    mid = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("consensus"))
    ok = (F.col(value) <= F.col("consensus") * ratio) & (F.col("consensus") <= F.col(value) * ratio)
    return df.join(mid, list(keys)).withColumn("consistent", ok)


def plateau_intersection(df: DataFrame, keys: Keys, lo: str, hi: str) -> DataFrame:
    """The common part of a group's ranges; null if one is null or they have none."""
    a, b = F.max(lo), F.min(hi)
    fits = ~F.bool_or(F.col(lo).isNull() | F.col(hi).isNull()) & (a <= b)
    return df.groupBy(*keys).agg(F.when(fits, a).alias("lo"), F.when(fits, b).alias("hi"))


def steady_share(df: DataFrame, keys: Keys, order: str, value: str, tolerance: float, span: str, least: float) -> DataFrame:
    """Whether a group's values all lie within the tolerance of its first and its span is long enough: yes, no or unknown."""
    first = F.min_by(value, order)
    out = df.groupBy(*keys).agg(first.alias("__f"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), (F.max(span) - F.min(span)).alias("__s"), F.count("*").alias("n"))
    steady = (F.col("__hi") - F.col("__f") <= tolerance) & (F.col("__f") - F.col("__lo") <= tolerance)
    return out.select(*keys, "n", F.when(~steady, "no").when(F.col("__s") >= least, "yes").otherwise("unknown").alias("status"))


def modal(df: DataFrame, keys: Keys, value: str, weight: str, order: str) -> DataFrame:
    """The commonest value of each group; ties by the larger weight sum, then by the first to appear."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.sum(weight).alias("__w"), F.min(order).alias("__o"))
    best = F.struct("votes", "__w", -F.col("__o"))
    return votes.groupBy(*keys).agg(F.max_by(value, best).alias(value), F.max("votes").alias("votes"))


def modal_reading(df: DataFrame, keys: Keys, text: str, confidence: str, place: str, least: int = 3) -> DataFrame:
    """Each group's reading with the most support, where its readable places form one band.

    A row supports a text if the two are near readings. Ties: more exact repeats, the higher mean
    confidence, the lower first place. No row for a group whose best has less than `least` support, whose
    readable places (0, 1, ...) have more than one hole, or one of two places and more. Empty and null
    texts are unreadable.
    """
    rows = df.where(F.col(text) != "")
    votes = rows.groupBy(*keys, text).agg(F.count("*").alias("exact"), F.avg(confidence).alias("mean"), F.min(place).alias("__o"))
    others = votes.select(*keys, F.col(text).alias("__t"), F.col("exact").alias("__n"))
    support = votes.join(others, [*keys]).where(supports(F.col(text), F.col("__t"))).groupBy(*keys, text, "exact", "mean", "__o").agg(F.sum("__n").alias("support"))
    best = F.struct("support", "exact", "mean", -F.col("__o"))
    chosen = support.groupBy(*keys).agg(F.max_by(text, best).alias(text), F.max("support").alias("support")).where(F.col("support") >= least)
    step = F.col(place) - F.lag(place).over(Window.partitionBy(*keys).orderBy(place))
    bands = rows.select(*keys, step.alias("__s")).groupBy(*keys).agg(F.count_if(F.col("__s") > 1).alias("__h"), F.max("__s").alias("__m"))
    bands = bands.where((F.col("__h") <= 1) & (F.coalesce("__m", F.lit(1)) <= 2))
    return chosen.join(bands.select(*keys), [*keys], "left_semi")


def reading_confidence(df: DataFrame, keys: Keys, text: str, confidence: str) -> DataFrame:
    """The mean confidence of each group's words; 100 where all texts are empty, 0 where no confidence is known."""
    out = df.groupBy(*keys).agg(F.avg(F.when(F.col(text) != "", F.col(confidence))).alias("__m"), F.count_if(F.col(text) != "").alias("__n"))
    return out.select(*keys, F.when(F.col("__n") == 0, 100.0).otherwise(F.coalesce("__m", F.lit(0.0))).alias("confidence"))


def surest(df: DataFrame, keys: Keys, text: str, confidence: str, order: str) -> DataFrame:
    """Each group's text of the largest confidence; the first on ties."""
    return df.groupBy(*keys).agg(F.max_by(text, F.struct(confidence, -F.col(order))).alias(text))


def best_reading(df: DataFrame, keys: Keys, text: str, confidence: str, order: str) -> DataFrame:
    """The longest text of each group, then the surest, then the first; and the first and last place of the whole group."""
    best = F.struct(F.length(text), F.col(confidence), -F.col(order))
    return df.groupBy(*keys).agg(F.max_by(text, best).alias(text), F.max_by(order, best).alias("chosen"), F.min(order).alias("first_place"), F.max(order).alias("last_place"))


def envelope(df: DataFrame, keys: Keys, place: str, n: str, value: str, bins: int) -> DataFrame:
    """Mean square of equal stretches of each group's rows (place from 0, n rows; the last takes the rest)."""
    size = F.floor(F.col(n) / bins)
    bin_ = F.when(size == 0, F.lit(bins - 1)).otherwise(F.least(F.floor(F.col(place) / size), F.lit(bins - 1)))
    return df.groupBy(*keys, bin_.cast("bigint").alias("bin")).agg(F.sum(F.col(value) * F.col(value)).alias("square_sum"), F.count("*").alias("n_values"))


def threshold_curve(df: DataFrame, keys: Keys, thresholds: Sequence[int], fires: Column, name: str = "t") -> DataFrame:
    """Rows of each group that fire at each threshold; `fires` may use the threshold's column. One pass, no self-join."""
    wide = df.withColumn(name, F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return wide.groupBy(*keys, name).agg(F.count_if(fires).alias("fired"), F.count("*").alias("n"))


def extremes(df: DataFrame, keys: Keys, measures: dict[str, tuple[str, str]], time: str) -> DataFrame:
    """One row per group and kind: the time of the smallest or largest value of a column, ties by the earliest."""
    out = []
    for kind, (how, column) in measures.items():
        key = F.struct(F.col(column) if how == "min" else -F.col(column), F.col(time))
        out.append(F.struct(F.lit(kind).alias("kind"), F.min_by(time, key).alias("at")))
    return df.groupBy(*keys).agg(F.array(*out).alias("__a")).select(*keys, F.inline("__a"))


def median_row(df: DataFrame, keys: Keys, value: str, tie: str) -> DataFrame:
    """The row in the (upper) middle of each group."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__r", F.row_number().over(w)).withColumn("__n", n).where("__r = floor(__n / 2) + 1").drop("__r", "__n")


def digest(df: DataFrame, keys: Keys, line: str, order: str) -> DataFrame:
    """SHA-256 over a group's lines in order, one a line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"])
    return df.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"))
