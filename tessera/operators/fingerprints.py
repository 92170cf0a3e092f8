"""Matching ordered sequences by packed or hashed fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.clock import packed

#: Of hashes, where rows are counted before they are told apart.
BUCKETS = 1 << 20


def shingles(df: DataFrame, id_: str, text: str, width: int, shown: bool = False) -> DataFrame:
    """(id, pos, hash) of each run of `width` words of other than white space (space, tab, line breaks).

    hash is a 64-bit number, or, where it is to be shown, the md5.
    """
    words = F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    # each word is written out beside the next ones, so that hashing is compiled code, without a text for each run
    beside = [F.slice("__w", k + 1, 1 << 30).alias(f"w{k}") for k in range(width)]
    rows = df.select(id_, words.alias("__w")).select(id_, F.posexplode(F.arrays_zip(*beside)).alias("__p", "__r"))
    run = [F.col(f"__r.w{k}") for k in range(width)]
    digest = F.md5(F.concat_ws(" ", *run).cast("binary")) if shown else F.xxhash64(*run)
    return rows.where(run[-1].isNotNull() & (run[0] != "")).select(id_, F.col("__p").cast("bigint").alias("pos"), digest.alias("hash"))


def offset_pairs(index: DataFrame, asked: DataFrame) -> DataFrame:
    """All pairs of equal hash, with the step between their places. Skewed hashes are split by the adaptive planner."""
    a = index.select("hash", *[F.col(c).alias(f"i_{c}") for c in index.columns if c != "hash"])
    b = asked.select("hash", *[F.col(c).alias(f"q_{c}") for c in asked.columns if c != "hash"])
    return a.join(b, "hash").withColumn("delta", F.col("q_pos") - F.col("i_pos"))


def offset_histogram(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys, "delta").agg(F.count("*").alias("n"))


def stop_hashes(df: DataFrame, id_: str, ratio: float) -> DataFrame:
    """Hashes that more than that part of the ids hold, and how many hold them.

    A hash of more ids has more rows, too, and so has the bucket of hashes it falls in: only rows of buckets
    with rows enough are counted by hash and id. A bucket's mean share of the ids is the mean number of an id's
    rows over BUCKETS, whatever the size of df, so what is shuffled is mostly rows of the hashes looked for.
    df is computed three times and should be cheap to make.
    """
    total = df.agg(F.count_distinct(id_).alias("__t"))
    bucket = F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int")
    often = df.groupBy(bucket.alias("__b")).agg(F.count("*").alias("__n")).join(F.broadcast(total), F.col("__n") > F.floor(F.col("__t") * ratio))
    # bounded: no more rows than BUCKETS
    held = df.withColumn("__b", bucket).join(F.broadcast(often.select("__b", "__t")), "__b").select("hash", id_, "__t").distinct()
    return held.groupBy("hash").agg(F.count("*").alias("df"), F.first("__t").alias("__t")).where(F.col("df") > F.floor(F.col("__t") * ratio)).select("hash", "df")


def containment(index: DataFrame, asked: DataFrame, i_id: str, q_id: str, least: float) -> DataFrame:
    """Which part of an asked id's distinct hashes an index id holds, where it is at least `least`.

    The index meets the asked hashes before it is made distinct, so only what matches is shuffled.
    """
    b = asked.select(q_id, "hash").distinct()
    total = b.groupBy(q_id).agg(F.count("*").alias("total"))
    common = index.select(i_id, "hash").join(b, "hash").distinct().groupBy(i_id, q_id).agg(F.count("*").alias("matched"))
    return common.join(total, q_id).where(F.col("matched") >= F.col("total") * least)


def fanout_pairs(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: Column, lo: int, hi: int, most: int) -> DataFrame:
    """Each row with the next `most` rows lo to hi later, and the two values and the step packed in one number."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(lo, hi)
    after = F.collect_list(F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), value.alias("v"))).over(w)
    out = df.withColumn("__v", value).withColumn("__c", after).withColumn("__n", F.explode(F.slice(F.array_sort("__c"), 1, most)))
    step = F.col("__n.a") - F.col(at)
    return out.select(*keys, F.col(tie).alias("left_id"), F.col("__n.t").alias("right_id"), step.alias("step"), packed(F.col("__v"), F.col("__n.v"), step).alias("code"))


def best_run(runs: DataFrame, length: Column, ties: list) -> DataFrame:
    """The longest run of all, ties by the order given."""
    return runs.withColumn("length", length).orderBy(F.desc("length"), *ties).limit(1)
