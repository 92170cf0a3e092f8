"""Groups of overlapping rows: smallest reachable id over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import ensure_checkpoint_dir


def components(edges: DataFrame, a: str, b: str, rounds: int = 64) -> DataFrame:
    """(node, comp) of all nodes of the edges, by label propagation with shortcuts; lineage cut each round.

    Rounds grow with the logarithm of the longest path. Raises if `rounds` did not suffice.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct().checkpoint()
    label = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("l")).select("u", "l")
    for _ in range(rounds):
        label = label.checkpoint()
        near = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        step = label.join(near, "u", "left").select("u", F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("j"))
        new = step.join(jump, "l", "left").select("u", F.least("l", F.coalesce("j", "l")).alias("l")).checkpoint()
        if not new.join(label.withColumnRenamed("l", "o"), "u").where("l <> o").take(1):
            return new.select(F.col("u").alias("node"), F.col("l").alias("comp"))
        label = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
