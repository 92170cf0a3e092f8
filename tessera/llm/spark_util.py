"""Staging tables in the shared folder, connected components, and small helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import shared_dir

#: A staged table needs none of the shuffle files it came from: they go when it is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Arrow batches of whole texts stay small: fewer rows and bytes than the defaults, where those are what is set."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return spark


#: The folders that this driver made and has not deleted.
_MADE: list[Stage] = []


class Stage:
    """Tables written to the shared folder and read back: cuts lineage, survives lost executors.

    Each operator call has its own folder, so concurrent calls do not meet. An operator drops the tables
    that nothing reads any more; those its result reads stay until drop_since() is told that the result
    is written. Arrow batches are set small for the session (small_batches), since results run later.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = small_batches(spark)
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: dict[str, int] = {}
        _MADE.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        n = self.made[name] = self.made.get(name, -1) + 1
        path = f"{self.base}/{name}-{n}"
        was = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names written so far (none of them may be read again)."""
        for name in names:
            for n in range(self.made.get(name, -1) + 1):
                self._delete(f"{self.base}/{name}-{n}")

    def drop_all(self) -> None:
        """Delete the folder of this call."""
        self._delete(self.base)


def stages_made() -> int:
    """A mark for drop_since()."""
    return len(_MADE)


def drop_since(mark: int, but: Stage | None = None) -> None:
    """Delete the staged tables of all calls since the mark: their results are written or no longer wanted."""
    for stage in _MADE[mark:]:
        if stage is not but:
            stage.drop_all()
    _MADE[mark:] = [s for s in _MADE[mark:] if s is but]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, by: str, stage: Stage, most: int = 512) -> DataFrame:
    """rows with the columns of `groups`, which has one row for each key; keys of more than `most` rows are dealt by `by`.

    Few keys are so large, so that marking their rows needs no shuffle, or one whose large keys the planner splits.
    """
    often = stage.save(rows.groupBy(key).agg(F.count("*").alias("many")).where(F.col("many") > most), f"often-{key}")
    parts = F.coalesce(F.ceil(F.col("many") / most), F.lit(1)).cast("int")
    a = rows.join(often, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("many")
    b = groups.join(often, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("many")
    return a.join(b, [key, "part"]).drop("part")


#: Edges that one task of a contraction holds on average.
TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of this task's edges (u, v) with the smallest node it reaches by them, but for itself."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    root = np.array(up)
    while (root[root] != root).any():
        root = root[root]
    own = np.flatnonzero(root != np.arange(len(root)))
    for k in range(0, len(own), 100_000):
        part = own[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], ["u", "v"])


def connected_components(edges: DataFrame, stage: Stage, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, comp) for every node of an edge, comp being the smallest node reachable.

    Each round contracts the edges of each task to a forest of stars, then, while they are more than one
    task's worth, brings stars together by large-star and small-star steps (map-side-combined minima and
    a join each), until the edge set no longer changes. No task holds more than about TASK_EDGES edges.
    Null ends and loops are ignored; no edges give no rows.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e, seen = stage.save(e, name), None
    while True:
        now = mark(e)
        tasks = -(-now[0] // TASK_EDGES)
        if now == seen or not now[0]:
            break
        seen = now
        e = (e.coalesce(tasks) if tasks == 1 else e.repartition(tasks)).mapInArrow(_forest, "u long, v long")
        if tasks == 1:
            e = stage.save(e, name)
            break
        both = stage.save(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{name}-both")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
