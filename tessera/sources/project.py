"""Project documents: nested JSON with a version, tolerant reading, migration of the first version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "version string, files map<string,struct<crop:struct<x:string,y:string,width:string,height:string>,brightness:string,"
    "time_ranges:array<struct<start:string,end:string>>,resolution:struct<width:string,height:string>,duration:string,review:string,skipped:string>>,"
    "global struct<brightness:string,time_range:struct<start:string,end:string>>, _corrupt string"
)
VERSIONS = (1, 2)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc, status) of the JSON files under path: ok, corrupt, or unknown (a version we must not overwrite)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parsed(files)


def parsed(files: DataFrame) -> DataFrame:
    """The same of a table (path, value)."""
    doc = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = files.select("path", doc.alias("doc"))
    version = F.col("doc.version").try_cast("int")
    bad = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    known = version.isin(*VERSIONS) | F.col("doc.version").isNull()
    return out.withColumn("status", F.when(bad, "corrupt").when(known, "ok").otherwise("unknown"))


def whole(c: Column) -> Column:
    """A whole number from text, through a decimal one (cut towards zero); null for anything else."""
    return c.try_cast("double").cast("int")


def truth(c: Column) -> Column:
    """true, 1 and yes in any case; false for other texts; null stays."""
    return F.lower(F.trim(c)).isin("true", "1", "yes")


def file_rows(docs: DataFrame) -> DataFrame:
    """One row a file of each readable document, with its own setting, else the global one, else null."""
    rows = docs.where("status = 'ok'").select("path", F.col("doc.global").alias("g"), F.explode("doc.files").alias("name", "f"))
    ranges = F.when(F.col("f.time_ranges").isNotNull(), F.col("f.time_ranges")).when(F.col("g.time_range").isNotNull(), F.array("g.time_range"))
    crop = F.struct(*[whole(F.col(f"f.crop.{k}")).alias(k) for k in ("x", "y", "width", "height")])
    return rows.select(
        "path",
        "name",
        F.when(F.col("f.crop").isNotNull(), crop).alias("crop"),
        F.coalesce(whole(F.col("f.brightness")), whole(F.col("g.brightness"))).alias("brightness"),
        ranges.alias("time_ranges"),
        F.coalesce(whole(F.col("f.resolution.width")), F.lit(0)).alias("width"),
        F.coalesce(F.col("f.duration").try_cast("double"), F.lit(0.0)).alias("duration"),
        F.coalesce(F.col("f.review"), F.lit("pending")).alias("review"),
        F.coalesce(truth(F.col("f.skipped")), F.lit(False)).alias("skipped"),
    )


def write(rows: DataFrame, path: str) -> None:
    """One JSON line a file; the committer renames when a task is done, so readers see whole files only."""
    rows.write.json(path)


def videos(paths: DataFrame, column: str = "path") -> DataFrame:
    """The rows whose path ends in a video's extension, in any case."""
    return paths.where(F.col(column).rlike(r"(?i)\.(mkv|mp4)$"))
