"""Dialogue text files: lines of ten comma fields, the last of which keeps its commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import clock, text

# Fixed values of the format: its fields in order.
FIELDS = ("layer", "start", "end", "style", "name", "margin_l", "margin_r", "margin_v", "effect", "text")
HEADER = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def rendered(start_cs: str, end_cs: str, style: str, body: str) -> Column:
    """One dialogue line."""
    fields = [F.lit("Dialogue: 0"), clock.code_of_centis(start_cs), clock.code_of_centis(end_cs), F.col(style), F.lit(""), F.lit("0"), F.lit("0"), F.lit("0"), F.lit(""), text.escape_breaks(body)]
    return F.concat_ws(",", *fields)


def parsed(line: Column | str) -> Column:
    """The fields of a dialogue line with its times in centiseconds (null where they cannot be read); null with fewer than ten."""
    c = F.col(line) if isinstance(line, str) else line
    parts = F.split(F.regexp_replace(c, r"^Dialogue:\s*", ""), ",", 10)
    get = lambda k: F.get(parts, F.lit(k))
    fields = [(F.trim(get(k)) if k < 9 else get(k)).alias(n) for k, n in enumerate(FIELDS)]
    times = [clock.centis_of_code(F.trim(get(1))).alias("start_cs"), clock.centis_of_code(F.trim(get(2))).alias("end_cs")]
    return F.when(c.startswith("Dialogue:") & (F.size(parts) == 10), F.struct(*fields, *times))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, section, line) of each line of the files under path; a mark of byte order is dropped.

    A file is one value, so a file must fit in a task; the number of files is free.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    w = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").rlike(r"^\[[^\]]+\]\s*$"), F.regexp_extract("line", r"^\[([^\]]+)\]", 1))
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(w))


def events(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, fields...) of the dialogue lines."""
    rows = read(spark, path).withColumn("p", parsed("line"))
    return rows.where(F.col("p").isNotNull()).select("path", "ord", "p.*", text.visible_text(F.col("p.text")).alias("shown"))


def write(df: DataFrame, path: str, document: str = "document", order: str = "start_cs", line: str = "line") -> None:
    """One text file a document, its lines by order after the header: each file lies in a folder document=..."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"])
    out = df.groupBy(document).agg(F.concat_ws("\n", F.lit(HEADER), F.array_join(lines, "\n")).alias("value"))
    out.write.partitionBy(document).text(path)


def merged(lines: DataFrame, keys: list[str], document: str = "document", order: str = "ord", line: str = "line") -> DataFrame:
    """(keys, place, line): the documents of each key as one: what is no dialogue in the first of them, then all
    dialogue lines by start, ties by document and place. A single document stays as it is.

    A dialogue line whose start cannot be read counts as starting at 0.
    """
    whole = Window.partitionBy(*keys)
    rows = lines.withColumn("__first", F.min(document).over(whole)).withColumn("__one", F.col("__first") == F.max(document).over(whole))
    shown = F.trim(F.col(line))
    said = shown.startswith("Dialogue:")
    start = F.coalesce(clock.centis_of_code(F.trim(F.get(F.split(shown, ",", 3), F.lit(1)))), F.lit(0)).cast("bigint")
    rows = rows.where(F.col("__one") | said | (F.col(document) == F.col("__first")))
    moved = ~F.col("__one") & said
    rows = rows.withColumn("__k", F.when(moved, 1).otherwise(0)).withColumn("__s", F.when(moved, start).otherwise(F.lit(0).cast("bigint")))
    place = F.row_number().over(whole.orderBy("__k", "__s", document, order)) - 1
    return rows.select(*keys, place.alias("place"), F.when(moved, shown).otherwise(F.col(line)).alias("line"))
