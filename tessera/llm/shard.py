"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly, by seeded hashes of the record, into buckets that fit in memory
and, inside a bucket, into cells of a few records. Pass two brings each bucket together in one task, where
each cell, put in a fixed order first, gets a Fisher-Yates shuffle whose draws are seeded hashes of bucket,
cell and step. Cells and buckets follow each other by number, so each record has a place in one
permutation of all, a function of the data and the seed alone, whatever the partitions. Shard k is the
k-th range of places: row counts are at most one apart, slots gapless, and a bucket lies in one shard or
a few neighbours, so that the shards are written straight from the second pass.

Equal records cannot be told apart by a hash. Where more than REPEATS_MOST are equal, they are counted
first and their copies numbered, so that they scatter like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native_util import byte_size, offsets, spread

SHARDS, SEED = 24, 20_261
#: A bucket's expected bytes of records and number of records, and a cell's number; buckets follow the input.
BUCKET_BYTES, BUCKET_ROWS, CELL_ROWS = 16 << 20, 16_384, 16
REPEATS_MOST = 64

#: (n, bucket, cell) -> which record stands at each place of the cell.
_FISHER_YATES = """
aggregate(
  if(n > 1, sequence(n - 1, 1, -1), cast(array() as array<int>)), sequence(0, n - 1),
  (s, i) -> transform(array(cast(pmod(xxhash64(bucket, cell, i, {seed}L), i + 1) as int)), j ->
    transform(s, (x, k) -> if(k = i, s[j], if(k = j, s[i], x))))[0])
"""


def permute(df: DataFrame, seed: int = SEED, size: str | None = None, key: list[str] | None = None) -> tuple[DataFrame, int]:
    """df with `place`, its row's place (from 0, gapless) in a seeded uniform permutation, and the row count.

    size: a column with the bytes of a record. key: the columns that are hashed (all where not given);
    rows equal in them may share a cell. All columns must be orderable and groupable. Equal rows are
    interchangeable. An empty table stays empty. Rows of null keys scatter by their other columns.
    """
    held = [f"c{k}" for k in range(len(df.columns))]
    own = dict(zip(df.columns, held, strict=True))
    rows = df.toDF(*held).withColumn("h", F.xxhash64(*[own[c] for c in key or df.columns], F.lit(seed)))
    counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(own[size] if size else F.lit(0)).alias("b"))
    n, total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(1, -(-n // BUCKET_ROWS), -(-total // BUCKET_BYTES))
    cells = max(1, n // buckets // CELL_ROWS)
    rows = rows.withColumn("copy", F.lit(0).cast("long"))
    if most > REPEATS_MOST:
        often = counts.where(F.col("n") > REPEATS_MOST).select("h")
        alike = rows.join(often, "h", "left_semi").groupBy(*held, "h").agg(F.count("*").alias("many"))
        alike = spread(alike, "many", "copy").select(rows.columns)
        rows = rows.join(often, "h", "left_anti").select(rows.columns).union(alike)
    mine = lambda k: F.xxhash64("h", "copy", F.lit(k))
    put = rows.select(F.pmod(mine(1), F.lit(buckets)).alias("bucket"), F.pmod(mine(2), F.lit(cells)).alias("cell"), F.struct(*held).alias("r"))
    counted = put.groupBy("bucket", "cell").agg(F.count("*").alias("n")).withColumn("nth", F.col("bucket") * cells + F.col("cell"))
    at = offsets(counted, [], "nth", "n", "at").select(F.expr(f"nth div {cells}L").alias("bucket"), F.expr(f"nth % {cells}L").alias("cell"), "at")
    whole = put.repartition("bucket").groupBy("bucket", "cell").agg(F.sort_array(F.collect_list("r")).alias("rs")).withColumn("n", F.size("rs"))
    whole = whole.join(at, ["bucket", "cell"]).withColumn("order", F.expr(_FISHER_YATES.format(seed=seed)))
    dealt = whole.select("at", "rs", F.posexplode("order").alias("i", "j")).select(F.col("rs")[F.col("j")].alias("r"), (F.col("at") + F.col("i")).alias("at"))
    return dealt.select(*[F.col("r")[c].alias(name) for name, c in own.items()], F.col("at").alias("place")), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", with_rows: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: shards hold as many rows as each other, at most one apart; grown_shard is null. size
    is the UTF-8 bytes of the text (null: none) plus 8; text_crc32 that of the text (null: of nothing).
    with_rows: the texts move along, for write(). Null doc_ids, repeated rows and equal texts are rows
    like others; extra columns are ignored. An empty table gives none.
    """
    kept = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (byte_size(text) + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        *([F.col(text).alias("text")] if with_rows else []),
    )
    place, n = permute(kept, seed, "size", ["doc_id", "size", "text_crc32"])
    each, longer = divmod(n, shards)  # the first `longer` shards hold one more
    cut = longer * (each + 1)
    at = F.col("place") - cut
    front = F.col("place") < cut
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(front, F.floor(F.col("place") / (each + 1))).otherwise(longer + F.floor(at / max(each, 1))).cast("int").alias("shard"),
        F.when(front, F.col("place") % (each + 1)).otherwise(at % max(each, 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["text"] if with_rows else []),
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the shards as folders shard=0, shard=1, ... of Parquet files, straight from the buckets.

    A file holds the rows of one bucket after another in slot order; `slot` says where each belongs.
    """
    out = shard(docs, shards, seed, with_rows=True)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
