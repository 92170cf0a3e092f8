"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is cut into blocks of equal bytes, in a seeded order. While sources A still have blocks,
each of them is owed w_s / sum(w in A) of the slots: its target weight, shared out anew whenever a
source runs out. In virtual time v, which runs so that source s is owed w_s v blocks, the slots gone by
are t(v) = sum over s of min(B_s, w_s v). Block i of a source is owed from v = i / w_s to (i + 1) / w_s,
so it is released at slot floor(t(i / w_s)) and due at ceil(t((i + 1) / w_s)); of the released blocks the
one due earliest goes first. One block a slot: the shares add up to the slots, so a schedule exists, EDF
finds it, and at every slot each source is less than one block away from what its target weight owes it.
No row is dropped or repeated.

At whole v all owed counts are whole numbers, so each unit of v is a period on its own, and two periods
in which the same sources run and none runs out are the same. Each different period is simulated once,
by a fold over its slots. Sources of equal weight and supply in a period are one class with a member
count, so a step costs the number of classes, which the weights bound, not the number of sources.
Rows find their slot by arithmetic and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .native_util import byte_size, free_names, offsets, spread
from .spark_util import Stage

SEED = 20_262
BLOCK_BYTES = 1 << 20
#: Rows that one window sees on average.
BUCKET_ROWS = 128
#: Production weights: slots of each period for a source; the others get DEFAULT_WEIGHT.
WEIGHTS, DEFAULT_WEIGHT = {"src0": 200, "src1": 80, "src2": 20}, 40
#: Slots whose results one step of the outer fold gathers.
STRIDE = 256

#: A class is struct(w, c, m): weight, blocks a member has in the period, members. The slots gone by, times
#: the weight of class x, when a member of it is owed its block i: `cs` are all classes of the period.
_GONE = "aggregate(cs, 0L, (a, j) -> a + j.m * least(j.c * {x}.w, j.w * ({i})))"


def _head(x: str, k: str, d: str) -> str:
    """The d-th block of class x (index k): members take their first blocks in turn, then their second ones."""
    i = f"(({d}) div {x}.m)"
    due, rel = _GONE.format(x=x, i=i + " + 1"), _GONE.format(x=x, i=i)
    return f"named_struct('due', ({due} + {x}.w - 1) div {x}.w, 'k', {k}, 'rel', {rel} div {x}.w, 'd', {d})"


#: classes -> (class, d) of each slot in turn. `heads` holds the next block of each class that has one left; a
#: released one is there at every slot. The outer fold gathers STRIDE slots at a time.
_EDF = f"""
aggregate(
  sequence(0L, total - 1, {STRIDE}L),
  named_struct('heads', transform(cs, (x, k) -> {_head("x", "k", "0L")}), 'out', cast(array() as array<struct<k:int,d:bigint>>)),
  (o, lo) -> transform(array(aggregate(
      sequence(lo, least(lo + {STRIDE}, total) - 1),
      named_struct('heads', o.heads, 'out', cast(array() as array<struct<k:int,d:bigint>>)),
      (s, t) -> transform(array(array_min(filter(s.heads, h -> h.rel <= t))), p -> named_struct(
        'heads', filter(transform(s.heads, h -> if(h.k = p.k,
           if(p.d + 1 < cs[p.k].m * cs[p.k].c, {_head("cs[p.k]", "p.k", "p.d + 1")}, null), h)), h -> h is not null),
        'out', concat(s.out, array(named_struct('k', p.k, 'd', p.d)))))[0])),
    r -> named_struct('heads', r.heads, 'out', concat(o.out, r.out)))[0],
  o -> o.out)
"""


def _sources(rows: DataFrame, weights: dict[str, int], default: int, block_bytes: int) -> DataFrame:
    """(name, n, w, b, last, rest, full_rank, rest_rank): rows, weight, blocks, whole periods and the blocks after them.

    The ranks number the sources of one weight by when they run out, last ones first, and those that
    run out together with equal rests.
    """
    w = F.lit(default).cast("long")
    for name, weight in weights.items():
        w = F.when(F.col("name") == F.lit("=" + name), F.lit(weight).cast("long")).otherwise(w)
    out = rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    out = out.select("name", "n", w.alias("w"), F.expr(f"(bytes + {block_bytes - 1}L) div {block_bytes}L").alias("b"))
    out = out.select("*", F.expr("b div w").alias("last"), F.expr("b % w").alias("rest"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("last"), "name")).cast("long") - 1
    return out.select("*", rank("w").alias("full_rank"), rank("w", "last", "rest").alias("rest_rank"))


def _segments(sources: DataFrame) -> DataFrame:
    """(seg, lo, last, gone, rate): in periods lo to last the same sources run; at the end of the last some run out."""
    ends = sources.groupBy("last").agg(F.sum("b").alias("sb"), F.sum("w").alias("sw"))
    order = Window.orderBy("last")  # one row for each end of a source
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ends.select(
        F.row_number().over(order).alias("seg"),
        (F.coalesce(F.lag("last").over(order), F.lit(-1).cast("long")) + 1).alias("lo"),
        "last",
        F.coalesce(F.sum("sb").over(before), F.lit(0).cast("long")).alias("gone"),
        F.sum("sw").over(on).alias("rate"),
    )


def _schedule(sources: DataFrame, segments: DataFrame, weights: list[int]) -> DataFrame:
    """(kind, w, c, rank, nth, at): the slot, within its period, of a block; kind is 2 seg, or 2 seg + 1 for the last period."""
    grid = segments.select("seg", "lo", "last", F.explode(F.array(*[F.lit(w).cast("long") for w in weights])).alias("w"))
    grid = grid.join(sources.groupBy("w", "last").agg(F.count("*").alias("m")), ["w", "last"], "left").fillna(0, ["m"])
    stay = F.sum("m").over(Window.partitionBy("w").orderBy(F.desc("last")))
    grid = grid.select("*", stay.alias("stay"))
    one = lambda c, m: F.struct(F.col("w").alias("w"), c.cast("long").alias("c"), m.cast("long").alias("m")).alias("x")
    whole = grid.where("lo < last and stay > 0").select((2 * F.col("seg")).alias("kind"), one(F.col("w"), F.col("stay")))
    stays = grid.where("stay > m").select((2 * F.col("seg") + 1).alias("kind"), one(F.col("w"), F.col("stay") - F.col("m")))
    going = sources.where("rest > 0").groupBy("w", "last", "rest").agg(F.count("*").alias("m")).join(segments.select("seg", "last"), "last")
    going = going.select((2 * F.col("seg") + 1).alias("kind"), one(F.col("rest"), F.col("m")))
    kinds = whole.union(stays).union(going).groupBy("kind").agg(F.sort_array(F.collect_list("x")).alias("cs"))
    kinds = kinds.withColumn("total", F.expr("aggregate(cs, 0L, (a, j) -> a + j.m * j.c)"))
    slots = kinds.select("kind", "cs", F.posexplode(F.expr(_EDF)).alias("at", "p"))
    slots = slots.select("kind", F.col("at").cast("long").alias("at"), F.col("p.d").alias("d"), F.col("cs")[F.col("p.k")].alias("x"))
    return slots.select("kind", F.col("x.w").alias("w"), F.col("x.c").alias("c"), F.expr("d % x.m").alias("rank"), F.expr("d div x.m").alias("nth"), "at")


def _slots(sources: DataFrame, segments: DataFrame, schedule: DataFrame) -> DataFrame:
    """(name, block, slot) of every block."""
    blocks = spread(sources, "b", "block").withColumn("p", F.expr("block div w")).withColumn("nth", F.expr("block % w"))
    out = F.col("p") == F.col("last")
    blocks = blocks.select("name", "block", "p", "nth", "w", F.when(out, F.col("rest")).otherwise(F.col("w")).alias("c"), F.when(out, F.col("rest_rank")).otherwise(F.col("full_rank")).alias("rank"))
    periods = spread(segments.withColumn("many", F.col("last") - F.col("lo") + 1), "many", "k").withColumn("p", F.col("lo") + F.col("k"))
    periods = periods.select("p", (2 * F.col("seg") + (F.col("p") == F.col("last")).cast("int")).alias("kind"), (F.col("gone") + F.col("rate") * F.col("p")).alias("first"))
    found = blocks.join(periods, "p").join(schedule, ["kind", "w", "c", "rank", "nth"])
    return found.select("name", "block", (F.col("first") + F.col("at")).alias("slot"))


OUT = ("__source", "__bytes", "__block", "__slot", "__start")


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    default_weight: int = DEFAULT_WEIGHT,
    block_bytes: int = BLOCK_BYTES,
    seed: int = SEED,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """All rows and columns of docs with __source (never null), __bytes, __block, __slot and __start.

    __slot orders the mixture (rows of a slot by __start). weights: slots a period for a source, whole
    numbers above 0. A row's bytes are those of its text in UTF-8 (null: none) plus 1; a row belongs to
    the block in which it starts, so a text longer than a block leaves the blocks it covers empty. Null
    sources are one source of their own, apart from the empty name; of any number of sources none is
    refused. Rows of equal doc_id and size are ordered either way round. An empty table stays empty.
    Columns of docs may have any names; where docs has one of the added names, that gets more underscores.
    """
    weights = WEIGHTS if weights is None else weights
    if any(int(w) != w or w < 1 for w in [*weights.values(), default_weight]):
        raise ValueError("weights must be whole numbers above 0")
    stage = Stage(docs.sparkSession, "mixing")
    held = [f"c{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, held, strict=True))
    name = F.coalesce(F.concat(F.lit("="), F.col(own[source]).cast("string")), F.lit("null"))
    rows = docs.toDF(*held).select("*", name.alias("name"), (byte_size(own[text]) + 1).alias("bytes"), F.xxhash64(own[doc_id], own[text], F.lit(seed)).alias("h"))
    sources = stage.save(_sources(rows, weights, default_weight, block_bytes), "sources")
    segments = stage.save(_segments(sources), "segments")
    schedule = stage.save(_schedule(sources, segments, sorted({*weights.values(), default_weight})), "schedule")

    rows = rows.join(sources.select("name", F.expr(f"(n + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}").alias("buckets")), "name")
    rows = rows.withColumn("bucket", F.pmod("h", "buckets")).drop("buckets")
    within = Window.partitionBy("name", "bucket").orderBy("h", own[doc_id], "bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = offsets(rows.groupBy("name", "bucket").agg(F.sum("bytes").alias("t")), ["name"], "bucket", "t", "off")
    rows = rows.withColumn("inside", F.sum("bytes").over(within) - F.col("bytes")).join(before, ["name", "bucket"])
    rows = rows.withColumn("start", F.col("inside") + F.col("off")).withColumn("block", F.expr(f"start div {block_bytes}L"))
    out = rows.join(_slots(sources, segments, schedule), ["name", "block"])
    added = zip(("name", "bytes", "block", "slot", "start"), free_names(docs.columns, OUT), strict=True)
    return out.select(*[F.col(c).alias(n) for c, n in zip(held, docs.columns, strict=True)], *[F.col(c).alias(n) for c, n in added])


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, all rows and columns, laid out in the order of the mixture: file after file, row after row."""
    _, _, _, slot, start = free_names(docs.columns, OUT)
    return mix(docs, **options).repartitionByRange(slot, start).sortWithinPartitions(slot, start).select(docs.columns)
