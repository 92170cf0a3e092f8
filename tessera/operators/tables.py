"""Set operations, reconciliation, ladders of rules, tolerant JSON, joins by nearness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def reconcile(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Each key of either side with its status: added, removed or kept."""
    a = existing.select(F.col(key).alias("__a")).distinct()
    b = incoming.select(F.col(key).alias("__b")).distinct()
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("kept")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), status.alias("status"))


def upsert(target: DataFrame, results: DataFrame, key: str, column: str, guard: Column) -> DataFrame:
    """target with `column` taken from results where there is one and the guard on the target's row holds."""
    new = results.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    out = target.withColumn("__g", guard).join(new, F.col(key) == F.col("__k"), "left")
    value = F.when(F.col("__g") & F.col("__k").isNotNull(), F.col("__v")).otherwise(F.col(column))
    changed = ~value.eqNullSafe(F.col(column))
    return out.withColumn("changed", changed).withColumn(column, value).drop("__k", "__v", "__g")


def ladder(rungs: Sequence[tuple[Column, str]], default: str) -> Column:
    """The first rung that holds."""
    out = F.lit(default)
    for condition, value in reversed(rungs):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def flag_add(flags: Column, more: Column) -> Column:
    """Two sets of flags written a+b+c, as one in the order of their first standing."""
    return F.array_join(F.array_distinct(F.concat(_flags(flags), _flags(more))), "+")


def flag_remove(flags: Column, less: Column) -> Column:
    return F.array_join(F.array_except(_flags(flags), _flags(less)), "+")


def flag_subset(flags: Column, of: Column) -> Column:
    return F.size(F.array_except(_flags(flags), _flags(of))) == 0


def _flags(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\+"), lambda x: x != "")


def json_number(c: Column, path: str) -> Column:
    """A number in a JSON text, whether written as one or as a text; null for anything else, broken JSON too."""
    return F.get_json_object(c, path).try_cast("double")


def spread_pick(df: DataFrame, keys: Keys, order: Keys, k: int) -> DataFrame:
    """k rows of each group at even steps from the first to the last (half to even); all rows of smaller groups."""
    w, all_ = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    out = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(all_))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (k - 1)).cast("int"))
    return out.where((F.col("__n") <= k) | F.array_contains(places, F.col("__i"))).drop("__i", "__n")


def descending_ladder(value: Column, floor: int, step: int) -> Column:
    """value, value - step, ... while above floor, and floor; the value alone if it is not above floor."""
    return F.when(value > floor, F.concat(F.sequence(value, F.lit(floor + 1).cast("bigint"), F.lit(-step).cast("bigint")), F.array(F.lit(floor).cast("bigint")))).otherwise(F.array(value))


def nearest(points: DataFrame, centres: DataFrame, keys: Keys, x: str, cx: str, cid: str, most: float) -> DataFrame:
    """Each point with the nearest centre of its group within `most` (ties: the smaller centre id); null without one.

    Points and centres are dealt into cells of twice `most`; a centre is in the cells next to its own, too, so a
    point's cell has all that can be its own. There both are sorted once up and once down: the last centre passed
    is the nearest on that side. Centres so close together that a distance may round to the same for several (a
    clump; of a grid of decimals each is one alone) are passed as one and all compared. Null places or keys and
    places that are no finite number have no centre.
    """
    width = 2.0 * most if most > 0 else 1.0
    # far out all places share a cell, and cells stay whole numbers
    cell = lambda c: F.floor(F.greatest(F.least(F.col(c).cast("double") / width, F.lit(1e15)), F.lit(-1e15)))
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    group = [F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)]
    in_cell = [*[f"__k{n}" for n in range(len(keys))], "__cell"]
    known = centres.where(finite(cx)).dropna(subset=list(keys)).select(*group, F.col(cx).alias("__c"), F.col(cid).alias("__i"), cell(cx).alias("__o"))
    near = known.withColumn("__cell", F.explode(F.array(F.col("__o") - 1, F.col("__o"), F.col("__o") + 1))).groupBy(*in_cell, "__c").agg(F.min("__i").alias("__i"))
    up = Window.partitionBy(*in_cell).orderBy("__c")
    apart = F.coalesce((F.col("__c") - F.lag("__c").over(up) > most * 2.0**-50).cast("int"), F.lit(0))
    clumps = near.withColumn("__n", apart).withColumn("__g", F.sum("__n").over(up)).groupBy(*in_cell, "__g")
    clumps = clumps.agg(F.min("__c").alias("__lo"), F.max("__c").alias("__hi"), F.collect_list(F.struct(F.col("__c").alias("c"), F.col("__i").alias("i"))).alias("__cs")).drop("__g")
    asked = points.select(F.struct(*[F.col(c) for c in points.columns]).alias("__row"), *group, F.when(finite(x), F.col(x)).alias("__x"), F.when(finite(x), cell(x)).alias("__cell"))
    both = asked.unionByName(clumps, allowMissingColumns=True)
    passed = lambda by: F.last("__cs", ignorenulls=True).over(Window.partitionBy(*in_cell).orderBy(by, F.isnull("__cs")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("__lo", F.coalesce("__lo", "__x")).withColumn("__hi", F.coalesce("__hi", "__x"))
    both = both.withColumn("__below", passed(F.asc("__lo"))).withColumn("__above", passed(F.desc("__hi"))).where(F.col("__row").isNotNull())
    ranked = F.transform(F.concat(F.coalesce("__below", "__above"), F.coalesce("__above", "__below")), lambda c: F.struct(F.abs(c["c"] - F.col("__x")).alias("d"), c["i"].alias("i")))
    best = both.select("__row", F.array_min(ranked).alias("__m"))
    return best.select("__row.*", F.when(F.col("__m.d") <= most, F.col("__m.i")).alias("centre"))


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str], id_: str, slack: float = 0) -> DataFrame:
    """(keys, inner, outer): boxes (x0, y0, x1, y1) that lie in another of equal keys, but for `slack` on each side."""
    a = inner.select(*keys, F.col(id_).alias("inner"), *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
    b = outer.select(*keys, F.col(id_).alias("outer"), "x0", "y0", "x1", "y1")
    inside = (F.col("__x0") >= F.col("x0") - slack) & (F.col("__y0") >= F.col("y0") - slack) & (F.col("__x1") <= F.col("x1") + slack) & (F.col("__y1") <= F.col("y1") + slack)
    return a.join(b, [*keys]).where(inside & (F.col("inner") != F.col("outer"))).select(*keys, "inner", "outer")


def bulk_targets(df: DataFrame, source: Column, skipped: Column, name: str) -> DataFrame:
    """The row a change comes from and all rows that are not skipped, numbered by name."""
    return df.where(source | ~F.coalesce(skipped, F.lit(False))).withColumn("place", F.row_number().over(Window.orderBy(name)) - 1)


def ordered_times(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Each key's distinct times in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("times"))
