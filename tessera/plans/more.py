"""Further queries: row rules, pools, captions, samples, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.clock import MICROS, micros
from tessera.operators import ordered
from tessera.sources import project

from .catalog import register, table
from .rows import HOUR, events, minutes

_US = "epoch_us(ts)"


@register("remove_short", "SELECT event_id, user_id FROM events WHERE coalesce(CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END >= 5, true)")
def remove_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.when(F.col("event_id") % 50 != 0, F.col("value"))
    return events(spark, sf_dir).where(F.coalesce(length >= 5, F.lit(True))).select("event_id", "user_id")


@register("word_floor", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 5)) AS n, array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 5), '') AS kept FROM part")
def word_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("p_name", " "), lambda w: F.length(w) >= 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(words).cast("bigint").alias("n"), F.array_join(words, "").alias("kept"))


@register(
    "moving_groups",
    f"""WITH g AS (SELECT user_id, event_type, count(*) AS n, max({_US}) - min({_US}) AS span, max(value) - min(value) AS drift FROM events GROUP BY ALL)
    SELECT user_id, event_type, n FROM g WHERE n >= 3 AND (span <= 86400000000 OR n * 172800000000 >= span) AND drift <= 60""",
)
def moving_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span"), (F.max("value") - F.min("value")).alias("drift"))
    dense = (F.col("span") <= 24 * HOUR) | (F.col("n") * 48 * HOUR >= F.col("span"))
    return g.where((F.col("n") >= 3) & dense & (F.col("drift") <= 60)).select("user_id", "event_type", "n")


@register(
    "block_kind",
    f"""WITH d AS (SELECT user_id, min({_US}) AS lo, max({_US}) AS hi FROM events GROUP BY user_id),
    e AS (SELECT event_id, {_US} - lo AS s, hi - lo AS dur, greatest(5000000, (hi - lo) // 20) AS edge FROM events JOIN d USING (user_id))
    SELECT event_id, CASE WHEN s <= edge THEN 'intro' WHEN s >= dur - edge THEN 'outro' ELSE 'repeat' END AS kind FROM e""",
)
def block_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = events(spark, sf_dir).select("event_id", (F.col("us") - F.min("us").over(w)).alias("s"), (F.max("us").over(w) - F.min("us").over(w)).alias("dur"))
    edge = F.greatest(F.lit(5 * MICROS), F.floor(F.col("dur") / 20))
    return rows.select("event_id", F.when(F.col("s") <= edge, "intro").when(F.col("s") >= F.col("dur") - edge, "outro").otherwise("repeat").alias("kind"))


@register(
    "stale_results",
    """SELECT o_orderkey, (o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END) IS DISTINCT FROM (CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END) AS stale FROM orders""",
)
def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    now = F.struct(F.col("o_orderstatus").alias("a"), priority.alias("b"))
    then = F.struct(F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("a"), priority.alias("b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (~now.eqNullSafe(then)).alias("stale"))


@register(
    "crop_from_union",
    """WITH u AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand), c AS (SELECT p_brand, greatest(lo - 2, 0) AS y, least(greatest(hi + 2 - greatest(lo - 2, 0), 12), 60) AS h FROM u)
    SELECT p_brand, CAST(y AS INTEGER) AS y, CAST(CASE WHEN h < 54 THEN h END AS INTEGER) AS h FROM c""",
)
def crop_from_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    y = F.greatest(F.col("lo") - 2, F.lit(0))
    h = F.least(F.greatest(F.col("hi") + 2 - y, F.lit(12)), F.lit(60))
    return u.select("p_brand", y.alias("y"), F.when(h < 54, h).alias("h"))


@register(
    "trusted_pool",
    """SELECT a.o_orderkey, count(b.o_orderkey) AS pool FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'F' AND b.o_orderkey <> a.o_orderkey GROUP BY a.o_orderkey""",
)
def trusted_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    trusted = (F.col("o_orderstatus") == "F").cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.sum(trusted).over(w) - trusted).alias("pool"))


@register("merged_lines", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS text, max(o_totalprice) AS best FROM orders GROUP BY o_custkey")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("listagg(o_orderstatus, '') WITHIN GROUP (ORDER BY o_orderkey)")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.alias("text"), F.max("o_totalprice").alias("best"))


@register(
    "run_summary",
    """SELECT o_orderpriority, len(list(o_orderkey) FILTER (o_orderstatus = 'F')) AS n_ok, min(o_orderkey) FILTER (o_orderstatus = 'O') AS first_failed, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'P') AS BIGINT) AS cancelled_cents FROM orders GROUP BY o_orderpriority""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = lambda s, c: F.when(F.col("o_orderstatus") == s, c)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(only("F", F.col("o_orderkey"))).alias("n_ok"),
        F.min(only("O", F.col("o_orderkey"))).alias("first_failed"),
        F.sum(only("P", F.round(F.col("o_totalprice") * 100).cast("bigint"))).alias("cancelled_cents"),
    )


@register("directory_usage", r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, max(page_id) AS newest, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY ALL")
def directory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.max("page_id").alias("newest"), F.sum(F.length("html")).alias("size"))


@register("caption_ratios", "SELECT lang, count(*) AS probes, count(*) FILTER (quality = 1) AS agreed, count(DISTINCT source) - 1 AS others FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def caption_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("probes"), F.count_if(F.col("quality") == 1).alias("agreed"), (F.count_distinct("source") - 1).alias("others"))


@register(
    "sample_times",
    f"""WITH s AS (SELECT user_id, {_US} // 1000000 AS s, CAST(floor(value * 60) AS BIGINT) AS d, {_US} AS us FROM events),
    c AS (SELECT *, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) - d AS before, CAST(sum(d) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM s),
    k AS (SELECT unnest(range(0, 5)) AS k) SELECT user_id, k, s + (2 * k + 1) * total // 10 - before AS at FROM c, k WHERE (2 * k + 1) * total // 10 >= before AND (2 * k + 1) * total // 10 < before + d""",
)
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / MICROS).alias("s"), F.floor(F.col("value") * 60).alias("d"), "us")
    rows = rows.withColumn("before", F.sum("d").over(w.orderBy("us").rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")).withColumn("total", F.sum("d").over(w))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))).withColumn("aim", F.expr("(2 * k + 1) * total div 10"))
    return rows.where("aim >= before AND aim < before + d").selectExpr("user_id", "k", "s + aim - before AS at")


@register(
    "newest_supported",
    """WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size <= 30) SELECT p_brand, p_partkey, p_size FROM r WHERE r = 1""",
)
def newest_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size <= 30").select("p_brand", "p_partkey", "p_size")
    return ordered.top_per_bucket(parts, ["p_brand"], "p_size", "p_partkey", 1).drop("place")


@register(
    "recents",
    f"""WITH l AS (SELECT user_id, event_type, max({_US}) AS us FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC) AS place FROM l) SELECT user_id, event_type, us, place FROM r WHERE place <= 3""",
)
def recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("us").alias("us"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"))).cast("bigint")
    return last.withColumn("place", place).where("place <= 3")


@register(
    "evidence_join",
    """WITH e AS (SELECT sha256(p_name) AS k, p_name AS name, count(*) AS n FROM part GROUP BY p_name) SELECT p.p_partkey, e.n FROM part p LEFT JOIN e ON sha256(p.p_name) = e.k AND e.name = p.p_name""",
)
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.sha2("p_name", 256).alias("k"))
    evidence = parts.groupBy("k", F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    return parts.join(evidence, "k", "left").where("name IS NULL OR name = p_name").select("p_partkey", "n")


@register(
    "changed_evidence",
    """SELECT o_orderkey FROM orders WHERE md5(o_orderstatus || o_orderpriority) <> md5(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END || o_orderpriority)""",
)
def changed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    digest = lambda a: F.md5(F.concat(a, F.col("o_orderpriority")).cast("binary"))
    saved = orders.select("o_orderkey", digest(F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("d"))
    now = orders.select("o_orderkey", digest(F.col("o_orderstatus")).alias("d"))
    return now.join(saved, ["o_orderkey", "d"], "left_anti").select("o_orderkey")


@register(
    "best_stream",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 10 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 5 ELSE 0 END AS score FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey) AS r FROM s) SELECT l_orderkey, l_linenumber, l_partkey, score FROM r WHERE r = 1""",
)
def best_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_returnflag") == "A", 10).otherwise(0) + F.when(F.col("l_linestatus") == "F", 5).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))
    best = F.struct(-F.col("score"), "l_linenumber", "l_partkey")
    out = rows.groupBy("l_orderkey").agg(F.min_by(F.struct("l_linenumber", "l_partkey", "score"), best).alias("b"))
    return out.select("l_orderkey", "b.*")


@register("list_videos", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '.MKV' WHEN p_partkey % 3 = 1 THEN '.mp4' ELSE '.txt' END AS path FROM part WHERE p_partkey % 3 <> 2")
def list_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("p_partkey") % 3 == 0, ".MKV").when(F.col("p_partkey") % 3 == 1, ".mp4").otherwise(".txt")
    return project.videos(table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", ending).alias("path")))


@register(
    "neighbour_times",
    f"""WITH b AS (SELECT user_id, min({_US} // 3600000000) AS lo, max({_US} // 3600000000) AS hi FROM events GROUP BY user_id), o AS (SELECT unnest([-8, -4, 4, 8]) AS o)
    SELECT DISTINCT user_id, greatest(least({_US} // 3600000000 + o, hi), lo) AS at FROM events JOIN b USING (user_id), o WHERE event_type = 'error'""",
)
def neighbour_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = events(spark, sf_dir).select("user_id", "event_type", F.floor(F.col("us") / HOUR).alias("h"))
    rows = rows.withColumn("lo", F.min("h").over(w)).withColumn("hi", F.max("h").over(w)).where("event_type = 'error'")
    at = F.transform(F.array(*map(F.lit, (-8, -4, 4, 8))), lambda o: F.greatest(F.least(F.col("h") + o, F.col("hi")), F.col("lo")))
    return rows.select("user_id", F.explode(at).alias("at")).distinct()


@register(
    "first_double_absence",
    f"""WITH w AS (SELECT user_id, event_id, event_type <> 'view' AND lead(event_type <> 'view') OVER (PARTITION BY user_id ORDER BY {_US}, event_id) AS gone FROM events) SELECT user_id, min(event_id) AS event_id FROM w WHERE gone GROUP BY user_id""",
)
def first_double_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    absent = F.col("event_type") != "view"
    rows = events(spark, sf_dir).withColumn("absent", absent)
    after = F.lead("absent").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return rows.withColumn("gone", F.col("absent") & after).where("gone").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@register(
    "present_prefix",
    f"""WITH w AS (SELECT user_id, event_id, min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY {_US}, event_id ROWS UNBOUNDED PRECEDING) AS p FROM events) SELECT user_id, max(event_id) AS last_present, count(*) AS n FROM w WHERE p = 1 GROUP BY user_id""",
)
def present_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events(spark, sf_dir).withColumn("p", F.min((F.col("event_type") != "error").cast("int")).over(w))
    return rows.where("p = 1").groupBy("user_id").agg(F.max("event_id").alias("last_present"), F.count("*").alias("n"))


@register("weighted_progress", "SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 5 WHEN 'purchase' THEN 40 ELSE 30 END) AS BIGINT) AS progress FROM events GROUP BY user_id")
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in {"view": 20, "click": 5, "purchase": 40}.items() for x in kv])[F.col("event_type")], F.lit(30))
    return events(spark, sf_dir).groupBy("user_id").agg(F.sum(weight).alias("progress"))


@register("alone_in_directory", r"SELECT page_id, count(*) OVER (PARTITION BY regexp_extract(url, '^(.*)/[^/]*$', 1)) = 1 AS alone FROM pages")
def alone_in_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_extract("url", "^(.*)/[^/]*$", 1)
    return table(spark, sf_dir, "pages").select("page_id", (F.count("*").over(Window.partitionBy(folder)) == 1).alias("alone"))


@register("dictionary_or_all", "SELECT n_nationkey FROM nation WHERE n_name IN (SELECT upper(p_name) FROM part WHERE p_size < 0) OR NOT EXISTS (SELECT 1 FROM part WHERE p_size < 0)")
def dictionary_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").where("p_size < 0").select(F.upper("p_name").alias("n_name")).distinct()
    nation = table(spark, sf_dir, "nation")
    return (nation if words.isEmpty() else nation.join(words, "n_name", "left_semi")).select("n_nationkey")


@register("zipped_words", "SELECT p_partkey, unnest(list_transform(range(0, len(string_split(p_name, ' '))), lambda i: (i + 1) || ':' || string_split(p_name, ' ')[i + 1])) AS word FROM part")
def zipped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    places = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: i.cast("string"))
    pairs = F.zip_with(places, words, lambda i, w: F.concat(i, F.lit(":"), w))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(pairs).alias("word"))


@register(
    "sessions",
    f"""WITH w AS (SELECT user_id, {_US} AS us, lag({_US}) OVER (PARTITION BY user_id ORDER BY {_US}) AS p FROM events), i AS (SELECT *, sum(CASE WHEN us - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS i FROM w)
    SELECT user_id, min(us) AS session_start, count(*) AS n FROM i GROUP BY user_id, i""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("session_start"), "n")


@register("kept_spans_valid", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 90) * 60 + o_orderkey % 60 END AS start_s FROM orders")
def kept_spans_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions import clock

    key = F.col("o_orderkey")
    written = F.when(key % 4 == 0, F.lit("x:00")).otherwise(F.concat((key % 90).cast("string"), F.lit(":"), (key % 60).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.seconds_of_clock(written).alias("start_s"))


@register("minutes_total", f"SELECT event_type, CAST(sum(e - s) AS BIGINT) AS total FROM (SELECT event_type, {_US} AS s, {_US} + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events) GROUP BY event_type")
def minutes_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes(spark, sf_dir).groupBy("event_type").agg(F.sum(F.col("end") - F.col("start")).alias("total"))


@register("time_rounding", f"SELECT event_id, CAST(round_even({_US} / 1000.0, 0) AS BIGINT) AS ms, {_US} * 24 // 1000000 AS frame FROM events")
def time_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(micros("ts").alias("us"), "event_id").selectExpr("event_id", "cast(bround(us / 1000.0D, 0) AS bigint) AS ms", "us * 24 div 1000000 AS frame")
