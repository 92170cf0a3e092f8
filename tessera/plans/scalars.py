"""Queries of expressions: text, clocks, numbers, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clock, text
from tessera.operators import tables

from .catalog import register, table


@register(
    "timecode_roundtrip",
    """SELECT o_orderkey, (o_orderkey // 360000) || ':' || lpad(CAST(o_orderkey // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS code, o_orderkey AS centis FROM orders""",
)
def timecode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").select("o_orderkey", clock.code_of_centis("o_orderkey").alias("code"))
    return out.withColumn("centis", clock.centis_of_code("code"))


@register(
    "clock_parse",
    """WITH s AS (SELECT event_id, epoch_us(ts) // 1000000 % 86400 AS seconds FROM events)
    SELECT event_id, CASE WHEN seconds // 60 < 10 THEN '0' ELSE '' END || CAST(seconds // 60 AS VARCHAR) || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') AS clock, seconds FROM s""",
)
def clock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").select("event_id", (F.floor(clock.micros("ts") / clock.MICROS) % 86_400).alias("s"))
    out = out.select("event_id", clock.clock_of_seconds("s").alias("clock"))
    return out.withColumn("seconds", clock.seconds_of_clock("clock"))


@register(
    "human_durations",
    """SELECT DISTINCT n_chars, CASE WHEN n_chars < 60 THEN n_chars || ' s' WHEN n_chars < 3600 THEN (n_chars // 60) || ' min ' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') || ' s'
      ELSE (n_chars // 3600) || ' h ' || lpad(CAST(n_chars // 60 % 60 AS VARCHAR), 2, '0') || ' min' END AS shown FROM documents""",
)
def human_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("n_chars").distinct().withColumn("shown", clock.human_seconds("n_chars"))


@register("half_up", "SELECT p_partkey, CAST(floor(p_retailprice / 5 + 0.5) * 5 AS BIGINT) AS price FROM part")
def half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", clock.half_up("p_retailprice", 5).cast("bigint").alias("price"))


@register("rounding_half_even", "SELECT o_orderkey, CAST(round_even(o_totalprice / 4, 0) AS BIGINT) AS even, CAST(trunc(o_totalprice / 4) AS BIGINT) AS cut FROM orders")
def rounding_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice") / 4
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bround(x).cast("bigint").alias("even"), x.cast("bigint").alias("cut"))


@register("decibels", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(20 * log10(greatest(l_discount, 1e-10)), 6) AS db, round(ln(1 + l_quantity), 6) AS magnitude FROM lineitem")
def decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = F.round(20 * F.log10(F.greatest(F.col("l_discount"), F.lit(1e-10))), 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", db.alias("db"), F.round(F.log(1 + F.col("l_quantity")), 6).alias("magnitude"))


@register("proof_window", "SELECT doc_id, greatest(least(n_chars // 3, n_chars - 30), 0) AS win_start, least(greatest(least(n_chars // 3, n_chars - 30), 0) + 30, n_chars) AS win_end FROM documents")
def proof_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.greatest(F.least(F.floor(F.col("n_chars") / 3), F.col("n_chars") - 30), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", start.alias("win_start"), F.least(start + 30, F.col("n_chars")).alias("win_end"))


@register(
    "visible_text",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace('{\i1}' || p_name || '\N' || p_brand || '\h  ' || p_type || ' {x}', '\{[^}]*\}', '', 'g'), '\\[Nnh]', ' ', 'g'), '\s+', ' ', 'g')) AS shown FROM part""",
)
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(r"{\i1}"), "p_name", F.lit(r"\N"), "p_brand", F.lit(r"\h  "), "p_type", F.lit(" {x}"))
    return table(spark, sf_dir, "part").select("p_partkey", text.visible_text(raw).alias("shown"))


@register(
    "text_normalise",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || '  ' || p_name || '!'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS plain, length(trim(regexp_replace(regexp_replace(lower(p_brand || '  ' || p_name || '!'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))) AS n FROM part""",
)
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "part").select("p_partkey", text.normalised(F.concat("p_brand", F.lit("  "), "p_name", F.lit("!"))).alias("plain"))
    return out.withColumn("n", F.length("plain").cast("bigint"))


@register(
    "undoubled",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || o_orderpriority || o_orderstatus || o_orderpriority ELSE o_orderpriority END AS t FROM orders)
    SELECT o_orderkey, CASE WHEN length(t) >= 4 AND length(t) % 2 = 0 AND left(t, length(t) // 2) = right(t, length(t) // 2) THEN left(t, length(t) // 2) ELSE t END AS t FROM r""",
)
def undoubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat("o_orderstatus", "o_orderpriority")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(both, both)).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.undoubled(t).alias("t"))


@register("safe_tag", "SELECT DISTINCT p_name, coalesce(nullif(regexp_replace(regexp_replace(p_name || ' #' || p_brand || '!', '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), ''), 'zh') AS tag FROM part")
def safe_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name", text.safe_tag(F.concat("p_name", F.lit(" #"), "p_brand", F.lit("!"))).alias("tag")).distinct()


@register("count_or_zero", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '0' WHEN event_id % 4 = 1 THEN '0' ELSE CAST(event_id AS VARCHAR) END AS n FROM events")
def count_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("-"), F.col("event_id").cast("string"))).when(F.col("event_id") % 4 == 1, F.lit("x1")).otherwise(F.concat(F.lit("00"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", text.count_or_zero(raw).alias("n"))


@register(
    "stems",
    r"""SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(list_last(string_split(url, '/')), '.(\.[^.]*)$', 1)) AS ext FROM pages""",
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.stem("url").alias("stem"), text.extension("url").alias("ext"))


@register("version_parts", "SELECT s_suppkey, CAST(s_suppkey % 7 AS INTEGER) AS major, CAST(s_nationkey AS INTEGER) AS minor, CAST(0 AS INTEGER) AS patch FROM supplier")
def version_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = text.version_parts(F.concat_ws(".", (F.col("s_suppkey") % 7).cast("string"), F.concat(F.col("s_nationkey").cast("string"), F.lit("rc1")), F.lit("x")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", v[0].alias("major"), v[1].alias("minor"), v[2].alias("patch"))


@register(
    "fake_text_flags",
    r"""WITH l AS (SELECT lang, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
    SELECT lang, count(*) AS n, count(*) FILTER (regexp_full_match(line, '(-{2,}|`+|[0-9]+|_+|[!-/:-@\[-`{-~]|[A-HJ-Za-z])') OR line = '') AS noise FROM l GROUP BY lang""",
)
def fake_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("l")).select("lang", F.trim("l").alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(text.is_noise("line")).alias("noise"))


@register(
    "near_pairs_levenshtein",
    """SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name AND 3 * levenshtein(a.n_name, b.n_name) <= 2 * greatest(length(a.n_name), length(b.n_name))""",
)
def near_pairs_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    a, b = n.withColumnRenamed("n_name", "a"), n.withColumnRenamed("n_name", "b")
    near = 3 * F.levenshtein("a", "b") <= 2 * F.greatest(F.length("a"), F.length("b"))
    return a.join(b, "n_regionkey").where((F.col("a") < F.col("b")) & near).select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("d"))


@register("anagrams", "WITH p AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b FROM p a JOIN p b ON list_sort(string_split(a.p_name, '')) = list_sort(string_split(b.p_name, '')) AND a.p_name <= b.p_name")
def anagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("k", F.array_join(F.array_sort(F.split("p_name", "")), ""))
    a, b = p.withColumnRenamed("p_name", "a"), p.withColumnRenamed("p_name", "b")
    return a.join(b, "k").where(F.col("a") <= F.col("b")).where(text.anagram("a", "b")).select("a", "b")


@register(
    "json_tolerant",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), -1) AS missing FROM events""",
)
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda path: tables.json_number(F.col("props"), path)
    return table(spark, sf_dir, "events").select("event_id", number("$.k").alias("k"), F.coalesce(number("$.missing"), F.lit(-1.0)).alias("missing"))


@register(
    "json_casts",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS own, CASE WHEN event_id % 5 = 0 THEN 7 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS chosen FROM events""",
)
def json_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 5 == 0, F.lit('{"k": "many"}')).otherwise(F.col("props"))
    own = F.get_json_object(broken, "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", own.alias("own"), F.coalesce(own, F.lit(7).cast("bigint")).alias("chosen"))


@register(
    "dialogue_parse",
    """SELECT conv_id, turn, length(replace(text, chr(10), '\\N')) AS n_text, CASE WHEN role = 'user' THEN 'Default' ELSE role END AS style, turn * 100 AS start_cs, turn * 100 + 250 AS end_cs FROM conversations""",
)
def dialogue_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources import dialogue

    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("turn") * 100).alias("start_cs"), (F.col("turn") * 100 + 250).alias("end_cs"), F.when(F.col("role") == "user", "Default").otherwise(F.col("role")).alias("style"), "text"
    )
    lines = turns.select("conv_id", "turn", dialogue.rendered("start_cs", "end_cs", "style", "text").alias("line"))
    p = dialogue.parsed("line")
    return lines.select("conv_id", "turn", F.length(p["text"]).cast("bigint").alias("n_text"), p["style"].alias("style"), p["start_cs"].alias("start_cs"), p["end_cs"].alias("end_cs"))
