"""Queries of the rules for skipped spans, merged lines, readings and texts, on rows made from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import folds, spans, summaries, tables
from tessera.sources import dialogue

from .catalog import register, table
from .rows import events

MINUTE = 60_000_000

_SKIPS = """s AS (SELECT user_id, event_type, epoch_us(ts) // 60000000 - (SELECT min(epoch_us(ts)) // 60000000 FROM events) AS a, epoch_us(ts) // 60000000 % 1440 AS d, CAST(floor(value) AS BIGINT) AS n FROM events)"""


def _skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", F.floor(F.col("us") / MINUTE).alias("m"), F.floor("value").alias("n"))
    first = rows.agg(F.min("m").alias("m0"))
    return rows.join(F.broadcast(first)).select("user_id", "event_type", (F.col("m") - F.col("m0")).alias("start"), (F.col("m") - F.col("m0") + F.col("n")).alias("end"), (F.col("m") % 1440).alias("d"), "n")


@register(
    "keep_ranges",
    f"""WITH {_SKIPS}, w AS (SELECT user_id, a, a + n AS e, max(a + n) OVER (PARTITION BY user_id ORDER BY a, a + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
    i AS (SELECT *, sum(CASE WHEN a > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS i FROM w),
    u AS (SELECT user_id, min(a) AS a, max(e) AS e FROM i GROUP BY user_id, i), g AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY a), 0) AS f, a AS t FROM u),
    k AS (SELECT user_id, f, t FROM g WHERE t - f >= 5 UNION ALL SELECT user_id, max(e), NULL FROM u GROUP BY user_id HAVING user_id % 3 <> 0 AND 60000 - max(e) >= 5)
    SELECT user_id, CAST(f AS DOUBLE) AS keep_start, CAST(t AS DOUBLE) AS keep_end, CASE WHEN f > 0 THEN lpad(CAST(f // 60 AS VARCHAR), CAST(greatest(2, length(CAST(f // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(f % 60 AS VARCHAR), 2, '0') END AS from_text,
      CASE WHEN t IS NOT NULL THEN lpad(CAST(t // 60 AS VARCHAR), CAST(greatest(2, length(CAST(t // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') END AS to_text FROM k""",
)
def keep_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    skips = _skips(spark, sf_dir).withColumn("duration", F.when(F.col("user_id") % 3 == 0, 0).otherwise(60_000))
    return spans.keep_ranges(skips, ["user_id"], "duration")


@register(
    "gap_bridge",
    f"""WITH RECURSIVE {_SKIPS}, w AS (SELECT event_type, user_id, d AS a, d + n AS e, max(d + n) OVER (PARTITION BY event_type, user_id ORDER BY d, d + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
    i AS (SELECT *, sum(CASE WHEN a > r THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS i FROM w),
    u AS (SELECT event_type, user_id, min(a) AS a, max(e) AS e FROM i GROUP BY event_type, user_id, i),
    x AS (SELECT *, lead(a) OVER (PARTITION BY event_type, user_id ORDER BY a) AS nx FROM u),
    g AS (SELECT event_type, user_id, e, (e + nx) / 2.0 AS mid, row_number() OVER (PARTITION BY event_type ORDER BY (e + nx) / 2.0, user_id, e) AS k FROM x WHERE nx - e <= 60),
    c AS (SELECT event_type, k, user_id, e, mid AS anchor, [user_id] AS files, 0 AS c FROM g WHERE k = 1
      UNION ALL SELECT g.event_type, g.k, g.user_id, g.e, CASE WHEN new THEN g.mid ELSE c.anchor END, CASE WHEN new THEN [g.user_id] ELSE list_append(c.files, g.user_id) END, CASE WHEN new THEN c.c + 1 ELSE c.c END
      FROM c JOIN g ON g.event_type = c.event_type AND g.k = c.k + 1, LATERAL (SELECT g.mid - c.anchor > 20 OR list_contains(c.files, g.user_id) AS new)),
    f AS (SELECT event_type, greatest(2, floor(count(DISTINCT user_id) * 0.2)) AS least FROM u GROUP BY event_type),
    o AS (SELECT event_type, c FROM c JOIN f USING (event_type) GROUP BY event_type, c, least HAVING count(*) >= least),
    b AS (SELECT event_type, user_id, e FROM c JOIN o USING (event_type, c)),
    n AS (SELECT u.*, CASE WHEN lag(b.e) OVER (PARTITION BY u.event_type, u.user_id ORDER BY u.a) IS NULL THEN 1 ELSE 0 END AS fresh FROM u LEFT JOIN b ON b.event_type = u.event_type AND b.user_id = u.user_id AND b.e = u.e),
    j AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS j FROM n)
    SELECT event_type, user_id, min(a) AS "start", max(e) AS "end", count(*) AS n_blocks FROM j GROUP BY event_type, user_id, j""",
)
def gap_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _skips(spark, sf_dir).select("event_type", "user_id", F.col("d").alias("start"), (F.col("d") + F.col("n")).alias("end"))
    return spans.bridged(rows, ["event_type"], "user_id", reach=20, most=60, share=0.2)


_NUMBERED = "SELECT user_id, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("i"), F.row_number().over(by).cast("long").alias("k"))


_ALIKE = "({0} = {1} OR ({0} <> '' AND {1} <> '' AND 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) >= {2}))"


@register(
    "merge_consecutive_full",
    rf"""WITH RECURSIVE n AS ({_NUMBERED}), e AS (SELECT user_id, k, k * 10 AS s, CASE WHEN i % 41 <> 0 THEN k * 10 + CASE i % 4 WHEN 0 THEN 10 WHEN 1 THEN 4 WHEN 2 THEN 9 ELSE 12 END END AS e,
      'the ' || CASE WHEN i % 4 = 0 THEN 'linee ' ELSE 'line ' END || CAST(k // 6 % 3 AS VARCHAR) AS v, CASE WHEN i % 6 = 0 THEN '{{\i1}}' ELSE '' END AS mark, CASE WHEN i % 13 = 0 THEN 'B' ELSE 'A' END AS style FROM n),
    r AS (SELECT user_id, k, 1 AS g, s AS fs, e AS fe, style, e AS me, mark || v AS mt, v AS mv, 1 AS n FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, CASE WHEN j THEN r.g ELSE r.g + 1 END, CASE WHEN j THEN r.fs ELSE e.s END, CASE WHEN j THEN r.fe ELSE e.e END, e.style, e.e,
        CASE WHEN j AND NOT (echo AND e.e - e.s >= 5) THEN r.mt ELSE e.mark || e.v END, CASE WHEN j AND NOT (echo AND e.e - e.s >= 5) THEN r.mv ELSE e.v END, CASE WHEN j THEN r.n + 1 ELSE 1 END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1,
        LATERAL (SELECT coalesce(e.s = r.me AND e.style = r.style AND {_ALIKE.format("r.mv", "e.v", 0.7)} AND r.fe - r.fs IS NOT NULL AND e.e - e.s IS NOT NULL AND least(r.fe - r.fs, e.e - e.s) < 5, false) AS echo),
        LATERAL (SELECT echo OR coalesce(e.s - r.me <= 3 AND e.style = r.style AND (r.mv = e.v OR ((coalesce(r.fe - r.fs < 10, false) OR coalesce(e.e - e.s < 10, false)) AND levenshtein(r.mv, e.v) = 1)), false) AS j))
    SELECT user_id, fs AS "start", arg_max(CAST(coalesce(me, -1) AS BIGINT), k) AS "end", arg_max(mt, k) AS text, style, max(n) AS n_rows FROM r GROUP BY user_id, g, fs, style""",
)
def merge_consecutive_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("i"), F.col("k")
    length = F.when(i % 4 == 0, 10).when(i % 4 == 1, 4).when(i % 4 == 2, 9).otherwise(12)
    said = F.concat(F.when(i % 6 == 0, "{\\i1}").otherwise(""), F.lit("the "), F.when(i % 4 == 0, "linee ").otherwise("line "), (F.floor(k / 6) % 3).cast("string"))
    rows = _numbered(spark, sf_dir).select("user_id", (k * 10).alias("start"), F.when(i % 41 != 0, k * 10 + length).cast("string").alias("stop"), said.alias("text"), F.when(i % 13 == 0, "B").otherwise("A").alias("style"))

    def fold(held: list[dict]) -> list[dict]:
        for r in held:
            r["end"] = int(r.pop("stop")) if isinstance(r["stop"], str) else None
        out = folds.merge_consecutive(3, 10, 5, ["style"])(held)
        return [r | {"end": -1 if r["end"] is None else r["end"]} for r in out]

    return folds.run(rows, ["user_id"], ["start"], fold, "user_id long, start long, end long, text string, style string, n_rows int")


@register(
    "merge_alternating",
    rf"""WITH RECURSIVE n AS ({_NUMBERED}), e AS (SELECT user_id, k, k AS s, k + CASE WHEN i % 29 = 0 THEN 2 ELSE 1 END AS e, CASE WHEN (user_id + k // 9) % 2 = 0 THEN 'steady line ' || chr(CAST(97 + k % 2 AS INTEGER)) || CASE WHEN k % 7 = 6 THEN '.' ELSE '' END ELSE 'other ' || CAST(k % 5 AS VARCHAR) END AS t,
      CASE WHEN i % 31 = 0 THEN 'B' ELSE 'A' END AS style FROM n),
    h AS (SELECT a.user_id, a.k, a.e = b.s AND b.e = c.s AND a.style = b.style AND a.style = c.style AND a.t = c.t AND a.t <> b.t AND {_ALIKE.format("a.t", "b.t", 0.7)} AS trio
      FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.k = a.k + 1 LEFT JOIN e c ON c.user_id = a.user_id AND c.k = a.k + 2),
    s AS (SELECT user_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, false AS open, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT s.user_id, CASE WHEN s.open THEN CASE WHEN fits THEN s.i ELSE s.j END WHEN three THEN s.i ELSE s.i + 1 END, CASE WHEN s.open THEN CASE WHEN fits THEN s.j + 1 ELSE s.j END WHEN three THEN s.i + 3 ELSE s.i + 1 END,
        CASE WHEN s.open THEN fits ELSE three END, CASE WHEN s.open AND NOT fits THEN s.i WHEN NOT s.open AND NOT three THEN s.i END, CASE WHEN s.open AND NOT fits THEN s.j - 1 WHEN NOT s.open AND NOT three THEN s.i END
      FROM s JOIN e f ON f.user_id = s.user_id AND f.k = s.i LEFT JOIN h ON h.user_id = s.user_id AND h.k = s.i LEFT JOIN e g ON g.user_id = s.user_id AND g.k = s.i + 1
        LEFT JOIN e p ON p.user_id = s.user_id AND p.k = s.j - 1 LEFT JOIN e q ON q.user_id = s.user_id AND q.k = s.j,
        LATERAL (SELECT coalesce(h.trio, false) AS three, coalesce(p.e = q.s AND q.style = f.style AND CASE WHEN (s.j - s.i) % 2 = 0 THEN {_ALIKE.format("q.t", "f.t", 0.9)} ELSE {_ALIKE.format("q.t", "g.t", 0.9)} END, false) AS fits))
    SELECT s.user_id, a.s AS "start", b.e AS "end", a.t AS text, a.style AS style, hi - lo + 1 AS n_rows FROM s JOIN e a ON a.user_id = s.user_id AND a.k = lo JOIN e b ON b.user_id = s.user_id AND b.k = hi""",
)
def merge_alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("i"), F.col("k")
    steady = F.concat(F.lit("steady line "), F.when(k % 2 == 0, "a").otherwise("b"), F.when(k % 7 == 6, ".").otherwise(""))
    said = F.when((F.col("user_id") + F.floor(k / 9)) % 2 == 0, steady).otherwise(F.concat(F.lit("other "), (k % 5).cast("string")))
    rows = _numbered(spark, sf_dir).select("user_id", k.alias("start"), (k + F.when(i % 29 == 0, 2).otherwise(1)).alias("end"), said.alias("text"), F.when(i % 31 == 0, "B").otherwise("A").alias("style"))
    return folds.run(rows, ["user_id"], ["start"], folds.merge_alternating(["style"]), "user_id long, start long, end long, text string, style string, n_rows int")


_READINGS = """r AS (SELECT user_id, (k - 1) // 8 AS strip, (k - 1) % 8 AS place, CASE WHEN event_id % 9 = 0 THEN '' ELSE substr(event_type, 1, CAST(length(event_type) - event_id % 3 AS INTEGER)) END AS text, value AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events))"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    cut = F.substr("event_type", F.lit(1), (F.length("event_type") - F.col("event_id") % 3).cast("int"))
    return rows.select("user_id", F.floor(F.col("k") / 8).alias("strip"), (F.col("k") % 8).alias("place"), F.when(F.col("event_id") % 9 == 0, "").otherwise(cut).alias("text"), F.col("value").alias("confidence"))


@register(
    "modal_reading",
    f"""WITH {_READINGS}, t AS (SELECT * FROM r WHERE text <> ''), v AS (SELECT user_id, strip, text, count(*) AS exact, avg(confidence) AS mean, min(place) AS o FROM t GROUP BY ALL),
    p AS (SELECT a.user_id, a.strip, a.text, a.exact, a.mean, a.o, b.exact AS n, CASE WHEN length(a.text) <= length(b.text) THEN a.text ELSE b.text END AS lo, CASE WHEN length(a.text) <= length(b.text) THEN b.text ELSE a.text END AS hi FROM v a JOIN v b USING (user_id, strip)),
    q AS (SELECT user_id, strip, text, exact, mean, o, CAST(sum(n) AS BIGINT) AS support FROM p WHERE 3 * levenshtein(lo, hi) <= length(hi) OR (length(lo) >= 2 AND regexp_matches(hi, array_to_string(string_split(lo, ''), '.*'))) GROUP BY ALL),
    z AS (SELECT *, row_number() OVER (PARTITION BY user_id, strip ORDER BY support DESC, exact DESC, mean DESC, o) AS z FROM q),
    g AS (SELECT user_id, strip, place - lag(place) OVER (PARTITION BY user_id, strip ORDER BY place) AS g FROM t),
    h AS (SELECT user_id, strip FROM g GROUP BY ALL HAVING count(*) FILTER (g > 1) <= 1 AND coalesce(max(g), 1) <= 2)
    SELECT user_id, strip, text, support FROM z JOIN h USING (user_id, strip) WHERE z = 1 AND support >= 3""",
)
def modal_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.modal_reading(_readings(spark, sf_dir), ["user_id", "strip"], "text", "confidence", "place")


@register(
    "reading_confidence",
    f"WITH {_READINGS} SELECT user_id, strip, CASE WHEN count(*) FILTER (text <> '') = 0 THEN 100 ELSE coalesce(avg(confidence) FILTER (text <> ''), 0) END AS confidence FROM r GROUP BY ALL",
)
def reading_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.reading_confidence(_readings(spark, sf_dir), ["user_id", "strip"], "text", "confidence")


@register("surest_reading", f"WITH {_READINGS} SELECT user_id, strip, text FROM (SELECT *, row_number() OVER (PARTITION BY user_id, strip ORDER BY confidence DESC, place) AS z FROM r) WHERE z = 1")
def surest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.surest(_readings(spark, sf_dir), ["user_id", "strip"], "text", "confidence", "place")


SAMPLES = ("", "I", "x", "ab", "to", "-- -", "- x", "``", "__", "?", "42", "I..", "q -", "ab.", "is.", "well", "□ x", "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", "Format:", "no way")
WORDS = ("to", "is", "no")
_LIST = "['" + "', '".join(SAMPLES) + "']"
_PAIR = "NOT list_contains(['to', 'is', 'no'], lower({}))"


@register(
    "fake_texts",
    rf"""WITH t AS (SELECT event_id, trim({_LIST}[event_id % {len(SAMPLES)} + 1]) AS t FROM events), u AS (SELECT *, regexp_extract(t, '^([A-Za-z])[\s.\-]*$', 1) AS a, regexp_extract(t, '^([A-Za-z][A-Za-z])[\s.\-]*$', 1) AS b FROM t)
    SELECT event_id, t AS text, t <> '' AND (replace(lower(t), ' ', '') LIKE '%layer,start,end,style,name,marginl,marginr,marginv,effect,text%' OR lower(t) = 'format:' OR regexp_full_match(t, '-[\s-]*-+|`+|[0-9]+|_+|[^\w\s]') OR contains(t, '□')
      OR (a <> '' AND a <> 'I') OR (b <> '' AND {_PAIR.format("b")})) AS fake FROM u""",
)
def fake_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("event_id") % len(SAMPLES) + 1).cast("int")).alias("text"))
    return rows.withColumn("fake", text.is_fake("text", WORDS))


_SEGMENT = "trim(regexp_replace(p, '\\{[^}]*\\}', '', 'g'))"
_GARBAGE = rf"({_SEGMENT} = '' OR regexp_full_match({_SEGMENT}, '[0-9]+|[^\w\s]|`+|_+'))"
_STRICT = rf"({_GARBAGE} OR regexp_full_match({_SEGMENT}, '[A-Za-z]') OR (regexp_full_match({_SEGMENT}, '[A-Za-z][A-Za-z]') AND {_PAIR.format(_SEGMENT)}))"


@register(
    "clean_breaks",
    rf"""WITH t AS (SELECT event_id, event_type || CASE WHEN event_id % 7 = 0 THEN '' ELSE '\N' || ['12', '-', 'ab', '', 'x{{\b1}}', '{{\i1}}to', 'fine'][event_id % 7 + 1] || '\N' || ['q', 'is', 'yes'][event_id % 3 + 1] END AS t FROM events)
    SELECT event_id, array_to_string(list_filter(string_split(t, '\N'), lambda p: NOT {_STRICT}), '\N') AS strict, array_to_string(list_filter(string_split(t, '\N'), lambda p: NOT {_GARBAGE}), '\N') AS conservative FROM t""",
)
def clean_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (i % len(x) + 1).cast("int"))
    middle = pick("12", "-", "ab", "", "x{\\b1}", "{\\i1}to", "fine")
    said = F.when(i % 7 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("\\N"), middle, F.lit("\\N"), pick("q", "is", "yes")))
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("t"))
    return rows.select("event_id", text.clean_breaks("t", False, WORDS).alias("strict"), text.clean_breaks("t", True).alias("conservative"))


@register(
    "merge_documents",
    """WITH l AS (SELECT user_id, event_id % CASE WHEN user_id % 5 = 0 THEN 1 ELSE 3 END AS d, event_id AS o, CASE WHEN event_id % 4 = 0 THEN '; note ' || CAST(event_id AS VARCHAR) ELSE
      'Dialogue: 0,0:' || lpad(CAST(event_id * 7 % 60 AS VARCHAR), 2, '0') || ':00.00,0:59:59.00,s,,0,0,0,,' || event_type END AS line, event_id % 4 <> 0 AS said, event_id * 7 % 60 AS m FROM events),
    f AS (SELECT *, min(d) OVER (PARTITION BY user_id) AS d0, max(d) OVER (PARTITION BY user_id) AS d1 FROM l)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN said AND d0 <> d1 THEN 1 ELSE 0 END, CASE WHEN said AND d0 <> d1 THEN m ELSE 0 END, d, o) - 1 AS place, line FROM f WHERE said OR d = d0""",
)
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    said = F.concat(F.lit("Dialogue: 0,0:"), F.lpad((i * 7 % 60).cast("string"), 2, "0"), F.lit(":00.00,0:59:59.00,s,,0,0,0,,"), F.col("event_type"))
    lines = table(spark, sf_dir, "events").select(
        "user_id", (i % F.when(F.col("user_id") % 5 == 0, 1).otherwise(3)).alias("document"), i.alias("ord"), F.when(i % 4 == 0, F.concat(F.lit("; note "), i.cast("string"))).otherwise(said).alias("line")
    )
    return dialogue.merged(lines, ["user_id"])


_BOXES = "b AS (SELECT l_orderkey, l_linenumber AS id, l_linenumber % 3 AS x0, l_linenumber % 2 AS y0, l_linenumber % 3 + l_quantity AS x1, l_linenumber % 2 + l_quantity / 2 AS y1 FROM lineitem)"


@register(
    "box_containment",
    f"WITH {_BOXES} SELECT l_orderkey, a.id AS \"inner\", o.id AS \"outer\" FROM b a JOIN b o USING (l_orderkey) WHERE a.x0 >= o.x0 AND a.y0 >= o.y0 AND a.x1 <= o.x1 AND a.y1 <= o.y1 AND a.id <> o.id",
)
def box_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_linenumber"), F.col("l_quantity")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", k.alias("id"), (k % 3).alias("x0"), (k % 2).alias("y0"), (k % 3 + q).alias("x1"), (k % 2 + q / 2).alias("y1"))
    return tables.contained(boxes, boxes, ["l_orderkey"], "id")


@register("bulk_targets", "SELECT n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS place FROM nation WHERE n_nationkey = 7 OR n_regionkey <> 2")
def bulk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bulk_targets(table(spark, sf_dir, "nation"), F.col("n_nationkey") == 7, F.col("n_regionkey") == 2, "n_name").select("n_nationkey", "place")


@register("ordered_times", "SELECT user_id, array_to_string(list_sort(list(DISTINCT epoch_us(ts) // 86400000000)), ',') AS days FROM events GROUP BY user_id")
def ordered_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / (1440 * MINUTE)).alias("day"))
    return tables.ordered_times(days, ["user_id"], "day").select("user_id", F.array_join(F.transform("times", lambda x: x.cast("string")), ",").alias("days"))
