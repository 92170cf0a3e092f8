"""Hand cases of the rules for skipped spans, readings, texts and documents."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import shared, text
from tessera.operators import fingerprints, spans, summaries
from tessera.sources import dialogue


def ranges(spark, rows, **more):
    df = spark.createDataFrame([(1, float(a), float(b), float(d)) for a, b, d in rows], "f long, start double, end double, d double")
    out = spans.keep_ranges(df, ["f"], "d", **more).orderBy("keep_start").collect()
    return [(r.from_text, r.to_text) for r in out]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(0, 20, 100), (23, 90, 100)], [("01:30", None)]),  # three seconds are too short
        ([(10, 20, 100)], [(None, "00:10"), ("00:20", None)]),
        ([(0, 5, 9), (5, 9, 9)], []),
        ([(4.9, 50, 54.9)], []),
        ([(5, 50, 55)], [(None, "00:05"), ("00:50", None)]),
        ([(30, 6100, 0)], [(None, "00:30")]),  # no known duration, no tail
        ([(30, 6100, 7000)], [(None, "00:30"), ("101:40", None)]),
        ([(40, 60, 100), (10, 50, 100)], [(None, "00:10"), ("01:00", None)]),
    ],
)
def test_keep_ranges(spark, rows, expected):
    assert ranges(spark, rows) == expected


def test_recurring_gaps_are_closed(spark):
    files = {1: [(0, 10), (20, 30)], 2: [(1, 11), (21, 31)], 3: [(0, 100)], 4: [(0, 10), (60, 70)]}
    rows = [("g", f, float(a), float(b)) for f, v in files.items() for a, b in v]
    df = spark.createDataFrame(rows, "g string, f long, start double, end double")
    out = {}
    for r in spans.bridged(df, ["g"], "f").collect():
        out.setdefault(r.f, set()).add((r.start, r.end))
    assert out == {1: {(0, 30)}, 2: {(1, 31)}, 3: {(0, 100)}, 4: {(0, 10), (60, 70)}}
    alone = spans.bridged(df.where("f in (1, 3, 4)"), ["g"], "f").where("f = 1").count()
    assert alone == 2  # one file is not enough


def strip(spark, readings):
    df = spark.createDataFrame([(1, k, t, c) for k, (t, c) in enumerate(readings)], "k long, place long, text string, conf double")
    return [r.text for r in summaries.modal_reading(df, ["k"], "text", "conf", "place").collect()]


def test_modal_reading(spark):
    assert strip(spark, [("hello", 0.9)] * 3) == ["hello"]
    assert strip(spark, [("hello", 0.9)] * 2) == []
    assert strip(spark, [("abcdef", 0.5), ("abcdef", 0.5), ("abf", 0.9), ("zz", 1.0)]) == ["abcdef"]  # a part with letters dropped supports
    assert strip(spark, [("hello", 0.9), ("", 0.0), ("hello", 0.9), ("hello", 0.9)]) == ["hello"]
    assert strip(spark, [("hello", 0.9), ("", 0.0), ("", 0.0), ("hello", 0.9), ("hello", 0.9)]) == []
    assert strip(spark, [("hello", 0.9), (None, 0.0), ("hello", 0.9), ("", 0.0), ("hello", 0.9)]) == []
    assert strip(spark, [("abc", 0.5), ("abd", 0.9), ("abc", 0.5), ("abd", 0.9)]) == ["abd"]  # equal votes: the surer


def test_reading_confidence(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0), (2, "", 0.3), (3, "x", None)], "k long, text string, c double")
    assert {r.k: r.confidence for r in summaries.reading_confidence(df, ["k"], "text", "c").collect()} == {1: 0.75, 2: 100.0, 3: 0.0}


def test_breaks(spark):
    df = spark.createDataFrame([("a1\\N12\\Nok",), ("{\\i1}-\\Nsee",), ("12",), ("1\\N2",), ("xy\\Nto\\Ngo",)], "t string")
    out = df.select(text.clean_breaks("t", False, ["to", "go"]).alias("a"), text.clean_breaks("t", True).alias("b")).collect()
    assert [r.a for r in out] == ["a1", "see", "12", "", "to\\Ngo"]
    assert [r.b for r in out] == ["a1\\Nok", "see", "12", "", "xy\\Nto\\Ngo"]


def test_documents_as_one(spark):
    said = lambda m, t: f"Dialogue: 0,0:{m:02d}:00.00,0:59:00.00,s,,0,0,0,,{t}"
    rows = [(1, 0, 0, "[head]"), (1, 0, 1, said(9, "c")), (1, 0, 2, said(1, "a")), (1, 1, 0, "[other]"), (1, 1, 1, said(1, "b")), (2, 5, 0, said(9, "z")), (2, 5, 1, said(1, "y"))]
    df = spark.createDataFrame(rows, "k long, document long, ord long, line string")
    out = [(r.k, r.line) for r in dialogue.merged(df, ["k"]).orderBy("k", "place").collect()]
    assert out == [(1, "[head]"), (1, said(1, "a")), (1, said(1, "b")), (1, said(9, "c")), (2, said(9, "z")), (2, said(1, "y"))]


def test_whole_numbers_of_any_length(spark):
    df = spark.createDataFrame([("000123",), ("9" * 40,), ("0",), ("-1",), ("",), ("000",)], "t string")
    assert [r[0] for r in df.select(text.count_or_zero("t")).collect()] == ["123", "9" * 40, "0", "0", "0", "0"]


def test_shingles_equal_plain_ones(spark):
    words = [f"w{k % 7}" for k in range(30)]
    df = spark.createDataFrame([(1, "  ".join(words)), (2, "a b c"), (3, None), (4, ""), (5, "a b c d e")], "id long, text string")
    got = fingerprints.shingles(df, "id", "text", 5, shown=True).collect()
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {(r.id, r.pos, r.hash) for r in got} == {(1, p, md5(" ".join(words[p : p + 5]))) for p in range(26)} | {(5, 0, md5("a b c d e"))}
    first = fingerprints.shingles(df, "id", "text", 5).where("id = 1").groupBy("hash").agg(F.collect_set("pos").alias("p")).collect()
    assert sorted(sorted(r.p) for r in first) == sorted([p for p in range(26) if p % 7 == m] for m in range(7))


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_content_keys(spark, tmp_path):
    import hashlib

    from tessera.sources import media

    big = bytes(range(256)) * 12_000
    for name, data in (("a", b"abc"), ("b", big), ("c", b""), ("moved", big)):
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a", "b", "c", "moved", "missing")] + [(None,)], "path string")
    got = {r.path and r.path.rsplit("/", 1)[1]: r.key for r in media.content_keys(paths).collect()}
    plain = lambda d: hashlib.blake2b(len(d).to_bytes(8, "little") + d[: 1 << 20] + d[-(1 << 20) :], digest_size=16).hexdigest()
    assert got == {"a": plain(b"abc"), "b": plain(big), "c": plain(b""), "moved": plain(big), "missing": None, None: None}


def test_stacked_boxes(spark):
    from tessera.operators import boxes

    rows = [(1, 0, 0.0, 0.0, 10.0, 40.0), (1, 1, 12.0, 0.0, 22.0, 10.0), (1, 2, 12.5, 12.0, 22.5, 22.0), (1, 3, 12.0, 40.0, 52.0, 50.0), (1, 4, 80.0, 0.0, 90.0, 10.0), (2, 0, 12.0, 0.0, 22.0, 10.0), (2, 1, 12.0, 12.0, 22.0, 22.0)]
    df = spark.createDataFrame(rows, "f long, id long, x0 double, y0 double, x1 double, y1 double")
    out = {(r.f, r.id): (r.n_boxes, r.y0, r.y1) for r in boxes.stacked(df, ["f"], "id", 200).collect()}
    assert out == {(1, 0): (1, 0, 40), (1, 1): (2, 0, 22), (1, 3): (1, 40, 50), (1, 4): (1, 0, 10), (2, 0): (1, 0, 10), (2, 1): (1, 12, 22)}


def test_nearest_equals_all_pairs(spark):
    """Ties of exact and of rounded distances, cells' borders, missing and infinite places, null keys, a centre twice."""
    import math
    import random

    from tessera.operators import tables

    rng, inf, nan = random.Random(3), float("inf"), float("nan")
    odd = [None, nan, inf, -inf, 0.0, -0.0, -1e-20, 500.0, 1000.0, 499.99999999999994, 1e17, 1e300]
    places = odd + [round(rng.uniform(-3000, 3000), 1) for _ in range(150)]
    centres = [(k % 2, 900 - k, x) for k, x in enumerate(odd + [0.1 + 0.2, 0.3, 0.3, -700.0, -500.0] * 2 + [round(rng.uniform(-9000, 3000), 1) for _ in range(40)])] + [(None, 1, 5.0), (3, 2, None)]
    points = [(k, n, x) for n, (k, x) in enumerate([(k, x) for k in (0, 1, 2, 3, None) for x in [*places, 100.3, -99.7, -600.0]])]

    def plain(k, x):
        near = [(abs(c - x), i) for g, i, c in centres if g == k and k is not None and None not in (c, x) and math.isfinite(c) and math.isfinite(x)]
        return next((i for d, i in sorted(near)[:1] if d <= 500), None)

    got = tables.nearest(spark.createDataFrame(points, "k int, n int, x double"), spark.createDataFrame(centres, "k int, i int, c double"), ["k"], "x", "c", "i", 500).collect()
    want = {n: plain(k, x) for k, n, x in points}
    assert len(got) == len(points) and {r.n: r.centre for r in got} == want and len(set(want.values())) > 30


def test_stop_hashes_shuffle_only_what_may_be_common(spark, monkeypatch):
    """Rare hashes are not shuffled one by one; repeated rows of an id count once, whatever bucket they fall in."""
    monkeypatch.setattr(fingerprints, "BUCKETS", 1024, raising=False)
    rows = spark.range(200_000).select((F.col("id") % 400).alias("doc"), (F.col("id") * 7919).alias("hash"))
    common = spark.range(400).select(F.col("id").alias("doc"), F.explode(F.array(*[F.lit(-k).cast("bigint") for k in (1, 2, 3)])).alias("hash"))
    often_in_few = spark.range(3000).select((F.col("id") % 10).alias("doc"), F.lit(-4).cast("bigint").alias("hash"))
    out = fingerprints.stop_hashes(rows.unionByName(common).unionByName(often_in_few).unionByName(common), "doc", 0.9)
    assert sorted((r.hash, r.df) for r in out.collect()) == [(-3, 400), (-2, 400), (-1, 400)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "pmod(xxhash64(hash" in plan and "BroadcastHashJoin" in plan
