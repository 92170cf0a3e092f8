"""Dialogue files: read, parse, write, read again."""

from pyspark.sql import functions as F

from tessera.functions import clock, text
from tessera.sources import dialogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_parse(spark):
    p = one(spark, dialogue.parsed(F.lit("Dialogue: 0,0:00:01.00,0:01:02.50,Default,,0,0,0,,Hello, you, there")))
    assert (p.text, p.start_cs, p.end_cs, p.style) == ("Hello, you, there", 100, 6250, "Default")
    assert one(spark, dialogue.parsed(F.lit("Dialogue: 0,1,2"))) is None
    assert one(spark, dialogue.parsed(F.lit("Dialogue: 0,x,0:01:02.50,D,,0,0,0,,t"))).start_cs is None


def test_round_trip(spark, tmp_path):
    rows = [("a", 100, 250, "Default", "one, two\nthree"), ("a", 50, 90, "Default", "first"), ("b", 0, 1, "Sign", "x")]
    df = spark.createDataFrame(rows, "document string, start_cs long, end_cs long, style string, text string")
    dialogue.write(df.withColumn("line", dialogue.rendered("start_cs", "end_cs", "style", "text")), str(tmp_path / "out"))
    back = dialogue.events(spark, str(tmp_path / "out" / "document=a")).orderBy("ord").collect()
    assert [(r.start_cs, r.end_cs, r.text, r.shown) for r in back] == [(50, 90, "first", "first"), (100, 250, r"one, two\Nthree", "one, two three")]
    assert {r.section for r in dialogue.read(spark, str(tmp_path / "out" / "document=b")).collect()} == {"Script Info", "Events"}


def test_expressions(spark):
    assert one(spark, text.visible_text(F.lit(r"{\pos(1,2)}a\N b\h\hc "))) == "a b c"
    assert one(spark, text.undoubled(F.lit("abab"))) == "ab" and one(spark, text.undoubled(F.lit("aa"))) == "aa"
    assert one(spark, text.count_or_zero(F.lit("007"))) == "7" and one(spark, text.count_or_zero(F.lit("-1"))) == "0"
    assert one(spark, text.safe_tag(F.lit("--!!"))) == "zh" and one(spark, text.stem(F.lit("/a/b.c.mkv"))) == "b.c"
    assert one(spark, clock.centis_of_code(F.lit("1:02:03.04"))) == 372_304 and one(spark, clock.centis_of_code(F.lit("1:2:3"))) is None
    assert one(spark, clock.seconds_of_clock(F.lit("1:00:05"))) == 3605 and one(spark, clock.seconds_of_clock(F.lit("x:1"))) is None
    assert one(spark, clock.code_of_centis(F.lit(-5))) == "0:00:00.00"
