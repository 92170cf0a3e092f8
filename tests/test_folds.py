"""Folds on small hand cases; test_oracles and test_twins hold them against other versions on the tables."""

import harness
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import folds, graph


def test_distance_and_ratio():
    assert folds.distance("kitten", "sitting") == 3 and folds.distance("", "ab") == 2
    assert folds.indel_ratio("this is a test", "this is a test!") == 97 and folds.indel_ratio("", "") == 100 and folds.indel_ratio("a", "b") == 0


def row(start, end, text, **more):
    return {"start": start, "end": end, "text": text} | more


def test_merge_consecutive():
    fold = folds.merge_consecutive(50, 25, 5)
    assert [r["n_rows"] for r in fold([row(0, 100, "hello"), row(140, 200, "hello"), row(260, 300, "hello")])] == [2, 1]
    assert [r["n_rows"] for r in fold([row(0, 100, "hello"), row(100, 120, "hallo")])] == [2]
    assert [r["n_rows"] for r in fold([row(0, 100, "hello"), row(100, 140, "hallo")])] == [1, 1]
    assert [(r["end"], r["n_rows"]) for r in fold([row(0, 500, "x"), row(100, 200, "x")])] == [(200, 2)]
    assert [(r["text"], r["n_rows"]) for r in fold([row(0, 100, "{\\b1}hello"), row(100, 200, "hello")])] == [("{\\b1}hello", 2)]
    # a short first row hands its text over; a short next one does not
    assert [r["text"] for r in fold([row(0, 4, "hello wqrld"), row(4, 100, "hello world")])] == ["hello world"]
    assert [r["text"] for r in fold([row(0, 100, "hello world"), row(100, 104, "hello wqxld")])] == ["hello world"]
    assert len(fold([row(0, None, "x"), row(0, 5, "x")])) == 2
    styled = folds.merge_consecutive(50, 25, 5, ["style"])
    assert len(styled([row(0, 9, "x", style="A"), row(9, 20, "x", style="B")])) == 2


def test_merge_alternating():
    fold = folds.merge_alternating()
    texts = lambda letters: [row(k, k + 1, f"line {t}") for k, t in enumerate(letters)]
    assert [(r["text"], r["n_rows"]) for r in fold(texts("ABABCC"))] == [("line A", 4), ("line C", 1), ("line C", 1)]
    assert [r["n_rows"] for r in fold(texts("ABCAB"))] == [1, 1, 1, 1, 1]
    assert [r["n_rows"] for r in fold([row(0, 1, "A"), row(1, 2, "B"), row(2, 3, "A")])] == [1, 1, 1]  # no variants
    apart = texts("ABA")
    apart[2]["start"] = 5
    assert len(fold(apart)) == 3


def test_merge_readings_follows_the_surest_text():
    rows = [row(0, 1, "hello world", confidence=0.5), row(1, 2, "hello worId", confidence=0.9), row(2, 3, "something else", confidence=0.9)]
    out = folds.merge_readings(5, 80)(rows)
    assert [(r["text"], r["n_rows"]) for r in out] == [("hello worId", 2), ("something else", 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 20)), max_size=25))
def test_suppression(points):
    rows = [{"at": a, "value": v} for a, v in points]
    kept = folds.suppress(5, 100)(rows)
    at = [r["at"] for r in kept]
    assert at == sorted(at) and all(b - a > 5 for a, b in zip(at, at[1:], strict=False))
    assert all(any(abs(r["at"] - k["at"]) <= 5 and k["value"] >= r["value"] for k in kept) for r in rows)


def test_spread_order():
    assert [r["at"] for r in folds.spread_order([{"at": a} for a in (0, 1, 5, 10)])] == [0, 10, 5, 1]


def test_gap_clusters():
    rows = [{"middle": m, "f": f, "at": m} for m, f in ((0, 1), (6, 2), (9, 1), (12, 3), (25, 2))]
    assert [r["cluster"] for r in folds.gap_clusters(10, "f")(rows)] == [0, 0, 1, 1, 2]


def test_online_clusters_and_fixpoint():
    out = folds.online_clusters(2, 100)([{"at": k, "x": x} for k, x in enumerate([1, 2, 9, 1.5, 8])])
    assert sorted(c["n_rows"] for c in out) == [2, 3]
    spans = [{"start": 0, "end": 10, "x": 0}, {"start": 4, "end": 14, "x": 1}, {"start": 12, "end": 22, "x": 0}, {"start": 50, "end": 60, "x": 0}]
    assert [s["n_rows"] for s in folds.drop_duplicates_to_fixpoint(5)(spans)] == [2, 1, 1]


def test_tracker():
    rows = [{"at": k, "x": x} for k, x in enumerate([1, 1, 1, 1, 50, 50])]
    kinds = [o["kind"] for o in folds.track(2, 2, 1)(rows)]
    assert kinds == ["frame", "extend", "candidate", "extend", "done", "frame", "extend", "done"]


def test_tracker_state_survives_a_break():
    rows = [(k, x) for k, x in enumerate([1, 1, 30, 30, 30, 2])]
    one, out = folds.Tracker(3, 2, 8), []
    for r in rows:
        out += one.feed(*r)
    again, state = [], None
    for r in rows:
        machine = folds.Tracker(3, 2, 8, state)
        again += machine.feed(*r)
        state = machine.state
    assert again == out


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in graph.components(edges, "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("name", ["merge_consecutive_full", "merge_alternating", "online_cluster", "dup_fixpoint"])
def test_folds_cover_all_rows(spark, name):
    from tessera.plans import catalog
    from tessera.plans.rows import events

    out = catalog.queries()[name](spark, harness.DATA)
    assert out.agg({"n_rows": "sum"}).first()[0] == events(spark, harness.DATA).count()


def test_a_call_folds_many_small_keys(spark):
    """Keys cost no call of their own; a key goes on over batches; missing numbers compare to nothing; null keys are one."""
    rows = [(k // 3 if k < 60 else None, k, None if k % 7 == 0 else float(k % 5), f"t{k}") for k in range(64)] + [(100, k, 1.0, None) for k in range(25)]
    df = spark.createDataFrame(rows, "g long, at long, x double, t string")
    seen = lambda held: [{"n": len(held), "places": ",".join(str(r["at"]) for r in held), "x": held[0]["x"], "near": sum(abs(r["x"] - 1) <= 1 for r in held), "t": held[-1]["t"]}]
    out = folds.run(df, ["g"], ["at"], seen, "g long, n int, places string, x double, near int, t string")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r.g: tuple(r)[1:] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for g in {r[0] for r in rows}:
        held = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        want[g] = (len(held), ",".join(str(r[1]) for r in held), held[0][2], sum(r[2] is not None and abs(r[2] - 1) <= 1 for r in held), held[-1][3])
    assert got == want
    assert folds.run(df.where("false"), ["g"], ["at"], seen, "g long, n int, places string, x double, near int, t string").count() == 0


def test_places_in_a_few_large_keys(spark):
    from pyspark.sql import functions as F

    from tessera.operators import ordered

    df = spark.range(3000).select(F.when(F.col("id") % 5 < 3, "a").when(F.col("id") % 5 == 3, "b").alias("k"), ((F.col("id") * 7919) % 3001).alias("x"))
    rows = sorted(((r.k, r.x) for r in df.collect()), key=str)
    places = {}
    for k in ("a", "b", None):
        held = sorted(x for g, x in rows if g == k)
        places |= {(k, x): (n, len(held)) for n, x in enumerate(held)}
    assert {(r.k, r.x): (r["__i"], r["__n"]) for r in ordered.placed(df, ["k"], ["x"], 7).collect()} == places
