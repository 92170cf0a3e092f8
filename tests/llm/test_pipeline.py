"""The pipeline's stages, each on its own input, and the registered queries."""

import brute
import corpus_pipeline
import pytest

from tessera.llm import mixing, queries, quality, secrets

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, docs, tmp_path_factory):
    """The input of each stage and the last result, written and read again."""
    out, base = [docs], tmp_path_factory.mktemp("stages")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], DATA).write.parquet(str(base / str(k)))
        out.append(spark.read.parquet(str(base / str(k))))
    return out


def test_columns(kept):
    assert all(df.columns == COLUMNS for df in kept[:-1])


def test_quality_stage(kept, docs, labels):
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept[1].collect()} == good
    truth = {r.doc_id: r.quality for r in labels.collect()}
    clean = [i for i in truth if truth[i] == 1]
    assert sum(i in good for i in clean) >= 0.95 * len(clean)


def test_near_duplicate_stage(kept):
    sets = {r.doc_id: brute.shingles(r.text) for r in kept[1].collect()}
    comp = brute.components(sets, brute.jaccard_links(sets))
    assert {r.doc_id for r in kept[2].collect()} == set(comp.values())


def test_secret_stage(kept):
    before = {r.doc_id: r.text for r in kept[2].collect()}
    after = {r.doc_id: r.text for r in kept[3].collect()}
    assert before.keys() == after.keys()
    assert all((after[i] == t) == (not secrets.spans_of(t)) for i, t in before.items())


def test_mixing_stage(kept):
    slot = {r.doc_id: (r["__slot"], r["__start"]) for r in mixing.mix(kept[3]).collect()}
    assert {r.doc_id for r in kept[4].collect()} == set(slot)
    order = [slot[r.doc_id] for r in kept[4].collect()]
    assert sum(a > b for a, b in zip(order, order[1:], strict=False)) <= kept[4].rdd.getNumPartitions()


def test_token_stage(kept):
    assert {r.doc_id for r in kept[5].collect()} == {r.doc_id for r in kept[4].collect()}


def test_run_equals_its_stages(spark, kept):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(kept[-1])


def test_each_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{k}" for k in range(1, 11)] and names[10] == "pipeline"


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


def test_stages_on_odd_rows(spark, odd):
    rows = odd.select(COLUMNS)
    for _, f in corpus_pipeline.STAGES:
        rows_out = f(spark, rows, DATA)
        assert rows_out.count() <= odd.count()
