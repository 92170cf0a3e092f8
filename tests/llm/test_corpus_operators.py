"""Operators that bring texts or rows together, against plain versions."""

import os
import random
from collections import Counter

import brute
import numpy as np
import pytest

from tessera.llm import embedding, mixing, ngram_join, shard, spark_util, substring
from tessera.llm.spark_util import Stage, connected_components


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def check_join(df):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect()]
    texts = {}
    for r in df.collect():
        if r.doc_id is not None:
            texts[r.doc_id] = r.text
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    comp = brute.components(sets, brute.jaccard_links(sets))
    assert Counter(g for g in got if g[0] is not None) == Counter((r.doc_id, len(sets[r.doc_id]), comp[r.doc_id]) for r in df.collect() if r.doc_id is not None)
    assert len(got) == df.count()
    return comp


def test_join_on_documents_and_odd_rows(docs, odd):
    check_join(docs.select("doc_id", "text"))
    check_join(odd)


@pytest.mark.parametrize("chunk", [512, 16])
def test_join_on_a_large_group_of_near_copies(spark, monkeypatch, chunk):
    """Copies with more and more edits: some pairs link, some do not, and hubs alone would not tell."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng, base, rows = random.Random(5), words(120, 1), []
    for i in range(260):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(10**9)}"
        rows.append((i * 3, " ".join(t)))
    rows += [(10_000 + i, " ".join(words(60, 100 + i))) for i in range(40)]
    comp = check_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(Counter(comp.values()).values()) > 50


def test_join_with_shingles_dealt_by_class(spark, monkeypatch):
    """Small limits: a passage in a third of the texts, and near copies, outgrow a part."""
    monkeypatch.setattr(ngram_join, "PART_ENTRIES", 40)
    monkeypatch.setattr(ngram_join, "FLUSH_ENTRIES", 2_000)
    rng, line, base, rows = random.Random(6), words(20, 50), words(60, 51), []
    for i in range(150):
        t = [*words(30, 1000 + i), *(line if i % 3 == 0 else [])] if i % 2 else list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, " ".join([*line, *words(3, 3000 + i)])) for i in range(30)]
    comp = check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert max(Counter(comp.values()).values()) > 30


def test_join_at_the_threshold(spark):
    a = [f"a{k}" for k in range(16)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1])), (3, " ".join([*a, "z1", "z2"])), (4, " ".join([*a, "y1", "y2", "y3", "y4"])), (5, "one two"), (6, "ONE two")]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sets_that_share_a_number(spark):
    rows = [(1, 2, 7, 70), (2, 2, 7, 70), (3, 2, 7, 71), (4, 2, 8, 72), (5, 0, None, None)]
    assert ngram_join.shared_numbers(spark.createDataFrame(rows, "doc_id long, n_shingles long, cls long, alt long")) == {7}
    a, b = np.array([1, 2], np.uint64), np.array([1, 3], np.uint64)
    alike = frozenset({ngram_join._class_of(a)})
    assert ngram_join._class_number(a, alike) == ngram_join._class_of(a, 1) != ngram_join._class_of(a)
    assert ngram_join._class_number(b, alike) == ngram_join._class_of(b)


def test_keepers_of_repeated_ids(spark):
    """No text is lost because its doc_id also stands on a copy of another document."""
    t, u = " ".join(words(30, 1)), " ".join(words(30, 2))
    rows = [(1, t), (2, t), (2, u), (3, u), (None, t), (4, None), (4, t)]
    kept = ngram_join.near_duplicate_keepers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, t), (2, t), (2, u), (None, t), (4, None), (4, t)])


def test_staged_tables_go(spark, docs, tmp_path):
    mark = spark_util.stages_made()
    ngram_join.ngram_join(docs).write.parquet(str(tmp_path / "out"))
    made = spark_util._MADE[mark:]
    folders = [s.base.removeprefix("file://") for s in made]
    assert made and all(sorted(x.split("-")[0] for x in os.listdir(f)) == ["classes", "members"] for f in folders)
    spark_util.drop_since(mark)
    assert spark_util.stages_made() == mark and not any(os.path.exists(f) for f in folders)


def test_join_empty(none):
    assert ngram_join.ngram_join(none).count() == 0
    assert ngram_join.near_duplicate_keepers(none).columns == none.columns


@pytest.mark.parametrize("most", [500_000, 40])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(spark_util, "TASK_EDGES", most)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in connected_components(df, Stage(spark, "t")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == brute.components(nodes, [e for e in edges if e[0] != e[1]])


def test_substring_finds_planted_passages(spark, odd, none):
    rng, rows, passage = random.Random(7), [], [words(51, 900 + k) for k in range(20)]
    for i in range(120):
        w = words(150, i)
        if i < 40:
            at = rng.randrange(len(w))
            w = [*w[:at], *passage[i % 20], *w[at:]]
        rows.append((i, " ".join(w)))
    got = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(40))
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.stop].strip() in " ".join(passage[r.doc_id % 20]) and r.first_doc_id == r.doc_id % 20 for r in got)
    assert substring.repeated_spans(none).count() == 0
    found = {r.doc_id for r in substring.repeated_spans(odd).collect()}
    assert {1, 2} <= found and not found & {4, 5, 6, 7, 8}


def plain_spans(rows):
    """Spans of chunks (by their very bytes) that stand elsewhere, too; the rows in their order."""
    split, holders = [], {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        at = substring.cuts(np.frombuffer(b, np.uint8), np.array([0, len(b)])).tolist() if b else []
        split.append([b[x:y] for x, y in zip(at, [*at[1:], len(b)], strict=False)])
        for c in split[-1]:
            holders.setdefault(c, []).append(k)
    out = []
    for k, pieces in enumerate(split):
        run, pos = [], 0
        for c in [*pieces, None]:
            if c is not None and len(holders[c]) > 1:
                run.append((pos, c))
            elif run:
                ids = [rows[h][0] for _, x in run for h in holders[x]]
                stop = run[-1][0] + len(run[-1][1].decode())
                first = min((i for i in ids if i is not None), default=None)
                out.append((rows[k][0], run[0][0], stop, len(run), first, any(holders[x][0] != k for _, x in run)))
                run = []
            pos += len((c or b"").decode())
    return out


def test_substring_equals_plain_chunks(spark, docs, odd_rows):
    """All columns but n_words, against dictionaries of whole chunks instead of digests."""
    held = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(200).collect()] + [(i and i + 10**6, t) for i, t in odd_rows]
    df = spark.createDataFrame(held, "doc_id long, text string").coalesce(1)
    found = substring.repeated_spans(df, min_words=0).collect()
    got = Counter((r.doc_id, r.start, r.stop, r.n_chunks, r.first_doc_id, r.is_copy) for r in found)
    assert got == Counter(plain_spans(held))
    text = {i: t for i, t in held}
    for r in found:  # words that begin inside
        if r.doc_id not in (None, 10**6 + 2):
            assert r.n_words == sum(r.start <= m.start() < r.stop for m in brute.WORD.finditer(text[r.doc_id]))


def test_substring_cut_out(spark):
    p = " ".join(words(80, 3))
    rows = [(1, " ".join(words(60, 4)) + " " + p), (2, p + " " + " ".join(words(60, 5))), (3, None)]
    out = {r.doc_id: r.text for r in substring.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[3] is None and len(out[2]) < len(rows[1][1]) - 200


def test_cuts_follow_the_content():
    text = " ".join(words(400, 8)).encode()
    moved = b"inserted bytes " + text
    at = lambda t: set(substring.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)])).tolist())
    a, b = at(text), {x - 15 for x in at(moved)}
    assert len({x for x in a if x > 80} ^ {x for x in b if x > 80}) == 0 and len(a) > 20


def check_mixture(df, block_bytes, **options):
    """Each block in its window by the target weights, each slot taken at most once."""
    out = mixing.mix(df, block_bytes=block_bytes, **options).select("__source", "__bytes", "__block", "__slot", "__start").collect()
    assert len(out) == df.count()
    size, slots = Counter(), {}
    for r in out:
        size[r["__source"]] += r["__bytes"]
        assert slots.setdefault((r["__source"], r["__block"]), r["__slot"]) == r["__slot"] and r["__start"] // block_bytes == r["__block"]
    given, other = options.get("weights", mixing.WEIGHTS), options.get("default_weight", mixing.DEFAULT_WEIGHT)
    weight = {s: given.get(s[1:], other) if s[0] == "=" else other for s in size}
    blocks = {s: -(-n // block_bytes) for s, n in size.items()}
    for (s, i), at in slots.items():
        first, due = brute.window(weight, blocks, s, i)
        assert first <= at < due
    assert len(set(slots.values())) == len(slots)
    return weight, {at: s for (s, _), at in slots.items()}


@pytest.mark.parametrize("block_bytes", [1 << 12, 1 << 20])
def test_mixing(docs, odd, block_bytes):
    for df in (docs, odd):
        check_mixture(df, block_bytes)


def test_mixing_keeps_to_the_target_weights(spark):
    """Equal supplies: the weights show at every slot, until a source is empty and then for the rest."""
    rows = [(k, "x" * 63, f"src{k % 4}") for k in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight, at = check_mixture(df, 64, weights={"src0": 200, "src1": 80, "src2": 20}, default_weight=40)
    order = [at[k] for k in range(1600)]
    assert brute.most_deviation(weight, order) < 2  # less than one, and what an ending source was ahead
    seen = Counter()
    for k, s in enumerate(order[:600]):  # before the first source is empty
        seen[s] += 1
        assert all(abs(seen[x] - (k + 1) * w / 340) < 1 for x, w in weight.items())


def test_mixing_many_sources_and_clashing_names(spark):
    rows = [(k, "y" * (k % 50), f"s{k % 600}") for k in range(3000)]
    check_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), 32, weights={"s0": 30, "s1": 7}, default_weight=3)
    names = ["name", "bytes", "h", "bucket", "buckets", "start", "slot", "block", "c0", "c1", "off", "inside", "__slot", "__start", "_o0"]
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, None), (2, "", "s")], "doc_id long, text string, source string").selectExpr("*", *[f"7 AS {n}" for n in names])
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "__source", "__bytes", "__block", "___slot", "___start"] and out.count() == 3
    assert Counter(map(str, mixing.mixed_order(df).collect())) == Counter(map(str, df.collect()))


def test_mixing_edges(none, docs):
    assert mixing.mix(none).count() == 0 and mixing.mixed_order(docs).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"src0": 0})


def test_shards(docs, odd, none):
    import zlib

    for df in (docs, odd):
        out = shard.shard(df).collect()
        sent = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == sent
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
        counts = [len(slots.get(k, [])) for k in range(24)]
        assert max(counts) - min(counts) <= 1 and all(r.law == "rows" and r.grown_shard is None for r in out)
    assert shard.shard(none).count() == 0


def test_shards_are_a_function_of_data_and_seed(spark, docs):
    places = lambda df, seed=1: sorted((r.shard, r.slot, r.doc_id) for r in shard.shard(df, seed=seed).collect())
    first = places(docs)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert places(docs.repartition(7)) == first
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(a == b for a, b in zip(first, places(docs, 2), strict=True)) < len(first) / 10


def test_fisher_yates_equals_a_plain_one(spark):
    """The fold that shuffles a cell, with the same draws in a plain loop."""
    rows = spark.range(40).selectExpr("cast(id as int) as n", "id * 7 as bucket", "id * 3 as cell")
    draws = "transform(sequence(0, n), i -> if(i > 0, cast(pmod(xxhash64(bucket, cell, i, 5L), i + 1) as int), 0))"
    for r in rows.selectExpr("n", f"{shard._FISHER_YATES.format(seed=5)} as order", f"{draws} as draws").where("n > 0").collect():
        plain = list(range(r.n))
        for i in range(r.n - 1, 0, -1):
            j = r.draws[i]
            plain[i], plain[j] = plain[j], plain[i]
        assert r.order == plain


def test_shards_scatter_repeated_rows(spark):
    """One row in most places: its copies go to all shards, and no cell holds them all."""
    df = spark.range(40).selectExpr("id as doc_id", "concat('t', id) as text").union(spark.range(2000).selectExpr("7L", "'same'")).union(spark.range(70).selectExpr("cast(null as long)", "cast(null as string)"))
    out = shard.shard(df).collect()
    found = {}
    for r in out:
        found.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert len(out) == 2110 and all(sorted(s for s, _ in v) == list(range(len(v))) for v in found.values())
    same = [sum(i == 7 for _, i in v) for v in found.values()]
    assert len(same) == 24 and min(same) > 60


def test_shard_files(spark, docs, odd, tmp_path):
    for name, df in (("docs", docs), ("odd", odd.select("doc_id", "text"))):
        shard.write(df, str(tmp_path / name), shards=4)
        back = spark.read.parquet(str(tmp_path / name))
        key = lambda r: (r.doc_id, r.shard, r.slot)
        assert Counter(map(key, back.collect())) == Counter(map(key, shard.shard(df, 4).collect()))
        assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in df.collect())
    for f in (tmp_path / "docs").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    x = np.concatenate([rng.normal(size=(300, 16)), *(c + rng.normal(size=(k, 16)) * 0.22 for k, c in enumerate(centre))])
    x = np.concatenate([x, x[:3], x[:3]])
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    odd = [(5001, None), (5003, []), (5005, [0.0] * 16), (5007, [1.0, None] + [0.0] * 14), (5009, [float("nan")] * 16), (5011, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS cls", "3 AS v", "4 AS w")
    got = {r.vec_id: r for r in embedding.near_dedup(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    links = near.sum(1) - 1
    found = np.array([got[i * 2].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum() > 0
    comp = brute.components([i * 2 for i in range(len(x))], [(2 * a, 2 * b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert sum(comp[i] == got[i].component_id for i in comp) >= 0.97 * len(comp)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [60, 6000])
def test_counts_and_components_agree(spark, monkeypatch, most):
    """Shards cut into blocks, several homes: each link counts for both ends or for none, and joins them."""
    monkeypatch.setattr(embedding, "SHARD_MOST", most)
    monkeypatch.setattr(embedding, "SHARD_SIZE", 40)
    rng = np.random.default_rng(9)
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.2 for c in rng.normal(size=(3, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    links = near.sum(1) - 1
    got = sorted(embedding.near_dedup(df).collect(), key=lambda r: r.vec_id)
    n = np.array([r.n_links for r in got])
    assert (n <= links).all() and n.sum() >= 0.97 * links.sum() > 0 and n.sum() % 2 == 0
    size = Counter(r.component_id for r in got)
    assert all((r.n_links > 0) == (size[r.component_id] > 1) for r in got)


def test_graph_is_pruned_and_connected_enough():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = embedding.build_graph(x)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(b.tolist(), a.tolist(), strict=True)) and (a != b).all()
    s = x @ x.T
    for i in range(0, 500, 50):  # a plain pruning of one row's candidates
        cand = np.array([j for j in np.argsort(-s[i], kind="stable") if j != i][:20])
        kept = []
        for j in cand:
            dist = np.sqrt(max(2 - 2 * s[i, j], 0))
            if len(kept) < embedding.DEGREE and all(embedding.ALPHA * np.sqrt(max(2 - 2 * s[j, k], 0)) > dist for k in kept):
                kept.append(j)
        assert cand[embedding.robust_prune(x, s[i, cand][None], cand[None])[0]].tolist() == kept


def test_many_centroids_are_found_through_tops(monkeypatch):
    monkeypatch.setattr(embedding, "FLAT_MOST", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = embedding.Centres(x, 200)
    near = c.nearest(x, 3)
    exact = np.argsort(-(x @ c.c.T), axis=1)[:, :3]
    assert near.shape == (3000, 3) and (near[:, 0] == exact[:, 0]).mean() > 0.9


def test_unit_vectors():
    import pyarrow as pa

    rows_in = [[3.0, 4.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e300, 1e300], [1e-300, 0.0], [2.0]]
    got = embedding._unit(pa.array(rows_in, pa.list_(pa.float64())), 2).to_pylist()
    vectors = [None if v is None else np.frombuffer(v).round(6).tolist() for v in got]
    assert vectors == [[0.6, 0.8], None, None, None, None, None, None, [0.707107, 0.707107], [1.0, 0.0], [1.0, 0.0]]
