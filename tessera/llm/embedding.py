"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors form a class with a weight; only classes are compared.
2. Classes go to the shards of their nearest `overlap` centroids; the nearest one is their home. k-means
   fits the centroids, whose number follows the table, on a bounded sample; many of them are found through
   a second level. A shard of more than SHARD_MOST classes is cut into blocks, so no group outgrows a task.
3. Each block builds a graph. Candidate neighbours come from the cells of about sqrt(n) pivots, CELLS for
   each class, never from all pairs of the block; they are pruned robustly to DEGREE edges, taken both ways.
   The adjacency lists that a class got in all its shards are united.
4. Every class is a query in its home shard: a greedy beam search from the block's medoid, then the search
   expands its range, from node to node, as long as nodes lie within SLACK of the threshold.
5. Similarities are those of double precision on the whole vectors, so each link found is verified. Each
   pair has one group that answers for it, found by a rule on homes, shards and blocks; what is found there
   counts for both and joins both, what another group finds does not, so counts and components agree.
   Groups send one row a class, a partial count and the root of its component there; no list of pairs.
6. Recall is audited against brute force, for a bounded sample of classes against all; below AUDIT_LEAST
   the search runs again with twice the overlap, in the end with every class in every shard. A recall
   below RECALL_LEAST even then is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import Stage, connected_components, join_groups

THRESHOLD = 0.9
#: Classes of a shard on average and at most, and centroids at most (their broadcast has that bound).
SHARD_SIZE, SHARD_MOST, CENTROIDS_MOST, FLAT_MOST, TOPS = 512, 2048, 65_536, 2048, 6
#: Sampled vectors for each centroid, least and most of them; audited classes; least recall to stop at and to give.
SAMPLE, SAMPLE_LEAST, SAMPLE_MOST = 64, 4096, 131_072
AUDIT, AUDIT_LEAST, RECALL_LEAST = 256, 0.97, 0.9
OVERLAP, CELLS, DEGREE, CANDIDATES, ALPHA = 3, 3, 24, 48, 1.2
BEAM, SLACK, QUERIES = 12, 0.08, 256
SEED = 20_270


def _unit(col: pa.Array, dim: int) -> pa.Array:
    """Unit vectors in double precision as bytes; null for those that link with nothing. Short ones are padded with zeros."""
    col = col.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    value = pc.fill_null(col.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    x = np.zeros((len(size), dim))
    x[row, np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)] = value
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1, initial=0)
        ok = np.isfinite(top) & (top > 0)
        x[ok] /= top[ok, None]  # no overflow or underflow of squares
        x[ok] /= np.sqrt(np.einsum("ij,ij->i", x[ok], x[ok]))[:, None]
    return pa.array([v.tobytes() if k else None for v, k in zip(x, ok, strict=True)], pa.binary())


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(6):
        own = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], c)
    return c


class Centres:
    """Centroids, with a level of tops above them where they are many."""

    def __init__(self, x: np.ndarray, k: int):
        self.c = _centroids(x, k)
        self.tops = self.own = None
        if len(self.c) > FLAT_MOST:
            self.tops = _centroids(self.c, int(np.sqrt(len(self.c))))
            self.own = np.concatenate([(self.c[i : i + 2048] @ self.tops.T).argmax(1) for i in range(0, len(self.c), 2048)])

    def nearest(self, x: np.ndarray, most: int) -> np.ndarray:
        """For each row the indexes of the `most` nearest centroids (all, if they are fewer), nearest first."""
        most = min(most, len(self.c))
        if self.tops is None or most > FLAT_MOST:
            s = x @ self.c.T
            near = np.argpartition(-s, most - 1, axis=1)[:, :most]
            return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        tops = np.argpartition(-(x @ self.tops.T), TOPS - 1, axis=1)[:, : max(TOPS, 2 * most)]
        rows, ids, sims = [], [], []
        for t in np.unique(tops):
            mine, below = np.flatnonzero((tops == t).any(1)), np.flatnonzero(self.own == t)
            if len(below):
                s = x[mine] @ self.c[below].T
                rows.append(np.repeat(mine, len(below)))
                ids.append(np.tile(below, len(mine)))
                sims.append(s.ravel())
        rows, ids, sims = np.concatenate(rows), np.concatenate(ids), np.concatenate(sims)
        order = np.lexsort((ids, -sims, rows))
        rows, ids = rows[order], ids[order]
        first = np.searchsorted(rows, np.arange(len(x)))
        count = np.diff(np.append(first, len(rows)))
        return ids[first[:, None] + np.minimum(np.arange(most), np.maximum(count - 1, 0)[:, None])]


def robust_prune(x: np.ndarray, sims: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """For each row of candidates (sorted by similarity, -1 for none) which stay: those not closer (by ALPHA) to
    one kept before than to the point, at most DEGREE."""
    v = x[np.maximum(cand, 0)]
    dist = np.sqrt(np.maximum(2 - 2 * sims, 0))
    among = np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
    alive = cand >= 0
    kept, count = np.zeros(cand.shape, bool), np.zeros(len(cand), np.int64)
    for k in range(cand.shape[1]):
        take = alive[:, k] & (count < DEGREE)
        kept[:, k] = take
        count += take
        alive &= ~take[:, None] | (ALPHA * among[:, k, :] > dist)
    return kept


def _candidates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, similarity): near rows that share a cell, the CANDIDATES best of each of a row's cells."""
    n = len(x)
    rng = np.random.default_rng(SEED)
    pivots = x[rng.choice(n, max(1, min(n, int(np.ceil(np.sqrt(n))))), replace=False)]
    most = min(CELLS, len(pivots))
    cell = np.concatenate([np.argpartition(-(x[k : k + 4096] @ pivots.T), most - 1, axis=1)[:, :most] for k in range(0, n, 4096)])
    out = []
    for c in range(len(pivots)):
        mine = np.flatnonzero((cell == c).any(1))
        best = min(CANDIDATES, len(mine) - 1)
        for lo in range(0, len(mine), 512) if best > 0 else ():
            s = x[mine[lo : lo + 512]] @ x[mine].T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -9
            near = np.argpartition(-s, best - 1, axis=1)[:, :best]
            out.append((np.repeat(mine[lo : lo + 512], best), mine[near].ravel(), np.take_along_axis(s, near, 1).ravel()))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) in both ways of the robust-pruned graph."""
    n = len(x)
    row, other, sim = _candidates(x)
    _, first = np.unique(row * n + other, return_index=True)  # one of each pair, by row
    row, other, sim = row[first], other[first], sim[first]
    order = np.lexsort((other, -sim, row))
    row, other, sim = row[order], other[order], sim[order]
    begin = np.searchsorted(row, np.arange(n + 1))
    edges = []
    for lo in range(0, n, 512):
        hi = min(lo + 512, n)
        count = np.minimum(np.diff(begin[lo : hi + 1]), CANDIDATES)
        at = begin[lo:hi, None] + np.minimum(np.arange(CANDIDATES), np.maximum(count - 1, 0)[:, None])
        there = np.arange(CANDIDATES) < count[:, None]
        if not there.any():
            continue
        at = np.minimum(at, len(row) - 1)
        cand, sims = np.where(there, other[at], -1), np.where(there, sim[at], -1.0)
        r, k = np.nonzero(robust_prune(x, sims, cand))
        edges.append((r + lo) * n + cand[r, k])
    flat = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    a, b = flat // n, flat % n
    both = np.unique(np.concatenate([flat, b * n + a]))
    return both // n, both % n


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all nodes found with similarity >= threshold. graph: neighbours, -1 where there are fewer."""
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    found_q, found_n = [], []
    for lo in range(0, len(queries), QUERIES):
        q = queries[lo : lo + QUERIES]
        m = len(q)
        seen, mark = np.zeros(m * n, bool), np.empty(m * n, np.int32)

        def fresh(rows, nodes, q=q, seen=seen, mark=mark):
            """The neighbours of nodes that their rows have not seen yet, once each, and their similarities."""
            near = graph[nodes]
            r = np.repeat(rows, near.shape[1])
            near = near.ravel()
            flat = r * n + near
            ok = (near >= 0) & ~seen[flat]
            flat = flat[ok]
            mark[flat] = np.arange(len(flat), dtype=np.int32)
            flat = flat[mark[flat] == np.arange(len(flat), dtype=np.int32)]
            seen[flat] = True
            r, near = flat // n, flat % n
            s = np.empty(len(r))
            for k in range(0, len(r), 65_536):
                s[k : k + 65_536] = np.einsum("ij,ij->i", q[r[k : k + 65_536]], x[near[k : k + 65_536]])
            hit = s >= threshold
            found_q.append(r[hit] + lo)
            found_n.append(near[hit])
            return r, near, s

        seen[np.arange(m) * n + medoid] = True
        first = q @ x[medoid]
        hit = np.flatnonzero(first >= threshold)
        found_q.append(hit + lo)
        found_n.append(np.full(len(hit), medoid))
        # each query's BEAM best nodes, their similarities, and whether they are still to be expanded
        beam, sims, todo = np.full((m, BEAM), medoid), np.full((m, BEAM), -9.0), np.zeros((m, BEAM), bool)
        sims[:, 0], todo[:, 0] = first, True
        held = []  # nodes near enough to the threshold that left the beam unexpanded
        active = np.arange(m)
        while len(active):  # greedy: the best node of the beam that has not been expanded
            value = np.where(todo[active], sims[active], -9.0)
            pick = value.argmax(1)
            go = value[np.arange(len(active)), pick] > -9
            active, pick = active[go], pick[go]
            if not len(active):
                break
            todo[active, pick] = False
            r, near, s = fresh(active, beam[active, pick])
            held.append((r[s >= threshold - SLACK], near[s >= threshold - SLACK]))
            order = np.lexsort((-s, r))  # the best of the new nodes of each row
            r, near, s = r[order], near[order], s[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            r, near, s, nth = r[nth < BEAM], near[nth < BEAM], s[nth < BEAM], nth[nth < BEAM]
            rows, at = np.unique(r, return_inverse=True)
            wide = np.full((len(rows), 2 * BEAM), -9.0)
            ids, open_ = np.zeros((len(rows), 2 * BEAM), np.int64), np.zeros((len(rows), 2 * BEAM), bool)
            wide[:, :BEAM], ids[:, :BEAM], open_[:, :BEAM] = sims[rows], beam[rows], todo[rows]
            wide[at, BEAM + nth], ids[at, BEAM + nth], open_[at, BEAM + nth] = s, near, True
            best = np.argsort(-wide, axis=1, kind="stable")[:, :BEAM]
            sims[rows], beam[rows], todo[rows] = (np.take_along_axis(v, best, 1) for v in (wide, ids, open_))
        # range: all nodes near enough to the threshold, those of the greedy walk once more (their neighbours are mostly seen)
        rows, nodes = (np.concatenate(v) for v in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
        close = np.flatnonzero(first >= threshold - SLACK)
        rows, nodes = np.concatenate([rows, close]), np.concatenate([nodes, np.full(len(close), medoid)])
        while len(rows):
            got = [fresh(rows[k : k + 8192], nodes[k : k + 8192]) for k in range(0, len(rows), 8192)]
            rows, nodes, s = (np.concatenate(v) for v in zip(*got, strict=True))
            rows, nodes = rows[s >= threshold - SLACK], nodes[s >= threshold - SLACK]
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_n)


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest label of its component under edges (a, b)."""
    low = label.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            return low
        low = new


def _links(classes: DataFrame, total: int, dim: int, overlap: int, threshold: float, stage: Stage) -> tuple[DataFrame, int]:
    """(cls, n, root) of each class and group: links counted there and a class it is joined with; and the centroids."""
    spark = classes.sparkSession
    k = max(1, min(CENTROIDS_MOST, -(-total // SHARD_SIZE)))
    most = max(SAMPLE_LEAST, min(SAMPLE_MOST, SAMPLE * k))
    sample = classes.select("cls", "v").orderBy(F.xxhash64("cls"), "cls").limit(most).select("v").collect()
    centres = spark.sparkContext.broadcast(Centres(_matrix([r["v"] for r in sample], dim) if sample else np.zeros((1, dim)), k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                near = centres.value.nearest(_matrix(part.column(1).to_pylist(), dim), overlap).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near[:, 0]), pa.array(list(near), pa.list_(pa.int32()))], ["cls", "v", "w", "home", "shards"])

    put = classes.select("cls", "v", "w").mapInArrow(assign, "cls long, v binary, w long, home int, shards array<int>")
    put = stage.save(put.withColumn("shards", F.array_distinct("shards")), "assigned")
    rows = put.select("*", F.explode("shards").alias("shard"))
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("blocks"))
    rows = rows.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = build_graph(_matrix(pdf["v"], dim))
        ids = pdf["cls"].to_numpy()
        begin = np.searchsorted(a, np.arange(len(ids) + 1))
        return pd.DataFrame({"cls": ids, "near": [ids[b[begin[i] : begin[i + 1]]] for i in range(len(ids))]})

    near = rows.select("cls", "v", "shard", "block").groupBy("shard", "block").applyInPandas(build, "cls long, near array<long>")
    near = near.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    rows = rows.join(near, "cls")
    # a group is a block of nodes (g) and a block of queries (q) of one shard; a row of a shard is a node of its
    # block for all blocks of queries, and, where the shard is its home, a query to all blocks of nodes
    group = F.expr(
        "concat(transform(sequence(0, blocks - 1), q -> struct(block as g, q as q, true as node, home = shard and q = block as ask)),"
        " if(home = shard, transform(filter(sequence(0, blocks - 1), g -> g <> block), g -> struct(g as g, block as q, false as node, true as ask)), array()))"
    )
    rows = rows.select("cls", "v", "w", "home", "shards", "shard", "block", "near", F.inline(group))
    rows = rows.withColumn("near", F.when(F.col("node"), F.col("near")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"cls": [], "n": [], "root": []}).astype("int64")
        shard, g, q = (int(pdf[c].iloc[0]) for c in ("shard", "g", "q"))
        nodes, asks = np.flatnonzero(pdf["node"].to_numpy()), np.flatnonzero(pdf["ask"].to_numpy())
        if not len(nodes) or not len(asks):
            return none
        pdf = pdf.sort_values("cls", kind="stable").reset_index(drop=True)
        nodes, asks = np.flatnonzero(pdf["node"].to_numpy()), np.flatnonzero(pdf["ask"].to_numpy())
        ids, w, home = (pdf[c].to_numpy() for c in ("cls", "w", "home"))
        x = _matrix(pdf["v"], dim)
        lists = [np.asarray(v, np.int64) for v in pdf["near"].iloc[nodes]]
        size = np.array([len(v) for v in lists])
        flat = np.concatenate(lists)
        at = np.minimum(np.searchsorted(ids[nodes], flat), len(nodes) - 1)
        ok = ids[nodes][at] == flat  # neighbours in other shards or blocks are none here
        owner, at = np.repeat(np.arange(len(nodes)), size)[ok], at[ok]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        graph = np.full((len(nodes), int(nth.max(initial=0)) + 1), -1, np.int64)
        graph[owner, nth] = at
        a, b = range_search(x[nodes], graph, x[asks], threshold)
        a, b = asks[a], nodes[b]
        a, b = a[a != b], b[a != b]
        # does this group answer for the pair? Of one home: it does where both are asked here, else the lower block
        # asks. Of two homes: the smaller class asks at its home, if the other is a node there; else the larger does.
        width = max(map(len, pdf["shards"]))
        shards = np.array([list(v) + [-1] * (width - len(v)) for v in pdf["shards"]])
        same = home[a] == home[b]
        mine = np.where(same, g >= q, (ids[a] < ids[b]) | ~(shards[a] == home[b][:, None]).any(1))
        a, b = a[mine], b[mine]
        pair = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        lo, hi = pair // len(ids), pair % len(ids)
        n = np.bincount(lo, w[hi], len(ids)) + np.bincount(hi, w[lo], len(ids))
        touched = np.unique(np.concatenate([lo, hi]))
        return pd.DataFrame({"cls": ids[touched], "n": n[touched].astype(np.int64), "root": _roots(len(ids), lo, hi, ids)[touched]})

    found = rows.groupBy("shard", "g", "q").applyInPandas(search, "cls long, n long, root long")
    return stage.save(found, "found"), k


def _recall(classes: DataFrame, counts: DataFrame, dim: int, threshold: float) -> float:
    """Links found of those there are, for AUDIT classes against all classes by brute force."""
    sample = classes.orderBy(F.xxhash64("cls", F.lit(SEED)), "cls").limit(AUDIT).collect()
    if not sample:
        return 1.0
    q, ids = _matrix([r["v"] for r in sample], dim), np.array([r["cls"] for r in sample])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                hit = (q @ _matrix(part.column(1).to_pylist(), dim).T >= threshold) & (ids[:, None] != part.column(0).to_numpy()[None, :])
                total += hit @ part.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["cls", "n"])

    exact = classes.select("cls", "v", "w").mapInArrow(brute, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("exact"))
    got = exact.where("exact > 0").join(counts, "cls", "left").agg(F.sum("exact"), F.sum(F.least(F.coalesce("n", F.lit(0)), "exact"))).first()
    return got[1] / got[0] if got[0] else 1.0


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept (vec_id = component_id), audited_recall.

    n_links counts the other rows found with cosine >= threshold (equal vectors among them), none below
    it. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing:
    n_links 0, a component of their own. Vectors shorter than the longest count as padded with zeros. A
    row with a null vec_id takes part, but names a component only if it holds no other. audited_recall is the
    share of the links of sampled classes that was found, AUDIT_LEAST and more but where all overlap is used up. Labels and other
    columns are ignored. An empty table gives an empty result.
    """
    stage = Stage(vectors.sparkSession, "embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    dim = rows.agg(F.max(F.size("e"))).first()[0] or 1
    dim = max(int(dim), 1)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _unit(batch.column(1), dim)], ["vec_id", "v"])

    rows = stage.save(rows.mapInArrow(unit, "vec_id long, v binary"), "vectors")
    each = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("w"), F.min("vec_id").alias("low"))
    for seed in range(8):  # a class number is a hash of the vector; another seed where two vectors share one
        number = F.xxhash64("v", F.lit(seed))
        classes = stage.save(each.withColumn("cls", number), "classes")
        total, most = classes.groupBy("cls").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if most <= 1:
            break
    else:
        raise RuntimeError("no seed gave each vector a number of its own")
    rows = rows.select("vec_id", F.when(F.col("v").isNotNull(), number).alias("cls"))
    overlap = OVERLAP
    while True:
        found, centroids = _links(classes, total, dim, overlap, threshold, stage)
        counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
        recall = _recall(classes, counts, dim, threshold)
        if recall >= AUDIT_LEAST or overlap >= centroids:
            break
        overlap *= 2
    if recall < RECALL_LEAST:
        raise RuntimeError(f"audited recall {recall:.3f} with every class in every shard")
    comps = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), stage)
    of = classes.drop("v").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = of.groupBy("comp").agg(F.min("low").alias("component_id"))
    of = join_groups(of, lowest, "comp", "cls", stage).join(counts, "cls", "left").select("cls", "component_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = rows.select("vec_id", "cls").join(of, "cls", "left")
    comp = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        comp.alias("component_id"),
        F.col("vec_id").eqNullSafe(comp).alias("kept"),
        F.lit(float(recall)).alias("audited_recall"),
    )
