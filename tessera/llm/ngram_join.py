"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every text becomes its set of hashed word shingles; texts of one set form a class, and
   only classes take part from here on (copies are never paired).
2. One packed shuffle brings the classes of each shingle together. Shingles of a single
   class cannot make a pair, so just the shared ones come out, with their class counts.
3. Each class orders its set rare-first: unshared shingles, then shared ones by class count,
   ties by hash. Of n shingles the first n - ceil(t n) + 1 are the prefix; linked classes
   meet in a shingle of both prefixes.
4. Candidates of a shingle: in three rounds, its classes with three hubs (a star rather than all
   pairs). Verified links give components; only classes of different components are paired further.
   At last the classes outside the largest component of a shingle meet all others, in chunks of
   bounded size. So a group of thousands of near copies costs a few pairs for each member, and no
   pair between components goes unexamined. The entries of a common shingle are dealt by class into
   chunks, and whatever meets them (hubs, other chunks) is sent to each, so no task takes a whole one.
5. A pair must pass the length filter, the positional bound at the shingle where it met, and
   the suffix bound: the sets are cut at fixed hash pivots into ranges, and the sum of the
   smaller counts bounds the overlap. Survivors are verified once, exactly, on shared shingles.

Classes are numbered by a 64-bit hash of their set; where two sets share one (found by a second hash),
they are numbered by that. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import Stage, connected_components, join_groups, partitions
from .text_util import blocks, hash_spans, lowered, release, windows, words

WIDTH, PERCENT = 5, 80
#: Shingles that one reducing group holds at most on average, and those a map task gathers before it sends.
PART_ENTRIES, FLUSH_ENTRIES = 2_000_000, 1_000_000
CHUNK = 512
#: The class that marks a hot shingle, and the class count that stands for all hot ones: they rank last.
HOT, HOT_DF = -(1 << 63), 1 << 40
#: Ranges into which the suffix filter cuts the sets (a power of two, 64 at most).
RANGES = 64
#: Hubs of a shingle in each round, by their order among its classes. Few unshared shingles make a good
#: hub; later rounds take hubs by seeds, the same for all shingles that a group shares.
HUBS = (
    ("struct(e.n - e.shared, e.cls)", "struct(e.n, e.cls)", "struct(-e.n, e.cls)"),
    ("xxhash64(e.cls, 1)", "xxhash64(e.cls, 2)", "struct(e.n - e.shared, xxhash64(e.cls, 3))"),
    ("xxhash64(e.cls, 4)", "xxhash64(e.cls, 5)", "xxhash64(e.cls, 6)"),
)


def _sets(batches, text: str, width: int):
    """(block, for each text its sorted distinct shingle hashes)."""
    for block in blocks(batches, text):
        buf = lowered(block.buf)
        starts, ends, first = words(buf, block.offs)
        win, at = windows(hash_spans(buf, starts, ends), first, width)
        yield block, [np.unique(win[at[k] : at[k + 1]]) for k in range(block.size)]


def _class_of(shingles: np.ndarray, seed: int = 0) -> int:
    """A number for a set; never HOT."""
    return max(int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed)).astype(np.int64)), HOT + 1)


def _class_number(shingles: np.ndarray, shared: frozenset[int]) -> int:
    """The class of a set; shared: first hashes that several sets have."""
    c = _class_of(shingles)
    return _class_of(shingles, 1) if c in shared else c


def members(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, cls, alt); cls and alt, two hashes of the set, are null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sets in _sets(batches, "text", width):
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([_class_of(s, 1) if len(s) else None for s in sets], pa.int64()),
                ],
                ["doc_id", "n_shingles", "cls", "alt"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, cls long, alt long"
    )


def shared_numbers(member: DataFrame) -> frozenset[int]:
    """First hashes that different sets have: of n sets some n^2 / 2^65 pairs, so a handful at most."""
    twice = member.where("cls is not null").groupBy("cls").agg(F.min("alt").alias("a"), F.max("alt").alias("b")).where("a <> b")
    return frozenset(r["cls"] for r in twice.select("cls").collect())


def _packed(docs: DataFrame, width: int, parts: int, salts: int, hot: int, text: str, alike: frozenset[int]) -> DataFrame:
    """(part, blob): the shingles of each class, dealt by hash into parts; a class goes once from each task.

    A shingle that `hot` or more classes of one flush hold is dealt by class into `salts` further groups of
    its part, and a mark of it goes to the part itself. One that is less common in every flush cannot have
    more entries than hot times the number of flushes. So no group outgrows a task.
    """

    def flush(classes, sets):
        if len(classes) >= hot:
            found, count = np.unique(np.concatenate(sets), return_counts=True)
            found = found[count >= hot]
            classes, sets = [HOT, *classes], [found, *sets]
        size = np.array([len(s) for s in sets], np.int64)
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        part = (((hashes >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64) * (salts + 1)
        if classes[0] == HOT and len(sets[0]):
            salt = 1 + np.array(classes, np.int64)[owner] % salts
            part += np.where((owner > 0) & np.isin(hashes, sets[0]), salt, 0)
        order = np.argsort(part, kind="stable")
        hashes, owner, part = hashes[order], owner[order], part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        cls = np.array(classes, np.int64)
        ids, blobs = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = owner[lo:hi]
            head = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            who = own[head]
            count = np.diff(np.concatenate([head, [hi - lo]]))
            ids.append(int(part[lo]))
            blobs.append(
                b"".join(
                    x.tobytes()
                    for x in (np.array([len(who)], np.int64), cls[who], size[who].astype(np.int32), count.astype(np.int32), hashes[lo:hi])
                )
            )
        for k in range(0, len(ids), 64):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 64], pa.int64()), pa.array(blobs[k : k + 64], pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        classes, sets, held = [], [], 0
        for _, found in _sets(batches, "text", width):
            for s in found:
                if len(s) and (c := _class_number(s, alike)) not in sent:
                    sent.add(c)
                    classes.append(c)
                    sets.append(s)
                    held += len(s)
            if held >= FLUSH_ENTRIES:
                yield from flush(classes, sets)
                classes, sets, held = [], [], 0
        if held:
            yield from flush(classes, sets)
        del sent, classes, sets
        release()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "part long, blob binary")


def _shared(batches: Iterator[pa.RecordBatch], salts: int) -> Iterator[pa.RecordBatch]:
    """Of blobs sorted by part: (cls, n, hash, df) of shingles that two or more classes hold; hot ones have df HOT_DF."""

    def solve(blobs, salted):
        cls, size, hashes, first = [], [], [], []
        for b in blobs:
            m = int(np.frombuffer(b, np.int64, 1)[0])
            count = np.frombuffer(b, np.int32, m, 8 + 12 * m)
            cls.append(np.frombuffer(b, np.int64, m, 8))
            size.append(np.frombuffer(b, np.int32, m, 8 + 8 * m))
            hashes.append(np.frombuffer(b, np.uint64, offset=8 + 16 * m))
            first.append(count)
        cls, size, hashes = np.concatenate(cls), np.concatenate(size), np.concatenate(hashes)
        owner = np.repeat(np.arange(len(cls), dtype=np.int32), np.concatenate(first))
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        same = hashes[1:] == hashes[:-1]
        keep = np.full(len(hashes), salted)
        keep[1:] |= same
        keep[:-1] |= same
        hashes, owner = hashes[keep], owner[keep]
        order = np.lexsort((cls[owner], hashes))
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), bool)  # the same class may come from several tasks
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (cls[owner[1:]] != cls[owner[:-1]])
        hashes, owner = hashes[fresh], owner[fresh]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        run = np.diff(np.concatenate([begin, [len(hashes)]]))
        marked = cls[owner] == HOT
        hot = np.repeat(np.logical_or.reduceat(marked, begin), run) if len(begin) else marked
        df = np.where(hot | salted, HOT_DF, np.repeat(run, run))
        keep = (df > 1) & ~marked
        out = [cls[owner[keep]], size[owner[keep]].astype(np.int64), hashes[keep].view(np.int64), df[keep].astype(np.int64)]
        for k in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in out], ["cls", "n", "hash", "df"])

    part, held = None, []
    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != part and held:
                yield from solve(held, part % (salts + 1) > 0)
                held = []
            part = p
            held.append(blob.as_py())
    if held:
        yield from solve(held, part % (salts + 1) > 0)
    del held
    release()


def _passes(a: str, b, percent: int) -> F.Column:
    """Length, positional and suffix filters for prefix entries that met in one shingle; b may be a getter."""
    get = b if callable(b) else lambda f: F.col(f"{b}.{f}")
    mine = lambda f: F.col(f"{a}.{f}")
    na, nb = mine("n"), get("n")
    need = F.ceil((na + nb) * percent / (100 + percent) - 1e-6)
    after = F.least(mine("shared") - mine("at"), get("shared") - get("at"))
    ranges = F.aggregate(F.zip_with(mine("ranges"), get("ranges"), lambda p, q: F.least(p, q)), F.lit(0), lambda s, x: s + x)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (after >= need) & (ranges >= need)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough, each examined once."""
    held = sets.select("cls", "n", "hashes")
    both = (
        pairs.distinct()
        .join(held.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha")), "a")
        .join(held.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb")), "b")
        .withColumn("common", F.size(F.array_intersect("ha", "hb")))
    )
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(f"{x}.cls", f"{y}.cls").alias("a"), F.greatest(f"{x}.cls", f"{y}.cls").alias("b")]


def class_links(
    docs: DataFrame, member: DataFrame, stage: Stage, width: int = WIDTH, percent: int = PERCENT, text: str = "text", alike: frozenset[int] = frozenset()
) -> DataFrame:
    """Verified links (a, b) between classes, enough to join every two linked classes by a path; staged."""
    n, total = member.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    parts = max(1, min((1 << 24) - 1, -(-total // PART_ENTRIES)))
    salts = max(1, -(-n // PART_ENTRIES))
    hot = max(2, PART_ENTRIES // max(1, -(-total // FLUSH_ENTRIES)))
    shared = (
        _packed(docs, width, parts, salts, hot, text, alike)
        .repartition(max(1, min(partitions(docs.sparkSession), parts)), "part")
        .sortWithinPartitions("part")
        .mapInArrow(lambda batches: _shared(batches, salts), "cls long, n long, hash long, df long")
    )
    bucket = F.shiftrightunsigned("hash", 64 - RANGES.bit_length() + 1)
    sets = stage.save(
        shared.groupBy("cls", "n")
        .agg(
            F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("x"),
            F.array(*[F.count_if(bucket == k).cast("int") for k in range(RANGES)]).alias("ranges"),
        )
        .select("cls", "n", F.col("x.hash").alias("hashes"), "ranges", F.size("x").alias("shared"))
        .withColumn("prefix", F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-6) + 1 - (F.col("n") - F.col("shared"))),
        "sets",
    )
    entries = sets.where("prefix > 0").select(
        "cls", "n", "shared", "ranges", F.posexplode(F.slice("hashes", F.lit(1), F.least("prefix", "shared").cast("int"))).alias("at", "hash")
    )
    # a shingle of many entries is dealt into chunks by class; few shingles are so common, so that this join needs no
    # shuffle of the entries, or one whose large keys the planner splits
    often = stage.save(entries.groupBy("hash").agg(F.count("*").alias("c")).where(F.col("c") > CHUNK), "often")
    chunks = F.coalesce(F.ceil(F.col("c") / CHUNK), F.lit(1)).cast("int")
    prefix = stage.save(
        entries.join(often, "hash", "left").select(
            "hash", F.pmod(F.xxhash64("cls"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"), F.struct("cls", "n", "shared", "ranges", "at").alias("e")
        ),
        "prefix",
    )
    links = None
    known = prefix.withColumn("comp", F.col("e.cls"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    for nth in range(len(HUBS)):
        hubs = known.groupBy("hash").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("chunks").alias("chunks"), F.array(*[F.min_by(F.struct("e", "comp"), F.expr(key)) for key in HUBS[nth]]).alias("hubs")
        )
        star = (
            known.join(hubs.where("lo < hi").select("hash", "hubs", every), ["hash", "chunk"])
            .select("e", "comp", F.explode("hubs").alias("h"))
            .where((F.col("comp") != F.col("h.comp")) & _passes("e", "h.e", percent))
            .select(*_pair("e", "h.e"))
        )
        found = stage.save(_verified(star, sets, percent), "links")
        links = found if links is None else links.union(found)
        comps = connected_components(links, stage)
        known = prefix.withColumn("node", F.col("e.cls")).join(comps, "node", "left")
        known = stage.save(known.select("hash", "chunk", "chunks", "e", F.coalesce("comp", "node").alias("comp")), "known")
        stage.drop("cc", "cc-both")
    # what is left: members outside the largest component of a shingle, with all others of another component
    sizes = known.groupBy("hash", "comp").agg(F.count("*").alias("c"), F.max("chunks").alias("chunks")).groupBy("hash")
    sizes = sizes.agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("strays"), F.max("chunks").alias("chunks"), F.count("*").alias("comps"))
    sizes = sizes.where("comps > 1").withColumn("groups", F.ceil(F.col("strays") / CHUNK).cast("int"))
    mixed = known.drop("chunks").join(sizes.select("hash", "main", "groups", "chunks", every), ["hash", "chunk"])
    # each group of strays meets each chunk in a row of its own
    whole = mixed.groupBy("hash", "chunk").agg(F.collect_list(F.struct("e", "comp", "main")).alias("ys"), F.max("groups").alias("groups"))
    whole = whole.select("hash", "chunk", "ys", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    strays = mixed.where("comp != main").withColumn("group", F.pmod(F.xxhash64("e.cls", F.lit(1)), "groups").cast("int"))
    strays = strays.groupBy("hash", "group").agg(F.collect_list(F.struct("e", "comp")).alias("xs"), F.max("chunks").alias("chunks")).select("hash", "group", "xs", every)
    other = lambda y: (
        (y["comp"] != F.col("x.comp")) & ((y["comp"] == y["main"]) | (y["e"]["cls"] > F.col("x.e.cls"))) & _passes("x.e", lambda f: y["e"][f], percent)
    )
    cross = (
        strays.join(whole, ["hash", "group", "chunk"])
        .select(F.explode("xs").alias("x"), "ys")
        .select("x", F.explode(F.transform(F.filter("ys", other), lambda y: y["e"]["cls"])).alias("y"))
        .select(F.least("x.e.cls", "y").alias("a"), F.greatest("x.e.cls", "y").alias("b"))
    )
    stage.save(_verified(cross, sets, percent), "links")
    stage.drop("sets", "often", "prefix", "known")
    return docs.sparkSession.read.schema(links.schema).parquet(*[f"{stage.base}/links-{n}" for n in range(len(HUBS) + 1)])


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are runs of other than space, tab, LF, VT, FF, CR, with A-Z in lower case. Two texts link
    when 100 * common shingles >= percent * shingles of either. A text of fewer than `width` words has
    its whole sequence as its one shingle. Null, empty and blank texts have none and link with nothing:
    their component is their own doc_id. Repeated rows each come out; a null doc_id never is a
    component_id unless the whole component has no other. Extra columns are ignored. An empty table
    gives an empty result.
    """
    stage = Stage(docs.sparkSession, "ngram-join")
    member = stage.save(members(docs, width, text, doc_id), "members")
    alike = shared_numbers(member)
    number = F.when(F.col("cls").isin(list(alike)), F.col("alt")).otherwise(F.col("cls")) if alike else F.col("cls")
    member = member.select("doc_id", "n_shingles", number.alias("cls"))
    links = class_links(docs, member, stage, width, percent, text, alike)
    comps = connected_components(links, stage)
    lowest = member.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    lowest = stage.save(lowest.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "lowest")
    whole = lowest.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_class = stage.save(join_groups(lowest, whole, "comp", "cls", stage).select("cls", "component_id"), "classes")
    stage.drop("links", "cc", "cc-both", "lowest", "often-comp")
    return member.join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicate_keepers(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when one document of each component does: the one with the smallest doc_id.

    Rows with a null doc_id stay (they cannot be told apart). Rows of one doc_id stay or go together: they
    stay if any of them stands for its component, so that no text is lost.
    """
    found = ngram_join(docs, width, percent)
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays")).where("not stays").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
