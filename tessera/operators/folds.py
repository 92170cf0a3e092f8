"""Order-dependent folds that no window can express: one pass over each key's rows in order.

Each fold is a plain function from a list of rows to a list of rows; `run` applies it to the groups of
a sorted table as they pass in Arrow batches. Keys must be real ones: a group is held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.ship import ship

Fold = Callable[[list[dict]], list[dict]]

#: One object, so that equal keys of no number are one key.
NAN = float("nan")


def _values(column: pa.Array, key: bool) -> list:
    """A batch's column as plain values. Missing numbers are NaN to a fold, which compares to nothing; a key stays null."""
    number = pa.types.is_floating(column.type) or pa.types.is_integer(column.type)
    if number and not column.null_count:
        out = column.to_numpy(zero_copy_only=False).tolist()
    else:
        out = column.to_pylist()
        if number and not key:
            return [NAN if v is None else v for v in out]
    return [NAN if v != v else v for v in out] if key and pa.types.is_floating(column.type) else out


def run(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, schema: str, parts: int | None = None) -> DataFrame:
    """fold over the rows of each key in order; schema lists the result's columns, keys first.

    A task has many keys in `parts` parts of the table, sorted with spill; only the rows of the key at hand
    are held as Python values, so that small keys cost no call of their own.
    """
    ship(df.sparkSession)
    columns, key_columns = list(df.columns), list(keys)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type, from_pandas=True) for f in target], schema=target)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [columns.index(k) for k in key_columns]
        key_of = itemgetter(*at) if at else lambda _: ()
        rows = (r for b in batches for r in zip(*[_values(c, n in key_columns) for n, c in zip(columns, b.columns, strict=True)], strict=True))
        out: list[dict] = []
        for key, held in groupby(rows, key_of):
            head = dict(zip(key_columns, (key,) if len(at) == 1 else key, strict=True))
            out += [head | r for r in fold([dict(zip(columns, r)) for r in held])]  # noqa: B905  (hot)
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        yield batch(out)

    ordered = [F.col(k).asc_nulls_first() for k in keys] + [F.col(c).asc_nulls_last() for c in order]
    placed = df.repartition(*([parts] if parts else []), *keys) if keys else df.coalesce(1)
    return placed.sortWithinPartitions(*ordered).mapInArrow(groups, schema)


def distance(a: str, b: str) -> int:
    """Levenshtein distance of two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def indel_ratio(a: str, b: str) -> int:
    """0 to 100: twice the longest common subsequence over both lengths, rounded half to even."""
    if not a and not b:
        return 100
    if a == b:
        return 100
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return round(200 * row[-1] / (len(a) + len(b)))


def alike(a: str, b: str, least: float = 0.7) -> bool:
    """Equal, or neither empty and alike by that share of the longer."""
    if a == b:
        return True
    if not a or not b:
        return False
    return 1 - distance(a, b) / max(len(a), len(b)) >= least


def visible(text: str) -> str:
    """A text without its {...} marks and outer white space."""
    return re.sub(r"\{[^}]*\}", "", text).strip()


def merge_consecutive(gap: int, short: int, echo: int, look: Sequence[str] = ()) -> Fold:
    """Rows (start, end, text and the `look` columns) that follow the growing row within gap and say the same.

    Texts are compared without their marks; they say the same if equal, or if one letter differs and the
    row that began the growing one, or the next, is short. At a gap of none, variants of one text (seven
    tenths) join where the next row is shorter than `echo`, and, where the first row is that short, the
    next one's text takes over. All `look` columns must be equal; a row without times joins nothing. There
    is no lower bound of the gap. The end becomes the last row's end.
    """

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        first: dict = {}
        for row in rows:
            cur = out[-1] if out else None
            joins = False
            if cur and cur["end"] is not None and row["start"] is not None and all(first[c] == row[c] for c in look):
                step = row["start"] - cur["end"]
                own = None if first["start"] is None or first["end"] is None else first["end"] - first["start"]
                its = None if row["end"] is None else row["end"] - row["start"]
                a, b = visible(cur["text"]), visible(row["text"])
                if step == 0 and own is not None and its is not None and alike(a, b) and min(own, its) < echo:
                    joins = True
                    if its >= echo:
                        cur["text"] = row["text"]
                elif step <= gap:
                    brief = (own is not None and own < short) or (its is not None and its < short)
                    joins = a == b or (brief and distance(a, b) == 1)
            if joins:
                cur["end"], cur["n_rows"] = row["end"], cur["n_rows"] + 1
            else:
                first = row
                out.append({k: row[k] for k in ("start", "end", "text", *look)} | {"n_rows": 1})
        return out

    return fold


def merge_alternating(look: Sequence[str] = ()) -> Fold:
    """Runs A B A (B A ...) of two variants without gaps become one row of A; greedy from the left, no overlaps.

    The first three must be exact, A and B alike by seven tenths; what follows may differ by a tenth from
    the one that is due.
    """

    def fold(rows: list[dict]) -> list[dict]:
        said = [visible(r["text"]) for r in rows]
        fits = lambda i, j: rows[j - 1]["end"] is not None and rows[j - 1]["end"] == rows[j]["start"] and all(rows[i][c] == rows[j][c] for c in look)
        out, i = [], 0
        while i < len(rows):
            stop = i
            if i + 2 < len(rows) and fits(i, i + 1) and fits(i, i + 2) and said[i] == said[i + 2] != said[i + 1] and alike(said[i], said[i + 1]):
                stop = i + 2
                while stop + 1 < len(rows) and fits(i, stop + 1) and alike(said[stop + 1], said[i + (stop + 1 - i) % 2], 0.9):
                    stop += 1
            out.append({k: rows[i][k] for k in ("start", "text", *look)} | {"end": rows[stop]["end"], "n_rows": stop - i + 1})
            i = stop + 1
        return out

    return fold


def gap_clusters(reach: float, file: str) -> Fold:
    """Rows (middle, file, at) numbered by cluster: a row joins the open one while within reach of its first middle, once a file."""

    def fold(rows: list[dict]) -> list[dict]:
        out, nth, anchor, files = [], -1, 0.0, set()
        for r in rows:
            if nth < 0 or r["middle"] - anchor > reach or r[file] in files:
                nth, anchor, files = nth + 1, r["middle"], set()
            files.add(r[file])
            out.append({file: r[file], "at": r["at"], "cluster": nth})
        return out

    return fold


def merge_readings(gap: int, ratio: int) -> Fold:
    """Readings (start, end, text, confidence) join the open group while near and alike its surest text so far."""

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in rows:
            cur = out[-1] if out else None
            if cur and r["start"] - cur["end"] <= gap and indel_ratio(cur["text"], r["text"]) >= ratio:
                cur["end"], cur["n_rows"] = max(cur["end"], r["end"]), cur["n_rows"] + 1
                if r["confidence"] > cur["confidence"]:
                    cur["text"], cur["confidence"] = r["text"], r["confidence"]
            else:
                out.append({k: r[k] for k in ("start", "end", "text", "confidence")} | {"n_rows": 1})
        return out

    return fold


def suppress(apart: int, most: int) -> Fold:
    """Greedy non-max suppression: the largest value, nothing within `apart` of it, and so on; in time order."""

    def fold(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in sorted(rows, key=lambda r: (-r["value"], r["at"])):
            if len(kept) < most and all(abs(r["at"] - k["at"]) > apart for k in kept):
                kept.append(r)
        return [{"at": r["at"], "value": r["value"]} for r in sorted(kept, key=lambda r: r["at"])]

    return fold


def spread_order(rows: list[dict]) -> list[dict]:
    """Farthest-point order of positions: the first, then each time the one farthest from all taken (ties: the lowest)."""
    left, taken = [r["at"] for r in rows], []
    near = {a: float("inf") for a in left}
    while left:
        best = max(left, key=lambda a: (near[a], -a))
        taken.append(best)
        left.remove(best)
        for a in left:
            near[a] = min(near[a], abs(a - best))
    return [{"at": a, "place": k} for k, a in enumerate(taken)]


def online_clusters(reach: float, idle: int) -> Fold:
    """Observations (at, x) join the first open cluster whose running centre is within reach and that was seen lately."""

    def fold(rows: list[dict]) -> list[dict]:
        open_: list[dict] = []
        for r in rows:
            for c in open_:
                if abs(c["total"] / c["n_rows"] - r["x"]) <= reach and r["at"] - c["last"] <= idle:
                    c["total"], c["n_rows"], c["last"] = c["total"] + r["x"], c["n_rows"] + 1, r["at"]
                    break
            else:
                open_.append({"first": r["at"], "last": r["at"], "total": r["x"], "n_rows": 1})
        return [{"first": c["first"], "last": c["last"], "n_rows": c["n_rows"]} for c in open_]

    return fold


def drop_duplicates_to_fixpoint(near: float) -> Fold:
    """Spans (start, end, x) that overlap by half of the shorter and lie near each other: the earlier takes in the later, until none is left."""

    def fold(rows: list[dict]) -> list[dict]:
        spans = [{k: r[k] for k in ("start", "end", "x")} | {"n_rows": 1} for r in rows]
        again = True
        while again:
            again = False
            for i, a in enumerate(spans):
                for j in range(len(spans) - 1, i, -1):
                    b = spans[j]
                    common = min(a["end"], b["end"]) - max(a["start"], b["start"])
                    if 2 * common >= min(a["end"] - a["start"], b["end"] - b["start"]) and common > 0 and abs(a["x"] - b["x"]) <= near:
                        a["start"], a["end"], a["n_rows"] = min(a["start"], b["start"]), max(a["end"], b["end"]), a["n_rows"] + b["n_rows"]
                        del spans[j]
                        again = True
        return spans

    return fold


def track(similar: float, every: int, most: int) -> Fold:
    """Frames (at, x) through the two-state machine: `frame` at a change, `candidate` at every so-manieth like frame
    (at most `most`), `extend` for the others, `done` with the last like frame at the next change."""

    def fold(rows: list[dict]) -> list[dict]:
        out, state = [], Tracker(similar, every, most)
        for r in rows:
            out += state.feed(r["at"], r["x"])
        return out + state.flush()

    return fold


class Tracker:
    """The state machine of `track`; its state is a tuple of plain numbers, so a stream can keep it."""

    def __init__(self, similar: float, every: int, most: int, state: tuple | None = None):
        self.similar, self.every, self.most = similar, every, most
        self.x, self.last, self.seen, self.candidates = state or (None, None, 0, 0)

    @property
    def state(self) -> tuple:
        return (self.x, self.last, self.seen, self.candidates)

    def feed(self, at: int, x: float) -> list[dict]:
        if self.x is not None and abs(x - self.x) <= self.similar:
            self.last, self.seen = at, self.seen + 1
            if self.seen % self.every == 0 and self.candidates < self.most:
                self.candidates += 1
                return [{"at": at, "kind": "candidate"}]
            return [{"at": at, "kind": "extend"}]
        out = self.flush()
        self.x, self.last, self.seen, self.candidates = x, at, 0, 0
        return [*out, {"at": at, "kind": "frame"}]

    def flush(self) -> list[dict]:
        return [] if self.x is None else [{"at": self.last, "kind": "done"}]


def ratio_column(a: str, b: str):
    """indel_ratio of two columns, Arrow-batched."""

    @F.pandas_udf("int")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return ratio(F.col(a), F.col(b))


def admit(budget: int) -> Fold:
    """Rows (id, size) in order, each taken whole or not at all while its size still fits."""

    def fold(rows: list[dict]) -> list[dict]:
        out, used = [], 0
        for r in rows:
            if used + r["size"] <= budget:
                used += r["size"]
                out.append({"id": r["id"], "used": used})
        return out

    return fold


def draw(count: int, apart: float, tries: int, seed: int) -> Fold:
    """A seeded draw of up to `count` of the rows (at) that keep their distance; `tries` misses end it."""
    import random

    def fold(rows: list[dict]) -> list[dict]:
        rng, taken, missed = random.Random(seed), [], 0
        while rows and len(taken) < count and missed < tries:
            at = rng.choice(rows)["at"]
            if all(abs(at - t) >= apart for t in taken):
                taken.append(at)
            else:
                missed += 1
        return [{"at": t} for t in sorted(taken)]

    return fold


def batches(near: float) -> Fold:
    """Rows (start, end, x) to the first batch that one of its rows touches in time and lies near."""

    def fold(rows: list[dict]) -> list[dict]:
        groups: list[list[dict]] = []
        for r in rows:
            for g in groups:
                if any(abs(r["x"] - o["x"]) <= near and r["start"] <= o["end"] and o["start"] <= r["end"] for o in g):
                    g.append(r)
                    break
            else:
                groups.append([r])
        return [{"start": min(r["start"] for r in g), "end": max(r["end"] for r in g), "n_rows": len(g)} for g in groups]

    return fold


def text_lines(rows: list[dict]) -> list[dict]:
    """Words (id, center, size) numbered by line: each joins the first line that has a word whose centre lies
    within half of both sizes' mean."""
    lines: list[list[tuple]] = []
    out = []
    for r in rows:
        center, size = r["center"], r["size"]
        for nth, line in enumerate(lines):  # noqa: B007
            for c, s in line:
                if abs(center - c) <= (size + s) / 4:
                    break
            else:
                continue
            line.append((center, size))
            break
        else:
            nth = len(lines)
            lines.append([(center, size)])
        out.append({"id": r["id"], "line": nth})
    return out


def content_segments(ratio: int) -> Fold:
    """Readings (at, text, confidence) in order, cut where one is not like the surest of the segment so far.

    A segment's text is its longest reading, then the surest, then the first.
    """

    def fold(rows: list[dict]) -> list[dict]:
        groups: list[list[dict]] = []
        for r in rows:
            if groups and indel_ratio(max(groups[-1], key=lambda x: x["confidence"])["text"], r["text"]) >= ratio:
                groups[-1].append(r)
            else:
                groups.append([r])
        best = [max(g, key=lambda x: (len(x["text"]), x["confidence"])) for g in groups]
        return [{"start": g[0]["at"], "end": g[-1]["at"], "text": b["text"], "confidence": b["confidence"], "n_rows": len(g)} for g, b in zip(groups, best, strict=True)]

    return fold
