"""Queries that SQL cannot express, against plain versions on the same rows, written another way."""

import itertools
import random

import harness
import numpy as np
import pytest

from tessera.functions.clock import MICROS
from tessera.plans import catalog

HOUR = 3600 * MICROS


def read(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{harness.DATA}/{name}.parquet").to_pylist()


def micros(ts):
    import calendar

    return calendar.timegm(ts.timetuple()) * MICROS + ts.microsecond


def by_user(rows):
    out = {}
    for r in rows:
        out.setdefault(r["user_id"], []).append(r)
    return out


def lcs(a, b):
    """Length of the longest common subsequence."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def ratio(a, b):
    return 100 if not a + b else round(200 * lcs(a, b) / (len(a) + len(b)))


def subtitle_merge():
    out = []
    for user, rows in by_user(read("events")).items():
        rows = [(micros(r["ts"]) // HOUR, (micros(r["ts"]) + int(r["value"] * 60) * MICROS) // HOUR + 1, r["event_type"], r["value"], r["event_id"]) for r in rows]
        groups = []
        for a, b, t, c, _ in sorted(rows, key=lambda r: (r[0], r[4])):
            if groups and a - max(x[1] for x in groups[-1]) <= 12 and ratio(max(groups[-1], key=lambda x: x[3])[2], t) >= 80:
                groups[-1].append((a, b, t, c))
            else:
                groups.append([(a, b, t, c)])
        for g in groups:
            sure = max(g, key=lambda x: x[3])
            out.append({"user_id": user, "start": g[0][0], "end": max(x[1] for x in g), "text": sure[2], "confidence": sure[3], "n_rows": len(g)})
    return out


def timed(rows):
    return sorted(((micros(r["ts"]), r["event_id"], micros(r["ts"]) + int(r["value"] * 60) * MICROS, r["value"]) for r in rows))


def dup_fixpoint():
    out = []
    for user, rows in by_user(read("events")).items():
        spans = [[a, b, x, 1] for a, _, b, x in timed(rows)]

        def pair(spans=spans):
            """The first pair that joins: lowest first member, then, going down, the last second member not yet passed."""
            for i in range(len(spans)):
                for j in reversed(range(i + 1, len(spans))):
                    a, b = spans[i], spans[j]
                    both = min(a[1], b[1]) - max(a[0], b[0])
                    if both > 0 and 2 * both >= min(a[1] - a[0], b[1] - b[0]) and abs(a[2] - b[2]) <= 30:
                        return i, j
            return None

        while (p := pair()) is not None:
            i, j = p
            a, b = spans[i], spans[j]
            spans[i] = [min(a[0], b[0]), max(a[1], b[1]), a[2], a[3] + b[3]]
            del spans[j]
        out += [{"user_id": user, "start": a, "end": b, "x": x, "n_rows": n} for a, b, x, n in spans]
    return out


def near_pairs_indel():
    kinds = {}
    for r in read("part"):
        kinds.setdefault(r["p_type"], set()).add(r["p_name"])
    pairs = {(a, b) for names in kinds.values() for a, b in itertools.combinations(sorted(names), 2)}
    return [{"a": a, "b": b, "ratio": ratio(a, b)} for a, b in pairs if ratio(a, b) >= 60]


def seeded_draw():
    out = []
    for user, rows in by_user(read("events")).items():
        at = sorted(micros(r["ts"]) for r in rows)
        rng, taken, missed = random.Random(1), set(), 0
        while len(taken) < 5 and missed < 64:
            pick = at[rng._randbelow(len(at))]
            if min((abs(pick - t) for t in taken), default=24 * HOUR) < 24 * HOUR:
                missed += 1
            else:
                taken.add(pick)
        out += [{"user_id": user, "at": t} for t in taken]
    return out


def spatial_batches():
    out = []
    for user, rows in by_user(read("events")).items():
        batch = {}
        for k, (a, _, b, x) in enumerate(timed(rows)):
            touched = [n for n, held in batch.items() if any(abs(x - z) <= 25 and a <= d and c <= b for c, d, z in held)]
            batch.setdefault(min(touched, default=k), []).append((a, b, x))
        out += [{"user_id": user, "start": min(v)[0], "end": max(b for _, b, _ in v), "n_rows": len(v)} for v in batch.values()]
    return out


def spectrum_peaks():
    """Sums of sines, and each cell against its neighbours one by one."""
    window = [0.5 - 0.5 * np.cos(2 * np.pi * n / 15) for n in range(16)]
    waves = np.array([[np.exp(-2j * np.pi * f * n / 16) for f in range(9)] for n in range(16)])
    out = []
    for r in read("embeddings"):
        x = np.array(r["embedding"], float)
        m = np.log1p(np.abs(np.array([(x[k : k + 16] * window) @ waves for k in range(0, len(x) - 15, 8)])))
        for t, f in itertools.product(range(m.shape[0]), range(m.shape[1])):
            around = m[max(t - 1, 0) : t + 2, max(f - 1, 0) : f + 2]
            if m[t, f] > 0.1 and m[t, f] >= around.max():
                out.append({"vec_id": r["vec_id"], "peak": t * 1000 + f})
    return out


def text_lines():
    frames = {}
    for r in sorted(read("lineitem"), key=lambda r: (r["l_partkey"], r["l_suppkey"], r["l_quantity"], r["l_extendedprice"])):
        top = r["l_suppkey"] % 7 * 20
        bottom = top + r["l_quantity"] * (0.5 + r["l_partkey"] % 4 * 0.75)
        frames.setdefault(r["l_orderkey"], []).append((len(frames.get(r["l_orderkey"], [])) + 1, (top + bottom) / 2, bottom - top))
    out = []
    for f, words in frames.items():
        line = {}
        for k, (i, c, h) in enumerate(words):
            near = [line[j] for j, (_, d, g) in enumerate(words[:k]) if abs(c - d) <= (h + g) / 2 * 0.5]
            line[k] = min(near, default=len(set(line.values())))
            out.append({"f": f, "id": i, "line": line[k]})
    return out


def content_segments():
    out = []
    for user, rows in by_user(read("events")).items():
        segments = []
        for at, r in enumerate(sorted(rows, key=lambda r: r["event_id"])):
            text = "" if r["event_id"] % 9 == 0 else r["event_type"][: len(r["event_type"]) - r["event_id"] % 3]
            if segments:
                surest = sorted(segments[-1], key=lambda x: -x[2])[0]
            if segments and ratio(surest[1], text) >= 60:
                segments[-1].append((at, text, r["value"]))
            else:
                segments.append([(at, text, r["value"])])
        for g in segments:
            _, text, confidence = sorted(g, key=lambda x: (-len(x[1]), -x[2]))[0]
            out.append({"user_id": user, "start": g[0][0], "end": g[-1][0], "text": text, "confidence": confidence, "n_rows": len(g)})
    return out


TWINS = {f.__name__: f for f in (subtitle_merge, dup_fixpoint, near_pairs_indel, seeded_draw, spatial_batches, spectrum_peaks, text_lines, content_segments)}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, name):
    columns, rows = harness.spark_rows(catalog.queries()[name](spark, harness.DATA))
    plain = TWINS[name]()
    assert plain and sorted(plain[0]) == sorted(columns)
    assert rows == sorted(tuple(harness._plain(r[c]) for c in columns) for r in plain)
