"""Personal data by boosted candidates, in DataFrame operations only.

Generators of high recall propose spans, which may overlap: the four base formats before their checks, and
looser ones (account numbers and dialled numbers inside longer runs, phone-like groups without a country,
spelled-out addresses, identity and bank codes). What is known of a candidate is its label:

- ip, card, phone: the base check; account: the check digit, and 12 to 19 digits;
- dial: 9 to 15 digits; not known where more digits follow;
- number: 7 to 15 digits behind a word such as "phone" or "fax" (which no feature shows);
- contact: a host with a dot that ends in 2 to 24 letters;
- code: the remainder of 97 of a bank code, the excluded ranges of an identity number.

Format and context features of each candidate are small integers, so all candidates of a corpus come down
to a table of feature combinations with counts, of a size fixed by the bins. On one half of the documents
boosted trees are fitted to the labels; on the other half each kind gets the lowest score from which on
the share of confirmed candidates is surely high enough (the lower end of its interval). The trees become
one SQL expression. Base spans that pass their checks stay whatever their score. Of the looser kinds those
above their threshold are added, but for those whose check digits refute them.

No pattern has a repeated group: nested repeats are turned into plain runs by blanking, in a copy of
equal length, the separators that cannot belong to a match. So texts of any length need no deep stack.
Places are running sums in two levels, and what lies inside base spans shows in a running maximum, so the
work grows with the matches of a text, not with their square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import Stage

# The base formats' characters.
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_START = r"(?:(?<![%s])|\G)"
EMAIL = _START % _LOCAL + rf"[{_LOCAL}]++@[{_DOMAIN}]++\.[{_DOMAIN}.]++"
IP = _START % "0-9" + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]{11,}+"  # shorter ones fail their check anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_OCTETS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

_ALONE = r"(?<![0-9A-Za-z+])"
ACCOUNT = r"(?<![0-9A-Za-z])(?:[0-9]{12,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4})(?![0-9A-Za-z])"
DIAL = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
NUMBER = _ALONE + r"\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z])"
CONTACT = rf"[{_LOCAL}]++ ?[\[(] ?at ?[\])] ?[{_DOMAIN}.]*[{_DOMAIN}]"
CODE = _ALONE + r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4} ?[A-Z0-9]{4}(?: ?[A-Z0-9]{1,4})?(?: ?[A-Z0-9]{1,4})?(?: ?[A-Z0-9]{1,4})?(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
CUES = r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp)\W{0,6}(?:\w{1,8}\W{1,3})?$"
HOST = r"\.[A-Za-z]{2,24}$"
_IDENTITY = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
REACH, STRIDE = 32, 128

KINDS = ("email", "ip", "card", "phone", "account", "dial", "number", "contact", "code")
N_BASE = 4
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, ACCOUNT, DIAL, NUMBER, CONTACT, CODE), strict=True))
#: Kinds whose check, where it fails, refutes a candidate.
CHECKED = ("ip", "card", "phone", "account", "code")
#: Features of a candidate and the largest value of each; values are 0 to that.
BINS = {"kind": len(KINDS) - 1, "digits": 9, "gaps": 5, "letters": 5, "lead": 10, "before": 2, "after": 2, "line": 1}
TREES, RATE, MIN_PRECISION = 24, 0.4, 0.85


def _running(values: Column, step: str) -> Column:
    """The running sum or maximum (`step` of a and x) of an array of longs, itself included, in two levels."""
    out = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int")),
        lambda q: F.slice(values, q * STRIDE + 1, F.lit(STRIDE)),
    )
    add = (lambda a, x: a + x) if step == "sum" else F.greatest
    zero = F.struct(F.lit(0 if step == "sum" else -1).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def grow(s: Column, x: Column) -> Column:
        now = add(s["at"], x)
        return F.struct(now.alias("at"), F.concat(s["out"], F.array(now)).alias("out"))

    inner = F.transform(out, lambda part: F.aggregate(part, zero, grow, lambda s: s["out"]))
    tops = F.aggregate(inner, zero, lambda s, x: F.struct(add(s["at"], F.element_at(x, -1)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    whole = F.flatten(F.zip_with(inner, tops, lambda x, top: F.transform(x, lambda v: add(v, top))))
    return F.when(F.size(values) > 0, whole).otherwise(F.expr("cast(array() as array<bigint>)"))


def _pieces(t: Column, pattern: str) -> Column:
    r"""Each leftmost match with all that stands between it and the one before."""
    # \G: the search for a piece begins where the last one ended, and nowhere else
    return F.regexp_extract_all(t, F.lit(rf"\G(?s).*?(?:{pattern})"), F.lit(0))


def _matches(pieces: Column, ends: Column, t: Column, pattern: str) -> Column:
    """[(b, m, l, n)]: end and text of each match, the REACH characters before it and itself, and what follows it."""
    behind = F.concat(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), F.array(F.substr(t, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)).cast("int") + 1, F.lit(2))))
    behind = F.transform(behind, lambda x: F.left(x, F.lit(2)))

    def one(p: Column, i: Column) -> Column:
        m = F.regexp_extract(p, pattern, 0)
        return F.struct(ends[i].alias("b"), m.alias("m"), F.right(p, F.length(m) + REACH).alias("l"), behind[i].alias("n"))

    return F.transform(pieces, one)


def _luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _bank(code: Column) -> Column:
    """Whether the remainder of 97 of a bank code is 1."""
    flat = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.left(flat, F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        v = F.ascii(F.substr(turned, i, F.lit(1)))
        digit = F.when(v < 65, v - 48).otherwise(v - 55)
        return (a * F.when(v < 65, 10).otherwise(100) + digit) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _label(c: Column, kind: str) -> Column:
    """What is known of a candidate: confirmed or not, null where nothing is."""
    m, no = c["m"], F.lit(False)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind in ("card", "account"):
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(no)
    if kind == "dial":
        return F.when(~c["n"].rlike(r"^[ .-]?[0-9]"), F.length(digits).between(9, 15))
    if kind == "number":
        return F.length(digits).between(7, 15) & F.left(c["l"], F.length(c["l"]) - F.length(m)).rlike(CUES)
    return {
        "email": F.lit(True),
        "ip": m.rlike(_OCTETS),
        "phone": F.length(digits).between(9, 15),
        "contact": m.rlike(HOST),
        "code": F.when(m.rlike("^[0-9]"), m.rlike(_IDENTITY)).otherwise(_bank(m)),
    }[kind]


def _features(c: Column, kind: int) -> list[Column]:
    before = F.left(c["l"], F.length(c["l"]) - F.length(c["m"]))
    count = lambda cls: F.length(c["m"]) - F.length(F.regexp_replace(c["m"], cls, ""))
    lead = F.regexp_extract(c["m"], "[0-9]", 0)
    bins = [
        F.lit(kind),
        F.when(count("[0-9]") < 4, 0).otherwise(F.least(F.floor((count("[0-9]") - 2) / 2), F.lit(9))),
        F.least(count("[^A-Za-z0-9]"), F.lit(5)),
        F.least(F.ceil(count("[A-Za-z]") / 4), F.lit(5)),
        F.when(lead == "", 10).otherwise(lead.cast("int")),
        F.when(before.rlike("[A-Za-z0-9]$"), 1).when(before.rlike(r"[^\x20\x0A]$"), 2).otherwise(0),
        F.when(c["n"].rlike(r"^[ .-]?[0-9]"), 1).when(c["n"].rlike(r"^[^\x20\x0A]"), 2).otherwise(0) if kind != KINDS.index("dial") else F.lit(0),
        c["m"].contains("\n").cast("int"),
    ]
    return [F.coalesce(x.cast("int"), F.lit(0)).alias(n) for n, x in zip(BINS, bins, strict=True)]


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, half, cands): each candidate of each row with its place, its label and its features."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digits = F.col("t").rlike(r"[0-9][\x20.-]?[0-9]")
    mails = F.regexp_replace("t", rf"\.(?![{_DOMAIN}])", "_")
    cards = F.regexp_replace("t", r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "_")
    asked = {
        "email": (F.contains("t", F.lit("@")), mails),
        "card": (digits, cards),
        "phone": (F.contains("t", F.lit("+")), F.col("t")),
        "dial": (F.contains("t", F.lit("+")), F.col("t")),
        "contact": (F.col("t").rlike(r"[\[(] ?at ?[\])]"), F.col("t")),
    }
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"))
    none = F.expr("cast(array() as array<string>)")
    pieces = [F.coalesce(F.when(asked.get(k, (digits,))[0], _pieces(asked.get(k, (0, F.col("t")))[1], p)), none).alias(f"p_{k}") for k, p in PATTERNS.items()]
    rows = rows.select("doc_id", "t", *pieces)
    ends = [_running(F.transform(f"p_{k}", lambda p: F.length(p).cast("long")), "sum").alias(f"e_{k}") for k in KINDS]
    rows = rows.select("*", *ends)

    def found(k: str, nth: int) -> Column:
        one = lambda c: F.struct((c["b"] - F.length(c["m"])).alias("a"), c["b"].alias("b"), _label(c, k).alias("ok"), *_features(c, nth))
        return F.transform(_matches(F.col(f"p_{k}"), F.col(f"e_{k}"), F.col("t"), PATTERNS[k]), one)

    # the places of blanked copies are those of the text, and so are their digits
    every = F.concat(*[found(k, nth) for nth, k in enumerate(KINDS)])
    return rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), every.alias("cands"))


def _tree(rows: list[tuple], grad: list[float], hess: list[float], depth: int) -> float | tuple:
    """(feature, value, left, right): left if the feature is no more than the value; or a leaf."""
    g, h = sum(grad), sum(hess)
    leaf = RATE * g / (h + 1.0)
    if not depth or len(rows) < 2:
        return leaf
    best = (1e-9, None)
    for f in range(len(BINS)):
        by: dict[int, list[float]] = {}
        for row, x, y in zip(rows, grad, hess, strict=True):
            cell = by.setdefault(row[f], [0.0, 0.0])
            cell[0] += x
            cell[1] += y
        lg = lh = 0.0
        for v in sorted(by)[:-1]:
            lg, lh = lg + by[v][0], lh + by[v][1]
            gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, v))
    if best[1] is None:
        return leaf
    f, v = best[1]
    sides = []
    for low in (True, False):
        pick = [k for k, row in enumerate(rows) if (row[f] <= v) == low]
        sides.append(_tree([rows[k] for k in pick], [grad[k] for k in pick], [hess[k] for k in pick], depth - 1))
    return (f, v, *sides)


def _apply(tree: float | tuple, row: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql(tree: float | tuple, c: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.9f}D"
    return f"(CASE WHEN {c}.{list(BINS)[tree[0]]} <= {tree[1]} THEN {_sql(tree[2], c)} ELSE {_sql(tree[3], c)} END)"


def fit(combos: list[tuple[tuple, float, float]]) -> list:
    """Boosted trees (log loss) on feature combinations (features, confirmed, all)."""
    trees: list = []
    rows = [c[0] for c in combos]
    score = [0.0] * len(rows)
    for _ in range(TREES if combos else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [good - n * q for (_, good, n), q in zip(combos, p, strict=True)]
        hess = [n * q * (1 - q) for (_, _, n), q in zip(combos, p, strict=True)]
        trees.append(_tree(rows, grad, hess, 3))
        score = [s + _apply(trees[-1], r) for s, r in zip(score, rows, strict=True)]
    return trees


def _surely(good: float, n: float) -> float:
    """The lower end of the interval of a share (Wilson, one standard error)."""
    p = good / n
    return (p + 0.5 / n - math.sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1 / n)


def thresholds(trees: list, combos: list[tuple[tuple, float, float]], least: float = MIN_PRECISION) -> dict[int, float]:
    """kind -> the lowest score from which on its held-out candidates are surely confirmed often enough; kinds without one are left out."""
    out = {}
    for kind in range(N_BASE, len(KINDS)):
        scored = sorted(((sum(_apply(t, r) for t in trees), good, n) for r, good, n in combos if r[0] == kind), reverse=True)
        good, n = 0.0, 0.0
        for k, (s, g, m) in enumerate(scored):
            good, n = good + g, n + m
            if (k + 1 == len(scored) or scored[k + 1][0] < s) and _surely(good, n) >= least:
                out[kind] = s
    return out


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_added, n_spans, base_sha256, spans.

    Spans are kind:start:end in code points, the end exclusive, by start and then kind as in KINDS. A
    null text counts as empty (no spans, the hash of nothing). An added span lies in no base span. Where
    nothing teaches the trees, nothing is added. Null doc_ids and repeated rows come out as they came;
    extra columns are ignored; an empty table gives none.
    """
    stage = Stage(docs.sparkSession, "pii")
    found = stage.save(candidates(docs, text, doc_id), "candidates")
    table = found.where(F.size("cands") > 0).select("half", F.inline("cands")).where("kind > 0 and ok is not null")
    table = table.groupBy("half", *BINS).agg(F.sum(F.col("ok").cast("long")).alias("good"), F.count("*").alias("n")).collect()
    halves = [[(tuple(r[f] for f in BINS), float(r["good"]), float(r["n"])) for r in table if r["half"] == h] for h in (0, 1)]
    trees = fit(sorted(halves[0]))
    least = thresholds(trees, halves[1]) if trees else {}
    base = F.filter("cands", lambda c: F.coalesce(c["ok"], F.lit(False)) & (c["kind"] < N_BASE))
    out = found.withColumn("base", base)
    if least:
        score = " + ".join(_sql(t, "c") for t in trees)
        checked = ", ".join(str(KINDS.index(k)) for k in CHECKED)
        limit = "CASE c.kind " + " ".join(f"WHEN {k} THEN {x - 1e-6:.9f}D" for k, x in least.items()) + " END"
        loose = F.expr(f"filter(cands, c -> c.kind IN ({', '.join(map(str, least))}) AND NOT (c.kind IN ({checked}) AND NOT c.ok) AND {score} >= {limit})")
        # by start, base spans first: a span is inside one if a base span before it ends no earlier
        place = lambda s, first: F.transform(s, lambda c: F.struct(c["a"].alias("a"), F.lit(first).alias("o"), c["b"].alias("b"), c["kind"].alias("kind")))
        out = out.withColumn("line", F.array_sort(F.concat(place("base", 0), place(F.array_distinct(loose), 1))))
        out = out.withColumn("reach", _running(F.transform("line", lambda c: F.when(c["o"] == 0, c["b"]).otherwise(F.lit(-1).cast("long"))), "max"))
        out = out.withColumn("more", F.filter("line", lambda c, i: (c["o"] == 1) & (F.col("reach")[i] < c["b"])))
        out = out.withColumn("more", F.transform("more", lambda c: F.struct(c["a"].alias("a"), c["kind"].alias("kind"), c["b"].alias("b"))))
    else:
        out = out.withColumn("more", F.expr("cast(array() as array<struct<a:bigint,kind:int,b:bigint>>)"))
    out = out.withColumn("base", F.transform("base", lambda c: F.struct(c["a"].alias("a"), c["kind"].alias("kind"), c["b"].alias("b"))))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda s: F.array_join(F.transform(F.array_sort(s), lambda c: F.concat_ws(":", names[c["kind"]], c["a"].cast("string"), c["b"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(
        "doc_id",
        *[count(k) for k in range(N_BASE)],
        F.size("more").cast("long").alias("n_added"),
        (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
    )
