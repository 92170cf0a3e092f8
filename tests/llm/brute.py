"""Plain versions of the operators, to hold them against."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def pii_ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
        "card": 12 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def pii(text):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if pii_ok(k, m[0]))
    return [f"{k}:{a}:{b}" for a, _, b, k in spans]


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_links(sets, percent=80):
    holders, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        for k, b in enumerate(held):
            for a in held[:k]:
                common[a, b] += 1
    return [p for p, c in common.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def owed(weights, blocks, v):
    """Slots gone by at virtual time v, when a source of weight w has been owed w * v blocks, or all it has."""
    return sum(min(Fraction(blocks[s]), weights[s] * v) for s in blocks)


def window(weights, blocks, s, i):
    """First slot in which block i of source s may go, and the one by which it must have gone."""
    lo, hi = (owed(weights, blocks, Fraction(k, weights[s])) for k in (i, i + 1))
    return math.floor(lo), math.ceil(hi)


def most_deviation(weights, slots):
    """The largest distance of a source, while it has blocks, from its target share of the slots since another ran out.

    slots: the source of each slot.
    """
    left, worst, due, had = Counter(slots), Fraction(0), dict.fromkeys(slots, Fraction(0)), Counter()
    for s in slots:
        alive = [x for x in left if left[x]]
        total = sum(weights[x] for x in alive)
        for x in alive:
            due[x] += Fraction(weights[x], total)
        had[s] += 1
        left[s] -= 1
        worst = max(worst, *(abs(due[x] - had[x]) for x in alive if left[x]), 0)
    return worst


def kneser_ney(counts, symbols):
    """trigram -> probability: interpolated modified Kneser-Ney from {trigram: count}, by the book."""
    orders, now = [], dict(counts)
    for order in (3, 2, 1):
        c = [0, *(sum(v == k for v in now.values()) for k in (1, 2, 3, 4))]
        if min(c[1:4]):
            y = c[1] / (c[1] + 2 * c[2])
            cut = [0, *(min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.05), k - 0.05) for k in (1, 2, 3))]
        else:
            cut = [0, 0.5, 0.5, 0.5]
        total, held = Counter(), Counter()
        for g, v in now.items():
            total[g[:-1]] += v
            held[g[:-1]] += cut[min(v, 3)]
        orders.append((now, cut, total, held))
        if order > 1:
            now = Counter(g[1:] for g in now)

    def p(g, k=0):
        if k == 3:
            return 1 / symbols
        now, cut, total, held = orders[k]
        lower, v = p(g[1:], k + 1), now.get(g, 0)
        return (v - cut[min(v, 3)] + held[g[:-1]] * lower) / total[g[:-1]] if total[g[:-1]] else lower

    return p


def shape(word):
    kind = lambda b: 0 if 97 <= b < 123 or b > 127 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3
    b = word.encode()
    return len(b) > 6, kind(b[0]), kind(b[-1]), any(kind(x) for x in b[1:-1])


def perplexities(rows, classes, word_bytes, lang_share):
    """(words, letters): the log-perplexity of each (lang, text) by both models, None without words."""
    size = Counter()
    for lang, text in rows:
        size[lang] += len((text or "").encode())
    model = lambda lang: lang if size[lang] and size[lang] * lang_share >= sum(size.values()) else "other"
    own = Counter()
    for lang, n in size.items():
        own[model(lang)] += n
    texts = [(model(lang), WORD.findall(text or "")) for lang, text in rows]
    seen = Counter((lang, w) for lang, ws in texts for w in ws)
    common = {k for k, n in seen.items() if n * word_bytes >= own[k[0]]}
    token = lambda lang, w: w if (lang, w) in common else shape(w)
    of_words = lambda lang, ws: [g for t in [[0, 0, *(token(lang, w) for w in ws)]] for g in zip(t, t[1:], t[2:], strict=False)]
    of_letters = lambda lang, ws: [g for w in ws for t in [[0, 0, *(int(classes[b]) for b in w.encode()), 0]] for g in zip(t, t[1:], t[2:], strict=False)]
    out = []
    for grams, symbols in ((of_words, 64 + len(common)), (of_letters, 64)):
        counts = defaultdict(Counter)
        for lang, ws in texts:
            counts[lang].update(grams(lang, ws))
        models = {lang: kneser_ney(c, symbols) for lang, c in counts.items() if c}
        log = [[math.log(models[lang](g)) for g in grams(lang, ws)] for lang, ws in texts]
        out.append([-sum(x) / len(x) if x else None for x in log])
    return out


def band(values, below, above, slack):
    """The ends of a band, from the quartiles (elements, not between them)."""
    v = sorted(values)
    q = [v[max(0, math.ceil(len(v) * p) - 1)] for p in (0.25, 0.75)]
    return q[0] - below * (q[1] - q[0]) - slack, q[1] + above * (q[1] - q[0]) + slack


def verdicts(rows, classes, word_bytes, lang_share, below, above, slack):
    """(kept, base, low or high) of each (lang, text)."""
    failed = [n < 50 or 100 * r > 50 * n for n, _, _, _, r in (base_counts(t) for _, t in rows)]
    found = perplexities(rows, classes, word_bytes, lang_share)
    bands = {}
    for lang in {lang for (lang, _), f in zip(rows, failed, strict=True) if not f}:
        mine = [k for k, (x, _) in enumerate(rows) if x == lang and not failed[k]]
        bands[lang] = [band([v[k] for k in mine], below, above, s) for v, s in zip(found, (0.0, slack), strict=True)]
    out = []
    for k, (lang, _) in enumerate(rows):
        pairs = [] if failed[k] else [(v[k], *b) for v, b in zip(found, bands[lang], strict=True)]
        out.append("base" if failed[k] else "low" if any(v < a for v, a, _ in pairs) else "high" if any(v > b for v, _, b in pairs) else "kept")
    return out, found


def bank(code):
    flat = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def label(kind, m, before, after, host, cues, identity):
    digits = re.sub("[^0-9]", "", m)
    if kind == "account":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "dial":
        return None if re.match("[ .-]?[0-9]", after) else 9 <= len(digits) <= 15
    if kind == "number":
        return 7 <= len(digits) <= 15 and bool(re.search(cues, before, re.A))
    if kind == "contact":
        return bool(re.search(host, m))
    if kind == "code":
        return bool(re.search(identity, m)) if m[0].isdigit() else bank(m)
    return pii_ok(kind, m)


def features(nth, kind, m, before, after):
    digits, other, letters = (len(re.findall(c, m)) for c in ("[0-9]", "[^A-Za-z0-9]", "[A-Za-z]"))
    lead = re.search("[0-9]", m)
    return (
        nth,
        0 if digits < 4 else min((digits - 2) // 2, 9),
        min(other, 5),
        min(-(-letters // 4), 5),
        int(lead[0]) if lead else 10,
        1 if re.search(r"[A-Za-z0-9]\Z", before) else 2 if re.search(r"[^\x20\x0A]\Z", before) else 0,
        0 if kind == "dial" else 1 if re.match(r"[ .-]?[0-9]", after) else 2 if re.match(r"[^\x20\x0A]", after) else 0,
        int("\n" in m),
    )


def pii_candidates(text, pii_module):
    """(kind, start, end, label, features) of each candidate of a text."""
    text, out = text or "", []
    for nth, kind in enumerate(pii_module.KINDS):
        last = 0
        for m in re.finditer(PII.get(kind) or pii_module.PATTERNS[kind], text):
            if kind == "card" and len(m[0]) < 12:
                continue
            before, after = text[last : m.start()][-pii_module.REACH :], text[m.end() : m.end() + 2]
            known = label(kind, m[0], before, after, pii_module.HOST, pii_module.CUES, pii_module._IDENTITY)
            out.append((kind, m.start(), m.end(), known, features(nth, kind, m[0], before, after)))
            last = m.end()
    return out
