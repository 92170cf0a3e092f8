"""Operators that look at each text alone, against plain versions."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, perplexity, pii, quality, secrets
from tessera.llm.queries import vocabulary_path


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def counted(pairs):
    return Counter((i, repr(v)) for i, v in pairs)


def both(docs, odd):
    return docs.select("doc_id", "text", "lang", "source", "n_chars").union(odd.select("doc_id", "text", "lang", "source", "n_chars"))


def test_bpe_equals_the_library(spark, docs, odd):
    from hashlib import sha256

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    lib.no_truncation()
    df = both(docs, odd)
    got = counted((r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.encode_decode(df, vocabulary_path()).collect())
    expected = []
    for i, t in rows(df):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        expected.append((i, (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest())))
    assert got == counted(expected)


@pytest.mark.parametrize(
    "text",
    ["it's I'LL we've 'd'd''s", "ΣΑΣ İstanbul ﬁ é é 1234 ½ ٣", "a\x1cb c d　e\x85f", "!!!???...", "</w> a</w>", "́ x ́", "🎉🎊 👨‍👩‍👧", "ab" * 500, "the<|startoftext|>the <|endoftext|"],
)
def test_bpe_odd_words(text):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary_path()), bpe.load(vocabulary_path())
    ids = lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == ids
    assert own.decode(own.encode([text])[0]) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_words_held_once_are_kept(docs, monkeypatch):
    """What a block needs again is not encoded anew when the room for words ends, and the results are the library's."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary_path()), bpe.Tokenizer(vocabulary_path())
    lib.no_truncation()
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2000)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 300)
    learnt, learn = Counter(), own.learn
    monkeypatch.setattr(own, "learn", lambda words: learnt.update(words) or learn(words))
    often = "Zyqavor vorqubzy, xyq'zzvor qwptzy9 Füzqßvor<|endoftext|>"
    texts = [t or "" for _, t in rows(docs)[:300]]
    for t in texts:
        for asked in (t, often):
            assert np.frombuffer(own.encode([asked])[0], "<u4").tolist() == lib.encode(asked, add_special_tokens=False).ids
    assert len(set().union(*(own.words(t) for t in texts))) > 3 * 2000
    assert all(learnt[w] == 1 for w in ("zyqavor", "vorqubzy", "xyq", "zzvor", "qwptzy", "füzqßvor"))


def test_bpe_texts_and_empty_table(odd, none):
    got = {r.doc_id: r for r in bpe.encode_decode(odd, vocabulary_path(), with_ids=True, with_text=True).collect()}
    assert got[5].ids == [] and got[5].decoded == "" and got[7].decoded == "a</w> b</w>"
    assert bpe.encode_decode(none, vocabulary_path()).count() == 0


def test_pii_base_spans(docs, odd, none):
    df = both(docs, odd)
    got = pii.detect(df).collect()
    expected = [(i, brute.pii(t)) for i, t in rows(df)]
    count = lambda spans: tuple(sum(s.startswith(k + ":") for s in spans) for k in brute.PII)
    assert counted((r.doc_id, (r.base_sha256, (r.n_email, r.n_ip, r.n_card, r.n_phone))) for r in got) == counted((i, (brute.sha(s), count(s))) for i, s in expected)
    held = Counter()
    for r in got:
        held[r.doc_id, r.base_sha256] += 1
        assert r.n_spans == len([s for s in r.spans.split(",") if s]) and r.n_added == r.n_spans - r.n_email - r.n_ip - r.n_card - r.n_phone
    by = {(i, brute.sha(s)): set(s) for i, s in expected}
    assert all(by[r.doc_id, r.base_sha256] <= set(r.spans.split(",")) for r in got)
    assert pii.detect(none).count() == 0


@pytest.mark.parametrize(
    "text",
    ["a@b.c_d@e.f x@y..z q@w.e..foo@x.y .@-.- a.@b.c-", "1.2.3.4.5 001.2.3.0004 999.1.1.1 1.1.1.1.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 1 2-3 -4", "+1 (22) 333-4444. +12 3 +49 170 1234567-89+1 2 3 4 5 6 7 8 9", "🎉a@b.cc 日本 4111111111111111"],
)
def test_pii_hard_formats(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.detect(df).first().base_sha256 == brute.sha(brute.pii(text))


def planted_personal_data(rng):
    """(doc_id, text): data that the base formats miss, beside much that only looks like it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        return next(d + x for x in "0123456789" if brute.luhn(d + x))

    def code():
        body = f"{rng.randrange(100):02d}{digits(16)}"
        return next(x for x in (f"DE{k:02d}{body}" for k in range(100)) if brute.bank(x))

    rows, plain = [], "and so it went on for a while"
    for k in range(600):
        phone = f"+1 ({digits(3)}) 555-{digits(4)}"
        text = [
            f"{plain} {card()} {plain} {digits(16)} x",
            f"{plain} {phone} then",
            f"call {digits(3)}-{digits(3)}-{digits(4)} now" if k % 20 else f"seen {digits(3)}-{digits(3)}-{digits(4)} there",
            f"write {rng.choice('abc')}{digits(2)} [at] mail{digits(1)}.example.org today",
            f"bank {code() if k % 12 else 'DE' + digits(20)} and id {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)} here",
        ][k % 5]
        rows.append((k, text))
    rows += [(1000, f"two {card()} {card()} cards"), (1001, "far +1 (212) 555-0101 10.20.30.40 off"), (1002, "é🎉 " + rows[3][1]), (1003, "12 " * 3000 + card()), (1004, None), (1005, "")]
    return rows


def test_pii_added_spans_equal_a_plain_version(spark):
    """Candidates, labels and features by plain loops; the same trees and thresholds; the spans added in the end."""
    import random

    df = spark.createDataFrame(planted_personal_data(random.Random(2)), "doc_id long, text string")
    half = {r.doc_id: r.h for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) AS h").collect()}
    found = {i: brute.pii_candidates(t, pii) for i, t in rows(df)}
    table = [Counter(), Counter()], [Counter(), Counter()]
    for i, cands in found.items():
        for kind, _, _, known, f in cands:
            if kind != "email" and known is not None:
                table[half[i]][0][f] += known
                table[half[i]][1][f] += 1
    halves = [[(f, float(good[f]), float(n[f])) for f in n] for good, n in table]
    trees = pii.fit(sorted(halves[0]))
    least = pii.thresholds(trees, halves[1])
    kinds = {pii.KINDS[k] for k in least}
    assert kinds == {"account", "dial", "number", "contact", "code"}
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    added = Counter()
    for i, cands in found.items():
        base = {(a, b, k) for k, a, b, known, _ in cands if k in brute.PII and known}
        more = set()
        for kind, a, b, known, f in cands:
            over = kind in kinds and sum(pii._apply(t, f) for t in trees) >= least[f[0]] - 1e-6
            if over and not (known is False and kind in pii.CHECKED) and not any(x <= a and b <= y for x, y, _ in base):
                more.add((a, b, kind))
        spans = sorted(base | more, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, b, k in spans), i
        assert got[i].n_added == len(more) and got[i].n_spans == len(spans)
        added.update(k for _, _, k in more)
    assert added["account"] >= 2 and added["dial"] == 1 and min(added["number"], added["contact"], added["code"]) > 100
    assert "account:4:20" in got[1000].spans and "dial:4:21" in got[1001].spans


def test_pii_running_values(spark):
    import random

    rng = random.Random(1)
    rows_in = [(k, [rng.randrange(100) for _ in range(n)]) for k, n in enumerate((0, 1, 2, 127, 128, 129, 1000))]
    df = spark.createDataFrame(rows_in, "id long, v array<bigint>")
    out = df.select("id", pii._running(F.col("v"), "sum").alias("s"), pii._running(F.col("v"), "max").alias("m")).collect()
    for r in out:
        v = rows_in[r.id][1]
        assert r.s == [sum(v[: k + 1]) for k in range(len(v))] and r.m == [max(v[: k + 1]) for k in range(len(v))]


def test_pii_trees_learn_and_calibrate():
    feature = lambda d, before: (6, d, 2, 0, 4, before, 0, 0)
    good = [(feature(d, b), 90.0 if b else 10.0, 100.0) for d in range(10) for b in (0, 1)]
    trees = pii.fit(good)
    score = lambda f: sum(pii._apply(t, f) for t in trees)
    assert score(feature(5, 1)) > 0 > score(feature(5, 0))
    least = pii.thresholds(trees, good, 0.85)
    assert score(feature(5, 1)) >= least[6] > score(feature(5, 0))
    assert pii.thresholds(trees, good, 0.99) == {} and pii.fit([]) == []


def test_secrets(docs, odd, none):
    df = both(docs, odd)
    got = secrets.scan(df).collect()
    expected = [(i, brute.secrets(t)) for i, t in rows(df)]
    assert counted((r.doc_id, r.base_sha256) for r in got) == counted((i, brute.sha(s)) for i, s in expected)
    assert counted((r.doc_id, (r.n_assign, r.n_access, r.n_hex)) for r in got) == counted((i, tuple(sum(x.startswith(k) for x in s) for k in secrets.BASE)) for i, s in expected)
    assert secrets.scan(none).count() == 0


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])) + body


def number(n, rng):
    return der(0x02, b"\x01" + rng.randbytes(n - 1))


def fields(*parts):
    return b"".join(len(x).to_bytes(4, "big") + x for x in parts)


def structures(rng):
    """(name, bytes, whether it is a private key) of each shape."""
    version, curve = der(0x02, b"\0"), der(0x06, b"\x2a\x86\x48\xce\x3d")
    algorithm = der(0x30, curve, der(0x05))
    sealed = der(0x30, der(0x06, bytes.fromhex("2a864886f70d01050d")), der(0x30))
    point = der(0x03, b"\0\4" + rng.randbytes(64))
    integers = [number(k, rng) for k in (64, 3, 64, 32, 32, 32, 32, 32)]
    ed = rng.randbytes(32)
    frame = b"openssh-key-v1\0" + fields(b"none", b"none", b"") + (1).to_bytes(4, "big") + fields(fields(b"ssh-ed25519", ed), rng.randbytes(136))
    return [
        ("integers", der(0x30, version, *integers), True),
        ("six integers", der(0x30, version, *integers[:5]), True),
        ("wrapped", der(0x30, version, algorithm, der(0x04, rng.randbytes(120))), True),
        ("wrapped with attributes", der(0x30, version, algorithm, der(0x04, rng.randbytes(60)), der(0xA0, der(0x30))), True),
        ("curve", der(0x30, der(0x02, b"\1"), der(0x04, rng.randbytes(32)), der(0xA0, curve), der(0xA1, point)), True),
        ("sealed", der(0x30, sealed, der(0x04, rng.randbytes(80))), True),
        ("framed", frame, True),
        ("typed private", fields(b"ssh-ed25519", ed, ed + rng.randbytes(32)), True),
        ("public", der(0x30, algorithm, point), False),
        ("public integers", der(0x30, integers[0], integers[1]), False),
        ("certificate", der(0x30, der(0x30, der(0xA0, der(0x02, b"\2")), integers[1], algorithm, point), algorithm, point), False),
        ("signature", der(0x30, number(32, rng), number(32, rng)), False),
        ("one integer", der(0x30, number(60, rng)), False),
        ("public typed", fields(b"ssh-ed25519", ed), False),
        ("public typed integers", fields(b"ssh-rsa", b"\1\0\1", rng.randbytes(128)), False),
        ("short", der(0x30, version, algorithm, der(0x04, rng.randbytes(120)))[:-1], False),
        ("noise", b"\x30" + rng.randbytes(90), False),
    ]


def token(head):
    import base64

    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    return ".".join([part(head), part(b'{"sub":"1"}'), part(b"signed with care")])


def test_planted_secrets_come_out_with_their_places(spark, docs):
    """Every private structure, in four spellings, in real texts: the spans found are the planted ones and the base ones."""
    import base64
    import random

    rng, texts = random.Random(11), [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect()]
    planted, expected = [], {}
    for name, data, private in structures(rng):
        kind = "sshkey" if b"ssh-" in data else "der"
        for spell in ("base64", "url", "hex", "armour"):
            b64 = base64.b64encode(data).decode()
            lines = "\n".join(b64[k : k + 64] for k in range(0, len(b64), 64))
            body = {"base64": b64, "url": base64.urlsafe_b64encode(data).decode(), "hex": data.hex().upper(), "armour": f"-----BEGIN X PRIVATE KEY-----\n{lines}\n-----END X PRIVATE KEY-----"}[spell]
            words = rng.choice(texts).split(" ")
            at = rng.randrange(len(words) + 1)
            before = " ".join([*words[:at], "é🎉 "])
            text, i = before + body + " " + " ".join(words[at:]), len(planted)
            own = {f"{'armour' if spell == 'armour' else kind}:{len(before)}:{len(before) + len(body)}"} if private else set()
            planted.append((i, text))
            expected[i] = (name, spell, {*brute.secrets(text), *own})
    for head, own in ((b'{"alg":"HS256","typ":"JWT"}', True), (b'{"alg":"none"}', False), (b'{"typ":"JWT"}', False), (b"[1]", False)):
        t = token(head)
        planted.append((len(planted), f"é {t} end"))
        expected[len(planted) - 1] = (head, "token", {f"signed:2:{2 + len(t)}"} if own else set())
    for r in secrets.scan(spark.createDataFrame(planted, "doc_id long, text string")).collect():
        name, spell, spans = expected[r.doc_id]
        found = {x for x in r.spans.split(",") if x}
        if spell == "armour":  # a long line of the body may stand on its own
            found = {x for x in found if not x.startswith(("der", "sshkey"))}
        assert found == spans, (name, spell)


def test_masking():
    assert secrets.masked("a token=abcdef0123456789abcdef0123456789 b") == "a [SECRET] b"
    assert not secrets.confirmed_spans("A" * 200) and not secrets.confirmed_spans("f" * 200)


def test_secret_redaction_keeps_rows(odd):
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert secrets.MASK in out.where("doc_id = 12").first().text
    assert out.where("doc_id = 1").first().text == odd.where("doc_id = 1").first().text


def test_rules_base_counts(docs, odd, none):
    df = both(docs, odd)
    got = perplexity.rules(df).collect()
    assert counted((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == counted((i, brute.base_counts(t)) for i, t in rows(df))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert perplexity.rules(none).count() == 0


def test_rules_equal_plain_models(spark, docs, odd, monkeypatch):
    """Verdicts and perplexities of all rows, by plain counts, plain Kneser-Ney and plain quartiles."""
    import math

    monkeypatch.setattr(perplexity, "FLUSH_WORDS", 5_000)
    for df in (both(docs, odd), docs.where("lang = 'de'"), odd):
        held = df.select("doc_id", "lang", "text").collect()
        given = [(r.lang, r.text) for r in held]
        verdict, (words, letters) = brute.verdicts(given, perplexity._CLASS, perplexity.WORD_BYTES, perplexity.LANG_SHARE, perplexity.BELOW, perplexity.ABOVE, perplexity.SLACK)
        near = lambda x: None if x is None else round(x, 7)
        log = lambda x: None if x is None else round(math.log(x), 7)
        expected = counted((r.doc_id, (v, near(a), near(b))) for r, v, a, b in zip(held, verdict, words, letters, strict=True))
        got = perplexity.rules(df).collect()
        assert counted((r.doc_id, (r.verdict, log(r.perplexity), log(r.letter_perplexity))) for r in got) == expected
        assert all(r.kept == (r.verdict == "kept") and r.base_failed == (r.verdict == "base") for r in got)


def test_rules_common_words_of_many_languages(spark):
    """More common words over all languages than a token's bits hold: each language numbers its own."""
    import math
    import random

    rng, given = random.Random(5), []
    for k in range(16):
        own = [f"{rng.choice('bdfgklmnprstvz')}{rng.choice('aeiou')}{n}" for n in range(190)]
        for _ in range(3):
            rng.shuffle(own)
            given.append((f"l{k}", " ".join(rng.choices(own, k=80) + own)))
    assert len({(lang, w) for lang, t in given for w in t.split()}) > 1 << perplexity.TOKEN_BITS
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], "doc_id long, lang string, text string")
    verdict, (words, _) = brute.verdicts(given, perplexity._CLASS, perplexity.WORD_BYTES, perplexity.LANG_SHARE, perplexity.BELOW, perplexity.ABOVE, perplexity.SLACK)
    got = {r.doc_id: r for r in perplexity.rules(df).collect()}
    assert [got[k].verdict for k in range(len(given))] == verdict
    assert np.allclose([math.log(got[k].perplexity) for k in range(len(given))], words)


def test_rules_bands(spark, docs, labels):
    """Planted noise is too high, planted patterns too low (words of one shape too), labelled good texts stay."""
    import random

    rng, rows = random.Random(3), []
    for k in range(2):
        rows.append((10**6 + k, " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(6)) for _ in range(300))))
        rows.append((2 * 10**6 + k, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(300))))
        words = ["".join(rng.choice("aeionrst") for _ in range(5)) for _ in range(200)]
        rows.append((3 * 10**6 + k, " | ".join(words)))
        rows.append((4 * 10**6 + k, " ".join(w + " =" for w in words)))
    df = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang"))
    got = {r.doc_id: r for r in perplexity.rules(df).collect()}
    for i, _ in rows:
        assert not got[i].kept and not got[i].base_failed
        assert got[i].verdict == ("high" if i < 2 * 10**6 else "low"), i
    good = [r.doc_id for r in labels.where("quality = 1").collect() if not got[r.doc_id].base_failed]
    bad = [r.doc_id for r in labels.where("quality = 0").collect() if not got[r.doc_id].base_failed]
    assert sum(got[i].kept for i in good) >= 0.98 * len(good)
    assert sum(not got[i].kept for i in bad) >= 0.8 * len(bad)


def test_kneser_ney_equals_a_plain_one():
    rng = np.random.default_rng(1)
    for bits in (6, perplexity.TOKEN_BITS):
        gram = np.unique(rng.integers(1, 20, (3000, 3)), axis=0)
        n = np.minimum(rng.geometric(0.4, len(gram)), 9)
        key = gram[:, 0] << 2 * bits | gram[:, 1] << bits | gram[:, 2]
        model = perplexity.Model(key, n, bits, 30)
        plain = brute.kneser_ney({tuple(g): int(c) for g, c in zip(gram.tolist(), n, strict=True)}, 30)
        asked = rng.integers(1, 25, (500, 3))
        got = model.log_probability(np.zeros(500, np.uint64), (asked[:, 0] << 2 * bits | asked[:, 1] << bits | asked[:, 2]).astype(np.uint64))
        assert np.allclose(np.exp(got), [plain(tuple(g)) for g in asked.tolist()])


def test_quality_scores(docs, labels, odd, none):
    got = quality.score(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (quality.crc_fold(r.doc_id) == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.8 * len(held)
    assert quality.score(odd, labels).count() == odd.count()
    assert quality.score(none, labels).count() == 0
    assert {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_never_sees_the_held_out_fold(docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: {r.doc_id: r.score for r in quality.score(docs, x).collect()}
    a, b = scores(labels), scores(turned)
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_quality_equals_a_plain_fit(docs, labels):
    """Standardised statistics, the Fourier map, ridge weights and isotonic rates, by plain loops and one solve."""
    import math

    stats = {r.doc_id: np.array(r.x) for r in quality.with_statistics(docs).collect()}
    rows_in = [(r.doc_id, float(r.quality)) for r in labels.collect() if quality.crc_fold(r.doc_id) != 1 and r.doc_id in stats]
    x = np.array([stats[i] for i, _ in rows_in])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(size=(x.shape[1], quality.FEATURES)) / math.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * math.pi, quality.FEATURES)

    def mapped(v):
        z = np.clip((v - mean) / scale, -quality.CLIP, quality.CLIP)
        return np.array([math.sqrt(2 / quality.FEATURES) * math.cos(float(z @ w[:, k]) + b[k]) for k in range(quality.FEATURES)] + [1.0])

    first = [(mapped(stats[i]), y) for i, y in rows_in if quality.crc_fold(i) == 0]
    z, y = np.array([v for v, _ in first]), np.array([y for _, y in first])
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(quality.FEATURES + 1) / quality.FEATURES, z.T @ y)
    bins = {}
    for i, good in rows_in:
        if quality.crc_fold(i) == 2:
            s = float(mapped(stats[i]) @ weights)
            bins.setdefault(min(max(math.floor((s + 0.5) / 2 * quality.BINS), 0), quality.BINS - 1), []).append((s, good))
    pools = [[sum(s for s, _ in v), sum(g for _, g in v), len(v)] for _, v in sorted(bins.items())]
    while any(p[1] * q[2] >= q[1] * p[2] for p, q in zip(pools, pools[1:], strict=False)):
        k = next(k for k in range(len(pools) - 1) if pools[k][1] * pools[k + 1][2] >= pools[k + 1][1] * pools[k][2])
        pools[k : k + 2] = [[p + q for p, q in zip(pools[k], pools[k + 1], strict=True)]]
    at, rate = [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    for i, v in stats.items():
        assert abs(got[i] - np.interp(float(mapped(v) @ weights), at, rate)) < 1e-5, i


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, len(quality.NAMES)))
    z = quality.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(2) / x.shape[1]
    assert np.abs(z @ z.T - np.exp(-gap / 2)).mean() < 0.08
