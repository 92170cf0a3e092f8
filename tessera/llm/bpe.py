"""BPE encoding and decoding by prefix-sharing trie traversal.

A word's encoding is fixed by its last token and the encoding of what stands before it: a token
sequence is a BPE encoding exactly if each two neighbours stay apart when joined and encoded alone.
So for each prefix one state is enough, the last token of its encoding. The distinct words of a
block are taken in sorted order, which walks their trie depth first: the states of the prefix that a
word shares with the one before it are kept, and only the nodes below are computed. The tokens that
end at a node are those of the longest token head that ends there (an automaton of token heads, made as
the words need it).

Results equal those of the tokenizers library for a vocabulary file with BPE merges, word-end
suffix, byte-level alphabet, NFC and lower-case normalising.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_util import release

#: Words and pairs of tokens held by a task between blocks; beyond that it starts anew, and of the words keeps
#: those held so far beside the new ones until these are as many.
CACHE_WORDS, CACHE_PAIRS = 150_000, 500_000
#: Characters of text that are split into words at a time.
PIECE_CHARS = 1 << 20

# Fixed values of the tokenizer format: white space, and the word pattern with it written out.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
_RUN = regex.compile(rf"[^{_WS}]+")
_CONTROLS = "\x1c\x1d\x1e\x1f"
_END = "</w>"
_NEVER = (1 << 60, 0)


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """Encodes and decodes with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or spec.get("decoder"):
            raise ValueError(f"{path}: not a BPE vocabulary with word ends and no decoder")
        alphabet = _byte_alphabet()
        self.token = [""] * (1 + max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]))
        self.mid: dict[bytes, int] = {}
        self.end: dict[bytes, int] = {}
        for s, i in model["vocab"].items():
            self.token[i] = s
            body, into = (s[: -len(_END)], self.end) if s.endswith(_END) and s != _END else (s, self.mid)
            into[bytes(alphabet[c] for c in body)] = i
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.special.items():
            self.token[i] = s
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        # symbols of each token, and rank and product of each merge
        self.size = [0] * len(self.token)
        self.base: list[tuple[int, ...]] = [()] * len(self.token)
        for kind, last in ((self.mid, self.mid), (self.end, self.end)):
            for b, i in kind.items():
                self.size[i] = len(b)
                self.base[i] = (*(self.mid[b[k : k + 1]] for k in range(len(b) - 1)), last[b[-1:]])
        vocab = model["vocab"]
        self.merge = {}
        for rank, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.merge.setdefault((vocab[x], vocab[y]), (rank, vocab[x + y]))
        self.made = {t: (rank, x, y) for (x, y), (rank, t) in self.merge.items()}
        if len(self.made) < len(self.merge) or any(self.made.get(p, (-1,))[0] >= r for r, x, y in self.made.values() for p in (x, y)):
            raise ValueError(f"{path}: a token is made by two merges, or before its parts")
        self.spines: tuple[dict, dict] = ({}, {})
        self.apart: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        # nodes of the automaton: the head of a token each, the steps by a byte, and the tokens that end it, longest first
        self.heads = {b[:k] for kind in (self.mid, self.end) for b in kind for k in range(len(b) + 1)}
        self.node = {b"": 0}
        self.head = [b""]
        self.step: dict[int, int] = {}
        self.mids: list[list[tuple[int, int]]] = [[]]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.known: tuple[dict, dict] = ({}, {})  # ids of words: of now, and of before
        self.held: tuple[dict, dict] = ({}, {})  # ids of runs between white space, as well

    def _merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Merge after merge, lowest rank and then leftmost first: for the symbols of one token only."""
        out = list(symbols)
        while len(out) > 1:
            (rank, made), k = min((self.merge.get(p, _NEVER), k) for k, p in enumerate(zip(out, out[1:], strict=False)))
            if rank == _NEVER[0]:
                break
            out[k : k + 2] = [made]
        return out

    def _stands(self, before: int, t: int) -> bool:
        """Whether t can follow `before` (-1: stand first) in an encoding."""
        key = before << 32 | t
        ok = self.apart.get(key)
        if ok is None:
            ok = self.alone.get(t)
            if ok is None:
                ok = self.alone[t] = self._merged(self.base[t]) == [t]
            if len(self.apart) > CACHE_PAIRS:
                self.apart.clear()
            ok = self.apart[key] = ok and (before < 0 or not self._join(before, t))
        return ok

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token while it is built, each with the rank of the merge that ends it."""
        held = self.spines[side].get(t)
        if held is None:
            out, until = [], 1 << 60
            while True:
                out.append((t, until))
                if t not in self.made:
                    break
                until, *ends = self.made[t]
                t = ends[side]
            held = self.spines[side][out[0][0]] = out[::-1]
        return held

    def _join(self, x: int, y: int) -> bool:
        """Whether a merge joins two neighbouring tokens' edges before both are built.

        A merge ranks above those that made its parts, so ranks are times. At equal rank the left one goes first.
        """
        xs, ys = self._spine(x, 1), self._spine(y, 0)
        i = j = 0
        while True:
            (p, gone_p), (q, gone_q) = xs[i], ys[j]
            rank = self.merge.get((p, q), _NEVER)[0]
            if rank < gone_p and rank <= gone_q and rank != _NEVER[0]:
                return True
            if i + 1 == len(xs) and j + 1 == len(ys):
                return False
            if gone_p <= gone_q:
                i += 1
            else:
                j += 1

    def _go(self, at: int, byte: int) -> int:
        """The node of the longest token head that ends with this byte behind the node's head."""
        head = self.head[at] + bytes([byte])
        while head not in self.heads:
            head = head[1:]
        to = self.node.get(head)
        if to is None:
            to = self.node[head] = len(self.head)
            self.head.append(head)
            for kind, into in ((self.mid, self.mids), (self.end, self.ends)):
                into.append([(kind[head[k:]], len(head) - k) for k in range(len(head)) if head[k:] in kind])
        self.step[at << 8 | byte] = to
        return to

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodings of the words, by a depth-first walk of their trie."""
        out = {}
        # of each prefix: the last token and the node
        state, nodes, done, before = [-1], [0], 0, b""
        step, apart, size, pack = self.step.get, self.apart.get, self.size, struct.pack
        for text in sorted(words):
            word = text.encode()
            last = len(word) - 1
            most, common = min(done, last), 0
            while common < most and word[common] == before[common]:
                common += 1
            del state[common + 1 :], nodes[common + 1 :]
            at = nodes[common]
            for i in range(common, last + 1):
                to = step(at << 8 | word[i])
                at = self._go(at, word[i]) if to is None else to
                for t, n in self.mids[at] if i < last else self.ends[at]:
                    ok = apart(state[i + 1 - n] << 32 | t)
                    if ok or ok is None and self._stands(state[i + 1 - n], t):
                        break
                else:
                    raise ValueError(f"no encoding for {word[: i + 1]!r}")
                state.append(t)
                nodes.append(at)
            done, before = last, word
            ids, j = [t], last + 1 - size[t]
            while j:
                t = state[j]
                ids.append(t)
                j -= size[t]
            out[text] = pack(f"<{len(ids)}I", *ids[::-1])
        return out

    def words(self, run: str) -> list[str]:
        """The words of a run of text without white space (or of any text without special tokens)."""
        if not run.isascii():
            run = unicodedata.normalize("NFC", run).replace("Σ", "σ")  # no final form of sigma
        return _WORD.findall(run.lower())

    def runs(self, text: str) -> list[str]:
        """The runs between white space, with special tokens on their own. No word crosses white space."""
        if "<|" in text and self.split:
            out, at = [], 0
            for m in self.split.finditer(text):
                out += [*self._plain_runs(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self._plain_runs(text[at:])
        return self._plain_runs(text)

    @staticmethod
    def _plain_runs(text: str) -> list[str]:
        # str.split also cuts at four control characters that are no white space here
        return _RUN.findall(text) if any(c in text for c in _CONTROLS) else text.split()

    @staticmethod
    def _room(held: tuple[dict, dict], asked: set[str]) -> tuple[tuple[dict, dict], set[str]]:
        """What is held, with those of the asked that it has in the first part, and the asked that it has not."""
        now, old = held
        new = asked.difference(now)
        if len(now) + len(new) > CACHE_WORDS:
            now, old, new = {}, now, asked
        found = [x for x in new if x in old]
        now.update(zip(found, map(old.__getitem__, found), strict=True))
        return (now, old), new.difference(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.runs(t) for t in texts]
        self.held, new = self._room(self.held, set().union(*cut))
        # runs of ASCII letters, those with one mark or digit behind, special tokens, and all others
        one, two, special, more = {}, {}, [], {}
        for r in new:
            if r in self.special:
                special.append(r)
            elif r.isascii() and r.isalpha():
                one[r] = r.lower()
            elif r.isascii() and r[:-1].isalpha():
                two[r] = r[:-1].lower()
            else:
                more[r] = self.words(r)
        asked = {*one.values(), *two.values(), *(r[-1] for r in two)}.union(*more.values())
        self.known, fresh = self._room(self.known, asked)
        known, held = self.known[0], self.held[0]
        known.update(self.learn(fresh))
        for r, w in one.items():
            held[r] = known[w]
        for r, w in two.items():
            held[r] = known[w] + known[r[-1]]
        for r, ws in more.items():
            held[r] = b"".join(map(known.__getitem__, ws))
        for r in special:
            held[r] = self.special[r].to_bytes(4, "little")
        return [b"".join(map(held.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between each two, as the library does without a decoder."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One tokenizer for each path, until the task ends."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _grouped(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_decode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; on wish the ids and the decoded text.

    Whole texts; a null text counts as empty (no tokens, hashes of nothing). Repeated rows and null
    doc_ids come out as they came. Extra columns are ignored. No shuffle; memory is bounded by
    twice CACHE_WORDS, a block of PIECE_CHARS and the longest text.
    """
    extra = [("ids", "array<int>")] * with_ids + [("decoded", "string")] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        for batch in batches:
            col = batch.column(1)
            for start in range(0, batch.num_rows, 256):
                texts = [t or "" for t in col.slice(start, 256).to_pylist()]
                for lo, hi in _grouped(texts, PIECE_CHARS):
                    ids = own.encode(texts[lo:hi])
                    out = [batch.column(0).slice(start + lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids])]
                    decoded = []
                    shas = []
                    for x in ids:
                        s = own.decode(x)
                        shas.append(hashlib.sha256(s.encode()).hexdigest())
                        if with_text:
                            decoded.append(s)
                    out.append(pa.array(shas))
                    if with_ids:
                        out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    if with_text:
                        out.append(pa.array(decoded))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(n for n, _ in extra)])
        del own
        _LOADED.clear()
        release()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {n} {t}" for n, t in extra)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
