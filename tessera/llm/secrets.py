"""Secret scans with structural confirmation.

Three plain formats (assignments, access keys, hex runs) are found by pattern. Then the candidates
that could hold a key are decoded and must prove their structure before they are reported:
- base64 or hex runs whose bytes are a DER private key: one SEQUENCE of exactly their length, with nested
  lengths that close everywhere, and the parts of a private key (a version and its integers, a version and
  an octet string, an algorithm and an octet string). Public keys and certificates are no secrets;
- private key encodings of length-prefixed strings: the framed form with its cipher, key count, public and
  private parts, or a key type followed by more fields than its public half has;
- armoured private keys, whose body must decode to one of these;
- signed tokens: three base64url parts, the first of which is a JSON object with an "alg" that signs.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough

_B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")  # either alphabet; then each on its own
_PARTS = (re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}"))
_HEXES = re.compile(r"[0-9A-Fa-f]{40,}")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----")
# Key types with the fields of their public halves (the type is one), the frame's name, and
# the object identifiers of encryption by passphrase.
_KEY_TYPES = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-": 3}
_OPENSSH = b"openssh-key-v1\x00"
_ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "armour", "der", "sshkey", "signed")
BASE = KINDS[:3]


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER item at `at`, if its length is well formed and within end."""
    if at + 2 > end:
        return None
    size, at2 = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at2 + n > end or not data[at2]:
            return None
        size = int.from_bytes(data[at2 : at2 + n], "big")
        at2 += n
        if size < 0x80:
            return None
    return (data[at], at2, at2 + size) if at2 + size <= end else None


def _items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER items that fill data[at:end]; None if they do not."""
    out = []
    while at < end:
        item = _der_item(data, at, end)
        if not item:
            return None
        out.append(item)
        at = item[2]
    return out


def _closes(data: bytes, items: list[tuple[int, int, int]]) -> bool:
    """Whether the lengths close in all constructed items, at any depth."""
    open_ = [x for x in items if x[0] & 0x20]  # a stack, not recursion
    while open_:
        _, at, end = open_.pop()
        inner = _items(data, at, end)
        if inner is None:
            return False
        open_ += [x for x in inner if x[0] & 0x20]
    return True


def _algorithm(data: bytes, item: tuple[int, int, int]) -> bytes | None:
    """The object identifier that a SEQUENCE begins with."""
    first = _der_item(data, item[1], item[2]) if item[0] == 0x30 else None
    return data[first[1] : first[2]] if first and first[0] == 0x06 else None


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE of exactly this length, all lengths closing, of the shape of a private key."""
    top = _der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data) or len(data) < 24:
        return False
    items = _items(data, top[1], top[2])
    if not items or not _closes(data, items):
        return False
    tags = [x[0] for x in items]
    if len(items) == 2 and tags[1] == 0x04:  # encrypted: how, and the bytes
        return (_algorithm(data, items[0]) or b"").startswith(_ENCRYPTED)
    version = data[items[0][1]] if tags[0] == 0x02 and items[0][2] - items[0][1] == 1 else 9
    if version > 1 or len(items) < 3 and tags[1:] != [0x04]:
        return False
    if all(t == 0x02 for t in tags[:6]) and len(items) >= 6:  # its integers: six, or nine and perhaps further primes
        return (len(items) == 6 and version == 0) or (len(items) >= 9 and tags[:9] == [0x02] * 9 and tags[9:] in ([], [0x30]))
    optional = {0xA0, 0xA1, 0x81}
    if tags[1] == 0x04:  # a number, its curve and point
        return version == 1 and items[1][2] - items[1][1] >= 16 and set(tags[2:]) <= optional
    return tags[2] == 0x04 and set(tags[3:]) <= optional and _algorithm(data, items[1]) is not None


def _strings(data: bytes, at: int = 0) -> list[bytes] | None:
    """The length-prefixed strings that fill data from `at`; None if they do not."""
    out = []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _public_fields(name: bytes) -> int | None:
    return next((n for k, n in _KEY_TYPES.items() if name.startswith(k)), None)


def is_ssh_key(data: bytes) -> bool:
    """A framed private key, or a key type with more fields than its public half has."""
    if data.startswith(_OPENSSH):
        at, head = len(_OPENSSH), []
        for _ in range(3):  # cipher, key derivation and its options
            n = int.from_bytes(data[at : at + 4], "big")
            head.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        keys = int.from_bytes(data[at : at + 4], "big")
        rest = _strings(data, at + 4) if at + 4 < len(data) else None
        if not rest or not head[0] or not head[0].isascii() or len(rest) != keys + 1 or not keys:
            return False
        return all((_strings(x) or [b""])[0] and _public_fields((_strings(x) or [b""])[0]) is not None for x in rest[:-1]) and len(rest[-1]) >= 8
    parts = _strings(data)
    if not parts:
        return False
    public = _public_fields(parts[0])
    return public is not None and len(parts) > public + (parts[0].startswith(b"ssh-rsa") and 2)


def from_base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(s: str) -> bool:
    parts = s.split(".")
    head = from_base64(parts[0])
    if not head or len(parts) != 3 or not parts[2] or from_base64(parts[1]) is None:
        return False
    try:
        found = json.loads(head)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str) and found["alg"].lower() not in ("", "none")


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if data[0] == 0x30 and is_der_key(data) else "sshkey" if is_ssh_key(data) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """The decoded and structurally confirmed spans."""
    out = []
    for m in _ARMOUR.finditer(text) if "-----BEGIN " in text else ():
        stop = f"-----END {m[1]}PRIVATE KEY-----"
        if (end := text.find(stop, m.end())) >= 0:
            body = "".join(x for x in text[m.end() : end].splitlines() if ":" not in x)
            if _key_kind(from_base64("".join(body.split()))):
                out.append((m.start(), end + len(stop), "armour"))
    for m in _TOKEN.finditer(text) if "eyJ" in text else ():
        if is_signed_token(m[0]):
            out.append((m.start(), m.end(), "signed"))
    for m in _B64.finditer(text):
        if kind := _key_kind(from_base64(m[0])):
            out.append((m.start(), m.end(), kind))
            continue
        for part in _PARTS:
            for x in part.finditer(text, m.start(), m.end()):
                if x.span() != m.span() and (kind := _key_kind(from_base64(x[0]))):
                    out.append((*x.span(), kind))
    for m in _HEXES.finditer(text):
        for skip in range(1 + len(m[0]) % 2):  # a run of odd length may begin with another digit
            if kind := _key_kind(bytes.fromhex(m[0][skip : skip + len(m[0]) // 2 * 2])):
                out.append((m.start(), m.end(), kind))
                break
    return out


_ORDER = {k: i for i, k in enumerate(KINDS)}


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind."""
    return sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans.

    Spans are kind:start:end in code points. A null text counts as empty: no spans, the hash of
    nothing. Whole texts at any length, one block in memory; no shuffle. Null doc_ids and repeated
    rows come out as they came; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [spans_of(t or "") for t in part.column(1).to_pylist()]
                counts = [[sum(s[2] == k for s in f) for f in found] for k in BASE]
                base = [[s for s in f if s[2] in BASE] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([len(f) - len(b) for f, b in zip(found, base, strict=True)], pa.int64()),
                        pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]),
                        pa.array([_joined(f) for f in found]),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"
    )


MASK = "[SECRET]"


def masked(text: str) -> str:
    """The text with every secret span, overlapping ones as one, replaced by MASK."""
    out, at = [], 0
    for a, b, _ in spans_of(text):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with the secrets in its texts masked and n_chars, where there is one, counted anew for changed rows.

    All rows and columns stay; a null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at).to_pylist()
                new = [t if t is None else masked(t) for t in texts]
                cols = part.columns
                cols[at] = pa.array(new, part.schema.field(at).type)
                if (c := part.schema.get_field_index(n_chars)) >= 0:
                    cols[c] = pa.array([old if a is b or a == b else len(b) for old, a, b in zip(part.column(c).to_pylist(), texts, new, strict=True)], part.schema.field(c).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
