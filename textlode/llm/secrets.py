r"""Operator 2: secrets in texts, by keywords first, anchored expressions at their places, then checksums inside the match.

One Aho-Corasick pass over the lower-cased bytes finds every keyword; an expression is tried only where one starts. Hex runs
have no keyword and are searched for directly. Base kinds follow their contract and need no checksum:
  assign  (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(VALUE), keyword in either case, VALUE of 6 or more
  access  AKIA[A-Z0-9]+ of 20 or more        hex  [0-9a-f]+ of 24 or more
The method's own kinds are kept only if what they embed is right:
  github, npm  prefix, 30 characters, then their CRC32 in six base-62 digits
  jwt          header and payload decode as JSON objects, the header has "alg"
  pem          the body decodes as one DER sequence whose length fits
  iban, card   after that word: remainder 97, Luhn
Matches are leftmost and do not overlap within a kind. Positions are code points, ends exclusive.
A null text counts as empty; rows that repeat stay; null doc_ids stay; extra columns are left out of the query and kept by redact().
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem", "iban", "card")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "jwt": ["eyj"],
    "pem": ["-----begin "],
    "iban": ["iban"],
    "card": ["card"],
}
_AT = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----\s{1,4}([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----"),
    "iban": re.compile(rb"(?i:iban)[:=\x20]{1,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])"),
    "card": re.compile(rb"(?i:card)(?:\x20(?i:number|no\.?))?[:=\x20]{1,4}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])"),
}
_HEX = re.compile(rb"[0-9a-f]{24,}")


@functools.lru_cache(1)
def _automaton():
    a = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _crc62(body: bytes) -> bytes:
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r : r + 1] + out
    return out


def _crc_ok(token: bytes) -> bool:
    body = token[token.index(b"_") + 1 :]
    return _crc62(body[:30]) == body[30:]


def _json_object(part: bytes) -> dict | None:
    try:
        x = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def _der_ok(body: bytes) -> bool:
    try:
        raw = base64.b64decode(b"".join(body.split()), validate=True)
    except binascii.Error:
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    k = raw[1] & 0x7F
    return 0 < k <= 4 and len(raw) == 2 + k + int.from_bytes(raw[2 : 2 + k], "big")


def _luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits if 48 <= c < 58]
    return sum(d[-1::-2]) % 10 == -sum((2 * x) // 10 + (2 * x) % 10 for x in d[-2::-2]) % 10


def _iban_ok(value: bytes) -> bool:
    v = value.replace(b" ", b"").decode()
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


_CHECK = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: _crc_ok(m[0]),
    "npm": lambda m: _crc_ok(m[0]),
    "jwt": lambda m: "alg" in (_json_object(m[1]) or ()) and _json_object(m[2]) is not None,
    "pem": lambda m: _der_ok(m[2]),
    "iban": lambda m: _iban_ok(m[1]),
    "card": lambda m: _luhn(m[1]),
}


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(raw.lower().decode("latin-1")):
        starts.setdefault(kind, []).append(end - n + 1)
    found = [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]
    for kind, at in starts.items():
        last = 0
        for i in sorted(set(at)):
            if i >= last and (m := _AT[kind].match(raw, i)):
                if _CHECK[kind](m):
                    found.append((kind, i, m.end()))
                elif kind not in BASE:
                    continue
                last = m.end()
    if not raw.isascii():
        at, points, chars, last = sorted({x for f in found for x in f[1:]}), {}, 0, 0
        for x in at:
            chars += len(raw[last:x].decode("utf-8", "surrogatepass"))
            points[x], last = chars, x
        found = [(k, points[a], points[b]) for k, a, b in found]
    return sorted(found, key=lambda f: (f[1], _ORDER[f[0]], f[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by <KIND> (spans that overlap by one mark, of the first), and n_chars, where there is one, anew. Null texts stay null."""

    def clean(text: str | None) -> str | None:
        if not text or not (spans := scan(text)):
            return text
        out, last = [], 0
        for kind, a, b in spans:
            if a >= last:
                out += [text[last:a], f"<{kind.upper()}>"]
            last = max(last, b)
        return "".join([*out, text[last:]])

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [scan(t) for t in b.column("text").to_pylist()]
            base = [[s for s in f if s[0] in BASE] for f in found]
            count = lambda kind: pa.array([sum(s[0] == kind for s in f) for f in base], pa.int64())
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n_assign": count("assign"),
                    "n_access": count("access"),
                    "n_hex": count("hex"),
                    "base_sha256": pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()),
                    "spans": pa.array([joined(f) for f in found], pa.string()),
                    "n_checked": pa.array([len(f) - len(g) for f, g in zip(found, base, strict=True)], pa.int64()),
                }
            )

    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")
