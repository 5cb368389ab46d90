r"""Operator 3: a homomorphic multiset hash of a text's paragraphs (its lines, parted by \n).

A paragraph hashes to a wide vector; a text's fingerprint is the sum of its paragraphs' vectors, so the order of paragraphs
does not matter, and a paragraph can be put in or taken out by one addition or subtraction. Two parts are summed modulo 2^64:
  DENSE lanes of BLAKE2b: equal multisets of paragraphs have equal sums, and others do not, but for chance
  LANES lanes in which each three-word shingle of the paragraph (all its words, if fewer) adds 1 or -1 to one lane: the cosine
  of two sums estimates how much the texts have in common, within about 1/sqrt(LANES)
Both stand in the fingerprint: DENSE as hex, then a dot, then LANES as zigzag varints in base 64. The likeness of two
fingerprints is that cosine, 0 where it is negative, 1 for equal ones.

A null text counts as empty: one empty paragraph. Rows of one doc_id follow one another by a hash of their text, null doc_ids
come first. In a table of one row the next document is the row itself. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANGE_BYTES, WordHash, documents, partitions, ranges, windows

DENSE, LANES = 16, 256
#: Comes before any doc_id: where there is none.
NOBODY = -(1 << 63)
_HASHES = WordHash(200_000, 3)


def _dense(paragraph: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(paragraph, person=p).digest() for p in (b"first", b"second")), "<u8")


def _lanes(paragraphs: list[bytes]) -> np.ndarray:
    words = [p.split() for p in paragraphs]
    h = _HASHES.array([w for p in words for w in p])
    of = np.repeat(np.arange(len(words)), [len(p) for p in words])
    grams = windows(h, 3)[of[2:] == of[:-2]] if len(h) > 2 else np.empty(0, np.uint64)
    short = [windows(_HASHES.array(p), len(p)) for p in words if 0 < len(p) < 3]
    grams = np.concatenate([grams, *short])
    sign = np.where(grams >> np.uint64(63) == 1, 1.0, -1.0)
    return np.bincount((grams & np.uint64(LANES - 1)).astype(np.int64), sign, LANES).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Signed integers as varints: seven bits a byte, the high bit set on all but the last."""
    z = (values << 1 ^ values >> 63).view(np.uint64)
    if not (z >> np.uint64(7)).any():
        return z.astype(np.uint8).tobytes()
    out = bytearray()
    for x in z.tolist():
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


def _unpacked(raw: bytes) -> np.ndarray:
    out, x, shift = [], 0, 0
    for c in raw:
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            out.append((x >> 1) ^ -(x & 1))
            x = shift = 0
    return np.array(out, np.int64)


class Fingerprint:
    """The sum over some paragraphs."""

    def __init__(self, dense: np.ndarray | None = None, lanes: np.ndarray | None = None):
        self.dense = np.zeros(DENSE, np.uint64) if dense is None else dense
        self.lanes = np.zeros(LANES, np.int64) if lanes is None else lanes

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        paragraphs = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
        dense = np.zeros(DENSE, np.uint64)
        for p in paragraphs:
            dense += _dense(p)
        return cls(dense, _lanes(paragraphs))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense + other.dense, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense - other.dense, self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.dense == other.dense).all())

    __hash__ = None

    def __str__(self) -> str:
        return self.dense.astype("<u8").tobytes().hex() + "." + base64.b64encode(_packed(self.lanes)).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        dense, lanes = text.split(".")
        return cls(np.frombuffer(bytes.fromhex(dense), "<u8").astype(np.uint64), _unpacked(base64.b64decode(lanes)))

    def likeness(self, other: Fingerprint) -> float:
        if self == other:
            return 1.0
        a, b = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        norm = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, a @ b / norm))) if norm else 0.0


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many, or all, of the following one's."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(doc_id, text: str, own: Fingerprint, following: str, other: Fingerprint) -> tuple:
    changed = edited(text, following)
    after = Fingerprint.of(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, str(own), str(after), own.likeness(after), own.likeness(other)


def compare(docs: DataFrame) -> DataFrame:
    """_COLUMNS of each document of docs and the one after it.

    One shuffle deals texts out by ranges of doc_id, parted so that they hold about as many bytes. Inside a range the next
    document is the next row. Each range starts with a known row, so that row alone is sent to the range before, too.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NOBODY)).alias("a"), F.xxhash64("text").alias("b"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    count, total, least = keyed.agg(F.count("*"), F.sum(size), F.min(F.struct("a", "b"))).first()
    if not count:
        return spark.createDataFrame([], _COLUMNS)
    n = max(partitions(spark), -(-total // RANGE_BYTES))
    some = keyed.where(F.pmod(F.xxhash64("a", "b"), F.lit(max(1, count // (64 * n)))) == 0)
    parts = ranges(some.select("a", "b", (size + 1).alias("weight")), n, tuple(least))
    starts = {x: i for i, x in enumerate(zip(parts.a.tolist(), parts.b.tolist(), strict=True))}

    def deal(batches):
        sent: dict = {}
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            part, ahead, rows = parts.of(a, b), np.zeros(len(a), bool), np.arange(len(a))
            more = []
            for i, x in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if x in starts:
                    text = batch.column("text")[i].as_py() or ""
                    if x not in sent or text < sent[x]:  # of rows with one key the first is enough
                        sent[x] = text
                        more.append(((starts[x] - 1) % len(parts), i))
            part = np.append(part, [m[0] for m in more]).astype(np.int32)
            ahead = np.append(ahead, [True] * len(more)).astype(bool)
            rows = np.append(rows, [m[1] for m in more]).astype(np.int64)
            yield pa.record_batch({"part": pa.array(part), "ahead": pa.array(ahead)} | {c: batch.column(c).take(pa.array(rows)) for c in ("doc_id", "a", "b", "text")})

    def run(batches):
        held, out = None, []
        for batch in batches:
            for ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("ahead", "doc_id", "text")), strict=True):
                text = text or ""
                own = Fingerprint.of(text) if held is not None or not ahead else None
                if held is not None:
                    out.append(_row(*held, text, own))
                held = None if ahead else (doc_id, text, own)
                if len(out) >= 500:
                    yield table(out)
                    out = []
        if out:
            yield table(out)

    def table(rows):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    dealt = keyed.mapInArrow(deal, "part int, ahead boolean, doc_id long, a long, b long, text string")
    ordered = dealt.repartitionById(len(parts), "part").sortWithinPartitions("ahead", "a", "b", "text")
    return ordered.select("ahead", "doc_id", "text").mapInArrow(run, _COLUMNS)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(documents(spark, sf_dir))
