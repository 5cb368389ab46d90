"""Operator 6: packing along a space-filling curve.

Each text is a hashed vector: square roots of the counts of its byte trigrams in 256 buckets, of length one. A fixed random
projection to four dimensions and a squashing give coordinates of 8 bits, and their place on the Hilbert curve the key.
Documents are dealt out by key, and where keys are equal by a hash of doc_id and text, into ranges of about as many bytes (as
many as there are shuffle partitions, more if one would hold over RANGE_BYTES), and sorted there. The ranges come from a sample
by that hash, some tens of documents a range; only where tasks part hangs on it. Neighbours on the curve follow one another, and the stream of
their ids is cut every LENGTH ids. What is left at the end of a range is cut into powers of two, so nothing is padded at all.

A document's ids are those of the tokenizer and the end id. Null and empty texts have the end id alone. Null doc_ids and rows
that repeat are packed as any other; extra columns are left out.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANGE_BYTES, documents, partitions, ranges
from .tokens import Encoder, slices, trim

LENGTH, DIMENSIONS, BITS = 2048, 4, 8
_PROJECTION = np.random.default_rng(20).standard_normal((256, DIMENSIONS))
_PROJECTION -= _PROJECTION.mean(0)  # square-rooted counts share a direction, which would put all texts in one corner
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vector(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16)
    if len(raw) < 3:
        return np.zeros(256)
    grams = raw[:-2] * np.uint16(40503) + raw[1:-1] * np.uint16(30011) + raw[2:] * np.uint16(13907)
    v = np.sqrt(np.bincount(grams >> np.uint16(8), minlength=256))
    return v / np.sqrt(v @ v)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points of unsigned integers, a row each (Skilling, 2004)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] = np.where(on, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def keys(texts: list[str | None]) -> np.ndarray:
    v = np.array([vector(t) for t in texts]).reshape(-1, 256)
    at = 1 / (1 + np.exp(-6 * (v @ _PROJECTION)))
    return hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, dealt out and sorted along the curve."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    doc_id = F.col("doc_id").cast("long")
    hashed = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(doc_id, "text").alias("b"))
    count, total = hashed.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(partitions(docs.sparkSession), -(-total // RANGE_BYTES))

    def weighed(batches):
        for b in batches:
            texts = b.column("text")
            bytes_ = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch({"a": pa.array(keys(texts.to_pylist()), pa.int64()), "b": b.column("b"), "weight": pc.add(bytes_, 1)})

    some = hashed.where(F.pmod("b", F.lit(max(1, count // (64 * n)))) == 0)
    parts = ranges(some.mapInArrow(weighed, "a long, b long, weight long"), n)

    def deal(batches):
        for batch in batches:
            key = keys(batch.column("text").to_pylist())
            part = parts.of(key, batch.column("b").to_numpy()).astype(np.int32)
            yield pa.record_batch({"part": pa.array(part), "key": pa.array(key), "b": batch.column("b"), "doc_id": batch.column("doc_id"), "text": batch.column("text")})

    dealt = hashed.mapInArrow(deal, "part int, key long, b long, doc_id long, text string")
    return dealt.repartitionById(len(parts), "part").sortWithinPartitions("key", "b").select("doc_id", "text")


@functools.lru_cache(1)
def _encoder(tokenizer: str, spaced: bool) -> Encoder:
    return Encoder(tokenizer, spaced)


class Packer:
    """Cuts a stream of documents' ids into sequences; add() and end() give pieces whose sequence is done."""

    def __init__(self, first: int, length: int = LENGTH):
        self.sequence, self.length, self.open, self.filled = first, length, [], 0

    def add(self, doc_id, ids: np.ndarray):
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, self.length - self.filled)
            self.open.append((doc_id, start, ids[start : start + n], len(ids)))
            start, self.filled = start + n, self.filled + n
            if self.filled == self.length:
                yield from self._emit(self.open)
                self.open, self.filled = [], 0

    def _emit(self, pieces):
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, self.sequence, at, ids
            at += len(ids)
        self.sequence += 1

    def end(self):
        """What is left goes into sequences of falling powers of two."""
        pieces, left = self.open[::-1], self.filled
        while left:
            room, now = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, total = pieces.pop()
                n = min(room, len(ids))
                now.append((doc_id, start, ids[:n], total))
                if n < len(ids):
                    pieces.append((doc_id, start + n, ids[n:], total))
                room -= n
            yield from self._emit(now)
        self.open, self.filled = [], 0


def pack(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, with_ids: bool = False) -> DataFrame:
    """PIECES of all docs, and their ids (little-endian uint32) if asked for. Sequences of one range are numbered on from its number times 2^32."""

    def run(batches):
        trim()
        packer, encoder, out = Packer(TaskContext.get().partitionId() << 32), _encoder(tokenizer, spaced), []
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, ends = encoder.batch(rows.column("text"))
                ends = ends.tolist()
                for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    out += packer.add(doc_id, np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)))
                yield flush(out)
                out = []
        out += packer.end()
        yield flush(out)

    def flush(out):
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = {c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(names)}
        return pa.record_batch(columns | ({"ids": pa.array([o[7].astype("<u4").tobytes() for o in out], pa.binary())} if with_ids else {}))

    return ordered(docs).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=1)
