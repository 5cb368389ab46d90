"""Operator 8: token ids in binary shards, with a minimal perfect hash index for access by document key.

The format, in one folder:
  shard-NNNNNN.ids   raw little-endian ids, of 2 bytes where the vocabulary allows, else 4; documents in ascending doc_id
                     order, shard after shard, each with its end id; nothing else
  index-NNNNNN.npz   a minimal perfect hash over the keys whose hash falls in this bucket, and of each slot the
                     fingerprint, shard, offset (in ids) and length
  meta.json          id width, buckets, and of each shard the ids of all shards before it

A key is a doc_id and a copy number: rows that repeat a doc_id are kept, and numbered from 0 in the order of their texts.
A null doc_id is a key as any other and comes first. Null and empty texts have the end id alone. Extra columns are left out.
Files appear under their name only when whole, and a task that runs twice writes the same bytes, so lost executors do no harm.
"""

from __future__ import annotations

import functools
import io
import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mph
from .common import documents, materialize, mix, partitions, scratch
from .tokens import Encoder, slices, trim

#: Keys of one index file: what one task holds when it builds or reads it.
BUCKET_KEYS = 200_000
ROWS = "doc_id long, copy int, shard int, at long, n_tokens long"


def _write(uri: str, data: bytes) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def _read(uri: str) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


@functools.lru_cache(1)
def _encoder(tokenizer: str, spaced: bool) -> Encoder:
    return Encoder(tokenizer, spaced)


def keys(doc_id: pa.Array, copy: pa.Array) -> np.ndarray:
    """64-bit keys: a mixing of doc_id, copy number and whether doc_id is null. Keys that collide stop the build."""
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    null = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix(mix(ids) + np.uint64(0x9E3779B97F4A7C15) * (copy.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(2) + null))


def write(docs: DataFrame, folder: str, tokenizer: str, spaced: bool, end_id: int, width: int) -> DataFrame:
    """Writes the shards and returns ROWS: of each document its shard, and there the offset of its first id and their number."""

    def shard(batches):
        trim()
        # ids go to the file as they come: a task holds one run of rows
        number, at, copy, last, f, encoder = TaskContext.get().partitionId(), 0, 0, (), None, _encoder(tokenizer, spaced)
        store, path = fs.FileSystem.from_uri(f"{folder}/shard-{number:06d}.ids")
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            for rows in slices(batch, "text"):
                f = f or store.open_output_stream(part)
                ids, ends = encoder.batch(rows.column("text"))
                n = np.diff(ends) + 1
                out = np.insert(ids, ends[1:], end_id).astype(f"<u{width}")
                f.write(out.tobytes())
                copies = []
                for x in rows.column("doc_id").to_pylist():
                    copy = copy + 1 if last == (x,) else 0
                    last = (x,)
                    copies.append(copy)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch({"doc_id": rows.column("doc_id").cast(pa.int64()), "copy": pa.array(copies, pa.int32()), "shard": pa.array(np.full(len(n), number, np.int32)), "at": pa.array(starts), "n_tokens": pa.array(n.astype(np.int64))})
        if f:
            f.close()
            store.move(part, path)

    n = partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(shard, ROWS), "token-rows")


def write_index(rows: DataFrame, folder: str, width: int) -> dict:
    """Builds the index files, a bucket of keys to a task, and meta.json, which is returned. Of the driver: a row for each shard."""
    sizes = {r["shard"]: (r["n"], r["docs"]) for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    buckets = max(1, -(-sum(d for _, d in sizes.values()) // BUCKET_KEYS))
    before, bases = 0, {}
    for k in sorted(sizes):
        bases[str(k)] = before
        before += sizes[k][0]

    def build(key, table):
        table = table.combine_chunks()
        k = keys(table["doc_id"].combine_chunks(), table["copy"].combine_chunks())
        if len(np.unique(k)) < len(k):
            raise ValueError("two document keys have one hash")
        index = mph.build(k)
        to = np.argsort(mph.slots(index, k))
        out = io.BytesIO()
        np.savez(out, fingerprints=mph.fingerprint(k)[to], **{c: table[c].to_numpy()[to] for c in ("shard", "at", "n_tokens")}, **index)
        number = key[0].as_py()
        _write(f"{folder}/index-{number:06d}.npz", out.getvalue())
        return pa.table({"bucket": pa.array([number], pa.int32()), "docs": pa.array([len(k)], pa.int64())})

    built = with_bucket(rows, buckets).groupBy("bucket").applyInArrow(build, "bucket int, docs long").agg(F.sum("docs")).collect()[0][0]
    meta = {"width": width, "buckets": buckets, "documents": built or 0, "ids": before, "before": bases}
    _write(f"{folder}/meta.json", json.dumps(meta).encode())
    return meta


def with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int"))


def find(wanted: DataFrame, folder: str) -> DataFrame:
    """Looks keys (doc_id, copy) up in the index: ROWS of those found. A key that was never added has no row, but for a fingerprint's chance of 2^-32."""
    meta = json.loads(_read(f"{folder}/meta.json"))

    def look(key, table):
        table = table.combine_chunks()
        k = keys(table["doc_id"].combine_chunks(), table["copy"].combine_chunks())
        index = np.load(io.BytesIO(_read(f"{folder}/index-{key[0].as_py():06d}.npz")))
        index = {name: index[name] for name in index.files}
        slot = mph.slots(index, k)
        there = (slot >= 0) & (index["fingerprints"][np.maximum(slot, 0)] == mph.fingerprint(k)) if len(index["fingerprints"]) else np.zeros(len(k), bool)
        found = table.filter(pa.array(there)).select(["doc_id", "copy"])
        for c in ("shard", "at", "n_tokens"):
            found = found.append_column(c, pa.array(index[c][slot[there]]))
        return found.cast(pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64())]))

    return with_bucket(wanted, meta["buckets"]).groupBy("bucket").applyInArrow(look, ROWS)


def read(found: DataFrame, folder: str) -> DataFrame:
    """Reads the ids of rows that find() returned: doc_id, copy, start, n_tokens, ids (little-endian uint32), shard by shard in order."""
    meta = json.loads(_read(f"{folder}/meta.json"))

    def load(batches):
        now, f = None, None
        for batch in batches:
            out = []
            for shard, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "n_tokens")), strict=True):
                if shard != now:
                    store, path = fs.FileSystem.from_uri(f"{folder}/shard-{shard:06d}.ids")
                    now, f = shard, store.open_input_file(path)
                raw = f.read_at(n * meta["width"], at * meta["width"])
                out.append((meta["before"][str(shard)] + at, np.frombuffer(raw, f"<u{meta['width']}").astype("<u4").tobytes()))
                if len(out) == 500:
                    yield piece(batch, out)
                    batch, out = batch.slice(500), []
            if out:
                yield piece(batch, out)

    def piece(batch, out):
        b = batch.slice(0, len(out))
        return pa.record_batch({"doc_id": b.column("doc_id"), "copy": b.column("copy"), "start": pa.array([x for x, _ in out], pa.int64()), "n_tokens": b.column("n_tokens"), "ids": pa.array([x for _, x in out], pa.binary())})

    ordered = found.repartition(partitions(found.sparkSession), "shard", F.expr("at div 1000000")).sortWithinPartitions("shard", "at")
    return ordered.mapInArrow(load, "doc_id long, copy int, start long, n_tokens long, ids binary")


def numbered(docs: DataFrame) -> DataFrame:
    """The keys of docs: doc_id and copy number."""
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = documents(spark, sf_dir), scratch(spark, "token-files")
    _store, path = fs.FileSystem.from_uri(folder)
    _store.create_dir(path)
    rows = write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1, width=2)
    write_index(rows, folder, width=2)
    ids = read(find(numbered(docs), folder), folder)
    # Spark's crc32 is that of zlib, over the bytes of uint32 ids
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


