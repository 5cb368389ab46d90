r"""Operator 10: near duplicates by SimHash, found through deletion-variant signatures.

A text's ASCII letters are lower-cased and its words [^\x20\x09-\x0D]+ taken; its shingles are every three words in a row,
repeats included, joined by a space (all words, if there are fewer). A fingerprint bit is 1 if it is set in over half of the
shingles' XXH64 (seed 42). Fingerprints of at most two differing bits are linked, and links are followed to components.

Links are searched among distinct fingerprints only. Two halves of a fingerprint share at most two differing bits, so one half
differs in at most one: each half is indexed as it is, and once for each of its bits with that bit blanked (a one-wildcard
variant). Fingerprints that meet under a signature are compared in full. Where over GROUP meet under one, they are not
compared there but indexed again by variants of the half that is still free, and then of half of that; what meets at the third
level shares all but 11 bits, so there are at most 2^11 of them. Of a group, only a spanning forest of its links is kept.

A null text counts as empty: its fingerprint is zero. A component's number is its smallest doc_id; a null doc_id is never that,
unless all are null. Rows that repeat stay. Extra columns are left out of link() and kept by keep_one().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, heavy, join_skewed, materialize, mix
from .components import components

BITS, SHINGLE, GROUP, LEVELS = 2, 3, 256, 3


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, k = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the fingerprint as a signed long) of each row of docs."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "key": b.column("key"), "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def _signatures(fp: np.ndarray, key: np.ndarray, low: np.ndarray, bits: int, wilds: bool):
    """Variants of both halves of the bits that start at low: (key, free), where free is what of the fingerprint is left to compare.

    free is the start of the other half, and 64 more if a bit is spent: rows that met under a wildcard and differ there have
    one differing bit left, so one half of what is free is equal, and they need no more wildcards.
    """
    half = bits // 2
    for first, free in ((0, half), (half, 0)):
        value = fp >> (low + np.uint64(first)) & np.uint64((1 << half) - 1)
        for wild in range(-1, half if wilds else 0):
            masked = value if wild < 0 else value & ~np.uint64(1 << wild)
            tag = np.uint64((first * 64 + wild + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            yield mix(mix(masked + tag) + key * np.uint64(3)), low + np.uint64(free + 64 * (wild >= 0 or not wilds))


def signatures(rows: DataFrame, level: int) -> DataFrame:
    """Of rows (fp, key, free), the signatures of that level: key, fp, free."""
    bits = 64 >> level

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                fp, key, free = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("fp", "key", "free"))
                for wilds in (True, False):
                    own = (free < 64) == wilds
                    if own.any():
                        got = list(_signatures(fp[own], key[own], free[own] & np.uint64(63), bits, wilds))
                        yield pa.record_batch({"key": pa.array(np.concatenate([k for k, _ in got]).view(np.int64)), "fp": pa.array(np.tile(fp[own], len(got)).view(np.int64)), "free": pa.array(np.concatenate([x for _, x in got]).astype(np.int32))})

    return rows.select("fp", "key", F.col("free").cast("long")).mapInArrow(run, "key long, fp long, free int")


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest among distinct fingerprints."""
    n, out = len(fp), []
    if n == 2:
        return [(0, 1)] if int(fp[0] ^ fp[1]).bit_count() <= BITS else []
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(left)
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= BITS]
            left[near] = False
            out += [(i, j) for j in near.tolist()]
            todo += near.tolist()
    return out


def meet(signed: DataFrame, last: bool) -> DataFrame:
    """Of signatures (key, fp, free): links (a, b) with key null; where over GROUP meet and it is not the last level, their rows (a: fp, b: free) with key."""

    def run(batches):
        key, held, hot, out = None, [], False, []  # of the group that may go on in the next batch

        def rows(k, fp, free):
            return [(k, x, y) for x, y in zip(fp.tolist(), free.tolist(), strict=True)]

        def whole(k, fp, free):
            if len(fp) > GROUP and not last:
                return rows(k, fp, free)
            fp = np.unique(fp.view(np.uint64))
            return [(None, *np.array([fp[i], fp[j]]).view(np.int64).tolist()) for i, j in forest(fp)]

        def more(fp, free):
            nonlocal held, hot
            if hot:
                return rows(key, fp, free)
            held.append((fp, free))
            if sum(len(f) for f, _ in held) <= GROUP or last:
                return []
            fp, free = (np.concatenate(x) for x in zip(*held, strict=True))
            held, hot = [], True
            return whole(key, fp, free)

        def close():
            return whole(key, *(np.concatenate(x) for x in zip(*held, strict=True))) if held else []

        for b in batches:
            k, fp, free = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "free"))
            if not len(k):
                continue
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            ends, n, out = np.append(starts[1:], len(k)), len(starts), []
            go_on = int(key is not None and k[0] == key)
            if go_on:
                out += more(fp[: ends[0]], free[: ends[0]])
            if n > go_on:
                out += close()
                for g in np.flatnonzero(ends[go_on:-1] - starts[go_on:-1] > 1) + go_on:
                    out += whole(int(k[starts[g]]), fp[starts[g] : ends[g]], free[starts[g] : ends[g]])
                key, held, hot = int(k[-1]), [], False
                out += more(fp[starts[-1] :], free[starts[-1] :])
            yield flush(out)
        yield flush(close())

    def flush(out):
        return pa.record_batch([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["key", "a", "b"])

    return signed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "key long, a long, b long")


def edges(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp) that give the same components as all pairs of at most BITS differing bits."""
    rows, found = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("free")), []
    for level in range(LEVELS):
        got = materialize(meet(signatures(rows, level), level == LEVELS - 1), "near-links")
        found.append(got.where("key IS NULL").select("a", "b"))
        rows = got.where("key IS NOT NULL").select(F.col("a").alias("fp"), "key", F.col("b").alias("free"))
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def link(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), fp, component (of fingerprints), component_id of each row of docs."""
    fps = materialize(fingerprints(docs), "near-fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "near-distinct")
    parts = components(edges(distinct))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    told = join_skewed(named.select("fp", "component"), least.drop("n"), ["component"], heavy(least, ["component"]))
    # very many rows may have one fingerprint, and very many fingerprints be of one component
    return join_skewed(fps, told, ["fp"], heavy(distinct, ["fp"])).select("doc_id", "key", "fp", "component", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one row of docs: that of smallest doc_id (null is the largest), then of smallest hash of the text."""
    linked = materialize(link(docs), "near-linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key")).alias("first")
    kept = linked.groupBy("component").agg(first).select(F.col("first.doc_id").alias("__kept"), F.col("first.key").alias("__key"))
    twice = linked.groupBy("doc_id", "key").count().where("count > 1")
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("__kept")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left_semi")
    if twice.isEmpty():
        return out
    # rows that repeat wholly in doc_id and text: one of them stays
    return out.withColumn("__key", F.xxhash64("text")).dropDuplicates(["doc_id", "__key"]).drop("__key")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
