r"""Operator 5: duplicate spans by relative Lempel-Ziv factors.

Words are [^\x20\x09-\x0D]+. A window is WINDOW consecutive words of one document; a word goes if a window covers it whose
words also start in a document with a smaller doc_id.

  1. Whole texts of equal words are one class. Only the row of smallest doc_id is parsed further; in the others, if they have
     WINDOW words, every word goes.
  2. Anchors index the reference: of every window, the GRAM-word run of smallest hash (of the first, in a tie). The choice hangs
     on the window's words alone, so equal windows have equal anchors at the same place. Anchors held by one document only
     can't lie in a duplicate.
  3. At each anchor that documents share, the text around it (the windows that chose it) is parsed greedily against the
     reference block of that anchor, which is the same of all smaller doc_ids: the longest factor from here on that goes along
     with the reference's first occurrence, then the next from where it ends. A factor is at least WINDOW words, is compared
     window by window over its whole length, and where it ends the next window is looked up anew, so what lies across a factor's
     boundary is found too. Equal blocks of windows are merged before they meet.
  4. Factors of a document are united and its words counted and cut.

Windows are compared by 64-bit hashes of their word sequences. At anchors of over CROWD different blocks (a phrase in a
third of all documents) no task sees a block whole: the smallest row of each window is aggregated, map side first, and every
block is told which windows its own row is the first to have; there, factors are runs of windows without a named reference.

A null text has no words. Rows of a null doc_id are never the smaller one, and lose what any row with a doc_id holds; rows that
repeat a doc_id do not take words from one another. Extra columns are left out of spans() and kept by none of these functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, documents, heavy, join_skewed, materialize, sliding, windows

WINDOW, GRAM = 50, 16
#: Contexts of one anchor that a task parses against one another; of more, no task sees them whole.
CROWD = 1_000
SPAN = WINDOW - GRAM + 1  # runs of GRAM words in a window
#: Stands for a null doc_id, which no doc_id exceeds.
NOBODY = (1 << 63) - 1
_HASHES = WordHash(300_000, 5)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of all runs of GRAM words that some window of the word hashes h chooses."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = windows(h, GRAM)
    least = sliding(g, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    chosen = sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum) == g
    at = np.flatnonzero(chosen)
    return g[at], at


def chosen(g: np.ndarray) -> np.ndarray:
    """Of each window, the place of its anchor, given the hashes of all runs of GRAM words."""
    key = np.lib.stride_tricks.sliding_window_view(g, SPAN)
    out = np.empty(len(key), np.int64)
    for i in range(0, len(key), 4096):
        out[i : i + 4096] = key[i : i + 4096].argmin(1) + np.arange(i, min(i + 4096, len(key)))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """row (doc_id, or NOBODY), key (a hash of the text, for rows that share a doc_id), doc_id and text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NOBODY)).alias("row"), F.xxhash64("text").alias("key"), doc_id.alias("doc_id"), "text")


def parse(docs: DataFrame) -> DataFrame:
    """row, key, n_words, same (hash of all words), anchors and their places, of each row of docs."""

    def run(batches):
        for b in batches:
            n, same, grams, places = [], [], [], []
            for text in b.column("text").to_pylist():
                words = _words(text)
                n.append(len(words))
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                g, at = anchors(_HASHES.array(words)) if len(words) >= WINDOW else (np.empty(0, np.uint64), np.empty(0, np.int64))
                grams.append(g.view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.record_batch({"row": b.column("row"), "key": b.column("key"), "n_words": pa.array(n, pa.int64()), "same": pa.array(same, pa.binary()), "grams": pa.array(grams, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32()))})

    return keyed(docs).mapInArrow(run, "row long, key long, n_words long, same binary, grams array<long>, places array<int>")


def blocks(texts: DataFrame) -> DataFrame:
    """Of texts with shared places, the windows that chose each of those anchors: gram, row, key, start of the first, packed hashes."""

    def run(batches):
        for b in batches:
            gram, row, key, start, hashes = [], [], [], [], []
            for r, k, text, places in zip(*(b.column(c).to_pylist() for c in ("row", "key", "text", "places")), strict=True):
                h = _HASHES.array(_words(text))
                w, g = windows(h, WINDOW), windows(h, GRAM)
                to = chosen(g)
                own = np.unique(np.array(places, np.int64))
                lo, hi = np.searchsorted(to, own), np.searchsorted(to, own, "right")
                for p, i, j in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    if j > i:
                        gram.append(int(g[p]) - (1 << 64 if g[p] >> np.uint64(63) else 0))
                        row.append(r)
                        key.append(k)
                        start.append(i)
                        hashes.append(w[i:j].tobytes())
                if len(gram) > 20_000:
                    yield out(gram, row, key, start, hashes)
                    gram, row, key, start, hashes = [], [], [], [], []
            yield out(gram, row, key, start, hashes)

    def out(gram, row, key, start, hashes):
        return pa.record_batch({"gram": pa.array(gram, pa.int64()), "row": pa.array(row, pa.int64()), "key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int32()), "windows": pa.array(hashes, pa.binary())})

    return texts.mapInArrow(run, "gram long, row long, key long, start int, windows binary")


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Block:
    """The reference block of one anchor: what smaller rows have around it."""

    def __init__(self):
        self.contexts: list[tuple[int, int, np.ndarray]] = []  # row, start in it, windows
        self.first: dict[int, tuple[int, int]] = {}  # of each window, its first context and place

    def add(self, row: int, start: int, w: np.ndarray) -> None:
        k = len(self.contexts)
        self.contexts.append((row, start, w))
        for i, x in enumerate(w.tolist()):
            self.first.setdefault(x, (k, i))

    def parse(self, w: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Factors of windows w: place, windows in it, the reference's row and place there. A factor of n windows is n + WINDOW - 1 words."""
        out, i, listed = [], 0, w.tolist()
        while i < len(listed):
            at = self.first.get(listed[i])
            if at is None:
                i += 1
                continue
            row, start, reference = self.contexts[at[0]]
            n = common_prefix(w[i:], reference[at[1] :])
            out.append((i, n, row, start + at[1]))
            i += n
        return out


_FACTORS = "gram long, context long, places array<int>, sizes array<int>, rows array<long>, froms array<int>"


def packed(factors: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.record_batch([pa.array([f[i] for f in factors], t) for i, t in enumerate(types)], [c.split()[0] for c in _FACTORS.split(", ")])


def factor(contexts: DataFrame) -> DataFrame:
    """_FACTORS of contexts (gram, context, row, start, windows) against those of the same gram and smaller rows, where there are any.

    Contexts of one gram come in ascending row. The state is the gram's reference block, of at most CROWD contexts.
    """

    def run(batches):
        key, block, now, fresh, out = None, Block(), None, [], []
        for b in batches:
            for gram, context, row, start, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "context", "row", "start", "windows")), strict=True):
                if gram != key:
                    key, block, fresh, now = gram, Block(), [], row
                if row != now:  # windows of one row do not count against it
                    for x in fresh:
                        block.add(*x)
                    fresh, now = [], row
                w = np.frombuffer(raw, np.uint64)
                if found := block.parse(w):
                    out.append((gram, context, *zip(*found, strict=True)))
                fresh.append((row, start, w))
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
        yield packed(out)

    spread = contexts.repartition("gram").sortWithinPartitions("gram", "row")
    return spread.mapInArrow(run, _FACTORS)


def factor_apart(contexts: DataFrame) -> DataFrame:
    """As factor(), of anchors that too many contexts hold: by the smallest row of each window, which is aggregated before it moves."""

    def least(batches):
        seen: dict = {}
        for b in batches:
            for gram, row, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "row", "windows")), strict=True):
                for x in np.frombuffer(raw, np.int64).tolist():
                    if seen.get((gram, x), row) >= row:
                        seen[gram, x] = row
            if len(seen) > 200_000:
                yield flush(seen)
                seen.clear()
        yield flush(seen)

    def flush(seen):
        keys = list(seen)
        return pa.record_batch({"gram": pa.array([k[0] for k in keys], pa.int64()), "w": pa.array([k[1] for k in keys], pa.int64()), "row": pa.array([seen[k] for k in keys], pa.int64())})

    def run(batches):
        at, own, out = None, set(), []
        for b in batches:
            for gram, row, context, w, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "row", "context", "w", "windows")), strict=True):
                if (gram, row) != at:
                    at, own = (gram, row), set()
                if raw is None:  # these come first, and are no more than one document has at one anchor
                    own.add(w)
                    continue
                seen = np.array([x not in own for x in np.frombuffer(raw, np.int64).tolist()])
                edges = np.flatnonzero(np.diff(np.concatenate([[False], seen, [False]]).astype(np.int8)))
                places, ends = edges[::2].tolist(), edges[1::2].tolist()
                if places:
                    out.append((gram, context, places, [e - p for p, e in zip(places, ends, strict=True)], None, None))
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
        yield packed(out)

    first = contexts.select("gram", "row", "windows").mapInArrow(least, "gram long, w long, row long").groupBy("gram", "w").agg(F.min("row").alias("row"))
    nothing = lambda kind: F.lit(None).cast(kind)
    both = first.select("gram", "row", nothing("long").alias("context"), "w", nothing("binary").alias("windows")).unionByName(contexts.select("gram", "row", "context", nothing("long").alias("w"), "windows"))
    return both.repartition("gram", "row").sortWithinPartitions("gram", "row", F.col("windows").asc_nulls_first()).mapInArrow(run, _FACTORS)


def once(texts: DataFrame) -> DataFrame:
    """texts (row, key, ...) without rows that repeat within a task, before they are shuffled."""

    def run(batches):
        seen: set = set()
        for b in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            take = []
            for i, k in enumerate(zip(b.column("row").to_pylist(), b.column("key").to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    take.append(i)
            yield b.take(pa.array(take, pa.int64()))

    return texts.mapInArrow(run, texts.schema)


def spans(docs: DataFrame) -> tuple[DataFrame, list]:
    """row, key, copy, hits of each text, once, from which words may go; and the (row, key) that very many rows repeat.

    copy: its words are those of a smaller row. hits: (start, n, factors) of runs of windows that a smaller row has: all n from
    start, or the factors.
    """
    parsed = materialize(parse(docs), "substring-words")
    repeats = heavy(parsed.groupBy("row", "key").agg(F.count("*").alias("n")), ["row", "key"])
    first = parsed.groupBy("same").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    same = heavy(first, ["same"])
    first = first.select("same", "first")
    rows = join_skewed(parsed.where(f"n_words >= {WINDOW}").select("row", "key", "same"), first, ["same"], same)
    copies = rows.where("first < row").select("row", "key").distinct()
    own = parsed.where(F.size("grams") > 0).select("row", "key", "same", "grams", "places")
    texts = keyed(docs)
    if repeats:
        own, texts = once(own), once(texts)
    own = join_skewed(own, first, ["same"], same).where("first = row")
    held = own.select("row", "key", F.explode(F.arrays_zip("grams", "places")).alias("a")).select("row", "key", F.col("a.grams").alias("gram"), F.col("a.places").alias("place"))
    shared = materialize(held.groupBy("gram").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("gram", "n"), "substring-shared")
    places = join_skewed(held, shared.select("gram"), ["gram"], heavy(shared, ["gram"])).groupBy("row", "key").agg(F.collect_set("place").alias("places"))
    placed = texts.join(places, ["row", "key"])
    found = materialize(blocks(once(placed) if repeats else placed).withColumn("context", F.xxhash64("windows")), "substring-blocks")
    contexts = found.groupBy("gram", "context").agg(F.min(F.struct("row", "start")).alias("at"), F.first("windows").alias("windows"), F.count("*").alias("n"))
    contexts = materialize(contexts.select("gram", "context", "at.row", "at.start", "windows", "n"), "substring-contexts")
    counts = contexts.groupBy("gram").agg(F.count("*").alias("n"))
    crowded = heavy(counts, ["gram"], CROWD)
    if crowded:
        many = counts.where(F.col("n") > CROWD).select("gram", F.lit(True).alias("crowd"))
        parted = join_skewed(contexts, many, ["gram"], crowded, "left")
        factors = factor(parted.where("crowd IS NULL")).unionByName(factor_apart(parted.where("crowd")))
    else:
        factors = factor(contexts)
    told = contexts.select("gram", "context", F.col("row").alias("least")).join(factors, ["gram", "context"], "left")
    told = told.select("gram", "context", "least", F.when(F.col("places").isNotNull(), F.arrays_zip("places", "sizes")).alias("factors"))
    hits = (
        join_skewed(found.select("gram", "context", "row", "key", "start", F.expr("octet_length(windows) div 8").cast("int").alias("n")), told, ["gram", "context"], heavy(contexts, ["gram", "context"]))
        .where((F.col("row") > F.col("least")) | F.col("factors").isNotNull())
        .select("row", "key", F.struct("start", F.when(F.col("row") > F.col("least"), F.col("n")).alias("n"), "factors").alias("hit"))
        .groupBy("row", "key")
        .agg(F.collect_list("hit").alias("hits"))
    )
    kind = hits.schema["hits"].dataType
    out = copies.select("row", "key", F.lit(True).alias("copy"), F.lit(None).cast(kind).alias("hits")).unionByName(hits.select("row", "key", F.lit(False).alias("copy"), "hits"))
    return out, repeats


def removed(n: int, copy: bool, hits: list | None) -> np.ndarray:
    """Which of a text's n words go."""
    if copy:
        return np.full(n, n >= WINDOW)
    edges = np.zeros(n + 1, np.int64)
    for hit in hits or ():
        for place, size in [(0, hit["n"])] if hit["n"] is not None else [(f["places"], f["sizes"]) for f in hit["factors"]]:
            a, b = hit["start"] + place, min(hit["start"] + place + size, n - WINDOW + 1)
            if a < b:
                edges[a] += 1
                edges[b + WINDOW - 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (what is left, its words joined by one space) of each row of docs."""

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for text, copy, hits in zip(*(b.column(c).to_pylist() for c in ("text", "copy", "hits")), strict=True):
                words = _words(text)
                out = removed(len(words), bool(copy), hits)
                n.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x) if gone[-1] else b" ".join(words))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary())})

    found, repeats = spans(docs)
    joined = join_skewed(keyed(docs), found, ["row", "key"], repeats, "left").select("doc_id", "text", "copy", "hits")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT doc_id, words, len(words) AS n FROM w),
s AS (SELECT doc_id, words, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(words[i:i+49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM h JOIN f USING (h) WHERE first < doc_id),
r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
k AS (SELECT n.doc_id, n, words, coalesce(gone, []) AS gone FROM n LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(CASE WHEN len(gone) = 0 THEN array_to_string(words, ' ')
                   ELSE array_to_string(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE words[i] END), lambda x: x IS NOT NULL), ' ') END) AS kept_sha256
FROM k
"""
