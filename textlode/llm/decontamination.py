r"""Operator 7: benchmark passages in documents, by latent semantic retrieval, then a longest common subsequence and the answer.

Terms are the benchmark's own words (runs of letters and digits, in lower case); other words weigh nothing in either text.
  1. How many documents hold each term is counted over all documents.
  2. A randomised decomposition (Nystrom's) of A'A, A being the TF-IDF matrix of passages, gives the latent space in one pass:
     Z = A'(A Omega), summed over partitions, Q R from its QR, then the eigenvectors of R (Omega'Z)^-1 R' in Q. A has every
     passage of every document, without a sample, and all benchmark passages, weighed up to as much as the rest.
  3. Every document is cut into overlapping passages of PASSAGE words. Each of the benchmark's items whose cosine with one is COSINE
     or more is a candidate. A passage is projected against an item only if the text that step 4 looks at has words enough for
     COMMON: that leaves at most `spare` of the item's words out, so of its spare + k rarest ones k must be there, in any order.
     No pair that could come through step 4 is left out by this.
  4. A candidate holds if the item's words and those of the passage with as much text around it have a longest common
     subsequence of LCS of the item's words, or of COMMON if its answer, the item's last ANSWER words, stands there too.

The benchmark is a fixed set of queries, held on the driver. Terms, document frequencies and latent space are those of all items;
tasks are sent ITEMS items at once, and each further block of items reads the documents' term ids again, not their texts.
A null text counts as empty; an empty item is no query; of items that repeat the smallest item_id is named, a null one last.
Null doc_ids and rows that repeat are searched as any other, and each row is answered; extra columns are left out of search().
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

PASSAGE, STEP, RANK, COSINE, LCS, COMMON, ANSWER = 32, 16, 192, 0.35, 0.65, 0.5, 4
ITEMS = 10_000
RARE, LEAST, HITS = 0.02, 4, 1_000_000
FOUND = "doc_id long, key long, contaminated int, item_id long, lcs double, cosine double"
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Terms(dict):
    """Ids of the benchmark's terms among what stands between two spaces; what was looked up is remembered, within bounds."""

    def __init__(self, vocabulary: list[str], most: int = 300_000):
        super().__init__()
        self.ids, self.most, self.many = {w: i for i, w in enumerate(vocabulary)}, most, []

    def __missing__(self, part: str) -> int:
        """The id of a single word, -1 if it is no term; of none or more words, -2 - their place in self.many."""
        got = [self.ids.get(w, -1) for w in _WORD.findall(part)]
        if len(got) == 1:
            self[part] = got[0]
        else:
            self[part] = -2 - len(self.many)
            self.many.append(got)
        return self[part]

    def of(self, text: str | None) -> np.ndarray:
        """The id of each word of the text, -1 for a word that is none."""
        if len(self) > self.most:
            self.clear()
            self.many.clear()
        parts = (text or "").lower().split()
        ids = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
        odd = np.flatnonzero(ids < -1)
        if not len(odd):
            return ids
        out, last = [], 0
        for i in odd.tolist():
            out += [ids[last:i], np.array(self.many[-2 - int(ids[i])], np.int32)]
            last = i + 1
        return np.concatenate([*out, ids[last:]])


def lcs(masks: dict[int, int], n: int, row: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words, given as bit masks of their places, and row."""
    full = (1 << n) - 1
    v = full
    for w in row:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Benchmark:
    """A block of items: their terms, places and vectors. vocabulary: the terms of all blocks."""

    def __init__(self, items: list[tuple[int | None, str]], vocabulary: list[str] | None = None):
        listed = [(i, words(t)) for i, t in items]
        listed = [(i, w) for i, w in listed if w]
        self.vocabulary = sorted({x for _, w in listed for x in w}) if vocabulary is None else vocabulary
        ids = {w: i for i, w in enumerate(self.vocabulary)}
        self.names = [i for i, _ in listed]
        self.rows = [np.array([ids[x] for x in w]) for _, w in listed]
        self.masks = []
        for r in self.rows:
            m: dict[int, int] = {}
            for place, w in enumerate(r.tolist()):
                m[w] = m.get(w, 0) | 1 << place
            self.masks.append(m)

    def weigh(self, df: dict[int, int], documents: int) -> None:
        n = np.array([df.get(i, 0) for i in range(len(self.vocabulary))])
        self.idf = np.log((1 + documents) / (1 + n)) + 0.1
        # an item's rarest words, those that spare + LEAST takes and all in at most RARE of the documents; need: how many of them must be there
        self.need, self.reach, pairs = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), np.int64), []
        for i, r in enumerate(self.rows):
            spare = len(r) - math.ceil(COMMON * len(r) - 1e-9)
            r = r[np.argsort(n[r], kind="stable")]
            first = min(len(r), max(spare + LEAST, int((n[r] <= RARE * documents).sum())))
            self.need[i], self.reach[i] = first - spare, -(-len(r) // STEP)
            pairs += [(w, i) for w in np.unique(r[:first]).tolist()]
        words, self.rare_items = (np.array(x, np.int64) for x in (zip(*sorted(pairs), strict=True) if pairs else ((), ())))
        self.rare_at = np.searchsorted(words, np.arange(len(n) + 1))

    def matrix(self) -> np.ndarray:
        a = np.zeros((len(self.rows), len(self.vocabulary)))
        for i, r in enumerate(self.rows):
            np.add.at(a[i], r, self.idf[r])
        return a


def passages(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - PASSAGE + STEP), STEP)


def _dense(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text, and its passages' TF-IDF vectors over these, of length one."""
    at = np.flatnonzero(ids >= 0)
    seen, place = np.zeros(len(idf), bool), np.empty(len(idf), np.int64)
    seen[ids[at]] = True
    own = np.flatnonzero(seen)
    place[own] = np.arange(len(own))
    steps = len(passages(len(ids))) + 1
    a = np.bincount(at // STEP * len(own) + place[ids[at]], minlength=steps * len(own)).reshape(steps, len(own)).astype(np.float32)
    a = (a[:-1] + a[1:]) * idf[own]  # a passage is two steps
    return own, a / np.maximum(np.sqrt(np.einsum("ij,ij->i", a, a)), 1e-9)[:, None]


def _summed(rows: DataFrame, idf: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A'(A left) over all passages of rows: partitions are summed, then their sums."""
    small, light = left.astype(np.float32), idf.astype(np.float32)

    def run(batches):
        total = np.zeros(left.shape)
        for b in batches:
            for raw in b.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<i4")
                for i in range(0, max(1, len(ids) - STEP), 1024):  # a part ends with the passage that starts before the next
                    own, a = _dense(ids[i : i + 1024 + STEP], light)
                    if len(own):
                        total[own] += a.T @ (a @ small[own])
        at = range(0, len(total), 32)
        yield pa.record_batch({"i": pa.array(at, pa.int32()), "x": pa.array([total[i : i + 32].tobytes() for i in at], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(x, np.float64) for x in table["x"].to_pylist())
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(left.shape)
    for r in rows.select("ids").mapInArrow(run, "i int, x binary").groupBy("i").applyInArrow(add, "i int, x binary").collect():
        part = np.frombuffer(r["x"], np.float64).reshape(-1, out.shape[1])
        out[r["i"] : r["i"] + len(part)] = part
    return out


def latent(rows: DataFrame, blocks: list[Benchmark], rank: int = RANK) -> np.ndarray:
    """Terms' vectors in the latent space: terms x rank."""
    idf = blocks[0].idf
    width = min(rank + 16, len(idf))
    start = np.linalg.qr(np.random.default_rng(7).standard_normal((len(idf), width)))[0]

    def unit(bench: Benchmark) -> np.ndarray:
        a = bench.matrix()
        return a / np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-9)

    z = _summed(rows, idf, start)
    own = sum(a.T @ (a @ start) for a in map(unit, blocks))
    z += max(1.0, np.linalg.norm(z) / max(np.linalg.norm(own), 1e-9)) * own
    q, r = np.linalg.qr(z)
    core = start.T @ z
    values, vectors = np.linalg.eigh(r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-6, hermitian=True) @ r.T)
    best = np.argsort(values)[::-1][: min(rank, width)]
    return q @ vectors[:, best]


class Searcher:
    def __init__(self, bench: Benchmark, space: np.ndarray):
        self.bench = bench
        self.terms = np.vstack([space * bench.idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)  # the last is for other words
        items = np.array([self.terms[r].sum(0) for r in bench.rows])
        self.items = items / np.maximum(np.sqrt((items * items).sum(1, keepdims=True)), 1e-9)

    def near(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and steps of STEP words of whole: the pairs in which words enough stand around the passage that starts at the step."""
        b = self.bench
        at = np.flatnonzero(whole >= 0)
        lo, hi = b.rare_at[whole[at]], b.rare_at[whole[at] + 1]
        n = hi - lo
        item = b.rare_items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        edge = 2 * int(b.reach.max()) + 4
        wide = len(whole) // STEP + 2 * edge  # steps of an item, with room on both sides
        key, count = np.unique(item * wide + np.repeat(at // STEP, n) + edge, return_counts=True)
        until = np.concatenate([[0], np.cumsum(count)])

        def held(first: np.ndarray, item: np.ndarray) -> np.ndarray:
            return until[np.searchsorted(key, first + 2 * b.reach[item] + 2)] - until[np.searchsorted(key, first)] >= b.need[item]

        # the steps around that have enough begin with one that has a word; as many steps from there on have no fewer
        item = key // wide
        some = held(key, item)
        item, n = item[some], 2 * b.reach[item[some]] + 2
        first = np.unique(np.repeat(key[some] - n + 1 - np.cumsum(n) + n, n) + np.arange(n.sum()))
        item = first // wide
        some = held(first, item)
        return item[some], first[some] % wide - edge + b.reach[item[some]]

    def candidates(self, texts: list[np.ndarray]) -> list[dict[tuple[int, int], float]]:
        """Of each text: (item, start of passage) to cosine."""
        out: list[dict[tuple[int, int], float]] = [{} for _ in texts]
        steps = np.array([-(-len(t) // STEP) + 1 for t in texts])
        base = np.cumsum(steps) - steps
        whole = np.full(steps.sum() * STEP, -1, np.int32)
        for t, i in zip(texts, base.tolist(), strict=True):
            whole[i * STEP : i * STEP + len(t)] = t
        item, step = self.near(whole)
        whole = whole.reshape(-1, STEP)
        order = np.argsort(step, kind="stable")
        item, step = item[order], step[order]
        text = np.searchsorted(base, step, "right") - 1
        real = (step >= 0) & (step - base[text] < np.array([len(passages(len(t))) for t in texts])[text])
        item, step, text = item[real], step[real], text[real]
        for i in range(0, len(item), 4096):
            own, s = item[i : i + 4096], step[i : i + 4096]
            starts, at = np.unique(s, return_inverse=True)
            row = self.terms[whole[starts]].sum(1) + self.terms[whole[starts + 1]].sum(1)
            row /= np.maximum(np.sqrt((row * row).sum(1, keepdims=True)), 1e-9)
            cosine = (row[at] * self.items[own]).sum(1)
            for k in np.flatnonzero(cosine >= COSINE).tolist():
                t = int(text[i + k])
                out[t][int(own[k]), int(s[k] - base[t]) * STEP] = float(cosine[k])
        return out

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int | None, float, float]]:
        """Best of each text; as many at once as have about HITS places of items' words."""
        out, some, n = [], [], 0
        for ids in texts:
            some.append(ids)
            own = ids[ids >= 0]
            n += int((self.bench.rare_at[own + 1] - self.bench.rare_at[own]).sum()) + len(ids)
            if n > HITS:
                out += map(self.best, some, self.candidates(some))
                some, n = [], 0
        return out + list(map(self.best, some, self.candidates(some))) if some else out

    def best(self, ids: np.ndarray, candidates: dict[tuple[int, int], float]) -> tuple[int, int | None, float, float]:
        """contaminated, item_id, share of the item's words in order, cosine: of the best candidate, that which holds first."""
        best, first, top = (0, None, 0.0, 0.0), True, (0, 0.0, 0)
        for (item, start), cosine in candidates.items():
            own = self.bench.rows[item]
            n = len(own)
            row = ids[max(0, start - n) : start + PASSAGE + n].tolist()
            share = lcs(self.bench.masks[item], n, row) / n
            if share < COMMON:
                continue
            answer = own[-ANSWER:].tolist()
            told = any(row[i : i + len(answer)] == answer for i in range(len(row) - len(answer) + 1))
            holds = int(share >= LCS or told)
            name = self.bench.names[item]
            rank = (holds, share, -(1 << 62) if name is None else -name)
            if first or rank > top:
                first, top, best = False, rank, (holds, name, share, cosine)
        return best


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """FOUND of each row of docs: whether a benchmark item holds, and the best candidate that shares COMMON of its words; key: a hash of the text."""
    asked = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    items = sorted(((r["item_id"], r["text"]) for r in asked.collect()), key=lambda x: (x[0] is None, x))
    items = [(i, t) for i, t in items if words(t)]
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    if not items:
        return texts.select("doc_id", "key", F.lit(0).alias("contaminated"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("lcs"), F.lit(0.0).alias("cosine"))
    vocabulary = sorted({w for _, t in items for w in words(t)})
    blocks = [Benchmark(items[i : i + ITEMS], vocabulary) for i in range(0, len(items), ITEMS)]
    terms = Terms(vocabulary)

    def look(batches):
        for b in batches:
            ids = pa.array([terms.of(t).astype("<i4").tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([b.column("doc_id"), b.column("key"), ids], ["doc_id", "key", "ids"])

    def count(batches):
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            for raw in b.column("ids").to_pylist():
                own = np.unique(np.frombuffer(raw, "<i4"))
                df[own[own >= 0]] += 1
                n += 1
        yield pa.record_batch({"t": pa.array(range(-1, len(df)), pa.int64()), "n": pa.array(np.append(n, df))})

    seen = texts.mapInArrow(look, "doc_id long, key long, ids binary")
    rows = materialize(seen if len(blocks) == 1 else seen.withColumn("row", F.monotonically_increasing_id()), "passage-terms")
    df = {r["t"]: r["n"] for r in rows.select("ids").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    for bench in blocks:
        bench.weigh(df, total)
    space = latent(rows, blocks)

    def found(bench: Benchmark, keys: list[str]) -> DataFrame:
        searcher = Searcher(bench, space)

        def run(batches):
            for b in batches:
                got = searcher.search([np.frombuffer(raw, "<i4") for raw in b.column("ids").to_pylist()])
                columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.record_batch([*(b.column(k) for k in keys), *columns], [*keys, "contaminated", "item_id", "lcs", "cosine"])

        return rows.select(*keys, "ids").mapInArrow(run, "".join(f"{k} long, " for k in keys) + "contaminated int, item_id long, lcs double, cosine double")

    if len(blocks) == 1:
        return found(blocks[0], ["doc_id", "key"])
    best = None
    for bench in blocks:
        own = found(bench, ["row", "doc_id", "key"])
        best = own if best is None else best.unionByName(own)
    top = F.max(F.struct("contaminated", "lcs", F.coalesce(-F.col("item_id"), F.lit(-(1 << 62))).alias("minus"), "item_id", "cosine")).alias("b")
    return best.groupBy("row", "doc_id", "key").agg(top).select("doc_id", "key", "b.contaminated", "b.item_id", "b.lcs", "b.cosine")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item holds."""
    bad = search(docs, benchmark).where("contaminated = 1").select(F.col("doc_id").alias("__bad"), F.col("key").alias("__key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__bad")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(bad, same, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")
