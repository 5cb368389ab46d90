"""What the operators share: inputs, the shared folder, labels' folds, word hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fold of five is held out: rows whose crc32(doc_id as text) mod 5 is 0.
FOLDS = 5
_SCRATCH: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where a local master has none, as in tests, a new local one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="textlode-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone; then its shared folder's owner cleans up
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it: lineage is cut, and a lost executor costs nothing that was done."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a range of rows is to have, where that asks for more ranges than there are shuffle partitions.
RANGE_BYTES = 128 << 20


class Ranges:
    """Ranges of keys (a, b), parted at keys of the rows' own: each starts with a row that is there."""

    def __init__(self, starts: list[tuple[int, int]]):
        self.a, self.b = (np.array([s[i] for s in starts], np.int64) for i in (0, 1))

    def __len__(self) -> int:
        return len(self.a)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The range of each key; keys before the first range are put there."""
        lo, hi = np.searchsorted(self.a, a, "left"), np.searchsorted(self.a, a, "right")
        out = lo - 1
        for i in np.flatnonzero(hi > lo).tolist():  # a start has the same a: b decides
            out[i] += np.searchsorted(self.b[lo[i] : hi[i]], b[i], "right")
        return np.maximum(out, 0)


def ranges(sample: DataFrame, n: int, least: tuple[int, int] | None = None) -> Ranges:
    """At most n ranges about as heavy as each other, by a sample (a, b, weight: long) of which some hundreds of n rows reach the driver."""
    rows = sorted(tuple(r) for r in sample.groupBy("a", "b").agg(F.sum("weight").alias("weight")).collect())
    if least is not None:
        rows = [(*least, 1), *(r for r in rows if r[:2] > least)]
    total = sum(r[2] for r in rows)
    starts, passed = [], 0
    for a, b, weight in rows:
        if passed * n >= len(starts) * total:
            starts.append((a, b))
        passed += weight
    return Ranges(starts or [(-(1 << 63), -(1 << 63))])


#: Rows of one key that a task takes as any others.
HOT = 10_000
#: Parts that rows of a hot key are dealt over, where there are as many partitions.
SALTS = 256


def heavy(rows: DataFrame, keys: list[str], over: int | None = None) -> list:
    """Of rows (keys, and their count n), the keys of most rows, if over HOT: at most four for each partition. No other holds more than a fourth of an even share."""
    return rows.where(F.col("n") > (HOT if over is None else over)).orderBy(F.desc("n"), *keys).limit(4 * partitions(rows.sparkSession)).select(*keys).collect()


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], hot: list, how: str = "inner") -> DataFrame:
    """left join right (one row a key) where rows of the keys `hot` (see heavy(): a bounded number) are dealt over SALTS parts by a hash of the row, and right's are sent to each."""
    if not hot:
        return left.join(right, keys, how)
    spark = left.sparkSession
    hashes = [r[0] for r in spark.createDataFrame(hot, left.select(*keys).schema).select(F.xxhash64(*keys)).collect()]
    salts = min(SALTS, partitions(spark))
    is_hot = F.xxhash64(*keys).isin(hashes)  # another key of the same hash is dealt out as well, on both sides
    plain = [c for c in left.columns if left.schema[c].dataType.typeName() not in ("array", "map", "struct")]
    dealt = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*plain, F.lit(1)), F.lit(salts))).otherwise(0).cast("int"))
    sent = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(sent, [*keys, "__salt"], how).drop("__salt")


def held_out(doc_id="doc_id"):
    """True for the rows that no label is learnt from; a null doc_id counts as its text "" does."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


class WordHash(dict):
    """bytes to its unsigned XXH64; emptied when full, so memory stays bounded."""

    def __init__(self, most: int = 300_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+: bytes.split() parts at just these six."""
    return text.split()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive values of h (uint64); empty if there are fewer."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    if len(_POWERS[0]) <= n:
        size = 2 * n + 1024
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _POWERS[0][:n], dtype=np.uint64, out=s[1:])
    return mix((s[k:] - s[: n - k + 1]) * _POWERS[1][: n - k + 1])


def sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of w values; w <= len(a)."""
    have = 1
    while have < w:
        step = min(have, w - have)
        a = f(a[:-step], a[step:])
        have += step
    return a


def one_thread() -> None:
    """Libraries' own threads off: Spark's tasks use the cores."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
