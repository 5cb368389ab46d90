"""Operator 1: quality by a regularised quadratic discriminant over transformed statistics of each text.

Each class has a mean and a covariance, shrunk towards a multiple of the identity after all features are put on one scale.
The Cholesky factors are found once; a score is the difference of the two Mahalanobis log densities, made a probability by
a logistic fit over the labelled rows. Of labels and texts only sums over classes reach the driver: 2 (1 + d + d^2) numbers.

All labelled rows outside the held-out fold are learnt from, without a sample. A null label is no label, a null text counts
as empty, a null doc_id has no label; rows that repeat count as often as they stand. Without rows of both classes each score
is the share of class 1, or 0.5. Extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, materialize

#: Shrinkage of the class covariances.
SHRINKAGE = 0.1
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"|", b"!?", b".,;:'\"()-", b"*$%&#@^~+=<>{}[]\\/_`"]
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c), _i] = 1
_TABLE[128:, -1] = 1


def statistics(text: str | None) -> list[float]:
    """What is measured of a text: log odds of kinds of characters, words' lengths and repetition, and lines' repetition."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE
    words, lines = raw.split(), raw.split(b"\n")
    n, w = len(raw), len(words)
    share = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5)) if whole >= part else 0.0
    return [
        math.log1p(n),
        *(share(c, n) for c in counts),
        math.log((n - counts[3] - counts[4] + 1) / (w + 1)),
        math.log((len(set(words)) + 1) / (w + 1)),
        share(len(lines) - len(set(lines)), len(lines)),
        math.log((w + 1) / len(lines)),
    ]


D = len(statistics(""))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x: an array of D doubles, of each row of docs."""

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "x": x})

    docs = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each class of (x, y): rows, sum of x, sum of x x'. Sums are made in each partition first."""

    def run(batches):
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            x, y = matrix(b.column("x"), D), b.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.record_batch({"y": pa.array([0, 1], pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    sums = labelled.select("x", "y").mapInArrow(run, "y int, sums array<double>")
    rows = sums.select("y", F.posexplode("sums")).groupBy("y", "pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros((2, 1 + D + D * D))
    for r in rows:
        out[r["y"], r["pos"]] = r["s"]
    return {k: (out[k, 0], out[k, 1 : 1 + D], out[k, 1 + D :].reshape(D, D)) for k in (0, 1)}


class Discriminant:
    """Log-density difference of class 1 over class 0; factors are kept inverted."""

    def __init__(self, by_class: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        n = sum(m[0] for m in by_class.values())
        mean = sum(m[1] for m in by_class.values()) / n
        spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in by_class.values())) / n - mean**2, 1e-12))
        self.mean, self.spread, self.parts = mean, np.where(spread > 1e-5, spread, 1.0), []
        for k in (0, 1):
            rows, total, outer = by_class[k]
            centre = (total / rows - mean) / self.spread
            cov = (outer / rows - np.outer(total / rows, total / rows)) / np.outer(self.spread, self.spread)
            cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / D, 1e-3) * np.eye(D)
            factor = np.linalg.cholesky(cov)
            self.parts.append((centre, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + math.log(rows / n)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        a, b = (c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in self.parts)
        return np.clip(b - a, -60, 60)


def logistic(margins: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins, with counts of either class, probabilities: Newton's method, with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        n = ones + zeros
        g = np.array([((p * n - ones) * margins).sum() + (a - 1), (p * n - ones).sum() + 1e-2 * b])
        w = p * (1 - p) * n
        h = np.array([[(w * margins**2).sum() + 1, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """logistic() over (margin, y), of which 601 bins reach the driver."""
    rows = scored.groupBy(F.round(F.col("margin") * 5).alias("bin")).agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    m, one, n = (np.array([float(r[c]) for r in rows]) for c in ("bin", "ones", "n"))
    return logistic(m / 5, one, n - one)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; labels: doc_id and the label, 0 or 1."""
    x = materialize(features(docs), "quality-features")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    train = x.where(~F.col("held_out")).join(known, "doc_id").select("x", "y")
    by_class = moments(train)
    n0, n1 = by_class[0][0], by_class[1][0]
    if not n0 or not n1:
        probability = F.lit(n1 / (n0 + n1) if n0 + n1 else 0.5)
        return x.select("doc_id", "held_out", probability.alias("score"), (probability >= threshold).cast("int").alias("predicted"))
    model = Discriminant(by_class)

    def margins(batches):
        for b in batches:
            yield pa.record_batch({"y": b.column("y"), "margin": pa.array(model.margin(matrix(b.column("x"), D)))})

    slope, offset = calibrate(train.mapInArrow(margins, "y int, margin double"))

    def run(batches):
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(slope * model.margin(matrix(b.column("x"), D)) + offset, -35, 35)))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return x.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
