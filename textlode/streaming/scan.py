"""Scans of a stream: hits of a document hang on that document alone, so the matching plan runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import match
from ..plans.scan import scan
from ..rules import RULES, Rule


def hits(stream: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Hits of a stream of (path, text), stateless."""
    return match.match(stream, rules)


def findings(stream: DataFrame, out: str, checkpoint: str, rules: list[Rule] = RULES, **trigger):
    """Starts a query that scans every micro-batch in full and appends its findings to out. A batch that is run again replaces its folder."""

    def each(batch: DataFrame, number: int) -> None:
        scan(batch, rules).findings.drop("captures", "props").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def new_fingerprints(found: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """A stream of findings (fingerprint, time) without those seen before within the watermark."""
    return found.withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])


def counts(found: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings by rule and window of event time, with late ones up to the watermark."""
    return found.withWatermark(time, late).groupBy(F.window(time, window), "rule_id").agg(F.count("*").alias("n"))
