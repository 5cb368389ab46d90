"""Operators on hits and lines that need no Python: positions, line-proximity joins, de-duplication, fingerprints, caps, suppression, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def lines(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, line (from 1), line_text of each line; only a line feed ends one."""
    return docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def line_starts(by_line: DataFrame, *keys: str) -> DataFrame:
    """by_line with the offset of each line's first character."""
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return by_line.withColumn("start", F.coalesce(F.sum(F.length("line_text") + 1).over(w), F.lit(0)))


def tokens(by_line: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """keys, line, ordinal (within the line, from 0), token: matches of a pattern without groups."""
    return by_line.select(*keys, "line", F.posexplode(F.regexp_extract_all("line_text", F.lit(pattern), F.lit(0))).alias("ordinal", "token"))


def near(hits: DataFrame, others: DataFrame, key: str, n: int, without: bool = False) -> DataFrame:
    """hits (key, line, end_line) that have one of others within n lines, or, without, have none: an equi-join on the document with a band."""
    o = others.select(F.col(key).alias("__key"), F.col("line").alias("__line"), F.col("end_line").alias("__end"))
    band = (F.col(key) == F.col("__key")) & (F.col("__end") >= F.col("line") - n) & (F.col("__line") <= F.col("end_line") + n)
    return hits.join(o, band, "left_anti" if without else "left_semi")


def within_ranges(hits: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """hits that meet one of ranges (key, lo, hi), such as a diff's hunks."""
    r = ranges.select(F.col(key).alias("__key"), "lo", "hi")
    return hits.join(r, (F.col(key) == F.col("__key")) & (F.col("end_line") >= F.col("lo")) & (F.col("line") <= F.col("hi")), "left_semi")


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def exact(hits: DataFrame) -> DataFrame:
    """One hit, the first emitted, of each rule and place."""
    return first_of_each(hits, ["path", "rule_id", "line", "col", "end_line", "end_col"], ["ordinal"])


def without_overlap(hits: DataFrame) -> DataFrame:
    """Of a rule's hits in a document: by start, the longest first, those that start at or after the end of the last one kept.

    What is kept hangs on what was kept before, so it is a fold over the rule's hits in the document, which the rule's cap bounds.
    """
    spans = hits.groupBy("path", "rule_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("minus"), F.col("ordinal").cast("long").alias("ordinal")))).alias("spans"))
    none = F.array().cast("array<bigint>")
    fold = F.aggregate(
        "spans",
        F.struct(F.lit(-1).alias("reach"), none.alias("kept")),
        lambda acc, x: F.when(x["start"] >= acc["reach"], F.struct((-x["minus"]).alias("reach"), F.concat(acc["kept"], F.array(x["ordinal"])).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    kept = spans.select("path", "rule_id", F.explode(fold).alias("ordinal"))
    return hits.join(kept, ["path", "rule_id", "ordinal"], "left_semi")


def clusters(spans: DataFrame, key: str = "path") -> DataFrame:
    """spans (key, s, e) with cluster: a new one starts where s reaches past every end before it."""
    order = [F.col("s"), F.col("e")]
    before = Window.partitionBy(key).orderBy(*order, "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(*order, "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("s") >= F.coalesce(F.max("e").over(before), F.lit(-1)), 1).otherwise(0)
    return spans.withColumn("__fresh", fresh).withColumn("cluster", F.sum("__fresh").over(upto)).drop("__fresh")


def winners(hits: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where rules' secrets overlap, the best rule keeps all its hits there: not generic, supersedes most of the others, highest score,
    highest confidence of its first hit, smallest id. Gives what is kept, and lost: path, ordinal, winner.

    hits: path, rule_id, ordinal, spans, score, confidence. rules: rule_id, generic, supersedes.
    """
    spans = hits.select("path", "rule_id", "ordinal", "score", "confidence", F.explode("spans").alias("x")).select("*", "x.s", "x.e").drop("x")
    placed = clusters(spans)
    at = ["path", "cluster"]
    by_rule = placed.groupBy(*at, "rule_id").agg(F.max("score").alias("best"), F.min(F.struct("s", "e", "ordinal", "confidence")).alias("first"))
    by_rule = by_rule.join(F.broadcast(rules), "rule_id")  # a few hundred rules at most
    entry = F.struct("rule_id", "best", F.col("first.confidence").alias("confidence"), "generic", "supersedes")
    # a cluster's rules are no more than there are rules
    met = by_rule.groupBy(*at).agg(F.collect_list(entry).alias("rs")).where(F.size("rs") > 1)
    members = F.transform("rs", lambda r: r["rule_id"])
    rank = F.transform("rs", lambda r: F.struct(r["generic"].alias("g"), (-F.size(F.array_intersect(r["supersedes"], F.array_remove(members, r["rule_id"])))).alias("n"), (-r["best"]).alias("b"), (-r["confidence"]).alias("c"), r["rule_id"].alias("id")))
    best = met.select(*at, F.array_min(rank)["id"].alias("winner"))
    lost = placed.select(*at, "rule_id", "ordinal").join(best, at).where("rule_id <> winner").select("path", "ordinal", "winner").distinct()
    return hits.join(lost, ["path", "ordinal"], "left_anti"), lost


def related(kept: DataFrame, hits: DataFrame, lost: DataFrame) -> DataFrame:
    """kept with related: the rules whose hits lost to this rule in the document, where their secrets overlap its own."""
    gone = hits.select("path", "ordinal", F.col("rule_id").alias("loser"), F.explode("spans").alias("x")).join(lost, ["path", "ordinal"])
    gone = gone.select(F.col("path").alias("__path"), "winner", "loser", F.col("x.s").alias("__s"), F.col("x.e").alias("__e"))
    own = kept.select("path", "rule_id", "ordinal", F.explode("spans").alias("x"))
    meets = (F.col("path") == F.col("__path")) & (F.col("rule_id") == F.col("winner")) & (F.col("x.s") < F.col("__e")) & (F.col("__s") < F.col("x.e"))
    names = own.join(gone, meets).groupBy("path", "ordinal").agg(F.array_sort(F.collect_set("loser")).alias("related"))
    return kept.join(names, ["path", "ordinal"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def also_reported(findings: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """findings with also_reported_by (source:id), and what is left of others (path, line, source, id, cwe: array, secret: boolean).

    Another scanner's finding is merged into one of the same line if they share a weakness (cwe), or both are of secrets.
    """
    o = others.select(F.col("path").alias("__path"), F.col("line").alias("__line"), F.concat_ws(":", "source", "id").alias("__name"), F.col("cwe").alias("__cwe"), F.col("secret").alias("__secret"))
    same = (F.col("path") == F.col("__path")) & (F.col("line") == F.col("__line")) & (F.arrays_overlap("cwe", "__cwe") | (F.size("spans") > 0) & F.col("__secret"))
    pairs = findings.join(o, same).select("fingerprint", "__path", "__line", "__name")
    names = pairs.groupBy("fingerprint").agg(F.array_sort(F.collect_set("__name")).alias("also_reported_by"))
    out = findings.join(names, "fingerprint", "left").withColumn("also_reported_by", F.coalesce("also_reported_by", F.array().cast("array<string>")))
    met = pairs.select(F.col("__path").alias("path"), F.col("__line").alias("line"), F.col("__name").alias("name")).distinct()
    left = others.withColumn("name", F.concat_ws(":", "source", "id")).join(met, ["path", "line", "name"], "left_anti").drop("name")
    return out, left.select(*others.columns)


def fingerprints(hits: DataFrame) -> DataFrame:
    """hits (path, rule_id, norm, start, ordinal) with occ, fingerprint and content_fingerprint; line numbers do not enter."""
    w = Window.partitionBy("path", "rule_id", "norm").orderBy("start", "ordinal")
    out = hits.withColumn("occ", F.row_number().over(w) - 1)
    occ = F.col("occ").cast("string")
    return out.withColumns({"fingerprint": C.fingerprint(F.col("rule_id"), F.col("path"), F.col("norm"), occ), "content_fingerprint": C.fingerprint(F.col("rule_id"), F.col("norm"), occ)})


def cap(hits: DataFrame, keys: list[str], most: int, order: list[str]) -> DataFrame:
    """hits with kept: the first `most` of each key."""
    return hits.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= most)


def _length_class(first: Column, last: Column) -> Column:
    """Of a range of lines, the largest k of which 2^k lines are no more than it has."""
    return F.length(F.bin(last.cast("long") - first.cast("long") + 1)) - 1


def first_markers(findings: DataFrame, markers: DataFrame) -> DataFrame:
    """fingerprint, marker_line, one row each: the first active marker (by line) that covers a line of it and names its rule; null without one.

    Pairs are never made, as many markers may cover many lines. A range of 2^k to 2^(k+1) - 1 lines is cut where stretches of 2^k lines meet.
    A piece then reaches from some line to the end of its stretch, or from its start to some line, so the least marker at a line is a running
    minimum within the stretch from either side. A finding is asked for once for each k that there is, 32 at most.
    """
    active = markers.where(F.col("active") & (F.col("first") <= F.col("last")))
    k, f = F.col("k"), F.col
    names = F.exists("ids", lambda i: (i == "*") | (i == F.col("rule_id")) | (i.endswith("*") & F.col("rule_id").startswith(F.regexp_replace(i, "[*]+$", ""))))
    m = active.select(f("path").alias("__path"), f("line").alias("marker_line"), f("first").cast("long").alias("first"), f("last").cast("long").alias("last"), "ids", _length_class(f("first"), f("last")).alias("k"))
    # a path's rules are no more than there are rules
    m = m.join(findings.select("path", "rule_id").distinct(), (f("path") == f("__path")) & names)
    stretch = lambda line: F.expr(f"shiftright({line}, k)")
    pieces = m.select("path", "rule_id", "k", "first", "last", "marker_line", F.explode(F.sequence(stretch("first"), stretch("last"))).alias("stretch"))
    # the last piece, where there are two or more, starts with its stretch; any other ends with it
    until = (f("stretch") == stretch("last")) & (f("stretch") > stretch("first"))
    at = F.when(until, f("last")).otherwise(F.greatest(f("first"), F.expr("shiftleft(stretch, k)")))
    pieces = pieces.select(F.lit(None).cast(findings.schema["fingerprint"].dataType).alias("fingerprint"), F.lit(False).alias("asked"), "path", "rule_id", "k", "stretch", at.alias("at"), F.when(~until, f("marker_line")).alias("since"), F.when(until, f("marker_line")).alias("until"))
    classes = active.agg(F.collect_set(_length_class(f("first"), f("last"))).alias("ks"))
    asked = findings.select("fingerprint", "path", "rule_id", f("line").cast("long").alias("at")).crossJoin(F.broadcast(classes))  # one row
    none = F.lit(None).cast(markers.schema["line"].dataType)
    asked = asked.select("fingerprint", F.lit(True).alias("asked"), "path", "rule_id", F.explode_outer("ks").alias("k"), "at").select("fingerprint", "asked", "path", "rule_id", "k", stretch("at").alias("stretch"), "at", none.alias("since"), none.alias("until"))
    w = Window.partitionBy("stretch", "path", "rule_id", "k")
    least = lambda c, order: F.min(c).over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = asked.unionAll(pieces).withColumns({"since": least("since", F.asc("at")), "until": least("until", F.desc("at"))}).where("asked")
    return met.groupBy("fingerprint").agg(F.min(F.least("since", "until")).alias("marker_line"))


def suppress(findings: DataFrame, markers: DataFrame) -> DataFrame:
    """findings with marker_line: the first active marker (by line) that covers the line and names the rule; null without one."""
    return findings.join(first_markers(findings, markers), "fingerprint", "left")


def baseline_match(findings: DataFrame, baseline: DataFrame, scanned: DataFrame, as_of: Column) -> DataFrame:
    """findings with baselined: by fingerprint, else by content where the entry's path was not scanned (the text has moved). Expired entries match nothing."""
    live = baseline.where(F.col("expires").isNull() | (F.col("expires") >= as_of))
    by_print = live.select("fingerprint").distinct().withColumn("__same", F.lit(True))
    gone = live.join(scanned.select("path").distinct(), "path", "left_anti")
    by_content = gone.select("content_fingerprint").distinct().withColumn("__moved", F.lit(True))
    out = findings.join(by_print, "fingerprint", "left").join(by_content, "content_fingerprint", "left")
    return out.withColumn("baselined", F.when(F.col("__same"), "same").when(F.col("__moved"), "moved")).drop("__same", "__moved")


def baseline_create(findings: DataFrame, reason: str, as_of: str, allow_critical: bool = False) -> DataFrame:
    """Entries of the unsuppressed findings. A reason of ten characters is needed; critical findings only where allowed."""
    if len(reason.strip()) < 10:
        raise ValueError("a reason of at least ten characters is needed")
    rows = findings.where("suppressed IS NULL")
    if not allow_critical and not rows.where("severity = 'critical'").isEmpty():
        raise ValueError("critical findings do not go into a baseline")
    return rows.dropDuplicates(["fingerprint"]).select("fingerprint", "content_fingerprint", "rule_id", "path", "line", "severity", F.lit(reason).alias("reason"), F.lit(as_of).cast("date").alias("added_at"), F.lit(None).cast("date").alias("expires"))


def baseline_update(baseline: DataFrame, findings: DataFrame, scanned: DataFrame, prune: bool = True, add_new: bool = False, reason: str = "", as_of: str = "", allow_critical: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """kept, pruned and added entries: one goes if its path was scanned and neither of its fingerprints was seen; new findings are added, with a reason, if so asked."""
    seen = findings.select(F.col("fingerprint").alias("__f")).distinct()
    content = findings.select(F.col("content_fingerprint").alias("__c")).distinct()
    paths = scanned.select(F.col("path").alias("__p")).distinct()
    unseen = baseline.join(seen, F.col("fingerprint") == F.col("__f"), "left_anti").join(content, F.col("content_fingerprint") == F.col("__c"), "left_anti")
    pruned = unseen.join(paths, F.col("path") == F.col("__p"), "left_semi") if prune else unseen.limit(0)
    kept = baseline.join(pruned.select("fingerprint"), "fingerprint", "left_anti")
    if not add_new:
        return kept, pruned, baseline.limit(0)
    added = baseline_create(findings, reason, as_of, allow_critical)
    return kept, pruned, added.join(baseline.select("fingerprint"), "fingerprint", "left_anti").join(baseline.select("content_fingerprint"), "content_fingerprint", "left_anti").select(*added.columns)


def stats(findings: DataFrame) -> DataFrame:
    """One row: findings, suppressed ones, and how many of each severity."""
    shown = F.col("suppressed").isNull()
    return findings.agg(F.count("*").alias("findings"), F.count_if(~shown).alias("suppressed"), *[F.count_if(shown & (F.col("severity") == s)).alias(s) for s in C.SEVERITIES])


def suppressed_by_kind(findings: DataFrame) -> DataFrame:
    """One row: how many findings a marker, and how many a baseline, suppresses."""
    return findings.agg(*[F.count_if(F.col("suppressed") == k).alias(k) for k in ("inline", "baseline")])


def profile(findings: DataFrame, most: int = 20) -> DataFrame:
    """The rules of most findings."""
    return findings.groupBy("rule_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "rule_id").limit(most)


def precision(judged: DataFrame, *keys: str, lines: str | None = None) -> DataFrame:
    """Of judged (keys, found, true: boolean; lines: of code): tp, fp, fn, precision, recall, f1, fdr, Wilson's interval of the precision (95%), and false ones per 1,000 lines."""
    f, t = F.col("found"), F.col("true")
    out = judged.groupBy(*keys).agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), *([F.sum(lines).alias("__lines")] if lines else []))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    z, n = 1.959964, F.nullif(tp + fp, F.lit(0.0))
    p = tp / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    out = out.withColumns({"precision": p, "recall": tp / F.nullif(tp + fn, F.lit(0.0)), "f1": 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0)), "fdr": 1 - p, "low": middle - half, "high": middle + half})
    return out.withColumn("fp_per_kloc", F.col("fp") / F.nullif(F.col("__lines") / 1000.0, F.lit(0.0))).drop("__lines") if lines else out


def gate(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """One row: whether any finding that is not suppressed is of at least that severity."""
    bad = F.col("suppressed").isNull() & (C.rank(F.col("severity"), C.SEVERITIES) >= C.SEVERITIES.index(fail_on))
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("fails"))
