"""A scan from documents to findings: one pass over texts, then shuffles of what was found alone."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import classify, match, relational
from ..rules import RULES, Rule, problems, severity_of
from ..storage import materialize

#: Characters of an injected text that are scanned; of a longer one its head and tail.
INJECT_CHARS = 1 << 20


@dataclass(frozen=True)
class Options:
    fail_on: str = "high"
    min_severity: str = "info"
    min_confidence: str = "low"
    exposure_globs: dict = field(default_factory=dict)
    severity_overrides: dict = field(default_factory=dict)
    allow_values: tuple[str, ...] = ()
    classify_rules: tuple = ()
    skip_minified: bool = True
    wildcard: bool = False
    inject: bool = False  # untrusted input: no markers, exposure default, kind doc
    seconds: float | None = None  # that matching may take
    as_of: str | None = None  # a date; None: the day (UTC) on which the scan is planned


@dataclass
class Result:
    findings: DataFrame
    #: What the gate judges: before min_severity.
    gated: DataFrame
    #: Every finding, before min_confidence too: suppressed ones are counted here.
    every: DataFrame
    markers: DataFrame
    #: path, line, code, rule_id, level, message, n
    diagnostics: DataFrame
    #: path, rule_id, lost
    capped: DataFrame
    #: values that snippets of no document may show
    secrets: DataFrame
    truncated: bool = False

    def stats(self) -> dict:
        """Findings by severity of what is shown; suppressed ones by kind, of all that were found."""
        shown = relational.stats(self.findings).first().asDict()
        return shown | {f"suppressed_{k}": n for k, n in relational.suppressed_by_kind(self.every).first().asDict().items()}

    def by_rule(self, most: int = 20) -> DataFrame:
        """The rules of most findings: rule_id, hits."""
        return relational.profile(self.every, most)

    def fails(self, fail_on: str = "high") -> bool:
        return fail_on != "never" and relational.gate(self.gated, fail_on).first()["fails"]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.id, r.pack, r.severity, r.exposure_sensitive, r.generic, list(r.supersedes), r.message or r.title, r.pack.startswith("agents"), list(r.cwe)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, pack string, base string, sensitive boolean, generic boolean, supersedes array<string>, message string, guarded boolean, cwe array<string>")


def message(template: Column, captures: Column) -> Column:
    """{{name}} in a message is the capture of that name, or nothing."""
    parts = F.split(template, r"\{\{")

    def told(part: Column) -> Column:
        name = F.trim(F.substring_index(part, "}}", 1))
        return F.when(part.contains("}}"), F.concat(F.coalesce(F.try_element_at(captures, name), F.lit("")), F.substring(part, F.instr(part, "}}") + 2, F.length(part)))).otherwise(F.concat(F.lit("{{"), part))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), told), ""))


def scan(docs: DataFrame, rules: list[Rule] = RULES, options: Options = Options(), baseline: DataFrame | None = None, ranges: DataFrame | None = None, truncated: bool = False) -> Result:
    """docs: path, text (one row a path), and fallback where Latin-1 was fallen back to. ranges: path, lo, hi, to keep findings of changed lines alone."""
    bad = {r.id: p for r in rules if (p := problems(r))}
    if bad:
        raise ValueError(f"rules with problems: {bad}")
    spark = docs.sparkSession
    as_of = options.as_of or datetime.datetime.now(datetime.timezone.utc).date().isoformat()
    rules = [severity_of(r, options.severity_overrides) for r in rules]
    folders = classify.charts(docs) if any("helm" in t for r in rules for t in (r.tags_any, r.tags_none)) else frozenset()
    if folders is None:
        raise ValueError("over 10,000 charts: scan them in parts, or give their tags by classify_rules")
    how = match.Matching(options.allow_values, options.inject, options.wildcard, as_of, options.classify_rules, folders, options.skip_minified, INJECT_CHARS if options.inject else None, time.time() + options.seconds if options.seconds else None)
    # the one pass over texts; all that follows reads what was found
    events = materialize(match.events(docs, rules, how), "events")
    hits = events.where("hit IS NOT NULL").select("path", "hit.*")
    table = rules_table(spark, rules)
    exposure = F.lit("default") if options.inject else C.exposure(F.col("path"), F.col("tags"), options.exposure_globs)
    rank = C.confidence(F.col("rule_confidence"), F.col("delta"))
    # secrets in examples are most likely placeholders
    rank = F.when(F.array_contains("tags", "example") & (F.size("spans") > 0), F.lit(0)).otherwise(rank)
    scored = hits.drop("secrets").join(F.broadcast(table), "rule_id")  # the rules' table has a row a rule
    scored = scored.withColumns({"exposure": exposure, "confidence_rank": rank, "message": message(F.col("message"), F.col("captures"))})
    scored = scored.withColumn("score", C.score(F.col("base"), F.coalesce(F.try_element_at("props", F.lit("reachability")), F.lit("unknown")), F.col("exposure"), F.col("sensitive"))).withColumn("severity", C.band(F.col("score")))
    scored = scored.withColumn("confidence", F.element_at(F.array(*map(F.lit, C.CONFIDENCES)), F.col("confidence_rank") + 1))
    one = materialize(relational.without_overlap(relational.exact(scored)), "hits-scored")
    kept, lost = relational.winners(one.withColumnRenamed("confidence", "confidence_name").withColumn("confidence", F.col("confidence_rank")), table.select("rule_id", "generic", "supersedes"))
    kept = relational.related(kept, one, lost)
    found = materialize(relational.fingerprints(kept.drop("confidence").withColumnRenamed("confidence_name", "confidence")), "findings")
    if ranges is not None:
        found = relational.within_ranges(found, ranges, "path")
    marks = events.where("marker IS NOT NULL").select("path", "marker.*")
    if options.inject:
        found = found.withColumn("marker_line", F.lit(None).cast("int"))
    else:
        found = relational.suppress(found, marks)
        # text that is to be read by an agent does not silence findings about itself
        found = found.withColumn("marker_line", F.when(~(F.col("guarded") & F.col("kind").isin("doc", "agent-config")), F.col("marker_line")))
    if baseline is not None:
        found = relational.baseline_match(found, baseline, docs, F.lit(as_of).cast("date"))
    else:
        found = found.withColumn("baselined", F.lit(None).cast("string"))
    found = found.withColumn("suppressed", F.when(F.col("marker_line").isNotNull(), "inline").when(F.col("baselined").isNotNull(), "baseline"))
    gated = found.where(F.col("confidence_rank") >= C.CONFIDENCES.index(options.min_confidence))
    shown = gated.where(C.rank(F.col("severity"), C.SEVERITIES) >= C.SEVERITIES.index(options.min_severity))
    notes = events.where("note IS NOT NULL").select("path", "note.*")
    truncated = truncated or bool(options.seconds) and not notes.where("code = 'time-budget'").isEmpty()
    capped = notes.where("code = 'rule-capped'").select("path", "rule_id", F.col("n").alias("lost"))
    if baseline is not None:
        expired = baseline.where(F.col("expires") < F.lit(as_of).cast("date"))
        notes = notes.unionByName(expired.select("path", F.lit(None).cast("int").alias("line"), F.lit("baseline-expired").alias("code"), "rule_id", F.lit("info").alias("level"), F.concat(F.lit("the entry ran out on "), F.col("expires").cast("string")).alias("message"), F.lit(1).alias("n")))
    secrets = hits.select(F.explode("secrets").alias("secret"))
    return Result(shown, gated, found, marks, notes, capped, secrets, truncated)


def scan_text(spark: SparkSession, text: str | bytes, path: str = "<stdin>", inject: bool = False, rules: list[Rule] = RULES, options: Options = Options(), most: int = 16 << 20) -> Result:
    """One text, such as standard input; of more than `most` characters the rest is left out, and a diagnostic says so."""
    fallback = False
    if isinstance(text, bytes):
        from ..sources.readers import decode

        text, _, fallback, _ = decode(text)
    cut = not inject and len(text or "") > most
    docs = spark.createDataFrame([(path, (text or "")[:most] if cut else text, fallback)], "path string, text string, fallback boolean")
    out = scan(docs, rules, replace(options, inject=inject or options.inject), truncated=cut)
    if cut:
        note = spark.createDataFrame([(path, None, "input-truncated", None, "warning", f"only the first {most} characters are scanned", 1)], f"path string, {match.NOTE}")
        out.diagnostics = out.diagnostics.unionByName(note)
    return out


def sweep(findings: DataFrame, secrets: DataFrame) -> DataFrame:
    """findings with every secret (secret) of any document taken out of their snippets, longest first.

    Secrets meet snippets by an equi-join on the PIECE characters that they begin with, so neither side is sent to all tasks.
    """
    piece = 6
    values = secrets.select("secret").where(F.length("secret") >= piece)
    lines = F.transform(F.filter(F.split("secret", "\n"), lambda x: F.length(x) >= 16), lambda x: x)
    keys = values.where(F.col("secret").contains("-----BEGIN")).select(F.explode(lines).alias("secret")).where(~F.col("secret").startswith("-----"))
    values = values.unionByName(keys).distinct().select("secret", F.left("secret", F.lit(piece)).alias("piece"))
    at = F.sequence(F.lit(1), F.length("snippet") - piece + 1)
    pieces = F.array_distinct(F.transform(at, lambda i: F.substr(F.col("snippet"), i, F.lit(piece))))
    asked = findings.where(F.length("snippet") >= piece).select("fingerprint", "snippet", F.explode(pieces).alias("piece"))
    met = asked.join(values, "piece").where(F.col("snippet").contains(F.col("secret")))
    shown = met.groupBy("fingerprint").agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("secret").alias("n"), "secret")))).alias("shown"))
    swept = F.aggregate(F.coalesce("shown", F.array().cast(shown.schema["shown"].dataType)), F.col("snippet"), lambda acc, x: F.replace(acc, x["secret"], F.lit("…[SWEPT]")))
    return findings.join(shown, "fingerprint", "left").withColumn("snippet", swept).drop("shown")
