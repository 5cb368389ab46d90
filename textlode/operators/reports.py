"""Findings as JSON lines (distributed), and as JSON, SARIF, Markdown and text for readers, in report order."""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator
from typing import TextIO
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import Rule

FIELDS = ["rule_id", "severity", "score", "confidence", "exposure", "path", "line", "col", "end_line", "end_col", "message", "snippet", "fingerprint", "content_fingerprint", "suppressed", "related", "props"]


def ordered(findings: DataFrame) -> DataFrame:
    """Heaviest first, then by place; `/` sorts before every other character of a path."""
    return findings.orderBy((-F.round(F.col("score") * C.weight(F.col("confidence_rank")), 6)), F.replace("path", F.lit("/"), F.lit("\x00")), "line", "col", "rule_id")


def jsonl(findings: DataFrame) -> DataFrame:
    """One column, value, for df.write.text: a finding a row, however many there are."""
    return findings.select(F.to_json(F.struct(*FIELDS)).alias("value"))


def rows(findings: DataFrame, most: int | None = None) -> Iterator[dict]:
    """Findings in report order, read by partitions, so the driver holds one at a time."""
    out = ordered(findings).select(*FIELDS)
    return (r.asDict(recursive=True) for r in (out.limit(most) if most else out).toLocalIterator())


def notes(diagnostics: DataFrame | None) -> list[dict]:
    """Diagnostics by path, line, code and rule."""
    if diagnostics is None:
        return []
    order = [F.replace("path", F.lit("/"), F.lit("\x00")), F.coalesce("line", F.lit(0)), "code", F.coalesce("rule_id", F.lit(""))]
    return [r.asDict() for r in diagnostics.select("path", "line", "code", "rule_id", "level", "message").orderBy(*order).collect()]


def _dumps(x) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def write_json(out: TextIO, findings: DataFrame, stats: dict, diagnostics: DataFrame | None = None) -> None:
    """{diagnostics, findings, schema, stats}, keys in order, a finding a line."""
    out.write('{"diagnostics": ' + _dumps(notes(diagnostics)) + ',\n"findings": [')
    for i, r in enumerate(rows(findings)):
        out.write((",\n" if i else "\n") + _dumps(r))
    out.write('],\n"schema": "report/1",\n"stats": ' + _dumps(stats) + "}\n")


def to_json(findings: DataFrame, stats: dict, diagnostics: DataFrame | None = None) -> str:
    out = io.StringIO()
    write_json(out, findings, stats, diagnostics)
    return out.getvalue()


_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def pascal(title: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.findall(r"[A-Za-z0-9]+", title))


def write_sarif(out: TextIO, findings: DataFrame, rules: dict[str, str] | list[Rule], diagnostics: DataFrame | None = None) -> None:
    """SARIF 2.1.0. rules: as data, or titles by id. Results come one by one; before them, the rules in the order in which they come."""
    known = {r.id: r for r in rules} if isinstance(rules, list) else {}
    titles = {i: r.title for i, r in known.items()} if known else rules
    first = F.min(F.struct((-F.round(F.col("score") * C.weight(F.col("confidence_rank")), 6)).alias("w"), F.replace("path", F.lit("/"), F.lit("\x00")).alias("p"), "line", "col")).alias("at")
    ids = [r["rule_id"] for r in findings.groupBy("rule_id").agg(first).orderBy("at", "rule_id").select("rule_id").collect()]  # a row a rule

    def described(i: str) -> dict:
        entry: dict = {"id": i, "name": pascal(titles.get(i, i)), "shortDescription": {"text": titles.get(i, i)}}
        if i in known:
            r = known[i]
            entry |= {"defaultConfiguration": {"level": _LEVEL[r.severity]}, "properties": {"tags": list(r.tags), "pack": r.pack, "precision": r.confidence}}
            if r.fix:
                entry["help"] = {"text": r.fix}
            if r.references:
                entry["helpUri"] = r.references[0]
        return entry

    told = [{"level": n["level"] if n["level"] in ("error", "warning") else "note", "descriptor": {"id": n["code"]}, "message": {"text": n["message"]}, **({"locations": [{"physicalLocation": {"artifactLocation": {"uri": quote(n["path"], safe="/:")}}}]} if n["path"] else {})} for n in notes(diagnostics)]
    tool = {"driver": {"name": "textlode", "rules": [described(i) for i in ids]}}
    head = {"tool": tool, "columnKind": "unicodeCodePoints", "invocations": [{"executionSuccessful": True, "toolExecutionNotifications": told}]}
    out.write('{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [' + _dumps(head)[:-1] + ', "results": [')
    index = {i: n for n, i in enumerate(ids)}
    for k, r in enumerate(rows(findings)):
        region = {"startLine": r["line"], "startColumn": r["col"], "endLine": r["end_line"], "endColumn": r["end_col"]}
        place = lambda x: {"physicalLocation": {"artifactLocation": {"uri": quote(r["path"], safe="/:")}, "region": x}}  # noqa: B023, E731
        trace = (r["props"] or {}).get("lines")
        result = {
            "ruleId": r["rule_id"], "ruleIndex": index[r["rule_id"]], "level": _LEVEL[r["severity"]], "message": {"text": r["message"]}, "locations": [place(region)],
            "partialFingerprints": {"primary": r["fingerprint"]}, **({"suppressions": [{"kind": "external" if r["suppressed"] == "baseline" else "inSource"}]} if r["suppressed"] else {}),
            **({"codeFlows": [{"threadFlows": [{"locations": [{"location": place({"startLine": int(n)})} for n in trace.split(",")]}]}]} if trace else {}),
        }
        out.write((",\n" if k else "\n") + _dumps(result))
    out.write("]}]}\n")


def to_sarif(findings: DataFrame, rules: dict[str, str] | list[Rule], diagnostics: DataFrame | None = None) -> str:
    out = io.StringIO()
    write_sarif(out, findings, rules, diagnostics)
    return out.getvalue()


def _cell(x: str) -> str:
    """Text that Markdown shows as it is: no markup, links, mentions or cells of its own."""
    out = re.sub(r"\s+", " ", str(x)).replace("&", "&amp;")
    for c in "<>|@`*_[]()!~\\":
        out = out.replace(c, f"&#{ord(c)};")
    return re.sub(r"(?i)\b(https?|www)(?=[:.])", r"\1&#8203;", out)


def to_markdown(findings: DataFrame, most: int = 200) -> str:
    found = list(rows(findings.where("suppressed IS NULL"), most + 1))
    out = ["| Severity | Rule | Place | Message |", "|-|-|-|-|"]
    out += [f"| {r['severity']} | {r['rule_id']} | {_cell(r['path'])}:{r['line']} | {_cell(r['message'])} |" for r in found[:most]]
    for r in found[:most]:
        if r["severity"] in ("critical", "high"):
            fence = "```"
            while fence in r["snippet"]:
                fence += "`"
            out += ["", f"### {r['rule_id']} in {_cell(r['path'])}", "", fence, r["snippet"], fence]
    return "\n".join(out + (["", f"Only the first {most} are shown."] if len(found) > most else [])) + "\n"


def to_text(findings: DataFrame, most: int | None = None) -> str:
    out, n = [], 0
    for r in rows(findings.where("suppressed IS NULL"), most):
        n += 1
        out.append(f"{r['severity'].upper():8} {r['path']}:{r['line']}:{r['col']} {r['rule_id']} {r['message']}")
        out += [f"    {line}" for line in r["snippet"].split("\n")[:3]]
    return "\n".join([*out, f"{n} findings"]) + "\n"


FORMATS = ("text", "json", "jsonl", "sarif", "markdown")


def write(format: str, out: TextIO, result, rules: list[Rule]) -> None:
    """A scan's result in one of FORMATS."""
    if format == "json":
        write_json(out, result.findings, result.stats(), result.diagnostics)
    elif format == "jsonl":
        for r in rows(result.findings):
            out.write(_dumps(r) + "\n")
    elif format == "sarif":
        write_sarif(out, result.findings, rules, result.diagnostics)
    elif format == "markdown":
        out.write(to_markdown(result.findings))
    elif format == "text":
        out.write(to_text(result.findings))
    else:
        raise ValueError(f"no format {format}")


def write_all(result, rules: list[Rule], to: list[tuple[str, str | None]], stdout: TextIO) -> None:
    """A result in several formats: those with a path are written first, each in one step; at most one goes to stdout."""
    if sum(path is None for _, path in to) > 1:
        raise ValueError("only one format can go to standard output")
    for format, path in sorted(to, key=lambda x: x[1] is None):
        if path is None:
            write(format, stdout, result, rules)
        else:
            with open(path + ".new", "w", encoding="utf-8") as f:
                write(format, f, result, rules)
            os.replace(path + ".new", path)


BASELINE = "fingerprint string, content_fingerprint string, rule_id string, path string, line int, severity string, reason string, added_at date, expires date"


def write_baseline(entries: DataFrame, path: str) -> int:
    """A baseline as one JSON file, sorted, without snippets, replaced in one step; how many entries it has."""
    order = [F.replace("path", F.lit("/"), F.lit("\x00")), "rule_id", "fingerprint"]
    names, n = [c.split()[0] for c in BASELINE.split(", ")], 0
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write('{"schema": "baseline/1", "entries": [')
        for r in entries.select(*names).orderBy(*order).toLocalIterator():
            f.write((",\n" if n else "\n") + _dumps({k: str(v) if k in ("added_at", "expires") and v else v for k, v in r.asDict().items()}))
            n += 1
        f.write("]}\n")
    os.replace(path + ".new", path)
    return n


def read_baseline(spark, path: str) -> DataFrame:
    """A baseline file's entries; sizes and depth are bounded, dates that are none are an error."""
    import datetime

    from ..packs import parse_json

    with open(path, encoding="utf-8") as f:
        made = parse_json(f.read(), 64 << 20)
    if not isinstance(made, dict) or made.get("schema") != "baseline/1":
        raise ValueError(f"{path} is no baseline")
    names, day = [c.split()[0] for c in BASELINE.split(", ")], lambda x: datetime.date.fromisoformat(x) if x else None
    return spark.createDataFrame([tuple(day(e.get(k)) if k in ("added_at", "expires") else e.get(k) for k in names) for e in made["entries"]], BASELINE)
