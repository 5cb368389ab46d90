"""Rules against documents: texts cross to Python once, where keywords, classification, matchers and markers are done together."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CONFIDENCES, glob
from ..rules import Rule
from . import classify, kernels, structures, suppressions  # noqa: F401 - structures registers its matchers

HIT = (
    "rule_id string, ordinal int, start int, end int, line int, col int, end_line int, end_col int, delta int, rule_confidence int, captures map<string,string>, "
    "props map<string,string>, spans array<struct<s:int,e:int>>, secrets array<string>, norm string, snippet string, kind string, lang string, tags array<string>"
)
MARKER = "line int, scope string, first int, last int, ids array<string>, reason string, until string, ticket string, active boolean, problem string"
NOTE = "line int, code string, rule_id string, level string, message string, n int"
#: A row is one of three things found in a document: a hit of a rule, a suppression marker, or a note on how the scan went.
EVENTS = f"path string, hit struct<{HIT}>, marker struct<{MARKER}>, note struct<{NOTE}>"


@dataclass(frozen=True)
class Matching:
    """What matching hangs on besides rules and texts. inject: untrusted input, so kind doc, no markers, minified texts too."""

    allow_values: tuple[str, ...] = ()
    inject: bool = False
    wildcard: bool = False
    as_of: str | None = None  # of markers that run out; None: markers are not read
    classify: tuple = ()
    charts: frozenset = field(default_factory=frozenset)
    skip_minified: bool = True
    max_chars: int | None = None  # of an injected text: beyond it, its head and tail
    deadline: float | None = None  # seconds since 1970, when the time that a scan may take is over: texts not yet begun are left out, with a note each


def applies(rule: Rule, doc: kernels.Document, minified_too: bool = False) -> bool:
    """Whether a rule is tried on a document of that path, kind, language, tags and size."""
    path = lambda globs: any(kernels.compiled(glob(g)).match(doc.path) for g in globs)
    return (
        (not rule.kinds or doc.kind in rule.kinds)
        and (not rule.langs or doc.lang in rule.langs)
        and (not rule.tags_any or bool(doc.tags & set(rule.tags_any)))
        and not doc.tags & set(rule.tags_none)
        and (not rule.globs or not doc.path.startswith("<") and path(rule.globs))
        and not path(rule.exclude_globs)
        and (not rule.max_bytes or len(doc.text.encode("utf-8", "surrogatepass")) <= rule.max_bytes)
        and (minified_too or rule.include_minified or rule.pack.startswith("secrets") or "minified" not in doc.tags)
    )


def head_tail(text: str, most: int) -> str:
    """A text that is too long as its first half and its last, joined by a line feed."""
    return text if len(text) <= most else text[: most // 2] + "\n" + text[len(text) - (most - most // 2) :]


class Matcher:
    """Rules made ready for texts; one is made for each task."""

    def __init__(self, rules: list[Rule], how: Matching):
        self.rules, self.how, self.waker = rules, how, kernels.Waker(rules)

    def events(self, path: str, text: str, fallback: bool = False) -> Iterator[dict]:
        how = self.how
        if how.max_chars and len(text) > how.max_chars:
            yield _note(path, "input-truncated", f"only the head and tail of {len(text)} characters are scanned")
            text = head_tail(text, how.max_chars)
        if how.as_of and not how.inject and suppressions.WORD in text:
            for m in suppressions.parse(text, how.as_of, how.wildcard):
                yield {"path": path, "marker": m}
                if m["problem"]:
                    yield _note(path, "suppression-invalid", m["problem"], line=m["line"])
                elif not m["active"] and m["scope"] != "end":
                    yield _note(path, "suppression-expired", f"ran out on {m['until']}", "info", line=m["line"])
        awake = self.waker.of(text)
        if not awake:
            return
        lang, kind, tags = classify.classify(path or "", text, how.classify, how.charts)
        doc = kernels.Document(text, path or "", "doc" if how.inject else kind, lang, tags, fallback)
        tried = [r for r in (self.rules[i] for i in awake) if applies(r, doc, how.inject or not how.skip_minified)]
        found, capped, secrets = kernels.scan(doc, tried, how.allow_values)
        for rule_id, lost in capped.items():
            yield _note(path, "rule-capped", f"{lost} more hits of {rule_id} are not listed", rule_id=rule_id, n=lost)
        for i, (rule, h) in enumerate(found):
            line, col = doc.position(h.start)
            end_line, end_col = doc.position(max(h.start, h.end - 1))
            yield {
                "path": path,
                "hit": {
                    "rule_id": rule.id, "ordinal": i, "start": h.start, "end": h.end, "line": line, "col": col, "end_line": end_line, "end_col": end_col + 1,
                    "delta": h.delta, "rule_confidence": CONFIDENCES.index(rule.confidence), "captures": list(h.captures.items()), "props": list(h.props.items()),
                    "spans": [{"s": s, "e": e} for s, e in h.secrets], "secrets": [text[s:e] for s, e in h.secrets], "norm": kernels.masked(doc, line, end_line, secrets, True),
                    "snippet": kernels.reveal(kernels.masked(doc, line, end_line, secrets, False))[:240], "kind": doc.kind, "lang": lang, "tags": list(tags),
                },
            }


def _note(path: str, code: str, message: str, level: str = "warning", line: int | None = None, rule_id: str | None = None, n: int = 1) -> dict:
    return {"path": path, "note": {"line": line, "code": code, "rule_id": rule_id, "level": level, "message": message, "n": n}}


_TEXT = pa.map_(pa.string(), pa.string())
_INTS = ("ordinal", "start", "end", "line", "col", "end_line", "end_col", "delta", "rule_confidence")
_HIT = pa.struct(
    [("rule_id", pa.string()), *((c, pa.int32()) for c in _INTS), ("captures", _TEXT), ("props", _TEXT), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("secrets", pa.list_(pa.string()))]
    + [(c, pa.string()) for c in ("norm", "snippet", "kind", "lang")] + [("tags", pa.list_(pa.string()))]
)
_NOTE = pa.struct([("line", pa.int32()), ("code", pa.string()), ("rule_id", pa.string()), ("level", pa.string()), ("message", pa.string()), ("n", pa.int32())])
_EVENTS = pa.schema([("path", pa.string()), ("hit", _HIT), ("marker", pa.struct([f for f in suppressions.SCHEMA if f.name != "path"])), ("note", _NOTE)])


def runs(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about that many bytes of a column, so that few texts are held as Python strings at once."""
    sizes, a, total = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > a and total + size > most:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += size
    yield batch.slice(a)


def events(docs: DataFrame, rules: list[Rule], how: Matching = Matching()) -> DataFrame:
    """EVENTS of docs (path, text, and fallback, where there is such a column). Null texts count as empty."""

    def run(batches):
        matcher, out = Matcher(rules, how), []
        for batch in batches:
            for b in runs(batch, "text"):
                for path, text, fallback in zip(*(b.column(c).to_pylist() for c in ("path", "text", "fallback")), strict=True):
                    if text and how.deadline and time.time() > how.deadline:
                        out.append(_note(path, "time-budget", "not scanned: the time is over"))
                    elif text:
                        out += matcher.events(path, text, bool(fallback))
                    if len(out) > 2_000:
                        yield pa.RecordBatch.from_pylist(out, schema=_EVENTS)
                        out = []
        yield pa.RecordBatch.from_pylist(out, schema=_EVENTS)

    fallback = F.col("fallback") if "fallback" in docs.columns else F.lit(False)
    return docs.select("path", "text", fallback.alias("fallback")).mapInArrow(run, EVENTS)


def match(docs: DataFrame, rules: list[Rule], how: Matching = Matching()) -> DataFrame:
    """path and the fields of HIT of docs' hits."""
    return events(docs, rules, how).where("hit IS NOT NULL").select("path", "hit.*")


def awake(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, rule_id: the rules that each text wakes."""

    def run(batches):
        waker = kernels.Waker(rules)
        for batch in batches:
            for b in runs(batch, "text"):
                found = [(p, rules[i].id) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for i in waker.of(t or "")]
                yield pa.record_batch({"path": pa.array([f[0] for f in found], pa.string()), "rule_id": pa.array([f[1] for f in found], pa.string())})

    return docs.select("path", "text").mapInArrow(run, "path string, rule_id string")


def applicable(docs: DataFrame, rules: list[Rule], how: Matching = Matching()) -> DataFrame:
    """path, kind, rule_id: the rules that would be tried on each document, keywords aside."""

    def run(batches):
        for batch in batches:
            for b in runs(batch, "text"):
                found = []
                for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                    lang, kind, tags = classify.classify(path or "", text or "", how.classify, how.charts)
                    doc = kernels.Document(text or "", path or "", kind, lang, tags)
                    found += [(path, kind, r.id) for r in rules if applies(r, doc, not how.skip_minified)]
                yield pa.record_batch({c: pa.array([f[i] for f in found], pa.string()) for i, c in enumerate(("path", "kind", "rule_id"))})

    return docs.select("path", "text").mapInArrow(run, "path string, kind string, rule_id string")
