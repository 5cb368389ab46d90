"""Suppression markers in texts: `# textlode:ignore[-next-line|-file|-start|-end][RULE, ...] reason="..." until=DATE ticket=ID`."""

from __future__ import annotations

import datetime
import re

import pyarrow as pa
from pyspark.sql import DataFrame

MARKERS = "path string, line int, scope string, first int, last int, ids array<string>, reason string, until string, ticket string, active boolean, problem string"
_MARK = re.compile(r"(?:#|//|--|/\*|<!--|;)[ \t]*textlode:ignore(-next-line|-file|-start|-end)?(?:\[([\w*, -]{1,200})\])?([^\n]{0,400})")
_PAIR = re.compile(r'\b(reason|until|ticket)=(?:"((?:[^"\\]|\\.)*)"|(\S+))')
WORD, BLOCK, FILE_WINDOW, REASON = "textlode:ignore", 200, 20, 10


def parse(text: str, as_of: str, wildcard: bool = False) -> list[dict]:
    """The markers of a text, with the lines they cover. One that is not valid covers nothing and says why; one that has expired is inactive."""
    lines, out, opened = text.split("\n"), [], []

    def following(n: int) -> int:
        return next((k for k in range(n + 1, len(lines) + 1) if lines[k - 1].strip()), len(lines) + 1)

    for n, line in enumerate(lines, 1):
        for m in _MARK.finditer(line):
            scope = (m[1] or "-line")[1:]
            ids = [i.strip() for i in (m[2] or "*").split(",") if i.strip()]
            pairs = {k: (q or v or "").replace('\\"', '"') for k, q, v in reversed(_PAIR.findall(m[3]))}
            row = {"line": n, "scope": scope, "first": n, "last": n, "ids": ids, "reason": pairs.get("reason"), "until": pairs.get("until"), "ticket": pairs.get("ticket"), "active": True, "problem": None}
            if scope == "end":
                if opened:
                    opened.pop()["last"] = n
                else:
                    out.append(row | {"active": False, "problem": "no start before this end"})
                continue
            if len((row["reason"] or "").strip()) < REASON:
                row["problem"] = f"a reason of {REASON} characters is needed"
            elif "*" in ids and not wildcard:
                row["problem"] = "rules are not named"
            elif scope == "file" and n > FILE_WINDOW:
                row["problem"] = f"not in the first {FILE_WINDOW} lines"
            if row["until"] and not row["problem"]:
                try:
                    if datetime.date.fromisoformat(row["until"]) < datetime.date.fromisoformat(as_of):
                        row["active"] = False
                except ValueError:
                    row["problem"] = "until is not a date"
            if row["problem"]:
                row["active"] = False
            elif scope == "file":
                row["first"], row["last"] = 1, len(lines)
            elif scope == "start":
                row["last"] = min(n + BLOCK, len(lines))
                opened.append(row)
            elif scope == "next-line" or not line[: m.start()].strip():
                row["first"] = row["last"] = following(n)
            out.append(row)
    return out


def markers(docs: DataFrame, as_of: str, wildcard: bool = False) -> DataFrame:
    """MARKERS of docs (path, text). Documents without the word never reach Python. (A scan reads markers as it matches rules.)"""

    def run(batches):
        for b in batches:
            rows = [{"path": p, **m} for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for m in parse(t, as_of, wildcard)]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return docs.where(docs["text"].contains(WORD)).select("path", "text").mapInArrow(run, MARKERS)


SCHEMA = pa.schema([("path", pa.string()), ("line", pa.int32()), ("scope", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("ids", pa.list_(pa.string())), ("reason", pa.string()), ("until", pa.string()), ("ticket", pa.string()), ("active", pa.bool_()), ("problem", pa.string())])
