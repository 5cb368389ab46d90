"""Other views of a text: normalised for phrases, what pages hide from readers, what is encoded. A view maps its places back to the text's."""

from __future__ import annotations

import base64
import binascii
import codecs
import html
import quopri
import re
import unicodedata
import urllib.parse
from bisect import bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.columns import CONFUSABLE, HIDDEN


@dataclass
class View:
    """text, and its pieces: where each starts, the span of the raw text that it comes from, whether it is unchanged, and what was done."""

    text: str
    starts: list[int] = field(default_factory=list)
    raw: list[tuple[int, int]] = field(default_factory=list)
    same: list[bool] = field(default_factory=list)
    marks: list[frozenset] = field(default_factory=list)
    #: Where, in the raw text, something was taken out, and as what.
    gaps: list[tuple[int, str]] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> View:
        return cls(text, [0], [(0, len(text))], [True], [frozenset()])

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The raw span of [a, b): from the first contributing character to the last."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, max(a, b - 1)) - 1
        lo = self.raw[i][0] + (a - self.starts[i] if self.same[i] else 0)
        hi = self.raw[j][0] + (b - self.starts[j]) if self.same[j] else self.raw[j][1]
        return lo, max(lo, hi)

    def marked(self, a: int, b: int) -> set[str]:
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, max(a, b - 1)) - 1
        lo, hi = self.span(a, b)
        return (set().union(*self.marks[i : j + 1]) | {mark for at, mark in self.gaps if lo <= at < hi}) - {"WRAP"}

    def done(self) -> list[str]:
        """All that was done anywhere."""
        return sorted(set().union(*self.marks) | {mark for _, mark in self.gaps})

    def replaced(self, edits: list[tuple[int, int, str, str]]) -> View:
        """With [a, b) put in place of, in order, each by a text, with a mark."""
        if not edits:
            return self
        out, at, pieces = View("", gaps=list(self.gaps)), 0, []

        def keep(a: int, b: int) -> None:
            i = bisect_right(self.starts, a) - 1
            while a < b:
                end = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                lo = self.raw[i][0] + (a - self.starts[i]) if self.same[i] else self.raw[i][0]
                add(self.text[a:end], (lo, lo + end - a) if self.same[i] else self.raw[i], self.same[i], self.marks[i])
                a, i = end, i + 1

        def add(text: str, raw: tuple[int, int], same: bool, marks: frozenset) -> None:
            nonlocal length
            if text:
                out.starts.append(length)
                out.raw.append(raw)
                out.same.append(same)
                out.marks.append(marks)
                pieces.append(text)
                length += len(text)

        length = 0
        for a, b, text, mark in edits:
            keep(at, a)
            if text:
                add(text, self.span(a, b), False, frozenset(self.marked(a, b) | {mark}))
            else:
                out.gaps.append((self.span(a, b)[0], mark))
            at = b
        keep(at, len(self.text))
        out.text = "".join(pieces)
        if not out.starts:
            return View("", [0], [(0, 0)], [True], [frozenset()], out.gaps)
        return out


_INVISIBLE = re.compile("[" + "".join(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08X" % int(m[1], 16), HIDDEN[k]) for k in ("ZW", "BIDI", "TAG", "VS", "CTRL")) + "\u115f\u1160\u2800\u3164\uffa0]")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_EMPHASIS = re.compile(r"(?<=[^\W\d_])(?:\*{1,3}|~~|`)(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_]([ .*_~`-])(?:[^\W\d_]\1){2,31}[^\W\d_](?![^\W\d_])")
_WRAPPED = re.compile(r"(?<=\S)[ \t]{0,64}\n[ \t]{0,64}(?=\S)|[ \t]{2,64}")
_FOLD = dict(zip(*CONFUSABLE, strict=True))
_HTML = re.compile(r"(?i)<(?:!doctype|html|head|body|div|span|p|table|style|meta)\b")


def norm(raw: str, kind: str = "doc") -> View:
    """Entities, invisible characters, compatibility forms and look-alikes, marks, emphasis, spaced letters and wrapped lines undone."""
    view = View.of(raw)

    def sub(rx: re.Pattern, put, mark: str) -> None:
        nonlocal view
        view = view.replaced([(m.start(), m.end(), put(m), mark) for m in rx.finditer(view.text) if put(m) != m[0]])

    if "&" in raw and (kind in ("doc", "agent-config") or _HTML.search(raw[:4096])):
        sub(_ENTITY, lambda m: html.unescape(m[0]), "ENTITY")
    if not view.text.isascii():
        sub(_INVISIBLE, lambda m: "", "INVIS")
        beyond = re.compile("[^\x00-\x7f]")
        sub(beyond, lambda m: unicodedata.normalize("NFKC", m[0]), "NFKC")
        sub(beyond, lambda m: _FOLD.get(m[0], m[0]), "CONF")
        sub(beyond, lambda m: "".join(c for c in unicodedata.normalize("NFD", m[0]) if unicodedata.category(c) != "Mn"), "MARK")
    elif any(ord(c) < 32 and c not in "\t\n\r\f" or c == "\x7f" for c in set(view.text)):
        sub(_INVISIBLE, lambda m: "", "INVIS")
    sub(_EMPHASIS, lambda m: "", "EMPH")
    sub(_SPACED, lambda m: m[0].replace(m[1], ""), "SPACE")
    sub(_WRAPPED, lambda m: " ", "WRAP")
    return view


@dataclass
class Segment:
    channel: str
    reason: str
    text: str
    start: int
    end: int


_ZERO = r"0*\.?0{0,4}(?:px|pt|em|rem|%)?"
_HIDING = {
    "display-none": "display:none", "visibility": "visibility:(?:hidden|collapse)", "opacity-0": rf"opacity:{_ZERO}$", "font-size-0": rf"font-size:(?:{_ZERO}|0?\.[0-4][0-9]*r?em|[01](?:\.[0-9]+)?p[xt])$",
    "no-size": "(?:max-)?(?:height|width):0(?:px)?$", "clipped": r"clip:rect\(0|clip-path:inset\((?:50|100)%", "offscreen": r"text-indent:-[0-9]{3,}|(?:left|top|right):-[0-9]{3,}",
    "scaled": r"transform:scale\(0", "mso-hide": "mso-hide:all", "transparent": "color:transparent$",
}
_HIDING_RX = {k: re.compile(v) for k, v in _HIDING.items()}
_A11Y = {"sr-only", "visually-hidden", "visuallyhidden", "screen-reader-text", "screen-reader-only", "a11y-hidden", "hidden-visually", "u-hidden-visually", "assistive-text", "skip-link"}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_WHITE = {"#fff", "#ffffff", "white", "rgb(255,255,255)"}
_MD_COMMENT = re.compile(r"""(?m)^[ \t]{0,3}\[(?://|comment|_|#)\]:[ \t]{0,4}(?:#|<>)[ \t]{0,4}(?:\(([^)\n]{0,2000})\)|"([^"\n]{0,2000})")""")


def _declared(style: str) -> dict[str, str]:
    out = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        if value:
            out[name.strip()] = re.sub(r"\s+", "", value.replace("!important", ""))
    return out


def hides(style: dict[str, str]) -> str | None:
    for name, value in style.items():
        for reason, rx in _HIDING_RX.items():
            if rx.match(f"{name}:{value}"):
                return "css:" + reason
    return None


class _Splitter(HTMLParser):
    """Walks a page with a stack of (tag, why it is hidden, colours)."""

    def __init__(self, text: str, rules: list[tuple[str, dict[str, str]]]):
        super().__init__(convert_charrefs=True)
        self.rules, self.stack, self.found, self.lines = rules, [], [], [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())
        self.feed(text)
        self.close()

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def add(self, channel: str, reason: str, text: str, length: int | None = None) -> None:
        if text.strip():
            self.found.append(Segment(channel, reason, text, self.at(), self.at() + (len(text) if length is None else length)))

    def handle_starttag(self, tag, attributes):
        given = {k: v or "" for k, v in attributes}
        classes = set(given.get("class", "").split())
        style: dict[str, str] = {}
        for selector, declared in self.rules:
            name, _, cls = selector.partition(".")
            if selector.startswith("#") and given.get("id") == selector[1:] or not selector.startswith("#") and (not name or name == tag) and (not cls or cls in classes) and (name or cls):
                style |= declared
        style |= _declared(given.get("style", ""))
        why = hides(style) or ("attr:hidden" if "hidden" in given else None) or ("template" if tag == "template" else None)
        channel = "hidden:css" if why else "hidden:a11y" if classes & _A11Y else None
        ground = style.get("background-color") or style.get("background") or (self.stack[-1][3] if self.stack else None)
        colour = style.get("color")
        if not channel and colour and (colour == ground or ground is None and colour in _WHITE):
            channel, why = "hidden:css", "css:low-contrast"
        length = len(self.get_starttag_text() or "")
        for name in ("alt", "title", "aria-label", "aria-description", "placeholder"):
            self.add("hidden:attr", f"attr:{name}", given.get(name, ""), length)
        for name, value in given.items():
            if name.startswith("data-") and len(value) >= 20:
                self.add("hidden:attr", f"attr:{name}", value, length)
        if tag == "input" and given.get("type") == "hidden":
            self.add("hidden:css", "attr:hidden", given.get("value", ""), length)
        told = given.get("name") or given.get("property") or ""
        if tag == "meta" and told.lower() in ("description", "keywords", "og:description", "twitter:description"):
            self.add("hidden:meta", f"meta:{told.lower()}", given.get("content", ""), length)
        if tag not in _VOID and len(self.stack) < 256:
            outer = self.stack[-1] if self.stack else (None, None, None, None)
            self.stack.append((tag, channel or outer[1], (why or "a11y") if channel else outer[2], ground))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in _VOID and self.stack:
            self.stack.pop()

    def handle_endtag(self, tag):
        for k in range(1, min(64, len(self.stack)) + 1):
            if self.stack[-k][0] == tag:
                del self.stack[-k:]
                return

    def handle_data(self, data):
        top = self.stack[-1] if self.stack else (None, None, None, None)
        if top[0] not in ("script", "style"):
            self.add(top[1] or "visible", top[2] or "", data)

    def handle_comment(self, data):
        self.add("hidden:comment", "comment", data, len(data) + 7)


def split_html(text: str) -> list[Segment]:
    """What a page shows and what it hides, each element, comment and attribute on its own."""
    rules = []
    for block in re.findall(r"(?is)<style\b[^>]*>(.*?)</style", text):
        for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", block):
            rules += [(s.strip().lower() if not s.strip().startswith(("#", ".")) else s.strip(), _declared(body)) for s in selectors.split(",") if re.fullmatch(r"[#.\w-]+", s.strip())]
    return _Splitter(text, rules[:5000]).found


def segments(text: str, lang: str = "html") -> list[Segment]:
    """The segments of a page or of Markdown; other texts are visible as they are."""
    if lang in ("html", "xml") or _HTML.search(text[:4096]) or "<!--" in text:
        out = split_html(text)
    else:
        out = [Segment("visible", "", text, 0, len(text))] if text.strip() else []
    return out + [Segment("hidden:comment", "comment", m[1] or m[2] or "", m.start(), m.end()) for m in _MD_COMMENT.finditer(text)]


@dataclass
class Decoded:
    chain: tuple[str, ...]
    text: str
    start: int
    end: int


def _readable(raw: bytes, least: float = 0.85) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in "\n\t\r" for c in text)
    return text if len(text) >= 12 and good >= least * len(text) and (" " in text or sum(c.isalpha() for c in text) >= 8) else None


def _base64url(m: re.Match) -> bytes | None:
    s = m[0]
    mixed = any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s)
    return base64.urlsafe_b64decode(s + "=" * (-len(s) % 4)) if "-" in s or "_" in s or mixed else None


_LAYERS = [
    ("base64", r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/]{4}){6,16384}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?(?![A-Za-z0-9+/=_-])", lambda m: base64.b64decode(m[0], validate=True)),
    ("base64url", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,65536}(?![A-Za-z0-9_=-])", _base64url),
    ("hex", r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,32768}(?![0-9A-Fa-f])", lambda m: bytes.fromhex(m[0])),
    ("hex-escapes", r"(?:\\x[0-9A-Fa-f]{2}){8,16384}", lambda m: bytes.fromhex(m[0].replace("\\x", ""))),
    ("percent", r"(?:%[0-9A-Fa-f]{2}){6,16384}[^\s%]{0,4096}(?:%[0-9A-Fa-f]{2}[^\s%]{0,4096}){0,4096}", lambda m: urllib.parse.unquote_to_bytes(m[0])),
    ("unicode-escapes", r"(?:\\u[0-9A-Fa-f]{4}){4,8192}", lambda m: codecs.decode(m[0], "unicode_escape").encode("utf-8", "replace")),
    ("quoted-printable", r"(?:=[0-9A-F]{2}){6,16384}", lambda m: quopri.decodestring(m[0])),
]
_LAYERS = [(name, re.compile(rx), f) for name, rx, f in _LAYERS]
_ROT13 = re.compile(r"(?i)\brot-?13\b")
_BINARY = re.compile("[\u200b\u200c\u200d\u2060\ufeff]{16,}")
BLOBS, DEPTH = 64, 2


def _invisible(text: str) -> list[tuple[str, str, int, int]]:
    out = []
    for m in re.finditer("[\U000e0020-\U000e007e]{2,}", text):
        out.append(("tag", "".join(chr(ord(c) - 0xE0000) for c in m[0]), *m.span()))
    for m in re.finditer("[\ufe00-\ufe0f\U000e0100-\U000e01ef]{2,}", text):
        told = _readable(bytes(ord(c) - (0xFE00 if ord(c) < 0xE0000 else 0xE0100 - 16) for c in m[0]), 0.9)
        if told:
            out.append(("selectors", told, *m.span()))
    for m in _BINARY.finditer(text):
        symbols = sorted(set(m[0]), key=lambda c: (-m[0].count(c), c))[:2]
        if len(symbols) == 2:
            bits = [c for c in m[0] if c in symbols]
            for zero in symbols:
                n = len(bits) // 8
                raw = bytes(int("".join("0" if c == zero else "1" for c in bits[8 * i : 8 * i + 8]), 2) for i in range(n))
                if n and all(32 <= x < 127 or x in (9, 10, 13) for x in raw):
                    out.append(("zero-width", raw.decode(), *m.span()))
                    break
    return out


def decode(text: str) -> list[Decoded]:
    """Texts that are encoded in this one, once or twice over; spans are those of the outermost blob."""
    out: list[Decoded] = []

    def look(within: str, chain: tuple[str, ...], at: tuple[int, int] | None) -> None:
        found = []
        for name, rx, f in _LAYERS:
            for m in rx.finditer(within):
                try:
                    raw = f(m)
                except (ValueError, binascii.Error):
                    continue
                if raw and (told := _readable(raw)) and told != m[0]:
                    found.append((name, told, *m.span()))
        for m in _ROT13.finditer(within):
            found.append(("rot13", codecs.decode(within[m.end() : m.end() + 2048], "rot13"), m.end(), min(len(within), m.end() + 2048)))
        for name, told, a, b in sorted(found + _invisible(within), key=lambda x: (x[2], x[0])):
            if len(out) >= BLOBS:
                return
            span = at or (a, b)
            if any(d.text == told and (d.start, d.end) == span for d in out):
                continue
            out.append(Decoded((*chain, name), told, *span))
            if len(chain) + 1 < DEPTH and name != "rot13":
                look(told, (*chain, name), span)

    look(text, (), None)
    return out


def _table(docs: DataFrame, rows, shape: str, schema: pa.Schema) -> DataFrame:
    def run(batches):
        from .match import runs

        for batch in batches:
            for b in runs(batch, "text"):
                found = [{"path": p, **r} for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for r in rows(t or "")]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return docs.select("path", "text").mapInArrow(run, shape)


def normalized(docs: DataFrame, kind: str = "doc") -> DataFrame:
    """path, text (normalised), marks (what was done anywhere) of docs (path, text)."""

    def rows(text):
        view = norm(text, kind)
        yield {"text": view.text, "marks": view.done()}

    return _table(docs, rows, "path string, text string, marks array<string>", pa.schema([("path", pa.string()), ("text", pa.string()), ("marks", pa.list_(pa.string()))]))


def hidden(docs: DataFrame) -> DataFrame:
    """path, channel, reason, text, start, end of what pages (path, text) show and hide."""
    schema = pa.schema([("path", pa.string()), ("channel", pa.string()), ("reason", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return _table(docs, lambda t: (vars(s) for s in segments(t)), "path string, channel string, reason string, text string, start int, end int", schema)


def decoded(docs: DataFrame) -> DataFrame:
    """path, chain, text, start, end of what is encoded in docs (path, text)."""
    schema = pa.schema([("path", pa.string()), ("chain", pa.list_(pa.string())), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return _table(docs, lambda t: (vars(d) | {"chain": list(d.chain)} for d in decode(t)), "path string, chain array<string>, text string, start int, end int", schema)
