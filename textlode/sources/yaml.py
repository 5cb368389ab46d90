"""A reader of the YAML that rules and configuration files are written in: block and flow collections, all scalar styles, anchors, aliases,
merge keys, several documents. Tags are read over. Sizes are bounded, as rule files may come from anyone."""

from __future__ import annotations

import re
from typing import Any

MAX_CHARS, MAX_DEPTH, MAX_NODES, MAX_ALIASES = 2 << 20, 64, 200_000, 10_000


class YamlError(ValueError):
    def __init__(self, message: str, line: int):
        super().__init__(f"line {line}: {message}")
        self.line = line


_NULLS = {"", "~", "null", "Null", "NULL"}
_BOOLS = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_INT, _FLOAT = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?|[^#\s][^#]*?\S)?[ \t]*:(?=[ \t]|$)""")


def scalar(text: str) -> Any:
    """What a plain scalar means."""
    if text in _NULLS:
        return None
    if text in _BOOLS:
        return _BOOLS[text]
    if _INT.fullmatch(text):
        return int(text)
    if re.fullmatch("0x[0-9a-fA-F]+|0o[0-7]+", text):
        return int(text, 0)
    if _FLOAT.fullmatch(text):
        return float(text)
    if text.lower() in (".inf", "-.inf", "+.inf", ".nan"):
        return float(text.replace(".", ""))
    return text


class _Reader:
    def __init__(self, lines: list[str], first: int):
        self.lines, self.first, self.at, self.nodes, self.aliases = lines, first, 0, 0, 0
        self.anchors: dict[str, Any] = {}
        #: Of (id of a collection, key or index), the line; the collections live as long as the tree that holds them.
        self.places: dict[tuple[int, Any], int] = {}

    def fail(self, message: str) -> YamlError:
        return YamlError(message, self.first + self.at)

    def count(self, depth: int) -> None:
        self.nodes += 1
        if self.nodes > MAX_NODES or depth > MAX_DEPTH:
            raise self.fail("too many nodes" if self.nodes > MAX_NODES else "nested too deep")

    def skip(self) -> None:
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1

    def indent(self) -> int:
        line = self.lines[self.at]
        n = len(line) - len(line.lstrip(" "))
        if line[n : n + 1] == "\t":
            raise self.fail("a tab indents")
        return n

    def block(self, least: int, depth: int) -> Any:
        """The node of lines from here on that are indented by at least that much."""
        self.count(depth)
        self.skip()
        if self.at >= len(self.lines) or self.indent() < least:
            return None
        n = self.indent()
        text = self.lines[self.at][n:]
        if text == "-" or text.startswith("- "):
            return self.sequence(n, depth)
        if self.is_key(text):
            return self.mapping(n, depth)
        self.lines[self.at] = " " * n + text
        return self.value(text, n - 1, depth)

    @staticmethod
    def is_key(text: str) -> bool:
        return text.startswith("? ") or not text.startswith(("{", "[", "|", ">")) and bool(_KEY.match(re.sub(r"^(?:[&!]\S*[ \t]+)+", "", text)))

    def sequence(self, n: int, depth: int) -> list:
        out = []
        while True:
            self.skip()
            if self.at >= len(self.lines) or self.indent() != n or not (self.lines[self.at][n:] + " ").startswith("- "):
                if self.at < len(self.lines) and self.indent() > n:
                    raise self.fail("indented deeper than its sequence")
                return out
            rest = self.lines[self.at][n + 1 :]
            own = rest.lstrip(" ")
            self.places[id(out), len(out)] = self.first + self.at
            if not own or own.startswith("#"):
                self.at += 1
                out.append(self.block(n + 1, depth + 1))
            elif own == "-" or own.startswith("- ") or self.is_key(own):
                inner = n + 1 + len(rest) - len(own)
                self.lines[self.at] = " " * inner + own
                out.append(self.block(inner, depth + 1))
            else:
                out.append(self.value(own, n, depth + 1))

    def mapping(self, n: int, depth: int) -> dict:
        out: dict = {}
        merged: list[dict] = []
        while True:
            self.skip()
            if self.at >= len(self.lines) or self.indent() < n:
                break
            if self.indent() > n:
                raise self.fail("indented deeper than its mapping")
            text = self.lines[self.at][n:]
            if text == "-" or text.startswith("- "):
                break
            m = _KEY.match(text)
            if not m:
                raise self.fail("a key is expected")
            name = m[0].rstrip()[:-1].rstrip()
            key = self.quoted(name) if name[:1] in ("'", '"') else scalar(name)
            rest = text[m.end() :].strip()
            line = self.first + self.at
            if rest and not rest.startswith("#"):
                value = self.value(rest, n, depth + 1)
            else:
                self.at += 1
                self.skip()
                # a sequence may stand as deep as its key
                flat = self.at < len(self.lines) and self.indent() == n and (self.lines[self.at][n:] + " ").startswith("- ")
                value = self.sequence(n, depth + 1) if flat else self.block(n + 1, depth + 1)
            if key == "<<":
                merged += value if isinstance(value, list) else [value]
            elif isinstance(key, (dict, list)):
                raise self.fail("a key must be a scalar")
            elif key in out:
                raise self.fail(f"key {key!r} stands twice")
            else:
                out[key] = value
                self.places[id(out), key] = line
        for more in merged:
            if not isinstance(more, dict):
                raise self.fail("only mappings can be merged")
            for k, v in more.items():
                if k not in out:
                    out[k] = v
                    self.places.setdefault((id(out), k), self.places.get((id(more), k), self.first + self.at - 1))
        return out

    def value(self, text: str, n: int, depth: int) -> Any:
        """The node that starts with text, on the current line, inside a collection indented by n."""
        self.count(depth)
        if text.startswith("!"):
            rest = text.partition(" ")[2].strip()
            return self.value(rest, n, depth) if rest else self.below(n, depth)
        if text.startswith("&"):
            name, _, rest = text[1:].partition(" ")
            rest = rest.strip()
            out = self.value(rest, n, depth) if rest and not rest.startswith("#") else self.below(n, depth)
            self.anchors[name] = out
            return out
        if text.startswith("*"):
            name = text[1:].partition(" ")[0]
            self.aliases += 1
            if name not in self.anchors or self.aliases > MAX_ALIASES:
                raise self.fail(f"no anchor {name!r}" if name not in self.anchors else "too many aliases")
            self.at += 1
            return self.anchors[name]
        if text[0] in "|>":
            return self.literal(text, n)
        if text[0] in "[{\"'":
            return self.flow(text, n, depth)
        lines = [self.plain(text)]
        self.at += 1
        done = " #" in text
        while self.at < len(self.lines) and not done:
            line = self.lines[self.at]
            if line.strip() and (self.indent() <= n or line.lstrip().startswith("#")):
                break
            if line.strip() and self.is_key(line.strip()):
                raise self.fail("a key stands inside a plain scalar")
            lines.append(self.plain(line.strip()))
            self.at += 1
        return scalar(_folded(lines)) if len(lines) > 1 else scalar(lines[0])

    def below(self, n: int, depth: int) -> Any:
        self.at += 1
        return self.block(n + 1, depth + 1)

    @staticmethod
    def plain(text: str) -> str:
        return re.split(r"[ \t]+#", text, maxsplit=1)[0].strip()

    def literal(self, head: str, n: int) -> str:
        spec = head.split("#")[0].strip()
        chomp = "-" if "-" in spec else "+" if "+" in spec else ""
        digits = re.sub(r"\D", "", spec)
        self.at += 1
        lines, depth = [], max(n, 0) + int(digits) if digits else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                own = len(line) - len(line.lstrip(" "))
                if depth is None:
                    depth = own
                if own < depth or own <= n:
                    break
            lines.append(line[depth or 0 :] if line.strip() or len(line) > (depth or 0) else "")
            self.at += 1
        body = list(lines)
        while body and not body[-1].strip():
            body.pop()
        if spec[0] == "|":
            text = "\n".join(body)
        else:
            text = ""
            for i, line in enumerate(body):
                if i == 0:
                    text = line
                elif not line or not body[i - 1] or line[0] in " \t" or body[i - 1][0] in " \t":
                    text += "\n" + line if line or not body[i - 1] or (line[:1] or "x") in " \t" or body[i - 1][:1] in " \t" else ""
                else:
                    text += " " + line
        if chomp == "-":
            return text
        return text + "\n" * (len(lines) - len(body) + 1) if chomp == "+" and body else text + "\n" if body else ""

    def quoted(self, raw: str) -> str:
        if raw[0] == "'":
            return raw[1:-1].replace("''", "'")

        def escape(m: re.Match) -> str:
            c = m[1]
            if c[0] in "xuU":
                return chr(int(c[1:], 16))
            if c not in _ESCAPES:
                raise self.fail(f"no escape \\{c}")
            return _ESCAPES[c]

        return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", escape, raw[1:-1], flags=re.S)

    def flow(self, text: str, n: int, depth: int) -> Any:
        """A flow collection or quoted scalar, which may go over several lines."""
        start = self.at
        while True:
            try:
                value, end = self.flow_node(text, 0, depth)
                break
            except IndexError:
                self.at += 1
                if self.at >= len(self.lines):
                    self.at = start
                    raise self.fail("not closed") from None
                line = self.lines[self.at].strip()
                if text[0] in "[{":
                    text += "\n" + line
                else:
                    text += "\n" if not line else (" " if not text.endswith("\n") else "") + line
        rest = text[end:].strip()
        if rest and not rest.startswith("#"):
            raise self.fail(f"{rest[:20]!r} stands after a value")
        self.at += 1
        return value

    def flow_node(self, s: str, i: int, depth: int) -> tuple[Any, int]:
        self.count(depth)
        i = self.blank(s, i)
        c = s[i]
        if c in "\"'":
            m = re.compile(r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'(?!')", re.S).match(s, i)
            if not m:
                raise IndexError
            return self.quoted(m[0]), m.end()
        if c in "[{":
            out: Any = [] if c == "[" else {}
            line = self.first + self.at
            i = self.blank(s, i + 1)
            while s[i] != ("]" if c == "[" else "}"):
                key, i = self.flow_node(s, i, depth + 1)
                i = self.blank(s, i)
                if s[i] == ":":
                    value, i = (None, self.blank(s, i + 1)) if s[self.blank(s, i + 1)] in ",}]" else self.flow_node(s, i + 1, depth + 1)
                    i = self.blank(s, i)
                    if c == "[":
                        out.append({key: value})
                    else:
                        out[key] = value
                elif c == "[":
                    out.append(key)
                else:
                    out[key] = None
                self.places[id(out), len(out) - 1 if c == "[" else key] = line
                if s[i] == ",":
                    i = self.blank(s, i + 1)
                elif s[i] not in "]}":
                    raise self.fail("a comma is expected")
            if c == "{" and "<<" in out:
                more = out.pop("<<")
                for one in more if isinstance(more, list) else [more]:
                    for k, v in one.items() if isinstance(one, dict) else ():
                        if k not in out:
                            out[k] = v
                            self.places[id(out), k] = line
            return out, i + 1
        if c in "]},":
            raise self.fail(f"{c!r} is not expected")
        j = i
        while not (s[j] in ",[]{}" or s[j] == ":" and (s[j + 1] in " ,]}\n") or s[j] == "#" and s[j - 1] in " \n"):
            j += 1
        word = " ".join(s[i:j].split())
        if word.startswith("*"):
            if word[1:] not in self.anchors:
                raise self.fail(f"no anchor {word[1:]!r}")
            return self.anchors[word[1:]], j
        return scalar(word), j

    @staticmethod
    def blank(s: str, i: int) -> int:
        while s[i] in " \t\n" or s[i] == "#" and s[i - 1] in " \t\n":
            if s[i] == "#":
                while s[i] != "\n":
                    i += 1
            i += 1
        return i


def _folded(lines: list[str]) -> str:
    out = lines[0]
    for i, line in enumerate(lines[1:], 1):
        out += line if not lines[i - 1] and out.endswith("\n") else "\n" if not line else " " + line
    return out.strip()


def load_all(text: str) -> list[Any]:
    """The documents of a text."""
    return [tree for tree, _ in load_placed(text)]


def load_placed(text: str) -> list[tuple[Any, dict]]:
    """The documents of a text, and of each the lines of its keys and items: by (id of the collection, key or index)."""
    if len(text) > MAX_CHARS:
        raise YamlError(f"over {MAX_CHARS} characters", 1)
    out, lines, first = [], [], 1
    every = text.lstrip("\ufeff").replace("\r\n", "\n").split("\n")

    def end() -> None:
        if any(x.strip() and not x.lstrip().startswith("#") for x in lines):
            r = _Reader(list(lines), first)
            out.append((r.block(0, 0), r.places))
            r.skip()
            if r.at < len(r.lines):
                raise r.fail("what stands here belongs to nothing")

    for n, line in enumerate(every, 1):
        if line.startswith("%") and not lines:
            continue
        if line == "---" or line.startswith("--- ") or line == "...":
            end()
            rest = line[4:].strip()
            lines, first = ([rest] if rest and not rest.startswith("#") else []), n + (not rest)
        else:
            lines.append(line)
    end()
    return out


def load(text: str) -> Any:
    found = load_all(text)
    if len(found) > 1:
        raise YamlError("more than one document", 1)
    return found[0] if found else None
