"""Matchers of structured texts: paths in YAML and JSON, calls and routes in Python, blocks in HCL. A text that does not parse has no hits."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import Any

from ..sources.yaml import YamlError, load_placed
from .kernels import Document, Hit, register

# ---- paths

_STEP = re.compile(r'\.?(?:(?P<deep>\*\*)|(?P<star>\*)|"(?P<quoted>(?:[^"\\]|\\.)*)"|\{(?P<either>[^{}]+)\}|(?P<name>[^.\[\]{}"*\s]+))|\[(?P<index>-?[0-9]+|\*)\]')


@lru_cache(2048)
def steps(path: str) -> tuple[tuple[str, Any], ...]:
    out, at = [], 0
    path = path.removeprefix("$.")
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or m.end() == at or len(path) > 512:
            raise ValueError(f"{path!r} is no path")
        kind = m.lastgroup
        out.append({"deep": ("deep", None), "star": ("star", None)}.get(kind) or (("index", None if m[kind] == "*" else int(m[kind])) if kind == "index" else ("keys", [x.strip() for x in m[kind].split(",")] if kind == "either" else [m[kind]])))
        at = m.end()
    return tuple(out)


@dataclass(eq=False)
class Node:
    value: Any
    line: int
    deep: bool = False

    def children(self, places: dict) -> list[tuple[Any, Node]]:
        v = self.value
        pairs = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        return [(k, Node(x, places.get((id(v), k), self.line))) for k, x in pairs]


def _name(key: Any) -> str:
    return {True: "on", False: "off", None: "null"}.get(key, str(key)) if key is None or isinstance(key, bool) else str(key)


def resolve(start: Node, path: str, places: dict, promote: bool = True) -> list[Node]:
    """The nodes at a path. A scalar, or an item of a sequence, stands for a key of its name: `on: push` has on.push."""
    nodes = [start]
    for kind, what in steps(path):
        out: list[Node] = []
        for n in nodes:
            below = n.children(places)
            if kind == "keys":
                if isinstance(n.value, dict):
                    out += [c for k, c in below if _name(k) in what or str(k) in what]
                elif promote and isinstance(n.value, list):
                    out += [Node(None, c.line) for _, c in below if not isinstance(c.value, (dict, list)) and str(c.value) in what]
                elif promote and n.value is not None and str(n.value) in what:
                    out.append(Node(None, n.line))
            elif kind == "star":
                out += [c for _, c in below]
                promote = False
            elif kind == "index" and isinstance(n.value, list):
                some = [c for _, c in below]
                out += some if what is None else some[what : what + 1 or None]
                promote = False
            elif kind == "deep":
                todo = [n]
                while todo:
                    one = todo.pop()
                    out.append(one)
                    todo += [c for _, c in reversed(one.children(places))]
                promote = False
        nodes = out
    return nodes


_TYPES = {"string": str, "bool": bool, "int": int, "float": float, "seq": list, "map": dict, "null": type(None)}


def holds(value: Any, spec: dict) -> bool:
    """Whether a value meets every predicate that is given."""
    tests = {
        "equals": lambda w: value == w and isinstance(value, bool) == isinstance(w, bool),
        "not_equals": lambda w: value != w,
        "in": lambda w: value in w,
        "not_in": lambda w: value not in w,
        "regex": lambda w: not isinstance(value, (dict, list)) and value is not None and re.search(w, str(value)) is not None,
        "not_regex": lambda w: not isinstance(value, (dict, list)) and value is not None and re.search(w, str(value)) is None,
        "type": lambda w: type(value) is _TYPES[w],
        "contains": lambda w: isinstance(value, list) and w in value,
    }
    return all(tests[k](w) for k, w in spec.items() if k in tests)


_VALUE = {"equals", "not_equals", "in", "not_in", "regex", "not_regex", "type", "contains"}


def condition(anchor: Node, root: Node, spec: dict, places: dict) -> tuple[bool, list[Node]]:
    """Whether a condition holds at the anchor, and the nodes that meet it. A path that is not there makes every test of a value false."""
    nodes = resolve(root if spec["path"].startswith("$.") else anchor, spec["path"], places, spec.get("promote", True))
    if "exists" in spec:
        return bool(nodes) == spec["exists"], nodes
    good = [n for n in nodes if holds(n.value, spec)]
    return (bool(nodes) and len(good) == len(nodes)) if spec.get("quantifier") == "all" else bool(good), good


def _line_hit(doc: Document, line: int) -> Hit | None:
    text = doc.line_text(line) if 1 <= line <= len(doc.starts) else ""
    if not text.strip():
        return None
    a = doc.starts[line - 1] + len(text) - len(text.lstrip())
    return Hit(a, doc.starts[line - 1] + len(text.rstrip()))


@register("yaml_path")
def yaml_path(doc: Document, spec: dict, rule) -> list[Hit]:
    """Per document, and per node at `each`: all conditions of `all`, one of `any`, none of `none`. Hits are the lines of what met the first condition."""
    if doc.lang not in ("yaml", "json"):
        return []
    try:
        trees = load_placed(doc.text)
    except (YamlError, RecursionError):
        return []
    lines: list[int] = []
    for tree, places in trees:
        root = Node(tree, 1)
        for anchor in resolve(root, spec["each"], places) if spec.get("each") else [root]:
            got = [condition(anchor, root, c, places) for c in spec.get("all", ())]
            some = [condition(anchor, root, c, places) for c in spec.get("any", ())]
            if not all(ok for ok, _ in got) or some and not any(ok for ok, _ in some) or any(condition(anchor, root, c, places)[0] for c in spec.get("none", ())):
                continue
            tests = list(zip(spec.get("all", []), got, strict=True)) + [x for x in zip(spec.get("any", []), some, strict=True) if x[1][0]]
            first = next((n for c, (_, n) in tests if n and _VALUE & c.keys()), None) or next((n for c, (_, n) in tests if n and c.get("exists")), None) or [anchor]
            lines += [n.line for n in first]
    return [h for line in dict.fromkeys(lines) if (h := _line_hit(doc, line))]


# ---- Python

_SAFE = {"int", "float", "bool", "uuid.UUID", "shlex.quote", "html.escape", "markupsafe.escape", "re.escape", "ipaddress.ip_address", "urllib.parse.quote", "os.path.basename"}
_PLAIN = {"int", "float", "bool", "UUID", "date", "datetime", "Decimal"}
SOURCES = {
    "web": r"(?:flask\.)?request\.(?:query_params|path_params|headers|cookies|form|json|body|url|args|values|data|files|get_json)\b.*",
    "airflow": r"(?:.*\.)?(?:dag_run\.conf|params|xcom_pull)\b.*", "cli": r"sys\.argv|input|.*\.parse_args\b.*", "net": r"(?:requests|httpx)\..*|(?:urllib\.request\.)?urlopen",
    "llm": r".*\.(?:invoke|ainvoke|converse|invoke_model|generate|generate_content|predict|complete|chat)", "msg": r".*\.poll|(?:msg|record)\.value|message\.data",
    "file": r"open|.*\.read_text|json\.load", "env": r"os\.environ.*|os\.getenv",
}
_METHODS = {"get", "post", "put", "patch", "delete", "head", "options"}


@lru_cache(2048)
def callee(pattern: str) -> re.Pattern:
    """A dotted name: * is one segment, ** any number, {a,b} either."""
    parts = []
    for p in re.split(r"\.(?![^{]*\})", pattern):
        parts.append(r"(?:[^.]+\.)*" if p == "**" else "[^.]+" if p == "*" else "(?:" + "|".join(map(re.escape, p[1:-1].split(","))) + ")" if p[:1] == "{" else re.escape(p))
    out = ""
    for i, p in enumerate(parts):
        out += p if p.startswith("(?:[^.]+") or i == len(parts) - 1 else p + r"\."
    return re.compile(out)


class _Module:
    def __init__(self, tree: ast.Module):
        self.tree, self.alias, self.functions = tree, {}, []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.alias[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
            elif isinstance(n, ast.ImportFrom) and n.module:
                for a in n.names:
                    self.alias[a.asname or a.name] = f"{n.module}.{a.name}"
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.functions.append(n)

    def name(self, e: ast.AST) -> str:
        if isinstance(e, ast.Name):
            return self.alias.get(e.id, e.id)
        if isinstance(e, ast.Attribute):
            return f"{self.name(e.value)}.{e.attr}"
        if isinstance(e, ast.Call):
            return self.name(e.func)
        return "?"


@dataclass
class _Scope:
    module: _Module
    body: list
    sources: list[re.Pattern]
    safe: set[str]
    tainted: dict[str, list] = field(default_factory=dict)
    last: dict[str, ast.AST] = field(default_factory=dict)

    def source(self, e: ast.AST) -> list | None:
        name = self.module.name(e)
        return [(e.lineno, name)] if "?" != name and any(rx.fullmatch(name) for rx in self.sources) else None

    def origin(self, e: ast.AST | None) -> list | None:
        """The steps by which input reaches an expression, or None."""
        if e is None or isinstance(e, ast.Constant):
            return None
        if isinstance(e, ast.Name):
            return self.tainted.get(e.id) or self.source(e)
        if isinstance(e, (ast.Attribute, ast.Subscript)):
            return self.origin(e.value) or self.source(e)
        if isinstance(e, ast.Call):
            if self.module.name(e.func) in self.safe:
                return None
            inner = [e.func.value] if isinstance(e.func, ast.Attribute) else []
            return self.source(e.func) or next((o for x in [*inner, *e.args, *(k.value for k in e.keywords)] if (o := self.origin(x))), None)
        return next((o for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr) or isinstance(x, ast.comprehension) if (o := self.origin(x.iter if isinstance(x, ast.comprehension) else x))), None)

    @cached_property
    def statements(self) -> list[ast.AST]:
        """In order, those of nested blocks too, but not of functions within."""
        todo, out = list(reversed(self.body)), []
        while todo:
            n = todo.pop()
            out.append(n)
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                todo += reversed(list(ast.iter_child_nodes(n)))
        return out

    def bind(self, targets: list, origin: list | None) -> None:
        for t in targets:
            for n in ast.walk(t):
                if origin and isinstance(n, ast.Name) and n.id not in self.tainted:
                    self.tainted[n.id] = (origin + [(n.lineno, n.id)])[:8]

    def settle(self) -> None:
        for _ in range(3):
            before = len(self.tainted)
            for n in self.statements:
                if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)) and n.value is not None:
                    targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                    self.bind(targets, self.origin(n.value))
                    for t in targets:
                        if isinstance(t, ast.Name):
                            self.last[t.id] = n.value
                elif isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)):
                    self.bind([n.target], self.origin(n.iter))
                elif isinstance(n, ast.withitem) and n.optional_vars is not None:
                    self.bind([n.optional_vars], self.origin(n.context_expr))
            if len(self.tainted) == before:
                return

    def constant(self, e: ast.AST) -> bool:
        return all(isinstance(n, (ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.BinOp, ast.UnaryOp, ast.JoinedStr)) for n in ast.walk(e))

    def dynamic(self, e: ast.AST) -> bool:
        """A string that is put together from what is not constant."""
        if isinstance(e, ast.Name) and e.id in self.last:
            e = self.last[e.id]
        if isinstance(e, ast.JoinedStr):
            return any(isinstance(v, ast.FormattedValue) for v in e.values)
        if isinstance(e, ast.BinOp) and isinstance(e.op, (ast.Add, ast.Mod)):
            return not self.constant(e)
        return isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and e.func.attr in ("format", "join") and not all(map(self.constant, [*e.args, *(k.value for k in e.keywords)]))


def _argument(scope: _Scope, e: ast.AST, spec: Any) -> bool:
    if isinstance(spec, str):
        return {"tainted": lambda: bool(scope.origin(e)), "dynamic_string": lambda: scope.dynamic(e), "constant": lambda: scope.constant(e)}[spec]()
    value = e.value if isinstance(e, ast.Constant) else scope.module.name(e)
    return all(value == w if k == "equals" else re.search(w, str(value)) is not None for k, w in spec.items() if k in ("equals", "regex"))


def _seeds(fn: ast.AST, module: _Module) -> dict[str, list]:
    """Parameters of route handlers, but for those that a type or a dependency makes safe."""
    route = any(isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in _METHODS | {"route", "websocket"} for d in fn.decorator_list)
    if not route:
        return {}
    positional = [*fn.args.posonlyargs, *fn.args.args]
    given = dict(zip([a.arg for a in positional[len(positional) - len(fn.args.defaults) :]], fn.args.defaults, strict=True)) | {a.arg: d for a, d in zip(fn.args.kwonlyargs, fn.args.kw_defaults, strict=True) if d}
    out = {}
    for a in [*positional, *fn.args.kwonlyargs]:
        default = given.get(a.arg)
        injected = isinstance(default, ast.Call) and module.name(default.func).rpartition(".")[2] in ("Depends", "Security")
        plain = a.annotation is not None and (module.name(a.annotation).rpartition(".")[2] in _PLAIN or ast.unparse(a.annotation).startswith("Literal"))
        if not injected and not plain and a.arg not in ("self", "cls"):
            out[a.arg] = [(a.lineno, a.arg)]
    return out


@register("py_ast")
def py_ast(doc: Document, spec: dict, rule) -> list[Hit]:
    """Calls (`callee`, with `args`, `kwargs`, `kwarg_absent`, `sources`, `sanitizers`), or routes without a check of who asks (`fastapi_route`)."""
    if doc.lang != "python":
        return []
    try:
        module = _Module(ast.parse(doc.text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    if "fastapi_route" in spec:
        return _routes(doc, module, spec["fastapi_route"] or {})
    wanted = callee(spec["callee"])
    sources = [re.compile(SOURCES[s]) for s in spec.get("sources", ("web", "airflow", "cli", "llm", "net", "msg"))]
    safe = _SAFE | set(spec.get("sanitizers", ()))
    out = []
    for fn in [module.tree, *module.functions]:
        scope = _Scope(module, fn.body, sources, safe, {} if fn is module.tree else _seeds(fn, module))
        calls = [n for n in scope.statements if isinstance(n, ast.Call) and wanted.fullmatch(module.name(n.func))]
        if calls:
            scope.settle()
        for call in calls:
            named = {k.arg: k.value for k in call.keywords}
            judged = []
            good = not any(k in named for k in spec.get("kwarg_absent", ()))
            for where, what in spec.get("args", {}).items():
                some = call.args if where == "*" else call.args[int(where) : int(where) + 1]
                met = [a for a in some if _argument(scope, a, what)]
                judged += met
                good &= bool(met)
            for where, what in spec.get("kwargs", {}).items():
                good &= where in named and _argument(scope, named[where], what)
                judged += [named[where]] if where in named else []
            if good:
                looked = judged or call.args
                trace = next((o for a in looked if (o := scope.origin(a))), None)
                reach = "tainted" if trace else "constant" if looked and all(map(scope.constant, looked)) else "unknown"
                props = {"reachability": reach} | ({"trace": " > ".join(f"{n} {name}" for n, name in trace), "lines": ",".join(str(n) for n, _ in trace)} if trace else {})
                out.append(_node_hit(doc, call, props))
    return sorted(out, key=lambda h: (h.start, -h.end))


def _node_hit(doc: Document, n: ast.AST, props: dict, delta: int = 0) -> Hit:
    def place(line: int, column: int) -> int:  # columns are of UTF-8 bytes
        text = doc.line_text(line)
        return doc.starts[line - 1] + (column if text.isascii() else len(text.encode("utf-8")[:column].decode("utf-8", "ignore")))

    return Hit(place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset), delta=delta, props=props)


def _routes(doc: Document, module: _Module, spec: dict) -> list[Hit]:
    asks = re.compile(spec.get("auth_regex", r"(?i)(?:auth|current_?user|verify|token|jwt|oauth|api_?key|security|permission|require|login|principal|session)"))
    methods = set(spec.get("methods", ("post", "put", "patch", "delete")))
    open_paths = re.compile(spec.get("ignore_paths_regex", r"^/(?:health|healthz|livez|readyz|metrics)$"))

    def evidence(e: ast.AST | None) -> bool:
        return e is not None and any(isinstance(n, ast.Call) and module.name(n.func).rpartition(".")[2] in ("Depends", "Security") and n.args and asks.search(module.name(n.args[0])) for n in ast.walk(e))

    guarded: dict[str, bool] = {}
    for n in ast.walk(module.tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and module.name(n.value.func).rpartition(".")[2] in ("FastAPI", "APIRouter"):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    guarded[t.id] = any(k.arg == "dependencies" and evidence(k.value) for k in n.value.keywords)
    for n in ast.walk(module.tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "include_router" and n.args and isinstance(n.args[0], ast.Name):
            guarded[n.args[0].id] = guarded.get(n.args[0].id, False) or any(k.arg == "dependencies" and evidence(k.value) for k in n.keywords)
    out = []
    for fn in ast.walk(module.tree):
        if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        for d in fn.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in guarded and d.func.attr in methods):
                continue
            path = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) else ""
            told = guarded[d.func.value.id] or evidence(fn.args) or any(k.arg == "dependencies" and evidence(k.value) for k in d.keywords)
            if not told and not open_paths.search(str(path)):
                out.append(_node_hit(doc, d, {"method": d.func.attr, "route": str(path)}, -1))
    return out


# ---- HCL

@dataclass
class Block:
    kind: str
    labels: list[str]
    line: int
    attributes: dict[str, tuple[Any, int]] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)


class Unknown(str):
    """An expression that is not a literal."""


_TOKEN = re.compile(r"(?P<skip>[ \t\r]+|(?:#|//)[^\n]*|/\*(?s:.*?)\*/)|(?P<line>\n)|(?P<number>-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>[A-Za-z_][\w-]*)|(?P<here><<-?(?P<tag>[A-Za-z_]\w*)[ \t]*\n)|(?P<quote>\")|(?P<sign>=>|==|.)", re.S)


def hcl_tokens(text: str) -> list[tuple[str, Any, int, int, int]]:
    """(kind, value, line, start, end); strings and here-documents are one token, with what they interpolate left as it is."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, end, value = m.lastgroup, m.end(), m[0]
        if kind == "quote":
            depth, i = 0, end
            while i < len(text) and (depth or text[i] != '"'):
                if text[i] == "\\" and not depth:
                    i += 1
                elif text.startswith(("${", "%{"), i):
                    depth += 1
                    i += 1
                elif depth and text[i] == "{":
                    depth += 1
                elif depth and text[i] == "}":
                    depth -= 1
                i += 1
            body, end = text[at + 1 : i], min(len(text), i + 1)
            kind, value = "string", Unknown(body) if re.search(r"(?<!\$)\$\{|(?<!%)%\{", body) else body.replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
        elif kind == "here":
            stop = re.compile(rf"(?m)^[ \t]*{re.escape(m['tag'])}[ \t]*$").search(text, end)
            body, end = text[end : stop.start() if stop else len(text)], stop.end() if stop else len(text)
            kind, value = "string", Unknown(body) if "${" in body else body
        elif kind == "number":
            value = float(value) if re.search("[.eE]", value) else int(value)
        if kind != "skip":
            out.append((kind, value, line, at, end))
        line += text.count("\n", at, end)
        at = end
    return out


class Hcl:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, hcl_tokens(text), 0

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", None, 0, len(self.text), len(self.text))

    def body(self, into: Block, depth: int = 0) -> Block:
        while True:
            kind, value, line, _, _ = self.peek()
            if kind == "end" or kind == "sign" and value == "}":
                return into
            self.at += 1
            if kind not in ("word", "string"):
                continue
            labels = []
            while self.peek()[0] in ("word", "string"):
                labels.append(str(self.peek()[1]))
                self.at += 1
            sign = self.peek()[1]
            if self.peek()[0] == "sign" and sign == "=" and not labels:
                self.at += 1
                into.attributes[str(value)] = (self.expression(depth), line)
            elif self.peek()[0] == "sign" and sign == "{" and depth < 64:
                self.at += 1
                into.blocks.append(self.body(Block(str(value), labels, line), depth + 1))
                self.at += 1

    def expression(self, depth: int) -> Any:
        start = self.at
        value = self.literal(depth)
        if value is not Hcl and (self.peek()[0] in ("line", "end") or self.peek()[1] in ("}", "]", ",")):
            return value
        self.at, level, first = start, 0, self.peek()[3]
        while self.peek()[0] != "end":
            kind, v, *_ = self.peek()
            if kind == "sign" and v in ("(", "[", "{"):
                level += 1
            elif kind == "sign" and v in (")", "]", "}"):
                if not level:
                    break
                level -= 1
            elif not level and (kind == "line" or v == ","):
                break
            self.at += 1
        return Unknown(self.text[first : self.peek()[3]].strip())

    def literal(self, depth: int) -> Any:
        """A literal, or Hcl where there is none."""
        kind, value, *_ = self.peek()
        if kind in ("number", "string"):
            self.at += 1
            return value
        if kind == "word" and value in ("true", "false", "null"):
            self.at += 1
            return {"true": True, "false": False, "null": None}[value]
        if kind != "sign" or value not in ("[", "{") or depth > 64:
            return Hcl
        self.at += 1
        out: Any = [] if value == "[" else {}
        while True:
            while self.peek()[0] == "line" or self.peek()[1] == ",":
                self.at += 1
            kind, v, *_ = self.peek()
            if kind == "end":
                return Hcl
            if kind == "sign" and v in ("]", "}"):
                self.at += 1
                return out
            if value == "[":
                out.append(self.expression(depth + 1))
            else:
                self.at += 1
                if self.peek()[1] not in ("=", ":"):
                    return Hcl
                self.at += 1
                out[str(v)] = self.expression(depth + 1)


def parse_hcl(text: str) -> Block:
    return Hcl(text).body(Block("", [], 1))


def parse_tf_json(text: str) -> Block:
    """A .tf.json text in the same form; labels are the names of nested mappings."""
    import json

    root = Block("", [], 1)

    def block(kind: str, labels: list[str], tree: dict) -> Block:
        b = Block(kind, labels, 1)
        for k, v in tree.items():
            for one in v if isinstance(v, list) and v and all(isinstance(x, dict) for x in v) else [v]:
                if isinstance(one, dict):
                    b.blocks.append(block(k, [], one))
            b.attributes[k] = (v if not isinstance(v, str) or "${" not in v else Unknown(v), 1)
        return b

    depth = {"resource": 2, "data": 2, "module": 1, "variable": 1, "provider": 1, "output": 1}
    for kind, tree in json.loads(text).items():
        found = [([], tree)]
        for _ in range(depth.get(kind, 0)):
            found = [(labels + [k], v) for labels, t in found if isinstance(t, dict) for k, v in t.items()]
        root.blocks += [block(kind, labels, t) for labels, t in found if isinstance(t, dict)]
    return root


def _attribute(b: Block, path: str, known: dict) -> tuple[Any, int] | None:
    name, _, rest = path.partition(".")
    if name in b.attributes:
        value, line = b.attributes[name]
        for part in filter(None, rest.split(".")):
            if not isinstance(value, dict) or part not in value:
                return None
            value = value[part]
        return known.get(str(value), value) if isinstance(value, Unknown) else value, line
    return next((got for inner in b.blocks if inner.kind == name and rest and (got := _attribute(inner, rest, known))), None)


@register("hcl")
def hcl(doc: Document, spec: dict, rule) -> list[Hit]:
    """Blocks by type and labels (`block`), or nested ones (`each`), whose attributes meet all of `all` and none of `none`. What is not a
    literal, nor a variable or local with one, is unknown: no match, or with on_unknown: match one of less confidence."""
    if doc.lang != "hcl" and not doc.path.endswith(".tf.json"):
        return []
    try:
        root = parse_tf_json(doc.text) if doc.path.endswith(".tf.json") else parse_hcl(doc.text)
    except (ValueError, RecursionError, AttributeError):
        return []
    known = {f"var.{b.labels[0]}": b.attributes["default"][0] for b in root.blocks if b.kind == "variable" and b.labels and "default" in b.attributes and not isinstance(b.attributes["default"][0], Unknown)}
    known |= {f"local.{k}": v for b in root.blocks if b.kind == "locals" for k, (v, _) in b.attributes.items() if not isinstance(v, Unknown)}
    kind, *labels = spec["block"].split(".")
    maybe, out = spec.get("on_unknown") == "match", []

    def test(b: Block, c: dict) -> tuple[bool | None, int]:
        if "range_includes" in c:
            r = c["range_includes"]
            ends = [_attribute(b, r[k], known) for k in ("lo", "hi")]
            if None in ends:
                return False, b.line
            if any(isinstance(v, Unknown) or not isinstance(v, (int, float)) for v, _ in ends):
                return None, ends[0][1]
            return any(ends[0][0] <= p <= ends[1][0] for p in r["any"]), ends[0][1]
        got = _attribute(b, c["attr"], known)
        if "exists" in c:
            return (got is not None or any(x.kind == c["attr"] for x in b.blocks)) == c["exists"], got[1] if got else b.line
        if got is None:
            return False, b.line
        return (None if isinstance(got[0], Unknown) else holds(got[0], c)), got[1]

    for b in root.blocks:
        if b.kind != kind or len(b.labels) < len(labels) or any(w not in ("*", have) for w, have in zip(labels, b.labels, strict=False)):
            continue
        for one in [x for x in b.blocks if x.kind == spec["each"]] if spec.get("each") else [b]:
            got = [test(one, c) for c in spec.get("all", ())]
            against = [test(one, c)[0] for c in spec.get("none", ())]
            unknown = any(ok is None for ok, _ in got)
            if any(ok is False for ok, _ in got) or any(against) or unknown and not maybe:
                continue
            if h := _line_hit(doc, got[0][1] if got else one.line):
                h.delta = -1 if unknown else 0
                h.props = {"block": ".".join([b.kind, *b.labels])} | ({"unresolved": "true"} if unknown else {})
                out.append(h)
    return out
