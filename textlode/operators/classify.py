"""Language, kind and tags of a document: by configured globs, path, extension, first line, then contents.

What comes first decides language and kind, each on its own; tags add up. Only the first SNIFF characters are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import glob

SNIFF, DOCUMENTS = 65_536, 256
KIND_RANK = ("data", "doc", "code", "agent-config", "iac", "ci")

#: By the last component's name (lower case where marked), then by folders: language, kind, tag.
_NAMES = {
    "action.yml": ("yaml", "ci", "gha-action"), "action.yaml": ("yaml", "ci", "gha-action"), "Jenkinsfile": ("groovy", "ci", "ci-other"),
    ".gitlab-ci.yml": ("yaml", "ci", "ci-other"), "azure-pipelines.yml": ("yaml", "ci", "ci-other"), "bitbucket-pipelines.yml": ("yaml", "ci", "ci-other"),
    "AGENTS.md": ("markdown", "agent-config", "agent-instructions"), "SKILL.md": ("markdown", "agent-config", "agent-instructions"),
    "CLAUDE.md": ("markdown", "agent-config", "agent-instructions"), "CLAUDE.local.md": ("markdown", "agent-config", "agent-instructions"),
    "GEMINI.md": ("markdown", "agent-config", "agent-instructions"), ".cursorrules": ("markdown", "agent-config", "agent-instructions"),
    ".windsurfrules": ("markdown", "agent-config", "agent-instructions"), ".clinerules": ("markdown", "agent-config", "agent-instructions"),
    "mcp.json": ("json", "agent-config", "mcp"), ".mcp.json": ("json", "agent-config", "mcp"), "Chart.yaml": ("yaml", "iac", "helm"),
    "terragrunt.hcl": ("hcl", "iac", "terragrunt"), "kustomization.yaml": ("yaml", "iac", "kustomize"), "kustomization.yml": ("yaml", "iac", "kustomize"),
    "site.yml": ("yaml", "iac", "ansible"), "ansible.cfg": ("ini", "iac", "ansible"), "nginx.conf": ("nginx", "iac", "nginx"),
    "traefik.yml": ("yaml", "iac", "traefik"), "traefik.yaml": ("yaml", "iac", "traefik"), "traefik.toml": ("toml", "iac", "traefik"),
    "go.sum": ("text", "data", "lockfile"), "yarn.lock": ("text", "data", "lockfile"), "uv.lock": ("toml", "data", "lockfile"),
    "poetry.lock": ("toml", "data", "lockfile"), "Cargo.lock": ("toml", "data", "lockfile"), "package-lock.json": ("json", "data", "lockfile"),
    "Pipfile.lock": ("json", "data", "lockfile"), "pnpm-lock.yaml": ("yaml", "data", "lockfile"),
}
_ANSIBLE = {"roles", "playbooks", "host_vars", "group_vars"}
_SITES = {"conf.d", "sites-enabled", "sites-available"}
_FLAGGED = {".example", ".sample", ".template", ".dist"}

EXTENSIONS: dict[str, tuple[str, str | None, str | None]] = {}
for _kind, _listed in {
    "code": "python: py pyi|scala: scala sc sbt|java: java|kotlin: kt|go: go|rust: rs|ruby: rb|php: php|csharp: cs|sql: sql|powershell: ps1|javascript: js mjs cjs jsx|typescript: ts tsx|shell: sh bash zsh ksh",
    None: "yaml: yml yaml|json: json|toml: toml|ini: ini cfg conf properties|xml: xml|csv: csv tsv",
    "doc": "markdown: md mdx markdown|rst: rst|text: adoc txt|html: html htm xhtml|xml: svg",
}.items():
    for _entry in _listed.split("|"):
        _lang, _exts = _entry.split(": ")
        EXTENSIONS |= dict.fromkeys(_exts.split(), (_lang, _kind, None))
EXTENSIONS |= {"ipynb": ("json", "code", "notebook")} | dict.fromkeys("j2 jinja jinja2 tpl".split(), ("jinja", "code", "template"))
EXTENSIONS |= dict.fromkeys("tf tfvars hcl".split(), ("hcl", "iac", "terraform")) | dict.fromkeys("pem key crt asc".split(), ("text", "data", "key-material"))

#: Modules whose import tags a Python text.
_MODULES = {
    "fastapi": "fastapi", "starlette": "fastapi", "airflow": "airflow-dag", "pyspark": "spark", "vertexai": "llm", "langchain": "llm", "llama_index": "llm",
    "pinecone": "vectordb", "qdrant_client": "vectordb", "weaviate": "vectordb", "chromadb": "vectordb", "pymilvus": "vectordb", "pgvector": "vectordb",
    "ccxt": "trading", "alpaca": "trading", "ib_insync": "trading", "binance": "trading", "kopf": "k8s-operator",
}
_FAMILIES = ("langchain", "alpaca")


def by_path(path: str, charts: Iterable[str] = ()) -> tuple[str | None, str | None, list[str]]:
    """charts: folders that hold a Chart.yaml."""
    *folders, name = path.split("/")
    low, ext = name.lower(), name.rpartition(".")[2].lower() if "." in name else ""
    yaml = ext in ("yml", "yaml")
    at = folders[-1] if folders else ""
    if folders[-2:] == [".github", "workflows"] and yaml:
        return "yaml", "ci", ["gha"]
    if ".tekton" in folders and yaml:
        return "yaml", "ci", ["tekton"]
    if at == ".circleci" and name in ("config.yml", "config.yaml"):
        return "yaml", "ci", ["ci-other"]
    if name in _NAMES:
        lang, kind, tag = _NAMES[name]
        return lang, kind, [tag]
    if {".cursorrules", ".windsurfrules", ".clinerules"} & set(folders) or folders[-2:] == [".cursor", "rules"]:
        return "markdown", "agent-config", ["agent-instructions"]
    if ".claude" in folders:
        below = folders[folders.index(".claude") + 1 :]
        if ext == "md" and below[:1] in (["agents"], ["commands"]):
            return "markdown", "agent-config", ["agent-instructions"]
        if not below and low.startswith("settings") and ext == "json":
            return "json", "agent-config", ["agent-settings"]
    stem = low.partition(".")[0]
    if stem in ("dockerfile", "containerfile") or ext == "dockerfile":
        return "dockerfile", "iac", ["docker"]
    if yaml and (stem.startswith("compose") or stem.startswith("docker-compose")):
        return "yaml", "iac", ["compose"]
    if charts and (yaml and stem.startswith("values") and "/".join(folders) in charts):
        return "yaml", "iac", ["helm"]
    if charts and "templates" in folders:
        above = folders[: len(folders) - 1 - folders[::-1].index("templates")]
        if "/".join(above) in charts:
            return ("yaml", "iac", ["helm", "helm-template"]) if ext in ("yaml", "yml", "tpl", "txt") else (None, None, ["helm", "helm-template"])
    if yaml and (_ANSIBLE & set(folders) or ext == "yml" and stem.startswith("playbook")):
        return "yaml", "iac", ["ansible"]
    if ext == "conf" and "nginx" in folders or at in _SITES:
        return "nginx", "iac", ["nginx"]
    if "traefik" in folders and (yaml or ext == "toml"):
        return "toml" if ext == "toml" else "yaml", "iac", ["traefik"]
    if ext == "py" and {"airflow", "dags"} & set(folders):
        return "python", "code", ["airflow-dag"]
    if name == ".env" or ext == "env" or name.startswith(".env.") or ".env." in name:
        return "dotenv", "data", ["env", "example"] if any(name.endswith(x) for x in _FLAGGED) else ["env"]
    if ext == "txt" and stem.startswith("requirements"):
        return "text", "data", ["lockfile"]
    if low.endswith(".tf.json"):
        return "json", "iac", ["terraform"]
    return None, None, []


_TOP = re.compile(r"""["']?([A-Za-z_][\w.-]*)["']?[ \t]*:(?:[ \t]+["']?([^\s"'#]*))?""")


def sniff_yaml(text: str) -> tuple[str | None, set[str]]:
    """Each document of the text on its own; the kind of highest rank."""
    kinds, tags, documents = set(), set(), 0
    for part in re.split(r"(?m)^---(?:[ \t].*)?$", text)[:DOCUMENTS]:
        documents += 1
        top: dict[str, str] = {}
        inside, play, child = "", False, False
        for line in part.split("\n"):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if line[0] not in " \t-":
                m = _TOP.match(line)
                inside = m[1] if m else ""
                if m:
                    top.setdefault(m[1], m[2] or "")
            else:
                word = line.strip(" \t-").partition(":")
                play |= bool(word[1]) and word[0].strip() in ("hosts", "tasks", "import_playbook")
                child |= inside == "services" and bool(word[1]) and word[0].strip() in ("image", "build")
        if "apiVersion" in top and "kind" in top:
            api, what = top["apiVersion"], top["kind"]
            kinds.add("ci" if api.startswith("tekton.dev/") else "iac")
            tags.add("tekton" if api.startswith("tekton.dev/") else "k8s")
            if "toolkit.fluxcd.io/" in api:
                tags.add("flux")
            if what.removeprefix("Cluster") in ("Role", "RoleBinding"):
                tags.add("rbac")
            if what == "CustomResourceDefinition":
                tags.add("crd")
        if "on" in top and "jobs" in top:
            kinds.add("ci")
            tags.add("gha")
        if child:
            kinds.add("iac")
            tags.add("compose")
        if play:
            kinds.add("iac")
            tags.add("ansible")
        if "AWSTemplateFormatVersion" in part or re.search(r"""Type["']?[ \t]*:[ \t]*["']?AWS::""", part):
            kinds.add("iac")
            tags.add("cloudformation")
    return max(kinds, key=KIND_RANK.index, default=None), tags


def sniff_json(text: str) -> tuple[str | None, set[str]]:
    quoted = set(re.findall(r'"(mcpServers|AWSTemplateFormatVersion|format_version|terraform_version)"\s*:', text))
    if "mcpServers" in quoted:
        return "agent-config", {"mcp"}
    if "AWSTemplateFormatVersion" in quoted or re.search(r'"Type"\s*:\s*"AWS::', text):
        return "iac", {"cloudformation"}
    if {"format_version", "terraform_version"} <= quoted:
        return "iac", {"terraform", "terraform-plan"}
    return None, set()


def sniff_imports(text: str, lang: str) -> set[str]:
    if lang == "scala":
        return {"spark"} if re.search(r"(?m)^\s*import\s+org\.apache\.spark\b", text) else set()
    tags = set()
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("from "):
            head, _, names = line[5:].partition(" import ")
            modules = [head.strip()] + [f"{head.strip()}.{n.strip().partition(' ')[0]}" for n in names.split(",")]
        elif line.startswith("import "):
            modules = [m.strip().partition(" ")[0] for m in line[7:].split(",")]
        else:
            continue
        for m in modules:
            first = m.partition(".")[0]
            family = next((f for f in _FAMILIES if first.startswith(f)), first)
            if family in _MODULES:
                tags.add(_MODULES[family])
            if m.startswith("google.cloud.aiplatform"):
                tags.add("llm")
    return tags


_TEST_FOLDERS = {"test", "tests", "__tests__", "spec", "specs", "fixture", "fixtures", "testdata"}
_TEST_NAME = re.compile(r"(?:test_.*\.py|.*_test\.(?:py|go)|conftest\.py|.*\.(?:spec|test)\.[jt]sx?)")


def flags(path: str, text: str, virtual: bool = False) -> set[str]:
    out = set()
    *folders, name = path.split("/")
    if re.search(r"(?i)@generated\b|\bcode generated\b|\bdo not edit\b|\bauto-?generated\b", "\n".join(text[:SNIFF].split("\n", 5)[:5])):
        out.add("generated")
    if name.endswith((".min.js", ".min.css")):
        out.add("minified")
    elif len(text) > 20_480:
        head = text[:SNIFF]
        if len(head) > 1000 * max(1, head.count("\n") + (not head.endswith("\n"))):
            out.add("minified")
    if not virtual and (_TEST_FOLDERS & set(folders) or _TEST_NAME.fullmatch(name)):
        out.add("test")
    return out


@lru_cache(1024)
def _glob(pattern: str) -> re.Pattern:
    return re.compile(glob(pattern))


def classify(path: str, text: str, rules: tuple = (), charts: frozenset[str] = frozenset()) -> tuple[str, str, tuple[str, ...]]:
    """lang, kind, tags. rules: (glob, lang, kind, tags) of a configuration, of which the first that matches counts."""
    virtual = not path or path.startswith("<") and path.endswith(">")
    lang = kind = None
    tags: set[str] = set()

    def offer(other_lang, other_kind, more=()):
        nonlocal lang, kind
        lang, kind = lang or other_lang, kind or other_kind
        tags.update(more)

    if not virtual:
        for pattern, *told in rules:
            if _glob(pattern).match(path):
                offer(*told)
                break
        offer(*by_path(path, charts))
        name = path.rpartition("/")[2]
        if "." in name[1:]:
            found = EXTENSIONS.get(name.rpartition(".")[2].lower())
            if found:
                offer(found[0], found[1], [found[2]] if found[2] else ())
    if text.startswith("#!"):
        first = text[:256].partition("\n")[0]
        if "python" in first:
            offer("python", "code")
        elif re.search(r"\b(?:ba|z|k|da)?sh\b", first):
            offer("shell", "code")
    head = text[:SNIFF]
    if lang == "yaml" or lang is None and re.search(r"(?m)^apiVersion[ \t]*:", head):
        offer("yaml" if lang else None, *sniff_yaml(head))
    if lang == "json" or lang is None and head.lstrip()[:1] == "{":
        told, more = sniff_json(head)
        offer("json" if told else None, told, more)
    if lang in ("python", "scala"):
        tags |= sniff_imports(head, lang)
    tags |= flags(path, text, virtual)
    return lang or "text", kind or "data", tuple(sorted(tags))


def classified(docs: DataFrame, rules: tuple = (), charts: frozenset[str] = frozenset()) -> DataFrame:
    """docs (path, text, ...) with lang, kind and tags."""

    def run(batches):
        for b in batches:
            got = [classify(p or "", t or "", rules, charts) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True)]
            columns = [b.column(c) for c in keys] + [pa.array([g[i] for g in got], pa.string()) for i in (0, 1)] + [pa.array([list(g[2]) for g in got], pa.list_(pa.string()))]
            yield pa.record_batch(columns, [*keys, "lang", "kind", "tags"])

    keys = [c for c in docs.columns if c not in ("text", "lang", "kind", "tags")]
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{shape}, lang string, kind string, tags array<string>")


def charts(docs: DataFrame, most: int = 10_000) -> frozenset[str] | None:
    """Folders of docs that hold a Chart.yaml, by paths alone; None if there are over `most`, which are too many to send to every task."""
    found = docs.where(F.col("path").rlike("(^|/)Chart[.]yaml$")).select(F.regexp_replace("path", "/?Chart[.]yaml$", "").alias("folder")).distinct().limit(most + 1).collect()
    return frozenset(r["folder"] for r in found) if len(found) <= most else None
