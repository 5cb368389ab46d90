"""Documents from tables, files, diffs and logs: path, text and what was found while reading."""

from __future__ import annotations

import codecs
import os
import re
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import glob
from ..storage import materialize

BINARY = "png jpg jpeg gif ico pdf zip gz bz2 xz 7z tar jar class so dll exe o a pyc woff woff2 ttf otf mp3 mp4 mov avi parquet orc avro db sqlite bin".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """documents, pages or conversations as path, text. Documents have no extension, so they count as data, not prose."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents":
        return rows.select("doc_id", F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), "text")
    if name == "pages":
        return rows.select("page_id", F.concat(F.lit("web:"), "url").alias("path"), F.col("html").alias("text"))
    turn = F.concat_ws("/", F.lit("conversations"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    return rows.select("conv_id", "turn", turn.alias("path"), "text")


def decode(data: bytes) -> tuple[str | None, str | None, bool, str | None]:
    """text, encoding, whether it fell back to Latin-1, and why there is no text: a byte-order mark, else UTF-8, else Latin-1; null if binary."""
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name, False, None
    head = data[:8192]
    if b"\0" in head or head and sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head) > 0.3 * len(head):
        return None, None, False, "binary"
    try:
        return data.decode("utf-8"), "utf-8", False, None
    except UnicodeDecodeError:
        return data.decode("latin-1"), "latin-1", True, None


#: Folders and files that hold nothing of one's own; a pattern with ! takes one back.
BUILTIN = [f"{name}/" for name in "node_modules venv .venv __pycache__ .tox .mypy_cache .ruff_cache .pytest_cache .terraform .terragrunt-cache dist build target .idea".split()] + ["*.min.js.map"]


def files(spark: SparkSession, root: str, max_file_bytes: int = 1 << 20, max_files: int | None = None, max_total_bytes: int | None = None, ignore: list[str] = (), include: list[str] = (), only: DataFrame | None = None, explicit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (path, text, encoding, fallback), and what was skipped (path, reason). Sizes and names decide before contents are read.

    only: the paths (path) to read, such as those of a list or a diff. explicit: paths that ignore patterns do not concern.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    named = listed.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.sub(r"([^\w/-])", r"\\\1", base), ""))
    if only is not None:
        named = named.join(only.select("path").distinct(), "path", "left_semi")
    asked = F.lit(False)
    if explicit is not None:
        named = named.join(explicit.select("path", F.lit(True).alias("__asked")).distinct(), "path", "left")
        asked = F.coalesce("__asked", F.lit(False))
    ext = F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1))
    left_out = ~asked & (ignored(F.col("path"), list(ignore)) | (~included(F.col("path"), list(include)) if include else F.lit(False)))
    reason = F.when(left_out, "ignored").when(ext.isin(BINARY), "binary").when(F.col("length") > max_file_bytes, "too_large")
    meta = named.select("path", "length", reason.alias("reason"))
    if max_files or max_total_bytes:
        live = running(meta.where("reason IS NULL"))
        over = F.lit(False)
        if max_files:
            over = over | (F.col("n") > max_files)
        if max_total_bytes:
            over = over | (F.col("total") > max_total_bytes)
        meta = meta.where("reason IS NOT NULL").unionByName(live.select("path", "length", F.when(over, "over_cap").alias("reason")))
        take = named.join(meta.where("reason IS NULL").select("path"), "path", "left_semi")
    else:
        take = named.where(reason.isNull())

    def read(batches):
        for b in batches:
            got = [decode(x) for x in b.column("content").to_pylist()]
            yield pa.record_batch([b.column("path"), *[pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))]], ["path", "text", "encoding", "fallback", "reason"])

    out = take.select("path", "content").mapInArrow(read, "path string, text string, encoding string, fallback boolean, reason string")
    skipped = meta.where("reason IS NOT NULL").select("path", "reason").unionByName(out.where("reason IS NOT NULL").select("path", "reason"))
    return out.where("reason IS NULL").drop("reason"), skipped


def running(meta: DataFrame, parts: int = 32) -> DataFrame:
    """meta (path, length) with n and total: how many there are, and of how many bytes, up to each in order of paths; `/` comes before all other characters.

    Names are dealt out by ranges; each range is summed where it is, and takes the sums of those before it, of which there are `parts`.
    """
    key = F.replace("path", F.lit("/"), F.lit("\x00"))
    dealt = materialize(meta.withColumn("__key", key).repartitionByRange(parts, "__key").withColumn("__part", F.spark_partition_id()), "names")
    rows, sums, n, total = sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.count("*"), F.sum("length")).collect()), [], 0, 0
    for part, count, size in rows:
        sums.append((part, n, total))
        n, total = n + count, total + size
    before = meta.sparkSession.createDataFrame(sums, "__part int, __n long, __total long")
    w = Window.partitionBy("__part").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({"n": F.count("*").over(w), "total": F.sum("length").over(w)}).join(F.broadcast(before), "__part")  # `parts` rows
    return own.withColumns({"n": F.col("n") + F.col("__n"), "total": F.col("total") + F.col("__total")}).drop("__key", "__part", "__n", "__total")


def listed(spark: SparkSession, data: bytes, most: int = 64 << 20) -> DataFrame:
    """path: of a list of names, parted by NUL or by line feeds."""
    if len(data) > most:
        raise ValueError(f"a list of over {most} bytes")
    names = data.split(b"\0") if b"\0" in data else data.split(b"\n")
    return spark.createDataFrame([(n.decode("utf-8", "surrogateescape").removeprefix("./"),) for n in (x.strip(b"\r") for x in names) if n], "path string")


def git(root: str, *arguments: str, seconds: int = 60) -> bytes | None:
    """What a git command in a local folder gives; None where there is no git, no repository, or no answer in time."""
    try:
        return subprocess.run(["git", "-C", root, *arguments], capture_output=True, timeout=seconds, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def git_files(root: str) -> bytes | None:
    """Names, parted by NUL, of the files that a repository has or would take."""
    return git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")


def git_changed(root: str, against: str | None = None) -> bytes | None:
    """Names of the files that differ from a commit, or that are staged; files that are gone are left out."""
    if against and against.startswith("-"):
        raise ValueError("not the name of a commit")
    return git(root, "diff", "--name-only", "--diff-filter=ACMR", "-z", *([against] if against else ["--cached"]), "--")


def git_diff(root: str, against: str | None = None) -> str | None:
    out = git(root, "diff", "-U0", "--no-color", "--diff-filter=ACMR", *([against] if against else ["--cached"]), "--")
    return None if out is None else out.decode("utf-8", "replace")


def git_log(root: str, since: str | None = None, most: int = 1000) -> str | None:
    out = git(root, "log", "-p", "-U0", "--no-color", f"--max-count={most}", *([f"--since={since}"] if since else []), seconds=600)
    return None if out is None else out.decode("utf-8", "replace")


def walk(root: str, follow: bool = False, most_depth: int = 512):
    """(path, note) of the regular files of a local folder, depth first, by bytes of names. Links are not followed, or if so only to what
    lies within root and was not yet met; note says why one is left out."""
    met: set[tuple[int, int]] = set()
    top = os.path.realpath(root)

    def below(folder: str, depth: int):
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        except OSError as e:
            yield os.path.relpath(folder, root), f"unreadable: {e.strerror}"
            return
        later = []
        for e in entries:
            path = os.path.relpath(e.path, root)
            if e.is_symlink():
                later.append((e, path))
            elif e.is_dir():
                if depth >= most_depth:
                    yield path, "too deep"
                else:
                    yield from below(e.path, depth + 1)
            elif e.is_file():
                at = e.stat()
                met.add((at.st_dev, at.st_ino))
                yield path, None
        for e, path in later:
            real = os.path.realpath(e.path)
            if not follow:
                yield path, "a link"
            elif os.path.commonpath([top, real]) != top:
                yield path, "a link that leads outside"
            elif os.path.isdir(real):
                if os.path.realpath(folder).startswith(real):
                    yield path, "a link in a circle"
                elif depth < most_depth:
                    yield from below(e.path, depth + 1)
            elif os.path.isfile(real):
                at = os.stat(real)
                if (at.st_dev, at.st_ino) in met:
                    yield path, "a link to a file that was met"
                else:
                    met.add((at.st_dev, at.st_ino))
                    yield path, None

    yield from below(root, 0)


def sections(text: str) -> list[tuple[str, tuple[str, ...] | None]]:
    """Patterns of an ignore file with the rules they are for: after a line `#!rules A, B-*` for those, after `#!rules` for all (None)."""
    out, scope = [], None
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("#!rules"):
            scope = tuple(x.strip() for x in line[7:].split(",") if x.strip()) or None
        elif line.strip() and not line.startswith("#"):
            line = re.sub(r"(?<!\\)[ \t]+$", "", line)
            out.append((line, scope))
    return out


def _pattern(text: str, negate: bool = True) -> tuple[str, bool, bool]:
    """A gitignore pattern's expression for one path, whether it takes back, and whether it is for folders alone."""
    back = negate and text.startswith("!")
    text = text[1:] if back else text.removeprefix("\\")
    return glob(text).replace("(?:/.*)?$", "$"), back, text.endswith("/")


def ignored(path: Column, patterns: list[str]) -> Column:
    """gitignore order: the last pattern that matches decides, ! takes back, and nothing under an ignored folder comes back. .git always is."""
    told = [_pattern(t.strip()) for t in patterns if t.strip() and not t.startswith("#")]

    def one(p: Column, folder: bool) -> Column:
        out = F.lit(False)
        for rx, back, folders in told:
            if folder or not folders:
                out = F.when(p.rlike(rx), F.lit(not back)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    git_own = path.rlike("(^|/)[.]git(/|$)")
    return git_own | F.exists(above, lambda p: one(p, True)) | one(path, False) if told else git_own


def included(path: Column, globs: list[str]) -> Column:
    """Whether a path, or a folder above it, matches one of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob(g))
    return out


def without_ignored(findings: DataFrame, patterns: list[tuple[str, tuple[str, ...] | None]]) -> DataFrame:
    """findings without those whose rule an ignore file's section leaves out of their path."""
    by_scope: dict = {}
    for text, scope in patterns:
        if scope:
            by_scope.setdefault(scope, []).append(text)
    out = findings
    for scope, listed_ in by_scope.items():
        named = F.lit(False)
        for i in scope:
            named = named | F.col("rule_id").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"(\W)", r"\\\1", c) for c in i) + "$")
        out = out.where(~(named & ignored(F.col("path"), listed_)))
    return out


def head_tail(text: Column, most: int) -> Column:
    """A text that is too long as its first half and its last, joined by a line feed."""
    k = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(k)), F.lit("\n"), F.right(text, F.lit(most - k)))).otherwise(text)


def unquoted(name: str) -> str:
    """A file's name as diffs quote it: in double quotes, with C escapes and octal bytes."""
    name = name.rstrip("\t\r")
    if not (name.startswith('"') and name.endswith('"')):
        return name
    plain = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, '"': 34, "\\": 92}
    out, i, body = bytearray(), 0, name[1:-1]
    while i < len(body):
        if body[i] != "\\":
            out += body[i].encode("utf-8", "surrogateescape")
            i += 1
        elif octal := re.match("[0-7]{3}", body[i + 1 : i + 4]):
            out.append(int(octal[0], 8) & 255)
            i += 4
        else:
            out.append(plain.get(body[i + 1 : i + 2], 63))
            i += 2
    return out.decode("utf-8", "surrogateescape")


def _hunks(text: str):
    path, left = None, 0
    for line in text.split("\n"):
        if left > 0 and line[:1] in ("+", "-", " "):  # within a hunk nothing is a header
            left -= 1
            continue
        if line.startswith("+++ "):
            name = unquoted(line[4:].rstrip("\n"))
            path = None if name == "/dev/null" else name.removeprefix("b/")
        elif m := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            gone, first, n = int(m[1] or 1), int(m[2]), int(m[3] or 1)
            left = gone + n
            if n and path is not None:
                yield path, first, first + n - 1


def hunks(diffs: DataFrame) -> DataFrame:
    """path, lo, hi of lines that unified diffs without context (text) add; pure deletions have none."""

    def run(batches):
        for b in batches:
            rows = [h for t in b.column("text").to_pylist() for h in _hunks(t or "")]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2))], ["path", "lo", "hi"])

    return diffs.select("text").mapInArrow(run, "path string, lo int, hi int")


def history(logs: DataFrame) -> DataFrame:
    """Runs of added lines of a patch log (log_id, text) as documents: path, commit, first_line, text. Gaps and islands over the log's rows."""
    rows = logs.select("log_id", F.posexplode(F.split("text", "\n")).alias("n", "row"))
    w = Window.partitionBy("log_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    commit = F.when(F.col("row").rlike("^commit [0-9a-f]{7,64}$"), F.substring("row", 8, 64))
    file = F.when(F.col("row").startswith("+++ "), F.regexp_extract("row", r"^\+\+\+ (?:b/)?(.+)$", 1))
    hunk = F.when(F.col("row").startswith("@@ "), F.col("n"))
    first = F.when(F.col("row").startswith("@@ "), F.regexp_extract("row", r"^@@ -\S+ \+(\d+)", 1).cast("int"))
    added = F.col("row").startswith("+") & ~F.col("row").startswith("+++ ")
    rows = rows.withColumns({"commit": F.last(commit, True).over(w), "path": F.last(file, True).over(w), "hunk": F.last(hunk, True).over(w), "at": F.last(first, True).over(w)})
    rows = rows.where(added).withColumn("k", F.row_number().over(Window.partitionBy("log_id", "hunk").orderBy("n")))
    run = rows.withColumn("island", F.col("n") - F.col("k")).groupBy("log_id", "commit", "path", "hunk", "island", "at")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: F.substr(x["row"], F.lit(2))), "\n")
    return run.agg(text.alias("text"), F.min("k").alias("k")).select("path", "commit", (F.col("at") + F.col("k") - 1).alias("first_line"), "text")


def history_documents(runs: DataFrame) -> DataFrame:
    """history()'s runs as documents to scan: each has a path of its own, which rebased() takes back."""
    place = F.concat("path", F.lit("@"), F.coalesce("commit", F.lit("")), F.lit(":"), F.col("first_line").cast("string"))
    return runs.select(place.alias("path"), "text", F.col("path").alias("file"), "commit", "first_line")


def rebased(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """findings of history_documents() with the file's own path and lines, and the commit."""
    of = documents.select("path", "file", "commit", "first_line").distinct()
    out = findings.join(of, "path").withColumns({"line": F.col("line") + F.col("first_line") - 1, "end_line": F.col("end_line") + F.col("first_line") - 1})
    return out.drop("path", "first_line").withColumnRenamed("file", "path")
