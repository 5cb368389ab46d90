"""Command line: scan, inject, secrets, baseline, rules, version.

Exits with 0: nothing at or over the gate; 1: something is; 2: wrong use or configuration; 3: the scan failed or was cut short; 130: interrupted.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
from dataclasses import asdict

from . import VERSION, config, packs
from .functions.columns import CONFIDENCES, SEVERITIES
from .rules import RULES, Rule, select

IGNORE_FILE = ".textlodeignore"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textlode")
    commands = top.add_subparsers(dest="command", required=True)

    def scanning(p: argparse.ArgumentParser) -> None:
        p.add_argument("paths", nargs="*", default=["."])
        p.add_argument("--config")
        p.add_argument("--packs", type=lambda x: x.split(","))
        p.add_argument("--enable", action="append", default=[])
        p.add_argument("--disable", action="append", default=[])
        p.add_argument("--rules", action="append", default=[], help="a file or folder of rules")
        p.add_argument("--fail-on", choices=[*SEVERITIES, "never"])
        p.add_argument("--min-severity", choices=SEVERITIES)
        p.add_argument("--min-confidence", choices=CONFIDENCES)
        p.add_argument("--format", choices=["text", "json", "jsonl", "sarif", "markdown"])
        p.add_argument("--also", action="append", default=[], metavar="FORMAT=PATH")
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--include", action="append", default=[])
        p.add_argument("--files-from", metavar="FILE")
        p.add_argument("--diff", metavar="COMMIT")
        p.add_argument("--staged", action="store_true")
        p.add_argument("--changed-lines", action="store_true")
        p.add_argument("--stdin-name", default="<stdin>")
        p.add_argument("--baseline")
        p.add_argument("--max-file-size", type=config.parse_size)
        p.add_argument("--max-files", type=int)
        p.add_argument("--as-of")
        p.add_argument("--profile", action="store_true")
        p.add_argument("--seconds", type=float, help="that matching may take")

    for name in ("scan", "secrets", "inject"):
        p = commands.add_parser(name)
        scanning(p)
        if name == "secrets":
            p.add_argument("--history", action="store_true")
            p.add_argument("--since")
            p.add_argument("--max-commits", type=int, default=1000)
        if name == "inject":
            p.add_argument("--reveal", metavar="PATH")
    actions = commands.add_parser("baseline").add_subparsers(dest="action", required=True)
    for name in ("create", "update"):
        p = actions.add_parser(name)
        scanning(p)
        p.add_argument("--out", default=".textlode/baseline.json")
        p.add_argument("--reason", default="")
        p.add_argument("--allow-critical", action="store_true")
        p.add_argument("--force", action="store_true")
        p.add_argument("--no-prune", action="store_true")
        p.add_argument("--add-new", action="store_true")
    actions = commands.add_parser("rules").add_subparsers(dest="action", required=True)
    p = actions.add_parser("list")
    p.add_argument("--packs", type=lambda x: x.split(","))
    p.add_argument("--severity-min", choices=SEVERITIES)
    p.add_argument("--kind")
    p.add_argument("--rules", action="append", default=[])
    p.add_argument("--format", choices=["table", "json", "markdown"], default="table")
    p = actions.add_parser("explain")
    p.add_argument("id")
    p.add_argument("--rules", action="append", default=[])
    p = actions.add_parser("test")
    p.add_argument("ids", nargs="*")
    p.add_argument("--fixtures")
    p.add_argument("--rules", action="append", default=[])
    p.add_argument("--slow", action="store_true")
    p.add_argument("--junit")
    p = actions.add_parser("bundle")
    p.add_argument("out")
    p.add_argument("--rules", action="append", default=[])
    commands.add_parser("version").add_argument("--format", choices=["text", "json"], default="text")
    return top


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("textlode").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def settings(args: argparse.Namespace) -> config.Config:
    known = args.config or config.find_project(args.paths[0] if args.paths and os.path.isdir(args.paths[0]) else ".")
    given = {
        "scan.packs": args.packs, "scan.fail_on": args.fail_on, "scan.min_severity": args.min_severity, "scan.min_confidence": args.min_confidence, "report.format": args.format,
        "scan.exclude": args.exclude or None, "scan.include": args.include or None, "scan.baseline": args.baseline, "scan.max_file_bytes": args.max_file_size, "scan.max_files": args.max_files,
        "rules.enable": args.enable or None, "rules.disable": args.disable or None, "rules.extra_dirs": args.rules or None,
    }
    user = os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "textlode", "config.toml")
    return config.load(known, user if os.path.isfile(user) else None, os.environ, given, trusted=bool(args.config))


def chosen(args: argparse.Namespace, conf: config.Config) -> list[Rule]:
    every = packs.load_rules(packs.SHIPPED, *conf["rules.extra_dirs"], base=RULES)
    wanted = tuple(p if "*" in p or "/" in p else p + "*" for p in conf["scan.packs"])
    if args.command == "secrets":
        wanted = ("secrets/*",)
    return select(every, wanted, tuple(conf["rules.enable"]), tuple(conf["rules.disable"]))


def inputs(spark, args: argparse.Namespace, conf: config.Config):
    """Documents and ranges, skipped (path, reason), and whether a cap cut the input short."""
    from functools import reduce

    from pyspark.sql import functions as F

    from .sources import readers

    parts, gone, ranges, scoped = [], [], None, []
    for root in args.paths:
        if root == "-":
            data = sys.stdin.buffer.read(conf["scan.max_stdin_bytes"] + 1)
            cut = len(data) > conf["scan.max_stdin_bytes"]
            text, encoding, fallback, reason = readers.decode(data[: conf["scan.max_stdin_bytes"]])
            parts.append(spark.createDataFrame([(args.stdin_name, text or "", encoding, fallback)], "path string, text string, encoding string, fallback boolean"))
            if cut or reason:
                gone.append(spark.createDataFrame([(args.stdin_name, "over_cap" if cut else reason)], "path string, reason string"))
            continue
        if "://" not in root and not os.path.exists(root):
            raise config.ConfigError(f"{root} is not there")
        local = "://" not in root and os.path.isdir(root)
        only = explicit = None
        ignore = []
        if local:
            if args.staged or args.diff:
                names = readers.git_changed(root, args.diff)
                if names is None:
                    raise config.ConfigError(f"git tells no changes of {root}")
                only = readers.listed(spark, names)
                if args.changed_lines:
                    text = readers.git_diff(root, args.diff) or ""
                    found = readers.hunks(spark.createDataFrame([(text,)], "text string"))
                    ranges = found if ranges is None else ranges.unionByName(found)
            elif conf["scan.respect_ignore"] and os.path.isdir(os.path.join(root, ".git")) and (names := readers.git_files(root)) is not None:
                only = readers.listed(spark, names)
            at = os.path.join(root, IGNORE_FILE)
            if conf["scan.respect_ignore"]:
                ignore += readers.BUILTIN
                if os.path.isfile(at):
                    with open(at, encoding="utf-8", errors="replace") as f:
                        told = readers.sections(f.read(1 << 20))
                    ignore += [p for p, scope in told if scope is None]
                    scoped += [x for x in told if x[1]]
            if only is None:
                walked = [(p, note) for p, note in readers.walk(root, conf["scan.follow_symlinks"])]
                only = spark.createDataFrame([(p,) for p, note in walked if note is None], "path string")
                links = [(p, note) for p, note in walked if note]
                if links:
                    gone.append(spark.createDataFrame(links, "path string, reason string"))
        elif "://" not in root:
            explicit = spark.createDataFrame([(os.path.basename(root),)], "path string")
        if args.files_from:
            with open(args.files_from, "rb") as f:
                only = readers.listed(spark, f.read((64 << 20) + 1))
        where = os.path.abspath(root) if "://" not in root else root
        docs, skipped = readers.files(spark, where if local or "://" in root else os.path.dirname(where), conf["scan.max_file_bytes"], conf["scan.max_files"], conf["scan.max_total_bytes"], ignore + conf["scan.exclude"], conf["scan.include"], explicit if explicit is not None and only is None else only, explicit)
        parts.append(docs)
        gone.append(skipped.where("reason <> 'ignored'"))
    docs = reduce(lambda a, b: a.unionByName(b), parts)
    skipped = reduce(lambda a, b: a.unionByName(b), gone) if gone else spark.createDataFrame([], "path string, reason string")
    truncated = not skipped.where(F.col("reason") == "over_cap").isEmpty()
    return docs, skipped, ranges, truncated, scoped


def run_scan(args: argparse.Namespace, low: bool = False):
    """A scan as the arguments say; low: with no thresholds, as a baseline needs it."""
    from pyspark.sql import functions as F

    from .operators import reports
    from .plans import scan as plans
    from .sources import readers

    conf = settings(args)
    rules = chosen(args, conf)
    if not rules:
        raise config.ConfigError("no rule is selected")
    spark = session()
    inject = args.command == "inject"
    history = args.command == "secrets" and args.history
    if history:
        log = readers.git_log(args.paths[0], args.since, args.max_commits)
        if log is None:
            raise config.ConfigError(f"git tells no history of {args.paths[0]}")
        runs = readers.history_documents(readers.history(spark.createDataFrame([(1, log)], "log_id int, text string")))
        docs, skipped, ranges, truncated, scoped = runs, spark.createDataFrame([], "path string, reason string"), None, False, []
    else:
        docs, skipped, ranges, truncated, scoped = inputs(spark, args, conf)
    if args.as_of:
        datetime.date.fromisoformat(args.as_of)
    options = plans.Options(
        fail_on=conf["scan.fail_on"], min_severity="info" if low else conf["scan.min_severity"], min_confidence="low" if low else conf["scan.min_confidence"],
        exposure_globs={k: conf[f"exposure.{k}"] for k in ("test", "vendored", "internet", "internal")}, severity_overrides=conf["severity.overrides"],
        allow_values=tuple(conf["secrets.allow_values"]), wildcard=conf["suppress.allow_wildcard"], skip_minified=conf["scan.skip_minified"], inject=inject, as_of=args.as_of, seconds=args.seconds,
        classify_rules=tuple((r["glob"], r.get("lang"), r.get("kind"), tuple(r.get("tags", ()))) for r in conf["classify.rules"]),
    )
    base = conf["scan.baseline"]
    baseline = reports.read_baseline(spark, base) if base and os.path.isfile(base) else None
    result = plans.scan(docs, rules, options, baseline, ranges, truncated)
    found = readers.rebased(result.findings, runs) if history else result.findings
    found = readers.without_ignored(found, scoped) if scoped else found
    result.findings = plans.sweep(found, result.secrets)
    if scoped:
        result.gated = readers.without_ignored(result.gated, scoped)
    missing = lambda kind: F.lit(None).cast(kind)
    notes = skipped.select("path", missing("int").alias("line"), F.concat(F.lit("skipped-"), F.regexp_replace("reason", "[ _]", "-")).alias("code"), missing("string").alias("rule_id"), F.lit("info").alias("level"), F.concat(F.lit("not scanned: "), F.col("reason")).alias("message"), F.lit(1).alias("n"))
    own = spark.createDataFrame([("", None, code, None, "warning", message, 1) for code, message in conf.notes], "path string, line int, code string, rule_id string, level string, message string, n int")
    result.diagnostics = result.diagnostics.unionByName(notes).unionByName(own)
    return conf, rules, docs, result


def cmd_scan(args: argparse.Namespace) -> int:
    from .operators import kernels, reports

    conf, rules, docs, result = run_scan(args)
    to: list[tuple[str, str | None]] = [(conf["report.format"], None)]
    for pair in args.also:
        format, _, path = pair.partition("=")
        if format not in reports.FORMATS or not path:
            raise config.ConfigError(f"--also {pair}: FORMAT=PATH is wanted")
        to.append((format, path))
    reports.write_all(result, rules, to, sys.stdout)
    if args.command == "inject" and args.reveal:
        with open(args.reveal, "w", encoding="utf-8") as f:
            for r in docs.select("text").toLocalIterator():
                f.write(kernels.reveal(r["text"]))
    if args.profile:
        for r in result.by_rule().collect():
            print(f"{r['hits']:8} {r['rule_id']}", file=sys.stderr)
    if result.fails(conf["scan.fail_on"]):
        return 1
    return 3 if result.truncated else 0


def cmd_baseline(args: argparse.Namespace) -> int:
    from .operators import relational, reports

    if args.action == "create" and os.path.exists(args.out) and not args.force:
        raise config.ConfigError(f"{args.out} is there; --force replaces it")
    _, _, docs, result = run_scan(args, low=True)
    if result.truncated:
        raise config.ConfigError("a cap cut the scan short; a baseline needs a whole one")
    day = args.as_of or datetime.datetime.now(datetime.timezone.utc).date().isoformat()
    os.makedirs(os.path.dirname(os.path.abspath(args.out)), exist_ok=True)
    if args.action == "create":
        n = reports.write_baseline(relational.baseline_create(result.findings, args.reason, day, args.allow_critical), args.out)
        print(f"{n} entries")
        return 0
    old = reports.read_baseline(session(), args.out)
    kept, pruned, added = relational.baseline_update(old, result.findings, docs, not args.no_prune, args.add_new, args.reason, day, args.allow_critical)
    counts = kept.count(), pruned.count(), added.count()
    reports.write_baseline(kept.unionByName(added), args.out)
    print("{} kept, {} pruned, {} added".format(*counts))
    return 0


def cmd_rules(args: argparse.Namespace) -> int:
    every = packs.load_rules(packs.SHIPPED, *args.rules, base=RULES)
    if args.action == "bundle":
        print(packs.write_bundle(every, args.out))
        return 0
    if args.action == "explain":
        rule = next((r for r in every if r.id == args.id), None)
        if rule is None:
            raise config.ConfigError(f"no rule {args.id}")
        print(json.dumps(asdict(rule), ensure_ascii=False, indent=1, default=list))
        return 0
    if args.action == "list":
        some = select(every, tuple(p if "*" in p else p + "*" for p in args.packs or ()))
        some = [r for r in some if (not args.kind or not r.kinds or args.kind in r.kinds) and (not args.severity_min or SEVERITIES.index(r.severity) >= SEVERITIES.index(args.severity_min))]
        if args.format == "json":
            print(json.dumps([asdict(r) for r in some], ensure_ascii=False, indent=1, default=list))
        elif args.format == "markdown":
            print("| Rule | Pack | Severity | Title |\n|-|-|-|-|\n" + "\n".join(f"| {r.id} | {r.pack} | {r.severity} | {r.title} |" for r in some))
        else:
            for r in some:
                print(f"{r.id:16} {r.severity:9} {r.pack:18} {r.title}")
        return 0
    some = [r for r in every if not args.ids or r.id in args.ids]
    cases = packs.evaluate(some, [c for c in packs.fixtures(args.fixtures) if not args.ids or c.rule_id in args.ids]) if args.fixtures else []
    if args.slow:
        cases += [packs.Case(r.id, "slow", "", False, error=f"slow: {p}") for r in some for p in packs.slow_patterns(r)]
    if args.junit:
        with open(args.junit, "w", encoding="utf-8") as f:
            f.write(packs.junit(cases))
    wrong = [c for c in cases if not c.right]
    for c in wrong:
        print(f"{c.rule_id} {c.name}: {c.error or f'found {c.found}'}")
    print(f"{len(cases) - len(wrong)} of {len(cases)} right")
    return 1 if wrong else 0


def main(arguments: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(arguments)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        if args.command == "version":
            print(json.dumps({"version": VERSION, "rules": packs.bundle(RULES)["hash"]}) if args.format == "json" else VERSION)
            return 0
        return {"baseline": cmd_baseline, "rules": cmd_rules}.get(args.command, cmd_scan)(args)
    except (config.ConfigError, packs.PackError, ValueError) as e:
        print(f"textlode: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"textlode: the scan failed: {type(e).__name__}: {e}", file=sys.stderr)
        return 3
