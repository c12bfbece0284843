"""Commands over one source tree: ``python -m codeloom.cli COMMAND [FOLDER] [options]``; the exit code says whether it passed."""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from codeloom.plans import replies
from codeloom.plans.analyze import Analysis
from codeloom.sources.config import Config

COMMANDS = ("report", "analyze", "dead-code", "health", "isolated", "duplicates", "hubs", "functions")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("command", choices=COMMANDS, nargs="?", default="report")
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--config")
    p.add_argument("--entry", help="entry point of the critical path in the report")
    p.add_argument("--format", choices=("text", "json", "ntriples", "stats"), default="text")
    p.add_argument("--output", help="file or, for graph formats, folder to write to")
    p.add_argument("--threshold", type=int, help="least occurrences of a duplicate (2), or dependents of a hub (5)")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--include-common", action="store_true")
    p.add_argument("--similar", type=float, help="also list names at least this similar")
    p.add_argument("--log", help="file that messages are appended to")
    p.add_argument("--dynamic", action="store_true", help="count import() expressions")
    return p


def log_to(file: str | None, most_bytes: int = 10_000_000, kept: int = 5) -> None:
    """Messages go to standard error and, if named, to a file that begins anew at so many bytes; older ones are kept."""
    log = logging.getLogger("codeloom")
    log.setLevel(logging.INFO)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=most_bytes, backupCount=kept, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers = handlers


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[str, bool]:
    """A command's text, and whether it passed."""
    config = Config.load(args.config, folder=args.folder)
    duplicates = args.command == "duplicates"
    threshold = args.threshold if args.threshold is not None else 2 if duplicates else 5
    a = Analysis.of(
        spark, args.folder, config, args.dynamic, threshold=threshold if duplicates else 2, ignore_common=not args.include_common
    )
    if args.command == "report":
        return replies.report(a, args.entry), a.passed()["report"]
    if args.command == "analyze":
        if args.format != "text":
            a.write(args.format, args.output or f"{args.folder}/graph")
            return f"written as {args.format}", True
        return replies.graph_size(a), True
    if args.command == "dead-code":
        return replies.dead_code(a, "text"), a.passed()["dead_code"]
    if args.command == "health":
        return replies.health(a), a.passed()["health"]
    if args.command == "isolated":
        return replies.isolated(a), True
    if args.command == "hubs":
        return replies.hubs(a, threshold, args.limit), True
    if args.command == "functions":
        return replies.functions(a, show_files=True), True
    text = replies.duplicates_json(a) if args.format == "json" else replies.duplicates(a, args.similar)
    return text, a.passed()["duplicates"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    log_to(args.log)
    spark = SparkSession.builder.appName("codeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    text, passed = run(args, spark)
    if args.output and args.format in ("text", "json") and not (args.command == "analyze" and args.format == "json"):
        Path(args.output).write_text(text, "utf-8")
    else:
        sys.stdout.write(text + "\n")
    return 0 if passed else 1


if __name__ == "__main__":
    sys.exit(main())
