"""Command line: ``index``, ``search``, ``stats``, ``list``, ``remove``, ``compact`` and grep-like matching."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from . import output
from .engine import Engine, index_folder, list_indexes
from .operators.snapshots import POINTER, SnapshotStore
from .plans.parser import build_pattern
from .sources.corpus import find_root


def default_base() -> str:
    return os.environ.get("SONDAGE_HOME") or str(Path(os.environ.get("XDG_DATA_HOME", Path.home() / ".local/share")) / "sondage")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sondage", description="Search an indexed tree of files.")
    p.add_argument("--base", default=default_base(), help="folder of all indexes")
    commands = p.add_subparsers(dest="command", required=True)
    g = commands.add_parser("grep", help="print matching lines")
    g.add_argument("pattern", nargs="?")
    g.add_argument("-e", dest="patterns", action="append", default=[], metavar="PATTERN")
    g.add_argument("-p", "--path", default=".")
    g.add_argument("-A", dest="after", type=int, default=0)
    g.add_argument("-B", dest="before", type=int, default=0)
    g.add_argument("-C", dest="context", type=int)
    g.add_argument("-i", dest="ignore_case", action="store_true")
    g.add_argument("-v", dest="invert", action="store_true")
    g.add_argument("-w", dest="word", action="store_true")
    g.add_argument("-m", dest="most", type=int, default=0)
    g.add_argument("-l", dest="files", action="store_true")
    g.add_argument("-c", dest="count", action="store_true")
    g.add_argument("--color", choices=("always", "never", "auto"), default="auto")
    s = commands.add_parser("search", help="print ranked matches")
    s.add_argument("query")
    s.add_argument("-p", "--path", default=".")
    s.add_argument("--limit", type=int, default=0)
    i = commands.add_parser("index", help="build or update an index")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    i.add_argument("--chunk-size", type=int, default=2000)
    for name, text in (("stats", "figures of an index"), ("compact", "rewrite an index as one segment"), ("remove", "delete an index")):
        commands.add_parser(name, help=text).add_argument("path", nargs="?", default=".")
    commands.add_parser("list", help="all indexes")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    args = parser().parse_args(argv)
    if args.command == "list":
        for x in list_indexes(args.base):
            out.write(f"{x['root']}{' [missing]' if x['missing'] else ''}\t{x['valid_doc_count']} files\n")
        return 0
    if args.command == "grep" and args.invert:
        sys.stderr.write("-v is not supported: an index gives matching lines only\n")
        return 2
    root = find_root(args.path, lambda p: (Path(index_folder(args.base, p)) / POINTER).exists())
    folder = index_folder(args.base, root)
    spark = spark or SparkSession.builder.appName("sondage").getOrCreate()
    if args.command == "index":
        engine = Engine.build(spark, root, folder, args.chunk_size, args.force)
        out.write(f"{engine.store.meta()['valid_doc_count']} files\n")
        return 0
    if args.command == "remove":
        SnapshotStore(spark, folder).remove()
        return 0
    engine = Engine.open(spark, folder)
    if args.command == "stats":
        out.write(json.dumps(engine.stats(), indent=1) + "\n")
    elif args.command == "compact":
        engine.compact()
    elif args.command == "search":
        for r in engine.search(args.query, args.limit).collect():
            out.write(f"{r['path']}:{r['line_number']}\t{r['score']:.3f}\n")
    else:
        patterns = ([args.pattern] if args.pattern is not None else []) + args.patterns
        if not patterns:
            parser().error("a pattern is needed")
        query = build_pattern(patterns, args.word)
        color = args.color == "always" or args.color == "auto" and out.isatty()
        if args.files:
            rows = engine.files(query, args.most, args.ignore_case).collect()
            out.write(output.file_list(rows, color))
        elif args.count:
            rows = engine.count(query, args.ignore_case).collect()
            out.write(output.counts(rows, color))
        else:
            before, after = (args.context, args.context) if args.context is not None else (args.before, args.after)
            rows = engine.grep(query, args.most, before, after, args.ignore_case).collect()
            out.write(output.content(rows, color))
        return 0 if rows else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
