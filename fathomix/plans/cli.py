"""python -m fathomix.plans.cli COMMAND: init, index, search, refresh, symbols, doctor, uninstall."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomix")
    p.add_argument("--index", default=".fathomix", help="folder of the index")
    p.add_argument("--format", choices=("table", "json", "list", "tree"), default="table")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "refresh"):
        sub.add_parser(name).add_argument("tree")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--directory")
    s.add_argument("--language")
    s.add_argument("--dense-weight", type=float, default=0.6)
    s.add_argument("--sparse-weight", type=float, default=0.4)
    s.add_argument("--file-pattern", action="append", default=[])
    s.add_argument("--exclude", action="append", default=[])
    for name in ("find-def", "find-refs", "callers", "callees"):
        sub.add_parser(name).add_argument("name")
    y = sub.add_parser("symbols")
    y.add_argument("path", nargs="?")
    y.add_argument("--kind")
    sub.add_parser("doctor")
    sub.add_parser("init")
    sub.add_parser("uninstall")
    return p


def show(df, form: str) -> None:
    """All rows, read partition by partition, as JSON lines, a table, a list or a tree of files."""
    rows = (r.asDict(recursive=True) for r in df.toLocalIterator())
    if form == "json":
        for r in rows:
            print(json.dumps(r, default=str, ensure_ascii=False))
        return
    if form == "tree":
        last: list[str] = []
        for path in (r["file_path"] for r in (x.asDict() for x in df.select("file_path").distinct().orderBy("file_path").toLocalIterator())):
            parts = path.split("/")
            same = next((i for i, (a, b) in enumerate(zip(parts, last, strict=False)) if a != b), min(len(parts), len(last)))
            for i in range(same, len(parts)):
                print("  " * i + parts[i])
            last = parts
        return
    print("\t".join(df.columns))
    for r in rows:
        values = ("" if v is None else str(v).replace("\t", " ").replace("\n", "\\n") for v in r.values())
        print("\t".join(values) if form == "table" else "  ".join(f"{k}: {v}" for k, v in zip(r, values, strict=True)))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession

    from fathomix.plans import config
    from fathomix.plans.engine import Engine

    engine = Engine(SparkSession.builder.appName("fathomix").getOrCreate(), a.index)
    if a.command in ("index", "refresh"):
        print(getattr(engine, a.command)(a.tree))
    elif a.command == "search":
        show(engine.search(a.query, a.limit, a.directory, a.language, a.dense_weight, a.sparse_weight, file_patterns=a.file_pattern, exclude=a.exclude), a.format)
    elif a.command == "symbols":
        show(engine.symbols(a.path, a.kind), a.format)
    elif a.command == "doctor":
        show(engine.doctor(), a.format)
    elif a.command == "init":
        print(config.initialise(a.index))
    elif a.command == "uninstall":
        engine.clear()
    else:
        show(getattr(engine, a.command.replace("-", "_"))(a.name), a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
