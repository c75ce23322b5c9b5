"""Command line: python -m dumpquarry.cli COMMAND ... over dump files."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from dumpquarry.operators import convert, diff, redact, sample, shard, statements, validate
from dumpquarry.plans import sql as shim
from dumpquarry.session import builder, ship
from dumpquarry.sinks import erd, formats, sqlwriter
from dumpquarry.sources.dump import read_dump


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dumpquarry")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, files: str = "+") -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("files", nargs=files)
        c.add_argument("--dialect", choices=("mysql", "postgres", "sqlite", "mssql"))
        return c

    command("analyze", "statements, rows and bytes per table")
    for name in ("split", "merge"):
        c = command(name, f"{name} dumps")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("--tables", nargs="*", default=[])
        c.add_argument("--exclude", nargs="*", default=[])
        if name == "split":
            c.add_argument("--only", choices=("schema", "data"))
            c.add_argument("--compression", default="none")
    c = command("convert", "another dialect")
    c.add_argument("--to", required=True, choices=("mysql", "postgres", "sqlite", "mssql"))
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--strict", action="store_true")
    command("validate", "integrity issues")
    c = command("sample", "a sample that keeps references")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--percent", type=float)
    c.add_argument("--rows", type=int)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--max-total-rows", type=int)
    c.add_argument("--strict", action="store_true")
    c = command("shard", "one tenant's rows")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--value", required=True)
    c.add_argument("--column")
    c.add_argument("--root", nargs="*", default=[])
    c = command("diff", "differences between two dumps", "*")
    c.add_argument("--format", choices=("text", "json", "sql"), default="text")
    c.add_argument("--ignore", nargs="*", default=[])
    c = command("redact", "columns by rules")
    c.add_argument("-o", "--output")
    c.add_argument("--rule", nargs="*", default=[], help="table.column=strategy[:value]")
    c.add_argument("--detect", action="store_true")
    c = command("graph", "tables and keys")
    c.add_argument("--format", choices=("dot", "mermaid", "json", "html"), default="mermaid")
    c.add_argument("--focus")
    c.add_argument("--reverse", action="store_true")
    c.add_argument("--depth", type=int)
    c = command("order", "tables, parents first")
    c.add_argument("--reverse", action="store_true")
    c = command("query", "SQL over the tables")
    c.add_argument("--sql", action="append", default=[])
    c.add_argument("--format", choices=formats.FORMATS, default="table")
    c.add_argument("--cache")
    c.add_argument("--limit", type=int, help="at most so many rows of each result; without it all")
    c = sub.add_parser("generate", help="a synthetic database from a model")
    c.add_argument("files", nargs=1)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--to", default="mysql", choices=("mysql", "postgres", "sqlite", "mssql"))
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--scale", type=float, default=1.0)
    return p


def repl(spark: SparkSession, names: Sequence[str], lines, out, limit: int | None = None) -> None:
    """SQL, and .tables .schema T .describe T .format F .count T .sample T .export F .quit"""
    form = "table"
    for line in lines:
        line = line.strip().rstrip(";")
        if not line:
            continue
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        try:
            if word in (".quit", ".exit"):
                return
            if word == ".tables":
                out.write("\n".join(names) + "\n")
            elif word in (".schema", ".describe"):
                out.write("".join(f"{f.name} {f.dataType.simpleString()}\n" for f in spark.table(rest).schema))
            elif word == ".format":
                form = rest if rest in formats.FORMATS else form
            elif word == ".count":
                out.write(f"{spark.table(rest).count()}\n")
            elif word == ".sample":
                out.write(formats.render(spark.table(rest), form, 10))
            elif word == ".export":
                target, _, query = rest.partition(" ")
                formats.write(shim.run(spark, query), target, target.rpartition(".")[2] if "." in target else "csv")
            elif word.startswith("."):
                out.write(f"unknown command {word}\n")
            else:
                formats.stream(shim.run(spark, line), form, out, limit)
        except Exception as e:  # noqa: BLE001 - the prompt goes on
            out.write(f"error: {str(e).splitlines()[0]}\n")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, stdin=sys.stdin) -> int:
    args = parser().parse_args(argv)
    spark = spark or builder("local[*]").getOrCreate()
    ship(spark)
    if args.command == "generate":
        from dumpquarry.generate import engine

        made = engine.generate(spark, engine.load_model(args.files[0]), args.seed, args.scale)
        sqlwriter.write_dump(made.tables, args.output, args.to)
        return 0
    if args.command == "diff":
        if len(args.files) != 2:
            raise SystemExit("diff takes two dumps")
        old, new = (read_dump(spark, f, args.dialect) for f in args.files)
        if args.format == "sql":
            out.write(diff.as_sql(old.catalog, new.catalog, new.dialect))
            return 0
        changes, warnings = diff.data_diff({t.name: old.table(t.name) for t in old.catalog}, {t.name: new.table(t.name) for t in new.catalog}, new.catalog, ignore=args.ignore)
        counts = diff.summary(changes)
        schema = diff.schema_diff(old.catalog, new.catalog, args.ignore)
        out.write((diff.as_json if args.format == "json" else diff.as_text)(schema, counts) + ("\n" if args.format == "json" else ""))
        sys.stderr.write("".join(f"warning: {w}\n" for w in warnings))
        return int(bool(schema or any(any(n.values()) for n in counts.values())))
    if args.command == "merge":
        dumps = [read_dump(spark, f, args.dialect) for f in args.files]
        statements.merge(dumps, args.output, dumps[0].dialect, include=args.tables, exclude=args.exclude)
        return 0
    dump = read_dump(spark, args.files, args.dialect)
    tables = lambda: {t.name: dump.table(t.name) for t in dump.catalog}
    if args.command == "analyze":
        formats.stream(statements.analyze(dump), "table", out)
    elif args.command == "split":
        statements.split(dump, args.output, args.tables, args.exclude, args.only, args.compression)
    elif args.command == "convert":
        made = convert.convert(dump, args.to, args.strict)
        convert.convert_to_file(made, args.output, args.to)
        for r in made.selectExpr("explode(warnings) as w").distinct().limit(1000).collect():
            sys.stderr.write(f"warning: {r.w}\n")
    elif args.command == "validate":
        found = validate.issues(tables(), dump.catalog, dump.statements())
        formats.stream(validate.report(found), "table", out)
        formats.stream(validate.summary(found), "table", out)
        return int(not found.where("severity = 'error'").isEmpty())
    elif args.command == "sample":
        r = sample.sample(tables(), dump.catalog, sample.SampleConfig(args.percent, args.rows, args.seed, strict=args.strict, max_total_rows=args.max_total_rows))
        sqlwriter.write_dump(r.tables, args.output, dump.dialect, dump.catalog)
        sys.stderr.write("".join(f"warning: {w}\n" for w in r.warnings))
    elif args.command == "shard":
        r = shard.shard(tables(), dump.catalog, shard.ShardConfig(args.value, args.column, tuple(args.root)))
        sqlwriter.write_dump(r.tables, args.output, dump.dialect, dump.catalog)
    elif args.command == "redact":
        found = redact.generate_config(dump.catalog)
        if args.detect:
            out.write("".join(f"{f.table}.{f.column}={f.rule.strategy}{':' + f.rule.value if f.rule.value else ''} ({f.confidence})\n" for f in found))
            return 0
        rules = [redact.Rule(r.partition("=")[0], *[x or None for x in r.partition("=")[2].partition(":")[::2]]) for r in args.rule] or [f.rule for f in found]
        sqlwriter.write_dump(redact.redact_all(tables(), dump.catalog, rules), args.output, dump.dialect, dump.catalog)
    elif args.command == "graph":
        catalog = dump.catalog.focus(args.focus, args.depth, args.reverse) if args.focus else dump.catalog
        out.write({"dot": erd.to_dot, "mermaid": erd.to_mermaid, "json": erd.to_json, "html": erd.to_html}[args.format](catalog) + ("\n" if args.format == "json" else ""))
    elif args.command == "order":
        out.write("\n".join(statements.order(dump.catalog, args.reverse)) + "\n")
    elif args.command == "query":
        names = dump.register(cache=args.cache)
        if args.sql:
            for text in args.sql:
                formats.stream(shim.run(spark, text), args.format, out, args.limit)
        else:
            repl(spark, names, stdin, out, args.limit)
    return 0


#: What the JSON outputs hold, as JSON Schemas.
SCHEMAS = {
    "diff": {"type": "object", "required": ["schema", "data"], "properties": {"schema": {"type": "array", "items": {"type": "object", "required": ["table", "change", "details"]}}, "data": {"type": "object", "additionalProperties": {"type": "object", "required": ["added", "removed", "modified"]}}}},
    "graph": {"type": "object", "required": ["tables", "edges", "order", "unordered", "cycles"]},
}


def schemas() -> str:
    return json.dumps(SCHEMAS, indent=2)


__all__ = ["SCHEMAS", "main", "parser", "repl", "schemas"]

if __name__ == "__main__":
    sys.exit(main())
