"""Dumps from one dialect to another: schema, identifiers, literals, and warnings about what does not carry over."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from dumpquarry import ddl
from dumpquarry.catalog import TableDef
from dumpquarry.dialect import quote
from dumpquarry.sinks.sqlwriter import footer, header, join_parts
from dumpquarry.sources import tokenizer
from dumpquarry.sources.dump import Dump


@dataclass(frozen=True)
class Warning_:
    kind: str  # unsupported_feature, lossy_conversion, skipped_statement, copy_not_converted
    detail: str
    suggestion: str = ""


class ConversionError(ValueError):
    """In strict mode, the first thing that does not carry over."""


# The portable family of each dialect's type names, and the name each dialect has for a family.
FAMILY_OF = {
    "bool": "boolean", "boolean": "boolean", "bit": "boolean", "tinyint": "tiny", "smallint": "small", "int2": "small", "mediumint": "int", "int": "int",
    "integer": "int", "int4": "int", "bigint": "big", "int8": "big", "serial": "serial", "bigserial": "bigserial", "smallserial": "smallserial",
    "float": "float", "float4": "float", "real": "float", "double": "double", "double precision": "double", "float8": "double", "decimal": "decimal", "numeric": "decimal",
    "money": "money", "smallmoney": "money", "char": "char", "character": "char", "nchar": "char", "varchar": "varchar", "character varying": "varchar", "nvarchar": "varchar",
    "text": "text", "tinytext": "text", "mediumtext": "text", "longtext": "text", "ntext": "text", "clob": "text", "blob": "blob", "tinyblob": "blob",
    "mediumblob": "blob", "longblob": "blob", "bytea": "blob", "binary": "blob", "varbinary": "blob", "image": "blob", "rowversion": "blob", "date": "date", "time": "time",
    "datetime": "datetime", "datetime2": "datetime", "smalldatetime": "datetime", "timestamp": "datetime", "timestamp without time zone": "datetime",
    "timestamptz": "datetimetz", "timestamp with time zone": "datetimetz", "datetimeoffset": "datetimetz", "year": "small", "json": "json", "jsonb": "json",
    "uuid": "uuid", "uniqueidentifier": "uuid", "enum": "enum", "set": "enum", "interval": "interval", "xml": "text",
}
NAME_OF = {
    "mysql": {
        "boolean": "TINYINT(1)", "tiny": "TINYINT", "small": "SMALLINT", "int": "INT", "big": "BIGINT", "serial": "INT AUTO_INCREMENT", "bigserial": "BIGINT AUTO_INCREMENT",
        "smallserial": "SMALLINT AUTO_INCREMENT", "float": "FLOAT", "double": "DOUBLE", "decimal": "DECIMAL{a}", "money": "DECIMAL(19,4)", "char": "CHAR{a}", "varchar": "VARCHAR{a}",
        "text": "TEXT", "blob": "LONGBLOB", "date": "DATE", "time": "TIME", "datetime": "DATETIME", "datetimetz": "DATETIME", "json": "JSON", "uuid": "VARCHAR(36)",
        "enum": "VARCHAR(255)", "interval": "VARCHAR(255)",
    },
    "postgres": {
        "boolean": "BOOLEAN", "tiny": "SMALLINT", "small": "SMALLINT", "int": "INTEGER", "big": "BIGINT", "serial": "SERIAL", "bigserial": "BIGSERIAL", "smallserial": "SMALLSERIAL",
        "float": "REAL", "double": "DOUBLE PRECISION", "decimal": "DECIMAL{a}", "money": "DECIMAL(19,4)", "char": "CHAR{a}", "varchar": "VARCHAR{a}", "text": "TEXT", "blob": "BYTEA",
        "date": "DATE", "time": "TIME", "datetime": "TIMESTAMP", "datetimetz": "TIMESTAMPTZ", "json": "JSONB", "uuid": "UUID", "enum": "VARCHAR(255)", "interval": "INTERVAL",
    },
    "sqlite": {
        "boolean": "INTEGER", "tiny": "INTEGER", "small": "INTEGER", "int": "INTEGER", "big": "INTEGER", "serial": "INTEGER", "bigserial": "INTEGER", "smallserial": "INTEGER",
        "float": "REAL", "double": "REAL", "decimal": "REAL", "money": "REAL", "char": "TEXT", "varchar": "TEXT", "text": "TEXT", "blob": "BLOB", "date": "TEXT", "time": "TEXT",
        "datetime": "TEXT", "datetimetz": "TEXT", "json": "TEXT", "uuid": "TEXT", "enum": "TEXT", "interval": "TEXT",
    },
    "mssql": {
        "boolean": "BIT", "tiny": "SMALLINT", "small": "SMALLINT", "int": "INT", "big": "BIGINT", "serial": "INT IDENTITY(1,1)", "bigserial": "BIGINT IDENTITY(1,1)",
        "smallserial": "SMALLINT IDENTITY(1,1)", "float": "REAL", "double": "FLOAT", "decimal": "DECIMAL{a}", "money": "MONEY", "char": "NCHAR{a}", "varchar": "NVARCHAR{a}",
        "text": "NVARCHAR(MAX)", "blob": "VARBINARY(MAX)", "date": "DATE", "time": "TIME", "datetime": "DATETIME2", "datetimetz": "DATETIMEOFFSET", "json": "NVARCHAR(MAX)",
        "uuid": "UNIQUEIDENTIFIER", "enum": "NVARCHAR(255)", "interval": "NVARCHAR(255)",
    },
}


def convert_type(sql_type: str, source: str, target: str) -> tuple[str, Warning_ | None]:
    """A column type in the target's terms, and a warning if something is lost."""
    if source == target:
        return sql_type, None
    t = re.sub(r"\s+", " ", sql_type.strip().strip("[]")).lower().replace("[", "").replace("]", "" if not sql_type.endswith("[]") else "]")
    if sql_type.strip().endswith("[]"):
        return NAME_OF[target]["text"], Warning_("lossy_conversion", f"{sql_type} to {NAME_OF[target]['text']}", "arrays become text")
    m = re.match(r"([a-z_0-9]+(?: (?:precision|varying|with time zone|without time zone))?)\s*(\([^)]*\))?(.*)", t)
    base, args, rest = m[1], (m[2] or ""), m[3]
    if "with time zone" in rest:
        base = "timestamptz"
    family = FAMILY_OF.get(base)
    if family is None:
        return sql_type, Warning_("unsupported_feature", f"type {sql_type}", "kept as it is")
    if base == "tinyint" and args.replace(" ", "") == "(1)":
        family = "boolean"
    if family == "boolean" and base == "bit" and args not in ("", "(1)"):
        family = "blob"
    if args.lower() == "(max)":
        family, args = ("blob" if family == "blob" else "text"), ""
    if family == "varchar" and not args and target in ("mysql", "mssql"):
        family = "text"
    name = NAME_OF[target][family].format(a=args.replace(" ", "") if family in ("decimal", "char", "varchar") else "")
    warning = None
    if family == "enum":
        warning = Warning_("unsupported_feature", f"{base.upper()} type", "a CHECK constraint could stand in for it")
    elif "unsigned" in rest and target != "mysql":
        warning = Warning_("lossy_conversion", f"{sql_type} to {name}", "unsigned range is not kept")
    elif family in ("decimal", "money") and target == "sqlite":
        warning = Warning_("lossy_conversion", f"{sql_type} to {name}", "exact decimals become floating point")
    return name, warning


def convert_table(table: TableDef, source: str, target: str) -> tuple[str, list[Warning_]]:
    """CREATE TABLE in the target's terms. Engine, character set, comments and inline indexes are not carried over."""
    q = lambda n: quote(n, target)
    lines, warnings = [], []
    for c in table.columns:
        name, w = convert_type(c.sql_type, source, target)
        if w:
            warnings.append(Warning_(w.kind, f"{table.name}.{c.name}: {w.detail}", w.suggestion))
        auto = c.auto and not re.search(r"AUTO_INCREMENT|SERIAL|IDENTITY", name)
        if auto and target == "postgres":
            name = {"BIGINT": "BIGSERIAL", "SMALLINT": "SMALLSERIAL"}.get(name, "SERIAL")
        default = ""
        if c.default is not None and not c.auto:
            value = {"GETDATE()": "CURRENT_TIMESTAMP", "NOW()": "CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP()": "CURRENT_TIMESTAMP"}.get(c.default.strip("()").upper().rstrip("()") + "()", c.default)
            value = re.sub(r"::[\w\s]+(\([\d,]+\))?$", "", value)
            if name in ("BOOLEAN",) and value.strip("'\"b") in ("0", "1"):
                value = "TRUE" if value.strip("'\"b") == "1" else "FALSE"
            elif source == "postgres" and value.lower() in ("true", "false"):
                value = "1" if value.lower() == "true" else "0"
            default = f" DEFAULT {value}"
        suffix = " AUTO_INCREMENT" if auto and target == "mysql" else " IDENTITY(1,1)" if auto and target == "mssql" else ""
        if auto and target == "sqlite" and table.primary_key == (c.name,):
            lines.append(f"  {q(c.name)} INTEGER PRIMARY KEY AUTOINCREMENT")
            continue
        lines.append(f"  {q(c.name)} {name}{'' if c.nullable else ' NOT NULL'}{default}{suffix}")
    if table.primary_key and not any("PRIMARY KEY" in x for x in lines):
        lines.append(f"  PRIMARY KEY ({', '.join(map(q, table.primary_key))})")
    lines += [f"  UNIQUE ({', '.join(map(q, u))})" for u in dict.fromkeys(table.unique)]
    for fk in table.foreign_keys:
        to = f" ({', '.join(map(q, fk.parent_columns))})" if fk.parent_columns else ""
        lines.append(f"  FOREIGN KEY ({', '.join(map(q, fk.columns))}) REFERENCES {q(fk.parent)}{to}")
    return f"CREATE TABLE {q(table.name)} (\n" + ",\n".join(lines) + "\n)" + (" ENGINE=InnoDB DEFAULT CHARSET=utf8mb4" if target == "mysql" else ""), warnings


def _value(v: str | None, number: bool, target: str) -> str:
    if v is None:
        return "NULL"
    if v.startswith("\\x") and re.fullmatch(r"\\x[0-9A-Fa-f]*", v):
        h = v[2:]
        return {"postgres": f"'\\x{h}'", "sqlite": f"X'{h}'"}.get(target, f"0x{h}" if h else "''")
    if number and re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v):
        return v
    if target == "mysql":
        return "'" + v.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"
    if target == "postgres" and "\0" in v:
        v = v.replace("\0", "")
    return ("N'" if target == "mssql" and not v.isascii() else "'") + v.replace("'", "''") + "'"


_NUMERIC = re.compile(r"^\s*(?:tiny|small|medium|big)?(?:int|serial)|^\s*(?:decimal|numeric|float|double|real|money|bit|bool|smallmoney|int\d|float\d)", re.I)


def convert_rows(kind: str, text: str, columns: list[str] | None, table: TableDef | None, name: str, source: str, target: str, chunk: int = 1000) -> Iterator[str]:
    """INSERT statements of the target for an INSERT or the data of a COPY."""
    if kind == "insert":
        given, rows = tokenizer.insert_rows(text, source)
    else:
        width = len(columns) if columns else len(table.columns) if table else None
        given, rows = columns, tokenizer.copy_rows(text, width)
    names = given or ([c.name for c in table.columns] if table else None)
    types = [(c.sql_type if table and (c := table.column(n)) else "") for n in names] if names else None
    booleans = [bool(re.match(r"bool|tinyint\s*\(1\)|bit$", t, re.I)) for t in types] if types else None
    head = f"INSERT INTO {quote(name, target)}" + (f" ({', '.join(quote(n, target) for n in given)})" if given else "") + " VALUES\n"
    block: list[str] = []
    for row in rows:
        out = []
        for i, v in enumerate(row):
            number = bool(types and i < len(types) and _NUMERIC.match(types[i])) or (types is None and v is not None)
            if booleans and i < len(booleans) and booleans[i] and v is not None and v.lower() in ("0", "1", "t", "f", "true", "false"):
                truth = v.lower() in ("1", "t", "true")
                out.append(("TRUE" if truth else "FALSE") if target == "postgres" else ("1" if truth else "0"))
            else:
                out.append(_value(v, number, target))
        block.append("(" + ", ".join(out) + ")")
        if len(block) == chunk:
            yield head + ",\n".join(block)
            block = []
    if block:
        yield head + ",\n".join(block)


def convert_statement(kind: str, text: str, table_name: str | None, header: str | None, tables: dict[str, TableDef], source: str, target: str) -> tuple[list[str], list[Warning_]]:
    """A statement in the target's terms (none if it has none), with warnings."""
    table = tables.get((table_name or "").lower())
    name = (table_name or "").rpartition(".")[2] if source == "mssql" or target == "sqlite" else (table_name or "")
    if kind == "create_table":
        parsed = ddl.parse_create_table(text)
        if parsed is None:
            return [], [Warning_("skipped_statement", text[:60])]
        if target == "sqlite" or source == "mssql":
            parsed.name = parsed.name.rpartition(".")[2]
        out, warnings = convert_table(parsed, source, target)
        return [out], warnings
    if kind in ("insert", "copy_data"):
        return list(convert_rows(kind, text, tokenizer.copy_columns(header) if header else None, table, name, source, target)), []
    if kind == "copy":
        return [], []
    if kind == "create_index" and (m := ddl._INDEX.match(ddl.strip_comments(text))):
        unique = "UNIQUE " if m[1] else ""
        return [f"CREATE {unique}INDEX {quote(ddl.unquote(m[2]), target)} ON {quote(name, target)} ({', '.join(quote(c, target) for c in ddl._names(m[4]))})"], []
    if kind == "drop_table":
        return [f"DROP TABLE IF EXISTS {quote(name, target)}"], []
    if kind == "alter_table":
        out = []
        body = ddl.strip_comments(text)
        for fk in ddl._FK.finditer(body):
            if target == "sqlite":
                return [], [Warning_("unsupported_feature", f"late foreign key of {name}", "SQLite takes foreign keys in CREATE TABLE only")]
            out.append(f"ALTER TABLE {quote(name, target)} ADD FOREIGN KEY ({', '.join(quote(c, target) for c in ddl._names(fk[2]))}) REFERENCES {quote(ddl.unquote(fk[3]).rpartition('.')[2], target)}" + (f" ({', '.join(quote(c, target) for c in ddl._names(fk[4]))})" if fk[4] else ""))
        if (pk := ddl._PK.search(body)) and target != "sqlite":
            out.append(f"ALTER TABLE {quote(name, target)} ADD PRIMARY KEY ({', '.join(quote(c, target) for c in ddl._names(pk[1]))})")
        return out, [] if out else [Warning_("skipped_statement", text[:60])]
    return [], [] if re.match(r"\s*(?:--|/\*|SET\b|BEGIN|COMMIT|START|LOCK|UNLOCK|USE\b|GO\b|PRAGMA|SELECT pg_catalog)", text, re.I) or not text.strip() else [Warning_("skipped_statement", text[:60])]


def convert(dump: Dump, target: str, strict: bool = False) -> DataFrame:
    """All statements in the target dialect: path, start, idx, part, text (null where there is none), warnings.

    Each split is converted by one task, to which only the catalog is sent; partitions and rows are in the order of the
    statements. With ``strict``, a warning is an error.
    """
    from dumpquarry.sources.dump import _clean, split_statements
    from dumpquarry.sources.splits import Splits

    source, parts = dump.dialect, Splits(dump.spark, dump.splits)
    tables = {t.name.lower(): t for t in dump.catalog}
    arrow = pa.schema([("path", pa.string()), ("start", pa.int64()), ("idx", pa.int32()), ("part", pa.int32()), ("text", pa.string()), ("warnings", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                split = parts[n]
                copying = split.header or None
                for s in split_statements(split, source):
                    copying = s.text if s.kind == "copy" else copying
                    out, warnings = convert_statement(s.kind, s.text, s.table, copying if s.kind == "copy_data" else None, tables, source, target)
                    if strict and warnings:
                        raise ConversionError(str(warnings[0]))
                    rows = [{"path": split.path, "start": split.start, "idx": s.index, "part": i, "text": _clean(t), "warnings": [f"{w.kind}: {w.detail}" for w in warnings] if i == 0 else []} for i, t in enumerate(out or [None] * bool(warnings))]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return parts.ids().mapInArrow(run, "path string, start long, idx int, part int, text string, warnings array<string>")


def convert_to_file(made: DataFrame, path: str, target: str) -> str:
    """The statements of :func:`convert` in one file, joined from parts that the executors wrote and published by renaming."""
    final = Path(path)
    unfinished = final.with_name(f".{final.name}.part")
    with unfinished.open("w", encoding="utf-8", newline="") as out:
        out.write(header(target))
        join_parts(made.where("text is not null").select("text"), out, "\nGO\n" if target == "mssql" else ";\n")
        out.write(footer(target))
    os.replace(unfinished, final)
    return str(final)
