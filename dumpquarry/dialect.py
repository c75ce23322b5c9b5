"""The four dump dialects: detection, quoting, escaping and column types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

DIALECTS = ("mysql", "postgres", "sqlite", "mssql")

# Marker texts and their weights for each dialect.
MARKERS = (
    ("postgres", 10, r"pg_dump|PostgreSQL database dump"),
    ("mysql", 10, r"MySQL dump|MariaDB dump"),
    ("sqlite", 10, r"SQLite"),
    ("postgres", 5, r"search_path"),
    ("mysql", 5, r"LOCK TABLES"),
    ("sqlite", 5, r"PRAGMA"),
    ("postgres", 2, r"CREATE EXTENSION"),
    ("sqlite", 2, r"BEGIN TRANSACTION"),
    ("mssql", 20, r"SET ANSI_NULLS"),
    ("mssql", 20, r"SET QUOTED_IDENTIFIER"),
    ("mssql", 10, r"IDENTITY\("),
    ("mssql", 10, r"ON \[PRIMARY\]"),
    ("mssql", 5, r"(?i:NVARCHAR)"),
    ("mssql", 5, r"(?i:\bCLUSTERED\b)"),
    ("mssql", 5, r"SET NOCOUNT"),
    ("postgres", 5, r"(?is:COPY\b.*?FROM stdin)"),
    ("mysql", 5, r"/\*!(?:40|50)"),
    ("postgres", 2, r"\$\$"),
    ("mysql", 2, r"`"),
    ("mssql", 15, r"(?im:^\s*GO\s*$)"),
    ("mssql", 10, r"\[[A-Za-z_]\w*\]"),
    ("postgres", 2, r"\[\]"),
    ("mssql", 5, r"\bN'"),
)


@dataclass(frozen=True)
class Detection:
    dialect: str
    confidence: str
    scores: dict[str, int]


def detect(head: str) -> Detection:
    """The dialect of a dump from its first 8 KB; ties fall to MySQL."""
    scores = dict.fromkeys(DIALECTS, 0)
    for dialect, weight, pattern in MARKERS:
        if re.search(pattern, head[:8192]):
            scores[dialect] += weight
    best = max(DIALECTS, key=lambda d: scores[d])  # the first of equals is MySQL
    top = scores[best]
    return Detection(best, "high" if top >= 10 else "medium" if top >= 5 else "low", scores)


def quote(name: str, dialect: str) -> str:
    """An identifier in the dialect's quotes; dotted names are quoted part by part."""
    if "." in name:
        return ".".join(quote(p, dialect) for p in name.split("."))
    if dialect == "mysql":
        return "`" + name.replace("`", "``") + "`"
    if dialect == "mssql":
        return "[" + name.replace("]", "]]") + "]"
    return '"' + name.replace('"', '""') + '"'


def unquote(name: str) -> str:
    """A possibly quoted and qualified name without quotes."""
    parts = re.findall(r"`((?:[^`]|``)*)`|\"((?:[^\"]|\"\")*)\"|\[((?:[^\]]|\]\])*)\]|([^.\s`\"\[\]]+)", name.strip())
    return ".".join(a.replace("``", "`") or b.replace('""', '"') or c.replace("]]", "]") or d for a, b, c, d in parts)


def bare(name: str) -> str:
    """The last part of a qualified name."""
    return unquote(name).rpartition(".")[2]


def spark_type(sql_type: str) -> T.DataType:
    """The Spark type of a column type of any of the dialects."""
    t = re.sub(r"\s+", " ", sql_type.strip().lower())
    t = re.sub(r"[\[\]\"`]", "", t) if not t.endswith("[]") else t
    if t.endswith("[]") or t.startswith("array"):
        return T.StringType()
    unsigned = "unsigned" in t
    name = re.match(r"[a-z_]+(?: precision| varying| large object)?", t)
    base = name[0] if name else t
    args = [int(x) for x in re.findall(r"\d+", t[t.find("(") : t.find(")") + 1])] if "(" in t else []
    if base in ("bool", "boolean", "bit") and (not args or args[0] == 1):
        return T.BooleanType()
    if base == "tinyint" and args == [1]:
        return T.BooleanType()
    if base in ("tinyint",):
        return T.ShortType() if unsigned else T.ByteType() if "mssql" not in t else T.ShortType()
    if base in ("smallint", "int2", "smallserial", "serial2"):
        return T.IntegerType() if unsigned else T.ShortType()
    if base == "year":
        return T.ShortType()
    if base in ("int", "integer", "int4", "mediumint", "serial", "serial4"):
        return T.LongType() if unsigned else T.IntegerType()
    if base in ("bigint", "int8", "bigserial", "serial8", "rowversion_number"):
        return T.DecimalType(20, 0) if unsigned else T.LongType()
    if base in ("float", "float4", "real"):
        return T.FloatType() if base != "float" or (args and args[0] <= 24) else T.DoubleType()
    if base in ("double", "double precision", "float8"):
        return T.DoubleType()
    if base in ("money", "smallmoney"):
        return T.DecimalType(19, 4)
    if base in ("decimal", "numeric", "dec", "number"):
        p = args[0] if args else 18
        return T.DecimalType(min(p, 38), min(args[1] if len(args) > 1 else (0 if args else 3), 38))
    if base in ("blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary", "bytea", "image", "rowversion", "timestamp_binary"):
        return T.BinaryType()
    if base == "date":
        return T.DateType()
    if base in ("timestamptz", "datetimeoffset") or "with time zone" in t and base.startswith("timestamp"):
        return T.TimestampType()
    if base in ("datetime", "datetime2", "smalldatetime", "timestamp"):
        return T.TimestampNTZType()
    return T.StringType()  # texts, enum, set, json, uuid, time, interval, xml and what is unknown


def column_class(sql_type: str) -> str:
    """Int, BigInt, Text, Uuid, Decimal, DateTime, Bool or Other: the family in which schemas are compared."""
    t = sql_type.lower()
    if re.match(r"(uuid|uniqueidentifier)", t):
        return "Uuid"
    kind = spark_type(sql_type)
    if isinstance(kind, T.BooleanType):
        return "Bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "Int"
    if isinstance(kind, T.LongType):
        return "BigInt" if re.match(r"(big|int8|serial8)", t) else "Int"
    if isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
        return "BigInt" if "unsigned" in t and "int" in t else "Decimal"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) or re.match(r"(time|interval)", t):
        return "DateTime"
    if re.match(r"(char|varchar|character|text|tinytext|mediumtext|longtext|nchar|nvarchar|ntext|enum|set|clob|citext)", t):
        return "Text"
    return "Other"


_MYSQL_ESCAPES = {"\\": "\\\\", "'": "''", "\n": "\\n", "\r": "\\r", "\0": "\\0", "\x1a": "\\Z"}


def literal(value: object, dialect: str) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return ("TRUE" if value else "FALSE") if dialect == "postgres" else ("1" if value else "0")
    if isinstance(value, (bytes, bytearray)):
        return {"postgres": f"'\\x{value.hex()}'", "sqlite": f"X'{value.hex()}'"}.get(dialect, f"0x{value.hex()}" if value else "''")
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return str(value)
    text = value.isoformat(sep=" ") if hasattr(value, "hour") and hasattr(value, "year") else str(value)
    if dialect == "mysql":
        return "'" + "".join(_MYSQL_ESCAPES.get(c, c) for c in text) + "'"
    return ("N'" if dialect == "mssql" and not text.isascii() else "'") + text.replace("'", "''") + "'"


def copy_text(value: object) -> str:
    """A value as a field of a COPY line."""
    if value is None:
        return "\\N"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, (bytes, bytearray)):
        return "\\\\x" + value.hex()
    text = value.isoformat(sep=" ") if hasattr(value, "hour") and hasattr(value, "year") else str(value)
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
