"""Writing tables as dumps: DDL, INSERT in chunks or COPY, per table or merged."""

from __future__ import annotations

import os
import shutil
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpquarry.catalog import Catalog, TableDef
from dumpquarry.dialect import quote
from dumpquarry.session import staging_path
from dumpquarry.sources.files import local

CHUNK_ROWS = 1000

# How each dialect names the portable types.
TYPE_NAMES = {
    "mysql": {"boolean": "TINYINT(1)", "byte": "TINYINT", "short": "SMALLINT", "integer": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "TEXT", "binary": "LONGBLOB", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME(6)"},
    "postgres": {"boolean": "BOOLEAN", "byte": "SMALLINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION", "string": "TEXT", "binary": "BYTEA", "date": "DATE", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMP"},
    "sqlite": {"boolean": "BOOLEAN", "byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE", "string": "TEXT", "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"},
    "mssql": {"boolean": "BIT", "byte": "SMALLINT", "short": "SMALLINT", "integer": "INT", "long": "BIGINT", "float": "REAL", "double": "FLOAT", "string": "NVARCHAR(MAX)", "binary": "VARBINARY(MAX)", "date": "DATE", "timestamp": "DATETIMEOFFSET", "timestamp_ntz": "DATETIME2(6)"},
}


def type_name(kind: T.DataType, dialect: str) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    return TYPE_NAMES[dialect].get(kind.typeName(), TYPE_NAMES[dialect]["string"])


def create_table(name: str, schema: T.StructType, dialect: str, table: TableDef | None = None) -> str:
    """CREATE TABLE with the keys of ``table``."""
    lines = [f"  {quote(f.name, dialect)} {type_name(f.dataType, dialect)}{'' if not table or (c := table.column(f.name)) is None or c.nullable else ' NOT NULL'}" for f in schema]
    if table and table.primary_key:
        lines.append(f"  PRIMARY KEY ({', '.join(quote(c, dialect) for c in table.primary_key)})")
    for fk in table.foreign_keys if table else ():
        lines.append(f"  FOREIGN KEY ({', '.join(quote(c, dialect) for c in fk.columns)}) REFERENCES {quote(fk.parent, dialect)} ({', '.join(quote(c, dialect) for c in fk.parent_columns)})")
    return f"CREATE TABLE {quote(name, dialect)} (\n" + ",\n".join(lines) + "\n)" + (" ENGINE=InnoDB" if dialect == "mysql" else "") + ";"


def header(dialect: str) -> str:
    return {"mysql": "-- MySQL dump\nSET NAMES utf8mb4;\nSET FOREIGN_KEY_CHECKS = 0;\n", "postgres": "-- PostgreSQL database dump\nSET client_encoding = 'UTF8';\n", "sqlite": "-- SQLite dump\nPRAGMA foreign_keys = OFF;\n", "mssql": "SET ANSI_NULLS ON\nGO\nSET NOCOUNT ON\nGO\n"}[dialect]


def footer(dialect: str) -> str:
    return {"mysql": "SET FOREIGN_KEY_CHECKS = 1;\n", "postgres": "", "sqlite": "PRAGMA foreign_keys = ON;\n", "mssql": "GO\n"}[dialect]


def literal_text(value: Column, kind: T.DataType, dialect: str, copy: bool = False) -> Column:
    """A column as SQL literals, or as fields of COPY lines; never null."""
    if isinstance(kind, T.BooleanType):
        yes, no = ("t", "f") if copy else ("TRUE", "FALSE") if dialect == "postgres" else ("1", "0")
        text = F.when(value, yes).otherwise(no)
    elif isinstance(kind, T.NumericType):
        text = value.cast("string")
        if isinstance(kind, (T.DoubleType, T.FloatType)):  # NaN and infinities are no numbers in SQL
            odd = F.isnan(value) | value.isin(float("inf"), float("-inf"))
            text = F.when(odd, text if copy else F.concat(F.lit("'"), text, F.lit("'")) if dialect == "postgres" else F.lit("NULL")).otherwise(text)
    elif isinstance(kind, T.BinaryType):
        digits = F.lower(F.hex(value))
        if copy:
            text = F.concat(F.lit("\\\\x"), digits)
        elif dialect == "postgres":
            text = F.concat(F.lit("'\\x"), digits, F.lit("'"))
        elif dialect == "sqlite":
            text = F.concat(F.lit("X'"), digits, F.lit("'"))
        else:
            text = F.when(digits == "", F.lit("''")).otherwise(F.concat(F.lit("0x"), digits))
    else:
        raw = value.cast("string") if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(value)
        if copy:
            for c, e in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                raw = F.replace(raw, F.lit(c), F.lit(e))
            text = raw
        else:
            escapes = (("\\", "\\\\"), ("'", "''"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"), ("\x1a", "\\Z")) if dialect == "mysql" else (("'", "''"),)
            for c, e in escapes:
                raw = F.replace(raw, F.lit(c), F.lit(e))
            quoted = F.concat(F.lit("'"), raw, F.lit("'"))
            text = F.when(raw.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("N"), quoted)).otherwise(quoted) if dialect == "mssql" else quoted
    return F.when(value.isNull(), "\\N" if copy else "NULL").otherwise(text)


def insert_statements(df: DataFrame, name: str, dialect: str, chunk: int = CHUNK_ROWS, copy: bool = False) -> DataFrame:
    """One column, ``value``: INSERT statements of up to ``chunk`` rows (or COPY blocks), made per partition without a shuffle.

    Rows are rendered by Spark's own expressions; Python only joins the texts of a chunk.
    """
    columns = ", ".join(quote(c, dialect) for c in df.columns)
    target = quote(name, dialect)
    fields = [literal_text(F.col(f"`{f.name}`"), f.dataType, dialect, copy) for f in df.schema]
    line = F.concat_ws("\t", *fields) if copy else F.concat(F.lit("("), F.concat_ws(", ", *fields), F.lit(")"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            out = []
            for i in range(0, len(rows), chunk):
                if copy:
                    out.append(f"COPY {target} ({columns}) FROM stdin;\n" + "\n".join(rows[i : i + chunk]) + "\n\\.\n")
                else:
                    out.append(f"INSERT INTO {target} ({columns}) VALUES\n" + ",\n".join(rows[i : i + chunk]) + ";")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return df.select(line.alias("value")).mapInArrow(run, "value string")


def write_dump(tables: Mapping[str, DataFrame], path: str, dialect: str, catalog: Catalog | None = None, chunk: int = CHUNK_ROWS, copy: bool = False, ddl: bool = True, transaction: bool = True, identity: bool = False) -> str:
    """One dump file of the tables in the given order, published by renaming a finished file.

    Rows are rendered on the executors into text parts in the shared folder, which are then joined in order.
    """
    final = Path(path)
    final.parent.mkdir(parents=True, exist_ok=True)
    unfinished = final.with_name(f".{final.name}.part")
    try:
        with unfinished.open("w", encoding="utf-8", newline="") as out:
            out.write(header(dialect))
            if transaction:
                out.write({"mysql": "START TRANSACTION;\n", "mssql": "BEGIN TRANSACTION;\nGO\n"}.get(dialect, "BEGIN;\n" if dialect == "postgres" else "BEGIN TRANSACTION;\n"))
            for name, df in tables.items():
                if ddl:
                    out.write(create_table(name, df.schema, dialect, catalog.get(name) if catalog else None) + "\n" + ("GO\n" if dialect == "mssql" else ""))
                if identity and dialect == "mssql":
                    out.write(f"SET IDENTITY_INSERT {quote(name, dialect)} ON;\nGO\n")
                join_parts(insert_statements(df, name, dialect, chunk, copy), out, "\nGO\n" if dialect == "mssql" else "\n")
                if identity and dialect == "mssql":
                    out.write(f"SET IDENTITY_INSERT {quote(name, dialect)} OFF;\nGO\n")
            if transaction:
                out.write("COMMIT;\n" + ("GO\n" if dialect == "mssql" else ""))
            out.write(footer(dialect))
        os.replace(unfinished, final)
    finally:
        unfinished.unlink(missing_ok=True)
    return str(final)


def join_parts(texts: DataFrame, out: TextIO, ending: str = "\n") -> None:
    """Text rows in the order of their partitions, appended to a file: written side by side into the shared folder, then joined.

    Where the shared folder is no folder of files, the rows come through the driver, a partition at a time.
    """
    spark = texts.sparkSession
    path = staging_path(spark, "parts")
    if not path.startswith("file:"):
        for r in texts.toLocalIterator(prefetchPartitions=True):
            out.write(r[0] + ending)
        return
    texts.write.option("lineSep", ending).text(path)
    folder = Path(local(path))
    for part in sorted(folder.glob("part-*")):
        with part.open(encoding="utf-8", newline="") as f:
            shutil.copyfileobj(f, out, 1 << 20)
    shutil.rmtree(folder, ignore_errors=True)


def write_tables(tables: Mapping[str, DataFrame], folder: str, dialect: str, compression: str = "none", chunk: int = CHUNK_ROWS, copy: bool = False) -> str:
    """One folder of text parts per table, written by the executors side by side: the way for tables that do not fit one file."""
    for name, df in tables.items():
        insert_statements(df, name, dialect, chunk, copy).write.mode("overwrite").option("compression", compression).text(f"{folder}/table={name}")
    return folder


def pack(folder: str, archive: str) -> str:
    """A folder as ``.tar``, ``.tar.gz``, ``.tar.bz2``, ``.tar.xz``, ``.tar.zst`` or ``.zip``, published by renaming."""
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(os.path.abspath(archive)), delete=False) as f:
        part = f.name
    names = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    if archive.endswith(".zip"):
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for p in names:
                z.write(p, p.relative_to(folder))
    elif archive.endswith(".zst"):
        import zstandard

        with open(part, "wb") as raw, zstandard.ZstdCompressor().stream_writer(raw) as stream, tarfile.open(fileobj=stream, mode="w|") as t:
            for p in names:
                t.add(p, str(p.relative_to(folder)))
    else:
        with tarfile.open(part, {"gz": "w:gz", "bz2": "w:bz2", "xz": "w:xz"}.get(archive.rpartition(".")[2], "w")) as t:
            for p in names:
                t.add(p, str(p.relative_to(folder)))
    shutil.move(part, archive)
    return archive
