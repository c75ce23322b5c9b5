"""Operations on a dump's statements: statistics, splitting by table, merging, ordering, content filters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpquarry.catalog import Catalog
from dumpquarry.dialect import bare
from dumpquarry.sinks.sqlwriter import footer, header, join_parts
from dumpquarry.sources.dump import Dump

SCHEMA_KINDS = ("create_table", "create_index", "alter_table", "drop_table")
DATA_KINDS = ("insert", "copy", "copy_data")


def content(statements: DataFrame, only: str | None = None) -> DataFrame:
    """``schema``: DDL statements; ``data``: INSERT and COPY; None: all."""
    kinds = {"schema": SCHEMA_KINDS, "data": DATA_KINDS}.get(only or "")
    return statements.where(F.col("kind").isin(*kinds)) if kinds else statements


def glob_match(column: Column, globs: Iterable[str]) -> Column:
    """Whether a name, or its last part, matches one of the globs, whatever the case."""
    regexes = ["".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g.lower()) for g in globs]
    if not regexes:
        return F.lit(False)
    name = F.lower(column)
    last = F.element_at(F.split(name, r"\."), -1)
    pattern = r"\A(?:" + "|".join(regexes) + r")\z"
    return F.coalesce(name.rlike(pattern) | last.rlike(pattern), F.lit(False))


def tables_like(statements: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    include, exclude = list(include), list(exclude)
    if include:
        statements = statements.where(glob_match(F.col("table_name"), include))
    return statements.where(~glob_match(F.col("table_name"), exclude)) if exclude else statements


def analyze(dump: Dump) -> DataFrame:
    """Per table: n_create, n_insert, n_copy, n_rows, n_bytes; most INSERT and COPY statements first."""
    stats = dump.statements(text=False).where("table_name is not null")
    kind = lambda *k: F.sum(F.col("kind").isin(*k).cast("long"))
    return (
        stats.groupBy("table_name")
        .agg(kind("create_table").alias("n_create"), kind("insert").alias("n_insert"), kind("copy").alias("n_copy"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        .orderBy(F.desc(F.col("n_insert") + F.col("n_copy")), "table_name")
    )


def split(dump: Dump, folder: str, include: Iterable[str] = (), exclude: Iterable[str] = (), only: str | None = None, compression: str = "none") -> str:
    """Statements into one folder per table (``table=name``), whose files, in the order of their names, hold them in the order of the dump.

    There is no shuffle: a task writes the tables of its neighbouring splits, so a large table is written by many tasks
    and there are about as many files as splits and tables together.
    """
    terminator = "\nGO" if dump.dialect == "mssql" else ";"
    placed = dump.statements(whole_copies=True).withColumn("pos", F.monotonically_increasing_id())
    chosen = tables_like(content(placed, only), include, exclude).where("table_name is not null")
    text = F.when(F.col("kind") == "copy_data", F.concat("text", F.lit("\\."))).otherwise(F.concat("text", F.lit(terminator)))
    # sorted by table and place here, the writer has nothing left to sort
    ordered = chosen.select(F.lower("table_name").alias("table"), "pos", text.alias("value")).sortWithinPartitions("table", "pos").drop("pos")
    ordered.write.mode("overwrite").option("compression", compression).partitionBy("table").text(folder)
    return folder


def merge(dumps: Iterable[Dump], path: str, dialect: str, transaction: bool = True, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> str:
    """The statements of several dumps in one file, in the order given, published by renaming."""
    import os
    from pathlib import Path

    final = Path(path)
    unfinished = final.with_name(f".{final.name}.part")
    terminator = "\nGO" if dialect == "mssql" else ";"
    with unfinished.open("w", encoding="utf-8", newline="") as out:
        out.write(header(dialect))
        if transaction:
            out.write({"mysql": "START TRANSACTION;\n", "mssql": "BEGIN TRANSACTION;\nGO\n", "sqlite": "BEGIN TRANSACTION;\n"}.get(dialect, "BEGIN;\n"))
        for d in dumps:
            chosen = tables_like(d.statements(whole_copies=True), include, exclude)
            texts = F.when(F.col("kind") == "copy_data", F.concat("text", F.lit("\\.\n"))).otherwise(F.concat("text", F.lit(terminator)))
            join_parts(chosen.where("table_name is not null").select(texts.alias("value")), out, "\n")
        if transaction:
            out.write("COMMIT;\n" + ("GO\n" if dialect == "mssql" else ""))
        out.write(footer(dialect))
    os.replace(unfinished, final)
    return str(final)


def order(catalog: Catalog, reverse: bool = False) -> list[str]:
    """Tables so that parents come first (``reverse``: last); tables on or below cycles at the end."""
    first, rest = catalog.topological()
    return [*reversed(rest), *reversed(first)] if reverse else [*first, *rest]


def ordered_statements(dump: Dump, reverse: bool = False) -> DataFrame:
    """The statements grouped by table in safe order: DDL of all tables, then data; ``pos`` is the table's place, ``at`` the statement's in the dump."""
    place = {bare(n).lower(): i for i, n in enumerate(order(dump.catalog, reverse))}
    rank = F.create_map(*[F.lit(x) for kv in place.items() for x in kv]) if place else None
    last = F.lower(F.element_at(F.split("table_name", r"\."), -1))
    group = F.when(F.col("table_name").isNull(), -1).when(F.col("kind").isin("create_table", "drop_table"), 0).when(F.col("kind").isin(*DATA_KINDS), 1).otherwise(2)
    pos = F.coalesce(F.try_element_at(rank, last), F.lit(len(place))) if rank is not None else F.lit(0)
    return dump.statements().select("*", group.alias("phase"), pos.alias("pos"), F.monotonically_increasing_id().alias("at")).orderBy("phase", "pos", "at")


def matching_views(tables: Mapping[str, DataFrame], include: Iterable[str]) -> dict[str, DataFrame]:
    """The tables whose names match."""
    names = Catalog()
    from dumpquarry.catalog import TableDef

    for n in tables:
        names.tables[n.lower()] = TableDef(n)
    return {n: tables[n] for n in names.matching(include).names()}
