"""Differences between two databases: schema and data."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpquarry.catalog import Catalog
from dumpquarry.dialect import quote


@dataclass
class TableChange:
    table: str
    change: str  # added, removed, modified
    details: list[str] = field(default_factory=list)


def ignored(table: str, column: str, globs: Sequence[str]) -> bool:
    """Whether ``table.column`` matches one of the globs, whatever the case."""
    return any(fnmatch.fnmatchcase(f"{table}.{column}".lower(), g.lower()) for g in globs)


def schema_diff(old: Catalog, new: Catalog, ignore: Sequence[str] = ()) -> list[TableChange]:
    """Tables and, by column, families, nullability, keys and indexes that differ."""
    out = []
    for t in old:
        if t.name not in new:
            out.append(TableChange(t.name, "removed"))
    for t in new:
        before = old.get(t.name)
        if before is None:
            out.append(TableChange(t.name, "added", [f"column {c.name} {c.sql_type}" for c in t.columns]))
            continue
        details = []
        names = {c.name.lower() for c in t.columns}
        details += [f"column {c.name} removed" for c in before.columns if c.name.lower() not in names and not ignored(t.name, c.name, ignore)]
        for c in t.columns:
            if ignored(t.name, c.name, ignore):
                continue
            was = before.column(c.name)
            if was is None:
                details.append(f"column {c.name} added {c.sql_type}")
            elif was.family != c.family:
                details.append(f"column {c.name} type {was.sql_type} -> {c.sql_type}")
            elif was.nullable != c.nullable:
                details.append(f"column {c.name} {'nullable' if c.nullable else 'not null'}")
        if before.primary_key != t.primary_key:
            details.append(f"primary key ({', '.join(before.primary_key)}) -> ({', '.join(t.primary_key)})")
        keys = lambda x: {(fk.columns, fk.parent.lower(), fk.parent_columns) for fk in x.foreign_keys}
        details += [f"foreign key ({', '.join(k[0])}) to {k[1]} added" for k in sorted(keys(t) - keys(before))]
        details += [f"foreign key ({', '.join(k[0])}) to {k[1]} removed" for k in sorted(keys(before) - keys(t))]
        details += [f"index {i[0]} added" for i in t.indexes if i not in before.indexes] + [f"index {i[0]} removed" for i in before.indexes if i not in t.indexes]
        if details:
            out.append(TableChange(t.name, "modified", details))
    return out


def row_digest(columns: Sequence[str]) -> Column:
    """A digest of the columns' values in which null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns]), 256)


def row_changes(old: DataFrame, new: DataFrame, key: Sequence[str], ignore: Sequence[str] = (), table: str = "") -> DataFrame:
    """One row per key that differs: the key columns and ``change`` (added, removed, modified).

    One full outer join on the keys over rows narrowed to key and digest. Rows without a key are not compared; of rows
    with the same key one counts, the one with the greatest digest. Without a key (empty ``key``) whole rows are the
    key, so rows are only added or removed.
    """
    columns = [c for c in new.columns if c in old.columns and not ignored(table, c, ignore)]
    key = list(key) or columns
    values = [c for c in columns if c not in key]
    null_safe = key == columns

    def narrowed(df: DataFrame, tag: str) -> DataFrame:
        if not null_safe:
            for k in key:
                df = df.where(F.col(f"`{k}`").isNotNull())
        return df.groupBy(*[F.col(f"`{k}`").alias(f"{tag}{i}") for i, k in enumerate(key)]).agg(F.max(row_digest(values)).alias(tag))

    match = F.lit(True)
    for i in range(len(key)):
        match = match & (F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) if null_safe else F.col(f"a{i}") == F.col(f"b{i}"))
    joined = narrowed(old, "a").join(narrowed(new, "b"), match, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return joined.select(*[F.coalesce(f"a{i}", f"b{i}").alias(k) for i, k in enumerate(key)], change.alias("change")).where("change is not null")


def data_diff(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], catalog: Catalog, keys: Mapping[str, Sequence[str]] | None = None, ignore: Sequence[str] = (), no_pk: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """:func:`row_changes` of each table in both, and warnings about tables without a key, which are left out unless ``no_pk``."""
    out, warnings = {}, []
    for name in new:
        if name not in old:
            continue
        table = catalog.get(name)
        key = (keys or {}).get(name) or (table.primary_key if table else ())
        if not key and not no_pk:
            warnings.append(f"{name} has no primary key")
            continue
        out[name] = row_changes(old[name], new[name], key, ignore, name)
    return out, warnings


def summary(changes: Mapping[str, DataFrame]) -> dict[str, dict[str, int]]:
    """Counts of added, removed and modified rows per table."""
    return {t: {"added": 0, "removed": 0, "modified": 0} | {r["change"]: r["count"] for r in df.groupBy("change").count().collect()} for t, df in changes.items()}


def as_text(schema: Sequence[TableChange], counts: Mapping[str, Mapping[str, int]]) -> str:
    lines = ["Schema:"] + [f"  {c.change} {c.table}" + "".join(f"\n    {d}" for d in c.details) for c in schema]
    lines += ["Data:"] + [f"  {t}: +{n['added']} -{n['removed']} ~{n['modified']}" for t, n in counts.items()]
    return "\n".join(lines) + "\n"


def as_json(schema: Sequence[TableChange], counts: Mapping[str, Mapping[str, int]]) -> str:
    return json.dumps({"schema": [asdict(c) for c in schema], "data": counts}, indent=2)


def as_sql(old: Catalog, new: Catalog, dialect: str, types: Mapping | None = None) -> str:
    """Statements that turn the old schema into the new one."""
    from dumpquarry.sinks.sqlwriter import create_table

    q = lambda n: quote(n, dialect)
    out = []
    for c in schema_diff(old, new):
        table = new.get(c.table)
        if c.change == "removed":
            out.append(f"DROP TABLE {q(c.table)};")
        elif c.change == "added":
            out.append(create_table(table.name, table.schema, dialect, table))
        else:
            before = old.get(c.table)
            for col in table.columns:
                was = before.column(col.name)
                null = "" if col.nullable else " NOT NULL"
                if was is None:
                    out.append(f"ALTER TABLE {q(c.table)} ADD COLUMN {q(col.name)} {col.sql_type}{null};")
                elif was.family != col.family or was.nullable != col.nullable:
                    if dialect == "postgres":
                        out.append(f"ALTER TABLE {q(c.table)} ALTER COLUMN {q(col.name)} TYPE {col.sql_type};")
                        if was.nullable != col.nullable:
                            out.append(f"ALTER TABLE {q(c.table)} ALTER COLUMN {q(col.name)} {'DROP' if col.nullable else 'SET'} NOT NULL;")
                    elif dialect == "sqlite":
                        out.append(f"-- SQLite cannot change {c.table}.{col.name} in place")
                    else:
                        out.append(f"ALTER TABLE {q(c.table)} {'MODIFY' if dialect == 'mysql' else 'ALTER'} COLUMN {q(col.name)} {col.sql_type}{null};")
            out += [f"ALTER TABLE {q(c.table)} DROP COLUMN {q(col.name)};" for col in before.columns if table.column(col.name) is None]
            for fk in table.foreign_keys:
                if fk not in before.foreign_keys:
                    out.append(f"ALTER TABLE {q(c.table)} ADD FOREIGN KEY ({', '.join(map(q, fk.columns))}) REFERENCES {q(fk.parent)} ({', '.join(map(q, fk.parent_columns))});")
            out += [f"CREATE INDEX {q(n)} ON {q(c.table)} ({', '.join(map(q, cols))});" for n, cols in table.indexes if (n, cols) not in before.indexes]
    return "\n".join(out) + "\n"
