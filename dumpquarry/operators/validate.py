"""Integrity checks of a database: keys, references, encoding, missing tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dumpquarry.catalog import Catalog
from dumpquarry.operators.sample import orphans

ISSUES_PER_TABLE = 5
MAX_ISSUES = 1000
SCHEMA = "code string, severity string, table_name string, column_name string, key_text string, n long"


def duplicate_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that more than one row has, with ``n_rows``; keys with a null part are not checked. Counted on the map side first."""
    present = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in key])
    return df.where(present).groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def invalid_utf8(df: DataFrame) -> DataFrame:
    """Per text column the number of values that are no valid UTF-8: column_name, n."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, n long")
    counted = df.agg(*[F.sum(F.when(~F.is_valid_utf8(F.col(f"`{c}`")) | F.col(f"`{c}`").contains("�"), 1).otherwise(0)).alias(c) for c in texts])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in texts])).alias("x")).select("x.*").where("n > 0")


def missing_tables(statements: DataFrame) -> DataFrame:
    """Tables that get rows but are never created, from a dump's statements: table_name, n."""
    last = F.lower(F.element_at(F.split("table_name", r"\."), -1))
    named = statements.where("table_name is not null").select(last.alias("table_name"), (F.col("kind") == "create_table").cast("int").alias("made"), F.col("kind").isin("insert", "copy").cast("int").alias("filled"))
    return named.groupBy("table_name").agg(F.max("made").alias("made"), F.sum("filled").alias("n")).where("made = 0 and n > 0").select("table_name", "n")


def issues(tables: Mapping[str, DataFrame], catalog: Catalog, statements: DataFrame | None = None) -> DataFrame:
    """All issues, one row per duplicate key and per missing parent key, with the number of rows concerned.

    Codes: DUPLICATE_PK, FK_MISSING_PARENT, DDL_MISSING_TABLE, ENCODING (a warning).
    """
    spark = next(iter(tables.values())).sparkSession
    parts = [spark.createDataFrame([], SCHEMA)]

    def key_text(columns):
        return F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in columns])

    for t in catalog:
        if t.name not in tables:
            continue
        df = tables[t.name]
        if t.primary_key:
            parts.append(duplicate_keys(df, t.primary_key).select(F.lit("DUPLICATE_PK"), F.lit("error"), F.lit(t.name), F.lit(",".join(t.primary_key)), key_text(t.primary_key), F.col("n_rows")))
        for fk in t.foreign_keys:
            parent = catalog.get(fk.parent)
            if parent and parent.name in tables and (fk.parent_columns or parent.primary_key):
                # distinct keys are looked up, not rows: a key that a third of all rows share is one row here
                keys = df.groupBy(*[F.col(f"`{c}`") for c in fk.columns]).agg(F.count("*").alias("n_rows"))
                lost = orphans(keys, tables[parent.name], fk.columns, fk.parent_columns or parent.primary_key)
                parts.append(lost.select(F.lit("FK_MISSING_PARENT"), F.lit("error"), F.lit(t.name), F.lit(",".join(fk.columns)), key_text(fk.columns), F.col("n_rows")))
        parts.append(invalid_utf8(df).select(F.lit("ENCODING"), F.lit("warning"), F.lit(t.name), F.col("column_name"), F.lit(None).cast("string"), F.col("n")))
    if statements is not None:
        parts.append(missing_tables(statements).select(F.lit("DDL_MISSING_TABLE"), F.lit("error"), F.col("table_name"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("n")))
    return reduce(DataFrame.union, parts).toDF(*[c.split()[0] for c in SCHEMA.split(", ")])


def report(found: DataFrame, per_table: int = ISSUES_PER_TABLE, total: int = MAX_ISSUES) -> DataFrame:
    """The first issues of each table and code, for people to read; counts stay whole in :func:`summary`."""
    w = Window.partitionBy("code", "table_name", "column_name").orderBy("key_text")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_table).drop("_n").orderBy("code", "table_name", "column_name", "key_text").limit(total)


def summary(found: DataFrame) -> DataFrame:
    """Per code and table: number of issues and of rows concerned."""
    return found.groupBy("code", "table_name").agg(F.count("*").alias("n_issues"), F.sum("n").alias("n_rows"))
