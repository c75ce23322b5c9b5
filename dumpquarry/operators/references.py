"""References to records that do not exist.

Method: parent keys and child keys are tagged and united in long form, one grouping by (parent table, key)
pre-aggregates on the map side, so a key named by a third of all rows is shuffled as one row per map task;
groups without a parent, or whose parent came or went at the wrong time, are kept. The rows of the kept groups are
then found by one join, which Spark broadcasts or splits by measured size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpquarry.session import stage

STATES = ("missing", "late", "deleted")


@dataclass(frozen=True)
class Reference:
    """``table.field`` names ``parent.parent_key``. ``period`` is the child's time column, by which cases are counted.

    With ``deleted_field``, a parent whose value there is earlier than the child's ``period`` was deleted before.
    """

    table: str
    field: str
    parent: str
    period: str
    row_id: str = "id"
    parent_key: str = "id"
    loaded: str | None = "loaded_at"
    deleted_field: str | None = None


def _children(tables: Mapping[str, DataFrame], references: Sequence[Reference], parents: list[str]) -> DataFrame:
    """One row per non-null reference: ref (index), parent (index), key, row_id, loaded, at. Each child table is scanned once."""
    parts = []
    for table in dict.fromkeys(r.table for r in references):
        entries = []
        for i, r in enumerate(references):
            if r.table == table:
                entries.append(
                    F.struct(
                        F.lit(i).alias("ref"),
                        F.lit(parents.index(r.parent)).alias("parent"),
                        F.col(f"`{r.field}`").alias("key"),
                        F.col(f"`{r.row_id}`").alias("row_id"),
                        (F.col(f"`{r.loaded}`") if r.loaded else F.lit(None).cast("timestamp_ntz")).alias("loaded"),
                        F.col(f"`{r.period}`").alias("at"),
                        F.lit(r.deleted_field is not None).alias("by_deletion"),
                    )
                )
        parts.append(tables[table].select(F.inline(F.array(*entries))).where("key is not null"))
    return reduce(DataFrame.unionByName, parts)


def _parents(tables: Mapping[str, DataFrame], references: Sequence[Reference], parents: list[str]) -> DataFrame:
    parts = []
    for i, name in enumerate(parents):
        r = next(x for x in references if x.parent == name)
        deleted = next((x.deleted_field for x in references if x.parent == name and x.deleted_field), None)
        parts.append(
            tables[name].select(
                F.lit(i).alias("parent"),
                F.col(f"`{r.parent_key}`").alias("key"),
                (F.col(f"`{r.loaded}`") if r.loaded else F.lit(None).cast("timestamp_ntz")).alias("p_loaded"),
                (F.col(f"`{deleted}`") if deleted else F.lit(None).cast("timestamp_ntz")).alias("p_deleted"),
            ).where("key is not null")
        )
    return reduce(DataFrame.unionByName, parts)


def reference_groups(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """One row per (parent table, key) named by a child: whether the parent exists, since when, until when, and the children's extremes."""
    parents = list(dict.fromkeys(r.parent for r in references))
    no_time = F.lit(None).cast("timestamp_ntz")
    child = _children(tables, references, parents).select(
        "parent", "key", F.lit(0).alias("is_parent"), no_time.alias("p_loaded"), no_time.alias("p_deleted"), "loaded",
        F.when(F.col("by_deletion"), F.col("at")).alias("at"), F.lit(1).alias("n"),
    )
    parent = _parents(tables, references, parents).select(
        "parent", "key", F.lit(1).alias("is_parent"), "p_loaded", "p_deleted", no_time.alias("loaded"), no_time.alias("at"), F.lit(0).alias("n")
    )
    return (
        child.unionByName(parent)
        .groupBy("parent", "key")
        .agg(
            F.max("is_parent").alias("has_parent"),
            F.min("p_loaded").alias("p_loaded"),
            F.min("p_deleted").alias("p_deleted"),
            F.min("loaded").alias("c_loaded"),
            F.max("at").alias("c_at"),
            F.sum("n").alias("n"),
        )
        .where("n > 0")
    )


def orphan_references(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """Every broken reference: table_name, field_name, row_id, ref_state, year_month.

    ``missing``: no parent row has the key. ``late``: the parent's earliest load is later than that of the referring
    row. ``deleted``: see :class:`Reference`. Two states give two rows. Defined results: a null reference is no case;
    a null load time on either side is never ``late``; a null deletion or period time is never ``deleted``; a null
    period gives a null year_month; repeated rows count once; empty tables give no rows (an empty parent makes every
    reference ``missing``); other columns of the tables are ignored, whatever their names.
    """
    parents = list(dict.fromkeys(r.parent for r in references))
    kept = reference_groups(tables, references).where("has_parent = 0 or p_loaded > c_loaded or p_deleted < c_at").select("parent", "key", "has_parent", "p_loaded", "p_deleted")
    # written, so that its size is known before the join, and so that the join has an exchange of its own on either
    # side, without which Spark does not split the partition of a hot key
    suspect = stage(kept, "suspect")
    rows = _children(tables, references, parents).join(suspect, ["parent", "key"])
    states: list[Column] = [
        F.when(F.col("has_parent") == 0, F.lit("missing")),
        F.when(F.col("p_loaded") > F.col("loaded"), F.lit("late")),
        F.when(F.col("by_deletion") & (F.col("p_deleted") < F.col("at")), F.lit("deleted")),
    ]

    def name(attribute: str) -> Column:
        return F.element_at(F.array(*[F.lit(getattr(r, attribute)) for r in references]), F.col("ref") + 1)

    return (
        rows.select("ref", "row_id", "at", F.explode(F.array_compact(F.array(*states))).alias("ref_state"))
        .distinct()
        .select(name("table").alias("table_name"), name("field").alias("field_name"), "row_id", "ref_state", F.date_format("at", "yyyy-MM").alias("year_month"))
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """The cases of :func:`orphan_references` counted per table, field, state and month."""
    return found.groupBy("table_name", "field_name", "ref_state", "year_month").agg(F.count("*").alias("n"))
