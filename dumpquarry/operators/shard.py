"""One tenant's rows out of a database, over foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpquarry.catalog import Catalog, is_lookup, is_system
from dumpquarry.operators.sample import orphans

# Names under which tenant columns are looked for, in this order.
TENANT_COLUMNS = ("company_id", "tenant_id", "organization_id", "org_id", "account_id", "team_id", "workspace_id")


@dataclass
class ShardConfig:
    value: object
    column: str | None = None
    roots: tuple[str, ...] = ()
    lookups: str = "full"  # or "none"
    unknown: str = "none"  # or "all"
    strict: bool = False
    classes: Mapping[str, str] = field(default_factory=dict)


@dataclass
class ShardResult:
    tables: dict[str, DataFrame]
    classes: dict[str, str]
    column: str


def tenant_column(catalog: Catalog, names: Sequence[str] = TENANT_COLUMNS) -> str | None:
    """The first of the names that at least two tables have."""
    return next((n for n in names if sum(t.column(n) is not None for t in catalog) >= 2), None)


def classify(catalog: Catalog, config: ShardConfig, column: str) -> dict[str, str]:
    """root, dependent, junction, system, lookup or unknown, by table."""
    roots = {t.name for t in catalog if (t.name in config.roots if config.roots else t.column(column) is not None)}
    reached = {d for r in roots for d in catalog.descendants(r)}
    out = {}
    for t in catalog:
        if t.name in config.classes:
            out[t.name] = config.classes[t.name]
        elif t.name in roots:
            out[t.name] = "root"
        elif t.name in reached:
            out[t.name] = "junction" if t.is_junction else "dependent"
        else:
            out[t.name] = "system" if is_system(t.name) else "lookup" if is_lookup(t.name) else "unknown"
    return out


def shard(tables: Mapping[str, DataFrame], catalog: Catalog, config: ShardConfig) -> ShardResult:
    """Root rows of the tenant, and rows of which any foreign key names a selected row, parents first.

    Each parent's selected keys are joined as one distinct set with a marker, and the markers are OR-ed, so a row comes
    out once however many parents select it. With ``strict``, rows whose parents are in no table are an error.
    """
    column = config.column or tenant_column(catalog)
    if column is None:
        raise ValueError("no tenant column is given or found")
    classes = classify(catalog, config, column)
    order, ring = catalog.topological()
    selected: dict[str, DataFrame] = {}
    for name in [*order, *ring]:
        table, kind = catalog.get(name), classes[name]
        if name not in tables or kind == "system" or (kind == "lookup" and config.lookups == "none") or (kind == "unknown" and config.unknown != "all"):
            continue
        df = tables[name]
        if kind == "root" and table.column(column) is not None:
            df = df.where(F.col(f"`{column}`") == F.lit(config.value))
        elif kind == "root":
            df = df.where(F.col(f"`{(table.primary_key or (table.columns[0].name,))[0]}`") == F.lit(config.value))
        elif kind in ("dependent", "junction"):
            df = any_parent(df, name, catalog, selected)
        if config.strict:
            for fk in table.foreign_keys:
                parent = catalog.get(fk.parent)
                if parent and parent.name in tables and not orphans(df, tables[parent.name], fk.columns, fk.parent_columns or parent.primary_key).isEmpty():
                    raise ValueError(f"{name}.{','.join(fk.columns)} names rows that {parent.name} does not have")
        selected[name] = df
    return ShardResult(selected, classes, column)


def any_parent(df: DataFrame, name: str, catalog: Catalog, selected: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of which at least one foreign key names a selected row of another table."""
    table = catalog.get(name)
    columns = [F.col(f"`{c}`") for c in df.columns]
    hit = F.lit(False)
    for i, fk in enumerate(table.foreign_keys):
        parent = catalog.get(fk.parent)
        if parent is None or parent is table or parent.name not in selected:
            continue
        targets = fk.parent_columns or parent.primary_key
        keys = selected[parent.name].select(*[F.col(f"`{t}`").alias(f"_k{i}_{j}") for j, t in enumerate(targets)], F.lit(True).alias(f"_hit{i}")).distinct()
        match = F.lit(True)
        for j, c in enumerate(fk.columns):
            match = match & (F.col(f"`{c}`") == F.col(f"_k{i}_{j}"))
        df = df.join(keys, match, "left")
        hit = hit | F.coalesce(F.col(f"_hit{i}"), F.lit(False))
    return df.where(hit).select(*columns)
