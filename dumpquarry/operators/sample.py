"""Samples of a whole database that keep foreign keys intact."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpquarry.catalog import Catalog, TableDef, is_lookup, is_system
from dumpquarry.functions import draws
from dumpquarry.session import stage


@dataclass
class SampleConfig:
    """Either ``percent`` or ``rows`` per table; ``tables`` overrides by name ({"rows": n}, {"percent": p}, {"class": c}, {"skip": True})."""

    percent: float | None = None
    rows: int | None = None
    seed: int = 42
    roots: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    lookups: str = "full"  # or "none"
    preserve_relations: bool = True
    strict: bool = False
    max_total_rows: int | None = None
    tables: Mapping[str, Mapping] = field(default_factory=dict)


@dataclass
class SampleResult:
    tables: dict[str, DataFrame]
    classes: dict[str, str]
    warnings: list[str]


def key_text(table: TableDef) -> Column:
    """The primary key (or all columns) as one text, on which the draws depend."""
    names = table.primary_key or tuple(c.name for c in table.columns)
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])


def drawn(df: DataFrame, table: TableDef, percent: float, seed: int) -> DataFrame:
    """Each row with the given chance, by its key."""
    return df.where(draws.uniform(seed, table.name, key_text(table)) < percent / 100)


def smallest(df: DataFrame, table: TableDef, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all): those with the smallest digests of their keys. Each partition hands on n rows at most."""
    order = draws.digest(seed, table.name, key_text(table))
    return df.orderBy(order, *[F.col(f"`{c.name}`") for c in table.columns]).limit(n)


def with_parents(df: DataFrame, table: TableDef, catalog: Catalog, kept: Mapping[str, DataFrame], ring: set[str]) -> DataFrame:
    """Rows each of whose non-null foreign keys names a kept row. Keys to the table itself, and between tables of a ring, are not asked."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    for i, fk in enumerate(table.foreign_keys):
        parent = catalog.get(fk.parent)
        if parent is None or parent is table or (table.name in ring and parent.name in ring):
            continue
        unset = F.lit(False)
        for c in fk.columns:
            unset = unset | F.col(f"`{c}`").isNull()
        if parent.name not in kept:
            df = df.where(unset)
            continue
        targets = fk.parent_columns or parent.primary_key
        keys = kept[parent.name].select(*[F.col(f"`{t}`").alias(f"_k{i}_{j}") for j, t in enumerate(targets)], F.lit(True).alias(f"_hit{i}")).distinct()
        match = F.lit(True)
        for j, c in enumerate(fk.columns):
            match = match & (F.col(f"`{c}`") == F.col(f"_k{i}_{j}"))
        df = df.join(keys, match, "left").where(unset | F.col(f"_hit{i}")).select(*columns)
    return df


def self_closure(sampled: DataFrame, source: DataFrame, table: TableDef) -> DataFrame:
    """The sample with all ancestors that its rows reach over keys to their own table. One join per level; ends when nothing new comes."""
    for fk in [k for k in table.foreign_keys if k.parent.lower() == table.name.lower() and len(k.columns) == 1]:
        key = (fk.parent_columns or table.primary_key)[0]
        sampled = stage(sampled, "sampled")
        frontier = sampled
        while True:
            wanted = frontier.where(F.col(f"`{fk.columns[0]}`").isNotNull()).select(F.col(f"`{fk.columns[0]}`").alias("_want")).distinct()
            wanted = wanted.join(sampled.select(F.col(f"`{key}`").alias("_have")), F.col("_want") == F.col("_have"), "left_anti")
            frontier = stage(source.join(wanted, F.col(f"`{key}`") == F.col("_want"), "left_semi"), "ancestors")
            if frontier.isEmpty():
                break
            sampled = stage(sampled.unionByName(frontier), "sampled")
    return sampled


def classify(table: TableDef, catalog: Catalog, config: SampleConfig) -> str:
    """root, lookup, system or normal. A table without parents is a root before its name is looked at."""
    own = config.tables.get(table.name, {})
    if table.name in config.roots:
        return "root"
    if own.get("class", "normal") != "normal":
        return own["class"]
    if not catalog.parents(table.name):
        return "root"
    if is_system(table.name):
        return "system"
    return "lookup" if is_lookup(table.name) else "normal"


def sample(tables: Mapping[str, DataFrame], catalog: Catalog, config: SampleConfig) -> SampleResult:
    """A sample of all tables, parents first: the foreign-key check comes before the draw, so rates multiply down the chains.

    With ``strict``, a row whose parent is in no table at all is an error. Tables of a ring of keys are drawn without
    asking for each other.
    """
    order, ring_order = catalog.topological()
    ring = set(ring_order)
    kept: dict[str, DataFrame] = {}
    result = SampleResult({}, {}, [])
    total = 0
    allowed = {t.name for t in catalog.matching(config.include, config.exclude)}
    for name in [*order, *ring_order]:
        table = catalog.get(name)
        kind = result.classes[name] = classify(table, catalog, config)
        own = config.tables.get(name, {})
        if name not in tables or name not in allowed or own.get("skip") or (kind == "system" and name not in config.roots) or (kind == "lookup" and config.lookups == "none"):
            continue
        if config.max_total_rows is not None and total >= config.max_total_rows:
            result.warnings.append(f"{name} and later tables were left out: {config.max_total_rows} rows are reached")
            break
        source = tables[name]
        if config.strict and config.preserve_relations:
            for fk in table.foreign_keys:
                parent = catalog.get(fk.parent)
                if parent and parent.name in tables and not orphans(source, tables[parent.name], fk.columns, fk.parent_columns or parent.primary_key).isEmpty():
                    raise ValueError(f"{name}.{','.join(fk.columns)} names rows that {parent.name} does not have")
        df = with_parents(source, table, catalog, kept, ring) if config.preserve_relations else source
        rows, percent = own.get("rows"), own.get("percent")
        if rows is None and percent is None:
            rows, percent = config.rows, config.percent
        left = None if config.max_total_rows is None else config.max_total_rows - total
        if kind == "lookup":
            rows, percent = None, 100.0
        if rows is not None:
            df = smallest(df, table, rows if left is None else min(rows, left), config.seed)
        elif percent is not None and percent < 100:
            df = drawn(df, table, percent, config.seed)
        if config.preserve_relations and any(fk.parent.lower() == name.lower() for fk in table.foreign_keys):
            df = self_closure(df, source, table)
        if left is not None:
            df = stage(smallest(df, table, left, config.seed), name.replace(".", "_"))
            total += df.count()
        kept[name] = result.tables[name] = df
    return result


def orphans(child: DataFrame, parent: DataFrame, columns: tuple[str, ...], targets: tuple[str, ...]) -> DataFrame:
    """Child rows whose key is set but names no parent row."""
    match, is_set = F.lit(True), F.lit(True)
    keys = parent.select(*[F.col(f"`{t}`").alias(f"_p{j}") for j, t in enumerate(targets)])
    for j, c in enumerate(columns):
        match = match & (F.col(f"`{c}`") == F.col(f"_p{j}"))
        is_set = is_set & F.col(f"`{c}`").isNotNull()
    return child.where(is_set).join(keys, match, "left_anti")
