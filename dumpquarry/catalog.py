"""Schema objects and the graph of foreign keys."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from dumpquarry.dialect import column_class, spark_type


@dataclass
class ColumnDef:
    name: str
    sql_type: str
    nullable: bool = True
    primary: bool = False
    default: str | None = None
    auto: bool = False

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.sql_type)

    @property
    def family(self) -> str:
        return column_class(self.sql_type)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str | None = None


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef] = field(default_factory=list)
    primary_key: tuple[str, ...] = ()
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    unique: list[tuple[str, ...]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    indexes: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, True) for c in self.columns])

    @property
    def is_junction(self) -> bool:
        """By name, or by holding little but two or more foreign keys."""
        keys = {c for fk in self.foreign_keys for c in fk.columns}
        named = any(x in self.name.lower() for x in ("_has_", "_pivot", "_link", "_map"))
        return named or (len(self.foreign_keys) >= 2 and len(keys) >= len(self.columns) - 2)


# Tables of frameworks, and of reference data, by name.
SYSTEM_PREFIXES = (
    "migrations", "failed_jobs", "job_batches", "jobs", "cache", "cache_locks", "sessions",
    "password_reset_tokens", "personal_access_tokens", "telescope_", "pulse_", "horizon_",
)
LOOKUP_TABLES = ("countries", "states", "provinces", "cities", "currencies", "languages", "timezones", "permissions", "roles", "settings")


def is_system(name: str) -> bool:
    low = name.lower()
    return any(low == p or (p.endswith("_") and low.startswith(p)) or low.startswith(p + "_") for p in SYSTEM_PREFIXES)


def is_lookup(name: str) -> bool:
    return name.lower() in LOOKUP_TABLES


class Catalog:
    """Tables by name, whatever the case, and their foreign keys as a graph. Self-references are no edges."""

    def __init__(self, tables: Iterable[TableDef] = ()) -> None:
        self.tables: dict[str, TableDef] = {}
        for t in tables:
            self.tables[t.name.lower()] = t

    def __iter__(self):
        return iter(self.tables.values())

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def get(self, name: str) -> TableDef | None:
        low = name.lower()
        if low in self.tables:
            return self.tables[low]
        return next((t for k, t in self.tables.items() if k.rpartition(".")[2] == low.rpartition(".")[2]), None)

    def names(self) -> list[str]:
        return [t.name for t in self]

    def edges(self) -> list[tuple[str, ForeignKey, str]]:
        """(child, key, parent) of keys whose parent is known and another table."""
        out = []
        for t in self:
            for fk in t.foreign_keys:
                parent = self.get(fk.parent)
                if parent and parent is not t:
                    out.append((t.name, fk, parent.name))
        return out

    def parents(self, name: str) -> list[str]:
        return sorted({p for c, _, p in self.edges() if c == name})

    def children(self, name: str) -> list[str]:
        return sorted({c for c, _, p in self.edges() if p == name})

    def topological(self) -> tuple[list[str], list[str]]:
        """Parents before children (names in order within a level), and the tables on or below a cycle, which have no such place."""
        waiting = {t.name: set(self.parents(t.name)) for t in self}
        order: list[str] = []
        while ready := sorted(n for n, ps in waiting.items() if not ps):
            for n in ready:
                order.append(n)
                del waiting[n]
            for ps in waiting.values():
                ps.difference_update(ready)
        return order, sorted(waiting)

    def cycles(self) -> list[list[str]]:
        """Sets of tables that refer to each other in a ring: strongly connected components of more than one table, and self-references."""
        reach = {t.name: self.ancestors(t.name) for t in self}
        seen: set[str] = set()
        out = []
        for n in sorted(reach):
            if n in seen:
                continue
            ring = sorted(m for m in reach[n] if n in reach[m])
            if ring:
                out.append(sorted({n, *ring}))
                seen |= {n, *ring}
        out += [[t.name] for t in self if any(self.get(fk.parent) is t for fk in t.foreign_keys) and t.name not in seen]
        return sorted(out)

    def _reach(self, name: str, step) -> set[str]:
        out: set[str] = set()
        todo = list(step(name))
        while todo:
            n = todo.pop()
            if n not in out:
                out.add(n)
                todo += step(n)
        return out

    def ancestors(self, name: str) -> set[str]:
        """Tables reached over foreign keys; the table itself only if it lies on a cycle."""
        return self._reach(name, self.parents)

    def descendants(self, name: str) -> set[str]:
        return self._reach(name, self.children)

    def focus(self, name: str, depth: int | None = None, reverse: bool = False, transitive: bool = True) -> Catalog:
        """The table with the tables it refers to (``reverse``: that refer to it), to some depth."""
        step = self.children if reverse else self.parents
        keep, wave, left = {name}, {name}, depth if depth is not None else (10**9 if transitive else 1)
        while wave and left > 0:
            wave = {m for n in wave for m in step(n)} - keep
            keep |= wave
            left -= 1
        return Catalog(t for t in self if t.name in keep)

    def matching(self, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Catalog:
        """Tables whose names match a glob of ``include`` (all if empty) and none of ``exclude``."""
        inc, exc = list(include), list(exclude)

        def hit(name: str, globs: list[str]) -> bool:
            low = name.lower()
            return any(fnmatch.fnmatchcase(low, g.lower()) or fnmatch.fnmatchcase(low.rpartition(".")[2], g.lower()) for g in globs)

        return Catalog(t for t in self if (not inc or hit(t.name, inc)) and not hit(t.name, exc))
