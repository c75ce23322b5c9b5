"""Random decisions as pure functions of (seed, names, key): the same in every engine that has md5, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: object) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts: object) -> Column:
    """md5 of the parts joined by colons, as 32 hex digits."""
    return F.md5(F.concat_ws(":", *map(_text, parts)).cast("binary"))


def word(*parts: object, at: int = 1, digits: int = 8) -> Column:
    """A whole number of ``digits`` hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), at, digits), 16, 10).cast("long")


def uniform(*parts: object) -> Column:
    """A double in [0, 1)."""
    return word(*parts) / F.lit(4294967296.0)


def integer(low: int, high: int, *parts: object) -> Column:
    """A whole number from low to high, both included."""
    return F.floor(uniform(*parts) * F.lit(float(high - low + 1))).cast("long") + F.lit(low)


def choice(values: list, *parts: object) -> Column:
    """One of the values."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), integer(1, len(values), *parts).cast("int"))


def weighted(values: list, weights: list[float], *parts: object) -> Column:
    """One of the values, by weight."""
    total, cum, u, out = sum(weights), 0.0, uniform(*parts), None
    for v, w in zip(values[:-1], weights[:-1]):
        cum += w / total
        out = F.when(u < cum, F.lit(v)) if out is None else out.when(u < cum, F.lit(v))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def uniform_sql(*parts: str) -> str:
    """The same number in DuckDB; the parts are SQL texts."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::bigint / 4294967296.0)"


def integer_sql(low: int, high: int, *parts: str) -> str:
    return f"(floor({uniform_sql(*parts)} * {float(high - low + 1)})::bigint + {low})"
