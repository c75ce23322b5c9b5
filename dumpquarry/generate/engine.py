"""Models of synthetic databases: loading, compiling to DataFrames, verifying."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpquarry.generate.generators import GENERATORS, MODIFIERS, Context, KeyDomain, make_unique
from dumpquarry.generate.planners import PLANNERS, order_family

RESERVED = ("kind", "null_rate", "unique", "modifiers", "type")


def load_model(path: str | Path) -> dict:
    """A model from YAML (where PyYAML is there) or JSON; ``imports`` of other files are merged below it."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    try:
        import yaml

        model = yaml.safe_load(text)
    except ImportError:
        model = json.loads(text)
    if not isinstance(model, dict):
        raise ValueError(f"{path} holds no model")
    out: dict = {}
    for other in model.pop("imports", []):
        out = merge_models(out, load_model(path.parent / other))
    return merge_models(out, model)


def merge_models(below: Mapping, above: Mapping) -> dict:
    """Mappings are merged by key, everything else of ``above`` holds."""
    out = dict(below)
    for k, v in above.items():
        out[k] = merge_models(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def row_counts(model: Mapping, seed: int, scale: float = 1.0) -> dict[str, int]:
    """Rows per table: a number times scale (rounded up with the chance of its fraction), or ``{"children_of": parent, "mean": m, "min": a, "max": b}``, not scaled again."""
    import hashlib

    def rounded(x: float, name: str) -> int:
        u = int(hashlib.md5(f"{seed}:{name}:rows".encode()).hexdigest()[:8], 16) / 2**32
        return int(x) + (u < x - int(x))

    out: dict[str, int] = {}
    todo = dict(model["tables"])
    while todo:
        ready = [n for n, t in todo.items() if not isinstance(t.get("rows", 100), Mapping) or t["rows"]["children_of"] in out]
        if not ready:
            raise ValueError(f"row counts refer to each other: {sorted(todo)}")
        for n in ready:
            t = todo.pop(n)
            r = t.get("rows", 100)
            if isinstance(r, Mapping):
                parents = out[r["children_of"]]
                count = rounded(parents * r.get("mean", 1.0), n)
                if count < parents * r.get("min", 0):
                    raise ValueError(f"{n}: mean {r.get('mean')} is below min {r['min']}")
                if r.get("max") is not None:
                    count = min(count, parents * r["max"])
            else:
                count = rounded(r * scale, n)
            out[n] = min(count, t["max_rows"]) if "max_rows" in t else count
    return out


@dataclass
class Generated:
    tables: dict[str, DataFrame]
    counts: dict[str, int]
    model: Mapping
    domains: dict[str, KeyDomain]


def generate(spark: SparkSession, model: Mapping, seed: int = 42, scale: float = 1.0) -> Generated:
    """Every table as one projection of a range of row numbers: no table waits for another, as keys are known in closed form."""
    counts = row_counts(model, seed, scale)
    domains = {}
    for name, t in model["tables"].items():
        key = next((c for c in t.get("columns", {}).values() if c.get("kind") in ("sequence", "monotonic")), {})
        domains[name.lower()] = KeyDomain(counts[name], key.get("start", 1), key.get("step", 1))
    tables = {}
    for name, t in model["tables"].items():
        parts = max(1, min(10_000, counts[name] // 100_000))
        df = spark.range(0, counts[name], 1, parts).withColumnRenamed("id", "_row")
        planned: set[str] = set()
        for p in t.get("planners", []):
            args = {k: v for k, v in p.items() if k != "kind"}
            if p["kind"] in PLANNERS:
                planned |= {v for k, v in args.items() if isinstance(v, str) and v in t.get("columns", {})}
                planned |= {s["column"] for s in args.get("states", []) if isinstance(s, Mapping)}
        for column, spec in t.get("columns", {}).items():
            if column in planned:
                continue
            context = Context(seed, name, column, F.col("_row"), domains)
            if spec["kind"] not in GENERATORS:
                raise ValueError(f"{name}.{column}: unknown generator {spec['kind']}")
            value = GENERATORS[spec["kind"]](context, **{k: v for k, v in spec.items() if k not in RESERVED})
            for m in spec.get("modifiers", []):
                value = MODIFIERS[m["kind"]](context, value, **{k: v for k, v in m.items() if k != "kind"})
            if spec.get("null_rate"):
                value = MODIFIERS["null_rate"](context, value, spec["null_rate"])
            df = df.withColumn(column, value.cast(spec["type"]) if "type" in spec else value)
            if spec.get("unique"):
                df = make_unique(df, column, "_row")
        for i, p in enumerate(t.get("planners", [])):
            if p["kind"] not in PLANNERS:
                raise ValueError(f"{name}: unknown planner {p['kind']}")
            context = Context(seed, name, f"planner{i}", F.col("_row"), domains)
            args = {k: v for k, v in p.items() if k != "kind"}
            if p["kind"] == "relation.tenant_family":
                args.setdefault("rows", counts[name])
            for column, value in PLANNERS[p["kind"]](context, **args).items():
                df = df.withColumn(column, value)
        order = [c for c in t.get("columns", {}) if c in df.columns]
        tables[name] = df.select(*order, *[c for c in df.columns if c not in (*order, "_row")])
    for name, t in model["tables"].items():
        if family := t.get("order_family"):
            parents, lines = order_family(tables[name].select(F.col(family.get("key", "id")).alias("id")), seed, family["lines"], **{k: v for k, v in family.items() if k not in ("key", "lines")})
            tables[name] = tables[name].join(parents.withColumnRenamed("id", family.get("key", "id")), family.get("key", "id"))
            tables[family["lines"]] = lines
    return Generated(tables, counts, model, domains)


# --- verification

EXACT, SAMPLED, NOT_CHECKED = "Exact", "Sampled", "NotChecked"


@dataclass(frozen=True)
class Check:
    """A condition that must hold in each row (SQL), under a name."""

    table: str
    name: str
    condition: str


def predicate(kind: str, *columns: str, low=None, high=None, when: str | None = None) -> str:
    """SQL of a planner's promise: equation, null_when, in_range, counter_sum, non_negative, not_null_when, ordering; ``when`` guards it."""
    a, b = columns[0], columns[1] if len(columns) > 1 else None
    sql = {
        "equation": f"{a} = {b}",
        "null_when": f"{a} is null",
        "not_null_when": f"{a} is not null",
        "in_range": f"{a} is null or {a} between {low} and {high}",
        "counter_sum": f"{a} = {' + '.join(columns[1:])}",
        "non_negative": f"{a} is null or {a} >= 0",
        "ordering": f"{a} is null or {b} is null or {a} <= {b}",
    }[kind]
    return f"not ({when}) or ({sql})" if when else sql


def verify(tables: Mapping[str, DataFrame], checks: list[Check], keys: Mapping[str, tuple[str, ...]] | None = None, references: list[tuple[str, str, str, str]] | None = None, counts: Mapping[str, int] | None = None, families: list[tuple[str, str, str, str, str]] | None = None) -> DataFrame:
    """A report: table_name, check_name, status, violations. Row conditions and counts of a table take one aggregation.

    ``references``: (child, column, parent, key); ``families``: (parent, key, parent column, child, child column), whose
    sums must agree.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []

    def row(table: str, name: str, violations) -> DataFrame:
        return violations.select(F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), F.lit(EXACT).alias("status"), F.coalesce(F.col("violations"), F.lit(0)).cast("long").alias("violations"))

    for t, df in tables.items():
        own = [c for c in checks if c.table == t]
        entries = [F.struct(F.lit(c.name).alias("check_name"), F.sum(F.when(F.expr(c.condition), 0).otherwise(1)).alias("violations")) for c in own]
        if counts and t in counts:
            entries.append(F.struct(F.lit("row_count").alias("check_name"), F.abs(F.count("*") - counts[t]).alias("violations")))
        if entries:
            wide = df.agg(F.array(*[e for e in entries]).alias("x")).select(F.explode("x").alias("x"))
            parts.append(wide.select(F.lit(t).alias("table_name"), F.col("x.check_name"), F.lit(EXACT).alias("status"), F.coalesce(F.col("x.violations"), F.lit(0)).cast("long").alias("violations")))
        for key in [(keys or {}).get(t)]:
            if key:
                repeated = df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count("*").alias("n")).where("n > 1")
                parts.append(row(t, f"unique({','.join(key)})", repeated.agg(F.sum(F.col("n") - 1).alias("violations"))))
    for child, column, parent, key in references or []:
        lost = tables[child].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")
        parts.append(row(child, f"foreign_key({column})", lost.agg(F.count("*").alias("violations"))))
    for parent, key, total, child, part in families or []:
        sums = tables[child].groupBy(F.col(key).alias("_k")).agg(F.sum(part).alias("_s"))
        off = tables[parent].join(sums, F.col(key) == F.col("_k"), "left").where(~F.col(total).eqNullSafe(F.coalesce("_s", F.lit(0))))
        parts.append(row(parent, f"sum({child}.{part}) = {total}", off.agg(F.count("*").alias("violations"))))
    for t, model_checks in ((c.table, c) for c in checks if c.table not in tables):
        parts.append(spark.createDataFrame([(t, model_checks.name, NOT_CHECKED, 0)], "table_name string, check_name string, status string, violations long"))
    return reduce(DataFrame.unionByName, parts)


def distribution_check(df: DataFrame, column: str, expected: Mapping[str, float], tolerance: float) -> DataFrame:
    """Shares of the values against what was expected: value, share, expected, ok."""
    counted = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    wanted = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in expected.items()], "value string, expected double")
    joined = wanted.join(counted, "value", "full_outer").crossJoin(F.broadcast(total))
    share = F.coalesce("n", F.lit(0)) / F.col("_total")
    return joined.select("value", share.alias("share"), F.coalesce("expected", F.lit(0.0)).alias("expected"), (F.abs(share - F.coalesce("expected", F.lit(0.0))) <= tolerance).alias("ok"))


__all__ = ["Check", "Generated", "distribution_check", "generate", "load_model", "merge_models", "predicate", "row_counts", "verify"]
