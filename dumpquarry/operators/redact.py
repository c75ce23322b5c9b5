"""Redaction of columns by rules, and finding columns that need it."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpquarry.catalog import Catalog, TableDef
from dumpquarry.functions import draws, redaction

STRATEGIES = ("null", "constant", "hash", "mask", "fake", "shuffle", "skip")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a glob of ``table.column``, or of a column anywhere; it is split at its last dot. The first rule that matches holds."""

    pattern: str
    strategy: str
    value: str | None = None  # constant, mask pattern, kind of fake
    preserve_domain: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")

    def matches(self, table: str, column: str) -> bool:
        of, _, name = self.pattern.lower().rpartition(".")
        return fnmatch.fnmatchcase(column.lower(), name) and (not of or fnmatch.fnmatchcase(table.lower(), of) or fnmatch.fnmatchcase(table.lower().rpartition(".")[2], of))


def rule_for(rules: Sequence[Rule], table: str, column: str) -> Rule | None:
    return next((r for r in rules if r.matches(table, column)), None)


def _column(rule: Rule, name: str, key: Column, table: str, seed: int) -> Column:
    value = F.col(f"`{name}`")
    if rule.strategy == "null":
        return F.lit(None).cast("string")
    if rule.strategy == "constant":
        return F.when(value.isNotNull(), F.lit(rule.value))
    if rule.strategy == "hash":
        return redaction.hashed(value, rule.preserve_domain)
    if rule.strategy == "mask":
        return redaction.masked(value, rule.value or "****", seed, table, name, key)
    return redaction.fake(value, rule.value or "", seed, table, name, key)


def redact(df: DataFrame, table: str, rules: Sequence[Rule], key: Sequence[str], seed: int = 42) -> DataFrame:
    """The table with its columns redacted: one projection, but for ``shuffle``.

    A redacted column becomes a text, except that ``null`` keeps its type. ``shuffle`` deals a column's values to other
    rows: values and rows are each numbered in the order of a seeded digest and joined on the number, by range
    partitions and their counts, so no task sees all rows.
    """
    key_text = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key])
    out, shuffled = [], []
    for f in df.schema:
        rule = rule_for(rules, table, f.name)
        if rule is None or rule.strategy == "skip":
            out.append(F.col(f"`{f.name}`"))
        elif rule.strategy == "shuffle":
            shuffled.append(f.name)
            out.append(F.col(f"`{f.name}`"))
        elif rule.strategy == "null":
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            out.append(_column(rule, f.name, key_text, table, seed).alias(f.name))
    result = df.select(*out)
    for name in shuffled:
        result = shuffle_column(result, name, key, seed)
    return result


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Rows numbered 0, 1, ... in an order, without a window over everything: sorted ranges are numbered each, and shifted by the counts before them."""
    ranged = df.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id())
    from dumpquarry.session import stage

    ranged = stage(ranged, "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row per range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_o"))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + inside - 1).drop("_o", "_p", "_before")


def shuffle_column(df: DataFrame, column: str, key: Sequence[str], seed: int) -> DataFrame:
    """The values of one column dealt anew to the rows."""
    key_text = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key])
    rows = numbered(df, draws.digest(seed, "rows", column, key_text), "_i")
    values = numbered(df.select(F.col(f"`{column}`").alias("_v"), key_text.alias("_key")), draws.digest(seed, "values", column, F.col("_key")), "_i").select("_i", "_v")
    return rows.join(values, "_i").select(*[F.col("_v").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


@dataclass(frozen=True)
class Finding:
    table: str
    column: str
    rule: Rule
    confidence: str


def detect(table: str, column: str) -> Finding | None:
    """A rule for a column whose name tells of personal data. The names, rules and confidences."""
    n = column.lower()
    has = lambda *words: any(w in n for w in words)
    tests = (
        (has("email"), "hash", None, "high"),
        (has("password", "passwd"), "constant", "$2b$10$REDACTED", "high"),
        (has("ssn", "social_security"), "null", None, "high"),
        (has("tax_id") or n == "tin", "null", None, "high"),
        (has("credit_card") or n.startswith("cc_"), "mask", "****-****-****-XXXX", "high"),
        (has("phone", "mobile", "cell"), "fake", "phone", "medium"),
        (n in ("first_name", "fname"), "fake", "first_name", "high"),
        (n in ("last_name", "lname") or has("surname"), "fake", "last_name", "high"),
        ((has("name") and not has("username") and n != "name"), "fake", "name", "medium"),
        (has("address", "street") and not has("ip_address"), "fake", "address", "medium"),
        (n == "city", "fake", "city", "medium"),
        (has("zip", "postal"), "fake", "zip", "medium"),
        (has("ip_address") or n in ("ip", "ip_addr"), "fake", "ip", "medium"),
        (has("birth") or n == "dob", "fake", "date", "medium"),
        (has("company", "organization"), "fake", "company", "low"),
    )
    for hit, strategy, value, confidence in tests:
        if hit:
            return Finding(table, column, Rule(f"{table}.{column}", strategy, value, preserve_domain=has("email")), confidence)
    return None


def generate_config(catalog: Catalog) -> list[Finding]:
    """Findings of all tables, keys left out."""
    out = []
    for t in catalog:
        keys = {c for fk in t.foreign_keys for c in fk.columns} | set(t.primary_key)
        out += [f for c in t.columns if c.name not in keys and (f := detect(t.name, c.name))]
    return out


def redact_all(tables: Mapping[str, DataFrame], catalog: Catalog, rules: Sequence[Rule], seed: int = 42) -> dict[str, DataFrame]:
    def key(t: TableDef | None, df: DataFrame) -> Sequence[str]:
        return t.primary_key if t and t.primary_key else df.columns

    return {n: redact(df, n, rules, key(catalog.get(n), df), seed) for n, df in tables.items()}
