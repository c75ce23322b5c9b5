"""Column profiles in one aggregation: counts, sketches, shapes, ranges; and relationships between columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpquarry.catalog import Catalog
from dumpquarry.functions import draws

#: Sketch sizes. Fixed values of the profile's format.
HLL_PRECISION, TOP_K, HISTOGRAM_BINS, RESERVOIR, PREFIX = 12, 32, 32, 1000, 64


def _common_prefix(a: Column, b: Column) -> Column:
    """The common prefix, up to :data:`PREFIX` characters, of two texts: of the smallest and the largest, that of all."""
    a, b = F.substring(a, 1, PREFIX), F.substring(b, 1, PREFIX)
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.substring(a, F.lit(1), F.coalesce(F.array_max(lengths), F.lit(0)))


def profile(df: DataFrame, columns: Sequence[str] = (), depth: str = "standard") -> DataFrame:
    """One row per column (``depth``: basic without sketches, standard with them): counts, null rate and confidence, distinct estimate, lengths, classes, numbers, times, quantiles, top values.

    A single pass with partial aggregation; every metric merges across partitions.
    """
    names = [c for c in (columns or df.columns)]
    aggs = []
    for i, c in enumerate(names):
        kind, v = df.schema[c].dataType, F.col(f"`{c}`")
        text = v.cast("string")
        parts = {
            "n": F.count("*"),
            "n_null": F.count_if(v.isNull()),
            "n_distinct": F.approx_count_distinct(text, 0.02) if depth == "basic" else F.hll_sketch_estimate(F.hll_sketch_agg(text, HLL_PRECISION)),
            "min_length": F.min(F.length(text)),
            "max_length": F.max(F.length(text)),
            "avg_length": F.avg(F.length(text)),
        }
        is_text = isinstance(kind, T.StringType)
        flag = lambda p: F.count_if(text.rlike(p)) if is_text else F.lit(None).cast("long")  # noqa: B023, E731
        parts |= {
            "n_digits": flag(r"\A[0-9]+\z"),
            "n_lower": flag(r"\A[a-z]+\z"),
            "n_upper": flag(r"\A[A-Z]+\z"),
            "n_hex": flag(r"\A[0-9a-fA-F]+\z"),
            "n_email": flag(r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"),
            "n_uuid": flag(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"),
            "n_non_ascii": flag(r"[^\x00-\x7F]"),
            "n_json": F.count_if(F.try_parse_json(text).isNotNull() & text.rlike(r"\A\s*[\[{]")) if is_text else F.lit(None).cast("long"),
            "n_timestamp": F.count_if(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}") & text.try_cast("timestamp_ntz").isNotNull()) if is_text else F.lit(None).cast("long"),
            "prefix": _common_prefix(F.min(text), F.max(text)) if is_text else F.lit(None).cast("string"),
            "suffix": F.reverse(_common_prefix(F.min(F.reverse(text)), F.max(F.reverse(text)))) if is_text else F.lit(None).cast("string"),
            "min_text": F.min(text) if is_text or kind.typeName().startswith(("timestamp", "date")) else F.lit(None).cast("string"),
            "max_text": F.max(text) if is_text or kind.typeName().startswith(("timestamp", "date")) else F.lit(None).cast("string"),
        }
        number = v.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")
        finite = F.when(~F.isnan(number), number)
        parts |= {
            "min_number": F.min(finite),
            "max_number": F.max(finite),
            "mean": F.avg(finite),
            "stddev": F.stddev(finite),
            "n_zero_or_one": F.count_if(finite.isin(0.0, 1.0)),
            "max_scale": F.max(F.length(F.regexp_extract(v.cast("decimal(38,10)").cast("string"), r"\.([0-9]*?)0*$", 1))) if isinstance(kind, T.NumericType) else F.lit(None).cast("int"),
        }
        if depth != "basic":
            parts |= {
                "quantiles": F.percentile_approx(finite, [0.5, 0.9, 0.99], 10_000),
                "histogram": F.histogram_numeric(finite, F.lit(HISTOGRAM_BINS)),
                "top": F.expr(f"approx_top_k(cast(`{c}` as string), {TOP_K})"),
            }
        aggs.append(F.struct(F.lit(c).alias("column_name"), *[p.alias(k) for k, p in parts.items()]).alias(f"c{i}"))
    wide = df.agg(*aggs)
    rows = wide.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("x")).select("x.*")
    return rows.withColumn("null_rate", F.col("n_null") / F.col("n")).withColumn("confidence", 1 - 1 / (1 + F.col("n") - F.col("n_null")))


def top_values(df: DataFrame, column: str, k: int = TOP_K) -> DataFrame:
    """The k most frequent values, exactly: value, n; ties by value."""
    return df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n")).where("value is not null").orderBy(F.desc("n"), "value").limit(k)


def reservoir(df: DataFrame, column: str, key: Column, k: int = RESERVOIR, seed: int = 42) -> DataFrame:
    """A uniform sample of k values: those whose keys have the smallest digests, mergeable and the same at each run."""
    return df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("value"), draws.digest(seed, column, key).alias("_d")).orderBy("_d", "value").limit(k).select("value")


def fk_coverage(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """How many distinct values of a column are keys of the parent: n_values, n_found, coverage."""
    values = child.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("v")).distinct()
    keys = parent.select(F.col(f"`{key}`").alias("k")).distinct()
    joined = values.join(keys, F.col("v") == F.col("k"), "left")
    return joined.agg(F.count("v").alias("n_values"), F.count("k").alias("n_found")).withColumn("coverage", F.when(F.col("n_values") > 0, F.col("n_found") / F.col("n_values")))


def temporal_order(df: DataFrame, first: str, second: str) -> DataFrame:
    """The share of rows, of those with both times, in which the first is not later than the second."""
    ok = F.col(f"`{first}`") <= F.col(f"`{second}`")
    return df.agg(F.count(ok).alias("n_pairs"), F.avg(ok.cast("int")).alias("share_ordered"))


def relationships(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """Coverage of all declared foreign keys of one column: child, column, parent, n_values, n_found, coverage."""
    parts = []
    for child, fk, parent in catalog.edges():
        target = (fk.parent_columns or catalog.get(parent).primary_key or ("",))[0]
        if child in tables and parent in tables and len(fk.columns) == 1 and target:
            parts.append(fk_coverage(tables[child], fk.columns[0], tables[parent], target).select(F.lit(child).alias("child"), F.lit(fk.columns[0]).alias("column_name"), F.lit(parent).alias("parent"), "*"))
    return reduce(DataFrame.unionByName, parts)
