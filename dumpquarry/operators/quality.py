"""Column-level data quality profile.

Method: value-count tables, one row per column, load and value with a signed count, kept as Parquet in the shared
folder. A load adds its deltas (+ for rows that came, - for rows that were withdrawn); null rates, distinct counts,
ranges, entropy, values outside a domain and changes between loads are all derived from the maintained counts, exactly.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpquarry.session import stage, staging_path


@dataclass(frozen=True)
class Domain:
    """What is declared of a column. ``valid`` maps the column's value (and ``beside``, another column's) to a boolean Column."""

    column: str
    valid: Callable[[Column, Column], Column]
    beside: str | None = None
    share_of_values: bool = False  # compare each value's share between loads
    mean: bool = False  # compare the mean of the values within the domain between loads


USER_DOMAINS = (
    Domain("email", lambda v, _: v.rlike(r"\A[a-z0-9._+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+\z")),
    Domain("role", lambda v, _: v.isin("reader", "author", "editor", "admin"), share_of_values=True),
    Domain("deleted_at", lambda v, created: (v < F.lit(datetime.datetime(2026, 1, 1)).cast("timestamp_ntz")) & F.coalesce(v >= created, F.lit(True)), beside="created_at"),
)
POST_DOMAINS = (Domain("rating", lambda v, _: ~F.isnan(v) & (v >= 0) & (v <= 5), mean=True),)


@dataclass
class Thresholds:
    """Changes between neighbouring loads above these are reported."""

    null_share: float = 0.15
    value_share: float = 0.25
    mean: float = 0.5


def _text(value: Column, kind: T.DataType) -> Column:
    """A value as the whole text it is counted under; equal values have equal texts."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # -0.0 is 0.0
    return F.to_json(F.struct(value.alias("v"))) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def value_counts(rows: DataFrame, columns: list[str], load: str, domains: tuple[Domain, ...] = (), sign: int = 1) -> DataFrame:
    """Deltas of all loads in ``rows``: column_name, load_id, value (text, null for null), beside (text), num, ok, n.

    num is the value as a double where it is a number; ok whether it lies in its domain (true where none is declared).
    One scan, one shuffle with map-side partial counts.
    """
    kinds = {c: rows.schema[c].dataType for c in rows.columns}
    by_column = {d.column: d for d in domains}
    entries = []
    for c in columns:
        value, d = F.col(f"`{c}`"), by_column.get(c)
        beside = F.col(f"`{d.beside}`") if d and d.beside else F.lit(None)
        ok = F.when(value.isNull(), F.lit(True)).otherwise(F.coalesce(d.valid(value, beside), F.lit(False))) if d else F.lit(True)
        num = value.cast("double") if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("double")
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                _text(value, kinds[c]).alias("value"),
                beside.cast("string").alias("beside"),
                num.alias("num"),
                ok.alias("ok"),
            )
        )
    return (
        rows.select(F.col(f"`{load}`").cast("long").alias("load_id"), F.inline(F.array(*entries)))
        .groupBy("column_name", "load_id", "value", "beside")
        .agg(F.first("num").alias("num"), F.first("ok").alias("ok"), (F.count("*") * sign).alias("n"))
    )


class CountTables:
    """Persistent value-count tables of one data table: an append-only log of signed deltas in one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or staging_path(spark, "value_counts")

    def apply(self, rows: DataFrame, columns: list[str], load: str, domains: tuple[Domain, ...] = (), sign: int = 1) -> CountTables:
        """Add the deltas of the loads in ``rows``; with ``sign=-1`` withdraw them."""
        value_counts(rows, columns, load, domains, sign).write.mode("append").parquet(self.path)
        return self

    def log(self) -> DataFrame:
        """The signed deltas as they were added; a value may have several."""
        return self.spark.read.parquet(self.path)

    def deltas(self) -> DataFrame:
        """The maintained counts per load; what was withdrawn in full is gone."""
        return self.log().groupBy("column_name", "load_id", "value", "beside").agg(F.first("num").alias("num"), F.first("ok").alias("ok"), F.sum("n").alias("n")).where("n != 0")

    def compact(self) -> CountTables:
        """Fold the log into one generation, in a new folder."""
        folded = staging_path(self.spark, "value_counts")
        self.deltas().write.parquet(folded)
        self.path = folded
        return self


def profile(counts: DataFrame, upto: int | None = None) -> DataFrame:
    """Exact metrics per column and load: column_name, load_id, n_rows, null_rate, n_distinct, n_invalid, num_min, num_max, text_min, text_max, entropy.

    entropy is in bits over the non-null values. With ``upto``, one row per column covers all loads up to that one.
    ``counts`` may be maintained counts or the log of signed deltas: values withdrawn in full count for nothing. NaN is
    left out of num_min and num_max. Defined results: an all-null column has null ranges, distinct count and entropy 0;
    text ranges are whole values of the column, compared by their UTF-8 bytes.
    """
    if upto is not None:
        counts = counts.where(F.col("load_id") <= upto).withColumn("load_id", F.lit(upto).cast("long"))
    values = counts.groupBy("column_name", "load_id", "value").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("bad"), F.first("num").alias("num")).where("n != 0")
    seen = F.col("value").isNotNull()
    number = F.when(~F.isnan("num"), F.col("num"))
    return values.groupBy("column_name", "load_id").agg(
        F.sum("n").alias("n_rows"),
        (F.sum(F.when(seen, 0).otherwise(F.col("n"))) / F.sum("n")).alias("null_rate"),
        F.count(F.when(seen, 1)).alias("n_distinct"),
        F.sum("bad").alias("n_invalid"),
        F.min(number).alias("num_min"),
        F.max(number).alias("num_max"),
        F.min("value").alias("text_min"),
        F.max("value").alias("text_max"),
        F.sum(F.when(seen, F.col("n"))).alias("_m"),
        F.sum(F.when(seen, F.col("n") * F.log2("n"))).alias("_s"),
    ).withColumn("entropy", F.coalesce(F.round(F.log2("_m") - F.col("_s") / F.col("_m"), 9), F.lit(0.0))).drop("_m", "_s")


def _shifts(counts: DataFrame, domains: tuple[Domain, ...], limits: Thresholds) -> DataFrame:
    """column_name, key_id (load) of loads that differ from the one before. Differences are rounded to 12 places, beyond the noise of binary fractions."""
    kinds = {d.column: d for d in domains}
    seen = F.col("value").isNotNull()
    inside = F.col("ok") & seen & ~F.isnan("num")
    loads = counts.where("load_id is not null").groupBy("column_name", "load_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(seen, 0).otherwise(F.col("n"))).alias("nulls"),
        F.sum(F.when(inside, F.col("n"))).alias("m"),
        F.sum(F.when(inside, F.col("num").cast("decimal(18,6)") * F.col("n").cast("decimal(15,0)"))).cast("double").alias("total"),
    )
    w = Window.partitionBy("column_name").orderBy("load_id")  # one row per load, not per data row
    pairs = loads.select("*", *[F.lag(c).over(w).alias(f"{c}_0") for c in ("load_id", "n", "nulls", "total", "m")])
    share = lambda a, b: F.col(a) / F.col(b)
    by_null = F.round(F.abs(share("nulls", "n") - share("nulls_0", "n_0")), 12) > limits.null_share
    means = [c for c, d in kinds.items() if d.mean]
    by_mean = F.col("column_name").isin(*means) & (F.abs(F.round(F.col("total") / F.col("m") - F.col("total_0") / F.col("m_0"), 9)) > limits.mean) if means else F.lit(False)
    changed = pairs.where(F.col("load_id_0").isNotNull() & (by_null | F.coalesce(by_mean, F.lit(False)))).select("column_name", F.col("load_id").alias("key_id"))
    shares = [c for c, d in kinds.items() if d.share_of_values]
    if not shares:
        return changed
    # a load's share of each value comes in once as +, and once as - in the load that follows
    valued = counts.where(seen & F.col("column_name").isin(*shares) & F.col("load_id").isNotNull()).groupBy("column_name", "load_id", "value").agg(F.sum("n").alias("c"))
    steps = pairs.where(F.col("column_name").isin(*shares)).select("column_name", "load_id", F.col("load_id_0").alias("prev"), (F.col("n") - F.col("nulls")).alias("m1"), (F.col("n_0") - F.col("nulls_0")).alias("m0")).where("prev is not null and m1 > 0 and m0 > 0")
    now = valued.join(steps, ["column_name", "load_id"]).select("column_name", F.col("load_id").alias("key_id"), "value", share("c", "m1").alias("d"))
    before = valued.join(steps.withColumnRenamed("load_id", "key_id").withColumnRenamed("prev", "load_id"), ["column_name", "load_id"]).select("column_name", "key_id", "value", (-share("c", "m0")).alias("d"))
    by_value = now.unionByName(before).groupBy("column_name", "key_id", "value").agg(F.sum("d").alias("d")).where(F.round(F.abs("d"), 12) > limits.value_share).select("column_name", "key_id")
    return changed.unionByName(by_value)


def quality_cases(table_name: str, rows: DataFrame, domains: tuple[Domain, ...], key: str = "id", load: str = "load_id", limits: Thresholds | None = None, tables: CountTables | None = None) -> DataFrame:
    """Cases of one table: table_name, column_name, kind, key_id.

    ``value``: a non-null value outside its domain; its rows are found by joining the bad entries of the value-count
    table to the rows, so key_id is the row's key. ``shift``: key_id is a load that differs from the preceding one
    (:class:`Thresholds`). Defined results: NaN is outside every numeric range; null is always allowed; repeated rows
    give one ``value`` case but count for ``shift``; rows with a null load belong to no load; a column without
    non-null values in one of two loads has no shift of shares or means; the first load is no case; an empty table
    gives no rows; other columns are ignored.
    """
    columns = [d.column for d in domains]
    kept = (tables or CountTables(rows.sparkSession)).apply(rows, columns, load, domains)
    counts = kept.deltas() if tables else rows.sparkSession.read.parquet(kept.path)
    shifts = stage(_shifts(counts, domains, limits or Thresholds()), "shifts").select("column_name", F.lit("shift").alias("kind"), "key_id")
    bad = stage(counts.where("not ok and n > 0").select("column_name", "value", F.coalesce("beside", F.lit("")).alias("beside")).distinct(), "bad")
    entries = []
    for d in domains:
        beside = F.col(f"`{d.beside}`").cast("string") if d.beside else F.lit(None).cast("string")
        entries.append(F.struct(F.lit(d.column).alias("column_name"), _text(F.col(f"`{d.column}`"), rows.schema[d.column].dataType).alias("value"), F.coalesce(beside, F.lit("")).alias("beside")))
    long_form = rows.select(F.col(f"`{key}`").cast("long").alias("key_id"), F.inline(F.array(*entries))).where("value is not null")
    values = long_form.join(bad, ["column_name", "value", "beside"], "left_semi").select("column_name", F.lit("value").alias("kind"), "key_id")
    return values.unionByName(shifts).distinct().select(F.lit(table_name).alias("table_name"), "column_name", "kind", "key_id")
