"""Differences between two copies of a dataset.

Method: both copies are normalised to common types; the difference EXCEPT ALL is taken in both directions by one
grouping over signed rows (a row of the first copy counts +1, of the second -1; what remains above or below zero is the
residue of either side), and the two small residues are full-joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpquarry.session import stage


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if isinstance(a, T.IntegralType) and isinstance(b, T.DecimalType):
        return _common(T.DecimalType(20, 0), b)
    if isinstance(a, T.DecimalType) and isinstance(b, T.IntegralType):
        return _common(a, T.DecimalType(20, 0))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DoubleType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return T.StringType()


def normalised(left: DataFrame, right: DataFrame, ignore: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns present in both, cast to common types (numbers and times by value); -0.0 becomes 0.0."""
    columns = [c for c in left.columns if c in right.columns and c not in ignore]
    kinds = {c: _common(left.schema[c].dataType, right.schema[c].dataType) for c in columns}

    def cast(c: str) -> Column:
        value = F.col(f"`{c}`").cast(kinds[c])
        return (value + F.lit(0.0) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else value).alias(c)

    return left.select(*map(cast, columns)), right.select(*map(cast, columns)), columns


def except_all_both(left: DataFrame, right: DataFrame, multiset: bool = False) -> DataFrame:
    """Residues of ``left EXCEPT ALL right`` and ``right EXCEPT ALL left`` in one shuffle: the columns, ``_side`` (1 left, -1 right), ``_n`` copies.

    Without ``multiset``, repeated rows of a side count once. Null equals null.
    """
    both = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    grouped = both.groupBy(*[F.col(f"`{c}`") for c in left.columns])
    if multiset:
        found = grouped.agg(F.sum("_sign").alias("_net"))
    else:
        found = grouped.agg((F.max("_sign") + F.min("_sign")).alias("_net"), F.min("_sign").alias("_low")).withColumn(
            "_net", F.when(F.col("_net") == 0, 0).otherwise(F.col("_low"))
        ).drop("_low")
    return found.where("_net != 0").withColumn("_side", F.signum("_net").cast("int")).withColumn("_n", F.abs("_net")).drop("_net")


def copy_differences(left: DataFrame, right: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """One row per difference: row_id, difference.

    ``only_primary`` and ``only_replica``: the other side has no row with this key; otherwise the name of a column
    present in both copies whose values differ. Defined results: strings compare exactly, numbers and times by value,
    null equals null; repeated rows count once; rows with a null key cannot be matched and are left out; if a key has
    several different rows on a side, a column differs when the smallest or largest value (or the presence of nulls)
    among all rows of the key differs between the sides; columns of only one side are ignored; an empty side makes
    every row of the other one-sided.
    """
    a, b, columns = normalised(left, right, ignore)
    values = [c for c in columns if c != key]
    keep = F.col(f"`{key}`").isNotNull()
    residue = stage(except_all_both(a.where(keep), b.where(keep)), "residue")

    def folded(df: DataFrame, tag: str) -> DataFrame:
        """One row per key with each column's extremes, so that no pairs are formed within a key."""
        parts = [
            F.struct(F.min(f"`{c}`").alias("lo"), F.max(f"`{c}`").alias("hi"), F.max(F.col(f"`{c}`").isNull()).alias("gap")).alias(f"{tag}_{i}")
            for i, c in enumerate(values)
        ]
        return df.groupBy(F.col(f"`{key}`").alias("row_id")).agg(F.lit(True).alias(tag), F.count("*").alias(f"{tag}_rows"), *parts)

    # the residues are full-joined by key; a key on one side only, or with several versions, is looked up in the whole other side
    ra, rb = folded(residue.where("_side = 1"), "a"), folded(residue.where("_side = -1"), "b")
    joined = ra.join(rb, "row_id", "full_outer")
    plain = joined.where("a_rows = 1 and b_rows = 1")
    rest = joined.where("not (coalesce(a_rows, 0) = 1 and coalesce(b_rows, 0) = 1)").select("row_id")

    def whole(df: DataFrame, tag: str) -> DataFrame:
        keyed = df.where(keep).join(rest.withColumnRenamed("row_id", "_key"), F.col(f"`{key}`") == F.col("_key"), "left_semi")
        return folded(keyed, tag)

    looked_up = whole(a, "a").join(whole(b, "b"), "row_id", "full_outer")

    def report(df: DataFrame) -> DataFrame:
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        fields = [F.when(~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")), F.lit(c)) for i, c in enumerate(values)]
        found = F.when(F.col("b").isNull(), F.array(F.lit("only_primary"))).when(F.col("a").isNull(), F.array(F.lit("only_replica")))
        return df.select("row_id", F.explode(F.when(both, F.array_compact(F.array(*fields)) if fields else F.array().cast("array<string>")).otherwise(found)).alias("difference"))

    return report(plain).unionByName(report(looked_up))
