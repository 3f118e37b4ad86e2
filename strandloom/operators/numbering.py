"""Numbers and running sums over ordered keys, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_checkpoints


def in_ranges(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """df in ranges of the keys (column _range), with what stands before each row's range: _before_<sum> for each column.

    The ranges are checkpointed, as their edges are sampled; their totals are one row a range.
    """
    with_checkpoints(df.sparkSession)
    dealt = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums))
    return dealt.join(F.broadcast(before), "_range")


def running_sums(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """df with the columns replaced by their sums over all rows up to the own one; keys must be distinct."""
    upto = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = in_ranges(df, keys, sums)
    return out.select(*(c for c in df.columns if c not in sums), *((F.sum(c).over(upto) + F.col(f"_before_{c}")).alias(c) for c in sums))


def dense_numbers(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct keys, numbered from 0 in their order."""
    out = running_sums(df.select(*keys).distinct().withColumn(name, F.lit(1).cast("bigint")), keys, [name])
    return out.withColumn(name, F.col(name) - 1)
