"""Running totals of groups of any size: no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysweep.operators.filters import broadcast_if_small
from keysweep.session import checkpoint_root


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same group that stand before it in ``order``.

    Rows are sorted over the cluster by group and order, so a large group is a run of partitions.  Sums run within each of these,
    and start at what the group's earlier partitions hold, which is a table of one row per partition and group.  Rows that are
    equal in group and order stand in an order of their own."""
    checkpoint_root(df.sparkSession)
    keys = [*group, *order]
    sorted_rows = (df.withColumn("_value", value).withColumn("_tie", F.monotonically_increasing_id())
                   .repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
                   .withColumn("_row", F.monotonically_increasing_id()).checkpoint())
    rows = sorted_rows.withColumn("_part", F.shiftright("_row", 33))
    parts = rows.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"),
                         F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long")).alias("_base"))
    within = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum("_value").over(within), F.lit(0).cast("long")))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_part") == F.col("_p")]
    return rows.join(broadcast_if_small(parts), same).withColumn(name, F.col(name) + F.col("_base")).select(*df.columns, name)
