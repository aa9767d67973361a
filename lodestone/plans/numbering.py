"""Row numbers in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import stage


def numbered(df: DataFrame, *keys: str, name: str = "idx") -> DataFrame:
    """``df`` with ``name``, the row's place (from 0) in the order of ``keys``, which should be unique.

    Rows are range-partitioned, numbered within each partition, and shifted by the sizes of the partitions before; the table
    of sizes has a row for each partition.
    """
    ranged = stage(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + place).cast("long")).drop("__part", "__before")


def running_sum(df: DataFrame, groups: list[str], order: str, amount: str, name: str = "up_to") -> DataFrame:
    """``df`` with ``name``, the sum of ``amount`` up to the row within its group in the order of ``order``, which should be unique there.

    Rows are range-partitioned by group and order, so that a large group spans many tasks; sums of the partitions before are
    added to those within.
    """
    # A struct of the group's columns is equal to another one when their nulls are at the same places.
    keyed = df.withColumn("__group", F.struct(*groups))
    ranged = stage(keyed.repartitionByRange("__group", order).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__group", "__part").agg(F.sum(amount).alias("__sum"))
    before = sums.select("__group", "__part", (F.sum("__sum").over(Window.partitionBy("__group").orderBy("__part")) - F.col("__sum")).alias("__before"))
    within = F.sum(amount).over(Window.partitionBy("__group", "__part").orderBy(order))
    return ranged.join(before, ["__group", "__part"]).withColumn(name, F.col("__before") + within).drop("__part", "__before", "__group")
