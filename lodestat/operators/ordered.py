"""Running sums down an order of any size.

A window over a whole group sorts the group in one task. Here the order is cut into ranges by the values themselves,
written once with the number of the range, and the sums of ranges (as many rows as there are ranges) are added up; only
a range is sorted in one task. Ties in the order never cross a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.sources.scratch import removed_at_exit, scratch_path


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, for plans that read them more than once."""
    spark = rows.sparkSession
    path = removed_at_exit(spark, scratch_path(spark, name))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def running(rows: DataFrame, order: list[Column], sums: list[str], *by: str) -> DataFrame:
    """rows with c_ahead and c_all for every c of sums: its sum over the rows of the group that come before, and over all of them.

    by and what order is made of may hold nulls. Rows that are equal in the order have some order of their own.
    """
    laid = kept(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "running")
    laid = laid.withColumn("_group", F.struct(F.lit(0).alias("_"), *by))
    parts = laid.groupBy("_group", "_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    group = Window.partitionBy("_group")  # a row for each range of the group
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_group", "_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums), *(F.sum(f"_{c}").over(group).alias(f"{c}_all") for c in sums))
    own = Window.partitionBy("_group", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = laid.join(parts, ["_group", "_part"])
    ahead = {f"{c}_ahead": F.col(f"_{c}_before") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}
    return met.withColumns(ahead).select(*rows.columns, *ahead, *(f"{c}_all" for c in sums))
