"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """root/name.parquet, a file or a directory of part files; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work that is long per row: with fewer splits than cores its (pruned) rows are dealt out once, else it is left alone.

    Only for scans: the number of partitions of a plan with shuffles isn't known before it runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
