"""Columnar scans and sinks with partition discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def distinct_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Scan of a few columns only; Parquet reads nothing else."""
    return spark.read.parquet(path).select(*columns).distinct()


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = hadoop_path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    p = hadoop_path(spark, path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, uri, length) of every file under a path or glob, empty files included: scans leave those out.

    Listing is name-node work that Spark's own file index also does on the driver.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for top in fs.globStatus(root) or []:
        walk = fs.listFiles(top.getPath(), True)
        while walk.hasNext():
            f = walk.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getPath().toUri().toString(), f.getLen()))
    return spark.createDataFrame(found, "path string, uri string, length bigint")


def read_prefix(spark: SparkSession, prefix: str, schema: T.StructType) -> DataFrame:
    """Every partition under a prefix as one table; an absent prefix is an empty table."""
    if not path_exists(spark, prefix):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(prefix)


def write_years(df: DataFrame, path: str, partition: str = "ano") -> None:
    """One folder per year; a rerun replaces only the years it brings."""
    df.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
