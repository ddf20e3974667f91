"""Run manifests: which file to read, what a backfill still needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from weekwatch.contracts import MANIFEST_SCHEMA


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and resource of every manifest JSON under a path."""
    docs = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return docs.select("run_id", F.explode("recursos").alias("r")).select("run_id", "r.*")


def newest_success(entries: DataFrame, key: str = "resource_id") -> DataFrame:
    """Newest successful entry per resource; the later run wins. A map-side combinable aggregate."""
    rest = [c for c in entries.columns if c != key]
    ok = entries.where((F.col("status") == "SUCCESS") & F.col(key).isNotNull())
    return ok.groupBy(key).agg(F.max_by(F.struct(*rest), "run_id").alias("_r")).select(key, "_r.*")


def newest_run(entries: DataFrame) -> DataFrame:
    return entries.agg(F.max("run_id").alias("run_id"))


def newest_complete_run(entries: DataFrame, parts: Sequence[str], column: str = "tipo") -> DataFrame:
    """Newest run in which every listed part succeeded."""
    ok = F.col("status") == "SUCCESS"
    runs = entries.groupBy("run_id").agg(*[F.coalesce(F.bool_or(ok & (F.col(column) == p)), F.lit(False)).alias(f"_{i}") for i, p in enumerate(parts)])
    cond = F.lit(True)
    for i in range(len(parts)):
        cond = cond & F.col(f"_{i}")
    return runs.where(cond).agg(F.max("run_id").alias("run_id")).where(F.col("run_id").isNotNull())


def newest_run_with_any(entries: DataFrame, parts: Sequence[str], column: str = "tipo") -> DataFrame:
    ok = entries.where((F.col("status") == "SUCCESS") & F.col(column).isin(*parts))
    return ok.agg(F.max("run_id").alias("run_id")).where(F.col("run_id").isNotNull())


def all_successes(entries: DataFrame, part: str, column: str = "tipo") -> DataFrame:
    """Append-only history of snapshots; de-duplication is a later step."""
    return entries.where((F.col("status") == "SUCCESS") & (F.col(column) == part))


def backfill_plan(done: DataFrame, requested: DataFrame, depth_days: int) -> DataFrame:
    """Requested stations whose deepest successful backfill is shallower than asked."""
    deepest = done.where(F.col("status") == "SUCCESS").groupBy("station").agg(F.max("depth_days").alias("depth"))
    return requested.join(deepest.where(F.col("depth") >= depth_days), "station", "left_anti")
