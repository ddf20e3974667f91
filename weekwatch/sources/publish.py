"""Sinks: rejected rows, run manifests, report twins, and publishing behind gates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weekwatch.operators import routing
from weekwatch.operators.grid import observed
from weekwatch.sources.tables import delete_path, hadoop_path, path_exists


def write_rejected(df: DataFrame, path: str, run_id: str) -> None:
    """Rejected rows of one run, in the run's own folder; a rerun replaces it."""
    routing.rejected(df).withColumnRenamed(routing.REASON, "_motivo_rejeicao").withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_valid_with_manifest(
    routed: DataFrame, table: str, manifest: str, layer: str, run_id: str, refused: Sequence[str] = (), source_rows: int | None = None
) -> dict:
    """Writes the valid rows as a version of `table`, counted on the same pass, appends one manifest row and makes the version current.

    With `source_rows`, the count of the source taken on its own, a routing that lost or doubled rows is neither
    published nor in the manifest. What was written is counted again before. The reasons of the rejected rows are a second, pruned pass.
    """
    spark = routed.sparkSession
    reason = F.col(routing.REASON)
    watched, watch = observed(
        routed, f"{layer}-{run_id}", linhas_lidas=F.count(F.lit(1)), linhas_validas=F.count_if(reason.isNull()), linhas_rejeitadas=F.count_if(reason.isNotNull())
    )
    valid = routing.valid(watched)
    version = write_version(valid, table)
    counts = watch.get
    written = read_version(spark, table, version, valid.schema).count()
    if source_rows is not None and counts["linhas_lidas"] != source_rows or written != counts["linhas_validas"]:
        delete_path(spark, f"{table}/{version}")
        raise ValueError(f"{source_rows} rows in the source, {counts['linhas_lidas']} after routing, {counts['linhas_validas']} valid, {written} written")
    histogram = routing.reason_counts(routing.rejected(routed)).agg(
        F.map_from_entries(F.collect_list(F.struct(routing.REASON, "n_rows"))).alias("motivos")
    )
    histogram.select(
        F.lit(layer).alias("layer"), F.lit(run_id).alias("run_id"),
        *[F.lit(counts[k]).cast("bigint").alias(k) for k in ("linhas_lidas", "linhas_validas", "linhas_rejeitadas")],
        "motivos", F.array(*[F.lit(r) for r in refused]).cast("array<string>").alias("arquivos_recusados"),
    ).write.mode("append").json(manifest)
    make_current(spark, table, version)
    return counts


def write_twins(tables: dict[str, DataFrame], folder: str) -> None:
    """Every report table as Parquet and as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/parquet")
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}/csv")


# --- versions ----------------------------------------------------------------------------------
#
# A published table is a folder of versions, v-<name>, and one small file that names the current one. A version is
# written and checked in full before the file is replaced, in one rename; whatever breaks before leaves the old
# version the current one, whatever breaks after leaves the new one.

POINTER = "_current"


def write_version(df: DataFrame, target: str) -> str:
    """Writes a new version that nobody reads yet; returns its name."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{target}/{version}")
    return version


def read_version(spark: SparkSession, target: str, version: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{target}/{version}")


def make_current(spark: SparkSession, target: str, version: str) -> None:
    """Lets the pointer name a version: the new pointer is written aside and put in place by one rename."""
    jvm, path = spark.sparkContext._jvm, hadoop_path(spark, f"{target}/{POINTER}")
    aside = hadoop_path(spark, f"{target}/{POINTER}-{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = path.getFileSystem(conf).create(aside)
    out.write(bytearray(version.encode()))
    out.close()
    renames = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(renames, 1)
    how[0] = renames.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(aside, path, how)


def current_version(spark: SparkSession, target: str) -> str | None:
    """Name of the version that readers see, or None before the first one."""
    if not path_exists(spark, f"{target}/{POINTER}"):
        return None
    path = hadoop_path(spark, f"{target}/{POINTER}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def drop_other_versions(spark: SparkSession, target: str, keep: Sequence[str] = ()) -> None:
    """Deletes all versions but the current one and those of `keep`, which readers may still hold."""
    held = {current_version(spark, target), *keep}
    folder = hadoop_path(spark, target)
    for status in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in held:
            delete_path(spark, status.getPath().toString())


def publish(df: DataFrame, target: str, gates: Callable[[DataFrame], None]) -> str:
    """Writes a version, runs the gates on what was really written, then makes it current; a failure leaves the old one."""
    spark = df.sparkSession
    version = write_version(df, target)
    try:
        gates(read_version(spark, target, version, df.schema))
    except Exception:
        delete_path(spark, f"{target}/{version}")
        raise
    make_current(spark, target, version)
    return version


def read_published(spark: SparkSession, target: str) -> DataFrame:
    version = current_version(spark, target)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {target}")
    return read_version(spark, target, version)
