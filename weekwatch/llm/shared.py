"""Tables written to the folder that all executors share, to cut lineage where a checkpoint would be large."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from weekwatch.session import checkpoint_dir


def store(df: DataFrame) -> DataFrame:
    """Writes the rows as a compressed table under spark.checkpoint.dir and reads them back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
