"""Versioned models: saved with metadata, refused when anything they rely on has changed."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from hashlib import sha256

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

KNOWN_VERSIONS = ("weekwatch_v1",)
VERSION_PATTERN = re.compile(r"^[a-z0-9_]+$")


class MissingModel(FileNotFoundError):
    """No model is stored under this version."""


class IncompatibleModel(RuntimeError):
    """The stored model does not fit the data or the library."""


def signature(names: Sequence[str]) -> str:
    return f"{len(names)}-{sha256('|'.join(names).encode()).hexdigest()[:12]}"


def model_path(base: str, version: str, known: Sequence[str] = KNOWN_VERSIONS) -> str:
    """The version is checked against a pattern and a list before it becomes part of a path."""
    if not VERSION_PATTERN.match(version) or version not in known:
        raise ValueError(f"unknown model version {version!r}")
    return f"{base.rstrip('/')}/{version}"


def _minor(v: str) -> str:
    return ".".join(v.split(".")[:2])


def save(spark: SparkSession, model: PipelineModel, base: str, version: str, names: Sequence[str], table_version: str, extra: dict | None = None, known: Sequence[str] = KNOWN_VERSIONS) -> str:
    path = model_path(base, version, known)
    model.write().overwrite().save(f"{path}/model")
    meta = {
        **(extra or {}), "model_version": version, "feature_names": list(names), "feature_schema_version": signature(names),
        "gold_schema_version": table_version, "spark_version": pyspark.__version__,
    }
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return path


def metadata(spark: SparkSession, base: str, version: str, known: Sequence[str] = KNOWN_VERSIONS) -> dict:
    from weekwatch.sources.tables import path_exists

    path = model_path(base, version, known)
    if not path_exists(spark, f"{path}/metadata"):
        raise MissingModel(path)
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def load(spark: SparkSession, base: str, version: str, names: Sequence[str] | None = None, table_version: str | None = None, known: Sequence[str] = KNOWN_VERSIONS) -> tuple[PipelineModel, dict]:
    """Feature names and order, table version and library minor must match before the model is read."""
    meta = metadata(spark, base, version, known)
    if names is not None and meta["feature_schema_version"] != signature(names):
        raise IncompatibleModel("feature signature differs")
    if table_version is not None and meta["gold_schema_version"] != table_version:
        raise IncompatibleModel("table version differs")
    if _minor(meta["spark_version"]) != _minor(pyspark.__version__):
        raise IncompatibleModel("library version differs")
    return PipelineModel.load(f"{model_path(base, version, known)}/model"), meta
