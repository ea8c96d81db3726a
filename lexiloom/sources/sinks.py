"""Writers of runs: appended Parquet with run id and label."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, read_text, write_text


def write_run(rows: DataFrame, root: str, label: str, when: datetime | None = None) -> str:
    """Append rows of an evaluation or bench run; the id is its UTC time."""
    run_id = (when or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")
    rows.withColumns({"run_id": F.lit(run_id), "label": F.lit(label)}).write.mode("append").option("compression", "zstd").partitionBy("run_id", "label").parquet(root)
    return run_id


def latest_run(runs: DataFrame, label: str) -> DataFrame:
    """Rows of the newest run with a label."""
    newest = runs.where(F.col("label") == label).agg(F.max("run_id").alias("run_id"))
    return runs.where(F.col("label") == label).join(F.broadcast(newest), "run_id", "left_semi")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table only, either way: empty when a written table equals its source."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


MANIFEST_VERSION = 1


def merge_manifest(spark: SparkSession, path: str, entries: list[dict]) -> dict:
    """Model entries by name; later ones replace, others stay."""
    old = read_manifest(spark, path)["models"] if exists(spark, path) else []
    merged = {e["name"]: e for e in [*old, *entries]}
    out = {"schema_version": MANIFEST_VERSION, "models": [merged[k] for k in sorted(merged)]}
    write_text(spark, path, json.dumps(out, sort_keys=True))
    return out


def read_manifest(spark: SparkSession, path: str) -> dict:
    data = json.loads(read_text(spark, path))
    if data.get("schema_version") != MANIFEST_VERSION:
        raise ValueError(f"{path}: schema_version {data.get('schema_version')!r}")
    return data
