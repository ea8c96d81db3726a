"""Content-addressed stage tables: a stage runs once per content, version and settings."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import struct
from ..sources.files import exists
from .seams import TextEmbedder, embed

VECTORS = struct("text_hash string, vector array<float>")


class CacheFault(RuntimeError):
    """A stored table has another schema than its stage."""


@dataclass(frozen=True)
class StageKey:
    stage: str
    input_hash: str
    stage_version: str
    config_hash: str

    @property
    def content_hash(self) -> str:
        return hashlib.sha256("\x1f".join((self.stage, self.input_hash, self.stage_version, self.config_hash)).encode()).hexdigest()


@dataclass
class StageRun:
    frame: DataFrame
    hit: bool
    n_out: int
    duration_ms: float


def hash_rows(df: DataFrame, *columns: str) -> str:
    """Digest of a table's rows, whatever their order: sums of two row hashes and the count."""
    cols = columns or df.columns
    m = df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.sum(F.hash(*cols).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{m[0]}\x1f{m[1]}\x1f{m[2]}".encode()).hexdigest()


class StageCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: StageKey) -> str:
        return f"{self.root}/{key.stage}/{key.content_hash}"

    def load(self, key: StageKey, schema: StructType) -> DataFrame | None:
        """None unless a whole table is there: _SUCCESS is written last."""
        if not exists(self.spark, f"{self.path(key)}/_SUCCESS"):
            return None
        df = self.spark.read.parquet(self.path(key))
        if [(f.name, f.dataType.simpleString()) for f in df.schema] != [(f.name, f.dataType.simpleString()) for f in schema]:
            raise CacheFault(f"{self.path(key)} holds {df.schema.simpleString()}")
        return df

    def get_or_compute(self, key: StageKey, schema: StructType, make: Callable[[], DataFrame]) -> StageRun:
        began = time.perf_counter()
        df = self.load(key, schema)
        if hit := df is not None:
            pass
        else:
            make().select(schema.fieldNames()).write.mode("overwrite").option("compression", "zstd").parquet(self.path(key))
            df = self.load(key, schema)
        return StageRun(df, hit, df.count(), (time.perf_counter() - began) * 1000)


def missing_texts(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """Texts whose hash has no vector yet: only these are embedded."""
    return texts.withColumn("text_hash", F.sha2("text", 256)).join(cached.select("text_hash"), "text_hash", "left_anti").dropDuplicates(["text_hash"])


class VectorCache:
    """Vectors by the hash of their text, one table for each embedder: a text is embedded once."""

    def __init__(self, spark: SparkSession, root: str, embedder: TextEmbedder):
        mark = hashlib.sha256(json.dumps(embedder.fingerprint(), sort_keys=True).encode()).hexdigest()[:16]
        self.spark, self.embedder, self.path = spark, embedder, f"{root.rstrip('/')}/{mark}"

    def load(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/_SUCCESS"):
            return self.spark.createDataFrame([], VECTORS)
        # a batch that was written twice holds equal vectors
        return self.spark.read.schema(VECTORS).parquet(self.path).dropDuplicates(["text_hash"])

    def get_or_compute(self, rows: DataFrame) -> DataFrame:
        """rows(text) with vector. Texts that are not there yet are embedded and appended first."""
        new = missing_texts(rows.select("text"), self.load())
        made = new.select("text_hash", embed(F.col("text"), self.embedder, self.embedder.passage_prefix).alias("vector"))
        made.write.mode("append").option("compression", "zstd").parquet(self.path)
        return rows.withColumn("text_hash", F.sha2("text", 256)).join(self.load(), "text_hash").drop("text_hash")
