"""Query traces: rows, stage means, daily files, device fall-backs."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TIERS, TRACE


class TraceRecorder:
    """What one query did. finish() gives the row, once."""

    def __init__(self, query: str, lang: str, config_hash: str):
        self._row = {"trace_id": uuid.uuid4().hex, "started_at": datetime.now(UTC), "query": query, "lang": lang, "config_hash": config_hash, "top_score": None, "n_retrieved": 0, "prompt_tokens": 0, "completion_tokens": 0, "ttft_ms": None}
        self._began, self._stages, self._devices, self._done = time.perf_counter(), [], [], False

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self._stages.append((name, (time.perf_counter() - began) * 1000))

    def device(self, model: str, requested: str, got: str) -> None:
        self._devices.append((model, requested, got))

    def retrieved(self, scores: list[float]) -> None:
        self._row |= {"n_retrieved": len(scores), "top_score": max(scores, default=None)}

    def tokens(self, prompt: int, completion: int) -> None:
        self._row["prompt_tokens"] += prompt
        self._row["completion_tokens"] += completion

    def first_token(self) -> None:
        if self._row["ttft_ms"] is None:
            self._row["ttft_ms"] = (time.perf_counter() - self._began) * 1000

    def finish(self, trace_id: str, tier: int, abstained: bool, n_citations: int) -> dict:
        if self._done:
            raise RuntimeError("finished already")
        if trace_id != self._row["trace_id"]:
            raise ValueError("answer of another trace")
        if tier not in TIERS:
            raise ValueError(f"unknown tier {tier}")
        self._done = True
        return self._row | {"tier": tier, "abstained": abstained, "n_citations": n_citations, "total_ms": (time.perf_counter() - self._began) * 1000, "stages": self._stages, "devices": self._devices}


def to_frame(spark: SparkSession, traces: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(t[c] for c in TRACE.fieldNames()) for t in traces], TRACE)


def write_traces(traces: DataFrame, root: str) -> None:
    """Appended to a folder per UTC day; writers do not read what is there."""
    traces.withColumn("day", F.date_format("started_at", "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(root)


def read_traces(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TRACE).parquet(root).select(TRACE.fieldNames())


def stage_means(traces: DataFrame) -> DataFrame:
    """(stage, mean_ms, n), in the order stages were first seen."""
    rows = traces.select("started_at", F.posexplode("stages").alias("pos", "s"))
    out = rows.groupBy("s.stage").agg(F.round(F.avg("s.duration_ms"), 6).alias("mean_ms"), F.count("*").alias("n"), F.min(F.struct("started_at", "pos")).alias("seen"))
    return out.orderBy("seen").drop("seen")


def stage_map(traces: DataFrame) -> DataFrame:
    return traces.select("trace_id", F.map_from_entries("stages").alias("stage_ms"))


def fallbacks(traces: DataFrame) -> DataFrame:
    """Per model: uses, and uses on another device than requested."""
    rows = traces.select(F.explode("devices").alias("d"))
    return rows.groupBy("d.model").agg(F.count("*").alias("n"), F.sum((F.col("d.requested") != F.col("d.device")).cast("long")).alias("n_fell_back"))


def unmatched(answers: DataFrame, traces: DataFrame) -> DataFrame:
    """Answers without a trace of their own."""
    return answers.join(traces.select("trace_id"), "trace_id", "left_anti")
