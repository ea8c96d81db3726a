"""Streams: documents to normalised blocks, and the trace log by UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.blocks import document_blocks, normalise_blocks


def document_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New files below path as rows; a doc_id seen before is dropped for good."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).dropDuplicates(["doc_id"])


def ingest_blocks(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Blocks of each batch into a folder of that batch: a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        normalise_blocks(document_blocks(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(traces: DataFrame, late: str = "1 day") -> DataFrame:
    """Traces a UTC day, with late rows counted as long as the watermark lets them."""
    days = traces.withWatermark("started_at", late).groupBy(F.window("started_at", "1 day"))
    return days.agg(F.count("*").alias("n"), F.sum("total_ms").alias("total_ms")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "total_ms")
