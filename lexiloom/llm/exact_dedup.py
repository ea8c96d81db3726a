"""Exact dedup as a stateful stream.

Each row has a digest of its normalised text. A Structured Streaming aggregation
keeps, per digest and without expiry, the largest doc_id (the stable identifier),
the file and row number of that row (the content locator) and the number of rows.
The state is disk-backed (RocksDB). State, stream log and updates lie in one home
folder: a later run with the same home reads only files it has not seen, and a run
after a failed driver goes on where that one stopped. Partial aggregation before the
shuffle means that a group of any size reaches the state as one row per task.

After the stream, every row whose digest was seen before is compared in full with
the text at the retained locator. Rows that differ (digest collisions) are grouped
anew by their full text.

Rows find their group by a broadcast of the groups of two rows and more where these
are measured to be at most BROADCAST_BYTES; beyond that, only groups of more than HOT
rows are broadcast, whose number is checked, and the others are joined by shuffle.
For the comparison, a group of n rows is cut into n / SPLIT parts, each with a copy of
the retained text.

Defined cases: a null text is empty; the largest doc_id stays, nulls before all
others, ties by file and row, so of repeated rows one stays; texts of any length are
hashed and compared whole; an empty table gives an empty result; other columns,
whatever their names, are ignored. Files that were seen must not change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lower_ascii, staged

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores: no disk is set aside in advance.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Files of one micro-batch.
FILES_PER_BATCH = 1000
#: Groups are broadcast up to so many bytes; beyond, those of more than HOT rows, HOT_GROUPS at most.
BROADCAST_BYTES, HOT, HOT_GROUPS = 16_000_000, 1000, 20_000
#: Rows of one part of a group that is compared.
SPLIT = 256
STATE = "digest string, keep struct<doc_id:bigint,file:string,row:bigint>, n bigint, batch bigint"


def sha256(norm: Column) -> Column:
    # never null, and known not to be: else joins filter on it first and compute it twice
    return F.coalesce(F.sha2(norm, 256), F.lit(""))


def _rows(raw: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = lower_ascii(F.col("text"))
    return raw.select(
        F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
    )


def retained(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, home: str | None = None) -> DataFrame:
    """Run the stream over the files at path that home has not seen: digest, keep, n of every digest."""
    schema = spark.read.parquet(path).schema
    # as a pattern, the path may be one file or a folder
    rows = _rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]"), digest)
    state = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
    home = (home or fresh_path(spark, "dedup")).rstrip("/")
    out, log = f"{home}/updates", f"{home}/log"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure overwrites its own folder
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/number={number}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{out}/number=-1")
    updates = spark.read.schema(STATE).parquet(f"{out}/number=*")
    return updates.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("last")).select("digest", "last.keep", "last.n")


def with_groups(rows: DataFrame, groups: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows with keep and n of their digest's group, nulls for those in none. groups is staged."""
    size = groups.agg(F.sum(F.octet_length("digest") + F.octet_length("keep.file") + 32)).first()[0] or 0
    if size <= limit:
        return rows.join(F.broadcast(groups), "digest", "left")
    hot = HOT
    while groups.where(F.col("n") > hot).count() > HOT_GROUPS:
        hot *= 4
    first = rows.join(F.broadcast(groups.where(F.col("n") > hot)), "digest", "left")
    # rows that have their group are dealt out by row, not by digest
    key = F.when(F.col("n").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.hex(F.xxhash64("at"))))
    rest = groups.where(F.col("n") <= hot).select(F.col("digest").alias("_key"), F.col("keep").alias("_keep"), F.col("n").alias("_n"))
    both = first.withColumn("_key", key).join(rest, "_key", "left")
    return both.withColumns({"keep": F.coalesce("keep", "_keep"), "n": F.coalesce("n", "_n")}).drop("_key", "_keep", "_n")


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, home: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of the Parquet files at path: doc_id, keep_id, group_size, kept, text_sha256."""
    state = retained(spark, path, digest, files_per_batch, home)
    groups = staged(state.where("n > 1").select("digest", "keep", "n"), "dedup_groups")
    rows = _rows(spark.read.parquet(path), digest)
    text_sha256 = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    found = with_groups(rows.select("at", "digest", text_sha256.alias("text_sha256")), groups, limit)
    alone = {"keep": F.coalesce("keep", "at"), "n": F.coalesce("n", F.lit(1).cast("long"))}
    found = staged(found.withColumns(alone).select("at", "digest", "keep", "n", "text_sha256"), "dedup_rows")
    # full bytes of all rows whose digest was there before, a large group in parts
    texts = with_groups(rows, groups, limit).where("n IS NOT NULL")
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    first = texts.where("at = keep").select("digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("norm").alias("kept_norm"))
    hits = texts.where("NOT at <=> keep").select("digest", F.pmod(F.xxhash64("at"), parts).cast("int").alias("part"), "norm")
    collided = staged(hits.join(first, ["digest", "part"]).where("norm <> kept_norm").select("digest").distinct(), "dedup_collided")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    right = found.select(F.col("at.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"), "text_sha256", "digest")
    if collided.isEmpty():
        return right.select(columns)
    again = rows.join(collided, "digest", "left_semi")
    by_text = again.groupBy("norm").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
    split = again.select("at", "norm").join(by_text, "norm")
    split = split.select(F.col("at.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"))
    return right.join(collided, "digest", "left_anti").select(columns).unionByName(split)
