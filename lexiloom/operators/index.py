"""The chunk index: one Parquet table with text and vectors, then a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config, hash_object
from ..sources.files import delete, exists, read_text, write_text
from ..sources.staging import staged
from .seams import FINGERPRINT, HashingEmbedder, TextEmbedder, embed


class IndexFault(ValueError):
    """The index is missing, incomplete or of another embedder."""


def l2_normalise(v):
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def faults(index: DataFrame, dim: int, id_col: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(id, fault) of rows with a wrong width, a number that is not finite, or a repeated id."""
    bad = F.exists(vector, lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf")))
    row = F.when(F.col(vector).isNull() | (F.size(vector) != dim), "width").when(bad, "not finite")
    rows = index.select(F.col(id_col).cast("string").alias("id"), row.alias("fault")).where("fault IS NOT NULL")
    repeated = index.groupBy(F.col(id_col).cast("string").alias("id")).count().where("count > 1").select("id", F.lit("repeated").alias("fault"))
    return rows.unionByName(repeated)


#: Ranges of doc_id in which rows are numbered, and documents looked at to place their bounds.
RANGES, SAMPLED = 256, 20_000


def with_row_ids(chunks: DataFrame) -> DataFrame:
    """row_id from 0 by document and chunk, made once and carried from then on.

    Counts per document are summed over a table of one row a document. Documents are dealt into
    ranges of doc_id; bounds come from a bounded sample by hash and decide only how even the ranges
    are. Totals of the ranges are added up, and inside a range documents are, so no task holds
    the whole index and ids follow the order of doc_id.
    """
    sizes = staged(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "chunk_counts")
    some = sorted(r.doc_id for r in sizes.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED).collect())
    cuts = sorted({some[len(some) * k // RANGES] for k in range(1, RANGES)}) if some else []
    bounds = F.array(*map(F.lit, cuts)).cast("array<string>")
    ranges = sizes.withColumn("part", F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    inside = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("n").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    offsets = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    firsts = ranges.join(F.broadcast(offsets), "part").withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select("doc_id", "first")
    order = Window.partitionBy("doc_id").orderBy("chunk_no")
    return chunks.join(firsts, "doc_id").withColumn("row_id", F.col("first") + F.row_number().over(order) - 1).drop("first")


def index_id(chunks: DataFrame, fingerprint: dict, chunk_config_hash: str) -> str:
    """Name of the index by content: a sum of row hashes, so order does not matter."""
    mark = chunks.agg(F.count("*"), F.sum(F.xxhash64("chunk_id", "text").cast("decimal(38,0)"))).first()
    return hash_object([int(mark[0]), str(mark[1]), fingerprint, chunk_config_hash])


def written_faults(chunks: DataFrame, written: DataFrame, dim: int) -> DataFrame:
    """(id, fault) of what the written table lacks, has too much, or has wrong: empty if it is whole."""
    one = chunks.groupBy("chunk_id").agg(F.count("*").alias("want"))
    two = written.groupBy("chunk_id").agg(F.count("*").alias("have"))
    both = one.join(two, "chunk_id", "full").where("NOT want <=> have").select(F.col("chunk_id").alias("id"), F.when(F.col("have").isNull(), "lost").otherwise("surplus").alias("fault"))
    return both.unionByName(faults(written, dim))


def build_index(chunks: DataFrame, root: str, cfg: Config = Config(), embedder: TextEmbedder | None = None, reuse: bool = True, vectors: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, dict]:
    """Embed and write chunks under root; (path, manifest).

    An index of the same content is reused if its manifest says so and its table has as many rows
    as the manifest. What was written is held against the chunks before the manifest is. vectors
    adds the column vector; the default embeds every text.
    """
    embedder = embedder or HashingEmbedder()
    spark, fp = chunks.sparkSession, embedder.fingerprint()
    name = index_id(chunks, fp, cfg.chunk_config_hash)
    path = f"{root.rstrip('/')}/{name.removeprefix('sha256:')[:16]}"
    if reuse and exists(spark, f"{path}/manifest.json"):
        old = read_manifest(spark, path)
        if (old.get("index_id"), old.get("embedder"), old.get("chunk_config_hash")) == (name, fp, cfg.chunk_config_hash) and exists(spark, f"{path}/chunks/_SUCCESS") and spark.read.parquet(f"{path}/chunks").count() == old["n_vectors"]:
            return path, old
    rows = with_row_ids(chunks)
    rows = rows.withColumn("vector", embed(F.col("text"), embedder, embedder.passage_prefix)) if vectors is None else vectors(rows)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    written = spark.read.parquet(f"{path}/chunks")
    if not (bad := written_faults(chunks, written, embedder.dim)).isEmpty():
        first = bad.first()
        delete(spark, path)
        raise IndexFault(f"{first.id}: {first.fault}")
    manifest = {"index_id": name, "n_vectors": chunks.count(), "chunk_config_hash": cfg.chunk_config_hash, "embedder": fp}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))  # last: it marks the index complete
    return path, manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/manifest.json"):
        raise IndexFault(f"{path} has no manifest")
    return json.loads(read_text(spark, f"{path}/manifest.json"))


def verify_fingerprint(manifest: dict, embedder: TextEmbedder) -> None:
    """An index of another embedder is refused before a plan is made."""
    stored, own = manifest.get("embedder", manifest), embedder.fingerprint()
    if "ir_sha256" not in stored:
        raise IndexFault("the manifest has no embedder fingerprint: index anew")
    if diff := [f"{k}: index {stored.get(k)!r}, runtime {own.get(k)!r}" for k in FINGERPRINT if stored.get(k) != own.get(k)]:
        raise IndexFault("index of another embedder: index anew\n" + "\n".join(diff))


def load_index(spark: SparkSession, path: str, embedder: TextEmbedder | None = None) -> DataFrame:
    manifest = read_manifest(spark, path)
    verify_fingerprint(manifest, embedder or HashingEmbedder())
    rows = spark.read.parquet(f"{path}/chunks")
    if (n := rows.count()) != manifest["n_vectors"]:
        raise IndexFault(f"{n} rows, manifest says {manifest['n_vectors']}")
    if narrow := rows.where(F.size("vector") != manifest["embedder"]["dim"]).count():
        raise IndexFault(f"{narrow} vectors are not {manifest['embedder']['dim']} wide")
    return rows
