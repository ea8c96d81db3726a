"""Whole plans: ingest to an index, retrieval by configuration, sweeps over arms."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import Config, hash_object
from ..operators import answer, blocks, cache, chunks, evaluate, index, ocr, retrieval
from ..operators.seams import HashingEmbedder, PageReader, TextEmbedder, embed, overlap_score, pass_through, read_pages
from ..schema import BLOCK, CHUNK, conform
from ..sources import readers
from ..sources.files import exists
from ..sources.readers import PIPELINE_VERSION
from ..sources.staging import staged

ARMS = ("rerank", "hybrid", "rewrite")


class ArmUnavailable(RuntimeError):
    """An arm is on whose model is not configured."""


def index_blocks(rows: DataFrame, root: str, cfg: Config, embedder: TextEmbedder | None) -> tuple[str, dict]:
    """Normalised blocks with kind to an index below root. Chunks and vectors are cached beside it."""
    spark, embedder, home = rows.sparkSession, embedder or HashingEmbedder(), root.rstrip("/")
    key = cache.StageKey("chunks", cache.hash_rows(rows, "doc_id", "block_id", "kind", "script", "text"), PIPELINE_VERSION, cfg.chunk_config_hash)
    schema = StructType([*CHUNK.fields, StructField("chunk_no", IntegerType())])
    made = cache.StageCache(spark, f"{home}-cache/stages").get_or_compute(key, schema, lambda: chunks.build_chunks(rows, cfg.chunk))
    vectors = cache.VectorCache(spark, f"{home}-cache/vectors", embedder)
    return index.build_index(made.frame, root, cfg, embedder, vectors=vectors.get_or_compute)


def ingest(docs: DataFrame, root: str, cfg: Config = Config(), embedder: TextEmbedder | None = None) -> tuple[str, dict]:
    """documents(doc_id, text) to an index: lines without typography are paragraphs."""
    rows = blocks.normalise_blocks(blocks.document_blocks(docs)).withColumn("kind", F.lit("paragraph"))
    return index_blocks(rows, root, cfg, embedder)


def page_blocks(items: DataFrame, height: Column | float, *ties: str) -> DataFrame:
    """items(doc_id, page, bbox, text, size, bold, in_table if known) to normalised blocks; height is a page's.

    Items are put in reading order and classified by typography; documents whose text layer cannot
    be trusted are left out, for OCR to read.
    """
    placed = blocks.reading_order(items, height, *ties)
    table = F.coalesce("in_table", F.lit(False)) if "in_table" in items.columns else F.lit(False)
    kind = blocks.classify(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size"), table)
    rows = placed.join(blocks.body_size(items), "doc_id").withColumn("kind", kind).drop("body_size", "size", "bold")
    rows = blocks.with_text_layer(rows).withColumn("block_id", blocks.block_id())
    return blocks.normalise_blocks(rows)


def ingest_items(items: DataFrame, root: str, height: float, *ties: str, cfg: Config = Config(), embedder: TextEmbedder | None = None) -> tuple[str, dict]:
    """Page items to an index: order, kinds, gate, normalisation, chunks, vectors, verification."""
    made = page_blocks(items, height, *ties).drop("bbox")  # pages place blocks; boxes in points are no fractions of a page
    # kept by the items, so that they are made once a content: their hash, their chunks and a second run read them
    key = cache.StageKey("blocks", cache.hash_rows(items), PIPELINE_VERSION, hash_object([height, *ties]))
    stages = cache.StageCache(items.sparkSession, f"{root.rstrip('/')}-cache/stages")
    return index_blocks(stages.get_or_compute(key, made.schema, lambda: made).frame, root, cfg, embedder)


def ingest_files(spark: SparkSession, targets: Sequence[str], root: str, reader: PageReader, renderer: ocr.Renderer | None = None, engine: ocr.Engine | None = None, cfg: Config = Config(), embedder: TextEmbedder | None = None) -> tuple[str, dict, DataFrame]:
    """PDF files below the targets to one index, and files(doc_id, filename, outcome).

    Documents whose text layer can be trusted are taken from it, the others from their page images where
    an engine is given. outcome: text, ocr, skipped (neither), corrupt, unsupported, or the reader's fault.
    """
    home = root.rstrip("/")
    files = staged(readers.pdf_files(spark, *targets), "files")
    ok = files.where("status = 'ok'").select("doc_id", "path", readers.script_hint(F.col("path")).alias("script_hint"))
    items = staged(read_pages(readers.with_content(ok, spark, *targets), reader), "items")

    def part(b: Column) -> Column:
        return blocks.unit_bbox(b["x0"], b["y0"], b["x1"], b["y1"], F.col("width"), F.col("height"))

    tables = F.filter(F.transform("tables", part), lambda t: t.isNotNull())
    placed = items.where("fault IS NULL AND text IS NOT NULL").withColumns({"bbox": part(F.col("bbox")), "tables": tables}).where("bbox IS NOT NULL")
    layer = page_blocks(placed.withColumn("in_table", blocks.in_table(F.col("bbox"), F.col("tables"))), F.col("height"), "bbox.y0", "text")
    rows = staged(conform(layer.withColumn("ocr_confidence", F.lit(None)), BLOCK), "layer")
    outcome = files.select("doc_id", "filename", "status")
    faults = items.where("fault IS NOT NULL").select("doc_id", "fault")
    outcome = outcome.join(faults, "doc_id", "left").join(rows.select("doc_id", F.lit(True).alias("layered")).distinct(), "doc_id", "left")
    if renderer and engine:
        rest = outcome.where("status = 'ok' AND fault IS NULL AND layered IS NULL").select("doc_id")
        images = readers.with_content(ok.join(rest, "doc_id", "left_semi"), spark, *targets)
        seen = staged(blocks.normalise_blocks(ocr.read_documents(images, renderer, engine, f"{home}-cache/lines")), "seen")
        rows = rows.unionByName(seen.select(rows.columns))
        outcome = outcome.join(seen.select("doc_id", F.lit(True).alias("read")).distinct(), "doc_id", "left")
    else:
        outcome = outcome.withColumn("read", F.lit(None).cast("boolean"))
    path, manifest = index_blocks(rows, root, cfg, embedder)
    said = F.when(F.col("status") != "ok", F.col("status")).when(F.col("fault").isNotNull(), F.col("fault"))
    said = said.when(F.col("layered"), "text").when(F.col("read"), "ocr").otherwise("skipped")
    return path, manifest, outcome.select("doc_id", "filename", said.alias("outcome"))


def only_index(spark: SparkSession, root: str) -> str:
    """The one complete index below root; none or several are refused."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = [f"{root.rstrip('/')}/{s.getPath().getName()}" for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory()]
    found = [p for p in found if exists(spark, f"{p}/manifest.json")]
    if len(found) != 1:
        raise index.IndexFault(f"{len(found)} indexes below {root}: name one")
    return found[0]


def retrieve(queries: DataFrame, rows: DataFrame, cfg: Config = Config(), embedder: TextEmbedder | None = None, rewriter: Callable[[Column], Column] = pass_through) -> DataFrame:
    """Hits of queries(query_id, text) in an index, with the arms that cfg turns on.

    Rewriting changes the query, hybrid adds the lexical arm, reranking comes last.
    """
    arms, embedder = cfg.retrieve, embedder or HashingEmbedder()
    lost = None
    if arms.rewrite.enabled:
        # written once: every arm reads the rewritten text, and the rewriter runs a single time
        queries = staged(retrieval.rewritten(queries, rewriter(F.col("text")), arms.rewrite.trigger_max_tokens), "rewritten")
        lost = queries.select("query_id", F.col("degraded").alias("lost"))
    vectors = queries.select("query_id", embed(F.col("text"), embedder, embedder.query_prefix).alias("vector"))
    # written once: fusion, gate and answers read hits several times
    hits = staged(retrieval.dense_hits(vectors, rows, arms.k), "dense")
    if arms.hybrid.enabled:
        lexical = retrieval.lexical_hits(queries, rows.select("row_id", "text"), arms.k)
        hits = retrieval.fuse([(hits, arms.hybrid.dense_weight), (lexical, arms.hybrid.lexical_weight)], arms.k, arms.hybrid.rrf_k)
        hits = staged(hits, "fused")
    if arms.rerank.enabled:
        head = hits.where(F.col("rank") <= arms.rerank.top_n).join(rows.select("row_id", F.col("text").alias("passage")), "row_id").join(queries.select("query_id", "text"), "query_id")
        scores = head.select("query_id", "row_id", overlap_score(F.col("text"), F.col("passage")).alias("new_score"))
        hits = retrieval.rerank(hits, scores, arms.rerank.top_n)
    if lost is not None:
        hits = hits.join(lost, "query_id", "left").withColumn("degraded", F.col("degraded") + F.coalesce("lost", F.lit(0))).drop("lost")
    return hits


def settings(arms: set[str], cfg: Config = Config()) -> Config:
    if "rerank" in arms and cfg.models.reranker is None:
        raise ArmUnavailable("no reranker is configured")
    return cfg.with_arms(arms)


def permutations(arms: tuple[str, ...] = ARMS) -> list[tuple[str, ...]]:
    """All sets of arms, none first."""
    return [c for n in range(len(arms) + 1) for c in itertools.combinations(arms, n)]


def evaluate_arms(gold: DataFrame, rows: DataFrame, cfg: Config = Config(), arms: tuple[str, ...] = ARMS) -> tuple[DataFrame, dict[str, str]]:
    """One row per set of arms (arm, recall_5, mrr_10, degraded), and why others were skipped.

    gold(q_id, q, lang, doc_id, gold_pages, alt_sources); every set is one plan over all questions.
    """
    queries = gold.select(F.col("q_id").alias("query_id"), F.col("q").alias("text"))
    pages, out, skipped = evaluate.gold_pages(gold), None, {}
    for chosen in permutations(arms):
        name = "+".join(chosen) or "dense"
        try:
            one = settings(set(chosen), cfg)
        except ArmUnavailable as e:
            skipped[name] = str(e)
            continue
        hits = retrieve(queries, rows, one)
        placed = hits.join(rows.select("row_id", "doc_id", "page_start", "page_end"), "row_id").withColumnRenamed("query_id", "q_id")
        asked = gold.select("q_id", "lang", (F.size("gold_pages") > 0).alias("answerable"))
        scored = evaluate.per_question(asked, evaluate.relevant_hits(placed, pages)).where("answerable")
        lost = hits.groupBy("query_id").agg(F.max("degraded").alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("degraded"))
        row = scored.agg(F.lit(name).alias("arm"), evaluate.mean(F.col("recall_5")).alias("recall_5"), evaluate.mean(F.col("rr_10")).alias("mrr_10")).crossJoin(F.broadcast(lost))  # one row each
        out = row if out is None else out.unionByName(row)
    return out, skipped


def golden_pool(gold: DataFrame, seed: int = 7, decoys: int = 3) -> DataFrame:
    """Pages to search without an index: the gold pages, and decoys 1 to 40 pages on, by hash."""
    pages = evaluate.gold_pages(gold).distinct()
    more = pages.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(decoys))))
    more = more.select("q_id", "doc_id", (F.col("page") + F.pmod(F.xxhash64("q_id", "page", "i", F.lit(seed)), F.lit(40)) + 1).cast("int").alias("page"))
    return pages.unionByName(more).select("doc_id", "page").distinct()


def ask(queries: DataFrame, rows: DataFrame, cfg: Config = Config(), embedder: TextEmbedder | None = None, names: DataFrame | None = None) -> DataFrame:
    """Queries to answers: retrieval, gate, context, generation, verification."""
    hits = retrieve(queries, rows, cfg, embedder)
    return answer.answers(queries, retrieval.gate(queries, hits, cfg.retrieve.tau), hits, rows, cfg, names=names)
