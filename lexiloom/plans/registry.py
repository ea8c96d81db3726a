"""All registered queries of the retrieval engine, with their DuckDB equivalents.

Corpus: documents (lines are blocks), whole. Lexical queries: benchmark passages. Dense index:
embeddings, of which every one whose id is divisible by 20 is a query; equal labels are relevant.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import ChunkConfig, Config, GenerateConfig
from ..functions import citations, scripts, text as tx
from ..operators import answer, blocks, chunks, evaluate, index, retrieval, traces
from ..operators.seams import LetterEmbedder, embed, overlap_score
from ..schema import TRACE, conform
from ..sources.readers import table
from ..sources.staging import fresh_path
from . import compose, sql
from .base import ORACLE as ORACLE
from .base import QUERIES as QUERIES
from .base import docs_of, query

# --- scripts and text


@query(f"SELECT doc_id, {', '.join(f'{sql.bucket('text', b)} AS {b}' for b in scripts.BUCKETS)} FROM documents")
def script_histogram(spark, sf):
    return docs_of(spark, sf).select("doc_id", scripts.histogram(F.col("text")).alias("h")).select("doc_id", "h.*")


@query(f"SELECT doc_id, {sql.detect('text')} AS script FROM documents")
def script_detect(spark, sf):
    return docs_of(spark, sf).select("doc_id", scripts.detect(F.col("text")).alias("script"))


@query(f"WITH s AS (SELECT {sql.detect('text')} AS script FROM documents) SELECT script, CASE script {' '.join(f'WHEN {s!r} THEN {x!r}' for s, x in scripts.SCRIPT_LANG.items())} ELSE 'und' END AS lang_tag, count(*) AS n FROM s GROUP BY 1, 2")
def lang_for_script(spark, sf):
    s = docs_of(spark, sf).select(scripts.detect(F.col("text")).alias("script"))
    return s.groupBy("script").agg(F.count("*").alias("n")).withColumn("lang_tag", scripts.language_of(F.col("script")))


@query(f"SELECT doc_id, CAST({sql.count('text', sql.NOT_SPACE + '+')} AS INTEGER) AS n FROM documents")
def token_count(spark, sf):
    return docs_of(spark, sf).select("doc_id", tx.count_tokens(F.col("text"), scripts.detect(F.col("text"))).alias("n"))


@query(f"SELECT doc_id, round({sql.LEGACY}, 9) AS ratio FROM documents")
def legacy_ratio(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.round(scripts.legacy_ratio(F.col("text")), 9).alias("ratio"))


@query(f"SELECT doc_id, round({sql.MIXED}, 9) AS ratio FROM documents")
def mixed_script_ratio(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.round(scripts.mixed_ratio(F.col("text")), 9).alias("ratio"))


@query(
    f"WITH {sql.BLOCKS}, j AS (SELECT doc_id, max(page) AS n_pages, string_agg(text, '' ORDER BY reading_order) AS text, "
    f"CAST(sum(length(regexp_replace(text, {sql.quoted(f'^{sql.SPACE}+|{sql.SPACE}+$')}, '', 'g'))) AS DOUBLE) AS chars FROM blocks GROUP BY doc_id) "
    f"SELECT doc_id, n_pages, chars / n_pages >= {scripts.MIN_CHARS_PER_PAGE} AND {sql.MIXED} <= {scripts.MIXED_MAX} AND {sql.LEGACY} <= {scripts.LEGACY_MAX} AS has_text_layer FROM j"
)
def text_layer_gate(spark, sf):
    b = blocks.document_blocks(docs_of(spark, sf))
    pages = b.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return blocks.text_layer_gate(b, pages).select("doc_id", "n_pages", "has_text_layer")


@query(f"SELECT conv_id, turn, {sql.estimate('text')} AS n FROM conversations")
def estimate_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.estimate_tokens(F.col("text")).alias("n"))


@query(f"WITH {sql.normalised('documents', 'nd')} SELECT doc_id, text FROM nd")
def normalize_text(spark, sf):
    raw = tx.nfc(F.col("text"))
    rows = docs_of(spark, sf).withColumn("text", raw).withColumn("script", scripts.detect(F.col("text")))
    return rows.select("doc_id", tx.normalise(F.col("text"), F.col("script")).alias("text"))


@query(f"SELECT doc_id, len(words) AS n, array_to_string(words, ' ') AS tokens FROM (SELECT doc_id, {sql.tokens('text')} AS words FROM documents)")
def tokenize(spark, sf):
    rows = docs_of(spark, sf).select("doc_id", tx.tokens(F.col("text"), scripts.detect(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT conv_id, turn, CASE WHEN length(t) <= {tx.SNIPPET_CHARS} THEN t ELSE rtrim(substring(t, 1, {tx.SNIPPET_CHARS})) || '…' END AS snippet FROM (SELECT conv_id, turn, {sql.collapse('text')} AS t FROM conversations)")
def snippets(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.snippet(F.col("text")).alias("snippet"))


_FOUND = r"regexp_extract(head, '^\s*(\d+(?:[.\-]\d+)*)\s*[.):]?\s+\S', 1)"


@query(f"WITH h AS (SELECT doc_id, CAST(doc_id % 12 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '.2' ELSE '.2-7' END || CASE WHEN doc_id % 5 = 0 THEN 'x ' ELSE ') ' END || text AS head FROM documents) SELECT doc_id, CAST(CASE WHEN {_FOUND} = '' THEN 1 ELSE len(string_split_regex({_FOUND}, '[.\\-]')) END AS INTEGER) AS level FROM h")
def heading_level(spark, sf):
    d = F.col("doc_id")
    number = F.concat((d % 12).cast("string"), F.when(d % 3 == 0, "").when(d % 3 == 1, ".2").otherwise(".2-7"), F.when(d % 5 == 0, "x ").otherwise(") "))
    return docs_of(spark, sf).select("doc_id", tx.heading_level(F.concat(number, F.col("text"))).alias("level"))


@query(f"SELECT item_id, CASE WHEN {sql.detect('text')} = 'latn' THEN '(Answer in English.)' ELSE '' END AS reminder FROM benchmark")
def language_reminder(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.language_reminder(F.col("text")).alias("reminder"))


# --- blocks


@query(f"WITH {sql.BLOCKS} SELECT doc_id, page, reading_order, text, substring(doc_id, 1, 12) || ':' || page || ':' || lpad(CAST(reading_order AS VARCHAR), 5, '0') AS block_id FROM blocks")
def document_blocks(spark, sf):
    return blocks.document_blocks(docs_of(spark, sf))


_SIZE, _BOLD = "(8 + CAST(doc_id AS BIGINT) % 7)", "((reading_order % 5) / 4.0)"


@query(
    f"""WITH {sql.BLOCKS}, s AS (SELECT *, CAST(8 + (CAST(doc_id AS BIGINT) + reading_order) % 7 AS DOUBLE) AS size, (reading_order % 5) / 4.0 AS bold FROM blocks),
    w AS (SELECT doc_id, round(size, 1) AS size, sum(length(text)) AS chars FROM s GROUP BY 1, 2),
    b AS (SELECT doc_id, arg_max(size, {{'c': chars, 's': -size}}) AS body_size FROM w GROUP BY 1)
    SELECT doc_id, reading_order, body_size, CASE
      WHEN length(text) <= 400 AND (regexp_matches(text, '(?i)^\\s*(fig(?:ure)?|table|chart|plate|exhibit)\\.?\\s*\\d') OR (size / body_size <= 0.92 AND length(text) >= 12)) THEN 'caption'
      WHEN length(text) <= 120 AND (size / body_size >= 1.15 OR (bold >= 0.6 AND size / body_size >= 1.02)) THEN 'heading'
      WHEN regexp_matches(text, '{blocks.LIST_ITEM}') THEN 'list' ELSE 'paragraph' END AS kind FROM s JOIN b USING (doc_id)"""
)
def classify_blocks(spark, sf):
    b = blocks.document_blocks(docs_of(spark, sf))
    b = b.withColumn("size", (8 + (F.col("doc_id").cast("long") + F.col("reading_order")) % 7).cast("double")).withColumn("bold", (F.col("reading_order") % 5) / 4.0)
    rows = b.join(blocks.body_size(b), "doc_id")
    kind = blocks.classify(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size"), F.lit(False))
    return rows.select("doc_id", "reading_order", "body_size", kind.alias("kind"))


@query("SELECT text_hash, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY text_hash")
def dedupe_documents(spark, sf):
    rows = docs_of(spark, sf).select(F.sha2("text", 256).alias("text_hash"), F.col("doc_id").alias("ordinal"))
    return blocks.first_of_each(rows, "text_hash").select("text_hash", F.col("ordinal").alias("doc_id"), F.col("n_copies").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_quantity / 12.5, 0), l_extendedprice, l_linenumber) - 1 AS INTEGER) AS reading_order FROM lineitem")
def reading_order(spark, sf):
    items = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    box = F.struct(F.col("l_extendedprice").alias("x0"), F.col("l_quantity").cast("double").alias("y0"))
    rows = items.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "l_linenumber", box.alias("bbox"))
    # a page of 0.4 points: bands of 12.5
    return blocks.reading_order(rows, 0.4, "l_linenumber").select(F.col("doc_id").alias("l_orderkey"), "l_linenumber", "reading_order")


# --- lexical


def _bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _doc_rows(spark, sf):
    return docs_of(spark, sf).withColumnRenamed("doc_id", "row_id")


@query(f"WITH {sql.bm25()} SELECT row_id, len(t) AS doc_len, len(list_distinct(t)) AS n_terms, (SELECT round(avg_len, 6) FROM stats) AS avg_len FROM tok")
def bm25_documents(spark, sf):
    t = retrieval.tokenised(_doc_rows(spark, sf), "row_id")
    avg = t.agg(F.round(F.avg(F.size("tokens")), 6).alias("avg_len"))
    return t.select("row_id", F.size("tokens").cast("long").alias("doc_len"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms")).crossJoin(F.broadcast(avg))


@query(f"WITH {sql.bm25()} SELECT term, row_id, tf, doc_len FROM post")
def bm25_postings(spark, sf):
    return retrieval.postings(retrieval.tokenised(_doc_rows(spark, sf), "row_id")).withColumn("doc_len", F.col("doc_len").cast("long"))


@query(f"WITH {sql.bm25()} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs CROSS JOIN stats")
def bm25_idf(spark, sf):
    t = retrieval.tokenised(_doc_rows(spark, sf), "row_id")
    df = t.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = t.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(retrieval.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query(f"WITH {sql.bm25()} SELECT query_id, row_id, score, rank FROM lexical")
def bm25_topk(spark, sf):
    return retrieval.lexical_hits(_bench_queries(spark, sf), _doc_rows(spark, sf)).select("query_id", "row_id", "score", "rank")


# --- dense


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")


def _asked(v):
    """The stated query set."""
    return v.where(F.col("row_id") % sql.EVERY == 0)


def _dense(spark, sf, k=20, dims=None):
    v = _vectors(spark, sf)
    if dims:
        v = v.withColumn("vector", F.slice("vector", 1, dims))
    return retrieval.dense_hits(_asked(v).withColumnRenamed("row_id", "query_id"), v, k)


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v) SELECT vec_id, CAST(unnest(range(0, len(e))) AS INTEGER) AS place, round(unnest(list_transform(e, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END)), 6) + 0.0 AS value FROM n")
def l2_normalize(spark, sf):
    v = _vectors(spark, sf).select("row_id", F.posexplode(index.l2_normalise(F.col("vector"))).alias("place", "value"))
    return v.select(F.col("row_id").alias("vec_id"), "place", (F.round("value", 6) + 0.0).alias("value"))


@query(f"WITH {sql.dense()} SELECT query_id, row_id, score, rank FROM dense")
def dense_topk(spark, sf):
    return _dense(spark, sf).select("query_id", "row_id", "score", "rank")


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS bad_width, count(*) - count(DISTINCT vec_id) AS repeated FROM embeddings")
def index_validate(spark, sf):
    v = _vectors(spark, sf)
    bad = index.faults(v, 64, "row_id").agg(F.sum((F.col("fault") == "width").cast("long")).alias("w"), F.sum((F.col("fault") == "repeated").cast("long")).alias("r"))
    return v.agg(F.count("*").alias("n")).crossJoin(bad).select("n", F.coalesce("w", F.lit(0)).alias("bad_width"), F.coalesce("r", F.lit(0)).alias("repeated"))


_TOP_OTHER = "SELECT query_id, max(score) AS top_score FROM dense WHERE row_id <> query_id GROUP BY query_id"


@query(f"WITH {sql.dense()} SELECT query_id, top_score, coalesce(top_score < 0.45, true) AS abstained FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % {sql.EVERY} = 0) LEFT JOIN ({_TOP_OTHER}) USING (query_id)")
def abstain_gate(spark, sf):
    hits = _dense(spark, sf).where("row_id <> query_id").withColumn("gate_score", F.col("score"))
    return retrieval.gate(_asked(_vectors(spark, sf)).select(F.col("row_id").alias("query_id")), hits)


# --- fusion, reranking, rewriting

#: The second arm of fused vector searches: the first half of each vector, as a smaller embedder.
_HALF = 32


def _fused_sql(w1: float, w2: float, k: int = 20) -> str:
    return f"""WITH {sql.dense()}, {sql.dense(20, f'embedding[1:{_HALF}]', 'half')}, arms AS (SELECT query_id, row_id, rank, {w1} AS w, 0 AS arm FROM dense UNION ALL SELECT query_id, row_id, rank, {w2} AS w, 1 AS arm FROM half),
    {sql.fused('arms', k)} SELECT query_id, row_id, score, rank FROM fused"""


@query(_fused_sql(1.0, 1.0))
def rrf_fuse(spark, sf):
    return retrieval.fuse([(_dense(spark, sf), 1.0), (_dense(spark, sf, dims=_HALF), 1.0)], 20).select("query_id", "row_id", "score", "rank")


@query(_fused_sql(3.0, 1.0, 10))
def rrf_weighted(spark, sf):
    return retrieval.fuse([(_dense(spark, sf), 3.0), (_dense(spark, sf, dims=_HALF), 1.0)], 10).select("query_id", "row_id", "score", "rank")


_WORDS_ARM = """overlap AS (SELECT a.query_id, b.row_id, CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) AS hits FROM (SELECT query_id, list_distinct(list(term)) AS t FROM q GROUP BY query_id) a JOIN (SELECT row_id, list_distinct(t) AS t FROM tok) b ON true WHERE (a.query_id, b.row_id) IN (SELECT (query_id, row_id) FROM lexical))"""


def _overlap(spark, sf, hits):
    rows = hits.join(_doc_rows(spark, sf).withColumnRenamed("text", "passage"), "row_id").join(_bench_queries(spark, sf), "query_id")
    return rows.select("query_id", "row_id", "rank", "score", F.round(overlap_score(F.col("text"), F.col("passage")), 9).alias("new_score"))


_LETTERS = LetterEmbedder()


def _embedded(spark, sf):
    """Documents as rows of an index, with vectors."""
    path = F.array(F.lit("Part"), F.lit(""))
    rows = _doc_rows(spark, sf).select("row_id", F.col("row_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("page_start"), (F.col("row_id") % 2 + 1).cast("int").alias("page_end"), path.alias("heading_path"))
    return rows.withColumn("vector", embed(F.col("text"), _LETTERS))


_HYBRID_SQL = f"""{sql.bm25()}, {sql.letters()}, harms AS (SELECT query_id, row_id, rank, 1.0 AS w, 0 AS arm FROM ldense UNION ALL SELECT query_id, row_id, rank, 1.0 AS w, 1 AS arm FROM lexical),
    {sql.fused('harms', 20)}, gates AS (SELECT query_id, max(score) AS gate_score FROM ldense GROUP BY 1)"""


@query(f"WITH {_HYBRID_SQL} SELECT query_id, row_id, score, rank, gate_score FROM fused JOIN gates USING (query_id)")
def hybrid_topk(spark, sf):
    hits = compose.retrieve(_bench_queries(spark, sf), _embedded(spark, sf), Config().with_arms({"hybrid"}), _LETTERS)
    return hits.select("query_id", "row_id", "score", "rank", "gate_score")


@query(
    f"""WITH {sql.bm25()}, {_WORDS_ARM}, r AS (SELECT l.query_id, l.row_id, l.rank, o.hits / (SELECT count(*) FROM q WHERE q.query_id = l.query_id) AS s FROM lexical l JOIN overlap o USING (query_id, row_id))
    SELECT query_id, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, CASE WHEN rank <= 10 THEN round(s, 9) END DESC NULLS LAST, rank) AS INTEGER) AS rank FROM r"""
)
def rerank_topn(spark, sf):
    lexical = retrieval.lexical_hits(_bench_queries(spark, sf), _doc_rows(spark, sf))
    scores = _overlap(spark, sf, lexical).where("rank <= 10").select("query_id", "row_id", "new_score")
    return retrieval.rerank(lexical, scores, 10).select("query_id", "row_id", "rank")


_DANGLE = f"[{', '.join(map(sql.quoted, retrieval.DANGLING))}]"


@query(f"SELECT conv_id, turn, len(t) < 5 OR len(list_intersect(t, {_DANGLE})) > 0 AS rewrite, len(list_intersect(t, {_DANGLE})) > 0 AS dangling FROM (SELECT conv_id, turn, {sql.tokens('text')} AS t FROM conversations WHERE role = 'user')")
def rewrite_trigger(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'")
    t = tx.tokens(F.col("text"), scripts.detect(F.col("text")))
    return users.select("conv_id", "turn", retrieval.should_rewrite(F.col("text")).alias("rewrite"), retrieval.has_dangling(t).alias("dangling"))


# --- chunks


def _chunks(spark, sf):
    b = blocks.normalise_blocks(blocks.document_blocks(docs_of(spark, sf)))
    # every twelfth line of a document is its heading
    b = b.withColumn("kind", F.when(F.col("reading_order") % 12 == 0, "heading").otherwise("paragraph"))
    return chunks.build_chunks(b)


_CHUNK_SQL = f"WITH RECURSIVE {sql.chunk_tables(ChunkConfig())}"


@query(
    f"""{_CHUNK_SQL} SELECT substring(sha256(doc_id || '|' || array_to_string(block_ids, ',')), 1, 32) AS chunk_id, doc_id, chunk_no, page_start, page_end, CAST(len(block_ids) AS INTEGER) AS n_blocks,
    array_to_string(path, ' > ') AS path, token_count, CASE script {sql.SCRIPT_LANGS} ELSE 'und' END AS lang, script, sha256(text) AS text_sha256 FROM chunk_rows"""
)
def chunk_pack(spark, sf):
    c = _chunks(spark, sf)
    return c.select("chunk_id", "doc_id", "chunk_no", "page_start", "page_end", F.size("block_ids").alias("n_blocks"), F.array_join("heading_path", " > ").alias("path"), "token_count", "lang", "script", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT substring(sha256(doc_id || '|' || string_agg(block_id, ',' ORDER BY reading_order)), 1, 32) AS chunk_id, doc_id, page FROM (SELECT *, substring(doc_id, 1, 12) || ':' || page || ':' || lpad(CAST(reading_order AS VARCHAR), 5, '0') AS block_id FROM blocks) GROUP BY doc_id, page".join((f"WITH {sql.BLOCKS} ", "")))
def chunk_ids(spark, sf):
    b = blocks.document_blocks(docs_of(spark, sf))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block_id"))), lambda x: x["block_id"])
    return b.groupBy("doc_id", "page").agg(ids.alias("ids")).select(chunks.chunk_id(F.col("doc_id"), F.col("ids")).alias("chunk_id"), "doc_id", "page")


@query(f"{_CHUNK_SQL} SELECT script, count(*) AS n, min(token_count) AS least, max(token_count) AS most, round(avg(token_count), 3) AS mean FROM chunk_rows GROUP BY script")
def chunk_stats(spark, sf):
    return _chunks(spark, sf).groupBy("script").agg(F.count("*").alias("n"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 3).alias("mean"))


# --- evaluation: a dense query is answerable if its label is even; equal labels are relevant

_JUDGED = f"""WITH {sql.dense()}, first AS (SELECT d.query_id, min(rank) AS first_rank FROM (SELECT query_id, row_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM dense WHERE row_id <> query_id) d
      JOIN dense_u a ON a.vec_id = d.query_id JOIN dense_u b ON b.vec_id = d.row_id WHERE a.label = b.label GROUP BY 1),
    top AS ({_TOP_OTHER}),
    judged AS (SELECT vec_id AS q_id, CAST(label AS VARCHAR) AS lang, label % 2 = 0 AS answerable, coalesce(top_score < 0.75, true) AS abstained, first_rank,
      CAST(coalesce(first_rank <= 1, false) AS DOUBLE) AS recall_1, CAST(coalesce(first_rank <= 5, false) AS DOUBLE) AS recall_5, CAST(coalesce(first_rank <= 10, false) AS DOUBLE) AS recall_10,
      CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0.0 END AS rr_10
      FROM dense_u LEFT JOIN first ON first.query_id = vec_id LEFT JOIN top ON top.query_id = vec_id WHERE vec_id % {sql.EVERY} = 0)"""


def _judged(spark, sf, dims=None):
    labels = _vectors(spark, sf).select("row_id", "label")
    hits = retrieval.top_k(_dense(spark, sf, dims=dims).where("row_id <> query_id").drop("rank"), 20).withColumn("gate_score", F.col("score"))
    own = labels.select(F.col("row_id").alias("query_id"), F.col("label").alias("q_label"))
    pairs = hits.join(own, "query_id").join(labels, "row_id")
    relevant = pairs.where("label = q_label").select(F.col("query_id").alias("q_id"), "rank")
    qs = _asked(labels).select(F.col("row_id").alias("query_id"), "label")
    gated = qs.join(retrieval.gate(qs, hits, 0.75), "query_id")
    questions = gated.select(F.col("query_id").alias("q_id"), F.col("label").cast("string").alias("lang"), (F.col("label") % 2 == 0).alias("answerable"), "abstained")
    return evaluate.per_question(questions, relevant)


@query(f"{_JUDGED} SELECT q_id, recall_1, recall_5, recall_10 FROM judged")
def recall_at_k(spark, sf):
    return _judged(spark, sf).select("q_id", "recall_1", "recall_5", "recall_10")


@query(f"{_JUDGED} SELECT round(coalesce(avg(rr_10) FILTER (answerable), 0), 6) AS mrr_10, count(*) FILTER (answerable) AS n FROM judged")
def mrr(spark, sf):
    return _judged(spark, sf).agg(F.round(evaluate.mean(F.when(F.col("answerable"), F.col("rr_10"))), 6).alias("mrr_10"), F.count(F.when(F.col("answerable"), 1)).alias("n"))


@query(
    f"""{_JUDGED} SELECT lang, grouping(lang) = 1 AS is_total, count(*) AS n, {', '.join(f'round(coalesce(avg({c}) FILTER (answerable), 0), 6) AS {c}' for c in ('recall_1', 'recall_5', 'recall_10', 'rr_10'))},
    CAST(count(*) FILTER (abstained) AS BIGINT) AS n_abstained, CAST(count(*) FILTER (abstained AND NOT answerable) AS BIGINT) AS n_right,
    round(avg(CASE WHEN NOT answerable THEN 1.0 ELSE 0.0 END) FILTER (abstained), 6) AS abstain_precision FROM judged GROUP BY CUBE (lang)"""
)
def per_lang_metrics(spark, sf):
    return evaluate.metrics(_judged(spark, sf))


@query(f"{_JUDGED} SELECT answerable, abstained, count(*) AS n FROM judged GROUP BY 1, 2")
def confusion(spark, sf):
    return evaluate.confusion(_judged(spark, sf))


@query(f"{_JUDGED} SELECT round(CAST(count(*) FILTER (abstained AND NOT answerable) AS DOUBLE) / nullif(count(*) FILTER (abstained), 0), 6) AS precision, round(CAST(count(*) FILTER (abstained AND NOT answerable) AS DOUBLE) / nullif(count(*) FILTER (NOT answerable), 0), 6) AS recall FROM judged")
def abstain_scores(spark, sf):
    return evaluate.abstain_scores(_judged(spark, sf))


@query(f"{_JUDGED}, m AS (SELECT avg(recall_1) AS r1, avg(recall_5) AS r5, avg(recall_10) AS r10 FROM judged WHERE answerable) SELECT 1 AS k, round(r1, 6) AS recall FROM m UNION ALL SELECT 5, round(r5, 6) FROM m UNION ALL SELECT 10, round(r10, 6) FROM m")
def recall_curve(spark, sf):
    return evaluate.recall_curve(_judged(spark, sf))


@query(f"{_JUDGED} SELECT CASE WHEN first_rank IS NULL OR first_rank > 20 THEN 'never' WHEN first_rank = 1 THEN '1' WHEN first_rank <= 5 THEN '2-5' WHEN first_rank <= 10 THEN '6-10' ELSE '11-20' END AS bucket, count(*) AS n FROM judged WHERE answerable GROUP BY 1")
def rank_distribution(spark, sf):
    return evaluate.rank_distribution(_judged(spark, sf))


def _random_sql(k: int = 20, seed: int = 7) -> str:
    p, (a, b, c) = retrieval.PRIME, retrieval.MULTIPLIERS
    turn = f"(h * h + h * {a} + {b}) % {p} AS h"
    return f"""WITH p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, (q.vec_id % {p} * {a} + r.vec_id % {p} * {b} + {seed * c}) % {p} AS h FROM embeddings q, embeddings r WHERE q.vec_id % {sql.EVERY} = 0),
    m AS (SELECT query_id, row_id, {turn} FROM (SELECT query_id, row_id, {turn} FROM p))
    SELECT query_id, row_id, h / {p}.0 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h DESC, row_id) AS INTEGER) AS rank FROM m QUALIFY rank <= {k}"""


@query(_random_sql())
def random_floor(spark, sf):
    v = _vectors(spark, sf)
    qs = _asked(v).select(F.col("row_id").alias("query_id"))
    return retrieval.random_hits(qs, v, 20, 7).select("query_id", "row_id", "score", "rank")


def _judged_sql(name: str, vector: str) -> str:
    """_JUDGED's tables for another vector, under names of their own."""
    out = _JUDGED.removeprefix("WITH ").replace(sql.dense(), sql.dense(20, vector, name))
    for t in ("dense_u", "FROM dense ", "first AS", "JOIN first", "first.query_id", "top AS", "JOIN top", "top.query_id", "judged AS"):
        new = t.replace("dense", name) if "dense" in t else t.replace("first", f"{name}_first").replace("top", f"{name}_top").replace("judged", f"{name}_judged")
        out = out.replace(t, new)
    return out


@query(
    f"""{_JUDGED}, {_judged_sql('half', f'embedding[1:{_HALF}]')}, base AS (SELECT avg(recall_5) AS b5, avg(rr_10) AS bm FROM judged WHERE answerable),
    arms AS (SELECT 'full' AS arm, avg(recall_5) AS recall_5, avg(rr_10) AS mrr_10, 0 AS degraded FROM judged WHERE answerable UNION ALL SELECT 'half', avg(recall_5), avg(rr_10), 0 FROM half_judged WHERE answerable UNION ALL SELECT 'lost', 0.0, 0.0, 3)
    SELECT arm, CASE WHEN degraded = 0 THEN round(recall_5, 6) END AS recall_5, CASE WHEN degraded = 0 THEN round(recall_5 - b5, 6) END AS d_recall_5, CASE WHEN degraded = 0 THEN round(mrr_10, 6) END AS mrr_10, CASE WHEN degraded = 0 THEN round(mrr_10 - bm, 6) END AS d_mrr_10, degraded FROM arms CROSS JOIN base"""
)
def sweep_delta(spark, sf):
    def row(arm, dims):
        return _judged(spark, sf, dims).where("answerable").agg(F.lit(arm).alias("arm"), F.avg("recall_5").alias("recall_5"), F.avg("rr_10").alias("mrr_10"), F.lit(0).alias("degraded"))

    full = row("full", None)
    lost = spark.createDataFrame([("lost", 0.0, 0.0, 3)], full.schema)
    return evaluate.sweep(full.unionByName(row("half", _HALF)).unionByName(lost), full)


# --- answers


def _context(spark, sf):
    hits = retrieval.lexical_hits(_bench_queries(spark, sf), _doc_rows(spark, sf), 5)
    return answer.context_blocks(hits, _embedded(spark, sf).drop("vector"))


_HEAD = "'[' || rank || '] ' || substring(CAST(row_id AS VARCHAR), 1, 8) || ' / ' || CASE WHEN row_id % 2 = 0 THEN 'p.1' ELSE 'pp.1-2' END || ' | Part' || chr(10)"


@query(f"""WITH {sql.bm25(5)} SELECT query_id, rank AS context_no, row_id, CAST(row_id AS VARCHAR) AS doc_id, {_HEAD} || text AS block FROM lexical JOIN documents ON doc_id = row_id""")
def context_blocks(spark, sf):
    return _context(spark, sf)


def _fit_sql(hits: str, budget: int) -> str:
    """CTEs from hits (query_id, row_id, rank) to fitted(query_id, n, all_n, prompt, tokens)."""
    note = f"CASE WHEN {sql.detect('b.text')} = 'latn' THEN '(Answer in English.)' || chr(10) ELSE '' END"
    return f"""ctx AS (SELECT query_id, rank, row_id, documents.text AS body, {_HEAD} || documents.text AS block FROM {hits} JOIN documents ON doc_id = row_id WHERE rank <= 5),
    tries AS (SELECT a.query_id, a.rank AS n, string_agg(c.block, chr(10) || chr(10) ORDER BY c.rank) AS context FROM ctx a JOIN ctx c ON c.query_id = a.query_id AND c.rank <= a.rank GROUP BY 1, 2),
    prompts AS (SELECT query_id, n, {sql.quoted(answer.SYSTEM)} || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || {note} || 'Answer:' AS prompt FROM tries JOIN benchmark b ON b.item_id = query_id),
    priced AS (SELECT *, {sql.estimate('prompt')} AS tokens, max(n) OVER (PARTITION BY query_id) AS all_n FROM prompts),
    fitted AS (SELECT * FROM priced WHERE n = 1 OR tokens <= {budget} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1)"""


@query(f"WITH {sql.bm25(5)}, {_fit_sql('lexical', GenerateConfig().max_prompt_tokens)} SELECT query_id, CAST(n AS INTEGER) AS n_context, CAST(all_n - n AS INTEGER) AS n_dropped, tokens AS prompt_tokens, sha256(prompt) AS prompt_sha256 FROM fitted")
def fit_context(spark, sf):
    fitted = answer.fit_context(_bench_queries(spark, sf), _context(spark, sf))
    return fitted.select("query_id", "n_context", "n_dropped", "prompt_tokens", F.sha2("prompt", 256).alias("prompt_sha256"))


#: Between the cosines of letter counts of near and far passages, so that some queries are declined.
_TAU = 0.97


def _answer_config():
    cfg = Config().with_arms({"hybrid"})
    return replace(cfg, retrieve=replace(cfg.retrieve, tau=_TAU))


_SENTENCE = r"regexp_extract(body, '^([^\n]*?[.!?]|[^\n]*)(?:\s|$)', 1)"


@query(
    f"""WITH {_HYBRID_SQL}, open AS (SELECT f.* FROM fused f JOIN gates USING (query_id) WHERE gate_score >= {_TAU}), {_fit_sql('open', GenerateConfig().max_prompt_tokens)},
    said AS (SELECT query_id, string_agg({_SENTENCE} || ' [' || c.rank || ']', ' ' ORDER BY c.rank) AS clean, list(row_id ORDER BY c.rank) AS rows_ FROM ctx c JOIN fitted USING (query_id) WHERE c.rank <= least(n, 2) GROUP BY 1)
    SELECT item_id AS query_id, coalesce(clean, {sql.quoted(answer.ABSTAIN)}) AS answer, coalesce(array_to_string(rows_, ','), '') AS citations, clean IS NULL AS abstained, false AS model_abstained, CASE WHEN clean IS NOT NULL THEN 1.0 END AS groundedness,
    CASE WHEN clean IS NOT NULL AND {sql.detect('text')} <> 'unknown' AND {sql.detect('clean')} <> 'unknown' THEN CAST({sql.detect('text')} = {sql.detect('clean')} AS INTEGER) ELSE -1 END AS language_match, coalesce(tokens, 0) AS prompt_tokens
    FROM benchmark LEFT JOIN said ON said.query_id = item_id LEFT JOIN fitted ON fitted.query_id = item_id"""
)
def answer_batch(spark, sf):
    out = compose.ask(_bench_queries(spark, sf), _embedded(spark, sf), _answer_config(), _LETTERS)
    match = F.coalesce(F.col("language_match").cast("int"), F.lit(-1))
    return out.withColumns({"language_match": match, "citations": F.array_join(F.col("citations").cast("array<string>"), ","), "prompt_tokens": F.coalesce("prompt_tokens", F.lit(0))})


#: Before and behind a turn's code: markers among its first words, and between the code and its other words.
_CITED = r"""w AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations WHERE role = 'user'),
    c AS (SELECT conv_id, turn, coalesce(w[1], '') || ' [' || (turn + 1) || '] ' || array_to_string(w[2:3], ' ') || ' ' AS a, '`x [4]`' AS code, ' [2, ' || (conv_id % 9) || '] ' || array_to_string(w[4:], ' ') || ' [9]' AS b, [turn + 1, 2, conv_id % 9, 9] AS ns FROM w),
    k AS (SELECT *, list_filter([ns[1]], lambda n: n BETWEEN 1 AND 5) AS k1, list_filter(list_distinct([ns[2], ns[3]]), lambda n: n BETWEEN 1 AND 5) AS k2 FROM c)"""


def _cited(spark, sf):
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    text = F.concat(
        F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.array_join(F.slice(words, 2, 2), " "), F.lit(" `x [4]` [2, "),
        (F.col("conv_id") % 9).cast("string"), F.lit("] "), F.array_join(F.slice(words, F.lit(4), F.greatest(F.size(words), F.lit(1))), " "), F.lit(" [9]"),
    )
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", text.alias("text"))


@query(f"WITH {_CITED} SELECT conv_id, turn, array_to_string(ns, ',') AS numbers FROM k")
def citation_markers(spark, sf):
    return _cited(spark, sf).select("conv_id", "turn", F.array_join(citations.find_markers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


@query(
    f"""WITH {_CITED}, s AS (SELECT conv_id, turn, k1, k2, code, a, b, (turn + 1) NOT BETWEEN 1 AND 5 AS gone1 FROM k),
    p AS (SELECT conv_id, turn, k1, k2, code,
        CASE WHEN len(k1) > 0 THEN a WHEN regexp_matches(a, '^[ ]') THEN ' ' || regexp_replace(a, '^[ ]*\\[\\d+\\][ ]*', '') ELSE regexp_replace(a, '[ \\t]*\\[\\d+\\]([ ])', '\\1') END AS a2,
        ' ' || array_to_string(list_transform([2] || list_filter(k2, lambda n: n <> 2), lambda n: '[' || n || ']'), '') || regexp_replace(regexp_replace(b, '^ \\[2, \\d+\\]', ''), '[ \\t]*\\[9\\]$', '') AS b2 FROM s)
    SELECT conv_id, turn, a2 || code || b2 AS clean, array_to_string(list_sort(list_distinct(k1 || k2)), ',') AS used FROM p"""
)
def citation_verify(spark, sf):
    rows = _cited(spark, sf).withColumn("v", citations.verify(F.col("text"), F.lit(5)))
    return rows.select("conv_id", "turn", F.col("v.text").alias("clean"), F.array_join(F.col("v.used").cast("array<string>"), ",").alias("used"))


@query(f"WITH {_CITED} SELECT conv_id, turn, round((len(k1) + len(k2)) / 4.0, 6) AS groundedness FROM k")
def groundedness(spark, sf):
    rows = _cited(spark, sf).withColumn("v", citations.verify(F.col("text"), F.lit(5)))
    return rows.select("conv_id", "turn", F.round(citations.groundedness(F.col("v.emitted"), F.col("v.grounded")), 6).alias("groundedness"))


# --- traces: events stand in, event_type as stage and value as duration


def _traces(spark, sf):
    """Whole trace rows."""
    e = table(spark, sf, "events")
    stages = F.array(F.struct(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms")))
    devices = F.array(F.struct(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.lit("GPU").alias("requested"), F.when(F.col("event_id") % 4 == 0, "CPU").otherwise("GPU").alias("device")))
    own = {"trace_id": F.col("event_id").cast("string"), "started_at": F.col("ts").cast("timestamp"), "query": F.col("props"), "lang": F.lit("en"), "config_hash": F.lit("c"), "tier": F.lit(1), "abstained": F.lit(False), "n_retrieved": F.lit(0), "n_citations": F.lit(0), "total_ms": F.col("value"), "stages": stages, "devices": devices}
    rows = e.select(*[c.alias(n) for n, c in own.items()])
    return conform(rows.withColumns({f: F.lit(None) for f in TRACE.fieldNames() if f not in own}), TRACE)


@query("SELECT event_type AS stage, round(avg(value), 6) AS mean_ms, count(*) AS n FROM events GROUP BY 1")
def stage_means(spark, sf):
    return traces.stage_means(_traces(spark, sf))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total_ms FROM events GROUP BY 1")
def daily_traces(spark, sf):
    traces.write_traces(_traces(spark, sf), log := fresh_path(spark, "traces"))
    t = traces.read_traces(spark, log)
    return t.groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("total_ms"), 4).alias("total_ms"))


@query("SELECT 'm' || (user_id % 3) AS model, count(*) AS n, CAST(count(*) FILTER (event_id % 4 = 0) AS BIGINT) AS n_fell_back FROM events GROUP BY 1")
def device_fallback(spark, sf):
    return traces.fallbacks(_traces(spark, sf))


from . import pages as pages  # noqa: E402  (registers its queries)
from . import stored as stored  # noqa: E402  (registers its queries)
