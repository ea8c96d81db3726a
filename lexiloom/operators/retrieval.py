"""Retrieval for many queries at once: dense, lexical, fused, reranked, rewritten.

Hits have query_id, row_id, score, rank, arm, gate_score and degraded. Payload is joined
after ranking. gate_score is always a cosine, whatever unit score has.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.scripts import detect
from ..schema import struct
from ..sources.staging import staged

# The constants of BM25.
K1, B = 1.5, 0.75
# Words that point at something said before.
DANGLING = ["it", "its", "this", "that", "these", "those", "they", "them", "their", "he", "she", "his", "her", "him", "one", "ones", "former", "latter", "same", "above", "below"]
#: Queries of one block, and rows of one block.
QUERIES_PER_PASS, ROWS_PER_BLOCK = 4096, 8192
#: Blocks of queries whose best rows one task keeps, and the bytes of one Arrow batch of blocks.
QUERY_BLOCKS_PER_TASK, BATCH_BYTES = 8, 16_777_216
#: Query terms, and pairs of query and term, that may be broadcast (some 40 bytes each).
BROADCAST_TERMS, BROADCAST_PAIRS = 200_000, 500_000
#: Rows scored at once, and terms of a block of queries that are scored as a matrix.
ROWS_AT_ONCE, DENSE_TERMS = 512, 256


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """Best k rows per query, by score rounded to 6 places, then by the tie columns."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("row_id",)))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(v: Column, q: Column) -> Column:
    """Cosine in double; 0 if either is zero. For few rows; dense_hits is for many."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)

    norm = F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))
    return F.when(norm > 0, dot(v, q) / norm).otherwise(0.0)


def _packed(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """Rows as blocks (ids, m) of at most most rows in the order of their ids, vectors of unit length."""
    wide = "vector" in rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), most):
                part = f.iloc[i : i + most].sort_values(id_col)
                v = np.stack(part.vector.to_numpy()).astype(np.float64) if wide else np.empty((len(part), 0))
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
                yield pd.DataFrame({"ids": [part[id_col].to_numpy(np.int64).tobytes()], "m": [v.tobytes()]})

    return rows.select(id_col, *["vector"] * wide).mapInPandas(run, "ids binary, m binary")


def _best(score: Callable, k: int, scale: int) -> Callable:
    """Whole scores of pairs of blocks to k rows a query; what a task has seen of a query is merged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for f in frames:
            for q_ids, q_m, r_ids, r_m in f[["q_ids", "q_m", "r_ids", "r_m"]].itertuples(index=False):
                ids, rows = np.frombuffer(q_ids, np.int64), np.frombuffer(r_ids, np.int64)
                q, v = np.frombuffer(q_m).reshape(len(ids), -1), np.frombuffer(r_m).reshape(len(rows), -1)
                n, take, found = len(rows), min(k, len(rows)), []
                for i in range(0, len(ids), 256):
                    # rows are in the order of their ids: the place breaks ties
                    key = score(ids[i : i + 256], q[i : i + 256], rows, v) * n + np.arange(n - 1, -1, -1)
                    found.append(np.partition(key, n - take, axis=1)[:, n - take :])
                key = np.concatenate(found)
                points, at = key // n, rows[n - 1 - key % n]
                if q_ids in kept:
                    points, at = np.hstack([kept[q_ids][0], points]), np.hstack([kept[q_ids][1], at])
                    order = np.lexsort((at, -points), axis=1)[:, :k]
                    points, at = np.take_along_axis(points, order, 1), np.take_along_axis(at, order, 1)
                kept[q_ids] = points, at
        for q_ids, (points, at) in kept.items():
            ids = np.frombuffer(q_ids, np.int64)
            for i in range(0, len(ids), 512):
                x = points[i : i + 512]
                yield pd.DataFrame({"query_id": np.repeat(ids[i : i + 512], x.shape[1]), "row_id": at[i : i + 512].ravel(), "score": x.ravel() / scale + 0.0})

    return run


def _search(queries: DataFrame, rows: DataFrame, score: Callable, k: int, scale: int) -> DataFrame:
    """Best k rows of each query, each block of queries against each block of rows on the workers."""
    conf, key = queries.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not (now := conf.get(key, None) or "").isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    # as many tasks as there are blocks for, and no more than the session's partitions
    q_parts = max(1, -(-queries.count() // (QUERIES_PER_PASS * QUERY_BLOCKS_PER_TASK)))
    r_parts = max(1, min(-(-rows.count() // ROWS_PER_BLOCK), -(-int(conf.get("spark.sql.shuffle.partitions")) // q_parts)))
    q = _packed(queries, "query_id", QUERIES_PER_PASS).toDF("q_ids", "q_m").repartition(q_parts)
    r = _packed(rows, "row_id", ROWS_PER_BLOCK).toDF("r_ids", "r_m").repartition(r_parts)
    pairs = r.hint("shuffle_replicate_nl").crossJoin(q)  # never broadcast: that passes through the driver
    return top_k(pairs.mapInPandas(_best(score, k, scale), "query_id long, row_id long, score double"), k)


def _cosines(ids: np.ndarray, q: np.ndarray, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.rint(q @ v.T * 1e6).astype(np.int64)


def dense_hits(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """Exact top k by cosine. queries(query_id, vector), vectors(row_id, vector).

    Both sides are packed into blocks, and each pair of blocks is one matrix product that keeps
    k rows a query. Neither side passes through the driver.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    ranked = _search(queries, vectors, _cosines, k, 10**6)
    return ranked.withColumns({"arm": F.lit("dense"), "gate_score": F.max("score").over(Window.partitionBy("query_id")), "degraded": F.lit(0)})


def tokenised(rows: DataFrame, id_col: str, script: Column | None = None) -> DataFrame:
    return rows.select(F.col(id_col), tx.tokens(F.col("text"), detect(F.col("text")) if script is None else script).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, row_id, tf, doc_len)"""
    rows = tokens.select("row_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return rows.groupBy("term", "row_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def _words(text: str, pairs: bool) -> list[str]:
    """functions.text.tokens of a folded text: str.split knows the same white space."""
    if pairs:
        solid = "".join(text.split())
        return [solid[i : i + 2] for i in range(len(solid) - 1)] or [solid] * bool(solid)
    return [t for t in (w.strip(tx.EDGE_PUNCTUATION) for w in text.split()) if t]


def _tokenising(rows: DataFrame) -> DataFrame:
    """(row_id, folded, pairs): folded, and told how to be cut, by the same expressions as tokens."""
    text = F.coalesce("text", F.lit(""))
    return rows.select(F.col("row_id").cast("long").alias("row_id"), tx.fold(text).alias("folded"), detect(text).isin(*tx.NON_SEGMENTING_SCRIPTS).alias("pairs"))


def _known_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(row_id, doc_len, terms, tfs): the length of each row that has tokens, and how often it has which of the terms, by place."""
    schema = struct("row_id long, doc_len int, terms array<int>, tfs array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            ids, sizes, ends, found, tfs = [], [], [0], [], []
            for row_id, text, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, own = 0, {}
                if pairs:
                    words = _words(text, True)
                    size = len(words)
                    own = {at[w]: n for w, n in Counter(words).items() if w in at}
                else:
                    # distinct words are stripped once
                    for w, n in Counter(text.split()).items():
                        if w := w.strip(tx.EDGE_PUNCTUATION):
                            size += n
                            if (i := at.get(w)) is not None:
                                own[i] = own.get(i, 0) + n
                if size:
                    ids.append(row_id)
                    sizes.append(size)
                    found.extend(own)
                    tfs.extend(own.values())
                    ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, tfs)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), *lists], schema.fieldNames())

    return _tokenising(rows).mapInArrow(run, schema)


def _best_by_worth(counts: DataFrame, asked: list[tuple[int, int, float]], avg_len: float, k: int) -> DataFrame:
    """(query_id, row_id, score), k rows a query and task: rows of _known_terms against all pairs (query_id, term, worth).

    A part of the rows against a block of queries is one sparse sum: what a row has of a term is added to
    the queries that have the term. Terms of many queries are a matrix product.
    """
    ids, q_at = np.unique(np.array([q for q, _, _ in asked], np.int64), return_inverse=True)
    term, worth = np.array([t for _, t, _ in asked], np.int64), np.array([w for _, _, w in asked], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for first in range(0, len(ids), QUERIES_PER_PASS):
            inside = (q_at >= first) & (q_at < first + QUERIES_PER_PASS)
            blocks.append(_Worths(q_at[inside] - first, term[inside], worth[inside], min(QUERIES_PER_PASS, len(ids) - first)))
        kept: list = [None] * len(blocks)
        for batch in batches:
            row_ids, lens = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = batch.column(2).offsets.to_numpy()
            of = np.repeat(np.arange(len(row_ids)), np.diff(ends))
            found, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.float64)
            part = tf / (tf + K1 * (1 - B + B * lens[of] / avg_len))
            for a in range(0, len(row_ids), ROWS_AT_ONCE):
                z = min(a + ROWS_AT_ONCE, len(row_ids))
                own = slice(np.searchsorted(of, a), np.searchsorted(of, z))
                for n, block in enumerate(blocks):
                    score = block.scores(of[own] - a, found[own], part[own], z - a)
                    kept[n] = _merged(kept[n], np.where(score > 0, np.rint(score * 1e6), -1).astype(np.int64), row_ids[a:z], k)
        for n, best in enumerate(kept):
            if best is not None:
                points, rows = best
                there = points >= 0
                q = np.repeat(ids[n * QUERIES_PER_PASS : n * QUERIES_PER_PASS + len(points)], points.shape[1])[there.ravel()]
                yield pa.record_batch([pa.array(q), pa.array(rows[there]), pa.array(points[there] / 1e6)], ["query_id", "row_id", "score"])

    return counts.mapInArrow(run, "query_id long, row_id long, score double")


class _Worths:
    """Worths of terms for the queries of one block."""

    def __init__(self, query: np.ndarray, term: np.ndarray, worth: np.ndarray, n: int):
        order = np.argsort(term, kind="stable")
        self.query, self.worth, self.n = query[order], worth[order], n
        names, self.first, self.many = np.unique(term[order], return_index=True, return_counts=True)
        self.place = np.full(int(term.max()) + 1, -1) if len(term) else np.empty(0, np.int64)
        self.place[names] = np.arange(len(names))
        # terms of more than a sixteenth of the queries: dense
        self.dense = np.full(len(names), -1)
        often = np.flatnonzero(self.many * 16 > n)[:DENSE_TERMS]
        self.dense[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), n))
        for i, t in enumerate(often):
            own = slice(self.first[t], self.first[t] + self.many[t])
            np.add.at(self.matrix[i], self.query[own], self.worth[own])

    def scores(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores of n_rows rows for each query: more than 0 where any term is shared."""
        known = term < len(self.place)
        row, part, t = row[known], part[known], self.place[term[known]]
        row, part, t = row[t >= 0], part[t >= 0], t[t >= 0]
        d = self.dense[t]
        of_rows = np.zeros((n_rows, len(self.matrix)))
        of_rows[row[d >= 0], d[d >= 0]] = part[d >= 0]
        row, part, t = row[d < 0], part[d < 0], t[d < 0]
        many = self.many[t]
        at = np.repeat(self.first[t] - np.r_[0, np.cumsum(many)[:-1]] if len(t) else t, many) + np.arange(many.sum())
        cell = self.query[at] * n_rows + np.repeat(row, many)
        score = np.bincount(cell, self.worth[at] * np.repeat(part, many), self.n * n_rows).reshape(self.n, n_rows)
        return score + self.matrix.T @ of_rows.T if len(self.matrix) else score


def _merged(kept: tuple | None, points: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query, by points and then by the smaller row_id; no hit has -1 points."""
    order = np.argsort(rows, kind="stable")
    rows, points = rows[order], points[:, order]
    n, take = len(rows), min(k, len(rows))
    key = points * n + np.arange(n - 1, -1, -1)  # the place breaks ties
    key = np.partition(key, n - take, axis=1)[:, n - take :]
    points, at = key // n, rows[n - 1 - key % n]
    if kept is not None:
        points, at = np.hstack([kept[0], points]), np.hstack([kept[1], at])
    order = np.lexsort((at, -points), axis=1)[:, :k]
    return np.take_along_axis(points, order, 1), np.take_along_axis(at, order, 1)


def lexical_hits(queries: DataFrame, rows: DataFrame, k: int = 20, stats: DataFrame | None = None) -> DataFrame:
    """BM25 top k. queries(query_id, text), rows(row_id, text). Rows without a match are no hits.

    Texts are cut into tokens once; of each row its length and the terms that some query has are written.
    Where terms and pairs of query and term are few enough to be handed to every task, these counts are
    scored where they lie: a task keeps k rows a query, and no posting is shuffled. More of them, and rows
    that share an id or have none, are counted and joined by shuffle. Hits are written once, whatever reads them.
    """
    ranked = staged(_lexical(queries, rows, k, stats), "lexical")
    return ranked.withColumns({"arm": F.lit("lexical"), "gate_score": F.lit(None).cast("double"), "degraded": F.lit(0)})


def _lexical(queries: DataFrame, rows: DataFrame, k: int, stats: DataFrame | None) -> DataFrame:
    """(query_id, row_id, score, rank) of lexical_hits."""
    q = staged(tokenised(queries, "query_id").select("query_id", F.explode(F.array_distinct("tokens")).alias("term")), "query_terms")
    if stats is not None or k < 1 or q.where("query_id IS NULL").count() or q.count() > BROADCAST_PAIRS or q.select("term").distinct().count() > BROADCAST_TERMS:
        return _lexical_by_shuffle(q, rows, k, stats)
    if not {queries.schema["query_id"].dataType.typeName(), rows.schema["row_id"].dataType.typeName()} <= {"long"}:
        return _lexical_by_shuffle(q, rows, k, stats)
    pairs = [(r.query_id, r.term) for r in q.collect()]  # BROADCAST_PAIRS at most
    terms = sorted({t for _, t in pairs})
    counts = staged(_known_terms(rows, terms), "known_terms")
    shared = counts.select("row_id").groupBy("row_id").count().where("count > 1 OR row_id IS NULL")
    if not shared.isEmpty():
        return _lexical_by_shuffle(q, rows, k, stats)
    n, total = rows.count(), counts.agg(F.sum("doc_len")).first()[0] or 0
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # BROADCAST_TERMS at most
    at = {t: i for i, t in enumerate(terms)}
    asked = [(query_id, at[t], math.log1p((n - df[at[t]] + 0.5) / (df[at[t]] + 0.5)) * (K1 + 1)) for query_id, t in pairs if at[t] in df]
    best = _best_by_worth(counts, asked, total / n if n else 1.0, k)
    return top_k(best, k)


def _lexical_by_shuffle(q: DataFrame, rows: DataFrame, k: int, stats: DataFrame | None) -> DataFrame:
    """_lexical for any number of terms and queries: AQE splits frequent terms.

    q: (query_id, term). Tokens that some query has are counted by row and term, all others of a row
    together, which is enough for lengths; these counts are written and everything else follows from them.
    """
    wanted = q.select("term").distinct().withColumn("asked", F.lit(True))
    few = wanted.count() <= BROADCAST_TERMS
    each = tokenised(rows, "row_id").select("row_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    known = each.join(F.broadcast(wanted) if few else wanted, "term", "left")
    counts = known.select("row_id", "doc_len", F.when(F.col("asked"), F.col("term")).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    # together by row: what a task adds up below is whole before it is shuffled
    counts = staged(counts.repartition("row_id"), "term_counts")
    if stats is None:
        sizes = rows.agg(F.count("*").alias("n")).crossJoin(counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")))
        stats = sizes.select("n", (F.col("t") / F.col("n")).alias("avg_len"))
    post = counts.where("term IS NOT NULL")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    asked = q.join(F.broadcast(df) if few else df, "term").crossJoin(F.broadcast(stats))  # stats: one row
    asked = asked.select("query_id", "term", "avg_len", (idf(F.col("df"), F.col("n")) * (K1 + 1)).alias("worth"))
    pairs = post.join(F.broadcast(asked) if q.count() <= BROADCAST_PAIRS else asked, "term")
    part = F.col("worth") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    scored = pairs.groupBy("query_id", "row_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scored, k)


def fuse(arms: list[tuple[DataFrame, float]], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion over stated ranks. One arm alone keeps its scores.

    Ties go to the row seen first: by arm, then by rank. gate_score is the dense arm's.
    """
    if not arms:
        raise ValueError("nothing to fuse")
    if rrf_k < 1:
        raise ValueError("rrf_k must be at least 1")
    if len(arms) == 1:
        return arms[0][0].where(F.col("rank") <= k)
    rows = None
    for n, (hits, weight) in enumerate(arms):
        # Arms are partitioned alike, but a union of branches that adaptive execution coalesces
        # apart does not stay so although Spark 4.1 plans on it: a computed key makes the
        # grouping below exchange rows itself.
        key = F.abs(F.col("query_id")) * F.signum("query_id").cast("long")
        one = hits.select(key.alias("query_id"), "row_id", "rank", "gate_score", "degraded", F.lit(float(weight)).alias("w"), F.lit(n).alias("arm_no"))
        rows = one if rows is None else rows.unionByName(one)
    summed = rows.groupBy("query_id", "row_id").agg(
        F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("arm_no", "rank")).alias("seen"),
    )
    gates = rows.groupBy("query_id").agg(F.max("gate_score").alias("gate_score"), F.max("degraded").alias("degraded"))
    out = top_k(summed, k, "seen", "row_id").join(gates, "query_id")
    return out.select("query_id", "row_id", "score", "rank", F.lit("fused").alias("arm"), "gate_score", "degraded")


def rerank(hits: DataFrame, scores: DataFrame, top_n: int = 10) -> DataFrame:
    """scores(query_id, row_id, new_score) order the first top_n; the rest follow as they were.

    Queries with fewer than two hits stay; a query with a missing score keeps its ranking and
    counts as degraded.
    """
    rows = hits.join(scores, ["query_id", "row_id"], "left")
    per = Window.partitionBy("query_id")
    head = F.col("rank") <= top_n
    failed = F.max(head & F.col("new_score").isNull()).over(per)
    alone = F.count("*").over(per) < 2
    rows = rows.withColumn("skip", failed | alone).withColumn("degraded", F.col("degraded") + (failed & ~alone).cast("int"))
    rows = rows.withColumn("key", F.when(head & ~F.col("skip"), F.col("new_score"))).withColumn("head", head)
    place = per.orderBy(F.desc("head"), F.desc_nulls_last("key"), "rank")
    out = rows.withColumn("place", F.row_number().over(place))
    score = F.when(F.col("key").isNotNull(), F.col("key")).otherwise(F.col("score"))
    return out.select("query_id", "row_id", score.alias("score"), F.col("place").alias("rank"), F.lit("rerank").alias("arm"), "gate_score", "degraded")


def has_dangling(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, DANGLING)))


def should_rewrite(query: Column, max_tokens: int = 5) -> Column:
    t = tx.tokens(query, detect(query))
    return (F.size(t) < max_tokens) | has_dangling(t)


def clean_rewrite(raw: Column) -> Column:
    """First line that is not empty once quotes are off."""
    lines = F.transform(F.split(raw, r"\r?\n"), lambda x: F.btrim(F.btrim(F.btrim(x), F.lit("\"'“”"))))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def rewritten(queries: DataFrame, raw: Column, max_tokens: int = 5) -> DataFrame:
    """queries with text replaced where a rewrite is called for and usable."""
    clean = clean_rewrite(raw)
    usable = (clean != "") & (F.length(clean) <= 4 * F.length("text") + 80)
    called = should_rewrite(F.col("text"), max_tokens)
    return queries.withColumn("degraded", (called & ~usable).cast("int")).withColumn("text", F.when(called & usable, clean).otherwise(F.col("text")))


def gate(queries: DataFrame, hits: DataFrame, tau: float = 0.45) -> DataFrame:
    """query_id, top_score, abstained: no hits, no cosine or one below tau."""
    top = hits.groupBy("query_id").agg(F.max("gate_score").alias("top_score"))
    return queries.select("query_id").join(top, "query_id", "left").withColumn("abstained", F.coalesce(F.col("top_score") < tau, F.lit(True)))


# A seeded order of pairs by arithmetic that any engine has: no product passes 2**63.
PRIME, MULTIPLIERS = 1_000_003, (7919, 104_729, 15_485_863)


def _mixed(seed: int) -> Callable:
    """Points below PRIME for pairs of ids."""

    def score(ids: np.ndarray, q: np.ndarray, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        a, b, c = MULTIPLIERS
        h = ((ids % PRIME * a)[:, None] + (rows % PRIME * b)[None] + seed * c) % PRIME
        for _ in range(2):
            h = (h * h + h * a + b) % PRIME
        return h

    return score


def random_hits(queries: DataFrame, rows: DataFrame, k: int, seed: int) -> DataFrame:
    """A seeded floor: k rows a query by a mixed number, the same however rows are partitioned."""
    return _search(queries.select("query_id"), rows.select("row_id"), _mixed(seed), k, PRIME)
