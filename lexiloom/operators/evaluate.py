"""Retrieval metrics over labelled questions, pooled and by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10)


def gold_pages(gold: DataFrame) -> DataFrame:
    """(q_id, doc_id, page): own pages and those of other accepted documents."""
    own = gold.select("q_id", "doc_id", F.explode("gold_pages").alias("page"))
    other = gold.select("q_id", F.explode("alt_sources").alias("doc_id", "pages")).select("q_id", "doc_id", F.explode("pages").alias("page"))
    return own.unionByName(other)


def gold_faults(gold: DataFrame) -> DataFrame:
    empty = F.size("gold_pages") == 0
    broken = F.when(empty & (F.size(F.map_keys("alt_sources")) > 0), "unanswerable with other sources").when(F.map_contains_key("alt_sources", F.col("doc_id")), "document named twice")
    return gold.withColumn("fault", broken).where("fault IS NOT NULL")


def relevant_hits(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """hits(q_id, doc_id, page_start, page_end, rank) that cover a gold page."""
    p = pages.select(F.col("q_id").alias("g_q"), F.col("doc_id").alias("g_doc"), "page")
    return hits.join(p, (F.col("q_id") == F.col("g_q")) & (F.col("doc_id") == F.col("g_doc")) & F.col("page").between(F.col("page_start"), F.col("page_end")), "left_semi")


def per_question(questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """questions(q_id, ...) with the rank of the first relevant hit, recall at the cut-offs and rr@10."""
    first = relevant.groupBy("q_id").agg(F.min("rank").alias("first_rank"))
    rows = questions.join(first, "q_id", "left")
    rank = F.col("first_rank")
    out = {f"recall_{k}": F.coalesce(rank <= k, F.lit(False)).cast("double") for k in CUTOFFS}
    out["rr_10"] = F.when(rank <= 10, 1.0 / rank).otherwise(0.0)
    return rows.withColumns(out)


def mean(c: Column) -> Column:
    """0 over nothing."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def metrics(rows: DataFrame) -> DataFrame:
    """One row a language and one for all (is_total; lang is null there), in one pass.

    Rows need lang, answerable, abstained; with groundedness and language_match, those of answers
    that were given are averaged too, n_scored being how many. Recall and rr are means over
    answerable questions, 0 without any; abstain_precision is null when nothing was declined, and
    so are the figures of answers when none was given.
    """
    a = F.col("answerable")
    out = [F.grouping("lang").cast("boolean").alias("is_total"), F.count("*").alias("n")]
    out += [F.round(mean(F.when(a, F.col(c))), 6).alias(c) for c in (*(f"recall_{k}" for k in CUTOFFS), "rr_10")]
    out.append(F.sum(F.col("abstained").cast("long")).alias("n_abstained"))
    out.append(F.sum((F.col("abstained") & ~a).cast("long")).alias("n_right"))
    out.append(F.round(F.avg(F.when(F.col("abstained"), (~a).cast("double"))), 6).alias("abstain_precision"))
    if "groundedness" in rows.columns:
        given = ~F.col("abstained") & F.col("groundedness").isNotNull()
        out.append(F.count(F.when(given, 1)).alias("n_scored"))
        out.append(F.round(F.avg(F.when(given, F.col("groundedness"))), 6).alias("groundedness"))
        out.append(F.round(F.avg(F.when(given, F.col("language_match").cast("double"))), 6).alias("language_match"))
    return rows.cube("lang").agg(*out)


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("answerable", "abstained").agg(F.count("*").alias("n"))


def abstain_scores(rows: DataFrame) -> DataFrame:
    """Precision and recall of declining; null over nothing."""
    hit = F.sum((F.col("abstained") & ~F.col("answerable")).cast("long"))
    declined, should = F.sum(F.col("abstained").cast("long")), F.sum((~F.col("answerable")).cast("long"))
    return rows.agg(F.round(F.try_divide(hit.cast("double"), declined), 6).alias("precision"), F.round(F.try_divide(hit.cast("double"), should), 6).alias("recall"))


def recall_curve(rows: DataFrame) -> DataFrame:
    """(k, recall) over answerable questions."""
    one = rows.where("answerable").agg(*[F.round(F.avg(f"recall_{k}"), 6).alias(str(k)) for k in CUTOFFS])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in CUTOFFS]), F.array(*[F.col(f"`{k}`") for k in CUTOFFS]))).alias("k", "recall"))


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull() | (rank > 20), "never").when(rank == 1, "1").when(rank <= 5, "2-5").when(rank <= 10, "6-10").otherwise("11-20")


def rank_distribution(rows: DataFrame) -> DataFrame:
    return rows.where("answerable").groupBy(rank_bucket(F.col("first_rank")).alias("bucket")).agg(F.count("*").alias("n"))


def sweep(arms: DataFrame, baseline: DataFrame) -> DataFrame:
    """arms(arm, recall_5, mrr_10, degraded) against a one-row baseline; degraded arms show no figures."""
    b = baseline.select(F.col("recall_5").alias("b5"), F.col("mrr_10").alias("bm"))
    sound = F.col("degraded") == 0
    rows = arms.crossJoin(F.broadcast(b))  # baseline: one row
    return rows.select(
        "arm",
        F.when(sound, F.round("recall_5", 6)).alias("recall_5"),
        F.when(sound, F.round(F.col("recall_5") - F.col("b5"), 6)).alias("d_recall_5"),
        F.when(sound, F.round("mrr_10", 6)).alias("mrr_10"),
        F.when(sound, F.round(F.col("mrr_10") - F.col("bm"), 6)).alias("d_mrr_10"),
        "degraded",
    )
