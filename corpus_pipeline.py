"""From raw documents to token files: five stages, each on all that its predecessor kept.

quality classifier: documents with predicted = 0 go.
near-dedup: of each near-duplicate group the document with the smallest id stays.
decontamination: documents with a full 13-word benchmark window go, whatever their length; so do
those of which a twentieth or more repeats items of fewer words.
mixing: sources are cut to their target weights; no document is taken twice.
token output: what is left is written as token files and read back.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs, whatever they are named. Texts of any length are read whole.

Defined cases: empty tables give empty results. A null or empty text has the score of no words;
it is no copy of anything, is not contaminated and yields the end id alone. Rows with one doc_id
and different texts, and rows without doc_id, are documents of their own; rows alike in doc_id and
text are one. In a group, unrepeated ids come before repeated ones and nulls, which are told
apart by a hash of id and text. A null source or language is a source or language of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, mixing, near_dup, quality, token_files
from lexiloom.llm.common import staged, table

#: Token output holds less in a worker than alone: the stages before leave executors little memory.
LIMITS = token_files.Limits(60_000, 1_000_000)
#: Columns that operators read; others are carried through.
READ = ("doc_id", "text", "lang", "source")
TARGET = mixing.Target(share=0.9, max_epochs=1)


def apart(docs: DataFrame) -> DataFrame:
    """docs with columns that no operator reads renamed, so that none is taken for an operator's."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"_own_{c}") for c in docs.columns])


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows of apart()."""
    return rows.select(*[F.col(f"`{c if c in READ else f'_own_{c}'}`").alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return back(quality.score_documents(apart(docs), model).where("predicted = 1"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id")
    repeated = staged(ids, "repeated")
    if repeated.isEmpty():
        return near_dup.drop_copies(docs, "doc_id")
    # keys of 62 bits and more: behind all ids that occur once
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
    marked = apart(docs).join(repeated.select(F.col("doc_id").alias("_again"), F.lit(True).alias("_more")), F.col("doc_id").eqNullSafe(F.col("_again")), "left").drop("_again")
    keyed = staged(marked.withColumn("_key", F.when(F.col("_more"), own).otherwise(F.col("doc_id"))).drop("_more"), "keyed")
    out = near_dup.drop_copies(keyed, "_key")
    first = out.where(F.col("_key") >= 1 << 62).groupBy("_key").agg(F.min(F.struct(*[c for c in out.columns if c != "_key"])).alias("r"))
    return back(out.where(F.col("_key") < 1 << 62).drop("_key").unionByName(first.select("r.*")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.search(apart(docs), table(spark, sf_dir, "benchmark")))
    return back(found.where(~F.col("full") & ~F.col("contaminated")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return back(mixing.mix(apart(docs), TARGET), docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_digests(docs, limits=LIMITS)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: The classifier and the signatures are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage_{k}")
    return docs
