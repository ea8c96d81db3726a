"""From hits to answers: context, prompt, budget, generation, verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import citations, text as tx
from ..functions.scripts import detect, let
from ..sources.staging import staged
from .seams import extractive

# Texts that interfaces and evaluation match on.
ABSTAIN = "I couldn't find this in your documents."
DISCLAIMER = "General knowledge — not from your materials. May not match your syllabus."
QUOTES = "\"'“”‘’"
SYSTEM = (
    "Answer the question from the numbered context blocks alone, in the language of the question. "
    "Cite blocks by number, like [1] or [2][3], right after what they support, and no others. "
    f'If the context does not hold the answer, reply exactly "{ABSTAIN}"'
)
SYSTEM_TIER3 = "Answer from general knowledge, in the language of the question. Cite nothing: no numbers in brackets, no pages, no documents. Say where you are unsure."


def provenance_column() -> Column:
    return tx.provenance(F.col("filename"), F.col("doc_id"), F.col("page_start"), F.col("page_end"), F.col("heading_path"))


def context_blocks(hits: DataFrame, chunks: DataFrame, names: DataFrame | None = None, n_context: int = 5) -> DataFrame:
    """(query_id, context_no, row_id, doc_id, block) for the first hits; payload joins after ranking."""
    top = hits.where(F.col("rank") <= n_context).select("query_id", "row_id", "rank")
    rows = top.join(chunks, "row_id")
    rows = rows.join(names, "doc_id", "left") if names is not None else rows.withColumn("filename", F.lit(None).cast("string"))
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), provenance_column(), F.lit("\n"), F.col("text"))
    return rows.select("query_id", F.col("rank").alias("context_no"), "row_id", "doc_id", block.alias("block"))


def reminder_note(question: Column) -> Column:
    return let(tx.language_reminder(question), lambda note: F.when(note == "", "").otherwise(F.concat(note, F.lit("\n"))))


def build_prompt(question: Column, context: Column, note: Column, system: str = SYSTEM) -> Column:
    """note: the question's reminder line, or an empty string."""
    # The frame of a prompt.
    return F.concat(F.lit(f"{system}\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n"), note, F.lit("Answer:"))


def fit_context(queries: DataFrame, blocks: DataFrame, budget: int = 6000, reminder: bool = True, tokens: Callable[[Column], Column] = tx.estimate_tokens) -> DataFrame:
    """The longest run of first blocks whose whole prompt fits; at least one block stays.

    (query_id, n_context, n_dropped, prompt, prompt_tokens)
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("context_no", "block"))), lambda x: x["block"])
    noted = queries.select("query_id", "text", (reminder_note(F.col("text")) if reminder else F.lit("")).alias("note"))
    rows = noted.join(blocks.groupBy("query_id").agg(ordered.alias("b")), "query_id")
    # generated, so that each prompt is made once and priced as a column
    runs = F.transform(F.sequence(F.lit(1), F.size("b")), lambda n: F.struct(n.alias("n"), build_prompt(F.col("text"), F.array_join(F.slice("b", 1, n), "\n\n"), F.col("note")).alias("prompt")))
    rows = rows.select("query_id", F.size("b").alias("all"), F.explode(runs).alias("r")).select("query_id", "all", "r.*").withColumn("prompt_tokens", tokens(F.col("prompt")))
    # a longer run never fits where a shorter one does not
    fits = F.when((F.col("n") == 1) | (F.col("prompt_tokens") <= budget), F.col("n"))
    best = rows.groupBy("query_id").agg(F.max_by(F.struct("n", "prompt", "prompt_tokens", "all"), fits).alias("x"))
    return best.select("query_id", F.col("x.n").alias("n_context"), (F.col("x.all") - F.col("x.n")).alias("n_dropped"), "x.prompt", "x.prompt_tokens")


def is_abstain(text: Column) -> Column:
    def plain(c: Column) -> Column:
        return tx.fold(F.rtrim(F.regexp_replace(F.btrim(F.btrim(F.btrim(c), F.lit(QUOTES))), r"\.+$", "")))

    return plain(text) == plain(F.lit(ABSTAIN))


def tier3_prompt(question: Column, enabled: bool = False) -> Column:
    """A prompt without documents, for users who asked for it."""
    if enabled is not True:
        raise PermissionError("answers without documents are off by default; pass enabled=True after the user has opted in")
    return F.concat(F.lit(f"{SYSTEM_TIER3}\n\nQuestion: "), question, F.lit("\nAnswer:"))


def online_source(query: str, k: int) -> list:
    """Tier 2 is not available: nothing leaves the cluster."""
    raise NotImplementedError("online sources are disabled")


def citation_rows(blocks: DataFrame, answered: DataFrame, chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(query_id, number, doc_id, provenance, snippet) of each verified citation; answered(query_id, used)."""
    rows = answered.select("query_id", F.explode("used").alias("context_no")).join(blocks.select("query_id", "context_no", "row_id"), ["query_id", "context_no"]).join(chunks, "row_id")
    rows = rows.join(names, "doc_id", "left") if names is not None else rows.withColumn("filename", F.lit(None).cast("string"))
    return rows.select("query_id", F.col("context_no").alias("number"), "doc_id", provenance_column().alias("provenance"), tx.snippet(F.col("text")).alias("snippet"))


def tier3_answer(raw: Column, enabled: bool = False, after_abstain: bool = False) -> Column:
    """Text without documents behind it: disclaimer first, all markers off. Off by default."""
    if enabled is not True:
        raise PermissionError("answers without documents are off by default; pass enabled=True after the user has opted in")
    body = F.btrim(citations.strip_all(raw))
    head = F.lit(f"{ABSTAIN}\n\n{DISCLAIMER}" if after_abstain else DISCLAIMER)
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("\n\n"), body))


def language_match(question: Column, answer: Column) -> Column:
    return let(F.struct(detect(question).alias("q"), detect(answer).alias("a")), lambda s: F.when((s["q"] != "unknown") & (s["a"] != "unknown"), s["q"] == s["a"]))


def answers(queries: DataFrame, gated: DataFrame, hits: DataFrame, chunks: DataFrame, cfg: Config = Config(), generate: Callable[[Column], Column] = extractive, names: DataFrame | None = None) -> DataFrame:
    """One row a query: text, citations (row_ids), abstained, model_abstained, groundedness, language_match.

    Queries below the gate are split off before the generator, so no model runs for them.
    """
    open_ = queries.join(gated.where("NOT abstained").select("query_id"), "query_id", "left_semi")
    blocks = staged(context_blocks(hits, chunks, names, cfg.retrieve.n_context), "context")
    fitted = fit_context(open_, blocks, cfg.generate.max_prompt_tokens, cfg.generate.language_reminder)
    raw = fitted.withColumn("v", citations.verify(generate(F.col("prompt")), F.col("n_context")))
    raw = raw.select("query_id", "n_context", "prompt_tokens", "v.*").withColumn("model_abstained", is_abstain(F.col("text")))
    cited = raw.select("query_id", F.explode("used").alias("context_no")).join(blocks, ["query_id", "context_no"])
    cited = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("context_no", "row_id"))), lambda x: x["row_id"]).alias("citations"))
    done = raw.join(cited, "query_id", "left").withColumnRenamed("text", "clean")
    out = queries.join(done, "query_id", "left")
    abstained = F.col("clean").isNull() | F.col("model_abstained")
    return out.select(
        "query_id",
        F.when(abstained, ABSTAIN).otherwise(F.col("clean")).alias("answer"),
        F.when(abstained, F.array().cast("array<bigint>")).otherwise(F.coalesce("citations", F.array().cast("array<bigint>"))).alias("citations"),
        abstained.alias("abstained"),
        F.coalesce("model_abstained", F.lit(False)).alias("model_abstained"),
        F.when(F.col("clean").isNotNull(), citations.groundedness(F.col("emitted"), F.col("grounded"))).alias("groundedness"),
        F.when(~abstained, language_match(F.col("text"), F.col("clean"))).alias("language_match"),
        "prompt_tokens",
    )
