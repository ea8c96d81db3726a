"""Registered queries over page items, other scripts, labelled questions, and tables that are
written, read back and reused: indexes, caches, runs, manifests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..config import ChunkConfig, Config, ModelsConfig, ModelSpec
from ..functions import scripts, text as tx
from ..operators import answer, blocks, cache, devices, evaluate, index, retrieval, traces
from ..operators.seams import LetterEmbedder
from ..schema import RULES, violations
from ..sources import files, readers, sinks
from ..sources.readers import table
from ..sources.staging import fresh_path
from . import compose, sql
from .base import docs_of, query

# --- other scripts: passages with their letters exchanged for those of another script

_ABC = "abcdefghijklmnopqrstuvwxyz"
#: First code points of 26 letters of each script.
_FIRST = {"latn": 0x61, "cyrl": 0x430, "arab": 0x627, "deva": 0x915, "taml": 0xB95, "thai": 0xE01, "jpan": 0x3042, "kore": 0xAC00, "hans": 0x4E00}
_EXCHANGED = {s: "".join(chr(a + i) for i in range(26)) for s, a in _FIRST.items()}


def _exchanged_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN translate(lower(text), '{_ABC}', '{v}')" for k, v in enumerate(_EXCHANGED.values()))
    return f"many AS (SELECT item_id, CAST(item_id % {len(_FIRST)} AS INTEGER) AS k, CASE item_id % {len(_FIRST)} {cases} END AS text FROM benchmark)"


def _exchanged(spark, sf):
    rows = table(spark, sf, "benchmark", "item_id", "text").withColumn("k", (F.col("item_id") % len(_FIRST)).cast("int"))
    out = F.col("text")
    for k, v in enumerate(_EXCHANGED.values()):
        out = F.when(F.col("k") == k, F.translate(F.lower("text"), _ABC, v)).otherwise(out)
    return rows.withColumn("text", out)


_SOLID = f"regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), {sql.quoted(sql.SPACE)}, '', 'g')"
_PAIRS = f"CASE WHEN length({_SOLID}) = 1 THEN [{_SOLID}] ELSE list_transform(range(1, length({_SOLID})), lambda i: substring({_SOLID}, i, 2)) END"
_NAMES = " ".join(f"WHEN '{k}' THEN '(Answer in {v}.)'" for k, v in tx.LANGUAGE_NAMES.items())


@query(
    f"""WITH {_exchanged_sql()}, s AS (SELECT *, {sql.detect('text')} AS script FROM many), l AS (SELECT *, CASE script {sql.SCRIPT_LANGS} ELSE 'und' END AS lang FROM s)
    SELECT item_id, script, lang, CAST(CASE WHEN script IN ('hans', 'hant', 'jpan', 'thai') THEN {sql.count('text', sql.NOT_SPACE)} ELSE {sql.count('text', sql.NOT_SPACE + '+')} END AS INTEGER) AS n_tokens, {sql.estimate('text')} AS estimate, coalesce(CASE lang {_NAMES} END, '') AS reminder FROM l"""
)
def many_scripts(spark, sf):
    rows = _exchanged(spark, sf).withColumn("script", scripts.detect(F.col("text")))
    return rows.select("item_id", "script", scripts.language_of(F.col("script")).alias("lang"), tx.count_tokens(F.col("text"), F.col("script")).alias("n_tokens"), tx.estimate_tokens(F.col("text")).alias("estimate"), tx.language_reminder(F.col("text")).alias("reminder"))


@query(
    f"""WITH {_exchanged_sql()}, s AS (SELECT *, {sql.detect('text')} AS script FROM many)
    SELECT item_id, array_to_string(CASE WHEN script IN ('hans', 'hant', 'jpan', 'kore', 'thai') THEN {_PAIRS} ELSE {sql.tokens('text')} END, ' ') AS tokens FROM s"""
)
def many_tokens(spark, sf):
    rows = _exchanged(spark, sf)
    return rows.select("item_id", F.array_join(tx.tokens(F.col("text"), scripts.detect(F.col("text"))), " ").alias("tokens"))


@query(
    f"""WITH {_exchanged_sql()}, s AS (SELECT item_id, text, {sql.detect('text')} AS script FROM many), w AS (SELECT *, string_split(text, ' ') AS w FROM s)
    SELECT item_id, script, CASE WHEN script IN ('hans', 'jpan', 'thai') THEN regexp_replace(array_to_string(w[1:2], '') || {sql.collapse("regexp_replace(array_to_string(w[3:], ' '), '[ ]*[\\n][ ]*', '', 'g')")}, '[\\n]', '', 'g') ELSE {sql.collapse('text')} END AS text FROM w"""
)
def many_blocks(spark, sf):
    """Blocks with a line break after their second word and one after their first, and a blank block that goes."""
    words = F.split("text", " ")
    broken = F.concat(F.col("text").substr(F.lit(1), F.length(words[0])), F.lit(" \n\n "), words[1], F.lit("\n"), F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(1))), " "))
    rows = _exchanged(spark, sf).withColumn("text", broken)
    return blocks.normalise_blocks(rows.unionByName(rows.withColumn("text", F.lit("  \n")))).select("item_id", "script", "text")


# --- page items


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag AS text, 8.0 + CAST(l_quantity AS INTEGER) % 5 AS size, l_linenumber % 3 = 0 AS bold FROM lineitem),
    g AS (SELECT l_orderkey, array_to_string(list_filter([string_agg(text, '' ORDER BY l_linenumber, text), '  ', 'end'], lambda x: trim(x) <> ''), chr(10)) AS text, max(size) AS size, round(CAST(coalesce(sum(length(text)) FILTER (bold), 0) AS DOUBLE) / sum(length(text)), 6) AS bold FROM s GROUP BY 1)
    SELECT l_orderkey, text, CAST(size AS DOUBLE) AS size, bold FROM g"""
)
def page_spans(spark, sf):
    items = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    span = F.struct("l_linenumber", F.col("l_returnflag").alias("text"), (8.0 + F.col("l_quantity").cast("int") % 5).cast("double").alias("size"), F.when(F.col("l_linenumber") % 6 == 0, 16).otherwise(0).alias("flags"), F.when(F.col("l_linenumber") % 6 == 3, "Serif-Bold").otherwise("Serif").alias("font"))
    rows = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(span)).alias("s"))
    lines = F.array(F.transform("s", lambda x: x["text"]), F.array(F.lit("  ")), F.array(F.lit("e"), F.lit("nd")))
    t = blocks.typography(F.col("s"))
    return rows.select("l_orderkey", blocks.block_text(lines).alias("text"), t["size"].alias("size"), F.round(t["bold"], 6).alias("bold"))


_BOX = "{'x0': greatest(0, least(1, x0 / 100)), 'y0': greatest(0, least(1, y0 / 100)), 'x1': greatest(0, least(1, x1 / 100)), 'y1': greatest(0, least(1, y1 / 100))}"


@query(
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, least(a, b) AS x0, greatest(a, b) AS x1, d AS y0, d + 20 AS y1 FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) * 3 - 20 AS a, CAST(l_partkey % 120 AS DOUBLE) AS b, CAST(l_suppkey % 110 - 5 AS DOUBLE) AS d FROM lineitem)),
    u AS (SELECT *, {_BOX} AS bx FROM c), k AS (SELECT *, CASE WHEN bx.x1 > bx.x0 AND bx.y1 > bx.y0 THEN bx END AS box FROM u)
    SELECT l_orderkey, l_linenumber, round(box.x0, 6) AS x0, round(box.y1, 6) AS y1, coalesce(greatest(least(box.x1, 0.6) - greatest(box.x0, 0.1), 0) * greatest(least(box.y1, 0.9) - greatest(box.y0, 0.2), 0) > 0.5 * (box.x1 - box.x0) * (box.y1 - box.y0), false) AS in_table FROM k"""
)
def page_boxes(spark, sf):
    items = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    y = (F.col("l_suppkey") % 110 - 5).cast("double")
    box = blocks.unit_bbox(F.col("l_quantity").cast("double") * 3 - 20, y, (F.col("l_partkey") % 120).cast("double"), y + 20, F.lit(100.0), F.lit(100.0))
    tables = F.array(F.struct(F.lit(0.1).alias("x0"), F.lit(0.2).alias("y0"), F.lit(0.6).alias("x1"), F.lit(0.9).alias("y1")))
    rows = items.select("l_orderkey", "l_linenumber", box.alias("box"))
    return rows.select("l_orderkey", "l_linenumber", F.round("box.x0", 6).alias("x0"), F.round("box.y1", 6).alias("y1"), F.coalesce(blocks.in_table(F.col("box"), tables), F.lit(False)).alias("in_table"))


@query(
    f"""WITH {sql.BLOCKS}, o AS (SELECT doc_id, reading_order, text, {sql.detect('text')} AS script, 8.0 + reading_order % 5 AS height, ((CAST(doc_id AS BIGINT) * 7 + reading_order) % 100) / 100.0 AS confidence FROM blocks)
    SELECT doc_id, reading_order, CASE WHEN length(text) <= 400 AND regexp_matches(text, '(?i)^\\s*(fig(?:ure)?|table|chart|plate|exhibit)\\.?\\s*\\d') THEN 'caption' WHEN length(text) <= 120 AND height / 9.0 >= 1.25 THEN 'heading' WHEN regexp_matches(text, '{blocks.LIST_ITEM}') THEN 'list' ELSE 'paragraph' END AS kind
    FROM o WHERE confidence >= CASE script WHEN 'latn' THEN 0.45 ELSE 0.30 END"""
)
def ocr_blocks(spark, sf):
    b = blocks.document_blocks(docs_of(spark, sf)).withColumn("script", scripts.detect(F.col("text")))
    b = b.withColumn("ocr_confidence", ((F.col("doc_id").cast("long") * 7 + F.col("reading_order")) % 100) / 100.0)
    kind = blocks.classify_ocr(F.col("text"), 8.0 + F.col("reading_order") % 5, F.lit(9.0))
    return blocks.confident(b, {"latn": 0.45}).select("doc_id", "reading_order", kind.alias("kind"))


@query(
    f"""WITH {sql.BLOCKS}, p AS (SELECT doc_id, max(page) AS n_pages, coalesce(sum(length(text)) FILTER (page <= 10), 0) AS chars FROM blocks GROUP BY 1)
    SELECT doc_id, n_pages, round(chars / least(n_pages, 10), 3) AS mean_chars, chars / least(n_pages, 10) > 100 AS text_layer FROM p"""
)
def describe_documents(spark, sf):
    return readers.describe(blocks.document_blocks(docs_of(spark, sf)))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'taml' WHEN n_nationkey % 3 = 1 THEN 'latn' END AS hint FROM nation")
def script_hints(spark, sf):
    folder = F.when(F.col("n_nationkey") % 3 == 0, "Tamil").when(F.col("n_nationkey") % 3 == 1, "english").otherwise("other")
    path = F.concat(F.lit("/corpus/"), folder, F.lit("/"), F.col("n_name"), F.lit(".pdf"))
    return table(spark, sf, "nation").select("n_nationkey", readers.script_hint(path).alias("hint"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_linenumber - 2 < 1 THEN 'page' END, CASE WHEN l_quantity - 5 < 0 THEN 'reading_order' END, CASE WHEN l_returnflag = 'R' THEN 'kind' END, CASE WHEN l_discount * 12 > 1 THEN 'ocr_confidence' END], lambda x: x IS NOT NULL), ',') AS broken FROM lineitem WHERE l_linenumber - 2 < 1 OR l_quantity - 5 < 0 OR l_returnflag = 'R' OR l_discount * 12 > 1")
def contract_faults(spark, sf):
    items = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    own = {"page": F.col("l_linenumber") - 2, "reading_order": F.col("l_quantity") - 5, "kind": F.when(F.col("l_returnflag") == "R", "aside").otherwise("list"), "script": F.lit("latn"), "ocr_confidence": F.col("l_discount") * 12}
    return violations(items.withColumns(own), RULES["block"]).select("l_orderkey", "l_linenumber", F.array_join("broken", ",").alias("broken"))


# --- labelled questions


def _gold(spark, sf):
    """Questions from JSON lines: passages, with pages, notes and other accepted documents."""
    rows = table(spark, sf, "benchmark", "item_id", "text")
    i = F.col("item_id")
    alt = F.when(i % 4 == 1, F.to_json(F.array(F.concat(F.lit("b"), i), F.concat(F.lit("c"), i)))).when(i % 4 == 2, F.to_json(F.create_map(F.concat(F.lit("b"), i), F.array(i.cast("int"), (i + 1).cast("int")))))
    base = F.to_json(F.struct(F.col("text").alias("q"), F.lit("en").alias("lang"), F.concat(F.lit("d"), i).alias("doc_id"), F.when(i % 4 == 3, F.array().cast("array<int>")).otherwise(F.array((i % 7 + 1).cast("int"), (i % 5 + 9).cast("int"))).alias("gold_pages")))
    line = F.when(alt.isNull(), base).otherwise(F.concat(base.substr(F.lit(1), F.length(base) - 1), F.lit(',"alt_doc_ids":'), alt, F.lit("}")))
    at = fresh_path(spark, "golden")
    lines = rows.select(F.array_join(F.array(F.lit("# a note"), F.lit(""), line), "\n").alias("value"), "item_id").orderBy("item_id")
    lines.select("value").coalesce(1).write.text(at)
    return readers.golden(spark, at)


@query("WITH b AS (SELECT item_id AS i, text, 3 * row_number() OVER (ORDER BY item_id) AS q_id FROM benchmark) SELECT q_id, text AS q, 'd' || i AS doc_id, CASE WHEN i % 4 = 3 THEN '' ELSE (i % 7 + 1) || ',' || (i % 5 + 9) END AS pages, CASE i % 4 WHEN 1 THEN 'b' || i || ',c' || i WHEN 2 THEN 'b' || i ELSE '' END AS others FROM b")
def golden_questions(spark, sf):
    g = _gold(spark, sf)
    return g.select("q_id", "q", "doc_id", F.array_join(F.col("gold_pages").cast("array<string>"), ",").alias("pages"), F.array_join(F.array_sort(F.map_keys("alt_sources")), ",").alias("others"))


_PAGES = """b AS (SELECT item_id AS i, 3 * row_number() OVER (ORDER BY item_id) AS q_id FROM benchmark),
    g AS (SELECT q_id, 'd' || i AS doc_id, unnest([i % 7 + 1, i % 5 + 9]) AS page FROM b WHERE i % 4 <> 3
      UNION ALL SELECT q_id, x || i, unnest([i % 7 + 1, i % 5 + 9]) FROM b, (VALUES ('b'), ('c')) t(x) WHERE i % 4 = 1 UNION ALL SELECT q_id, 'b' || i, unnest([i, i + 1]) FROM b WHERE i % 4 = 2)"""


@query(f"WITH {_PAGES} SELECT q_id, doc_id, CAST(page AS INTEGER) AS page FROM g")
def gold_pages(spark, sf):
    return evaluate.gold_pages(_gold(spark, sf))


@query(
    f"""WITH {_PAGES}, h AS (SELECT q_id, CASE k % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'b' ELSE 'c' END || i AS doc_id, i % 7 + k - 4 AS page_start, i % 7 + k - 3 AS page_end, k AS rank FROM b, (SELECT unnest(range(1, 21)) AS k))
    SELECT DISTINCT h.q_id, CAST(h.rank AS INTEGER) AS rank FROM h JOIN g ON g.q_id = h.q_id AND g.doc_id = h.doc_id AND g.page BETWEEN h.page_start AND h.page_end"""
)
def relevant_hits(spark, sf):
    gold = _gold(spark, sf)
    i = F.substring("doc_id", 2, 9).cast("int")
    hits = gold.select("q_id", i.alias("i"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rank"))
    doc = F.concat(F.when(F.col("rank") % 3 == 0, "d").when(F.col("rank") % 3 == 1, "b").otherwise("c"), F.col("i"))
    hits = hits.select("q_id", "rank", doc.alias("doc_id"), (F.col("i") % 7 + F.col("rank") - 4).alias("page_start"), (F.col("i") % 7 + F.col("rank") - 3).alias("page_end"))
    return evaluate.relevant_hits(hits, evaluate.gold_pages(gold)).select("q_id", "rank")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unanswerable with other sources' ELSE 'document named twice' END AS fault FROM customer WHERE (c_custkey % 3 = 0 AND c_custkey % 2 = 0) OR c_custkey % 5 = 0")
def gold_faults(spark, sf):
    i = F.col("c_custkey")
    pages = F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    other = F.when(i % 5 == 0, F.create_map(F.lit("d"), F.array(F.lit(1)))).when(i % 2 == 0, F.create_map(F.lit("e"), F.array(F.lit(1)))).otherwise(F.create_map().cast("map<string,array<int>>"))
    gold = table(spark, sf, "customer", "c_custkey").select("c_custkey", F.lit("d").alias("doc_id"), pages.alias("gold_pages"), other.alias("alt_sources"))
    return evaluate.gold_faults(gold).select("c_custkey", "fault")


@query(
    """WITH r AS (SELECT 's' || c_nationkey % 4 AS lang, c_custkey % 3 <> 0 AS answerable, c_custkey % 5 = 0 AS abstained, CASE WHEN c_custkey % 7 < 5 THEN c_custkey % 7 * 4 + 1 END AS first_rank, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 9) / 8.0 END AS g, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 2 AS DOUBLE) END AS m FROM customer)
    SELECT lang, grouping(lang) = 1 AS is_total, count(*) AS n, """
    + ", ".join(f"round(coalesce(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END) FILTER (answerable), 0), 6) AS recall_{k}" for k in (1, 5, 10))
    + """, round(coalesce(avg(CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0.0 END) FILTER (answerable), 0), 6) AS rr_10, CAST(count(*) FILTER (abstained) AS BIGINT) AS n_abstained, CAST(count(*) FILTER (abstained AND NOT answerable) AS BIGINT) AS n_right,
    round(avg(CASE WHEN answerable THEN 0.0 ELSE 1.0 END) FILTER (abstained), 6) AS abstain_precision, count(*) FILTER (NOT abstained AND g IS NOT NULL) AS n_scored, round(avg(g) FILTER (NOT abstained), 6) AS groundedness, round(avg(m) FILTER (NOT abstained AND g IS NOT NULL), 6) AS language_match FROM r GROUP BY CUBE (lang)"""
)
def answer_metrics(spark, sf):
    i = F.col("c_custkey")
    qs = table(spark, sf, "customer", "c_custkey", "c_nationkey").select(
        i.alias("q_id"), F.concat(F.lit("s"), F.col("c_nationkey") % 4).alias("lang"), (i % 3 != 0).alias("answerable"), (i % 5 == 0).alias("abstained"),
        F.when(i % 4 != 0, (i % 9) / 8.0).alias("groundedness"), F.when(i % 6 != 0, i % 2 == 1).alias("language_match"),
    )
    relevant = qs.where("q_id % 7 < 5").select("q_id", (F.col("q_id") % 7 * 4 + 1).alias("rank"))
    return evaluate.metrics(evaluate.per_question(qs, relevant))


# --- answers


@query(
    f"""WITH {sql.bm25(5)} SELECT query_id, rank AS number, CAST(row_id AS VARCHAR) AS doc_id, substring(CAST(row_id AS VARCHAR), 1, 8) || ' / p.' || (row_id % 9) AS provenance, CASE WHEN length(t) <= {tx.SNIPPET_CHARS} THEN t ELSE rtrim(substring(t, 1, {tx.SNIPPET_CHARS})) || '…' END AS snippet
    FROM lexical JOIN (SELECT doc_id, {sql.collapse('text')} AS t FROM documents) ON doc_id = row_id WHERE rank IN (1, 3)"""
)
def citation_list(spark, sf):
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows = docs_of(spark, sf).withColumnRenamed("doc_id", "row_id")
    hits = retrieval.lexical_hits(qs, rows, 5)
    page = (F.col("row_id") % 9).cast("int")
    payload = rows.select("row_id", F.col("row_id").cast("string").alias("doc_id"), "text", page.alias("page_start"), page.alias("page_end"), F.array().cast("array<string>").alias("heading_path"))
    used = hits.where("rank IN (1, 3)").groupBy("query_id").agg(F.collect_list("rank").alias("used"))
    return answer.citation_rows(answer.context_blocks(hits, payload), used, payload)


@query(
    f"""WITH u AS (SELECT conv_id, turn, string_split(text, ' ') AS w, text FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, {sql.quoted(answer.SYSTEM_TIER3)} || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt,
    {sql.quoted(answer.ABSTAIN)} || chr(10) || chr(10) || {sql.quoted(answer.DISCLAIMER)} || chr(10) || chr(10) || 'As ' || w[1] || ' x' AS answer FROM u"""
)
def tier3_answers(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'")
    raw = F.concat(F.lit(" As "), F.split("text", " ")[0], F.lit(" [1] [2, 3] x [4]"))
    return rows.select("conv_id", "turn", answer.tier3_prompt(F.col("text"), enabled=True).alias("prompt"), answer.tier3_answer(raw, enabled=True, after_abstain=True).alias("answer"))


@query(
    f"""WITH u AS (SELECT conv_id * 100 + turn AS query_id, text, {sql.tokens('text')} AS t FROM conversations WHERE role = 'user'),
    c AS (SELECT *, len(t) < 5 OR len(list_intersect(t, [{', '.join(map(sql.quoted, retrieval.DANGLING))}])) > 0 AS called, query_id % 3 AS k FROM u)
    SELECT query_id, CASE WHEN called AND k = 0 THEN 'plain question ' || query_id ELSE text END AS text, CAST(CASE WHEN called AND k <> 0 THEN 1 ELSE 0 END AS INTEGER) AS degraded FROM c"""
)
def rewritten_queries(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    k = F.col("query_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('\n "plain question '), F.col("query_id"), F.lit('" \nmore'))).when(k == 1, "\n \n").otherwise(F.repeat(F.lit("long "), 2000))
    return retrieval.rewritten(users, raw).select("query_id", "text", "degraded")


@query("SELECT event_id AS trace_no FROM events WHERE event_id % 3 = 0")
def unmatched_answers(spark, sf):
    e = table(spark, sf, "events", "event_id")
    own = e.select(F.col("event_id").alias("trace_no"), F.col("event_id").cast("string").alias("trace_id"))
    return traces.unmatched(own, own.where("trace_no % 3 <> 0")).select("trace_no")


# --- tables that are written and read back


@query("SELECT c_custkey, 'base' AS label FROM customer WHERE c_custkey % 2 = 0")
def latest_run(spark, sf):
    from datetime import UTC, datetime

    rows, at = table(spark, sf, "customer", "c_custkey"), fresh_path(spark, "runs")
    for day, label, some in ((1, "base", rows), (2, "base", rows.where("c_custkey % 2 = 0")), (3, "other", rows)):
        sinks.write_run(some, at, label, datetime(2026, 1, day, tzinfo=UTC))
    return sinks.latest_run(spark.read.parquet(at), "base").select("c_custkey", "label")


@query("SELECT 'm' || n_regionkey AS name, max(n_nationkey) AS version, 1 AS schema_version FROM nation GROUP BY 1")
def model_manifest(spark, sf):
    at = f"{fresh_path(spark, 'models')}.json"
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():  # 25 rows
        sinks.merge_manifest(spark, at, [{"name": f"m{r.n_regionkey}", "precision": f"p{r.n_nationkey % 3}", "version": r.n_nationkey}])
    got = sinks.read_manifest(spark, at)
    return spark.createDataFrame([(m["name"], m["version"], got["schema_version"]) for m in got["models"]], "name string, version long, schema_version int")


@query("SELECT 'r' || r_regionkey AS metric, round(r_regionkey / 10.0, 6) AS baseline FROM region")
def stored_baseline(spark, sf):
    at = f"{fresh_path(spark, 'baseline')}.json"
    rows = table(spark, sf, "region").collect()  # 5 rows
    files.write_text(spark, at, json.dumps({"metrics": {f"r{r.r_regionkey}": r.r_regionkey / 10 for r in rows}}))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in readers.baseline(spark, at).items()], "metric string, baseline double")


@query("SELECT doc_id, length(text) AS n, true AS hit FROM documents")
def cached_stage(spark, sf):
    """A stage that is run twice: the second time it is read."""
    docs = docs_of(spark, sf)
    out = docs.select("doc_id", F.length("text").cast("long").alias("n"))
    store = cache.StageCache(spark, fresh_path(spark, "stages"))
    key = cache.StageKey("lengths", cache.hash_rows(docs), "1", Config().config_hash)
    store.get_or_compute(key, out.schema, lambda: out)
    run = store.get_or_compute(key, out.schema, lambda: out.limit(0))
    return run.frame.withColumn("hit", F.lit(run.hit))


_N_LETTERS = "length(regexp_replace(lower(text), '[^a-z]', '', 'g'))"


@query(f"SELECT doc_id, {_N_LETTERS} AS n_letters, (SELECT count(DISTINCT text) FROM documents) AS n_cached FROM documents")
def cached_vectors(spark, sf):
    """Vectors of half the texts, then of all: a text is embedded once."""
    docs = docs_of(spark, sf)
    store = cache.VectorCache(spark, fresh_path(spark, "vectors"), LetterEmbedder())
    store.get_or_compute(docs.where("doc_id % 2 = 0"))
    rows = store.get_or_compute(docs)
    n = spark.read.parquet(store.path).count()
    return rows.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_letters"), F.lit(n).cast("long").alias("n_cached"))


_KIND = """CASE WHEN length(text) <= 400 AND (regexp_matches(text, '(?i)^\\s*(fig(?:ure)?|table|chart|plate|exhibit)\\.?\\s*\\d') OR (size / body_size <= 0.92 AND length(text) >= 12)) THEN 'caption'
      WHEN length(text) <= 120 AND (size / body_size >= 1.15 OR (bold >= 0.6 AND size / body_size >= 1.02)) THEN 'heading' ELSE 'other' END"""


def _items_sql() -> str:
    """Blocks of the documents that pass the gate, in order, with whether they are headings."""
    return f"""{sql.BLOCKS}, sz AS (SELECT *, CAST(8 + (CAST(doc_id AS BIGINT) + reading_order) % 7 AS DOUBLE) AS size, (reading_order % 5) / 4.0 AS bold FROM blocks),
    wz AS (SELECT doc_id, round(size, 1) AS size, sum(length(text)) AS chars FROM sz GROUP BY 1, 2), bz AS (SELECT doc_id, arg_max(size, {{'c': chars, 's': -size}}) AS body_size FROM wz GROUP BY 1),
    jz AS (SELECT doc_id, max(page) AS n_pages, string_agg(text, '' ORDER BY reading_order) AS text, CAST(sum(length(regexp_replace(text, {sql.quoted(f'^{sql.SPACE}+|{sql.SPACE}+$')}, '', 'g'))) AS DOUBLE) AS chars FROM blocks GROUP BY doc_id),
    gz AS (SELECT doc_id FROM jz WHERE chars / n_pages >= {scripts.MIN_CHARS_PER_PAGE} AND {sql.MIXED} <= {scripts.MIXED_MAX} AND {sql.LEGACY} <= {scripts.LEGACY_MAX}),
    bk AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) - 1 AS INTEGER) AS reading_order, text, {_KIND} = 'heading' AS head FROM sz JOIN bz USING (doc_id) JOIN gz USING (doc_id))"""


def _ingest_sql() -> str:
    return f"""WITH RECURSIVE {sql.chunk_tables(ChunkConfig(), _items_sql())}
    SELECT row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS row_id, doc_id, chunk_no, substring(sha256(doc_id || '|' || array_to_string(block_ids, ',')), 1, 32) AS chunk_id, page_start, page_end, array_to_string(path, ' > ') AS path, token_count, {_N_LETTERS} AS n_letters FROM chunk_rows"""


@query(_ingest_sql())
def ingest_index(spark, sf):
    """Lines as page items to an index, twice: the second run reuses it, and what it holds is read back."""
    b = blocks.document_blocks(docs_of(spark, sf))
    box = F.struct(F.lit(0.0).alias("x0"), (F.col("reading_order") % blocks.LINES_PER_PAGE * 20.0).alias("y0"), F.lit(1.0).alias("x1"), (F.col("reading_order") % blocks.LINES_PER_PAGE * 20.0 + 9).alias("y1"))
    size = (8 + (F.col("doc_id").cast("long") + F.col("reading_order")) % 7).cast("double")
    items = b.select("doc_id", "page", box.alias("bbox"), "text", size.alias("size"), ((F.col("reading_order") % 5) / 4.0).alias("bold"))
    root = fresh_path(spark, "index")
    path, manifest = compose.ingest_items(items, root, 1.0, embedder=LetterEmbedder())
    again, _ = compose.ingest_items(items, root, 1.0, embedder=LetterEmbedder())
    if again != path or compose.only_index(spark, root) != path:
        raise index.IndexFault(f"{path} was not reused")
    rows = index.load_index(spark, path, LetterEmbedder())
    letters = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long")
    return rows.select("row_id", "doc_id", "chunk_no", "chunk_id", "page_start", "page_end", F.array_join("heading_path", " > ").alias("path"), "token_count", letters.alias("n_letters"))


def _devices_probe(device):
    if device == "NPU":
        raise RuntimeError("no driver")
    return devices.timed_generation(lambda d, prompt: [0.25, 0.5, 0.75])(device)


@query(
    """SELECT * REPLACE (CAST(ttft_ms AS DOUBLE) AS ttft_ms, CAST(tokens_per_s AS DOUBLE) AS tokens_per_s) FROM (VALUES ('CPU', 'CPU', 'measured', true, 250.0, 4.0, 3, '', 'read=5;pack=2', 'stored'), ('NPU', '', 'failed', true, -1.0, -1.0, -1, 'NPU: RuntimeError: no driver', 'read=5;pack=2', 'stored'),
    ('GPU', '', 'unavailable', false, -1.0, -1.0, -1, 'GPU is not on this host: nothing was measured', 'read=5;pack=2', 'stored')) t(device, resolved_device, status, available, ttft_ms, tokens_per_s, n_tokens, detail, stages, ingest_source)"""
)
def device_bench(spark, sf):
    """A bench run of two devices found and one that only the settings name, written and read back."""
    cfg = Config(models=ModelsConfig(generator=ModelSpec("extractive", device="GPU")))
    rows = devices.report(spark, cfg, {"CPU": "cpu", "NPU": "npu"}, _devices_probe, lambda: ([("read", 5), ("pack", 2)], "stored"))
    sinks.write_run(rows, runs := fresh_path(spark, "bench"), "bench")
    back = sinks.latest_run(spark.read.parquet(runs), "bench").fillna(-1, ["ttft_ms", "tokens_per_s", "n_tokens"]).fillna("", ["resolved_device"])
    stages = F.array_join(F.transform("stages", lambda s: F.concat(s["stage"], F.lit("="), s["duration_ms"].cast("int"))), ";")
    return back.select("device", "resolved_device", "status", "available", "ttft_ms", "tokens_per_s", "n_tokens", "detail", stages.alias("stages"), "ingest_source")
