"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, html_text, language, mixing, near_dup, quality, sharding, token_files
from .common import table


def op1_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_chat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_records(chat.records(turns)))


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = decontaminate.judged(decontaminate.search(docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_tree_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op8_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_marginal_unigrams": op1_marginal_unigrams,
    "op2_chat_fingerprints": op2_chat_fingerprints,
    "op3_wu_manber": op3_wu_manber,
    "op4_tree_budgets": op4_tree_budgets,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_token_files": op6_token_files,
    "op7_stream_dedup": op7_stream_dedup,
    "op8_additive_model": op8_additive_model,
    "op9_host_paths": op9_host_paths,
    "op10_bbit_minhash": op10_bbit_minhash,
}

# --- SQL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped_length(t: str) -> str:
    control = "|".join(re.escape(c).replace("<", r"\x{3C}").replace(">", r"\x{3E}") for c in sorted(chat.CONTROL, key=len, reverse=True))
    return f"(length({t}) + length({t}) - length(replace({t}, '\\', '')) + len(regexp_extract_all({t}, {_quoted(control)})))"


def _chat_sql() -> str:
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
            CAST(sum({len(chat.START) + len(chat.END) + 2} + {_escaped_length('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped_length('text')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
            CASE WHEN roles = 'user,assistant' THEN 'prompt_response' WHEN roles = 'system,user,assistant' THEN 'system_prompt_response'
                 WHEN regexp_full_match(roles, '(user|assistant)(,(user|assistant))*') THEN 'conversations' ELSE 'messages' END AS layout, 'ok' AS status FROM c"""


_HITS_SQL = rf"""WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
    d AS (SELECT doc_id, regexp_extract_all({_LOWER}, p) AS w FROM documents, pattern),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER}, p) AS w FROM benchmark, pattern),
    bw AS (SELECT item_id, least({decontaminate.WINDOW}, len(w)) AS m, w, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    bg AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bw),
    dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bg) WHERE len(w) >= m),
    h AS (SELECT dw.doc_id, dw.i, dw.m, bg.item_id FROM dw JOIN bg ON bg.m = dw.m AND bg.g = array_to_string(dw.w[dw.i:dw.i + dw.m - 1], ' ')),
    p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
    n AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM h GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _mix_sql(target: mixing.Target = mixing.Target()) -> str:
    domain = " ".join(f"WHEN regexp_matches(source, {_quoted(p)}) THEN {_quoted(n)}" for n, p in target.domains)
    parts = []
    for k, level in enumerate(mixing.LEVELS):
        up, own = ", ".join(mixing.LEVELS[:k]), ", ".join(mixing.LEVELS[: k + 1])
        weight = " ".join(f"WHEN {_quoted(n)} THEN {w}" for n, w in target.weights.get(level, {}).items())
        weight = f"CASE {level} {weight} ELSE 1.0 END" if weight else "1.0"
        budget = f"JOIN g{k - 1} USING ({up})" if k else f"CROSS JOIN (SELECT sum(t) * least({target.share}, {target.max_epochs}) AS budget FROM leaves)"
        along = f"({f'PARTITION BY {up} ' if up else ''}ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, {level}"
        parts.append(f"""c{k} AS (SELECT {own}, CAST(sum(t) * {target.max_epochs} AS DOUBLE) AS cap, CAST({weight} AS DOUBLE) AS w FROM leaves GROUP BY {own}),
        s{k} AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER {along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS left_, sum(w) OVER {along} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c{k} {budget}),
        r{k} AS (SELECT *, CASE WHEN ws > 0 THEN left_ / ws ELSE 0 END AS rate FROM s{k}),
        g{k} AS (SELECT {own}, CASE WHEN rate * w >= cap THEN cap ELSE coalesce(min(CASE WHEN rate * w < cap THEN {{'a': CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, 'b': {level}, 'rate': rate}} END) OVER {f'(PARTITION BY {up})' if up else '()'}.rate, 0) * w END AS budget FROM r{k})""")
    return rf"""WITH d AS (SELECT doc_id, text, lang, source, CASE {domain} ELSE 'other' END AS domain, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens) AS t FROM d GROUP BY ALL), {', '.join(parts)},
        b AS (SELECT domain, lang, source, t, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM leaves JOIN g{len(mixing.LEVELS) - 1} USING (domain, lang, source)),
        p AS (SELECT domain, lang, source, CASE WHEN t = 0 THEN 1 ELSE least(budget // t, {target.max_epochs}) END AS epochs, CASE WHEN t = 0 OR budget // t >= {target.max_epochs} THEN 0 ELSE budget % t END AS rest FROM b),
        o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY CAST('0x' || substring(md5(concat_ws('|', '{target.seed}', CAST(epochs AS BIGINT), doc_id, text)), 1, 15) AS BIGINT), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN p USING (domain, lang, source)),
        k AS (SELECT *, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS times FROM o)
        SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, times)) AS INTEGER) AS epoch FROM k"""


ORACLE = {
    "op2_chat_fingerprints": _chat_sql(),
    "op3_wu_manber": _HITS_SQL,
    "op4_tree_budgets": _mix_sql(),
    "op7_stream_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op10_bbit_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        -- a pair at 0.8 shares one of the first n - ceil(0.8 n) + 1 shingles in any common order; rare ones first
        f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
        r AS (SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.g) AS k FROM e JOIN f USING (g)),
        p AS (SELECT doc_id, n, g FROM r WHERE k <= n - (4 * n + 4) // 5 + 1),
        c AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        j AS (SELECT u, v, len(list_intersect(a.sh, b.sh)) AS i, len(a.sh) + len(b.sh) AS t FROM c JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v),
        l AS (SELECT u, v FROM j WHERE 100 * i >= 80 * (t - i) UNION SELECT v, u FROM j WHERE 100 * i >= 80 * (t - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.v FROM reach JOIN l ON reach.b = l.u),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
}
