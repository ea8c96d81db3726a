"""DuckDB forms of the shared expressions."""

from __future__ import annotations

from ..functions import citations, scripts, text as tx
from ..operators import blocks

SPACE, NOT_SPACE = scripts.SPACE, scripts.NOT_SPACE


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({t}, ''), {quoted(pattern)}))"


def bucket(t: str, name: str) -> str:
    return count(t, scripts.char_class(scripts.BUCKETS[name]))


def detect(t: str) -> str:
    han, kana, hang = (bucket(t, b) for b in ("han", "kana", "hang"))
    variant = f"CASE WHEN {count(t, f'[{scripts.TRADITIONAL_ONLY}]')} > {count(t, f'[{scripts.SIMPLIFIED_ONLY}]')} THEN 'hant' ELSE 'hans' END"
    pairs = [f"{{'n': {bucket(t, b)}, 's': '{b}'}}" for b in ("latn", "cyrl", "arab", "deva", "taml", "thai")]
    pairs.append(f"{{'n': CASE WHEN {kana} > 0 THEN {kana} + {han} WHEN {hang} > 0 THEN {hang} + {han} ELSE {han} END, 's': CASE WHEN {kana} > 0 THEN 'jpan' WHEN {hang} > 0 THEN 'kore' ELSE {variant} END}}")
    best = f"list_reverse_sort([{', '.join(pairs)}])[1]"
    return f"CASE WHEN {best}.n > 0 THEN {best}.s ELSE 'unknown' END"


def tokens(t: str) -> str:
    """Words of spaced scripts: the driver's tables hold no others."""
    folded = f"replace(replace(lower(trim(x, {quoted(tx.EDGE_PUNCTUATION)})), 'ß', 'ss'), 'ς', 'σ')"
    return f"list_filter(list_transform(string_split_regex(coalesce({t}, ''), {quoted(SPACE + '+')}), lambda x: {folded}), lambda x: x <> '')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, {quoted(SPACE + '+')}, ' ', 'g'))"


def bm25(k: int = 20, queries: str = "SELECT item_id AS query_id, text FROM benchmark", rows: str = "SELECT doc_id AS row_id, text FROM documents") -> str:
    return f"""tok AS (SELECT row_id, {tokens('text')} AS t FROM ({rows})),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok),
    one AS (SELECT row_id, len(t) AS doc_len, unnest(t) AS term FROM tok),
    post AS (SELECT term, row_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM one GROUP BY term, row_id),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    q AS (SELECT query_id, unnest(list_distinct({tokens('text')})) AS term FROM ({queries})),
    scored AS (SELECT query_id, row_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
        FROM q JOIN post USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, row_id),
    lexical AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= {k})"""


#: The stated query set: every id divisible by this, against all rows.
EVERY = 20


def dense(k: int = 20, vector: str = "embedding", name: str = "dense") -> str:
    return f"""{name}_v AS (SELECT vec_id, label, CAST({vector} AS DOUBLE[]) AS e FROM embeddings),
    {name}_u AS (SELECT vec_id, label, sqrt(list_dot_product(e, e)) AS n, e FROM {name}_v),
    {name}_pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round(CASE WHEN a.n * b.n > 0 THEN list_dot_product(a.e, b.e) / (a.n * b.n) ELSE 0 END, 6) + 0.0 AS score FROM {name}_u a, {name}_u b WHERE a.vec_id % {EVERY} = 0),
    {name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM {name}_pairs QUALIFY rank <= {k})"""


_LETTERS = f"[{', '.join(f"length(low) - length(replace(low, {chr(39)}{c}{chr(39)}, {chr(39)}{chr(39)}))" for c in 'abcdefghijklmnopqrstuvwxyz')}]"


def letters(k: int = 20) -> str:
    """Dense hits of passages among documents by counts of letters."""
    def side(source: str, id_col: str) -> str:
        return f"SELECT {id_col} AS id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT {id_col}, CAST({_LETTERS} AS DOUBLE[]) AS e FROM (SELECT {id_col}, lower(coalesce(text, '')) AS low FROM {source}))"

    return f"""lq AS ({side('benchmark', 'item_id')}), lr AS ({side('documents', 'doc_id')}),
    lpairs AS (SELECT lq.id AS query_id, lr.id AS row_id, round(CASE WHEN lq.n * lr.n > 0 THEN list_dot_product(lq.e, lr.e) / (lq.n * lr.n) ELSE 0 END, 6) + 0.0 AS score FROM lq, lr),
    ldense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM lpairs QUALIFY rank <= {k})"""


def fused(arms: str, k: int) -> str:
    """arms: name of (query_id, row_id, rank, w, arm)."""
    return f"""fs AS (SELECT query_id, row_id, round(sum(w / (60 + rank)), 9) AS score, min({{'a': arm, 'r': rank}}) AS seen FROM {arms} GROUP BY 1, 2),
    fused AS (SELECT query_id, row_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, row_id) AS INTEGER) AS rank FROM fs QUALIFY rank <= {k})"""


def estimate(t: str) -> str:
    priced = " + ".join(f"{bucket(t, b)} / {r}" for b, r in tx.CHARS_PER_TOKEN.items())
    rest = f"(length({t}) - {' - '.join(bucket(t, b) for b in tx.CHARS_PER_TOKEN)}) / {tx.DEFAULT_CHARS_PER_TOKEN}"
    return f"CAST(ceil(round(({priced} + {rest}) * {tx.ESTIMATE_SAFETY}, 9)) AS BIGINT)"


_LINE_LIST = f"list_filter(list_transform(string_split(regexp_replace(nfc_normalize(text), {quoted(tx.LINE_BREAK)}, chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, {quoted(f'^{SPACE}+|{SPACE}+$')}, '', 'g')), lambda x: x <> '')"


def normalised(source: str, name: str) -> str:
    """name: source with text composed, joined and collapsed, for scripts that hyphenate."""
    one = r"regexp_replace(regexp_replace(t, chr(10), ' ', 'g'), '[\x{AD}\x{FEFF}]', '', 'g')"
    return rf"""{name}_j AS (SELECT * EXCLUDE (text), nfc_normalize(text) AS composed, array_to_string({_LINE_LIST}, chr(10)) AS t FROM {source}),
    {name}_h AS (SELECT * EXCLUDE (t), regexp_replace(regexp_replace(t, '(\p{{L}})[-‐‑]\n(\p{{Ll}})', '\1\2', 'g'), '(\p{{L}}[-‐‑])\n(\p{{L}})', '\1\2', 'g') AS t FROM {name}_j),
    {name} AS (SELECT * EXCLUDE (t), {collapse(one)} AS text FROM {name}_h)"""


BLOCKS = f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    cut AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS reading_order, unnest(l) AS text FROM lines),
    blocks AS (SELECT doc_id, reading_order, CAST(reading_order // {blocks.LINES_PER_PAGE} + 1 AS INTEGER) AS page, text FROM cut WHERE regexp_matches(text, {quoted(NOT_SPACE)}))"""

#: Every twelfth line of a document as its heading.
TWELFTH = f"{BLOCKS}, bk AS (SELECT *, reading_order % 12 = 0 AS head FROM blocks)"


def chunk_tables(cfg, source: str = TWELFTH) -> str:
    """CTEs from source, which ends in bk(doc_id, page, reading_order, text, head), to chunks(doc_id, chunk_no, items, path), items being places in the lists of docs_of_blocks."""

    def cost(items: str) -> str:
        return f"coalesce(list_sum(list_transform({items}, lambda i: costs[i])), 0)"

    def joined(a: str, b: str) -> str:
        return f"({a} || list_filter({b}, lambda i: NOT list_contains({a}, i)))"

    number = r"regexp_extract(text, '^\s*(\d+(?:[.\-]\d+)*)\s*[.):]?\s+\S', 1)"
    tail = f"s.cur[len(s.cur) - list_max(list_filter(range(0, len(s.cur)), lambda m: coalesce(list_sum(list_transform(s.cur[len(s.cur) - m + 1:], lambda y: y.c)), 0) <= {cfg.overlap})) + 1:]"
    return rf"""{source}, {normalised('bk', 'nb')},
    lb AS (SELECT doc_id, page, reading_order, text, {detect('composed')} AS script, {count('text', NOT_SPACE + '+')} AS cost, head,
        CASE WHEN {number} = '' THEN 1 ELSE len(string_split_regex({number}, '[.\-]')) END AS level FROM nb WHERE text <> ''),
    ob AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS i, CAST(sum(head::INT) OVER w AS INTEGER) AS sec FROM lb WINDOW w AS (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    docs_of_blocks AS (SELECT doc_id, list(cost ORDER BY i) AS costs, list(text ORDER BY i) AS texts, list(page ORDER BY i) AS pages, list(script ORDER BY i) AS scripts,
        list(substring(doc_id, 1, 12) || ':' || page || ':' || lpad(CAST(reading_order AS VARCHAR), 5, '0') ORDER BY i) AS ids FROM ob GROUP BY doc_id),
    heads AS (SELECT doc_id, sec, level, text FROM ob WHERE head),
    paths AS (SELECT doc_id, 1 AS sec, [text] AS path FROM heads WHERE sec = 1
        UNION ALL SELECT h.doc_id, h.sec, p.path[1:h.level - 1] || [h.text] FROM paths p JOIN heads h ON h.doc_id = p.doc_id AND h.sec = p.sec + 1),
    secs AS (SELECT ob.doc_id, ob.sec, any_value(coalesce(p.path, [])) AS path, bool_and(head) AS bare, list({{'i': i, 'c': cost}} ORDER BY i) AS pieces FROM ob LEFT JOIN paths p ON p.doc_id = ob.doc_id AND p.sec = ob.sec GROUP BY 1, 2),
    after AS (SELECT *, coalesce(lead(path) OVER (PARTITION BY doc_id ORDER BY sec), []) AS nxt FROM secs),
    held AS (SELECT doc_id, sec, path, pieces FROM after WHERE NOT (len(nxt) > len(path) AND nxt[1:len(path)] = path AND bare)),
    runs AS (SELECT doc_id, sec, path, list_reduce(list_transform(pieces, lambda p: {{'runs': CAST([] AS INTEGER[][]), 'cur': [p]}}), lambda s, x: CASE
        WHEN len(s.cur) > 0 AND list_sum(list_transform(s.cur, lambda y: y.c)) + x.cur[1].c > {cfg.target_tokens} THEN {{'runs': s.runs || [list_transform(s.cur, lambda y: y.i)], 'cur': {tail} || x.cur}}
        ELSE {{'runs': s.runs, 'cur': s.cur || x.cur}} END) AS s FROM held),
    flat AS (SELECT doc_id, sec, path, list_transform(s.runs || [list_transform(s.cur, lambda y: y.i)], lambda r: [r]) AS r, costs FROM runs JOIN docs_of_blocks USING (doc_id)),
    merged AS (SELECT doc_id, sec, path, costs, list_reduce(r, lambda s, x: CASE WHEN len(s) > 0 AND {cost('x[1]')} < {cfg.min_tokens} THEN s[1:len(s) - 1] || [{joined('s[len(s)]', 'x[1]')}] ELSE s || x END) AS g FROM flat),
    single AS (SELECT doc_id, sec, path, costs, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS k FROM merged),
    rows_of AS (SELECT doc_id, any_value(costs) AS costs, list({{'done': CAST([] AS STRUCT(g INTEGER[], path VARCHAR[])[]), 'g': g, 'path': path}} ORDER BY sec, k) AS l FROM single GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(l, lambda s, x: CASE WHEN {cost(joined('s.g', 'x.g'))} >= {cfg.min_tokens}
        THEN {{'done': s.done || [{{'g': {joined('s.g', 'x.g')}, 'path': x.path}}], 'g': CAST([] AS INTEGER[]), 'path': CAST([] AS VARCHAR[])}}
        ELSE {{'done': s.done, 'g': {joined('s.g', 'x.g')}, 'path': CASE WHEN len(s.g) > 0 THEN s.path ELSE x.path END}} END,
        {{'done': CAST([] AS STRUCT(g INTEGER[], path VARCHAR[])[]), 'g': CAST([] AS INTEGER[]), 'path': CAST([] AS VARCHAR[])}}) AS s FROM rows_of),
    lists AS (SELECT doc_id, CASE WHEN len(s.g) > 0 THEN s.done || [{{'g': s.g, 'path': s.path}}] ELSE s.done END AS c FROM folded),
    chunks AS (SELECT doc_id, CAST(unnest(range(0, len(c))) AS INTEGER) AS chunk_no, unnest(c).g AS items, unnest(c).path AS path FROM lists),
    chunk_rows AS (SELECT c.doc_id, chunk_no, path, list_transform(items, lambda i: ids[i]) AS block_ids, CAST(list_min(list_transform(items, lambda i: pages[i])) AS INTEGER) AS page_start, CAST(list_max(list_transform(items, lambda i: pages[i])) AS INTEGER) AS page_end,
        CAST(list_sum(list_transform(items, lambda i: costs[i])) AS INTEGER) AS token_count, array_to_string(list_transform(items, lambda i: texts[i]), chr(10) || chr(10)) AS text,
        coalesce(list_reverse_sort(list_transform(list_distinct(list_filter(list_transform(items, lambda i: scripts[i]), lambda x: x <> 'unknown')), lambda x: {{'n': list_sum(list_transform(items, lambda i: CASE WHEN scripts[i] = x THEN costs[i] ELSE 0 END)), 's': x}}))[1].s, 'unknown') AS script
        FROM chunks c JOIN docs_of_blocks d ON d.doc_id = c.doc_id)"""


MARKERS = citations.MARKER_TEXT
SCRIPT_LANGS = " ".join(f"WHEN {s!r} THEN {x!r}" for s, x in scripts.SCRIPT_LANG.items())

LEGACY = f"CASE WHEN {count('text', NOT_SPACE)} = 0 OR {count('text', scripts.char_class(scripts.REAL_SCRIPT))} > 0 THEN 0.0 ELSE CAST({count('text', scripts.char_class(scripts.LEGACY_SUSPECT))} AS DOUBLE) / {count('text', NOT_SPACE)} END"
_SPACED = f"list_filter(string_split_regex(text, {quoted(SPACE + '+')}), lambda x: regexp_matches(x, {quoted(scripts.char_class(scripts.SPACED_SCRIPT))}))"
MIXED = f"CASE WHEN len({_SPACED}) > 0 THEN CAST(len(list_filter({_SPACED}, lambda x: regexp_matches(x, '[A-Za-z]'))) AS DOUBLE) / len({_SPACED}) ELSE 0.0 END"
