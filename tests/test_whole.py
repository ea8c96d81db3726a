"""Queries do the whole of their job: all queries, texts and arms."""

import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lexiloom.functions import citations
from lexiloom.functions.text import estimate_tokens
from lexiloom.operators import answer, retrieval, seams
from lexiloom.plans import registry


def test_the_stated_queries_meet_every_vector(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, v = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = registry.QUERIES["dense_topk"](spark, sf_dir).toPandas().sort_values(["query_id", "rank"])
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(set(got.query_id)) == asked
    s = np.round(v @ v.T, 6)
    for i, rows in zip(ids, s, strict=True):
        if i % 20 == 0:
            assert list(got[got.query_id == i].row_id) == list(ids[np.lexsort((ids, -rows))[:20]])
    assert registry.QUERIES["recall_at_k"](spark, sf_dir).count() == len(asked)
    assert registry.QUERIES["random_floor"](spark, sf_dir).count() == 20 * len(asked)


def test_blocks_merge(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", 3)
    v = spark.range(0, 300, 1, 7).select(F.col("id").alias("row_id"), F.array((F.col("id") % 5).cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    got = retrieval.dense_hits(v.where("row_id < 10").withColumnRenamed("row_id", "query_id"), v, 70).toPandas().sort_values(["query_id", "rank"])
    for i in range(10):
        assert list(got[got.query_id == i].row_id)[:60] == list(range(i % 5, 300, 5)) and len(got[got.query_id == i]) == 70


def test_random_hits_are_plain_arithmetic(spark):
    q, rows = spark.range(-3, 40).toDF("query_id"), spark.range(0, 500).toDF("row_id")
    got = {}
    for r in retrieval.random_hits(q, rows, 20, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.row_id))
    p, (a, b, c) = retrieval.PRIME, retrieval.MULTIPLIERS
    for i in range(-3, 40):
        points = {}
        for j in range(500):
            h = (i % p * a + j % p * b + 7 * c) % p
            for _ in range(2):
                h = (h * h + h * a + b) % p
            points[j] = h
        assert [j for _, j in sorted(got[i])] == sorted(points, key=lambda j: (-points[j], j))[:20]
    firsts = [j for own in got.values() for _, j in own]
    assert len(set(firsts)) > 350  # spread over the rows


def test_context_has_whole_texts(spark, tmp_path):
    tail = " ".join(f"filler{k}" for k in range(100)) + " zebra crossing."
    docs = [(1, tail), (2, "a short text about zebra"), (3, "nothing of it")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "zebra crossing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    blocks = {r.row_id: r.block for r in registry.QUERIES["context_blocks"](spark, str(tmp_path)).collect()}
    assert set(blocks) == {1, 2} and all(blocks[k].split("\n", 1)[1] == t for k, t in docs[:2])
    context = "\n\n".join(blocks[k] for k in (1, 2))
    prompt = f"{answer.SYSTEM}\n\nContext:\n{context}\n\nQuestion: zebra crossing\n(Answer in English.)\nAnswer:"
    tokens = spark.createDataFrame([(prompt,)], "p string").select(estimate_tokens(F.col("p"))).first()[0]
    got = registry.QUERIES["fit_context"](spark, str(tmp_path)).first()
    assert (got.n_context, got.n_dropped, got.prompt_sha256, got.prompt_tokens) == (2, 0, hashlib.sha256(prompt.encode()).hexdigest(), tokens)
    out = registry.QUERIES["answer_batch"](spark, str(tmp_path)).first()
    assert out.abstained == (out.answer == answer.ABSTAIN)


def outside_code(text):
    """Brute force: text with code blanked, by back-tick runs and fenced lines."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] not in "`~":
            out.append(text[i])
            i += 1
            continue
        j = i
        while j < n and text[j] == text[i]:
            j += 1
        run, end = j - i, None
        if run >= 3 and not text[:i].rpartition("\n")[2].strip():
            end, at = n, text.find("\n", j)
            while at != -1:
                line = text[at + 1 :].split("\n", 1)[0]
                if set(line.strip(" \t")) == {text[i]} and len(line.strip(" \t")) >= run:
                    end = at + 1 + len(line)
                    break
                at = text.find("\n", at + 1)
        elif text[i] == "`":
            at = j
            while at < n and end is None:
                if text[at] == "`":
                    k = at
                    while k < n and text[k] == "`":
                        k += 1
                    end, at = k if k - at == run else None, k
                else:
                    at += 1
        out.append(text[i:j] if end is None else "\n")
        i = end or j
    return "".join(out)


def test_citations_see_whole_answers(spark):
    made = ["one two three four [3] five [9], six [1, 7].", "a `x [4]` b [5] ``c ` [1]`` d [6]", "say\n```\n[2]\n```\nthen [4] ~ ` [8]", "one", "", "a  b [ 5 , 6 ] [x] [] c [5]", "~~~\n[1]\n~~~~\n [9] x `[2]` [3]", "[9] [8] y", "```\nopen [1]"]
    df = spark.createDataFrame(list(enumerate(made)), "k int, t string")
    got = {r.k: r for r in df.select("k", citations.find_markers(F.col("t")).alias("m"), citations.verify(F.col("t"), F.lit(5)).alias("v")).collect()}
    for k, text in enumerate(made):
        marks = [[int(x) for x in re.findall(r"\d+", m)] for m in re.findall(r"\[[ \t]*\d+(?:[ \t]*,[ \t]*\d+)*[ \t]*\]", outside_code(text))]
        every, kept = [x for m in marks for x in m], [x for m in marks for x in dict.fromkeys(m) if 1 <= x <= 5]
        assert got[k].m == every and got[k].v.used == sorted(set(kept))
        assert [int(x) for x in re.findall(r"\[(\d+)\]", outside_code(got[k].v.text))] == kept
        assert (got[k].v.emitted, got[k].v.grounded) == (len(every), len(kept))


def test_two_arms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    qs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").toPandas()
    e = seams.LetterEmbedder()
    d, q = (e.embed(list(x)).astype(float) for x in (docs.text, qs.text))
    d, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (d, q))
    points, ids = np.round(q @ d.T, 6), docs.doc_id.to_numpy()
    dense = {i: list(ids[np.lexsort((ids, -s))[:20]]) for i, s in zip(qs.item_id, points, strict=True)}
    lexical = {i: [] for i in qs.item_id}
    for r in duckdb.connect().execute(registry.ORACLE["bm25_topk"].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'").replace("FROM benchmark", f"FROM '{sf_dir}/benchmark.parquet'") + " ORDER BY query_id, rank").fetchall():
        lexical[r[0]].append(r[1])
    assert any(set(dense[i]) - set(lexical[i]) for i in dense) and any(set(lexical[i]) - set(dense[i]) for i in dense)
    got = registry.QUERIES["hybrid_topk"](spark, sf_dir).toPandas().sort_values(["query_id", "rank"])
    for i in dense:
        score, seen = {}, {}
        for n, arm in enumerate((dense[i], lexical[i])):
            for rank, x in enumerate(arm, 1):
                score[x] = score.get(x, 0) + 1 / (60 + rank)
                seen.setdefault(x, (n, rank))
        assert list(got[got.query_id == i].row_id) == sorted(score, key=lambda x: (-round(score[x], 9), seen[x], x))[:20]


def test_all_tokens_and_whole_headings(spark, tmp_path):
    docs = [(1, " ".join(f"w{k}" for k in range(30))), (2, " " * 25 + "late words")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["tokenize"](spark, str(tmp_path)).collect()}
    assert got[1].n == 30 and got[1].tokens == docs[0][1] and got[2].tokens == "late words"
    assert {r.doc_id: r.level for r in registry.QUERIES["heading_level"](spark, str(tmp_path)).collect()} == {1: 2, 2: 3}


def test_the_gate_in_one_grouping(spark):
    """The same documents as by the joined form; spans without text and pages below 1 included."""
    from lexiloom.operators import blocks

    texts = {"a": ["plain words " * 9, "  more  "], "b": ["short"], "c": ["தமிழ் " * 30, "abதமிழ் " * 20], "d": ["ãäåæ " * 30], "e": ["x " * 60, None], "f": [], "g": ["ãä " * 10 + "слово " * 30, "文字 " * 20 + "é" * 40], "h": [" " * 80, "　y"]}
    rows = [(d, 1 + k // 2, k, t) for d, ts in texts.items() for k, t in enumerate(ts)] + [("z", 0, 0, "y" * 90)]
    b = spark.createDataFrame(rows, "doc_id string, page int, reading_order int, text string")
    want = blocks.text_layer_gate(b, b.groupBy("doc_id").agg(F.max("page").alias("n_pages"))).where("has_text_layer")
    got = blocks.with_text_layer(b)
    assert got.columns == b.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in want.collect()} == {"a", "e", "g"}
    assert got.count() == b.join(want, "doc_id", "left_semi").count()


def test_items_become_blocks_once(spark, tmp_path, monkeypatch):
    """A second ingest of the same items reads what the first has made; other items are made anew."""
    from lexiloom.operators import blocks
    from lexiloom.plans import compose

    rows = [("a", 1, (0.0, 20.0 * k, 1.0, 20.0 * k + 9), f"line {k} of some length for the gate", 9.0, 0.0) for k in range(4)]
    schema = "doc_id string, page int, bbox struct<x0: double, y0: double, x1: double, y1: double>, text string, size double, bold double"
    items, root = spark.createDataFrame(rows, schema), f"file://{tmp_path}/index"
    path, manifest = compose.ingest_items(items, root, 1.0)
    made = lambda: len(list((tmp_path / "index-cache" / "stages" / "blocks").iterdir()))
    assert manifest["n_vectors"] == 1 and made() == 1
    assert compose.ingest_items(items, root, 1.0)[0] == path and made() == 1
    assert compose.ingest_items(items, root, 1000.0)[0] and made() == 2
    assert compose.ingest_items(items.where("bbox.y0 < 50"), root, 1.0)[0] != path and made() == 3


def test_lexical_hits_where_counts_lie(spark, monkeypatch):
    """Scored by tasks or by shuffle, in any blocks: the same hits; only matches, copies by their ids."""
    words = "the light of logic gates и слово été 光合作用 (light) light. LIGHT ﬀ ß ςas İx".split()
    rows = [(7 * i % 1000, " ".join(words[(i * j * j + j) % len(words)] for j in range(i % 13)), 0) for i in range(120)] + [(5000, None, 0), (5001, "光合作用的光", 0), (5002, " … ", 0), (5003, "the the the\x1flight", 0)]
    rows += [(9000 + i, "light of the copies", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "row_id long, text string, x int").drop("x").repartition(5)
    qs = spark.createDataFrame([(1, "Light of gates"), (2, "слово"), (3, "光合作用"), (4, "the copies the"), (5, "nothing here"), (6, None), (-7, "été ß")], "query_id long, text string")

    def hits():
        return [tuple(r) for r in retrieval.lexical_hits(qs, docs, 20).select("query_id", "rank", "row_id", "score").orderBy("query_id", "rank").collect()]

    called, shuffled = [], retrieval._lexical_by_shuffle
    monkeypatch.setattr(retrieval, "_lexical_by_shuffle", lambda *a: called.append(1) or shuffled(*a))
    own = hits()
    assert not called and {h[0] for h in own} == {1, 2, 3, 4, -7} and [h[2] for h in own if h[0] == 4] == list(range(9000, 9020))
    with monkeypatch.context() as m:
        m.setattr(retrieval, "QUERIES_PER_PASS", 2)
        m.setattr(retrieval, "ROWS_AT_ONCE", 7)
        m.setattr(retrieval, "DENSE_TERMS", 1)
        assert hits() == own
        m.setattr(retrieval, "BROADCAST_PAIRS", 3)
        assert hits() == own and called
    # rows that share an id are one row
    twice = docs.unionByName(docs.where("row_id = 9000"))
    called.clear()
    assert retrieval.lexical_hits(qs, twice).groupBy("query_id", "row_id").count().where("count > 1").isEmpty() and called


def test_words_are_tokens(spark):
    from lexiloom.functions import text as tx
    from lexiloom.functions.scripts import detect

    rows = ["", "  ", "a", "光", "光 合\n作用", "Hello, (World)! 2.4.1", "x\u0085y z　w\x1cv᠎u​t", "«été» ßΣς …", "한국어 표현", "\U00020000𠀁a", None, "--- a-b _c_"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "row_id long, text string")
    want = df.select("row_id", tx.tokens(F.col("text"), detect(F.col("text"))).alias("t")).orderBy("row_id").collect()
    got = {r.row_id: retrieval._words(r.folded, r.pairs) for r in retrieval._tokenising(df).collect()}
    assert [got[r.row_id] for r in want] == [r.t for r in want]


def test_hits_are_found_once(spark, monkeypatch):
    """Reranking, context and citations read hits that were written."""
    real, made = retrieval.staged, []
    monkeypatch.setattr(retrieval, "staged", lambda df, name: made.append(name) or real(df, name))
    for name in ("bm25_topk", "rerank_topn", "citation_list", "context_blocks", "fit_context"):
        made.clear()
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert made.count("lexical") == made.count("known_terms") == 1 and "MapInArrow" not in plan


def test_arms_and_context_are_run_once(spark, monkeypatch):
    """Gate, context and citations read hits and blocks that were written."""
    from lexiloom.plans import compose

    made = []
    for module in (retrieval, compose, answer):
        monkeypatch.setattr(module, "staged", lambda df, name, real=module.staged: made.append(name) or real(df, name))
    plan = registry.QUERIES["answer_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert [made.count(n) for n in ("dense", "lexical", "fused", "context")] == [1] * 4
    assert "MapInPandas" not in plan and "documents.parquet" not in plan
