"""Chunks, index, retrieval, answers, evaluation, traces, cache, sources, streams."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from lexiloom.config import ChunkConfig, Config, ConfigError, RerankConfig, RetrieveConfig, from_dict, hash_object
from lexiloom.functions.text import estimate_tokens
from lexiloom.operators import answer, blocks, cache, chunks, evaluate, imaging, index, retrieval, seams, traces
from lexiloom.plans import compose
from lexiloom.schema import RULES, TRACE, conform, violations
from lexiloom.sources import files, readers, sinks
from lexiloom.streaming import ingest

CFG = ChunkConfig()


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def pieces(*items):
    return [chunks.Piece(f"b{k}", t, len(t.split()), heading) for k, (t, heading) in enumerate(items)]


def ids(groups):
    return [[p.id for p in g.pieces] for g in groups]


def test_oversize_block_is_one_chunk():
    got = chunks.chunk_pieces(pieces((words(1000, "w"), False)), CFG)
    assert len(got) == 1 and got[0].cost == 1000


def test_coverage_and_overlap():
    got = chunks.chunk_pieces(pieces(*[(words(30, f"t{i}_"), False) for i in range(30)]), CFG)
    assert {i for g in ids(got) for i in g} == {f"b{k}" for k in range(30)}
    for a, b in zip(got, got[1:], strict=False):
        shared = {p.id for p in a.pieces} & {p.id for p in b.pieces}
        assert shared and sum(p.cost for p in b.pieces if p.id in shared) <= 60
        assert not {p.id for p in b.pieces} <= {p.id for p in a.pieces}


def test_headings_bound_chunks_and_nest():
    assert ids(chunks.chunk_pieces(pieces(("A", True), (words(200, "x"), False), ("B", True), (words(200, "y"), False)), CFG)) == [["b0", "b1"], ["b2", "b3"]]
    got = chunks.chunk_pieces(pieces(("Part Two", True), ("3.1 L", True), (words(100, "a"), False), ("3.1.1 M", True), (words(100, "b"), False), ("3.2 N", True), (words(100, "c"), False)), CFG)
    assert [g.path for g in got] == [("Part Two", "3.1 L"), ("Part Two", "3.1 L", "3.1.1 M"), ("Part Two", "3.2 N")]
    assert "b0" not in ids(got)[0]


def test_short_groups_fold():
    assert ids(chunks.chunk_pieces(pieces(("3.1 X", True), (words(100, "a"), False), ("Index", True)), CFG))[-1] == ["b2"]
    got = chunks.chunk_pieces(pieces((words(390, "a"), False), (words(20, "b"), False)), ChunkConfig(400, 0, 80))
    assert len(got) == 1 and got[0].cost == 410
    got = chunks.chunk_pieces(pieces(("PART 9", True), ("STONES AND SAND", True), (words(300, "c"), False)), CFG)
    assert len(got) == 1 and got[0].path == ("STONES AND SAND",) and got[0].pieces[0].text == "PART 9"


def test_a_long_section_is_linear():
    import time

    began = time.perf_counter()
    got = chunks.chunk_pieces(pieces(("Head", True), *[(f"line {k}", False) for k in range(200_000)]), CFG)
    assert len(got) > 900 and time.perf_counter() - began < 10


def block_rows(spark):
    rows = [("b0", "doc-a", 1, (0.1, 0.1, 0.9, 0.2), "paragraph", 0, "latn", "one two three"), ("b1", "doc-a", 2, (0.2, 0.05, 0.95, 0.85), "paragraph", 1, "hans", "光合作用是植物的过程光合作用是植物的过程光合作用"), ("c0", "doc-b", 1, (0.1, 0.1, 0.9, 0.2), "heading", 0, "latn", "Alone")]
    return spark.createDataFrame(rows, "block_id string, doc_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, kind string, reading_order int, script string, text string")


def test_build_chunks(spark):
    got = {r.doc_id: r for r in chunks.build_chunks(block_rows(spark)).collect()}
    a = got["doc-a"]
    assert (a.page_start, a.page_end, a.script, a.lang, a.block_ids) == (1, 2, "hans", "zh", ["b0", "b1"])
    assert tuple(a.bbox_union) == (0.1, 0.05, 0.95, 0.85) and a.text.startswith("one two three\n\n光")
    assert a.chunk_id == hashlib.sha256(b"doc-a|b0,b1").hexdigest()[:32] and got["doc-b"].heading_path == ["Alone"]


def test_index_round_trip(spark, tmp_path):
    c = chunks.build_chunks(block_rows(spark))
    path, manifest = index.build_index(c, f"file://{tmp_path}/ix")
    again, _ = index.build_index(c, f"file://{tmp_path}/ix")
    rows = index.load_index(spark, path).orderBy("row_id").collect()
    assert again == path and manifest["n_vectors"] == 2 and [r.row_id for r in rows] == [0, 1] and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    with pytest.raises(index.IndexFault, match="another embedder"):
        index.load_index(spark, path, seams.HashingEmbedder(dim=32))
    with pytest.raises(index.IndexFault, match="no manifest"):
        index.load_index(spark, f"file://{tmp_path}/none")


def test_rows_follow_documents_and_losses_are_seen(spark, tmp_path):
    made = spark.range(0, 1500).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("d"), (F.col("id") * 7 % 500)).alias("doc_id"), F.col("id").cast("int").alias("chunk_no"), F.concat(F.lit("text "), "id").alias("text"))
    rows = sorted((r.row_id, r.doc_id, r.chunk_no) for r in index.with_row_ids(made).collect())
    assert [r[0] for r in rows] == list(range(1500)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    with pytest.raises(index.IndexFault, match="lost"):
        index.build_index(made, f"file://{tmp_path}/ix", vectors=lambda r: r.where("row_id > 3").withColumn("vector", F.array_repeat(F.lit(0.5).cast("float"), 64)))
    path, manifest = index.build_index(made, f"file://{tmp_path}/ix")
    files.delete(spark, f"{path}/chunks/_SUCCESS")  # an index that is not whole is made anew
    again, _ = index.build_index(made, f"file://{tmp_path}/ix")
    assert again == path and manifest["n_vectors"] == 1500 and files.exists(spark, f"{path}/chunks/_SUCCESS")


def test_vectors_are_made_once(spark, tmp_path):
    store = cache.VectorCache(spark, f"file://{tmp_path}/v", seams.LetterEmbedder())
    docs = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "b")], "doc_id long, text string")
    assert store.get_or_compute(docs.where("doc_id < 3")).count() == 2 and spark.read.parquet(store.path).count() == 1
    got = {r.doc_id: list(r.vector[:2]) for r in store.get_or_compute(docs).collect()}
    assert got == {1: [1, 1], 2: [1, 1], 3: [0, 1]} and spark.read.parquet(store.path).count() == 2


def test_index_faults(spark):
    rows = [("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [1.0]), ("c", [float("nan"), 1.0])]
    got = {tuple(r) for r in index.faults(spark.createDataFrame(rows, "chunk_id string, vector array<float>"), 2).collect()}
    assert got == {("a", "repeated"), ("b", "width"), ("c", "not finite")}


def vectors(spark):
    v = {1: (1, 3, 0), 2: (1, 0, 0), 3: (0, 1, 0), 4: (3, 1, 0), 5: (1, 1, 0), 6: (0, 0, 0)}
    return spark.createDataFrame([(k, [float(x) for x in t]) for k, t in v.items()], "row_id long, vector array<float>")


def test_dense_order_and_scores(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0])], "query_id long, vector array<float>")
    got = retrieval.dense_hits(q, vectors(spark), 10).orderBy("query_id", "rank").collect()
    first = [r for r in got if r.query_id == 0]
    assert [r.row_id for r in first] == [2, 4, 5, 1, 3, 6]
    assert [r.score for r in first] == [1.0, round(3 / math.sqrt(10), 6), round(1 / math.sqrt(2), 6), round(1 / math.sqrt(10), 6), 0.0, 0.0]
    assert [r.row_id for r in got if r.query_id == 1] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        retrieval.dense_hits(q, vectors(spark), 0)


CORPUS = ["rivers carry light sand into water", "the old map was drawn by Anna Petrova", "a glacier is the slow river of a mountain", "page 7.1.4 lists stone kinds and their names", "light rain on hills feeds the brook"]


def test_bm25(spark):
    rows = spark.createDataFrame(list(enumerate(CORPUS, 1)), "row_id long, text string")
    q = spark.createDataFrame([(0, "Anna Petrova"), (1, "7.1.4"), (2, "glacier"), (3, "மழை"), (4, "light light")], "query_id long, text string")
    got = {}
    for r in retrieval.lexical_hits(q, rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got[0][0].row_id == 2 and got[1][0].row_id == 4 and len(got[2]) == 1 and 3 not in got
    n, df, avg = 5, 2, sum(len(t.split()) for t in CORPUS) / 5
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 6 / avg))
    assert abs({r.row_id: r.score for r in got[4]}[1] - want) < 1e-5


def hits(spark, *rows):
    return spark.createDataFrame([(0, r, k, None, 0) for k, r in rows], "query_id long, row_id long, rank int, gate_score double, degraded int").withColumn("score", F.lit(1.0) / F.col("rank"))


def test_fusion(spark):
    dense, lexical = hits(spark, (1, 1), (2, 2), (3, 3)), hits(spark, (1, 2), (2, 4), (3, 1))
    got = retrieval.fuse([(dense, 1.0), (lexical, 1.0)], 10).orderBy("rank").collect()
    assert [r.row_id for r in got] == [2, 1, 4, 3]
    assert [r.score for r in got] == [round(x, 9) for x in (1 / 62 + 1 / 61, 1 / 61 + 1 / 63, 1 / 62, 1 / 63)]
    got = retrieval.fuse([(hits(spark, (1, 1), (2, 2)), 3.0), (hits(spark, (1, 2), (2, 1)), 1.0)], 10).orderBy("rank").collect()
    assert got[0].row_id == 1 and got[0].score == round(3 / 61 + 1 / 62, 9)
    assert retrieval.fuse([(dense, 1.0)], 2).count() == 2
    tie = retrieval.fuse([(hits(spark, (1, 8)), 1.0), (hits(spark, (1, 5)), 1.0)], 5).orderBy("rank").collect()
    assert [r.row_id for r in tie] == [8, 5]
    with pytest.raises(ValueError):
        retrieval.fuse([], 5)


def test_rerank(spark):
    five = hits(spark, *[(k, k) for k in range(1, 6)])
    s = spark.createDataFrame([(0, k, v) for k, v in zip(range(1, 6), (0.1, 0.2, 0.3, 0.9, 0.05), strict=True)], "query_id long, row_id long, new_score double")
    assert [r.row_id for r in retrieval.rerank(five, s, 5).orderBy("rank").collect()] == [4, 3, 2, 1, 5]
    two = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9)], "query_id long, row_id long, new_score double")
    assert [r.row_id for r in retrieval.rerank(five.where("rank < 5"), two, 2).orderBy("rank").collect()] == [2, 1, 3, 4]
    lost = retrieval.rerank(five, two, 3).orderBy("rank").collect()
    assert [r.row_id for r in lost] == [1, 2, 3, 4, 5] and lost[0].degraded == 1


def test_rewrite(spark):
    q = spark.createDataFrame([(0, "what about it"), (1, "rivers in spring carry sand and fresh water"), (2, "why this")], "query_id long, text string")
    raw = F.when(F.col("query_id") == 0, '\n "standalone query" \nmore').when(F.col("query_id") == 2, F.repeat(F.lit("x"), 500)).otherwise("unused")
    got = {r.query_id: r for r in retrieval.rewritten(q, raw).collect()}
    assert got[0].text == "standalone query" and got[1].text.startswith("rivers") and got[2].text == "why this" and got[2].degraded == 1


def test_gate(spark):
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id long")
    h = spark.createDataFrame([(0, 0.45), (1, 0.449)], "query_id long, gate_score double")
    assert {r.query_id: r.abstained for r in retrieval.gate(q, h).collect()} == {0: False, 1: True, 2: True}


def test_answers(spark):
    rows = spark.createDataFrame([(k, f"d{k}", t, 1, k % 2 + 1, ["H"]) for k, t in enumerate(CORPUS, 1)], "row_id long, doc_id string, text string, page_start int, page_end int, heading_path array<string>")
    q = spark.createDataFrame([(0, "light sand"), (1, "nothing here at all")], "query_id long, text string")
    h = retrieval.lexical_hits(q, rows)
    gated = q.select("query_id", (F.col("query_id") == 1).alias("abstained"))
    got = {r.query_id: r for r in answer.answers(q, gated, h, rows).collect()}
    assert not got[0].abstained and got[0].citations and got[0].groundedness == 1.0 and got[0].language_match
    assert got[1].abstained and got[1].answer == answer.ABSTAIN and got[1].citations == [] and got[1].groundedness is None
    b = answer.context_blocks(h, rows)
    tight = answer.fit_context(q, b, 10).collect()
    assert all(r.n_context == 1 for r in tight)
    full = answer.fit_context(q, b, 10**6).where("query_id = 0").first()
    assert full.n_dropped == 0 and full.prompt_tokens == spark.createDataFrame([(full.prompt,)], "p string").select(estimate_tokens(F.col("p"))).first()[0]


def test_abstain_and_tier3(spark):
    df = spark.createDataFrame([('"I couldn\'t find this in your documents"',), ("I found it.",), ("Text [1] here",)], "t string")
    assert [r[0] for r in df.select(answer.is_abstain(F.col("t"))).collect()] == [True, False, False]
    with pytest.raises(PermissionError):
        answer.tier3_answer(F.col("t"))
    got = df.select(answer.tier3_answer(F.col("t"), enabled=True, after_abstain=True).alias("x")).collect()[2].x
    assert got == f"{answer.ABSTAIN}\n\n{answer.DISCLAIMER}\n\nText here"


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "d1", [42], {"d9": [3]}), (2, "d2", [7], {})], "q_id long, doc_id string, gold_pages array<int>, alt_sources map<string,array<int>>")
    h = spark.createDataFrame([(1, "d1", 40, 41, 1), (1, "d9", 2, 4, 3), (2, "d1", 7, 7, 1)], "q_id long, doc_id string, page_start int, page_end int, rank int")
    rel = evaluate.relevant_hits(h, evaluate.gold_pages(gold))
    q = spark.createDataFrame([(1, "en", True, False), (2, "zh", True, True), (3, "en", False, True)], "q_id long, lang string, answerable boolean, abstained boolean")
    rows = evaluate.per_question(q, rel)
    got = {r.q_id: r for r in rows.collect()}
    assert (got[1].recall_1, got[1].recall_5, round(got[1].rr_10, 6), got[2].rr_10) == (0.0, 1.0, 0.333333, 0.0)
    m = {r.lang: r for r in evaluate.metrics(rows).collect()}
    assert m[None].is_total and not m["en"].is_total
    one = evaluate.metrics(rows.withColumns({"lang": F.lit(None).cast("string"), "groundedness": F.lit(0.5), "language_match": F.lit(True)})).collect()
    assert sorted(r.is_total for r in one) == [False, True] and {(r.n_scored, r.groundedness) for r in one} == {(1, 0.5)}
    assert m[None].n == 3 and m[None].recall_5 == 0.5 and m[None].abstain_precision == 0.5 and m["en"].abstain_precision == 1.0
    assert evaluate.abstain_scores(rows.where("NOT abstained")).first().precision is None
    assert {r.bucket: r.n for r in evaluate.rank_distribution(rows).collect()} == {"2-5": 1, "never": 1}
    assert evaluate.gold_faults(spark.createDataFrame([(1, "d", [], {"e": [1]}), (2, "d", [1], {"d": [1]}), (3, "d", [1], {})], gold.schema)).count() == 2


def test_traces(spark, tmp_path):
    rec = traces.TraceRecorder("q", "ta", "h")
    with rec.stage("embed"):
        pass
    rec.device("embedder", "GPU", "CPU")
    rec.retrieved([0.2, 0.7])
    rec.tokens(10, 2)
    row = rec.finish(rec._row["trace_id"], 1, False, 3)
    with pytest.raises(RuntimeError):
        rec.finish(row["trace_id"], 1, False, 3)
    df = traces.to_frame(spark, [row])
    traces.write_traces(df, f"file://{tmp_path}/t")
    traces.write_traces(df, f"file://{tmp_path}/t")
    back = traces.read_traces(spark, f"file://{tmp_path}/t")
    assert back.count() == 2 and back.schema.fieldNames() == TRACE.fieldNames() and back.first().top_score == 0.7
    assert traces.fallbacks(back).first().n_fell_back == 2 and traces.stage_means(back).first().stage == "embed"
    assert traces.stage_map(back).first().stage_ms.keys() == {"embed"}
    assert violations(back, RULES["trace"]).count() == 0


def test_stage_cache(spark, tmp_path):
    c, df = cache.StageCache(spark, f"file://{tmp_path}/c"), spark.range(5)
    key = cache.StageKey("s", cache.hash_rows(df), "1", "none")
    runs = [c.get_or_compute(key, df.schema, lambda: df) for _ in range(2)]
    assert [r.hit for r in runs] == [False, True] and runs[1].n_out == 5
    assert cache.hash_rows(spark.range(4, -1, -1).select("id")) == cache.hash_rows(df) != cache.hash_rows(spark.range(6))
    with pytest.raises(cache.CacheFault):
        c.load(key, spark.createDataFrame([], "other string").schema)


def test_config():
    cfg = Config()
    assert from_dict(json.loads(json.dumps({"retrieve": {"k": 30}}))).retrieve.k == 30
    assert cfg.config_hash != from_dict({"retrieve": {"k": 30}}).config_hash and cfg.chunk_config_hash == from_dict({"retrieve": {"k": 30}}).chunk_config_hash
    assert cfg.with_arms({"hybrid"}).retrieve.hybrid.enabled and hash_object({"b": 1, "a": 2}) == hash_object({"a": 2, "b": 1})
    for bad in ({"nope": 1}, {"retrieve": {"n_context": 50}}, {"chunk": {"overlap": 400}}):
        with pytest.raises(ConfigError):
            from_dict(bad)
    with pytest.raises(ConfigError):
        Config(retrieve=RetrieveConfig(rerank=RerankConfig(True)))


def test_blocks(spark):
    df = spark.createDataFrame([("Figure 3 shows", 10.0, 0.0), ("Results", 12.0, 0.0), ("Bold line", 10.3, 0.9), ("- item", 10.0, 0.0), ("small print of a page", 9.0, 0.0), ("Plain text here", 10.0, 0.0)], "t string, s double, b double")
    assert [r[0] for r in df.select(blocks.classify(F.col("t"), F.col("s"), F.col("b"), F.lit(10.0), F.lit(False))).collect()] == ["caption", "heading", "heading", "list", "caption", "paragraph"]
    assert [r[0] for r in df.select(blocks.classify_ocr(F.col("t"), F.col("s"), F.lit(8.0))).collect()][1] == "heading"
    items = spark.createDataFrame([("d", 1, (0.5, 0.100, 0.9, 0.12)), ("d", 1, (0.1, 0.101, 0.4, 0.12)), ("d", 1, (0.1, 0.5, 0.4, 0.52))], "doc_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.bbox.x0 for r in blocks.reading_order(items).orderBy("reading_order").collect()] == [0.1, 0.5, 0.1]
    spans = spark.createDataFrame([("d", 10.04, "abcd"), ("d", 9.0, "abcd"), ("d", 12.0, "a")], "doc_id string, size double, text string")
    assert blocks.body_size(spans).first().body_size == 9.0
    box = spark.range(1).select(blocks.unit_bbox(F.lit(50.0), F.lit(20.0), F.lit(-10.0), F.lit(40.0), F.lit(100.0), F.lit(100.0)).alias("b")).first().b
    assert tuple(box) == (0.0, 0.2, 0.5, 0.4)
    o = spark.createDataFrame([("x", "latn", 0.31), (" ", "latn", 0.9), ("y", "taml", 0.4)], "text string, script string, ocr_confidence double")
    assert blocks.confident(o, {"taml": 0.5}).count() == 1


def test_schema_rules(spark):
    bad = spark.createDataFrame([("c", 0, -1, [], 5)], "chunk_id string, page_start int, page_end int, block_ids array<string>, token_count int")
    assert set(violations(bad, RULES["chunk"]).first().broken) == {"page_start", "page_end", "block_ids"}
    assert conform(spark.range(1).withColumn("x", F.lit(1)), spark.range(1).schema).columns == ["id"]


def test_sources(spark, tmp_path):
    (tmp_path / "pdf" / "tamil").mkdir(parents=True)
    for name, body in (("a.pdf", b"%PDF-1.7 x"), ("tamil/b.pdf", b"%PDF-1.7 x"), ("c.pdf", b" \n"), ("d.pdf", b"MZ"), ("e.txt", b"%PDF")):
        (tmp_path / "pdf" / name).write_bytes(body)
    got = {r.filename: r.status for r in readers.pdf_files(spark, f"file://{tmp_path}/pdf").collect()}
    assert got == {"a.pdf": "ok", "c.pdf": "corrupt", "d.pdf": "unsupported"}
    assert spark.sql("SELECT '/x/tamil/b.pdf' AS p").select(readers.script_hint(F.col("p"))).first()[0] == "taml"
    (tmp_path / "g.jsonl").write_text('# note\n\n{"q":"?","lang":"en","doc_id":"d1","gold_pages":[42],"alt_doc_ids":["d2"]}\n{"q":"!","lang":"ta","doc_id":"d1","gold_pages":[],"note":"none"}\n{"q":"x","lang":"en","doc_id":"d1","gold_pages":[1],"alt_doc_ids":{"d3":[5]}}\n')
    g = {r.q: r.alt_sources for r in readers.golden(spark, f"file://{tmp_path}/g.jsonl").collect()}
    assert g == {"?": {"d2": [42]}, "!": {}, "x": {"d3": [5]}}
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(ValueError):
        readers.golden(spark, f"file://{tmp_path}/bad.jsonl")
    for odd in ("7", '"d2"'):
        (tmp_path / "odd.jsonl").write_text('\n{"q":"?","lang":"en","doc_id":"d","gold_pages":[1],"alt_doc_ids":%s}\n' % odd)
        with pytest.raises(ValueError, match="odd.jsonl:2"):
            readers.golden(spark, f"file://{tmp_path}/odd.jsonl")
    files.write_text(spark, f"file://{tmp_path}/m.json", '{"metrics": {"recall@5": 0.9}}')
    assert readers.baseline(spark, f"file://{tmp_path}/m.json") == {"recall@5": 0.9} and readers.baseline(spark, f"file://{tmp_path}/x") == {}
    run = sinks.write_run(spark.range(3), f"file://{tmp_path}/runs", "dense")
    assert sinks.latest_run(spark.read.parquet(f"file://{tmp_path}/runs"), "dense").count() == 3 and run.endswith("Z")
    assert sinks.differences(spark.range(3), spark.range(3)).count() == 0


def test_streams(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    docs.write.parquet(f"file://{tmp_path}/in")
    docs.limit(5).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = ingest.document_stream(spark, f"file://{tmp_path}/in", docs.schema)
    ingest.ingest_blocks(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/log").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").select("doc_id").distinct().count() == 20


def test_seams():
    e = seams.HashingEmbedder()
    v = e.embed(["alpha beta", "", "alpha beta"])
    assert (v[0] == v[2]).all() and v[1].sum() == 0 and abs((v[0] ** 2).sum() - 1) < 1e-6 and set(e.fingerprint()) == set(seams.FINGERPRINT)
    assert seams.ctc_decode([0, 1, 1, 0, 1, 2], [0.1, 0.9, 0.8, 0.1, 0.7, 0.5], ["", "a", "b"]) == ("aab", pytest.approx(0.7))
    with pytest.raises(seams.Unavailable):
        seams.read_pages(None, None)


def test_compose(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"{t}\nsecond line {k}") for k, t in enumerate(CORPUS)], "doc_id long, text string")
    path, _ = compose.ingest(docs, f"file://{tmp_path}/ix")
    assert compose.only_index(spark, f"file://{tmp_path}/ix") == path
    rows = index.load_index(spark, path)
    gold = spark.createDataFrame([(1, "old map Anna Petrova", "en", "1", [1], "", {}), (2, "it", "en", "9", [], "", {})], "q_id long, q string, lang string, doc_id string, gold_pages array<int>, note string, alt_sources map<string,array<int>>")
    got, skipped = compose.evaluate_arms(gold, rows)
    table = {r.arm: r for r in got.collect()}
    assert set(table) == {"dense", "hybrid", "rewrite", "hybrid+rewrite"} and all(r.recall_5 == 1.0 and r.degraded == 0 for r in table.values())
    assert set(skipped) == {"rerank", "rerank+hybrid", "rerank+rewrite", "rerank+hybrid+rewrite"}
    out = {r.query_id: r for r in compose.ask(gold.select(F.col("q_id").alias("query_id"), F.col("q").alias("text")), rows).collect()}
    assert not out[1].abstained and out[2].abstained
    assert compose.golden_pool(gold).count() >= 2
    edge = spark.createDataFrame([("a", 1, "x" * 100), ("b", 1, "x" * 101)], "doc_id string, page int, text string")
    assert [r.doc_id for r in readers.describe(edge).where("text_layer").collect()] == ["b"]


def test_manifest(spark, tmp_path):
    at = f"file://{tmp_path}/m.json"
    sinks.merge_manifest(spark, at, [{"name": "a", "precision": "int8", "v": 1}, {"name": "b"}])
    got = sinks.merge_manifest(spark, at, [{"name": "a", "precision": "int4", "v": 2}])
    assert [(m["name"], m.get("v"), m.get("precision")) for m in got["models"]] == [("a", 2, "int4"), ("b", None, None)] and sinks.read_manifest(spark, at) == got


def test_imaging():
    import numpy as np

    g = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert imaging.to_rgb(g).shape == (4, 4, 3) and imaging.crop(g, (3.2, -1, 9, 0.5)).tolist() == [[3]]
    assert (imaging.resize(g, 4, 4) == g).all() and imaging.resize(np.full((2, 2), 7, np.uint8), 5, 3).tolist() == [[7] * 3] * 5
    assert imaging.unclip((0, 0, 10, 10), 2.0) == (-5.0, -5.0, 15.0, 15.0)
    s = np.zeros((6, 8))
    s[0, 0] = s[1, 1] = s[2, 2] = 0.9
    s[4, 6] = 0.8
    assert imaging.regions(s, 0.5) == [((0, 0, 3, 3), pytest.approx(0.9)), ((6, 4, 7, 5), pytest.approx(0.8))]
    assert imaging.charset(["a"], 3) == ["", "a", " "]
    with pytest.raises(ValueError):
        imaging.charset(["a"], 9)
