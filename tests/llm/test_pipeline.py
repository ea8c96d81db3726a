"""The pipeline, stage by stage, against plain Python on the same rows."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_table_ops import brute_components
from test_text_ops import brute_hits

from lexiloom.llm import decontaminate, quality
from lexiloom.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    first = cp.keep_quality(spark, docs, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    import numpy as np

    rows = docs.collect()
    score = model.score(np.array([quality.figures(r.text) for r in rows]))
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {r.doc_id for r, s in zip(rows, score, strict=True) if s >= 0.3}

    second = cp.drop_near_copies(spark, first, sf_dir)
    kept = brute_components([(r.doc_id, r.text) for r in first.collect()])
    assert second.columns == columns and {r.doc_id for r in second.collect()} == {i for i, (_, c) in kept.items() if c == i}

    third = cp.drop_contaminated(spark, second, sf_dir)
    items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = second.collect()
    hits = brute_hits([r.text for r in rows], items)
    # a full window of 13 words is enough; short items count by their share
    full = brute_hits([r.text for r in rows], [x for x in items if len(decontaminate.words_of(x[1])) >= 13])
    clean = {r.doc_id for r, (n, h, _), (_, f, _) in zip(rows, hits, full, strict=True) if not f and not (h and 20 * h >= n)}
    assert third.columns == columns and {r.doc_id for r in third.collect()} == clean

    fourth = cp.mix_sources(spark, third, sf_dir)
    ids = [r.doc_id for r in fourth.collect()]
    assert fourth.columns == columns and len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in third.collect()}
    got = cp.write_tokens(spark, fourth, sf_dir).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).collect()) == sorted(map(tuple, got))


def test_empty_and_repeated_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    twice = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 20"))
    once = cp.drop_near_copies(spark, docs.where("doc_id < 20"), sf_dir).count()
    assert cp.drop_near_copies(spark, twice, sf_dir).count() == once


def test_contaminated_whatever_the_length(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").first().text.split()
    fill = " ".join(f"filler{i}" for i in range(5000))
    rows = [(1, f"{fill} {' '.join(item[:13])} {fill}"), (2, f"{fill} {' '.join(item[:12])} {fill}"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.drop_contaminated(spark, docs, sf_dir).collect()) == [2, 3, 4]


def test_edges_of_every_stage(spark, sf_dir):
    """Nulls in all columns, long texts, repeated ids and names that operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, runs int, full int, kept int, epoch int, domain string, _key int, bands int"
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(5, "one two three four"), (5, "quite another text here"), (5, "one two three four"), (None, "no id at all"), (None, None), (6, None), (7, ""), (8, long), (9, "one two three four")]
    docs = spark.createDataFrame([(i, t, None, None, None, "s", "p", 1, 1, 1, 1, "d", 1, 1) for i, t in rows], schema)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema and {r.score for r in out.collect()} <= {"s"}, name
    kept = sorted((str(r.doc_id), r.text) for r in cp.drop_near_copies(spark, docs.where("text IS NOT NULL"), sf_dir).collect())
    # of the copies, the id that occurs once stays
    assert kept == sorted([("5", "quite another text here"), ("None", "no id at all"), ("7", ""), ("8", long), ("9", "one two three four")])
    assert cp.drop_near_copies(spark, docs.where("text IS NULL"), sf_dir).count() == 2
    assert cp.write_tokens(spark, docs, sf_dir).count() == len(rows)
    assert cp.mix_sources(spark, docs.withColumn("text", F.lit(None).cast("string")), sf_dir).count() == len(rows)
