"""Every operator on nulls, empty and very long texts, repeats, empty tables and clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import chat, decontaminate, exact_dedup, html_text, language, mixing, near_dup, quality, sharding, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ROWS = [
    (1, "The cat sat on the mat.", "en", "a", 1),
    (2, None, "en", "a", 1),
    (3, "", None, None, None),
    (4, LONG, "de", "b", 1),
    (5, "the cat sat on the mat.", "en", None, 1),
    (None, "Nobody's row", "en", "b", 1),
    (6, "one", "en", "a", 1),
    (7, "  \n\t ", "en", "a", 1),
    (7, "  \n\t ", "en", "a", 1),
    (8, "Ünïcode 日本語 🙂 \u0000 text", None, "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, docs, empty):
    model = language.train(docs)
    extra = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = {(r.doc_id, r.text): r for r in language.identify(extra, model).collect()}
    assert len(got) == len(ROWS) - 1
    assert got[2, None].lang_pred == "und" and got[2, None].score == 0.0 and got[3, ""].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    signs = spark.createDataFrame([(1, "½ ①② 12 - Ⅷ"), (2, "½ the")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(signs, model).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0) and got[2].lang_pred in ("de", "en")
    flat = (model[0], ["b", "c", "a"], np.full((len(model[2]), 3), 1e-3))
    tie = language.identify(signs, (flat[0], sorted(flat[1]), flat[2])).where("doc_id = 2").first()
    assert tie.lang_pred == "a" and abs(tie.score - 1 / 3) < 1e-9
    assert language.identify(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 0), (6, 1, 1), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.train(docs, labels), quality.train(docs, labels.limit(0)), quality.train(empty, labels)):
        rows = quality.score_documents(docs.withColumn("predicted", F.lit("x")), model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert quality.score_documents(empty, model).count() == 0


def test_near_dup(spark, docs, empty):
    rows = near_dup.near_groups(docs.withColumn("bands", F.lit(1)).withColumn("n_shingles", F.lit("x"))).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert got[5].component_id == 1 and not got[5].kept and got[1].kept
    assert got[2].n_shingles == 0 and got[2].component_id == 2 and got[2].kept
    assert got[6].n_shingles == 1 and got[7].n_shingles == 0
    assert near_dup.near_groups(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, "Cat sat"), (2, None), (None, "one"), (3, "..."), (1, "cat sat")], "item_id long, text string")
    extra = docs.withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = {r.doc_id: r for r in decontaminate.judged(decontaminate.search(extra, bench)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (6, 2, 1, True)
    assert got[1].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[6].n_items == 1 and got[6].items_sha256 == hashlib.sha256(b"").hexdigest() and got[6].contaminated
    assert got[2].n_words == 0 and not got[2].contaminated
    assert decontaminate.judged(decontaminate.search(empty, bench)).count() == 0
    assert decontaminate.judged(decontaminate.search(docs, bench.limit(0))).agg(F.sum("n_hit")).first()[0] == 0


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs.withColumn("epoch", F.lit("x")).withColumn("domain", F.lit(1)), mixing.Target(share=1.0, max_epochs=1))
    assert out.count() == len(ROWS) and {r.n_tokens for r in out.where("doc_id = 2").collect()} == {0}
    assert mixing.mix(empty).count() == 0


def test_sharding(spark, docs, empty):
    rows = sharding.shard_documents(docs.withColumn("slot", F.lit(1)).withColumn("size", F.lit(1)), 4, 16).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.size for r in rows if r.doc_id == 2} == {8}
    assert sharding.shard_documents(empty).count() == 0


def test_token_files(spark, docs, empty):
    rows = token_files.token_digests(docs.withColumn("part", F.lit(9)).withColumn("ids", F.lit(9)), None).orderBy("start").collect()
    assert len(rows) == len(ROWS) and rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(r[0] for r in ROWS if r[0])
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert token_files.token_digests(empty).count() == 0


def test_exact_dedup(spark, docs, empty, tmp_path):
    docs.withColumn("digest", F.lit(1)).write.parquet(f"file://{tmp_path}/docs")
    rows = exact_dedup.exact_dedup(spark, f"file://{tmp_path}/docs").collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[1].keep_id == 5 and not got[1].kept and got[5].kept and got[1].group_size == 2
    assert got[2].keep_id == 3 and got[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.kept for r in rows if r.doc_id == 7) == [False, True]
    empty.write.parquet(f"file://{tmp_path}/empty")
    assert exact_dedup.exact_dedup(spark, f"file://{tmp_path}/empty").count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a.b/c", "", "x"), (2, "http://a.b/c", "<p>a<p>b &amp; c", "x"), (3, "no url", "<div>" * 300 + "deep", "x"), (4, "http://a.b", "<p>" + "word " * 200_000, "x")], "page_id long, url string, html string, path string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 5
    assert sorted(r.text for r in rows if r.page_id == 2) == ["", "a\nb & c"]
    assert next(r for r in rows if r.page_id == 4).n_chars == 5 * 200_000 - 1
    assert next(r for r in rows if r.page_id == 3).text == "deep"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_deep_and_broken_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for part in ("<div>", "<a ", "<a x='", "<a x='>'", "<li>", "<td>", "<", "<!--", '<p class="a">', "<p><div><span></p>"):
        page = html_text.Page(part * (1_000_000 // len(part)) + "deep")
        k, _ = page.best()
        assert page.find(page.path(k)) == k and len(page.text(k)) <= 1_500_000
    assert time.perf_counter() - began < 30


def test_names_in_and_outside_the_article():
    def text(source):
        page = html_text.Page(source)
        return page.text(page.best()[0])

    assert text("<body class='no-sidebar'><header>H</header><article><h1>T</h1><div class=body><p>" + "long " * 90 + "</p></div></article>").startswith("T\nlong")
    assert text("<article><div class='header'>Head</div><p class='share-price'>Price<p class='notice'>Note<div class='comment-list'>c</div></article><p class='notice'>out") == "Head\nPrice\nNote"
    assert text("<div id=w><div class=lead>lead text</div><div class=rest>rest of the text</div></div><div class=site-header>x</div>") == "lead text\nrest of the text"
    assert text("<article><section class=a>first</section><section class=b>" + "second " * 40 + "</section></article>").startswith("first\nsecond")
    assert text("<main><p hidden>x</p><div hidden>y</div><p title='hidden'>z</p></main>") == "z"


def test_chat(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "b", 1), (1, 1, "user", None, 1), (1, 1, None, "x", 1), (None, None, "user", "y", 1), (1, 2, "assistant", "b", 1), (2, 0, "assistant", "z" * 300_000, 1)], "conv_id long, turn long, role string, text string, record int")
    got = {r.conv_id: r for r in chat.digests(chat.format_records(chat.records(turns))).collect()}
    assert set(got) == {1, 2, None} and got[1].n_turns == 4 and got[1].loss_chars == 2 and got[2].loss_chars == 300_000
    assert chat.digests(chat.format_records(chat.records(turns.limit(0)))).count() == 0
