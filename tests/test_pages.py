"""Page images, recognition, device runs, dictionaries."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexiloom.config import Config, ModelsConfig, ModelSpec
from lexiloom.operators import devices, imaging, index, ocr, seams
from lexiloom.plans import compose
from lexiloom.plans.pages import PRINTED, Bytes, PrintedFiles, PrintedPages, Strips
from lexiloom.sources import readers

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FILES = "doc_id string, content binary, script_hint string"


class Fixed(Bytes):
    """Reads strips with one confidence, behind a mark; counts how many it is given at once."""

    def __init__(self, mark, sure):
        self.mark, self.sure = mark, sure

    def recognise(self, crops):
        assert len(crops) <= ocr.BATCH
        ratios = [c.shape[1] / c.shape[0] for c in crops]
        assert ratios == sorted(ratios)
        return [(self.mark + t, self.sure) for t, _ in super().recognise(crops)]

    factor = 1


class Broken:
    def detect(self, image):
        raise RuntimeError("read again")


def engine(**sure):
    marks = {"unknown": "", "cyrl": "к", "latn": "l", "taml": "த"}
    return ocr.Engine(Strips, lambda head: Fixed(marks[head], sure[head]), tuple(sure), "fixed")


def files(spark, *rows):
    return spark.createDataFrame([(d, t.encode(), h) for d, t, h in rows], FILES)


def blocks_of(spark, tmp_path, eng, *rows, **kw):
    out = ocr.read_documents(files(spark, *rows), PrintedPages(), eng, f"file://{tmp_path}/lines", **kw)
    return [(r.doc_id, r.page, r.reading_order, r.block_id, r.script, r.text) for r in out.orderBy("doc_id", "reading_order").collect()]


def test_heads(spark, tmp_path):
    rows = (("a", "слово\n\nword", None), ("b", "слово\nword", "latn"), ("c", "слово", "thai"))
    got = blocks_of(spark, tmp_path, engine(unknown=0.9, cyrl=0.8, latn=0.7), *rows)
    # each line by the head of its script; a hint without a head is no hint
    assert got == [
        ("a", 1, 0, "a:1:00000", "cyrl", "кслово"),
        ("a", 1, 1, "a:1:00001", "latn", "lword"),
        ("b", 1, 0, "b:1:00000", "cyrl", "кслово"),
        ("b", 1, 1, "b:1:00001", "latn", "lword"),
        ("c", 1, 0, "c:1:00000", "cyrl", "кслово"),
    ]


def test_a_hint_leads_where_text_cannot(spark, tmp_path):
    # the default head cannot tell these strips from Latin; only the hint finds the head
    got = blocks_of(spark, tmp_path, engine(unknown=0.9, taml=0.9), ("a", "word", "taml"), ("b", "word", None))
    assert [x[4:] for x in got] == [("taml", "தword"), ("unknown", "word")]


def test_thresholds_follow_the_text_of_the_default_head(spark, tmp_path):
    rows = ("a", "слово\nword", None)
    assert [x[5] for x in blocks_of(spark, tmp_path, engine(unknown=0.5), rows, thresholds={"latn": 0.6})] == ["слово"]
    assert blocks_of(spark, tmp_path, ocr.Engine(Strips, lambda h: Fixed("", 0.1), fingerprint="low"), rows) == []


def test_numbers_across_pages(spark, tmp_path):
    text = "\n".join(f"w{k}" for k in range(25)) + "\n" * 12 + "end"
    got = blocks_of(spark, tmp_path, engine(unknown=1.0), ("a" * 20, text, None))
    assert [x[2] for x in got] == list(range(26)) and [x[5] for x in got] == [f"w{k}" for k in range(25)] + ["end"]
    assert got[10][3] == f"{'a' * 12}:2:00000" and got[-1][1] == 4


def test_pages_are_read_once(spark, tmp_path):
    pages = ocr.render_pages(files(spark, ("a", "one\ntwo", None), ("b", "", None), ("c", "one\ntwo", None)), PrintedPages()).withColumn("page_hash", ocr.page_hash())
    cache = ocr.LineCache(f"file://{tmp_path}/lines", engine(unknown=1.0))
    first = cache.get_or_compute(pages)
    # equal pages share their lines; a blank page is remembered
    assert first.count() == 3 and first.where("bbox IS NULL").count() == 1
    again = ocr.LineCache(f"file://{tmp_path}/lines", ocr.Engine(Broken, lambda h: Fixed("", 1.0), fingerprint="fixed"))
    assert again.path == cache.path and again.get_or_compute(pages).count() == 3
    assert ocr.line_blocks(pages, first).count() == 4
    # another hint is another reading
    assert pages.withColumn("script_hint", F.lit("taml")).select(ocr.page_hash()).intersect(pages.select("page_hash")).isEmpty()


def test_no_pages(spark, tmp_path):
    assert blocks_of(spark, tmp_path, PRINTED, ("a", "", None)) == []
    assert ocr.read_documents(files(spark, ("a", "x", None)).limit(0), PrintedPages(), PRINTED, f"file://{tmp_path}/none").count() == 0


def test_pages_asked_for(spark):
    rows = files(spark, ("a", "x\n" * 15, None))
    assert [r.page for r in ocr.render_pages(rows, PrintedPages(), pages=[2]).collect()] == [2]
    with pytest.raises(Exception, match="no page 3 of 2"):
        ocr.render_pages(rows, PrintedPages(), pages=[3]).collect()
    with pytest.raises(ValueError):
        ocr.Engine(Strips, Bytes, ("latn", "taml"))


def test_colour_pages_and_counts_from_one(spark):
    grey = PrintedPages().render(b"word", 1, 200)
    rgba = np.dstack([grey] * 4)
    rows = [("a", 1, *rgba.shape, rgba.tobytes(), None)]
    pages = spark.createDataFrame(rows, ocr.PAGE).withColumn("page_hash", ocr.page_hash())
    lines = ocr.read_lines(pages, PRINTED)
    assert [r.text for r in lines.collect()] == ["word"]
    with pytest.raises(Exception, match="count from 1"):
        ocr.line_blocks(pages.withColumn("page", F.lit(0)), lines).collect()


def test_device_runs(spark):
    cfg = Config(models=ModelsConfig(embedder=ModelSpec("e", "GPU"), reranker=ModelSpec("r", "CPU")))
    assert devices.requested(cfg) == ["GPU", "CPU"]
    assert devices.statuses({"CPU": "x"}, ["GPU", "CPU"]) == {"CPU": True, "GPU": False}

    def fault():
        raise OSError("gone")

    rows = devices.report(spark, cfg, {"CPU": "x"}, None, fault).collect()
    assert [(r.device, r.status, r.ingest_source) for r in rows] == [("CPU", "pending", "failed: OSError: gone"), ("GPU", "unavailable", "failed: OSError: gone")]
    ran = devices.report(spark, cfg, {"CPU": "x"}, lambda d: devices.Sample(1, 2, 3, "AUTO")).where("status = 'measured'").first()
    assert ran.resolved_device == "AUTO" and ran.peak_rss_bytes > 1 << 20
    with pytest.raises(KeyError):
        devices.report(spark, cfg, {"CPU": "x"}, lambda d: {}[d])
    with pytest.raises(ValueError):
        devices.Sample(-1, 0, 0)
    assert devices.timed_generation(lambda d, p: [0.5])("CPU") == devices.Sample(500.0, 0.0, 1, "CPU")


def test_dictionaries(spark, tmp_path):
    at = f"file://{tmp_path}"
    with pytest.raises(ValueError):
        readers.charset_lines(spark, at)
    (tmp_path / "a_dict.txt").write_text("x\ny\n")
    assert readers.charset_lines(spark, at) == ["x", "y"]
    (tmp_path / "config.json").write_text("{nope")
    assert readers.charset_lines(spark, at) == ["x", "y"]
    (tmp_path / "config.json").write_text(json.dumps({"PostProcess": {"character_dict": ["a", 1]}}))
    assert imaging.charset(readers.charset_lines(spark, at), 4) == ["", "a", "1", " "]


def test_files_to_one_index(spark, tmp_path):
    words = " ".join(f"word{k}" for k in range(60))
    bodies = {
        # the heading lies below in the file and above on the page; the last item is in a table
        "a": {"items": [[1, 40, words, 9.0], [1, 5, "Title", 14.0], [1, 320, "cell", 9.0]], "image": "not read"},
        "scan": {"items": [], "image": "first line\nsecond line"},
        "thin": {"items": [[1, 5, "x", 9.0]], "image": "thin layer"},
        "locked": {"locked": True},
    }
    home = tmp_path / "in"
    home.mkdir()
    for name, body in bodies.items():
        (home / f"{name}.pdf").write_bytes(b"%PDF-1\n" + json.dumps(body).encode())
    (home / "copy.pdf").write_bytes((home / "a.pdf").read_bytes())
    (home / "zip.pdf").write_bytes(b"PK")
    args = (spark, [f"file://{home}"], f"file://{tmp_path}/index", PrintedFiles())
    path, manifest, told = compose.ingest_files(*args, PrintedFiles(), engine(unknown=1.0))
    assert {r.filename: r.outcome for r in told.collect()} == {"a.pdf": "text", "scan.pdf": "ocr", "thin.pdf": "ocr", "locked.pdf": "ValueError: locked", "zip.pdf": "unsupported"}
    rows = index.load_index(spark, path, seams.HashingEmbedder()).orderBy("row_id").collect()
    assert sorted(r.text.split("\n")[0].split()[0] for r in rows) == ["Title", "first", "thin"]
    [a] = [r for r in rows if r.text.startswith("Title")]
    assert a.heading_path == ["Title"] and a.text.endswith("cell") and "not read" not in a.text
    # nothing changed: the index is reused; without an engine scans are left out, and said to be
    assert compose.ingest_files(*args, PrintedFiles(), engine(unknown=1.0))[0] == path
    other, _, told = compose.ingest_files(*args[:2], f"file://{tmp_path}/plain", PrintedFiles())
    assert {r.filename: r.outcome for r in told.collect()}["scan.pdf"] == "skipped" and index.load_index(spark, other, seams.HashingEmbedder()).count() == 1


def test_scripts_of_single_texts(spark):
    from lexiloom.functions import scripts

    edges = [chr(x) * 3 for ranges in scripts.BUCKETS.values() for a, b in ranges for x in (a, b)]
    mixed = ["", "12 —", "a слово", "ab яю", "國见", "國見见", "漢字かな", "かな한국", "한국어 ab", "தமிழ் abc", "ไทย 한", "é", "�", "\U00020000國", "กab", "日本abc"]
    rows = spark.createDataFrame([(t,) for t in edges + mixed], "t string").select("t", scripts.detect(F.col("t")).alias("s")).collect()
    assert [(r.t, scripts.detect_plain(r.t)) for r in rows] == [(r.t, r.s) for r in rows]


def test_no_raster_leaves_its_worker(spark, tmp_path, monkeypatch):
    """Files that share pages, rows of one doc_id, and pages known from before: the same blocks as by rasters."""
    rows = (("a", "one\ntwo\n" * 9 + "end", None), ("a", "other\nlines", "latn"), ("b", "one\ntwo\n" * 9 + "end", None), (None, "x\nслово y", None), ("c", "", None), ("d", "long " * 40 + "\nx", None))
    eng, root = engine(unknown=0.9, cyrl=0.8, latn=0.7), f"file://{tmp_path}/lines"
    pages = ocr.render_pages(files(spark, *rows[:1] + rows[1:3] + rows[4:]), PrintedPages()).withColumn("page_hash", ocr.page_hash())
    want = sorted(ocr.line_blocks(pages, ocr.read_lines(pages.dropDuplicates(["page_hash"]), eng)).collect(), key=str)
    with monkeypatch.context() as m:
        m.setattr(ocr, "render_pages", None)
        given = files(spark, *[r for r in rows if r[0]])
        assert sorted(ocr.read_documents(given, PrintedPages(), eng, root).collect(), key=str) == want
        n = spark.read.parquet(ocr.LineCache(root, eng).path).count()
        assert n == spark.read.parquet(ocr.LineCache(root, eng).path).select("page_hash").distinct().count()
        # once more, with one file more: only its page is read
        assert ocr.read_documents(files(spark, *rows), PrintedPages(), eng, root).count() == len(want) + 2
        assert spark.read.parquet(ocr.LineCache(root, eng).path).count() == n + 1


def test_long_files_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = (("a", "\n".join(f"w{k}" for k in range(45)), None), ("b", "x", None))
    monkeypatch.setattr(ocr, "PAGES_TOGETHER", 2)
    given = files(spark, *rows)
    marks = ocr.mark_pages(given, PrintedPages())
    got = ocr.read_marked(given, marks, PrintedPages(), engine(unknown=1.0)).select("page_hash", F.spark_partition_id().alias("p")).collect()
    assert len(got) == len({r.page_hash for r in got}) == marks.count() == 6
    assert len({r.p for r in got}) > 1
    assert [x[5] for x in blocks_of(spark, tmp_path, engine(unknown=1.0), *rows) if x[0] == "a"] == [f"w{k}" for k in range(45)]
