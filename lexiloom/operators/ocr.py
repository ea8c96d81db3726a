"""Page images to text blocks: an engine's detector and recognisers run in Arrow functions; order,
thresholds, kinds and numbers are plans.

An engine is made once a task, by a function that executors call, so tasks take the place of
threads and no task shares an engine. Pages are independent rows: a long document is read by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scripts
from ..functions.scripts import let
from ..schema import BBOX, BLOCK, conform, struct
from ..sources.files import exists
from ..sources.staging import staged
from . import blocks
from .imaging import crop, to_rgb

#: The head that reads what no head of a script claims.
DEFAULT = "unknown"
BATCH = 16
#: Crops and lines that are recognised together, and pages that are told at once.
READ_BYTES, READ_LINES, MARKED = 8_000_000, 2_000, 2_000
#: Pages of a file that one task reads.
PAGES_TOGETHER = 256
PAGE = struct("doc_id string, page int, height int, width int, channels int, pixels binary, script_hint string")
#: A page and its lines, boxes in pixels; script is the head that read a line.
READ = struct("page_hash string, height int, width int, lines array<struct<x0: double, y0: double, x1: double, y1: double, height: int, width: int, script: string, text: string, ocr_confidence: double>>")
LINE = struct(f"page_hash string, height int, width int, bbox {BBOX}, script string, text string, ocr_confidence double")


class Renderer(Protocol):
    def n_pages(self, content: bytes) -> int: ...

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray: ...


class Detector(Protocol):
    def detect(self, image: np.ndarray) -> Sequence[tuple[float, float, float, float]]: ...


class Recogniser(Protocol):
    def recognise(self, crops: list[np.ndarray]) -> list[tuple[str, float]]: ...


@dataclass(frozen=True)
class Engine:
    """What is known of an engine before it is loaded: its heads by script, and its fingerprint."""

    detector: Callable[[], Detector]
    recogniser: Callable[[str], Recogniser]
    heads: tuple[str, ...] = (DEFAULT,)
    fingerprint: str = "none"

    def __post_init__(self) -> None:
        if not self.heads or (len(self.heads) > 1 and DEFAULT not in self.heads):
            raise ValueError(f"heads {self.heads} without {DEFAULT!r}")

    @property
    def lead(self) -> str:
        return DEFAULT if DEFAULT in self.heads else self.heads[0]


def render_pages(files: DataFrame, renderer: Renderer, dpi: int = 200, pages: Sequence[int] | None = None) -> DataFrame:
    """files(doc_id, content, script_hint) to PAGE rows, one image in memory at a time.

    pages asks for some pages only; one that a file has not is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for doc_id, content, hint in zip(frame.doc_id, frame.content, frame.script_hint, strict=True):
                n = renderer.n_pages(content)
                if lost := [p for p in pages or () if not 1 <= p <= n]:
                    raise ValueError(f"{doc_id}: no page {lost[0]} of {n}")
                for page in pages or range(1, n + 1):
                    image = np.ascontiguousarray(renderer.render(content, page, dpi))
                    depth = image.shape[2] if image.ndim == 3 else 1
                    yield pd.DataFrame([(doc_id, page, *image.shape[:2], depth, image.tobytes(), hint)], columns=PAGE.fieldNames())

    return files.select("doc_id", "content", "script_hint").mapInPandas(run, PAGE)


def page_hash() -> Column:
    """Of all that a reading depends on beside the engine."""
    about = F.concat_ws("|", "height", "width", "channels", F.coalesce("script_hint", F.lit("")))
    return F.sha2(F.concat(F.col("pixels"), F.encode(about, "UTF-8")), 256)


class _Reading:
    """An engine as one task has it. Pages are read together until their crops fill a bound."""

    def __init__(self, engine: Engine):
        self.engine, self.detector, self.made = engine, engine.detector(), {}

    def recognise(self, crops: list[np.ndarray], heads: list[str]) -> list[tuple[str, float]]:
        """Text and confidence of each crop by its head. Crops of like shape share a batch, so that little of it is padding."""
        out: list = [None] * len(crops)
        ratio = np.array([c.shape[1] / c.shape[0] for c in crops])
        for name in dict.fromkeys(heads):
            own = np.array([k for k, h in enumerate(heads) if h == name])
            own = own[np.argsort(ratio[own], kind="stable")]
            reader = self.made.get(name) or self.made.setdefault(name, self.engine.recogniser(name))
            for i in range(0, len(own), BATCH):
                part = own[i : i + BATCH]
                for k, read in zip(part, reader.recognise([crops[k] for k in part]), strict=True):
                    out[k] = read
        return out

    def read(self, pages: Iterator[tuple[str, str | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """(page_hash, hint, image) to READ rows."""
        known, crops, heads, boxes, size = [], [], [], [], 0
        for mark, hint, raw in pages:
            image = to_rgb(raw)
            head = hint if hint in self.engine.heads else self.engine.lead
            found = self.detector.detect(image)
            known.append((mark, *image.shape[:2], len(found)))
            for box in found:
                # a copy: the page itself is not kept
                crops.append(crop(image, box).copy())
                heads.append(head)
                boxes.append(tuple(map(float, box)))
                size += crops[-1].nbytes
            if size >= READ_BYTES or len(crops) >= READ_LINES or len(known) >= READ_LINES:
                yield self.rows(known, crops, heads, boxes)
                known, crops, heads, boxes, size = [], [], [], [], 0
        if known:
            yield self.rows(known, crops, heads, boxes)

    def rows(self, known: list[tuple], crops: list[np.ndarray], heads: list[str], boxes: list[tuple]) -> pa.RecordBatch:
        done = self.recognise(crops, heads)
        if others := {h for h in self.engine.heads if h != self.engine.lead}:
            scripts_of = [scripts.detect_plain(t) for t, _ in done]
            again = [k for k, s in enumerate(scripts_of) if s in others and s != heads[k]]
            for k, read in zip(again, self.recognise([crops[k] for k in again], [scripts_of[k] for k in again]), strict=True):
                done[k], heads[k] = read, scripts_of[k]
        high, wide = ([v for row in known for v in [row[at]] * row[3]] for at in (1, 2))
        x0, y0, x1, y1 = zip(*boxes, strict=True) if boxes else ((),) * 4
        values = (*((v, pa.float64()) for v in (x0, y0, x1, y1)), (high, pa.int32()), (wide, pa.int32()), (heads, pa.string()), ([t for t, _ in done], pa.string()), ([c for _, c in done], pa.float64()))
        lines = pa.StructArray.from_arrays([pa.array(v, t) for v, t in values], ["x0", "y0", "x1", "y1", "height", "width", "script", "text", "ocr_confidence"])
        ends = pa.array(np.r_[0, np.cumsum([row[3] for row in known])], pa.int32())
        marks, heights, widths, _ = zip(*known, strict=True)
        return pa.record_batch([pa.array(marks, pa.string()), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.ListArray.from_arrays(ends, lines)], READ.fieldNames())


def read_rasters(pages: DataFrame, engine: Engine) -> DataFrame:
    """PAGE rows with page_hash to READ rows, a page each with its lines in pixels.

    The head of a page's hint reads first, else the leading one; a line whose text is of a script
    that has a head of its own is read again by it. Crops stay in the worker that cut them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def images() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    mark, hint, height, width, channels, pixels = (c[i].as_py() for c in batch.columns)
                    yield mark, hint, np.frombuffer(pixels, np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))

        yield from _Reading(engine).read(images())

    return pages.select("page_hash", "script_hint", "height", "width", "channels", "pixels").mapInArrow(run, READ)


def read_lines(pages: DataFrame, engine: Engine) -> DataFrame:
    """PAGE rows with page_hash to LINE rows, in pixels."""
    return flat_lines(read_rasters(pages, engine))


def mark_pages(files: DataFrame, renderer: Renderer, dpi: int = 200) -> DataFrame:
    """files(doc_id, content, script_hint) to (doc_id, key, page, page_hash): rasters are hashed where they are made."""
    schema = struct("doc_id string, key long, page int, page_hash string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                doc_id, content, hint, key = (c[i].as_py() for c in batch.columns)
                for page in range(1, renderer.n_pages(content) + 1):
                    rows.append((doc_id, key, page, _hash(renderer.render(content, page, dpi), hint)))
                    if len(rows) >= MARKED:
                        yield _batch(rows, schema.fieldNames(), types)
                        rows = []
            if rows:
                yield _batch(rows, schema.fieldNames(), types)

    types = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return files.select("doc_id", "content", "script_hint", _key()).mapInArrow(run, schema)


def read_marked(files: DataFrame, marks: DataFrame, renderer: Renderer, engine: Engine, dpi: int = 200) -> DataFrame:
    """READ rows of all pages of marks, each hash once: only contents are shuffled, never rasters.

    A page is rendered again in the worker that reads it, from one of the files that have it. The pages
    of longer files are dealt out to several tasks, with a copy of the file each.
    """
    part = F.floor((F.col("f.page") - 1) / PAGES_TOGETHER)
    of = marks.groupBy("page_hash").agg(F.min(F.struct("doc_id", "key", "page")).alias("f"))
    asked = of.groupBy("f.doc_id", "f.key", part).agg(F.collect_list("f.page").alias("pages"), F.collect_list("page_hash").alias("hashes")).toDF("_doc", "_key", "_part", "pages", "hashes")
    rows = files.withColumn("key", _key()).join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    if not marks.where(F.col("page") > PAGES_TOGETHER).isEmpty():
        rows = rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def images() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    content, hint, pages, hashes = (c[i].as_py() for c in batch.columns)
                    n, wanted = renderer.n_pages(content), set(hashes)
                    for page in sorted(set(pages)):
                        if page <= n:
                            image = renderer.render(content, page, dpi)
                            if (mark := _hash(image, hint)) in wanted:
                                yield mark, hint, np.ascontiguousarray(image)

        yield from _Reading(engine).read(images())

    return rows.select("content", "script_hint", "pages", "hashes").mapInArrow(run, READ)


def _key() -> Column:
    """Tells files of one doc_id apart; pages are told apart by their hashes, so that keys may meet."""
    return F.xxhash64("content", "script_hint").alias("key")


def _hash(image: np.ndarray, hint: str | None) -> str:
    """page_hash() of an image."""
    depth = image.shape[2] if image.ndim == 3 else 1
    mark = hashlib.sha256(np.ascontiguousarray(image).data)
    mark.update("|".join((*map(str, (*image.shape[:2], depth)), hint or "")).encode())
    return mark.hexdigest()


def _batch(rows: list[tuple], names: list[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def flat_lines(read: DataFrame) -> DataFrame:
    """READ rows to LINE rows; a page without lines has one row, without box."""
    rows = read.select("page_hash", "height", "width", F.explode_outer("lines").alias("l"))
    box = F.when(F.col("l").isNotNull(), F.struct("l.x0", "l.y0", "l.x1", "l.y1")).alias("bbox")
    return conform(rows.select("page_hash", "height", "width", box, "l.script", "l.text", "l.ocr_confidence"), LINE)


class LineCache:
    """Lines by the hash of their page, one table for each engine: a page is read once, blank ones too."""

    def __init__(self, root: str, engine: Engine):
        mark = hashlib.sha256("\x1f".join((engine.fingerprint, *sorted(engine.heads))).encode()).hexdigest()[:16]
        self.engine, self.path = engine, f"{root.rstrip('/')}/{mark}"

    def _append(self, pages: DataFrame, read: Callable[[DataFrame], DataFrame]) -> None:
        """Read and append pages that are not there yet."""
        spark, new = pages.sparkSession, pages
        if exists(spark, f"{self.path}/_SUCCESS"):
            seen = spark.read.schema(READ).parquet(self.path).select("page_hash")
            new = pages.join(seen, "page_hash", "left_anti")
        read(new).write.mode("append").option("compression", "zstd").parquet(self.path)

    def _all(self, spark: SparkSession) -> DataFrame:
        # a page that two runs read at once has equal lines
        return spark.read.schema(READ).parquet(self.path).dropDuplicates(["page_hash"])

    def get_or_compute(self, pages: DataFrame) -> DataFrame:
        """LINE rows of all pages that were ever read here. Pages not there yet are read and appended first."""
        self._append(pages, lambda new: read_rasters(new.dropDuplicates(["page_hash"]), self.engine))
        return flat_lines(self._all(pages.sparkSession))

    def read_files(self, files: DataFrame, marks: DataFrame, renderer: Renderer, dpi: int = 200) -> DataFrame:
        """READ rows of all pages that were ever read here, those of marks among them."""
        self._append(marks, lambda new: read_marked(files, new, renderer, self.engine, dpi))
        return self._all(marks.sparkSession)


def line_blocks(pages: DataFrame, lines: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """BLOCK rows of pages(doc_id, page, page_hash) from LINE rows."""
    line = F.struct("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "height", "width", "script", "text", "ocr_confidence")
    return page_blocks(pages, lines.where("bbox IS NOT NULL").groupBy("page_hash").agg(F.collect_list(line).alias("lines")), thresholds)


def page_blocks(pages: DataFrame, read: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """BLOCK rows of pages(doc_id, page, page_hash) from READ rows.

    Bands and heights are measured over all lines found, before the doubtful ones go. block_id counts
    within a page, so that a page keeps its ids whatever is read with it; reading_order within the document.
    A block's script is its head; the leading head has none, so its lines have the threshold of their text.

    A page is one row until its lines are in order; rows are then dealt out by document once, and one
    sort serves both numbers.
    """
    page = F.when(F.col("page") < 1, F.raise_error(F.lit("pages count from 1")).cast("int")).otherwise(F.col("page"))
    rows = pages.select("doc_id", page.alias("page"), "page_hash").join(read.where(F.size("lines") > 0).select("page_hash", "lines"), "page_hash")
    rows = rows.select("doc_id", "page", "lines").repartition("doc_id").groupBy("doc_id", "page").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    tall = F.sort_array(F.transform("lines", lambda l: l["y1"] - l["y0"]))
    rows = rows.withColumn("usual", let(tall, lambda t: 0.5 * F.get(t, F.floor((F.size(t) - 1) / 2).cast("int")) + 0.5 * F.get(t, F.floor(F.size(t) / 2).cast("int"))))
    # rows of text from the top, each from the left, as blocks.reading_order has them
    band = F.greatest(F.lit(1e-9), 0.6 * F.col("usual"))
    placed = F.transform("lines", lambda l: F.struct(F.bround(l["y0"] / F.col("band")).alias("row"), l["x0"], l["y0"], l["text"], l.alias("l")))
    rows = rows.withColumn("band", band).select("doc_id", "page", "usual", F.posexplode(F.sort_array(placed)).alias("place", "x"))
    rows = rows.select("doc_id", "page", "usual", "place", "x.l.*").withColumn("tall", F.col("y1") - F.col("y0"))
    rows = rows.withColumn("text", F.regexp_replace("text", f"^{scripts.SPACE}+|{scripts.SPACE}+$", ""))
    rows = rows.withColumn("head", F.col("script")).withColumn("script", F.when(F.col("head") == DEFAULT, scripts.detect(F.col("text"))).otherwise(F.col("head")))
    rows = blocks.confident(rows, thresholds).withColumn("bbox", blocks.unit_bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("width"), F.col("height"))).where("bbox IS NOT NULL")
    rows = rows.withColumns({"kind": blocks.classify_ocr(F.col("text"), F.col("tall"), F.col("usual")), "script": F.col("head"), "ocr_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ocr_confidence")))})
    rows = rows.withColumn("reading_order", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("place")) - 1).withColumn("block_id", blocks.block_id())
    rows = rows.withColumn("reading_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "place")) - 1)
    return conform(rows, BLOCK)


def read_documents(files: DataFrame, renderer: Renderer, engine: Engine, cache_root: str, dpi: int = 200, thresholds: dict[str, float] | None = None) -> DataFrame:
    """files(doc_id, content, script_hint) to blocks. Pages are rendered twice, to be hashed and, one of equal ones, to be read; lines are stored.

    No raster leaves the worker that made it.
    """
    marks = staged(mark_pages(files, renderer, dpi), "marks")
    return page_blocks(marks, LineCache(cache_root, engine).read_files(files, marks, renderer, dpi), thresholds)
