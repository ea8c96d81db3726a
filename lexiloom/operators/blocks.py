"""Text blocks: from documents or page items, classified, normalised and gated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scripts, text

# Thresholds of the classification by typography.
HEADING_MAX_CHARS, HEADING_SIZE, BOLD_SIZE, BOLD_SHARE = 120, 1.15, 1.02, 0.6
CAPTION_SIZE, CAPTION_MIN, CAPTION_MAX, OCR_HEADING_HEIGHT = 0.92, 12, 400, 1.25
CAPTION = r"(?i)^\s*(fig(?:ure)?|table|chart|plate|exhibit)\.?\s*\d"
LIST_ITEM = r"^\s*(?:[-•–⁃▪○·*]|\d{1,2}[.)]|[a-z][.)])\s+"
ROW_BAND_POINTS = 5.0
LINES_PER_PAGE = 10
OCR_LEAST_CONFIDENCE = 0.30
#: White space at the ends of a text. Java tries a run of it once, not from each of its characters.
EDGES = f"^{scripts.SPACE}++|{scripts.SKIP}(?<!{scripts.SPACE}){scripts.SPACE}++$"


def document_blocks(docs: DataFrame) -> DataFrame:
    """Non-blank lines of each document as blocks; ten lines make a page."""
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("reading_order", "text"))
    lines = lines.where(F.col("text").rlike(scripts.NOT_SPACE))
    page = (F.floor(F.col("reading_order") / LINES_PER_PAGE) + 1).cast("int")
    return lines.withColumn("page", page).withColumn("block_id", block_id())


def block_id() -> Column:
    return F.concat(F.substring("doc_id", 1, 12), F.lit(":"), F.col("page"), F.lit(":"), F.lpad(F.col("reading_order").cast("string"), 5, "0"))


def classify(body: Column, size: Column, bold: Column, body_size: Column, in_table: Column) -> Column:
    """Kind of a text-layer block; the first rule that holds decides."""
    ratio, n = size / body_size, F.length(body)
    return (
        F.when(in_table, "table")
        .when((n <= CAPTION_MAX) & (body.rlike(CAPTION) | ((ratio <= CAPTION_SIZE) & (n >= CAPTION_MIN))), "caption")
        .when((n <= HEADING_MAX_CHARS) & ((ratio >= HEADING_SIZE) | ((bold >= BOLD_SHARE) & (ratio >= BOLD_SIZE))), "heading")
        .when(body.rlike(LIST_ITEM), "list")
        .otherwise("paragraph")
    )


def classify_ocr(body: Column, height: Column, median_height: Column) -> Column:
    n = F.length(body)
    return (
        F.when((n <= CAPTION_MAX) & body.rlike(CAPTION), "caption")
        .when((n <= HEADING_MAX_CHARS) & (height / median_height >= OCR_HEADING_HEIGHT), "heading")
        .when(body.rlike(LIST_ITEM), "list")
        .otherwise("paragraph")
    )


def body_size(spans: DataFrame) -> DataFrame:
    """Font size of most characters per document, sizes to a tenth; ties go to the smaller."""
    sizes = spans.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body_size"))


def reading_order(items: DataFrame, height: Column | float | None = None, *ties: str) -> DataFrame:
    """items(doc_id, page, bbox) numbered from 0 by page, row band, x and ties. Bands round half to even."""
    if height is None:
        tall = items.groupBy("doc_id", "page").agg(F.greatest(F.lit(1e-9), 0.6 * F.median(F.col("bbox.y1") - F.col("bbox.y0"))).alias("band"))
        items = items.join(tall, ["doc_id", "page"])
    else:
        items = items.withColumn("band", ROW_BAND_POINTS / (height if isinstance(height, Column) else F.lit(height)))
    place = Window.partitionBy("doc_id").orderBy("page", F.bround(F.col("bbox.y0") / F.col("band")), "bbox.x0", *ties)
    return items.withColumn("reading_order", F.row_number().over(place) - 1).drop("band")


def unit_bbox(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A page box as sorted fractions within 0 to 1; null if nothing is left of it."""

    def clamp(v: Column, span: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / span))

    box = F.struct(clamp(F.least(x0, x1), width).alias("x0"), clamp(F.least(y0, y1), height).alias("y0"), clamp(F.greatest(x0, x1), width).alias("x1"), clamp(F.greatest(y0, y1), height).alias("y1"))
    return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def in_table(bbox: Column, tables: Column) -> Column:
    """Whether any table covers more than half of the box."""

    def covered(t: Column) -> Column:
        w = F.least(bbox["x1"], t["x1"]) - F.greatest(bbox["x0"], t["x0"])
        h = F.least(bbox["y1"], t["y1"]) - F.greatest(bbox["y0"], t["y0"])
        area = (bbox["x1"] - bbox["x0"]) * (bbox["y1"] - bbox["y0"])
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) > 0.5 * area

    return F.exists(tables, covered)


def block_text(lines: Column) -> Column:
    """lines: array of arrays of spans. Spans joined per line, blank lines dropped."""
    joined = F.transform(lines, lambda spans: F.array_join(spans, ""))
    return F.array_join(F.filter(joined, lambda x: F.btrim(x) != ""), "\n")


def typography(spans: Column) -> Column:
    """spans: array<struct<text,size,flags,font>>. Largest size and share of bold characters."""
    total = F.aggregate(spans, F.lit(0), lambda a, s: a + F.length(s["text"]))
    bold = F.aggregate(spans, F.lit(0), lambda a, s: a + F.when((s["flags"].bitwiseAND(16) != 0) | F.lower(s["font"]).contains("bold"), F.length(s["text"])).otherwise(0))
    return F.struct(F.array_max(F.transform(spans, lambda s: s["size"])).alias("size"), F.coalesce(F.try_divide(bold.cast("double"), total.cast("double")), F.lit(0.0)).alias("bold"))


def normalise_blocks(blocks: DataFrame, composed: bool = False) -> DataFrame:
    """Script from the composed text, then the text on one line; empty blocks go."""
    raw = F.col("text") if composed else text.nfc(F.col("text"))
    rows = blocks.withColumn("text", raw).withColumn("script", scripts.detect(F.col("text")))
    # a generator, not a filter: a filter would be pushed down and normalise every text twice
    full = F.filter(F.array(text.normalise(F.col("text"), F.col("script"))), lambda t: t != "")
    return rows.select(*[c for c in rows.columns if c != "text"], F.explode(full).alias("text"))


def with_text_layer(blocks: DataFrame) -> DataFrame:
    """Rows of the documents whose text can be used: text_layer_gate in one grouping, without a join."""
    own = [c for c in blocks.columns if c != "doc_id"]
    docs = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", *[c for c in own if c != "reading_order"]))).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: x["text"]), "")
    trimmed = F.aggregate("b", F.lit(0), lambda n, x: n + F.coalesce(F.length(F.regexp_replace(x["text"], EDGES, "")), F.lit(0)))
    n_pages = F.array_max(F.transform("b", lambda x: x["page"]))
    dense = F.when(n_pages > 0, trimmed / n_pages >= scripts.MIN_CHARS_PER_PAGE)
    kept = docs.where(F.coalesce(dense & scripts.trustworthy(joined), F.lit(False)))
    return kept.select("doc_id", F.explode("b").alias("x")).select(*[F.col("doc_id") if c == "doc_id" else F.col(f"x.{c}") for c in blocks.columns])


def text_layer_gate(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """documents(doc_id, n_pages) with whether their blocks' text can be used."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"])
    joined = blocks.groupBy("doc_id").agg(F.array_join(ordered, "").alias("joined"), F.sum(F.length(F.regexp_replace("text", EDGES, ""))).alias("chars"))
    rows = documents.join(joined, "doc_id", "left")
    dense = (F.col("n_pages") > 0) & (F.coalesce("chars", F.lit(0)) / F.col("n_pages") >= scripts.MIN_CHARS_PER_PAGE)
    return rows.withColumn("has_text_layer", F.coalesce(dense & scripts.trustworthy(F.col("joined")), F.lit(False))).drop("joined", "chars")


def confident(blocks: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """OCR blocks that are not blank and reach their script's confidence."""
    least = F.lit(OCR_LEAST_CONFIDENCE)
    if thresholds:
        least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("script")), least)
    return blocks.where(F.col("text").rlike(scripts.NOT_SPACE) & (F.col("ocr_confidence") >= least))


def first_of_each(docs: DataFrame, key: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """The first row per key by input order, and n_copies: how many rows have the key.

    A minimum, not a window: copies meet before they are shuffled, however many a key has.
    """
    rest = [c for c in docs.columns if c not in (key, order)]
    first = docs.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r"), F.count("*").alias("n_copies"))
    return first.select(key, "r.*", "n_copies")
