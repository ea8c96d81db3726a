"""Registered queries over page images, and the small engine that reads them.

A printed page has a strip of pixels for each line of text, whose values are the line's bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

from ..functions import scripts
from ..operators import blocks, index, ocr
from ..operators.seams import LetterEmbedder
from ..sources import files
from ..sources.readers import table
from ..sources.staging import fresh_path
from . import compose, sql
from .base import docs_of, query

GAP, TALL, USUAL = 4, 6, 4
#: Fills the end of a strip: no byte of UTF-8.
FILL = 255


class PrintedPages:
    """Renderer of UTF-8 text: ten lines a page, every fifth one taller."""

    def n_pages(self, content: bytes) -> int:
        return -(-(content.count(b"\n") + 1) // blocks.LINES_PER_PAGE)

    def _lines(self, content: bytes) -> list[bytes]:
        """Lines of the content of the last call are kept: a long document is cut once, not once a page."""
        if getattr(self, "_cut", (None,))[0] is not content:
            self._cut = content, content.split(b"\n")
        return self._cut[1]

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray:
        first = (page - 1) * blocks.LINES_PER_PAGE
        strips = []
        for k, line in enumerate(self._lines(content)[first : first + blocks.LINES_PER_PAGE], first):
            if line.strip():
                tall = USUAL if k % 5 else TALL
                wide = -(-len(line) // tall)
                strips.append(np.frombuffer(line.ljust(tall * wide, bytes([FILL])), np.uint8).reshape(tall, wide))
        out = np.zeros((max(1, sum(len(s) + GAP for s in strips)), max([1, *(s.shape[1] for s in strips)])), np.uint8)
        y = 0
        for s in strips:
            out[y : y + s.shape[0], : s.shape[1]] = s
            y += s.shape[0] + GAP
        return out


class PrintedFiles(PrintedPages):
    """Reader and renderer of files that hold, behind a line of magic, JSON with text items and what is printed."""

    def _data(self, content: bytes) -> dict:
        return json.loads(content.split(b"\n", 1)[1])

    def read(self, content: bytes) -> Iterator[tuple]:
        data = self._data(content)
        if data.get("locked"):
            raise ValueError("locked")
        for page, y, text, size in data["items"]:
            yield page, 200.0, 400.0, (10, y, 190, y + 9), text, size, 0.0, [(0, 300, 200, 400)]

    def n_pages(self, content: bytes) -> int:
        return super().n_pages(self._data(content).get("image", "").encode())

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray:
        return super().render(self._data(content).get("image", "").encode(), page, dpi)


class Strips:
    """Detector: runs of pixel rows that are not empty."""

    def detect(self, image: np.ndarray) -> list[tuple[int, int, int, int]]:
        ink = image[..., 0] > 0
        edges = np.flatnonzero(np.diff(np.r_[False, ink.any(1), False].astype(np.int8)))
        return [(0, int(a), int(np.flatnonzero(ink[a:b].any(0)).max()) + 1, int(b)) for a, b in edges.reshape(-1, 2)]


class Bytes:
    """Recogniser: the bytes of a strip. Its confidence comes from their number of characters."""

    def __init__(self, factor: int):
        self.factor = factor

    def recognise(self, crops: list[np.ndarray]) -> list[tuple[str, float]]:
        texts = [c[..., 0].tobytes().rstrip(bytes([FILL])).decode() for c in crops]
        return [(t, len(t) * self.factor % 100 / 100) for t in texts]


PRINTED = ocr.Engine(Strips, lambda head: Bytes(7 if head == "latn" else 1), (ocr.DEFAULT, "latn"), "printed/1")
LEAST = {"latn": 0.45}

_TRIMMED = f"regexp_replace(raw, {sql.quoted(f'^{scripts.SPACE}+|{scripts.SPACE}+$')}, '', 'g')"


@query(
    f"""WITH {sql.BLOCKS}, l AS (SELECT doc_id, page, reading_order AS pos, text AS raw, CASE WHEN reading_order % 5 = 0 THEN {TALL} ELSE {USUAL} END AS tall FROM blocks),
    p AS (SELECT *, {_TRIMMED} AS text, CAST(ceil(strlen(raw) / tall) AS BIGINT) AS wide, sum(tall + {GAP}) OVER w - {GAP} AS y1, sum(tall + {GAP}) OVER a AS height, median(tall) OVER a AS usual, CASE WHEN {sql.detect('raw')} = 'latn' THEN 'latn' ELSE 'unknown' END AS script
        FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos), a AS (PARTITION BY doc_id, page)),
    q AS (SELECT *, max(wide) OVER (PARTITION BY doc_id, page) AS width, length(raw) * CASE script WHEN 'latn' THEN 7 ELSE 1 END % 100 / 100.0 AS ocr_confidence FROM p)
    SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS reading_order,
        doc_id[1:12] || ':' || page || ':' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) - 1 AS VARCHAR), 5, '0') AS block_id,
        CASE WHEN length(text) <= 400 AND regexp_matches(text, '(?i)^\\s*(fig(?:ure)?|table|chart|plate|exhibit)\\.?\\s*\\d') THEN 'caption' WHEN length(text) <= 120 AND tall / usual >= 1.25 THEN 'heading' WHEN regexp_matches(text, '{blocks.LIST_ITEM}') THEN 'list' ELSE 'paragraph' END AS kind,
        script, text, CAST(ocr_confidence AS DOUBLE) AS ocr_confidence, round(wide / width, 6) AS x1, round(CAST(y1 / height AS DOUBLE), 6) AS y1
    FROM q WHERE ocr_confidence >= CASE script WHEN 'latn' THEN 0.45 ELSE 0.30 END"""
)
def ocr_pages(spark, sf):
    """All documents printed on pages, and read by a default head and one for Latin."""
    files = docs_of(spark, sf).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("script_hint"))
    out = ocr.read_documents(files, PrintedPages(), PRINTED, fresh_path(spark, "lines"), thresholds=LEAST)
    return out.select("doc_id", "page", "reading_order", "block_id", "kind", "script", "text", "ocr_confidence", F.round("bbox.x1", 6).alias("x1"), F.round("bbox.y1", 6).alias("y1"))


WHOLE = ocr.Engine(Strips, lambda head: Bytes(3), fingerprint="printed/2")


@query(
    """WITH f AS (SELECT n_nationkey AS k, n_name, n_name || ' is printed in long lines' AS line FROM nation),
    o AS (SELECT *, CASE k % 4 WHEN 0 THEN 'text' WHEN 2 THEN 'ValueError: locked' WHEN 3 THEN 'unsupported' ELSE CASE WHEN length(line) * 3 % 100 >= 30 THEN 'ocr' ELSE 'skipped' END END AS outcome FROM f)
    SELECT k || '.pdf' AS filename, outcome, CASE outcome WHEN 'text' THEN n_name || repeat(' of layers', 40) WHEN 'ocr' THEN line ELSE '' END AS text FROM o"""
)
def ingest_files(spark, sf):
    """A file for each nation, with a text layer, an image only, locked, or of another kind, to one index.

    Some images are read with too little confidence: nothing is left of them.
    """
    home = fresh_path(spark, "files")
    for r in table(spark, sf, "nation", "n_nationkey", "n_name").toLocalIterator():
        body = ({"items": [[1, 5, r.n_name + " of layers" * 40, 9.0]]}, {"items": [], "image": f"{r.n_name} is printed in long lines"}, {"locked": r.n_name}, {"other": r.n_name})[r.n_nationkey % 4]
        files.write_text(spark, f"{home}/{r.n_nationkey}.pdf", ("PK" if r.n_nationkey % 4 == 3 else "%PDF-1") + "\n" + json.dumps(body))
    path, _, told = compose.ingest_files(spark, [home], fresh_path(spark, "index"), PrintedFiles(), PrintedFiles(), WHOLE, embedder=LetterEmbedder())
    rows = index.load_index(spark, path, LetterEmbedder())
    return told.join(rows.select("doc_id", "text"), "doc_id", "left").select("filename", "outcome", F.coalesce("text", F.lit("")).alias("text"))
