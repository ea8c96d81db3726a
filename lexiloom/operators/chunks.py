"""Heading-aware chunks.

Packing is a fold along one document's blocks. Only the costs of the blocks and the texts of
headings go through it; what it returns are places of blocks, from which the chunks are put
together in the JVM. Documents are independent and go to tasks by doc_id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions import text as tx
from ..functions.scripts import SCRIPT_LANG
from ..schema import BBOX, CHUNK, struct

_NUMBER = re.compile(tx.HEADING_NUMBER)


@dataclass(frozen=True)
class Piece:
    """A block as packing sees it."""

    id: object
    text: str
    cost: int
    heading: bool = False


@dataclass
class Group:
    pieces: list[Piece] = field(default_factory=list)
    path: tuple[str, ...] = ()
    cost: int = 0

    def add(self, pieces: list[Piece]) -> None:
        """Append pieces that are not there yet."""
        have = {p.id for p in self.pieces}
        for p in pieces:
            if p.id not in have:
                self.pieces.append(p)
                self.cost += p.cost


def level_of(heading: str) -> int:
    m = _NUMBER.match(heading)
    return 1 + len(re.findall(r"[.\-]", m[1])) if m else 1


def sections_of(pieces: list[Piece]) -> list[Group]:
    """Runs that begin at a heading, with the headings above them; bare parents go."""
    found: list[Group] = []
    for p in pieces:
        if p.heading or not found:
            above = found[-1].path if found else ()
            found.append(Group(path=(*above[: level_of(p.text) - 1], p.text) if p.heading else ()))
        found[-1].pieces.append(p)
    nexts = [*(g.path for g in found[1:]), ()]
    inherited = [len(n) > len(g.path) and n[: len(g.path)] == g.path and all(p.heading for p in g.pieces) for g, n in zip(found, nexts, strict=True)]
    return [g for g, gone in zip(found, inherited, strict=True) if not gone]


def tail_of(pieces: list[Piece], budget: int) -> list[Piece]:
    """The longest end of a chunk, short of all of it, within the budget."""
    kept = len(pieces)
    while kept > 1 and pieces[kept - 1].cost <= budget:
        kept -= 1
        budget -= pieces[kept].cost
    return pieces[kept:]


def packed(section: Group, cfg: ChunkConfig) -> list[Group]:
    """Greedy groups of a section; short ones join the group before them."""
    runs = [Group(path=section.path)]
    for p in section.pieces:
        now = runs[-1]
        if now.pieces and now.cost + p.cost > cfg.target_tokens:
            tail = tail_of(now.pieces, cfg.overlap) if cfg.overlap > 0 else []
            now = Group(tail, section.path, sum(x.cost for x in tail))
            runs.append(now)
        now.pieces.append(p)
        now.cost += p.cost
    out: list[Group] = []
    for run in runs:
        if out and run.cost < cfg.min_tokens:
            out[-1].add(run.pieces)
        elif run.pieces:
            out.append(run)
    return out


def chunk_pieces(pieces: list[Piece], cfg: ChunkConfig) -> list[Group]:
    """All chunks of one document. A group that is still short leads the next one."""
    done: list[Group] = []
    short: Group | None = None
    for group in (g for s in sections_of(pieces) for g in packed(s, cfg)):
        if short:
            first = short.path
            short.add(group.pieces)
            # a group that is long enough has the path of its last part; what is left, of its first
            group = Group(short.pieces, group.path if short.cost >= cfg.min_tokens else first, short.cost)
        short = None if group.cost >= cfg.min_tokens else group
        if short is None:
            done.append(group)
    return done + ([short] if short else [])


def fold(costs: Column, headings: Column, cfg: ChunkConfig) -> Column:
    """struct(items, paths): places of the blocks of each chunk, and its heading path.

    headings has the text of blocks that are headings and null for others.
    """

    @F.pandas_udf(struct("items array<array<int>>, paths array<array<string>>"))
    def run(costs: pd.Series, headings: pd.Series) -> pd.DataFrame:
        rows = []
        for cost, texts in zip(costs, headings, strict=True):
            groups = chunk_pieces([Piece(k, t or "", int(c), t is not None) for k, (c, t) in enumerate(zip(cost, texts, strict=True))], cfg)
            rows.append(([[p.id for p in g.pieces] for g in groups], [list(g.path) for g in groups]))
        return pd.DataFrame(rows, columns=["items", "paths"])

    return run(costs, headings)


def main_script(own: Column) -> Column:
    """Script of most tokens, unknown ones left out; ties go to the code that sorts last."""
    known = F.filter(own, lambda b: b["script"] != "unknown")

    def weight(s: Column) -> Column:
        return F.aggregate(known, F.lit(0), lambda n, b: n + F.when(b["script"] == s, b["cost"]).otherwise(0))

    best = F.array_max(F.transform(F.array_distinct(F.transform(known, lambda b: b["script"])), lambda s: F.struct(weight(s).alias("n"), s.alias("s"))))
    return F.coalesce(best["s"], F.lit("unknown"))


def _row(own: Column, path: Column) -> Column:
    """A chunk from its blocks."""
    boxes = F.filter(F.transform(own, lambda b: b["bbox"]), lambda x: x.isNotNull())

    def side(c: str) -> Column:
        return F.transform(boxes, lambda x: x[c])

    union = F.struct(*[(F.array_min if c[1] == "0" else F.array_max)(side(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    pages = F.transform(own, lambda b: b["page"])
    return F.struct(
        F.array_min(pages).alias("page_start"),
        F.array_max(pages).alias("page_end"),
        F.transform(own, lambda b: b["block_id"]).alias("block_ids"),
        F.when(F.size(boxes) > 0, union).alias("bbox_union"),
        path.alias("heading_path"),
        F.array_join(F.transform(own, lambda b: b["text"]), "\n\n").alias("text"),
        F.aggregate(own, F.lit(0), lambda n, b: n + b["cost"]).alias("token_count"),
        main_script(own).alias("script"),
    )


def gathered_chunks(blocks: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """Chunks without ids. blocks needs a column cost."""
    block = F.struct("reading_order", "page", "block_id", "kind", "cost", "script", "text", "bbox")
    docs = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    docs = docs.withColumn("f", fold(F.transform("b", lambda x: x["cost"]), F.transform("b", lambda x: F.when(x["kind"] == "heading", x["text"])), cfg))
    made = F.transform(F.arrays_zip("f.items", "f.paths"), lambda z: _row(F.transform(z["items"], lambda i: F.get(F.col("b"), i)), z["paths"]))
    return docs.select("doc_id", F.posexplode(made).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.*")


def chunk_id(doc_id, block_ids):
    return F.substring(F.sha2(F.concat(doc_id, F.lit("|"), F.array_join(block_ids, ",")), 256), 1, 32)


def build_chunks(blocks: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunk rows of normalised blocks, in CHUNK's columns plus chunk_no."""
    rows = blocks.withColumn("cost", tx.count_tokens(F.col("text"), F.col("script")))
    if "bbox" not in rows.columns:
        rows = rows.withColumn("bbox", F.lit(None).cast(BBOX))
    made = gathered_chunks(rows, cfg)
    lang = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCRIPT_LANG.items() for x in kv]), F.col("script")), F.lit("und"))
    made = made.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("block_ids"))).withColumn("lang", lang)
    return made.select(*CHUNK.fieldNames(), "chunk_no")
