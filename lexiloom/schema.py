"""Table schemas, and invariants as queries for rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = {"string": T.StringType, "long": T.LongType, "bigint": T.LongType, "int": T.IntegerType, "tinyint": T.ByteType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType, "binary": T.BinaryType, "timestamp": T.TimestampType}


def _parts(s: str) -> list[str]:
    """Split at commas outside angle brackets."""
    out, depth = [""], 0
    for c in s:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def type_of(s: str) -> T.DataType:
    name, _, inner = s.strip().partition("<")
    inner = inner[:-1]
    if name == "array":
        return T.ArrayType(type_of(inner))
    if name == "map":
        return T.MapType(*map(type_of, _parts(inner)))
    if name == "struct":
        return T.StructType([T.StructField(k, type_of(v)) for k, _, v in (p.partition(":") for p in _parts(inner))])
    return _NAMES[name]()


def struct(s: str) -> T.StructType:
    """A schema from `name type, ...`; unlike fromDDL it needs no session, so modules may hold schemas."""
    return T.StructType([T.StructField(k, type_of(v)) for k, _, v in (p.partition(" ") for p in _parts(s))])


BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
DOCUMENT = struct("doc_id string, filename string, mime string, n_pages long, has_text_layer boolean, pipeline_version string")
BLOCK = struct(f"block_id string, doc_id string, page int, bbox {BBOX}, kind string, reading_order int, script string, text string, ocr_confidence double")
CHUNK = struct(f"chunk_id string, doc_id string, page_start int, page_end int, block_ids array<string>, bbox_union {BBOX}, heading_path array<string>, text string, token_count int, lang string, script string")
HITS = struct("query_id long, chunk_id string, row_id long, score double, rank int, arm string, gate_score double, degraded int")
ANSWER = struct("trace_id string, text string, citations array<int>, abstained boolean")
TRACE = struct(
    "trace_id string, started_at timestamp, query string, lang string, config_hash string, tier tinyint, abstained boolean, top_score double, n_retrieved int, n_citations int, "
    "prompt_tokens int, completion_tokens int, ttft_ms double, total_ms double, stages array<struct<stage:string,duration_ms:double>>, devices array<struct<model:string,requested:string,device:string>>"
)
GOLD = struct("q_id long, q string, lang string, doc_id string, gold_pages array<int>, note string, alt_sources map<string,array<int>>")

KINDS = ("heading", "paragraph", "table", "caption", "list")
SCRIPTS = ("latn", "cyrl", "arab", "deva", "taml", "thai", "hans", "hant", "jpan", "kore", "unknown")
TIERS = {1: "grounded", 2: "online", 3: "parametric"}


def bbox_ok(name: str) -> Column:
    b = F.col(name)
    inside = [b[c].between(0.0, 1.0) for c in ("x0", "y0", "x1", "y1")]
    return inside[0] & inside[1] & inside[2] & inside[3] & (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])


RULES: dict[str, dict[str, Column | str]] = {
    "document": {"n_pages": "n_pages >= 0", "doc_id": "doc_id <> ''"},
    "block": {
        "page": "page >= 1",
        "reading_order": "reading_order >= 0",
        "kind": f"kind IN {KINDS}",
        "script": f"script IN {SCRIPTS}",
        "ocr_confidence": "ocr_confidence IS NULL OR ocr_confidence BETWEEN 0 AND 1",
    },
    "chunk": {"page_start": "page_start >= 1", "page_end": "page_end >= page_start", "block_ids": "size(block_ids) >= 1", "token_count": "token_count >= 0"},
    "hits": {"rank": "rank >= 1"},
    "answer": {"citations": "NOT abstained OR size(citations) = 0"},
    "trace": {"tier": "tier IN (1, 2, 3)", "total_ms": "total_ms >= 0", "n_citations": "n_citations >= 0", "n_retrieved": "n_retrieved >= 0"},
}


def violations(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """Rows that break a rule, with the names of the rules; null counts as broken."""
    broken = [F.when(~F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return df.withColumn("broken", F.array_compact(F.array(*broken))).where(F.size("broken") > 0)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Only the schema's columns, in its order; other columns are ignored."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
