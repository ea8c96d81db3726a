"""Readers: PDF files as bytes, labelled questions, baselines, driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import spread

PDF_MAGIC = "%PDF"
PIPELINE_VERSION = "v1"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def pdf_files(spark: SparkSession, *targets: str) -> DataFrame:
    """(doc_id, path, filename, length, status, content) of all *.pdf below the targets.

    doc_id is the content's hash; of equal files the first path stays. status tells blank
    and foreign files apart instead of failing the job; files of no bytes at all are not listed
    by Spark's scan.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(list(targets))
    head = F.regexp_replace(F.decode(F.substring(F.col("content"), 1, 64), "ISO-8859-1"), r"^\s+", "")
    status = F.when(head == "", "corrupt").when(head.startswith(PDF_MAGIC), "ok").otherwise("unsupported")
    rows = files.select(F.sha2("content", 256).alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", status.alias("status"))
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("path", "filename", "length", "status"), "path").alias("f"))
    return first.select("doc_id", "f.*").orderBy("path")


def with_content(files: DataFrame, spark: SparkSession, *targets: str) -> DataFrame:
    """Bytes joined late, for the files that are read on. The list of files is the side that may be broadcast."""
    scan = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(list(targets))
    return scan.select("path", "content").join(files, "path")


def script_hint(path):
    """Script by the name of the folder that a file is in."""
    return F.element_at(F.create_map(F.lit("tamil"), F.lit("taml"), F.lit("english"), F.lit("latn")), F.lower(F.get(F.slice(F.split(path, "/"), -2, 1), F.lit(0))))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from JSON lines, q_id being the line; blank lines and # comments are skipped.

    alt_doc_ids is a list of documents that share gold_pages, or an object of pages each.
    A line that cannot be read, another form of alt_doc_ids, or a file without questions is an error;
    the line is named.
    """
    # a file of questions is read whole, so that its lines have numbers
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "v"))
    lines = lines.select((F.col("pos") + 1).cast("long").alias("q_id"), F.btrim("v").alias("v")).where("v <> '' AND NOT v LIKE '#%'")
    base = "q string, lang string, doc_id string, gold_pages array<int>, note string, alt_doc_ids string"
    rows = lines.select("q_id", "v", F.from_json("v", base, {"mode": "PERMISSIVE"}).alias("r")).select("q_id", "v", "r.*")
    alt = F.btrim("alt_doc_ids")
    listed = F.from_json(alt, "array<string>").isNotNull() & alt.startswith("[")
    mapped = F.from_json(alt, "map<string,array<int>>").isNotNull() & alt.startswith("{")
    odd = F.coalesce(alt.isNotNull() & ~listed & ~mapped, F.lit(False))
    bad = rows.where(F.col("q").isNull() | F.col("doc_id").isNull() | F.col("gold_pages").isNull() | odd).orderBy("q_id").select("q_id", "v").head()
    if bad:
        raise ValueError(f"{path}:{bad.q_id}: cannot read {bad.v[:80]}")
    shared = F.from_json("alt_doc_ids", "array<string>")
    own = F.from_json("alt_doc_ids", "map<string,array<int>>")
    alt = F.when(F.col("alt_doc_ids").startswith("["), F.map_from_entries(F.transform(shared, lambda d: F.struct(d, F.col("gold_pages"))))).when(F.col("alt_doc_ids").startswith("{"), own)
    out = rows.select("q_id", "q", "lang", "doc_id", "gold_pages", F.coalesce("note", F.lit("")).alias("note"), F.coalesce(alt, F.create_map().cast("map<string,array<int>>")).alias("alt_sources"))
    if out.isEmpty():
        raise ValueError(f"{path}: no questions")
    return out


def baseline(spark: SparkSession, path: str) -> dict:
    """The metrics object of a baseline file, or nothing."""
    import json

    from .files import exists, read_text

    return json.loads(read_text(spark, path)).get("metrics", {}) if exists(spark, path) else {}


# Where a recogniser's folder keeps its dictionary, in order of preference.
CHARSET_FILES = ("config.json", "inference.yml", "*dict*.txt")
CHARSET_KEYS = ("PostProcess", "character_dict")


def charset_lines(spark: SparkSession, folder: str) -> list[str]:
    """Dictionary of a CTC recogniser; a settings file that cannot be read or has none is passed over."""
    import json

    from .files import matching, read_text

    for pattern in CHARSET_FILES:
        for path in matching(spark, f"{folder.rstrip('/')}/{pattern}")[:1]:
            text = read_text(spark, path)
            if path.endswith(".txt"):
                found = text.splitlines()
            else:
                try:
                    data = json.loads(text) if path.endswith(".json") else _yaml(text)
                except ValueError:
                    continue
                for key in CHARSET_KEYS:
                    data = (data if isinstance(data, dict) else {}).get(key)
                found = data or []
            if found:
                return [str(c) for c in found]
    raise ValueError(f"{folder}: no dictionary in {', '.join(CHARSET_FILES)}")


def _yaml(text: str):
    """Where a parser is installed; without one the file counts as unreadable."""
    try:
        import yaml
    except ImportError as e:
        raise ValueError("no YAML parser") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def describe(blocks: DataFrame, first_pages: int = 10, least_chars: int = 100) -> DataFrame:
    """(doc_id, n_pages, mean_chars, text_layer) over the first pages of each document; a text layer has more than least_chars a page."""
    early = blocks.where(F.col("page") <= first_pages)
    pages = blocks.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    chars = early.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    mean = F.coalesce("chars", F.lit(0)) / F.least("n_pages", F.lit(first_pages))
    return pages.join(chars, "doc_id", "left").select("doc_id", "n_pages", F.round(mean, 3).alias("mean_chars"), (mean > least_chars).alias("text_layer"))
