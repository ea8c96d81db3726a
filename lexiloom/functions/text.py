"""Normalisation, tokens, estimates and presentation of text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scripts import GAP, NOT_SPACE, SKIP, SPACE, count, detect, histogram, language_of, let

# Fixed values
NO_SPACE_SCRIPTS = ("hans", "hant", "jpan", "thai")
HYPHENATING_SCRIPTS = ("latn", "cyrl")
NON_SEGMENTING_SCRIPTS = ("hans", "hant", "han", "jpan", "kana", "kore", "hang", "thai")
EDGE_PUNCTUATION = " \t\n\r.,;:!?()[]{}<>\"'“”‘’«»—–-_/\\|@#$%^&*+=~`…।॥"
HEADING_NUMBER = r"^\s*(\d+(?:[.\-]\d+)*)\s*[.):]?\s+\S"
CHARS_PER_TOKEN = {"taml": 1.10, "deva": 1.10, "thai": 1.10, "han": 1.62, "kana": 1.62, "hang": 1.62, "latn": 2.33, "cyrl": 2.33, "arab": 2.33}
DEFAULT_CHARS_PER_TOKEN, ESTIMATE_SAFETY = 2.33, 1.15
SNIPPET_CHARS = 220
LANGUAGE_NAMES = {"en": "English", "zh": "Chinese", "ta": "Tamil"}
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
#: White space that breaks no line.
BLANK = r"[\x{09}\x{1F}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _udf():
    # made on first use: it needs a running session
    @F.pandas_udf(StringType())
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return nfc


def nfc(text: Column) -> Column:
    """Canonical composition: the one step without a built-in function."""
    return _udf()(text)


def collapse(text: Column) -> Column:
    """Runs of Unicode white space to one space, trimmed."""
    return F.btrim(F.regexp_replace(text, GAP, " "))


def join_lines(text: Column, script: Column) -> Column:
    """Lines stripped, blank ones dropped, the rest joined as their script writes.

    White space around a line break, blank lines with it, is one match: no array of lines is made.
    """
    lines = F.regexp_replace(text, f"{SKIP}(?<!{SPACE}){BLANK}*+(?:{LINE_BREAK}){SPACE}*+", "\n")
    # the first line and the last one have no line break on their outer side
    lines = F.regexp_replace(lines, f"^{SPACE}++|{SKIP}(?<!{SPACE}){SPACE}++$", "")
    bent = lines.rlike("[-‐‑]\n")
    unbroken = F.regexp_replace(F.regexp_replace(lines, r"(?<=\p{L})[-‐‑]\n(?=\p{Ll})", ""), r"(?<=\p{L}[-‐‑])\n(?=\p{L})", "")
    joined = F.when(script.isin(*HYPHENATING_SCRIPTS) & bent, unbroken).otherwise(lines)
    return F.when(script.isin(*NO_SPACE_SCRIPTS), F.translate(joined, "\n", "")).otherwise(F.translate(joined, "\n", " "))


def normalise(composed: Column, script: Column) -> Column:
    """Composed text without soft hyphens and byte order marks, on one line."""
    plain = F.struct(F.regexp_replace(composed, r"[\x{AD}\x{FEFF}]", "").alias("t"), script.alias("s"))
    return let(plain, lambda x: collapse(join_lines(x["t"], x["s"])))


def fold(text: Column) -> Column:
    """Lower case for matching, with sharp s and final sigma folded as well."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters, white space left out; a lone character stays."""
    solid = F.regexp_replace(text, GAP, "")
    n = F.length(solid)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(solid, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(pairs)


def tokens(text: Column, script: Column) -> Column:
    # folded as a whole: compiled code, where functions on array elements are interpreted
    folded = fold(F.coalesce(text, F.lit("")))
    words = F.filter(F.transform(F.split(folded, GAP), lambda t: F.btrim(t, F.lit(EDGE_PUNCTUATION))), lambda t: t != "")
    pairs = bigrams(folded)
    return F.when(script.isin(*NON_SEGMENTING_SCRIPTS), pairs).otherwise(words)


def count_tokens(text: Column, script: Column) -> Column:
    """Characters for scripts without spaces, else words."""
    return F.when(script.isin(*NO_SPACE_SCRIPTS), count(text, NOT_SPACE)).otherwise(count(text, NOT_SPACE + "+")).cast("int")


def heading_level(text: Column) -> Column:
    number = F.regexp_extract(text, HEADING_NUMBER, 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"[.\-]"))).cast("int")


def estimate_tokens(text: Column) -> Column:
    def priced(h: Column) -> Column:
        rest = F.length(text) - sum((h[b] for b in CHARS_PER_TOKEN), F.lit(0))
        return sum((h[b] / F.lit(r) for b, r in CHARS_PER_TOKEN.items()), F.lit(0.0)) + rest / F.lit(DEFAULT_CHARS_PER_TOKEN)

    return F.ceil(F.round(let(histogram(text), priced) * ESTIMATE_SAFETY, 9)).cast("long")


def snippet(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…")))


def short_doc_id(doc_id: Column) -> Column:
    return F.substring(F.regexp_replace(doc_id, "^sha256:", ""), 1, 8)


def provenance(name: Column, doc_id: Column, page_start: Column, page_end: Column, heading_path: Column) -> Column:
    pages = F.when(page_start == page_end, F.concat(F.lit("p."), page_start)).otherwise(F.concat(F.lit("pp."), page_start, F.lit("-"), page_end))
    heading = F.array_join(F.filter(heading_path, lambda h: h != ""), " > ")
    return F.concat(F.coalesce(name, short_doc_id(doc_id)), F.lit(" / "), pages, F.when(heading == "", "").otherwise(F.concat(F.lit(" | "), heading)))


def language_reminder(question: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return let(F.element_at(names, language_of(detect(question))), lambda n: F.when(n.isNull(), "").otherwise(F.concat(F.lit("(Answer in "), n, F.lit(".)"))))
