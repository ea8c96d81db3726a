"""Script detection and text-layer trust, as column expressions.

A character's script comes from its code point; Chinese, Japanese and Korean share Han, so
kana and hangul counts decide between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of each raw bucket.
BUCKETS: dict[str, tuple[tuple[int, int], ...]] = {
    "latn": ((0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF)),
    "cyrl": ((0x0400, 0x052F),),
    "arab": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "deva": ((0x0900, 0x097F),),
    "taml": ((0x0B80, 0x0BFF),),
    "thai": ((0x0E00, 0x0E7F),),
    "hang": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)),
}
# Characters of one Chinese orthography only.
SIMPLIFIED_ONLY = "国见说会学时这个们为对关后万与书电车东门问长风飞马鸟龙华汉"
TRADITIONAL_ONLY = "國見說會學時這個們為對關後萬與書電車東門問長風飛馬鳥龍華漢"
# Language of each script.
SCRIPT_LANG = {"latn": "en", "cyrl": "ru", "arab": "ar", "deva": "hi", "taml": "ta", "thai": "th", "hans": "zh", "hant": "zh", "jpan": "ja", "kore": "ko", "unknown": "und"}
# Code points typical of text decoded with the wrong 8-bit table.
LEGACY_SUSPECT = ((0x00A0, 0x00FF), (0x0152, 0x0178), (0x02C6, 0x02DC), (0x2018, 0x201D), (0x2020, 0x2026))
# Scripts with a block of their own, in ascending order.
REAL_SCRIPT = (
    (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F),
    (0x0C80, 0x0CFF), (0x0D00, 0x0D7F), (0x0E00, 0x0E7F), (0x1100, 0x11FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF),
)
# Those among them that write words apart.
SPACED_SCRIPT = ((0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF), (0x0D00, 0x0D7F), (0x1100, 0x11FF))
# Thresholds of the text-layer gate.
MIN_CHARS_PER_PAGE, LEGACY_MAX, MIXED_MAX = 50, 0.25, 0.15
#: Unicode white space, in a form that both Java and RE2 read.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: All others, as ranges: printable ASCII first, which Java's matcher then decides at once.
NOT_SPACE = r"[\x{21}-\x{7E}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}]"
#: Before a class that holds neither: passes over ASCII signs and Latin letters without trying its ranges.
SKIP = r"(?![!-~\x{C0}-\x{24F}])"
#: A run of white space, for Java.
GAP = f"{SKIP}{SPACE}++"


def char_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def held(text: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    """Characters within ranges: what is shorter once their runs are gone. One match a run, not one a character."""
    text = F.coalesce(text, F.lit(""))
    skip = "" if ranges == BUCKETS["latn"] else SKIP
    return (F.length(text) - F.length(F.regexp_replace(text, f"{skip}{char_class(ranges)}+", ""))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, however often body names it.

    It also keeps body out of the generated code: methods that outgrow what the JVM compiles run
    ten times slower.
    """
    return F.transform(F.array(value), body)[0]


def histogram(text: Column) -> Column:
    """struct of characters per raw bucket. Plain ASCII holds Latin only."""
    plain = F.octet_length(text) == F.length(text)
    rest = {b: F.when(plain, F.lit(0).cast("long")).otherwise(held(text, r)) for b, r in BUCKETS.items() if b != "latn"}
    return F.struct(held(text, BUCKETS["latn"]).alias("latn"), *[c.alias(b) for b, c in rest.items()])


def detect(text: Column) -> Column:
    """Dominant script; ties go to the code that sorts last; none is `unknown`.

    Most texts have letters of no other script than Latin: one search tells, and nothing is counted.
    """
    other = f"{SKIP}[" + "".join(char_class(r)[1:-1] for b, r in BUCKETS.items() if b != "latn") + "]"

    def of(t: Column) -> Column:
        latin = F.when(t.rlike(char_class(BUCKETS["latn"])), "latn").otherwise("unknown")
        return F.when(t == "", "unknown").when(~t.rlike(other), latin).otherwise(let(histogram(t), lambda h: _most(h, t)))

    return let(F.coalesce(text, F.lit("")), of)


def _most(h: Column, text: Column) -> Column:
    han = h["han"]
    variant = F.when(count(text, f"[{TRADITIONAL_ONLY}]") > count(text, f"[{SIMPLIFIED_ONLY}]"), "hant").otherwise("hans")
    east = (
        F.when(h["kana"] > 0, F.struct((h["kana"] + han).alias("n"), F.lit("jpan").alias("s")))
        .when(h["hang"] > 0, F.struct((h["hang"] + han).alias("n"), F.lit("kore").alias("s")))
        .otherwise(F.struct(han.alias("n"), F.when(han > 0, variant).otherwise("hans").alias("s")))
    )
    # one of them only: beside kana, hangul does not count
    rest = [F.struct(h[b].alias("n"), F.lit(b).alias("s")) for b in ("latn", "cyrl", "arab", "deva", "taml", "thai")]
    best = F.array_max(F.array(*rest, east))
    return F.when(best["n"] > 0, best["s"]).otherwise("unknown")


#: Runs of each raw bucket, for workers.
PLAIN = {b: re.compile(f"[{''.join(f'{re.escape(chr(x))}-{re.escape(chr(y))}' for x, y in ranges)}]+") for b, ranges in BUCKETS.items()}


def detect_plain(text: str | None) -> str:
    """detect() of one text, for workers that have no column."""
    t = text or ""
    if t.isascii():
        return "latn" if PLAIN["latn"].search(t) else "unknown"
    h = {b: sum(map(len, p.findall(t))) for b, p in PLAIN.items()}
    if not any(h.values()):
        return "unknown"
    han = h["han"]
    traditional, simplified = (sum(t.count(c) for c in only) for only in (TRADITIONAL_ONLY, SIMPLIFIED_ONLY)) if han else (0, 0)
    east = (h["kana"] + han, "jpan") if h["kana"] else (h["hang"] + han, "kore") if h["hang"] else (han, "hant" if traditional > simplified else "hans")
    return max(east, *((h[b], b) for b in ("latn", "cyrl", "arab", "deva", "taml", "thai")))[1]


def language_of(script: Column) -> Column:
    pairs = [F.lit(x) for kv in SCRIPT_LANG.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), script), F.lit("und"))


def _without(text: Column, pattern: str) -> Column:
    """Characters that are left: one match a run, not one a character."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def legacy_ratio(text: Column) -> Column:
    """Suspect characters among all but white space; 0 if any real script is present.

    Plain ASCII has none of them.
    """

    def of(t: Column) -> Column:
        suspect = F.length(t) - _without(t, char_class(LEGACY_SUSPECT) + "++")
        ratio = let(_without(t, GAP), lambda solid: F.when(solid == 0, 0.0).otherwise(suspect / solid))
        return F.when((F.octet_length(t) == F.length(t)) | t.rlike(SKIP + char_class(REAL_SCRIPT)), 0.0).otherwise(ratio)

    return let(F.coalesce(text, F.lit("")), of)


def mixed_ratio(text: Column) -> Column:
    """Of the tokens with a spaced-script character, the share with an ASCII letter too."""
    spaced = SKIP + char_class(SPACED_SCRIPT)

    def of(t: Column) -> Column:
        tokens = F.filter(F.split(t, GAP), lambda x: x.rlike(spaced))
        share = let(tokens, lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda y: y.rlike("[A-Za-z]"))) / F.size(x)).otherwise(0.0))
        return F.when(t.rlike(spaced), share).otherwise(0.0)

    return let(F.coalesce(text, F.lit("")), of)


def trustworthy(text: Column, legacy_max: float = LEGACY_MAX, mixed_max: float = MIXED_MAX) -> Column:
    return (mixed_ratio(text) <= mixed_max) & (legacy_ratio(text) <= legacy_max)
