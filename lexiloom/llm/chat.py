"""Chat formatting by schema fingerprints.

A record is JSON. The fingerprint of its layout is a hash of its sorted nested field paths
(arrays as []); a declarative mapping registered under that fingerprint says where turns,
roles and texts are. So prompt/response, instruction/input/output and message-list layouts
all become canonical turns (role, text). Fields that only describe a record, such as its id
or source, do not count for the fingerprint. Records with an unknown layout have status
`unknown` and no turns; they stay in every result.

Template. Every turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside roles and
texts, the template's own and those of other common templates, get a backslash after their
first character, and backslashes are doubled, so formatting can be undone exactly. The loss
mask is a list of [start, end) spans of code points: the texts of assistant turns.

Defined cases: null roles and texts are empty; turns are ordered by turn number, then role and
text, nulls first, so that ties have one order; a conversation without turns gives no row;
repeated rows are repeated turns; a null conv_id is one conversation; texts of any length are
formatted whole; an empty table gives an empty result; other columns, whatever their names, are
ignored. A conversation is one string, hence one row of one task; conversations are otherwise
independent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
FORMATTED = "id long, layout string, status string, formatted string, loss array<struct<a:bigint,b:bigint>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string, status string"


@dataclass(frozen=True)
class Mapping:
    """turns: path of a list, with role and text below it; or fixed (role, path...) turns.

    roles renames roles. A fixed turn joins the non-empty texts at its paths by a blank line.
    """

    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


def field_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


#: Top-level fields that describe a record and hold none of its turns.
ASIDE = {"id", "source", "lang", "language", "license", "meta", "metadata", "score", "timestamp", "url"}


def fingerprint(paths: set[str]) -> str:
    kept = sorted(p for p in paths if re.split(r"[.\[]", p, maxsplit=1)[0] not in ASIDE)
    return hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()[:16]


OTHER_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS: dict[str, tuple[set[str], Mapping]] = {
    "messages": ({"messages[].role", "messages[].content"}, Mapping("messages", "role", "content")),
    "conversations": ({"conversations[].from", "conversations[].value"}, Mapping("conversations", "from", "value", roles=OTHER_NAMES)),
    "prompt_response": ({"prompt", "response"}, Mapping(fixed=(("user", ("prompt",)), ("assistant", ("response",))))),
    "prompt_completion": ({"prompt", "completion"}, Mapping(fixed=(("user", ("prompt",)), ("assistant", ("completion",))))),
    "question_answer": ({"question", "answer"}, Mapping(fixed=(("user", ("question",)), ("assistant", ("answer",))))),
    "instruction": ({"instruction", "output"}, Mapping(fixed=(("user", ("instruction",)), ("assistant", ("output",))))),
    "instruction_input": ({"instruction", "input", "output"}, Mapping(fixed=(("user", ("instruction", "input")), ("assistant", ("output",))))),
    "system_prompt_response": ({"system", "prompt", "response"}, Mapping(fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))))),
}
REGISTRY: dict[str, tuple[str, Mapping]] = {fingerprint(paths): (name, m) for name, (paths, m) in LAYOUTS.items()}


def _at(value: object, path: str) -> object:
    for part in path.split(".") if path else ():
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _string(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def canonical(record: object, registry: dict = REGISTRY) -> tuple[str, list[tuple[str, str]] | None]:
    """(layout, turns); turns is None for unknown layouts."""
    name, m = registry.get(fingerprint(field_paths(record)), ("", None))
    if m is None:
        return "", None
    if m.fixed:
        return name, [(role, "\n\n".join(t for t in (_string(_at(record, p)) for p in paths) if t)) for role, paths in m.fixed]
    rename = dict(m.roles)
    turns = _at(record, m.turns)
    return name, [(rename.get(r, r), t) for r, t in ((_string(_at(x, m.role)), _string(_at(x, m.text))) for x in turns)]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda x: x[0][0] + "\\" + x[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, loss spans)"""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
        body = escape(text)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string. Unescaped control strings are the template's only."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        head = _HEAD.match(formatted, at + len(START))
        end = formatted.index(f"{END}\n", head.end())
        out.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(END) + 1
    return out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            b = batch.slice(i, 256)
            layouts, status, texts, losses = [], [], [], []
            for raw in b.column("record").to_pylist():
                try:
                    layout, turns = canonical(json.loads(raw or "null"))
                except ValueError:
                    layout, turns = "", None
                text, loss = format_turns(turns) if turns is not None else (None, None)
                layouts.append(layout)
                status.append("ok" if turns is not None else "unknown")
                texts.append(text)
                losses.append(loss and [{"a": x, "b": y} for x, y in loss])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(layouts), pa.array(status), pa.array(texts, pa.string()), pa.array(losses, kind)], names=["id", "layout", "status", "formatted", "loss"])


def format_records(records: DataFrame) -> DataFrame:
    """records: id long, record string (JSON). See FORMATTED for the result."""
    small_batches(records.sparkSession)
    return records.select(F.col("id").cast("long").alias("id"), "record").mapInArrow(_format, FORMATTED)


def records(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one JSON record a conversation.

    Its layout follows from its roles, as in corpora from several places: one exchange is a
    prompt and a response, with or without a system text; longer talks of user and assistant are
    from/value lists; all others are role/content lists.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.groupBy(F.col("conv_id").cast("long").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("t"))
    t, roles = F.col("t"), F.transform("t", lambda r: r["role"])

    def of(k: int) -> Column:
        return t[k]["text"]

    def same(*names: str) -> Column:
        return roles == F.array(*map(F.lit, names))

    renamed = F.transform(t, lambda r: F.struct(F.when(r["role"] == "user", "human").otherwise("gpt").alias("from"), r["text"].alias("value")))
    messages = F.transform(t, lambda r: F.struct(r["role"], r["text"].alias("content")))
    record = (
        F.when(same("user", "assistant"), F.to_json(F.struct(of(0).alias("prompt"), of(1).alias("response"))))
        .when(same("system", "user", "assistant"), F.to_json(F.struct(of(0).alias("system"), of(1).alias("prompt"), of(2).alias("response"))))
        .when(F.forall(roles, lambda r: r.isin("user", "assistant")), F.to_json(F.struct(renamed.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return rows.select("id", record.alias("record"))


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(i, 256).to_pylist():
                row = dict.fromkeys(names) | {"conv_id": r["id"], "layout": r["layout"], "status": r["status"]}
                if r["status"] == "ok":
                    text = r["formatted"]
                    turns = parse(text)
                    loss = "".join(unescape(text[x["a"] : x["b"]]) for x in r["loss"])
                    row |= {"n_turns": len(turns), "turns_sha256": _hex("".join(f"{a}\n{b}\n" for a, b in turns)), "loss_chars": len(loss), "loss_sha256": _hex(loss), "formatted_chars": len(text)}
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read back from formatted strings; nulls where the layout is unknown."""
    return formatted.mapInArrow(_digest, DIGESTS)


def with_probe(turns: DataFrame) -> DataFrame:
    """turns plus conversation -1, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(extra)
