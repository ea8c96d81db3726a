"""Benchmark decontamination by Wu-Manber search over words.

The alphabet of the search is the benchmark's vocabulary; a document word outside it is one
foreign symbol. All windows (13 consecutive item words; an item of fewer words is one window)
of one length m form a machine: a table over blocks of two words gives how far the search may
shift; blocks with shift 0 lead to a bucket keyed by that suffix, whose windows are told apart
by their first word and then compared in full. A machine needs about n / m steps on clean text.

Benchmark items go to the workers in blocks of at most BLOCK_BYTES of text, so what is shipped
is bounded; a larger benchmark takes one pass over the documents for each block, and hits are
united row by row.

Defined cases: null texts have no words and no hits; items without words have no window; items
with equal ids count once, items without an id are one item of the id ''; windows that overlap
or repeat hit a word once; repeated rows are searched one by one; empty tables give no hits; very
long texts are searched whole; columns named n_words, runs, items, full, n_hit, n_items,
items_sha256 or contaminated are replaced, others stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import small_batches, staged, worker_store

WINDOW = 13
BLOCK_BYTES = 32_000_000
#: A document is contaminated if one word of SHARE or more are hit.
SHARE = 20
FOUND = "n_words long, runs array<struct<a:bigint,b:bigint>>, items array<string>, full boolean"
N_FOUND = 4

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words after A-Z become a-z. Bytes beyond ASCII always belong to words."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Machine:
    """Wu-Manber tables of all windows of length m."""

    def __init__(self, m: int, windows: dict[tuple[int, ...], list[int]], base: int):
        self.m, self.base = m, base
        self.block = min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, list[int], list[int]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, m + 1):
                key = self.key(window, end)
                left = m - end
                if left < self.shift.get(key, self.far):
                    self.shift[key] = left
            self.bucket.setdefault(self.key(window, m), []).append((window[0], list(window), items))

    def key(self, ids, end: int) -> int:
        return ids[end - 2] * self.base + ids[end - 1] if self.block == 2 else ids[end - 1]

    def search(self, ids: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence, in order."""
        m, base, far, shift, bucket, two = self.m, self.base, self.far, self.shift.get, self.bucket, self.block == 2
        end, n = m, len(ids)
        while end <= n:
            key = ids[end - 2] * base + ids[end - 1] if two else ids[end - 1]
            step = shift(key, far)
            if step:
                end += step
                continue
            start = end - m
            for first, window, items in bucket[key]:
                if ids[start] == first and ids[start:end] == window:
                    yield start, items
            end += 1


class Searcher:
    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        seen: dict[str, int] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            if name not in seen:
                seen[name] = len(self.names)
                self.names.append(name)
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1):
                owners = by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), [])
                if seen[name] not in owners:
                    owners.append(seen[name])
        self.machines = [Machine(m, w, len(self.vocabulary) + 1) for m, w in sorted(by_length.items())]
        self.window = window

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str], bool]:
        """(words, hit runs [a, b), ids of items with an occurring window, whether a full-length one occurs)."""
        words = words_of(text)
        ids = [*map(self.vocabulary.get, words, [0] * len(words))]
        spans, items, full = [], set(), False
        for machine in self.machines:
            for start, owners in machine.search(ids):
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + machine.m)
                else:
                    spans.append([start, start + machine.m])
                items.update(owners)
                full |= machine.m == self.window
        return len(words), united(spans), sorted(self.names[i] for i in items), full


def united(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _search(items: list[tuple[str, str]], schema: StructType, place: int, found: int | None) -> Callable:
    """found: index of the columns of an earlier block, or None."""
    key = hashlib.sha256(repr(items).encode()).hexdigest()
    types_ = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("benchmark")
        if getattr(store, "benchmark_key", None) != key:
            store.benchmark, store.benchmark_key = Searcher(items), key
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                b = batch.slice(i, 128)
                got = [store.benchmark.find(t) for t in b.column(place).to_pylist()]
                if found is not None:
                    before = zip(*(b.column(found + k).to_pylist() for k in (1, 2, 3)), strict=True)
                    got = [(n, united([*r, *((x["a"], x["b"]) for x in old)]), sorted({*s, *olds}), f or had) for (n, r, s, f), (old, olds, had) in zip(got, before, strict=True)]
                kept = b.columns[: -N_FOUND if found is not None else None]
                new = [[n for n, *_ in got], [[{"a": a, "b": z} for a, z in r] for _, r, *_ in got], [s for _, _, s, _ in got], [f for *_, f in got]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, types_.field(len(kept) + k).type) for k, x in enumerate(new))], schema=types_)

    return run


def search(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, runs of hit words, the items that occur, and whether a full window does."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop("n_words", "runs", "items", "full")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    schema = StructType([*rows.schema.fields, *spark.createDataFrame([], FOUND).schema.fields])
    place, found = rows.columns.index("text"), None
    for k in range(n_blocks):
        # one block of about block_bytes comes to the driver and goes to the workers
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        block = sorted((r.item_id, r.text) for r in block)
        rows = rows.mapInArrow(_search(block, schema, place, found), schema)
        if n_blocks > 1:
            rows = staged(rows, f"searched_{k}")
        found = len(schema) - N_FOUND
    return rows


def judged(found: DataFrame) -> DataFrame:
    """Rows of search() with n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["b"] - r["a"])
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words")))
    )
