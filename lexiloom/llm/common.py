"""What the corpus operators share: staged tables, Python columns, hash orders, workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table as table
from ..sources.staging import discard as discard
from ..sources.staging import fresh_path as fresh_path
from ..sources.staging import shared_dir as shared_dir
from ..sources.staging import staged as staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty. Plain ASCII takes the faster lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def add_columns(df: DataFrame, fields: str, make: Callable[[], Callable[[list], list[list]]], text: str = "text", step: int = 256) -> DataFrame:
    """df with new columns made in Python from the column `text`.

    make() is called once per task and gives a function from a list of texts to one list
    per new column. Columns of df with the name of a new one are replaced. Batches are cut
    into `step` rows, so that memory is bounded by those rows' texts.
    """
    small_batches(df.sparkSession)
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    kept = df.drop(*[n for n in names if n != text])
    probe = df.sparkSession.createDataFrame([], fields).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    types_ = [f.type for f in to_arrow_schema(probe)]
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                b = batch.slice(i, step)
                new = f(b.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, t) for x, t in zip(new, types_, strict=True)]], names=[*b.schema.names, *names])

    from pyspark.sql.types import StructType

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *probe.fields]))


#: Rows of a table with one row a group that may be broadcast; a group of more than HOT rows is hot.
BROADCAST_GROUPS, HOT = 100_000, 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, small: bool = False) -> DataFrame:
    """rows with the columns of their group, for rows whose group is in groups (one row a group).

    Groups of more than HOT rows (by the column weight) are broadcast, the limit raised until at
    most BROADCAST_GROUPS are, and only rows of other groups are dealt by key. With small=True a
    table of at most BROADCAST_GROUPS groups is broadcast as it is.
    """
    if small and groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys)
    hot = HOT
    while (n := groups.where(F.col(weight) > hot).count()) > BROADCAST_GROUPS:
        hot *= 4
    if n == 0:
        return rows.join(groups, keys)
    more = [c for c in groups.columns if c not in keys]
    few = groups.where(F.col(weight) > hot).withColumn("_hot", F.lit(True))
    rest = groups.where(F.col(weight) <= hot).select(*keys, F.lit(-1).alias("_deal"), *[F.col(c).alias(f"_{c}") for c in more], F.lit(True).alias("_cold"))
    # rows that have their group are dealt out by their own hash
    first = rows.join(F.broadcast(few), keys, "left")
    first = first.withColumn("_deal", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int")).otherwise(-1))
    both = first.join(rest, [*keys, "_deal"], "left").where("_hot OR _cold")
    return both.select(*rows.columns, *[F.coalesce(c, f"_{c}").alias(c) for c in more])


def hash_order(*columns) -> Column:
    """A seeded order of rows: 63 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def order_limit(wanted: int, total: int) -> int:
    """A hash_order value that at least `wanted` of `total` rows lie below, and not many more.

    Rows are cut down to it before they are ranked, so no task ranks more than a bounded sample.
    """
    return min(2**63 - 1, int((1.3 * wanted + 200) / max(total, 1) * 2**63))


def worker_store(operator: str) -> types.ModuleType:
    """What a Python worker keeps between tasks of one operator; another operator's things go.

    Every operator with Python steps asks for its store, so that workers do not pile up memory.
    """
    store = sys.modules.setdefault("_lexiloom_worker", types.ModuleType("_lexiloom_worker"))
    if getattr(store, "operator", None) != operator:
        had = len(store.__dict__) > 0
        store.__dict__.clear()
        store.operator = operator
        if had:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
                ctypes.CDLL("libc.so.6").malloc_trim(0)
    return store


#: Texts differ in size by orders of magnitude: Arrow batches are bounded by bytes as well as rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("2000", 2000), "spark.sql.execution.arrow.maxBytesPerBatch": ("4194304", 4194304)}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCHES where they are higher.

    They stay lowered: plans are lazy, and a limit counts when a plan is run.
    """
    for key, (value, most) in BATCHES.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most:
            spark.conf.set(key, value)
