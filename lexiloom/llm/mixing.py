"""Mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source; its leaves hold documents. A source belongs to the
first of the target's domains whose pattern it matches, else to `other`. A token budget enters
at the root and goes down by weight. A child gets no more than its tokens times the number of
epochs allowed; what it leaves goes to its siblings by their weights, and only what all
children together cannot take stays with the parent's siblings. Each leaf then takes whole
seeded epochs and the token-prefix of one more: its documents in the order of a hash of seed,
epoch and document, as long as their running total stays within the budget.

Budgets are shared out level by level, in windows over one row a child: with children in the
order of capacity over weight, those before some place are full and the others share what is
left by weight. So neither leaves nor documents come to the driver.

Running totals never gather a leaf in one task: the hash order of n documents is cut into
sqrt(n) buckets, bucket totals are summed along the leaf, and single documents are ordered
only in the one bucket where the budget ends.

Defined cases: null sources and languages are leaves of their own, written '?'; null texts
have 0 tokens; a leaf without tokens keeps its rows once; a very long text that would pass the
end of its leaf's budget ends the prefix; equal hashes go by doc_id, and rows equal in doc_id
and text are taken as separate documents in any order; an empty table gives an empty result;
columns named domain, n_tokens or epoch are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_groups, staged

LEVELS = ("domain", "lang", "source")
LEAF = [f"l_{x}" for x in LEVELS]
SEED = 11
#: Pattern of the sources of each domain; a corpus with other sources states its own.
DOMAINS = (("web", "^src[0-4]$"), ("books", "^src[5-9]$"), ("news", "^src1[0-4]$"), ("code", "^src1[5-9]$"))


@dataclass(frozen=True)
class Target:
    """weights[level][name] (default 1); the budget is share of all tokens."""

    share: float = 0.6
    max_epochs: int = 2
    seed: int = SEED
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {"lang": {"en": 3.0}})
    domains: tuple[tuple[str, str], ...] = DOMAINS

    def weight(self, level: str, name: Column) -> Column:
        named = [F.lit(x) for kv in self.weights.get(level, {}).items() for x in kv]
        return F.coalesce(F.element_at(F.create_map(*named), name), F.lit(1.0)) if named else F.lit(1.0)

    def domain_of(self, source: Column) -> Column:
        out = F.lit("other")
        for name, pattern in reversed(self.domains):
            out = F.when(source.rlike(pattern), name).otherwise(out)
        return out


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leaf_rows(docs: DataFrame, target: Target, domain: Callable[[Column], Column] | None = None) -> DataFrame:
    source, lang = F.coalesce(F.col("source").cast("string"), F.lit("?")), F.coalesce(F.col("lang").cast("string"), F.lit("?"))
    rows = docs.drop("domain", "n_tokens", "epoch")
    return rows.withColumns({"l_domain": (domain or target.domain_of)(source), "l_lang": lang, "l_source": source, "n_tokens": n_tokens(F.col("text"))})


def shares(children: DataFrame, parent: list[str]) -> DataFrame:
    """children(*parent, name, cap, weight, budget) with share: their part of the parent's budget.

    Children come in the order of cap / weight. Where one is filled by its share of what those
    before it leave, so are all before it; from the first that is not, all get one rate.
    """
    filling = Window.partitionBy(*parent or [F.lit(0)]).orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")), "name")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.lit(0.0))
    rows = children.withColumn("rate", F.when(F.sum("weight").over(after) > 0, left / F.sum("weight").over(after)).otherwise(0.0))
    rows = rows.withColumn("full", F.col("rate") * F.col("weight") >= F.col("cap"))
    common = F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(common, F.lit(0.0)) * F.col("weight"))).drop("rate", "full")


def plan_leaves(rows: DataFrame, target: Target) -> DataFrame:
    """(leaf, n, full, rest, buckets): whole epochs, tokens of one more, and hash buckets of each leaf."""
    leaves = staged(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "leaves")
    total = leaves.agg(F.least(F.sum("t") * F.lit(target.share), F.sum("t") * F.lit(float(target.max_epochs))).alias("budget"))
    given = None
    for k, level in enumerate(LEVELS):
        parent = LEAF[:k]
        children = leaves.groupBy(*LEAF[: k + 1]).agg((F.sum("t") * target.max_epochs).cast("double").alias("cap")).withColumn("name", F.col(LEAF[k]))
        children = children.withColumn("weight", target.weight(level, F.col("name")))
        budget = children.crossJoin(F.broadcast(total)) if given is None else children.join(given, parent)  # total: one row
        given = staged(shares(budget, parent).select(*LEAF[: k + 1], F.col("share").alias("budget")), f"{level}_budgets")
    whole = leaves.join(given.withColumn("budget", F.floor(F.col("budget") + 1e-6)), LEAF)
    full = F.when(F.col("t") == 0, 1).otherwise(F.least(F.expr("budget div t"), F.lit(target.max_epochs))).cast("int")
    rest = F.when((F.col("t") == 0) | (full >= target.max_epochs), 0).otherwise(F.col("budget") - full * F.col("t")).cast("long")
    return staged(whole.select(*LEAF, "n", full.alias("full"), rest.alias("rest"), F.greatest(F.floor(F.sqrt("n")), F.lit(1)).cast("long").alias("buckets")), "leaf_plan")


def seeded_order(seed: int) -> Column:
    """60 bits of a hash of seed, epoch, doc_id and text."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full").cast("string"), F.col("doc_id").cast("string"), "text"))
    return F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, target: Target = Target(), domain: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with domain, n_tokens and epoch: one row for each time a document is taken."""
    rows = leaf_rows(docs, target, domain)
    rows = join_groups(rows, plan_leaves(rows, target), LEAF, "n", small=True)
    rows = rows.withColumn("m_order", seeded_order(target.seed)).withColumn("m_bucket", F.shiftright(F.shiftright("m_order", 30) * F.least("buckets", F.lit(1 << 31)), 30))
    totals = rows.groupBy(*LEAF, "m_bucket").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"), F.max("n").alias("n"))
    along = Window.partitionBy(*LEAF).orderBy("m_bucket")
    upto = totals.withColumn("upto", F.sum("t").over(along))
    ends = upto.groupBy(*LEAF).agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("m_bucket", (F.col("rest") - F.col("upto") + F.col("t")).alias("room")))).alias("e"))
    ends = staged(ends.select(*LEAF, F.col("n").alias("m_n"), F.col("e.m_bucket").alias("m_end"), F.col("e.room").alias("m_room")), "bucket_ends")
    rows = join_groups(rows, ends, LEAF, "m_n", small=True)
    inside = F.col("m_end").isNotNull() & (F.col("m_bucket") == F.col("m_end")) & (F.col("rest") > 0)
    clear = rows.where(~inside).withColumn("m_more", (F.col("rest") > 0) & (F.col("m_end").isNull() | (F.col("m_bucket") < F.col("m_end"))))
    running = Window.partitionBy(*LEAF).orderBy("m_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    close = rows.where(inside).withColumn("m_more", F.sum("n_tokens").over(running) <= F.col("m_room"))
    taken = clear.unionByName(close).withColumn("m_times", F.col("full") + F.col("m_more").cast("int")).where("m_times > 0")
    taken = taken.withColumn("epoch", F.explode(F.expr("sequence(0, m_times - 1)")))
    return taken.select(*[c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")], F.col("l_domain").alias("domain"), "n_tokens", "epoch")
