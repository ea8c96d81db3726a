"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few figures. Cyclic boosting visits the features in turn; each visit
fits a shallow tree (at most three leaves) to the residuals of the logistic loss over the
feature's bins and adds a small step of it to the feature's lookup table. Then the pairs
with the largest gain get two-dimensional tables in the same way. A score is the logistic
of the sum of the looked-up bins: vectorised additions.

The model is fitted on the driver from at most MAX_TRAIN labelled rows, those with the
smallest hash of their doc_id; only their figures come to the driver, not their texts.

Defined cases: null, empty and blank texts have the figures of no words and are scored like
any other; labels that are null or neither 0 nor 1 are not learned from; a doc_id with
several labels counts once per label; with no labels of one kind the score is the share of
label 1 (0.5 without labels). Equal texts have equal scores, so ties and repeated rows need
no rule; a doc_id that several documents have lends its label to each; texts of any length are
read whole; an empty table gives an empty result; columns named score or predicted are
replaced, others stay.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, hash_order, order_limit, worker_store

MAX_TRAIN = 20_000
MAX_BINS = 32
ROUNDS = 60
PAIR_ROUNDS = 20
N_PAIRS = 6
RATE = 0.3
SHRINK = 1.0
THRESHOLD = 0.3

FEATURES = ("log_words", "distinct", "adjacent", "top_share", "word_chars", "long_share", "symbols", "upper", "digits", "stops", "lines", "repeat_lines", "marked", "alone")

_KIND = np.zeros(256, np.uint8)  # 0 other symbols, 1 lower, 2 upper, 3 digit, 4 space, 5 stop marks, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[33, 44, 46, 58, 59, 63]] = 5


def figures(text: str | None) -> list[float]:
    """The features of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)
    seen = Counter(words)
    lines = data.split(b"\n")
    marked = sum(1 for w in seen if not _KIND[w[-1]] in (1, 2, 3, 5, 6))
    alone = sum(k for w, k in seen.items() if len(w) == 1 and _KIND[w[0]] == 0)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)),
        len(seen) / n,
        sum(map(eq, words, words[1:])) / n,
        max(seen.values()) / n,
        float(lengths.mean()),
        float((lengths > 20).mean()),
        kinds[0] / size,
        kinds[2] / size,
        kinds[3] / size,
        kinds[5] / size,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        marked / len(seen),
        alone / n,
    ]


def _figures_of() -> object:
    worker_store("quality")
    return lambda texts: [[figures(t) for t in texts]]


def with_figures(docs: DataFrame) -> DataFrame:
    return add_columns(docs, "figures array<double>", _figures_of)


@dataclass
class Gam:
    """edges[f]: bin borders; tables[f]: value of each bin; pairs: (f, g, table)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total, b = np.full(len(x), self.base), self.bins(x)
        for f, t in enumerate(self.tables):
            total += t[b[f]]
        for f, g, t in self.pairs:
            total += t[b[f], b[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray) -> np.ndarray:
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, MAX_BINS + 1)[1:-1]))
    values = np.unique(x)
    if len(values) <= MAX_BINS:
        cuts = (values[1:] + values[:-1]) / 2
    return cuts


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> tuple[np.ndarray, float]:
    """Values per bin of the best tree of up to `leaves` runs of bins, and its gain."""
    runs, gained = [(0, len(g))], 0.0
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for a, b in runs:
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                all_g, all_h = g[a:b].sum(), h[a:b].sum()
                gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (float(gains[k]), (a, b), a + k + 1)
        if best[1] is None:
            break
        gained += best[0]
        a, b = best[1]
        runs.remove((a, b))
        runs += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out, gained


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a table from one cut of the first feature and one of the second on each side."""
    best, gained = np.zeros_like(g), 0.0
    base = float(_gain(g.sum(), h.sum()))
    for k in range(1, g.shape[0]):
        out, total = np.zeros_like(g), -base
        for s in (slice(0, k), slice(k, None)):
            values, extra = _tree(g[s].sum(0), h[s].sum(0), 2)
            out[s] = values
            total += extra + float(_gain(g[s].sum(), h[s].sum()))
        if total > gained:
            best, gained = out, total
    return best, gained


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Gam(float(np.log(share / (1 - share))))
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))), [_edges(x[:, f]) for f in range(x.shape[1])])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            r, w = slopes()
            step, _ = _tree(np.bincount(b[f], r, len(t)), np.bincount(b[f], w, len(t)))
            t += RATE * step
            total += RATE * step[b[f]]
    # pairs: quarter-size bins, ranked by what they still gain
    def grid(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, w = slopes()
        shape = (len(model.tables[f]), len(model.tables[g]))
        at = b[f] * shape[1] + b[g]
        return at, np.bincount(at, r, shape[0] * shape[1]).reshape(shape), np.bincount(at, w, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_tree2(*grid(f, g)[1:])[1], f, g) for f in range(len(b)) for g in range(f + 1, len(b))), reverse=True)
    model.pairs = [(f, g, np.zeros((len(model.tables[f]), len(model.tables[g])))) for gain, f, g in gains[:N_PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for f, g, t in model.pairs:
            at, r, w = grid(f, g)
            step, _ = _tree2(r, w)
            t += RATE * step
            total += RATE * step.ravel()[at]
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Gam:
    """Fit on at most max_rows labelled rows that are not held out."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    # a bounded sample: the smallest hashes; its broadcast is bounded by max_rows
    order = hash_order("doc_id", F.lit(8))
    some = usable.where(order <= order_limit(max_rows, usable.count())).orderBy(order, "doc_id", "quality").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = with_figures(rows).select("quality", "figures").collect()
    got.sort(key=lambda r: (r.quality, list(r.figures)))
    return fit(np.array([r.figures for r in got], float).reshape(-1, len(FEATURES)), np.array([r.quality for r in got], float))


def _scorer(model: Gam):
    def make():
        worker_store("quality")

        def run(texts: list) -> list[list]:
            score = model.score(np.array([figures(t) for t in texts], float).reshape(-1, len(FEATURES))) if model.edges else np.full(len(texts), 1 / (1 + np.exp(-model.base)))
            return [score.tolist(), (score >= THRESHOLD).astype(np.int32).tolist()]

        return run

    return make


def score_documents(docs: DataFrame, model: Gam) -> DataFrame:
    """docs with score and predicted (1 if score >= 0.3)."""
    return add_columns(docs, "score double, predicted int", _scorer(model))
