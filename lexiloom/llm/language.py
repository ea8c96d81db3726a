"""Language identification with segmentation-marginalised unigrams.

The vocabulary is a fixed public one (piece_bpe_32k.model; its path is a parameter). For
each language every piece has a probability; that of a word is the sum over all its
segmentations into pieces, by the forward algorithm, run for all languages and many words
at once. A text's log-probability is the sum over its words; the best language wins, and
the score is its posterior under equal priors.

Probabilities are learned by expectation-maximisation (forward and backward sums) on the
word counts of at most DOCS_PER_LANG documents per language, those with the smallest hash
of their doc_id. Expected counts are summed in Spark; the driver gets one figure per piece
and language.

Words are runs of letters (Unicode categories L*) of the lower-cased text, with the vocabulary's word mark in front;
stretches of over 48 characters are cut there. Characters without a piece of their own count
as FOREIGN in every language.

Defined cases: null texts, texts without letters, and all texts where nothing could be
learned are `und` with score 0; ties go to the alphabetically first language, with a score of
one over the number of languages that tie; repeated rows are rated one by one; whole texts are
read, however long; columns named lang_pred or score are replaced, others stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import add_columns, hash_order, order_limit, small_batches, staged, worker_store

DOCS_PER_LANG = 1500
EM_ROUNDS = 3
SMOOTH = 0.05
FOREIGN = 1e-9
CHAR_SCALE = 16.0
LONGEST = 48
CACHE_WORDS = 1_000_000
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Word characters that are numbers but no letters, such as fractions and circled digits.
_NUMBERS = frozenset(c for c in map(chr, range(0xA0, 0x110000)) if c.isnumeric() and not c.isalpha())
_BLANKED = dict.fromkeys(map(ord, _NUMBERS), " ")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The text pieces of a vocabulary file, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    found = {sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in found if LETTERS.fullmatch(p.replace(MARK, "", 1)) or p == MARK)


_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


def _grow(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings made longer by one character."""
    h = (h ^ codes) * _M
    return h ^ h >> np.uint64(32)


class Lattice:
    """Piece lookup for every stretch of many words of one length."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        mask = (1 << self.BITS) - 1
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        self.hash = np.zeros(len(pieces), np.uint64)
        self.next = np.full(len(pieces), -1, np.int32)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = np.array([_K])
                for c in p:
                    h = _grow(h, np.array([ord(c)], np.uint64))
                self.hash[i] = h[0]
                at = int(h[0]) & mask
                self.next[i] = self.slot[at]
                self.slot[at] = i
        self.chain = 0
        lengths = Counter(int(h) & mask for h in self.hash.tolist())
        self.chain = max(lengths.values(), default=0)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 if none."""
        at = self.slot[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)]
        out = np.full(len(h), -1, np.int32)
        for _ in range(self.chain):
            live = at >= 0
            if not live.any():
                break
            hit = live & (self.hash[at] == h)
            out[hit] = at[hit]
            at = np.where(live & ~hit, self.next[at], -1)
        return out

    def stretches(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) to piece ids, for words of one length."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)
        out = {}
        with np.errstate(over="ignore"):
            for i in range(n):
                h = np.full(len(words), _K)
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    h = _grow(h, codes[:, j - 1])
                    found = self.find(h)
                    if j == i + 1 or (found >= 0).any():
                        out[i, j] = found
        return out


def _chance(prob: np.ndarray, found: np.ndarray, length: int) -> np.ndarray:
    """Scaled probability per word and language; prob has FOREIGN in its last row but one, 0 in its last."""
    scale = CHAR_SCALE**length
    return prob[np.where(found >= 0, found, -2 if length == 1 else -1)] * scale


def forward(prob: np.ndarray, cells: dict, n: int, rows: int) -> list[np.ndarray]:
    alpha = [np.ones((rows, prob.shape[1]))] + [np.zeros((rows, prob.shape[1])) for _ in range(n)]
    for (i, j), found in sorted(cells.items(), key=lambda c: c[0][1]):
        alpha[j] += alpha[i] * _chance(prob, found, j - i)
    return alpha


def backward(prob: np.ndarray, cells: dict, n: int, rows: int) -> list[np.ndarray]:
    beta = [np.zeros((rows, prob.shape[1])) for _ in range(n)] + [np.ones((rows, prob.shape[1]))]
    for (i, j), found in sorted(cells.items(), key=lambda c: -c[0][0]):
        beta[i] += beta[j] * _chance(prob, found, j - i)
    return beta


def _by_length(words: list[str]) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for g in groups.values():
        for i in range(0, len(g), 8192):
            yield g[i : i + 8192]


def word_log_probs(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), summed over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    for group in _by_length(words):
        some = [words[k] for k in group]
        n = len(some[0])
        alpha = forward(prob, lattice.stretches(some), n, len(some))[n]
        out[group] = np.log(np.maximum(alpha, 1e-300)) - n * np.log(CHAR_SCALE)
    return out


def words_of(text: str | None) -> list[str]:
    """Marked words, in stretches of LONGEST characters at most."""
    out, text = [], (text or "").lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = text.translate(_BLANKED)
    for w in LETTERS.findall(text):
        if len(w) < LONGEST:
            out.append(MARK + w)
        else:
            w = MARK + w
            out += [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return out


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
    for lang, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])


def _expected(path: str, langs: list[str], prob: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = worker_lattice(path)
        total = np.zeros((len(prob), len(langs)))
        for batch in batches:
            words = batch.column("word").to_pylist()
            of = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            times = np.array(batch.column("n").to_pylist(), float)
            for group in _by_length(words):
                some, g = [words[k] for k in group], np.array(group)
                n, rows = len(some[0]), np.arange(len(group))
                cells = lattice.stretches(some)
                alpha, beta = forward(prob, cells, n, len(some)), backward(prob, cells, n, len(some))
                z = np.maximum(alpha[n][rows, of[g]], 1e-300)
                for (i, j), found in cells.items():
                    w = alpha[i][rows, of[g]] * _chance(prob, found, j - i)[rows, of[g]] * beta[j][rows, of[g]] / z * times[g]
                    known = found >= 0
                    np.add.at(total, (found[known], of[g][known]), w[known])
        for k, lang in enumerate(langs):
            seen = np.flatnonzero(total[:, k])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen, k], pa.float64())], names=["lang", "piece", "n"])

    return run


def worker_lattice(path: str) -> Lattice:
    store = worker_store("language")
    if getattr(store, "lattice_path", None) != path:
        store.lattice, store.lattice_path = Lattice(read_pieces(path)), path
    return store.lattice


def _with_tail(p: np.ndarray) -> np.ndarray:
    return np.vstack([p, np.full((1, p.shape[1]), FOREIGN), np.zeros((1, p.shape[1]))])


def train(docs: DataFrame, path: str | None = None, docs_per_lang: int = DOCS_PER_LANG, rounds: int = EM_ROUNDS) -> tuple[str, list[str], np.ndarray]:
    """(vocabulary path, languages, probabilities) from rows that are not held out."""
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()
    ids = docs.where(F.col("lang").isNotNull()).where(~held_out(F.col("doc_id")))
    # the sample is bounded per language; ranks need ids alone, not texts
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().collect()}
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, order_limit(docs_per_lang, n))]) if counts else F.create_map().cast("map<string,bigint>")
    near = ids.select("doc_id", "lang", hash_order("doc_id", F.lit(1)).alias("o")).where(F.col("o") <= F.element_at(limits, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("o", "doc_id")
    some = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang).select("doc_id", "lang").distinct()
    few = len(counts) * docs_per_lang <= 200_000
    rows = ids.select("doc_id", "lang", "text").join(F.broadcast(some) if few else some, ["doc_id", "lang"], "left_semi")
    words = staged(rows.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    size = len(read_pieces(path))
    p = np.full((size, len(langs)), 1 / max(size, 1))
    for _ in range(rounds if langs else 0):
        got = words.mapInArrow(_expected(path, langs, _with_tail(p)), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((size, len(langs)), SMOOTH)
        counts[got.piece.to_numpy(), [langs.index(x) for x in got.lang]] += got.n.to_numpy()
        p = counts / counts.sum(0)
    return path, langs, p


def _identify(path: str, langs: list[str], prob: np.ndarray) -> Callable:
    key = (path, tuple(langs), float(prob.sum()), hash(prob.tobytes()))

    def make() -> Callable:
        store = worker_store("language")
        if getattr(store, "language_key", None) != key:
            store.language_key, store.words, store.logs = key, {}, np.zeros((1 << 16, len(langs)))
        lattice = worker_lattice(path)

        def run(texts: list) -> list[list]:
            split = [words_of(t) for t in texts]
            if len(store.words) > CACHE_WORDS:
                store.words = {}
            words = store.words
            if new := list({w for ws in split for w in ws if w not in words}):
                at = len(words)
                while at + len(new) > len(store.logs):
                    store.logs = np.vstack([store.logs, np.zeros_like(store.logs)])
                store.logs[at : at + len(new)] = word_log_probs(lattice, prob, new)
                words.update(zip(new, range(at, at + len(new)), strict=True))
            pred, score = [], []
            for ws in split:
                if not ws or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = store.logs[np.fromiter(map(words.__getitem__, ws), np.int64, len(ws))].sum(0)
                k = int(np.argmax(total))
                pred.append(langs[k])
                score.append(float(1 / np.exp(total - total[k]).sum()))
            return [pred, score]

        return run

    return make


def identify(docs: DataFrame, model: tuple[str, list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score."""
    path, langs, p = model
    return add_columns(docs, "lang_pred string, score double", _identify(path, langs, _with_tail(p)))
