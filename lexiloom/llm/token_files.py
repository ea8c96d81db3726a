"""Token ids of documents in a frequency-ranked, byte-aligned variable-length format.

Format. Ids are replaced by their rank in the corpus (most frequent first, ties by
id), so that common ids are short. A rank takes one to four bytes, least significant
first. Lengths are kept apart from the bytes: a control byte holds four two-bit codes
(length - 1), the first rank in the lowest bits. A block holds consecutive documents:
doc_ids, ids per document, control bytes, data bytes. Blocks are rows of Parquet files;
a second small table holds the ranks. Decoding looks the lengths of four ranks up by
control byte in a 256-row table and gathers bytes with numpy.

Plan. Documents are encoded where they are read; their ids, as small integers, go to
ranges of doc_id (bounds from quantiles of that column alone), are sorted there, staged,
counted and coded block by block. Global offsets come from per-partition totals, whose
number is that of the partitions.

Tokens come from the tokenizers library. A text is cut as the tokenizer's own
pre-tokenizer cuts it, and equal pieces are encoded once per worker; texts with
characters on which that cut could differ are encoded whole.

Defined cases: a null text is empty and yields the end id alone; documents follow
ascending doc_id, nulls first, ties by the text's hash; repeated rows are all kept; an
empty table writes no block; a text of any length is one document of one block; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, small_batches, staged, worker_store

END_ID = 2
BLOCK_IDS = 1 << 18
CACHE_PIECES = 400_000
IDS_SCHEMA = "doc_id long, part int, pos long, n_tokens long, ids binary"
BLOCK_SCHEMA = "part int, pos long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
RANKS_SCHEMA = "id int, rank int, n long"
OUT_SCHEMA = "doc_id long, part int, pos long, n_tokens long, ids_crc32 long"

ODD_SPACE = re.compile(rb"[\x1c-\x1f]")
WORD = re.compile(rb" [A-Za-z\x80-\xff]+")
# Byte classes of the pre-tokenizer's cut, for texts whose characters beyond ASCII are all letters.
SPACE_CLASS, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE_CLASS
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT


class Limits(NamedTuple):
    """What a worker may hold: pieces of each of two generations, bytes of texts cut together."""

    pieces: int = CACHE_PIECES
    batch_bytes: int = 2_000_000


def cut_points(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that lie one after another in data; texts: where each begins.

    A piece is a run of letters, of digits or of other signs, with one space before it; a run of
    white space, short of the space that goes to the next piece; or an English contraction.
    """
    n = len(data)
    first = np.zeros(n + 3, bool)
    first[texts[texts < n]] = True
    first[n:] = True
    kind = CLASS[data]
    space = kind == SPACE_CLASS
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run & space
    solid = np.flatnonzero(run & ~space)
    after = solid[(solid > 0) & ~first[solid] & space[solid - 1]]
    start[after - 1] = True
    start[solid] = True
    start[after[data[after - 1] == 32]] = False
    if len(mark := np.flatnonzero(start & (data == 39))):
        ahead = np.concatenate((data, np.zeros(3, np.uint8)))
        one, two = ahead[mark + 1], ahead[mark + 2]
        short = ~first[mark + 1] & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ~first[mark + 1] & ~first[mark + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        ends = np.concatenate((mark[short] + 2, mark[long] + 3))
        start[mark[short | long] + 1] = False
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to arrays of ids; pieces seen before come from a bounded cache of two generations.

    A full cache becomes the older generation, from which pieces that come again are taken
    over; the others go when the next one is full.

    The pieces of a batch are cut and told apart by array operations, so that Python sees each
    distinct piece of a batch once. Texts on which the cut could differ are encoded whole.
    """

    def __init__(self, path: str, limits: Limits = Limits()):
        from tokenizers import Tokenizer

        self.limits = limits

        self.tok = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}
        #: One object for each id that is a piece of its own.
        self.single: dict[bytes, bytes] = {}
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.specials = re.compile(b"|".join(re.escape(s.encode()) for s in specials)) if specials else None
        raw = _byte_decoder()
        size = self.tok.get_vocab_size()
        self.width = np.array([len([c for c in (self.tok.id_to_token(i) or "") if c in raw]) for i in range(size)], np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def simple(self, data: bytes) -> bool:
        """Whether cut_points cuts these bytes as the tokenizer would."""
        if ODD_SPACE.search(data) or self.specials and self.specials.search(data):
            return False
        if data.isascii():
            return True
        for c in set(data.translate(None, bytes(range(128))).decode()):
            if c not in self.letters:
                self.letters[c] = unicodedata.category(c)[0] == "L"
            if not self.letters[c]:
                return False
        return True

    def learn(self, new: list[bytes]) -> None:
        """Encode pieces: words in runs, told apart by byte widths; others alone."""
        words, rest = [], []
        for w in new:
            (words if WORD.fullmatch(w) else rest).append(w)
        runs = [words[i : i + 500] for i in range(0, len(words), 500)]
        joined = self.tok.encode_batch_fast([b"".join(some).decode() for some in runs], add_special_tokens=False)
        for some, found in zip(runs, joined, strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w) for w in some])) + 1
            starts = np.concatenate(([0], ends[:-1]))
            raw = ids.tobytes()
            coded = (raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True))
            self.cache.update(zip(some, (self.single.setdefault(x, x) if len(x) == 4 else x for x in coded), strict=True))
        if rest:
            for w, e in zip(rest, self.tok.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, np.uint32).tobytes()

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that are simple and not empty."""
        data = b"".join(texts)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        at = cut_points(np.frombuffer(data, np.uint8), begin)
        offsets = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, bounds, held = pieces.dictionary.buffers()
        bounds, held = np.frombuffer(bounds, np.int32)[: len(pieces.dictionary) + 1].tolist(), held.to_pybytes()
        distinct, which = [held[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pieces.indices.to_numpy()
        if new := [w for w in distinct if w not in self.cache]:
            self.cache.update((w, v) for w in new if (v := self.older.get(w)) is not None)
            self.learn([w for w in new if w not in self.cache])
        coded = list(map(self.cache.__getitem__, distinct))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, first = np.frombuffer(b"".join(coded), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        ids = ids[np.arange(ends[-1]) + np.repeat(first[which] - (ends - n), n)]
        return np.split(ids, (ends - n)[np.searchsorted(at, begin[1:])])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """texts: UTF-8."""
        if len(self.cache) > self.limits.pieces:
            self.cache, self.older = {}, self.cache
        texts = [t or b"" for t in texts]
        alike = [bool(t) and self.simple(t) for t in texts]
        some = [t for t, a in zip(texts, alike, strict=True) if a]
        done = iter(self.together(some) if some else ())
        return [next(done) if a else self.whole(t.decode()) for t, a in zip(texts, alike, strict=True)]


def _byte_decoder() -> set[str]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in keep} | {chr(256 + i) for i in range(256 - len(keep))}


def worker_encoder(path: str, limits: Limits = Limits()) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    store = worker_store("token files")
    if getattr(store, "encoder_key", None) != (path, limits):
        store.encoder, store.encoder_key = Encoder(path, limits), (path, limits)
    return store.encoder


def pack_ids(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def _tokenise(path: str, end_id: int, wide: bool, bounds: np.ndarray, limits: Limits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, limits)
        for batch in batches:
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                # as many rows as batch_bytes hold, one at least
                k = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + limits.batch_bytes)))
                b = batch.slice(i, k - i)
                i = k
                ids = [np.append(x, np.uint32(end_id)) for x in encoder.encode(b.column("text").cast(pa.binary()).to_pylist())]
                part = np.searchsorted(bounds, b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("h"), pa.array(part, pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack_ids(x, wide) for x in ids], pa.binary())],
                    names=["doc_id", "h", "part", "n_tokens", "ids"],
                )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions from 0 along each part; parts come sorted and whole."""
    at: dict[int, int] = {}
    for b in batches:
        part = b.column("part").to_numpy(zero_copy_only=False)
        pos = np.empty(len(part), np.int64)
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            pos[own] = at.get(p, 0) + np.arange(len(own))
            at[p] = at.get(p, 0) + len(own)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(pos), b.column("n_tokens"), b.column("ids")], names=["doc_id", "part", "pos", "n_tokens", "ids"])


def needs_wide(vocabulary: str, end_id: int = END_ID) -> bool:
    """Whether the vocabulary has ids beyond two bytes."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values(), default=0) > 0xFFFF or end_id > 0xFFFF


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = END_ID, wide: bool = False, limits: Limits = Limits()) -> DataFrame:
    """Staged ids of every row, in ascending (part, pos)."""
    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts if n > 1 else [], np.int64))
    coded = rows.mapInArrow(_tokenise(vocabulary, end_id, wide, bounds, limits), "doc_id long, h long, part int, n_tokens long, ids binary")
    ranged = coded.repartitionById(n, "part").sortWithinPartitions("doc_id", "h")
    return staged(ranged.select("doc_id", "part", "n_tokens", "ids").mapInArrow(_number, IDS_SCHEMA), "token_ids")


def _count(wide: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4" if wide else "<u2")
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return run


def ranked_ids(tokens: DataFrame, wide: bool = False) -> list[tuple[int, int, int]]:
    """(id, rank, n) by descending count: one row per id of the vocabulary at most."""
    counts = tokens.select("ids").mapInArrow(_count(wide), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted(counts, key=lambda r: (-r.n, r.id))
    return [(r.id, k, r.n) for k, r in enumerate(order)]


_TWO_BITS = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3


def code_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = extra
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    extra = _TWO_BITS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first = np.cumsum(extra + 1) - extra - 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[first].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(extra >= k)
        out[long] |= raw[first[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _blocks(rank_of: np.ndarray, wide: bool, block_ids: int) -> Callable:
    def block(rows: list[tuple]) -> dict:
        control, data = code_ranks(rank_of[np.concatenate([r[3] for r in rows])])
        return {"part": rows[0][1], "pos": rows[0][2], "doc_ids": [r[0] for r in rows], "n_tokens": [len(r[3]) for r in rows], "control": control, "data": data}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, part, pos, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "pos", "ids")), strict=True):
                if held and (size >= block_ids or (part, pos) != (held[-1][1], held[-1][2] + 1)):
                    yield pa.RecordBatch.from_pylist([block(held)], schema)
                    held, size = [], 0
                held.append((doc_id, part, pos, np.frombuffer(ids, "<u4" if wide else "<u2")))
                size += len(held[-1][3])
        if held:
            yield pa.RecordBatch.from_pylist([block(held)], schema)

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, limits: Limits = Limits()) -> str:
    """Encode docs into path/blocks and path/ranks. Ids move as two bytes where the vocabulary allows it, else as four.

    limits bounds what a worker holds; results do not depend on it.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    wide = needs_wide(vocabulary, end_id)
    tokens = token_ids(docs, vocabulary, end_id, wide, limits)
    ranks = ranked_ids(tokens, wide)
    spark.createDataFrame(ranks, RANKS_SCHEMA).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((r[0] for r in ranks), default=0) + 1, np.uint32)
    for i, k, _ in ranks:
        rank_of[i] = k
    tokens.mapInArrow(_blocks(rank_of, wide, block_ids), BLOCK_SCHEMA).write.parquet(f"{path}/blocks", compression="none")
    return path


def decode_block(b: dict, id_of: np.ndarray) -> list[np.ndarray]:
    """The ids of each document of a block."""
    ids = id_of[decode_ranks(b["control"], b["data"], sum(b["n_tokens"]))]
    return np.split(ids, np.cumsum(b["n_tokens"])[:-1])


def read_ids(spark: SparkSession, path: str) -> np.ndarray:
    """Id of each rank: as many rows as the vocabulary has."""
    rows = spark.read.schema(RANKS_SCHEMA).parquet(f"{path}/ranks").collect()
    out = np.zeros(max(len(rows), 1), np.uint32)
    for r in rows:
        out[r.rank] = r.id
    return out


def _digests(id_of: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                docs = decode_block(b, id_of)
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["doc_ids"], pa.int64()),
                        pa.array([b["part"]] * n, pa.int32()),
                        pa.array(range(b["pos"], b["pos"] + n), pa.int64()),
                        pa.array(b["n_tokens"], pa.int64()),
                        pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in docs], pa.int64()),
                    ],
                    names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"],
                )

    return run


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of every document."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    base, at = [], 0
    for r in sorted(totals, key=lambda r: r.part):
        base.append((r.part, at))
        at += r.n
    rows = blocks.mapInArrow(_digests(read_ids(spark, path)), OUT_SCHEMA)
    before = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    bases = spark.createDataFrame(base, "part int, base long")  # one row per partition written
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, vocabulary: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Write docs as token files into the shared folder and read them back."""
    spark = docs.sparkSession
    return read_digests(spark, write_token_files(docs, fresh_path(spark, "token_files"), vocabulary, limits=limits))
