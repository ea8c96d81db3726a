"""Near-duplicate groups by b-bit MinHash.

1. Rows with equal sets of 2-word shingles form a class (exact, by a 128-bit digest of
   the sorted set); the smallest doc_id stands for it from here on.
2. Each class gets N_BANDS x BAND_ROWS minima. Band keys hash BAND_ROWS full minima; of
   each minimum the low B_BITS bits are kept, packed into one signature.
3. Within a band bucket every member is paired with the bucket's smallest id. Pairs
   whose collision-corrected similarity, estimated from the bit counts, is not hopeless
   are confirmed on full shingle sets. The links give components.
4. A bucket whose members all lie in one component is done. In the others, the documents
   outside the bucket's largest component are estimated against all of other components,
   block by block; the largest component is never held against itself. A document with a
   hopeful partner is confirmed on full sets against the block of that partner's component;
   the first link found is enough, for the block is connected already. So no candidate is
   dropped, no bucket or component is ever one task, and a large group of near copies
   yields rows in proportion to its members, not to their square.

Joins by band take hot bands from a short list, whose length is checked before it is
broadcast; only the others are dealt by band.

At a similarity of 0.8, a pair shares no band with probability (1 - 0.8^6)^40 = 5e-6, and
the estimate (240 samples of 4 bits, deviation 0.03) lies below 0.65 with about 1e-6. Full
sets are those of 64-bit hashes of the shingles: two different shingles of a pair of
documents are taken for one with less than 1e-13 for documents of 1000 words.

Defined cases: null, empty or blank texts have an empty set, are linked with nothing and
kept; one word is its own single shingle; rows with equal doc_id are one document only if
their sets are equal, otherwise their links are joined; a row without doc_id is in no group:
its component is null and it is kept; very long texts are read whole, their minima in slices;
empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, small_batches, staged, worker_store

BAND_ROWS = 6
N_BANDS = 40
B_BITS = 4
SIMILARITY = 80  # per cent
HOPELESS = 0.65
BLOCK = 128
#: Documents of a block of a bucket's largest component.
MAIN_BLOCK = 512
SEED = 20_240_601

#: Ids whose set may be picked out by a broadcast (8 bytes each); more are picked out by a join.
BROADCAST_IDS = 500_000

SIGN_SCHEMA = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"
FULL_SCHEMA = "id long, set_key binary, shingles binary"


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of 2-word shingles; of the only word if one."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) > 1:
        with np.errstate(over="ignore"):
            a = h[:-1] * np.uint64(0x9E3779B97F4A7C15)
            a ^= a >> np.uint64(29)
            a += h[1:]
            a *= np.uint64(0xBF58476D1CE4E5B9)
            a ^= a >> np.uint64(32)
        h = a
    return np.unique(h)


def parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = N_BANDS * BAND_ROWS
    return rng.integers(0, 2**32, n, np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation, in slices of bounded size."""
    x = ((hashes ^ hashes >> np.uint64(31)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            y = a[:, None] * x[None, i : i + 1024]
            y += b[:, None]
            np.minimum(best, y.min(1), out=best)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        return x ^ x >> np.uint32(16)


def pack_signature(best: np.ndarray) -> bytes:
    """The low B_BITS (4) bits of each (mixed) minimum, two to a byte."""
    low = (_mix(best) & np.uint32((1 << B_BITS) - 1)).astype(np.uint8)
    return (low[0::2] | low[1::2] << np.uint8(4)).tobytes()


def band_keys(best: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(N_BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in best.reshape(N_BANDS, BAND_ROWS).T.astype(np.uint64):
            key = (key ^ column) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_store("near dup")
    a, b = parameters()
    known: dict[bytes, tuple[bytes, np.ndarray]] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            sizes, keys, signatures, bands = [], [], [], []
            for text in rows.column("text").to_pylist():
                hashes = shingle_hashes(text)
                key = set_key(hashes)
                if key not in known:
                    if len(known) > 5_000:
                        known.clear()
                    best = minima(hashes, a, b)
                    known[key] = pack_signature(best), band_keys(best)
                sizes.append(len(hashes))
                keys.append(key)
                signatures.append(known[key][0])
                bands.append(known[key][1])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "signature", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            sets = [shingle_hashes(t) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(map(set_key, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["id", "set_key", "shingles"],
            )


_ONES = np.uint64(0x1111111111111111)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis: 64-bit words), corrected for chance collisions.

    Differing groups of B_BITS bits are folded onto one bit each and counted.
    """
    diff = x ^ y
    diff |= diff >> np.uint64(1)
    diff |= diff >> np.uint64(2)
    diff &= _ONES
    same = 1 - np.bitwise_count(diff).sum(-1, dtype=np.int64) / (N_BANDS * BAND_ROWS)
    chance = 1 / (1 << B_BITS)
    return (same - chance) / (1 - chance)


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.filter(pa.array(estimate(x, y) >= HOPELESS)).select(["u", "v"])


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = min(len(p), len(q)), max(len(p), len(q))
    if 100 * small < SIMILARITY * large:
        return False
    both = np.concatenate((p, q))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= SIMILARITY * (len(p) + len(q) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
        keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def _sides(lists: pa.ListArray) -> list[dict[str, np.ndarray]]:
    """Member columns of each list as arrays."""
    ends, members = lists.offsets.to_numpy(), lists.values
    signatures = members.field("signature")
    packed = np.frombuffer(b"".join(signatures.to_pylist()), np.uint64).reshape(len(members), -1)
    columns = {c: members.field(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "size", "part")}
    columns["bands"] = members.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(members), -1)
    return [{c: v[a:b] for c, v in columns.items()} | {"signature": packed[a:b]} for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Between two blocks of one bucket: (id, component block) with a hopeful pair across components.

    The document of the smaller component is held against the other's block. A pair counts in
    the first band that it shares.
    """
    seen: set[tuple[int, int, int]] = set()
    for batch in batches:
        for no, x, y in zip(batch.column("no").to_pylist(), _sides(batch.column("l")), _sides(batch.column("r")), strict=True):
            # in slices: the work space of an estimate is bounded
            hit = np.concatenate([estimate(x["signature"][i : i + 16, None], y["signature"][None]) >= HOPELESS for i in range(0, len(x["id"]), 16)])
            hit &= x["comp"][:, None] != y["comp"][None, :]
            k, j = np.nonzero(hit)
            if no and len(k):
                hit[k, j] = ~(x["bands"][k, :no] == y["bands"][j, :no]).any(1)
            if not hit.any():
                continue
            smaller = (x["size"][:, None] < y["size"]) | ((x["size"][:, None] == y["size"]) & (x["comp"][:, None] < y["comp"]))
            found = set()
            for cells, small, large in ((hit & smaller, x, y), ((hit & ~smaller).T, y, x)):
                names, group = np.unique(np.stack([large["comp"], large["part"]], 1), axis=0, return_inverse=True)
                k, j = np.nonzero(cells)
                for at in np.unique(k * len(names) + group.ravel()[j]).tolist():
                    comp, part = names[at % len(names)].tolist()
                    found.add((int(small["id"][at // len(names)]), comp, part))
            if len(seen) > 500_000:
                seen.clear()
            if found := found - seen:
                seen |= found
                ids, comps, parts = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(comps, pa.int64()), pa.array(parts, pa.int64())], names=["id", "comp", "part"])


def _against_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One confirmed link, if there is any, of each document with a block of another component.

    One is enough: the block's documents are connected already.
    """
    for batch in batches:
        us, vs = [], []
        for r in batch.to_pylist():
            block = r["block"]
            y = np.frombuffer(b"".join(m["signature"] for m in block), np.uint64).reshape(len(block), -1)
            sets = [np.frombuffer(m["shingles"], np.uint64) for m in block]
            for m in r["docs"]:
                guess = estimate(y, np.frombuffer(m["signature"], np.uint64))
                own = np.frombuffer(m["shingles"], np.uint64)
                for j in np.argsort(-guess, kind="stable").tolist():
                    if guess[j] < HOPELESS:
                        break
                    if similar(own, sets[j]):
                        us.append(m["id"])
                        vs.append(block[j]["id"])
                        break
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def full_sets(ids: DataFrame, rows: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(id, signature, shingles) of the classes in ids, made anew from the texts."""
    small = ids.count() <= BROADCAST_IDS
    picked = ids.withColumnRenamed("id", "doc_id")
    texts = rows.join(F.broadcast(picked) if small else picked, "doc_id", "left_semi")
    sets = texts.mapInArrow(_full_sets, FULL_SCHEMA).join(classes.join(ids, "id", "left_semi"), ["id", "set_key"])
    return staged(sets.groupBy("id").agg(F.first("signature").alias("signature"), F.first("shingles").alias("shingles")), f"{name}_sets")


def confirm(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes that hold on full sets. Hot ids are split by AQE's skew joins."""
    pairs = staged(pairs, "star_pairs")
    ids = staged(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "star_ids")
    sets = full_sets(ids, rows, classes, "star")
    x = sets.select(F.col("id").alias("u"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("v"), F.col("shingles").alias("y"))
    return staged(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_confirmed, "u long, v long"), "star_links")


def links_across(in_bucket: DataFrame, comp: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between components that share a bucket and that the stars did not join."""
    sizes = comp.groupBy("comp").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).alias("part")
    placed = staged(comp.join(sizes, "comp").select("id", "comp", "size", part), "placed")

    def own(df: DataFrame) -> DataFrame:
        alone = {"comp": F.coalesce("comp", "id"), "size": F.coalesce("size", F.lit(1)), "part": F.coalesce("part", F.lit(0))}
        return df.join(placed, "id", "left").withColumns(alone)

    wide = own(in_bucket.where("n > 2"))
    shares = wide.groupBy("band", "comp").agg(F.count("*").alias("m"))
    split = shares.groupBy("band").agg(F.count("*").alias("comps"), F.sum("m").alias("n_all"), F.max(F.struct("m", "comp")).alias("top")).where("comps > 1")
    split = split.select("band", "n_all", F.col("top.comp").alias("main"), F.col("top.m").alias("n_main"))
    open_rows = join_groups(wide.drop("n"), staged(split, "split"), ["band"], "n_all").where("id <> least").join(classes.select("id", "signature", "bands"), "id")
    # a bucket's largest component in blocks -1, -2, ..., the others in blocks 0, 1, ...
    k_main, k_rest = F.ceil(F.col("n_main") / MAIN_BLOCK).cast("int"), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int")
    block = F.when(F.col("comp") == F.col("main"), -1 - F.pmod(F.xxhash64("id"), k_main)).otherwise(F.pmod(F.xxhash64("id"), k_rest)).cast("int")
    member = F.struct("id", "comp", "size", "part", "signature", "bands")
    blocks = open_rows.withColumns({"block": block, "k_main": k_main, "k_rest": k_rest})
    blocks = blocks.groupBy("band", "block").agg(F.max("k_main").alias("k_main"), F.max("k_rest").alias("k_rest"), F.first("no").alias("no"), F.collect_list(member).alias("m"))
    blocks = staged(blocks, "blocks")
    right = blocks.select("band", F.col("block").alias("other"), F.col("m").alias("r"))
    others = F.expr("concat(sequence(-k_main, -1), sequence(block, k_rest - 1))")
    left = blocks.where("block >= 0").select("band", F.explode(others).alias("other"), "no", F.col("m").alias("l"))
    tries = staged(left.join(right, ["band", "other"]).select("no", "l", "r").mapInArrow(_across, "id long, comp long, part long").distinct(), "tries")
    if tries.isEmpty():
        return tries.select(F.col("id").alias("u"), F.col("comp").alias("v"))
    # the documents of the blocks to be tried: of components, and single ones
    parts = tries.select("comp", "part").distinct()
    held = placed.join(parts, ["comp", "part"]).select("id", "comp", "part").unionByName(parts.join(placed.select("comp").distinct(), "comp", "left_anti").select(F.col("comp").alias("id"), "comp", "part"))
    held = staged(held, "held")
    ids = staged(tries.select("id").unionByName(held.select("id")).distinct(), "cross_ids")
    sets = full_sets(ids, rows, classes, "cross")
    member = F.struct("id", "signature", "shingles")
    block = held.join(sets, "id").groupBy("comp", "part").agg(F.collect_list(member).alias("block"))
    count = tries.groupBy("comp", "part").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    docs = tries.join(count, ["comp", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    docs = docs.join(sets, "id").groupBy("comp", "part", "chunk").agg(F.collect_list(member).alias("docs"))
    found = docs.join(block, ["comp", "part"]).select("docs", "block").mapInArrow(_against_block, "u long, v long")
    return staged(found, "cross_links")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp): the smallest id reachable, for every id that has a link.

    Alternates large-star and small-star steps; every step is written to the shared folder.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = staged(small, "small_star")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        discard(large)
        edges = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots.distinct())


def drop_copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose group has a smaller key; key is a long column."""
    groups = near_groups(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = staged(groups.where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti").select(docs.columns)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(rows.mapInArrow(_signed, SIGN_SCHEMA), "signed")
    # equal sets: one class, carried by its smallest doc_id; copies meet before they are shuffled
    filled = sets.where("n_shingles > 0")
    named = filled.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    named = staged(named, "classes")
    signed = named.where("id IS NOT NULL")
    signatures = classes = signed.select("id", "set_key", "signature", "bands")
    at = signed.select("id", F.posexplode("bands").alias("no", "band"))
    buckets = at.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    in_bucket = staged(join_groups(at, staged(buckets, "shared_bands"), ["band"], "n").select("band", "no", "id", "least", "n"), "buckets")
    stars = in_bucket.where("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v")).distinct()
    x = signatures.select(F.col("id").alias("u"), F.col("signature").alias("x"))
    y = signatures.select(F.col("id").alias("v"), F.col("signature").alias("y"))
    hopeful = stars.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_hopeful, "u long, v long")
    links = confirm(hopeful, rows, classes)
    comp = staged(components(links), "star_components")
    more = links_across(in_bucket, comp, rows, classes)
    # rows of one doc_id with different sets are one document: they tie their classes
    shared = filled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("doc_id")
    ties = filled.select("doc_id", "set_key").join(shared, "doc_id").join(named.select("set_key", "id"), "set_key")
    ties = staged(ties.select(F.col("doc_id").alias("u"), F.col("id").alias("v")).where("u <> v").distinct(), "ties")
    if more.isEmpty() and ties.isEmpty():
        final = comp
    else:
        final = staged(components(links.unionByName(more).unionByName(ties)), "components")
    of_class = staged(named.join(final, "id", "left").select("set_key", "n", F.coalesce("comp", "id").alias("component_id")), "class_components")
    placed = join_groups(filled.select("doc_id", "set_key"), of_class, ["set_key"], "n").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
