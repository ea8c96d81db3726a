"""Dedup, near-dedup, mixing, sharding, token files: brute force and round trips."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup, mixing, near_dup, queries, sharding, token_files
from lexiloom.llm.common import table


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if len(w) == 1 else {*zip(w, w[1:], strict=False)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_families(seed, n_families=12, copies=14):
    r, rows = random.Random(seed), []
    words = [f"v{i}" for i in range(400)]
    for _ in range(n_families):
        base = [r.choice(words) for _ in range(r.choice([3, 12, 60, 200]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 9))):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t).upper() if r.random() < 0.2 else " ".join(t)))
    return rows


def test_near_groups_are_brute_force(spark):
    for seed in (1, 2):
        rows = near_families(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_components(rows)


def test_large_family_links_across_stars(spark):
    """Copies around a base that is not the smallest id: stars alone leave components apart."""
    r, words = random.Random(9), [f"u{i}" for i in range(900)]
    base, rows = [f"b{i}" for i in range(150)], []
    for k in range(260):
        t = list(base)
        for i in r.sample(range(150), r.choice([4, 6, 8, 9, 10])):
            t[i] = r.choice(words)
        rows.append((k, " ".join(t)))
    rows.append((500, " ".join(base)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_estimate_is_close():
    a, b = near_dup.parameters()
    r = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8, 0.95):
        x = r.integers(0, 2**63, 2000, np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        y = np.concatenate((x[:n], r.integers(0, 2**63, 2000 - n, np.uint64)))
        p, q = (np.frombuffer(near_dup.pack_signature(near_dup.minima(s, a, b)), np.uint64) for s in (x, y))
        assert abs(float(near_dup.estimate(p, q)) - share) < 0.12


def test_forced_collisions_are_told_apart(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice(["Alpha", "alpha", "Beta", "gamma", "", None, "Ä", "ä"])) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/d")
    low = lambda t: (t or "").translate(str.maketrans("ABG", "abg"))
    want = {i: (max(j for j, u in rows if low(u) == low(t)), sum(low(u) == low(t) for _, u in rows)) for i, t in rows}
    for digest, limit in ((exact_dedup.sha256, 10**6), (exact_dedup.sha256, 0), (lambda norm: (F.length(norm) % 2).cast("string"), 0)):
        got = exact_dedup.exact_dedup(spark, f"file://{tmp_path}/d", digest, files_per_batch=1, limit=limit).collect()
        assert {x.doc_id: (x.keep_id, x.group_size) for x in got} == want
        assert all(x.kept == (x.doc_id == x.keep_id) for x in got)


def test_near_pairs_at_the_limit_are_found(spark):
    """Pairs whose similarity is 0.80 to 0.82: the recall that banding and estimates leave."""
    r, rows, want = random.Random(11), [], {}
    for k in range(600):
        n = r.randint(100, 400)
        base = [f"p{k}w{i}" for i in range(n + 1)]
        other = list(base)
        # changed words at the end take one shingle each and bring one each
        for cut in range(n // 9 + 2, 0, -1):
            other = base[: n + 1 - cut] + [f"p{k}x{i}" for i in range(cut)]
            if 100 * (n - cut) >= 80 * (n + cut):
                break
        assert 0.8 <= (n - cut) / (n + cut) < 0.83
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        want[2 * k + 1] = 2 * k
    got = {x.doc_id: x.component_id for x in near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(got[i] == c for i, c in want.items()) / len(want)
    print("recall at 0.80 to 0.83:", recall)
    assert recall >= 0.998
    assert all(got[i] == i for i in want.values())


def test_rows_without_an_id_are_in_no_group(spark):
    rows = [(1, "a b c d"), (None, "a b c d"), (None, "x y z"), (2, "a b c d")]
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 1, True), (2, 1, False), (None, None, True), (None, None, True)]


def fill(budget, children):
    """Brute force: give out by weight, round after round, to those that are not full."""
    got, open_ = [0.0] * len(children), [k for k, (w, _) in enumerate(children) if w > 0]
    while open_ and budget > 1e-9:
        total = sum(children[k][0] for k in open_)
        given = [(k, min(budget * children[k][0] / total, children[k][1] - got[k])) for k in open_]
        for k, x in given:
            got[k] += x
        budget -= sum(x for _, x in given)
        open_ = [k for k in open_ if got[k] < children[k][1] - 1e-9]
    return got


def test_shortage_goes_to_siblings(spark):
    r = random.Random(8)
    cases = [(100, [(1, 10), (1, 1000), (2, 1000)]), (100, [(1, 10), (1, 20)]), (10, [(0, 5), (1, 100)]), (0, [(1, 5)])]
    cases += [(r.uniform(0, 300), [(r.choice([0, 0.5, 1, 3]), r.choice([0, 10, 40, 90])) for _ in range(r.randint(1, 7))]) for _ in range(40)]
    rows = [(c, str(k), float(cap), float(w), float(budget)) for c, (budget, children) in enumerate(cases) for k, (w, cap) in enumerate(children)]
    got = {}
    for x in mixing.shares(spark.createDataFrame(rows, "c int, name string, cap double, weight double, budget double"), ["c"]).collect():
        got[x.c, int(x.name)] = x.share
    assert [got[0, k] for k in range(3)] == [10, 30, 60] and [got[2, k] for k in range(2)] == [0, 10]
    for c, (budget, children) in enumerate(cases):
        assert np.allclose([got[c, k] for k in range(len(children))], fill(budget, children)), cases[c]


def brute_mix(rows, target):
    import hashlib
    import re

    words, domain = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for _, _, _, source in rows:
        domain[source] = next((n for n, p in target.domains if re.search(p, source)), "other")
    leaves = {}
    for i, t, lang, source in rows:
        leaves.setdefault((domain[source], lang, source), []).append((i, t or "", len(words.findall(t or ""))))
    size = {k: sum(x[2] for x in v) for k, v in leaves.items()}
    budget = {(): target.share * sum(size.values())}
    for n, level in enumerate(mixing.LEVELS):
        below = {}
        for k in leaves:
            below.setdefault(k[:n], set()).add(k[: n + 1])
        for parent, names in below.items():
            names = sorted(names)
            caps = [target.max_epochs * sum(t for k, t in size.items() if k[: n + 1] == x) for x in names]
            budget |= dict(zip(names, fill(budget[parent], [(target.weights.get(level, {}).get(x[n], 1.0), c) for x, c in zip(names, caps, strict=True)]), strict=True))
    out = []
    for k, own in leaves.items():
        full, rest = divmod(int(budget[k] + 1e-6), size[k]) if size[k] else (1, 0)
        if full >= target.max_epochs:
            full, rest = target.max_epochs, 0
        at = 0
        for i, _, n in sorted(own, key=lambda x: hashlib.md5("|".join((str(target.seed), str(full), str(x[0]), x[1])).encode()).hexdigest()[:15]):
            at += n
            out += [(i, e) for e in range(full + (rest > 0 and at <= rest))]
    return sorted(out)


def test_mix_is_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    for target in (mixing.Target(), mixing.Target(share=0.7, seed=3), mixing.Target(share=1.7, max_epochs=2), mixing.Target(share=0.9, max_epochs=1, weights={"domain": {"web": 0.0}, "source": {"src7": 9.0}})):
        assert sorted((r.doc_id, r.epoch) for r in mixing.mix(docs, target).collect()) == brute_mix(rows, target)


def test_shards_are_near_equal_and_gapless(spark, sf_dir):
    got = queries.op5_virtual_slots(spark, sf_dir).toPandas()
    docs = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in table(spark, sf_dir, "documents").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for _, r in got.iterrows()} == docs
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() - sums.min() <= got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_rebalancing_edits_few_slots():
    r = random.Random(2)
    size = [r.randint(1, 100) for _ in range(512)]
    first = sharding.rebalance(sharding.first_map(512, 8), size, [1] * 512)
    assert first.version == 2 and max(first.loads()) - min(first.loads()) <= 100
    grown = sharding.rebalance(first, size, [1] * 512, 9)
    moved = [v for v in range(512) if first.shard[v] != grown.shard[v]]
    assert grown.version == 3 and len([v for v in moved if grown.shard[v] == 8]) >= 0.9 * len(moved) and len(moved) < 512 / 6
    assert max(grown.loads()) <= 1.02 * sum(size) / 9
    fewer = sharding.rebalance(grown, size, [1] * 512, 8)
    assert set(fewer.shard) == set(range(8)) and max(fewer.loads()) <= 1.02 * sum(size) / 8
    # one slot above the mean is left, the others are near equal
    big = sharding.rebalance(sharding.first_map(64, 4), [1000] + [1] * 63, [1] * 64).loads()
    assert sorted(big)[3] == 1000 and sorted(big)[:3] == [21, 21, 21]


def test_the_map_is_stored_and_edited(spark, tmp_path):
    home = f"file://{tmp_path}/map"
    rows = [(i, "x" * (i * 37 % 400)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r for r in sharding.shard_documents(docs, 6, 64, home).collect()}
    assert sharding.map_versions(spark, home) == [1, 2] and {r.map_version for r in one.values()} == {2}
    assert sharding.load_map(spark, home, 1).shard == sharding.first_map(64, 6).shard
    again = {r.doc_id: r for r in sharding.shard_documents(docs, 6, 64, home).collect()}
    assert sharding.map_versions(spark, home) == [1, 2] and again == one
    grown = {r.doc_id: r for r in sharding.shard_documents(docs, 7, 999, home).collect()}
    assert sharding.map_versions(spark, home) == [1, 2, 3] and {r.shard for r in grown.values()} == set(range(7))
    assert all(grown[i].vslot == r.vslot for i, r in one.items())
    assert sum(grown[i].shard != r.shard for i, r in one.items()) < 900 / 4


def test_the_stream_goes_on_where_it_stopped(spark, tmp_path):
    at, home = f"file://{tmp_path}/d", f"file://{tmp_path}/home"
    r = random.Random(5)
    rows = [(i, r.choice(["Alpha", "alpha", "Beta", "gamma", "", None, "Ä" * 5000])) for i in range(90)]
    low = lambda t: (t or "").translate(str.maketrans("ABG", "abg"))
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], "doc_id long, text string").coalesce(1).write.mode("append").parquet(at)
        seen = rows[: 30 * k + 30]
        want = {i: (max(j for j, u in seen if low(u) == low(t)), sum(low(u) == low(t) for _, u in seen)) for i, t in seen}
        got = exact_dedup.exact_dedup(spark, at, home=home, limit=0 if k == 1 else exact_dedup.BROADCAST_BYTES).collect()
        assert {x.doc_id: (x.keep_id, x.group_size) for x in got} == want
        new = exact_dedup.retained(spark, at, home=home)
        assert new.agg(F.sum("n")).first()[0] == len(seen)  # nothing is read twice


def test_codec_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (2 ** r.uniform(0, 32, n)).astype(np.uint32)
        control, data = token_files.code_ranks(x)
        assert len(control) == -(-n // 4) and (token_files.decode_ranks(control, data, n) == x).all()


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = token_files.vocabulary_path()
    tok, own, r = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(7)
    parts = [" ", "  ", "a", "é", "1", "½", "\n", "\t", "'s", ".", "\xa0", "日", "<|endoftext|>", "\x1c", "the", " the", "_", "🙂", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_wide_ids_do_not_overflow(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.save(path := f"{tmp_path}/wide.json")
    assert token_files.needs_wide(path) and not token_files.needs_wide(token_files.vocabulary_path())
    x = np.array([3, 69_999, 65_536], np.uint32)
    assert (np.frombuffer(token_files.pack_ids(x, True), "<u4") == x).all()


def test_files_hold_every_document(spark, sf_dir):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(token_files.vocabulary_path()), 0
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    got = sorted(tuple(r) for r in queries.op6_token_files(spark, sf_dir).collect())
    for (i, t), g in zip(docs, got, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert g == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
