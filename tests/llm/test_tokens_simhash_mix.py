"""Token counts, SimHash classes and source mixing against brute force."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from ratewright.llm import simhash
from ratewright.llm.mixing import mixed, sainte_lague, weighted_targets
from ratewright.llm.simhash import BANDS, band_keys, near_links, simhash_classes, within
from ratewright.llm.tokens import LONGEST, Counter, single_tokens, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b \t c", "▁x▁▁ y", "<s> </s> <unk><0x41>", "あ漢字 \U0001f600 é", "x" * 5000, "ab " * 3000,
    "Hello world, the cat's 1234567 dogs.\n\nnew\r\nline", "\x00\x01 nul", "tab\tseparated", "   leading", "trailing   ", "ﬁ ² ½ Å",
]


@pytest.fixture
def docs(spark):
    def make(texts, sources=None):
        sources = sources or ["s"] * len(texts)
        return spark.createDataFrame([(i, t, None, s, None) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], SCHEMA)

    return make


def test_token_counts_equal_the_library(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    alphabet = list("abcdefgh the of in  \n\t.,é▁漢\U0001f600") + [" the", "ing "]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(300)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs(texts).withColumnRenamed("lang", "n_tokens")).collect()}
    want = {i: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in enumerate(texts)}
    assert got == want
    assert token_counts(docs([])).collect() == []


def test_memory_of_counts_is_bounded_in_characters(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    slices = [["".join(rng.choices("abc漢é ", k=rng.randrange(1, 300))) for _ in range(20)] + ["漢字" * 2000, "x" * 9000] for _ in range(6)]
    for kept in (1 << 22, 50):
        monkeypatch.setattr("ratewright.llm.tokens.KEPT_CHARS", kept)
        counter = Counter(path)
        for texts in slices:
            assert counter.count(texts) == [len(model.encode(t)) for t in texts]
            grown = counter.rest.keys() - counter.single.keys()
            assert max(map(len, grown)) <= LONGEST and sum(map(len, grown)) == counter.chars
        assert kept > 50 or counter.chars < 5000


def test_shortcut_holds_only_single_tokens():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    single = single_tokens(model)
    assert len(single) > 10_000 and " the" in single
    assert all(len(model.encode(w[1:])) == 1 for w in list(single)[:500] if len(w) > 1)


def brute_simhash(rows, radius=2):
    def fp(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)] += [k] * (k is not None)
    return sorted(((k, format(fps[i], "016x"), min(least[find(i)], default=None)) for i, (k, _) in enumerate(rows)), key=str)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices(["Alpha", "beta", "gamma", "delta", "Eps", "zeta"], k=n)) for n in (0, 1, 2, 3, 40, 400, 400)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(60):
        w = rng.choice(base[4:]).split()
        if i % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, None), (201, "  \n"), (None, base[5]), (None, "only one here"), (300, base[4]), (300, base[4]), (7, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS fingerprint")
    got = sorted((tuple(r) for r in simhash_classes(df).collect()), key=str)
    assert got == brute_simhash(rows)
    assert simhash_classes(df.limit(0)).collect() == []


def test_tiles_find_every_near_pair(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(r.a, r.b) for r in near_links(spark.createDataFrame([([f], f) for f in signed], "fp array<long>, node long"), 2, tile=3).collect()]

    def classes(pairs):
        root = {f: f for f in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for f in signed:
            out[find(f)].add(f)
        return sorted(map(sorted, out.values()))

    brute = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    assert classes(links) == classes(brute)


def test_long_fingerprints_meet_across_bands(spark):
    rng = random.Random(4)
    base = [[rng.getrandbits(64) & (-1 if i % 2 else rng.getrandbits(64)) for i in range(4)] for _ in range(20)]
    fps = []
    for b in base:
        for flips in (0, 10, 30, 60):
            x = list(b)
            for bit in rng.sample(range(256), flips):
                x[bit // 64] ^= 1 << bit % 64
            fps.append(x)
    signed = [[f - (1 << 64) if f >> 63 else f for f in x] for x in fps]
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp array<long>, node long")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def classes(pairs):
        root[:] = range(len(fps))
        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for i in range(len(fps)):
            out[find(i)].add(i)
        return sorted(map(sorted, out.values()))

    brute = [(i, j) for i in range(len(fps)) for j in range(i) if sum(bin(a ^ b).count("1") for a, b in zip(fps[i], fps[j], strict=True)) <= 48]
    got = [(r.a, r.b) for r in near_links(rows, 48, lanes=4, tile=7).collect()]
    assert classes(got) == classes(brute)


def test_sainte_lague_gives_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    for house, claims in ((0, [3, 4]), (7, [53, 24, 23]), (10, [1, 1, 1, 1]), (100, [rng.randrange(1, 1000) for _ in range(30)]), (5, [0, 0]), (13, [100, 1, 1, 1, 1, 1, 1, 1, 1, 1])):
        rows = spark.createDataFrame([(f"p{i:02d}", float(c)) for i, c in enumerate(claims)], "source string, claim double")
        got = {r.source: r.seats for r in sainte_lague(rows, ["source"], [], "claim", F.lit(house)).collect()}
        want = {f"p{i:02d}": 0 for i in range(len(claims))}
        for _ in range(house if sum(claims) else 0):
            want[max(want, key=lambda p: (claims[int(p[1:])] / (2 * want[p] + 1), -int(p[1:])))] += 1
        assert got == want


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 2000}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in weighted_targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    open_, target, left = set(sizes), {}, float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(target)


def test_mix_reaches_targets(spark, docs):
    rng = random.Random(2)
    texts = [None, "", "w " * 20000] + ["w " * rng.randrange(1, 400) for _ in range(600)]
    sources = [rng.choice(["big", "big", "big", "x", "y", None]) for _ in texts]
    df = docs(texts, sources).selectExpr("*", "1 AS size", "2 AS code", "3 AS shard")
    rows = mixed(df, shard_blocks=64).collect()
    assert rows and sorted(rows) == sorted(mixed(df.repartition(5), shard_blocks=64).collect())
    assert all(0 <= r.taken <= 3 * r.size for r in rows) and len(rows) == len(texts)
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 128
    assert mixed(docs([])).collect() == []


def test_pairs_within_buckets_are_all_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 40, 400)] ^ np.where(rng.random((400, 4)) < 0.5, np.uint64(1) << rng.integers(0, 64, (400, 4)).astype(np.uint64), np.uint64(0))
    bucket = np.sort(rng.integers(0, 25, 400))
    for radius in (0, 3, 84):
        a, b = within(bucket, fps, radius)
        want = {(i, j) for i in range(400) for j in range(i) if bucket[i] == bucket[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius}
        assert len(a) == len(want) and {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want


def test_band_keys_follow_the_share():
    rng = np.random.default_rng(8)
    common, rest = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, (500, 2, 20), dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, r])) for pair in rest for r in pair]
    keys = band_keys([*sets, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)], 42)
    hits = (keys[0:1000:2] == keys[1:1000:2]).mean()
    assert abs(hits - 0.8**3) < 0.02 and (keys[-1] == keys[-2]).all() and not (keys[0] == keys[-1]).any()
    assert ((keys[0:1000:2] == keys[1:1000:2]).any(axis=1)).all() and keys.shape == (1002, BANDS)


@pytest.mark.parametrize(("common", "own", "other"), [(160, 20, 20), (160, 40, 0), (16, 2, 2), (8, 1, 1), (4, 1, 0)])
def test_texts_alike_agree_in_a_band_of_fingerprint_bits(common, own, other):
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(1000):
        h = rng.integers(0, 2**64, common + own + other, dtype=np.uint64)
        sets += [h[: common + own], np.concatenate([h[:common], h[common + own :]])]
    sums = np.stack([simhash.balance(s, 4) for s in sets])
    assert (simhash.packed(sums) == np.stack([simhash.majority(s, 4) for s in sets])).all()
    bands = simhash.bit_bands(sums, np.array([len(s) for s in sets]))
    apart = (bands[::2] ^ bands[1::2]) & ~((bands[::2] | bands[1::2]) >> simhash.BAND_BITS) & (1 << simhash.BAND_BITS) - 1
    assert (apart == 0).any(axis=1).all()
    # Other pairs hardly ever do.
    assert np.mean(((bands[:-2:2] ^ bands[2::2]) & ~((bands[:-2:2] | bands[2::2]) >> simhash.BAND_BITS) & (1 << simhash.BAND_BITS) - 1) == 0) < 0.01


@pytest.mark.parametrize(("tile", "crowd"), [(1 << 18, 64), (40, 2)])
def test_banded_links_connect_all_that_agree_in_a_band(spark, monkeypatch, tile, crowd):
    monkeypatch.setattr(simhash, "BUCKET_TILE", tile)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(10)
    sets = []
    for _ in range(25):
        h = rng.integers(0, 2**64, 100, dtype=np.uint64)
        sets += [np.concatenate([h[rng.random(100) < 0.9], rng.integers(0, 2**64, 8, dtype=np.uint64)]) for _ in range(rng.choice([1, 2, 5, 20]))]
    sums = np.stack([simhash.balance(s, 4) for s in sets])
    fps, bands = simhash.packed(sums), simhash.bit_bands(sums, np.array([len(s) for s in sets]))
    rows = [(i, f, b) for i, (f, b) in enumerate(zip(fps.view(np.int64).tolist(), bands.tolist(), strict=True))]
    nodes = spark.createDataFrame(rows, "node long, fp array<long>, bands array<long>")
    found = simhash.banded_links(nodes, 60, 4).collect()

    def classes(links):
        root = list(range(len(sets)))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return [root.index(r) for r in root]

    low = (1 << simhash.BAND_BITS) - 1
    want = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 60 and (((bands[i] ^ bands[j]) & ~((bands[i] | bands[j]) >> simhash.BAND_BITS) & low) == 0).any()
    ]
    assert classes(found) == classes(want) and len(want) > 200
