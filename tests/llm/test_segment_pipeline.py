"""Sampled encodings against listed segmentations, and the pipeline against its parts by brute force."""

import collections
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from ratewright.llm import quality, segment, simhash
from ratewright.llm.queries import QUERIES
from ratewright.llm.segment import Sampler, decoded, encoder, sampled, segmented, vocabulary

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocab():
    return vocabulary(public_tokenizers.path(MODEL))


def listed(vocab, text, alpha):
    """Every segmentation of a text of known characters, with its probability."""
    score = {vocab.bytes[i].decode(): (int(i), float(s)) for _, ids, scores in vocab.by_length.values() for i, s in zip(ids, scores, strict=True)}

    def paths(at):
        if at == len(text):
            yield (), 0.0
            return
        for n in vocab.by_length:
            if text[at : at + n] in score and at + n <= len(text):
                i, s = score[text[at : at + n]]
                for rest, more in paths(at + n):
                    yield (i, *rest), alpha * s + more

    found = dict(paths(0))
    mass = np.exp(np.array(list(found.values())))
    return dict(zip(found, mass / mass.sum(), strict=True))


def test_samples_follow_the_law_without_replacement(vocab):
    n = 6000
    p = listed(vocab, " abab", 0.5)
    runs = segmented(["abab"] * n, range(n), vocab, 2, 0.5, 1)
    pairs = collections.Counter((tuple(a[0]), tuple(b[0])) for a, b in runs)
    for a, b in itertools.permutations(p, 2):
        assert abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.025
    weight = collections.Counter()
    for samples in runs:
        assert samples[0][2] >= samples[1][2]
        for ids, log_prob, _, log_inclusion in samples:
            assert log_prob == pytest.approx(np.log(p[tuple(ids)]), abs=1e-9)
            weight[tuple(ids)] += np.exp(log_prob - log_inclusion) / n
    # Weighting by inclusion probabilities gives the law back.
    assert all(abs(weight[s] - p[s]) < 0.02 for s in p)


def test_all_segmentations_come_out_once(vocab):
    p = listed(vocab, " ab c", 0.5)
    (samples,) = segmented(["ab c"], [1], vocab, 1000, 0.5, 1)
    assert {tuple(s[0]) for s in samples} == set(p) and len(samples) == len(p)
    assert all(s[3] == pytest.approx(0.0, abs=1e-9) for s in samples)


def test_noise_depends_on_the_key_alone(vocab):
    texts = ["some words here", "other words there", "some words here"]
    together = segmented(texts, [1, 2, 1], vocab, 3, 0.5, 1)
    alone = [segmented([t], [k], vocab, 3, 0.5, 1)[0] for t, k in zip(texts, [1, 2, 1], strict=True)]
    flat = lambda runs: [[(tuple(s[0]), round(s[1], 9), round(s[2], 9)) for s in r] for r in runs]
    assert flat(together) == flat(alone)
    assert flat(segmented(texts, [1, 2, 3], vocab, 3, 0.5, 1))[2] != flat(together)[2]


def test_memory_of_lattices_changes_nothing(vocab, monkeypatch):
    texts = ["the cat sat on the mat", "", "a mat; the cat\nsat 日本語 on it", "the cat sat on the mat", "unseen words ☃ here"]
    flat = lambda samples: [(s[0].tolist(), *s[1:]) for s in samples]
    alone = [flat(segmented([t], [i], vocab, 3, 0.5, 1)[0]) for i, t in enumerate(texts)]
    for kept in (1 << 19, 0, 20):
        monkeypatch.setattr("ratewright.llm.segment.KEPT_CHARS", kept)
        sampler = Sampler(vocab, 3, 0.5, 1)
        assert [flat(sampler.segmented([t], [i])[0]) for i, t in enumerate(texts)] == alone
    sampler = Sampler(vocab, 3, 0.5, 1)
    assert [flat(x) for x in sampler.segmented(texts[:2], [0, 1]) + sampler.segmented(texts[2:], [2, 3, 4])] == alone


def test_regions_are_cut_from_the_steps_that_can_matter(vocab, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghilmnorstu", k=rng.randrange(1, 12))) for _ in range(n)) for n in (4000, 300, 40, 1)] + ["x" * 2000, "☃" * 200 + " end", "日本 ☃" * 50]
    flat = lambda runs: [[(s[0].tolist(), *s[1:]) for s in r] for r in runs]
    drawn, plain = [], segment.exponents
    monkeypatch.setattr(segment, "exponents", lambda place, u: drawn.append(len(place)) or plain(place, u))
    some = flat(segmented(texts, range(7), vocab, 3, 0.5, 1))
    few = sum(drawn)
    monkeypatch.setattr(segment, "FIRST_STEPS", 1 << 40)
    assert flat(segmented(texts, range(7), vocab, 3, 0.5, 1)) == some
    # Noise is drawn for the regions beside a path's first steps, not beside all of them.
    assert few * 5 < sum(drawn) - few
    monkeypatch.setattr(segment, "FIRST_STEPS", 1)
    assert flat(segmented(texts, range(7), vocab, 3, 0.5, 1)) == some


@pytest.mark.parametrize("rounds", [64, 1, 0])
def test_trie_holds_every_piece(monkeypatch, rounds):
    monkeypatch.setattr(segment, "ROUNDS", rounds)
    rng = random.Random(4)
    pieces = sorted({"".join(rng.choices("abcd é☃", k=rng.randrange(1, 6))) for _ in range(900)} | {chr(c) for c in range(97, 200)})
    trie = object.__new__(segment.Vocabulary)
    trie._grow_trie(pieces)
    state_of = dict(zip(pieces, trie.states.tolist(), strict=True))
    assert len(set(state_of.values())) == len(pieces)
    starts = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
    for text in [*pieces, *("".join(rng.choices("abcd é☃Z", k=6)) for _ in range(500))]:
        state = 0
        for n, c in enumerate(text, 1):
            to = trie.base[state] + trie.class_of[ord(c)]
            assert (trie.parent[to] == state) == (text[:n] in starts)
            if trie.parent[to] != state:
                break
            state = to
            assert state_of.get(text[:n], state) == state


def test_words_are_split_at_spaces(vocab):
    texts = ["a b", "", " a", "a ", "  a  b ", "b", " ", "é☃ a\n a", "a▁b"]
    sampler = Sampler(vocab, 2, 0.5, 1)
    words = [sampler._words(texts[:5]), sampler._words(texts[5:]), sampler._words([])]
    spelt = {n: w for w, n in sampler.numbers.items()}
    assert [[spelt[n] for n in x.tolist()] for some in words for x in some] == [re.findall(" +[^ ]*", " " + t.replace("▁", " ")) if t else [] for t in texts]


def test_encodings_decode(spark):
    texts = [None, "", " ", "a", "Hello world\n\n  x", "\t tab", "é 漢字 \U0001f600 \x00", "x" * 3000, "word " * 20000, "   ", "▁literal mark"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS Samples", "2 AS ids")
    out = sampled(df)
    assert out.columns == ["doc_id", "text", "ids", "samples", "round_trip"]
    got = out.collect()
    assert [r.round_trip for r in sorted(got, key=lambda r: str(r.doc_id)) if r.text == "▁literal mark"] == [False]
    assert all(r.round_trip for r in got if r.text != "▁literal mark")
    library = encoder(MODEL)
    for r in got:
        ids = [tuple(s.ids) for s in r.samples]
        assert len(set(ids)) == len(ids) == (1 if not r.text else 2)
        assert all(s.log_prob <= 1e-9 and s.log_inclusion <= 0 and np.isfinite(s.log_inclusion) for s in r.samples)
        if r.text and r.text != "▁literal mark":
            assert all(library.decode(list(i)) == r.text for i in ids)
    same = [r.samples for r in got if r.doc_id == 4]
    assert same[0] == same[1]
    assert sampled(df.limit(0)).collect() == []
    ids = spark.createDataFrame([(1, library.encode("round trip\n")), (2, []), (3, None)], "k long, ids array<int>")
    assert {r.k: r.decoded for r in decoded(ids).collect()} == {1: "round trip\n", 2: "", 3: None}


def test_query_returns_the_encodings(spark, tmp_path):
    spark.createDataFrame([(1, "Hello world"), (2, None), (3, "another text")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op2_sampled_encodings"](spark, str(tmp_path)).collect()}
    library = encoder(MODEL)
    for i, text, n in [(1, "Hello world", 2), (2, "", 1), (3, "another text", 2)]:
        ids = {tuple(s.ids) for s in got[i].samples}
        assert len(ids) == len(got[i].samples) == n and all(library.decode(list(x)) == text for x in ids)


WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("an", "or", "il", "ust") for c in ("ed", "ing", "er", "ly", "a")]


def small_corpus(rng):
    rows = []
    for i in range(400):
        w = rng.choices(WORDS, k=rng.randrange(30, 150))
        good = i % 5 != 0
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w]), "en", f"s{i % 4}", good))
    passage = " ".join(rng.choices(WORDS, k=40))
    for i in range(1, 400, 37):
        rows[i] = (i, rows[i][1] + " " + passage, *rows[i][2:])
    for j, i in enumerate(range(2, 60, 6)):
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((1000 + j, " ".join(w) if j % 2 else rows[i][1], "en", "s1", rows[i][4]))
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = small_corpus(rng)
    odd = [(2000, None, None, None, None), (2001, "", "en", "s1", None), (None, rows[1][1], "en", "s2", True)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows + odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("tails", docs.doc_id).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, _, _, g in rows[:300]], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, stage in enumerate(stages):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen.append(now.collect())
        if i < 4:
            assert now.columns == corpus_pipeline.COLUMNS
    # 1: the poor go, and what has no words.
    assert {r.doc_id for r in seen[0]} == {i for i, _, _, _, g in rows + odd if g}
    # 2: of texts with four fifths of their five-word shingles in common the smallest doc_id stays.
    kept = {r.doc_id: r.text for r in seen[0] if r.doc_id is not None}
    shingles = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in kept.items()}
    gone = {b for a, b in itertools.combinations(sorted(kept), 2) if b >= 1000 and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])}
    assert {r.doc_id for r in seen[1] if r.doc_id is not None} == set(kept) - gone and len(gone) >= 6
    # 3: words of windows that a smaller doc_id has are cut.
    first = {}
    order = sorted(seen[1], key=lambda r: (r.doc_id is None, r.doc_id))
    want = {}
    for r in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        cut = {k for j in range(len(w) - 12) if tuple(w[j : j + 13]) in first for k in range(j, j + 13)}
        want[r.doc_id] = " ".join(x for k, x in enumerate(w) if k not in cut) if cut else r.text
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), r.doc_id)
    assert {r.doc_id: r.text for r in seen[2]} == {i: t for i, t in want.items() if t}
    # 4: rows repeat whole, three times at most, and the sources' words come near their targets.
    times = collections.Counter(r.doc_id for r in seen[3])
    assert set(times) <= {r.doc_id for r in seen[2]} and max(times.values()) <= 3
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    total = words(seen[2])
    for source, weight in zip(["s0", "s1", "s2", "s3"], [1, 2, 3, 1], strict=True):
        have, target = words(r for r in seen[3] if r.source == source), total * weight / 7
        assert abs(have - min(target, 3 * words(r for r in seen[2] if r.source == source))) < 300
    # 5: every row has its encodings, which decode to its text.
    library = encoder(MODEL)
    texts = {r.doc_id: r.text for r in seen[3]}
    assert len(seen[4]) == len(seen[3])
    assert all(r.round_trip and all(library.decode(s.ids) == texts[r.doc_id] for s in r.samples) for r in seen[4])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "round_trip").collect())) == sorted(str(r) for r in now.select("doc_id", "round_trip").collect())


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert quality.KEEP > 0


@pytest.mark.parametrize("tile", [2048, 6])
def test_near_dedup_keeps_what_is_below_four_fifths(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "PIECE", 16)
    monkeypatch.setattr(simhash, "BUCKET_TILE", tile)
    rng = random.Random(5)
    rows = []
    for g in range(60):
        base = rng.choices(WORDS, k=120)
        # Runs of changed words: shares of the shingles from about 0.6 to 0.95.
        for v in range(4):
            w = list(base)
            start, n = rng.randrange(80), rng.choice([1, 4, 8, 12, 20, 26]) if v else 0
            w[start : start + n] = rng.choices(WORDS, k=n)
            rows.append((4 * g + v, " ".join(w)))
    # One line again and again in otherwise different texts.
    line = " ".join(rng.choices(WORDS, k=14))
    rows += [(1000 + i, " ".join(rng.choices(WORDS, k=150)) + f" {line}" * 12) for i in range(20)]
    # A chain of near copies longer than a piece.
    w = rng.choices(WORDS, k=100)
    for i in range(60):
        rows.append((2000 + i, " ".join(w)))
        w[rng.randrange(100)] = rng.choice(WORDS)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {i for i, r in root.items() if i == r} and 60 < len(got) < 300


def test_near_dedup_with_one_key_for_two_texts_and_null_keys(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(rng.choices(WORDS, k=60)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (2, two), (3, None), (4, ""), (None, one), (None, three), (5, three), (5, three)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    # Key 2 is first of its second text, so its rows stay, each once; rows without a key stay as they are.
    assert got == sorted([(False, 1, one), (False, 2, one), (False, 2, two), (False, 3, ""), (False, 5, three), (True, 0, one), (True, 0, three)])
