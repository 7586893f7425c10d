"""Filter audit, language by compression, clusters by subvectors: brute force, held-out accuracy, odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from ratewright.llm import filter_audit, langid, subvectors


# --- filter audit


def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))

    def fails(i, t):
        t = t or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        return {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
        }

    out = defaultdict(Counter)
    for i, t, lang in docs:
        f = fails(i, t)
        for order in permutations("ABCDE"):
            gone = False
            for s, x in enumerate(order, 1):
                c = out[lang or "", "".join(order), s]
                here = f[x] and not gone
                c["removed"] += here
                c["redundant"] += f[x] and gone
                gone |= f[x]
                c["kept"] += not gone
                c["unique_fails"] += f[x] and sum(f.values()) == 1
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
    shapley = Counter()
    for (part, order, s), c in out.items():
        shapley[part, order[s - 1]] += c["removed"]
    names = filter_audit.COUNTERS
    return {k: (*[c[n] for n in names], shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def audit_rows(docs, labels):
    return {(r.part, r.filter_order, r.step): (*[r[n] for n in filter_audit.COUNTERS], r.shapley) for r in filter_audit.audited(docs, labels).collect()}


def test_audit_is_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    docs = []
    for i in range(120):
        w = rng.choices(words if rng.random() < 0.6 else words[:20], k=rng.choice([0, 5, 150, 199, 200, 320]))
        t = " ".join(x.upper() if rng.random() < rng.choice([0, 0, 0.1]) else x for x in w) + rng.choice(["", "", "", " |", "é あ"])
        docs.append((i, t, rng.choice(["en", "fr", None, ""])))
    docs += [(500 + i, docs[rng.randrange(40)][1], rng.choice(["en", "fr"])) for i in range(60)]
    docs += [(3, docs[3][1], "en"), (3, docs[3][1], "fr"), (None, docs[7][1], "en"), (None, None, "en"), (900, None, "de"), (901, "", "de"), (902, "Long wordy " * 60000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 560, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "2 AS digest", "3 AS part", "4 AS n")
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "true AS good")
    assert audit_rows(frame, label) == brute_audit(docs, labels)
    assert audit_rows(frame.limit(0), label) == {}
    got = audit_rows(frame, label.limit(0))
    assert got == brute_audit(docs, [])
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})


def test_fields_do_not_run_over():
    big = (1 << 63) - 1
    total = filter_audit.packed(0b00001, True, False) * big
    fields = filter_audit.unpacked(total)
    assert fields.max() == big and fields.min() == 0
    assert (fields == filter_audit.outcomes(1, True, False).astype(np.int64) * big).all()
    kept = filter_audit.unpacked(sum(filter_audit.packed(m, False, True) for m in range(32)))[:, -1, 0]
    assert (kept == 1).all()


# --- language

TONGUES = {
    "xa": ["shu", "tiro", "mael", "kand", "ve", "lorun", "espa"], "xb": ["grom", "dass", "ich", "weld", "und", "schra", "bitz"],
    "xc": ["étra", "oul", "ceaux", "quel", "ment", "voir", "tre"],
}


def speech(rng, tongue, n):
    return " ".join("".join(rng.choices(TONGUES[tongue], k=rng.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_rows(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        tongue = rng.choice(list(TONGUES))
        text = speech(rng, tongue, rng.choice([4, 30, 200]))
        rows.append((i, text.upper() + "!! 42" if rng.random() < 0.2 else text, tongue))
    odd = [(5000, None, "xa"), (5001, "", "xa"), (5002, " 12 ²½ ?!\n", "xb"), (5003, speech(rng, "xc", 90000), None), (None, speech(rng, "xa", 20), "xb"), (5004, rows[0][1], "xa"), (5004, rows[0][1], "xa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'z' AS lang_pred", "true AS rejected")
    model = langid.fit(docs)
    assert set(model.names) == set(TONGUES) and all(len(c) <= langid.DICT_BYTES for c in model.contents)
    got = langid.identified(docs, model).collect()
    by = {r.doc_id: r for r in got}
    held = [(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(docs.collect()) and len(held) > 150
    assert np.mean([by[i].lang_pred == t for i, t in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert [(by[i].lang_pred, by[i].score, by[i].rejected) for i in (5000, 5001, 5002)] == [("und", 0.0, True)] * 3
    assert by[5003].lang_pred == "xc" and not by[5003].rejected
    assert by[None].lang_pred == "xa" and by[5004].lang_pred == by[0].lang_pred
    assert langid.identified(docs.limit(0), model).collect() == []
    none = langid.identified(docs, langid.fit(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(got)


def test_held_out_and_other_columns_teach_nothing(spark):
    rng = random.Random(6)
    rows = [(i, speech(rng, t, 30), t) for i, t in enumerate(rng.choices(list(TONGUES), k=200))]
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows] + [(None, "nobody", "yy")]
    a, b = (langid.fit(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, turned))
    assert a == b


def test_narrow_margins_are_rejected_and_ties_go_to_the_frequent(spark):
    text = langid.folded(speech(random.Random(7), "xa", 900))
    model = langid.Languages(["p", "q"], [text, text])
    docs = spark.createDataFrame([(1, speech(random.Random(8), "xa", 60))], "doc_id long, text string")
    row = langid.identified(docs, model).first()
    assert (row.lang_pred, row.score, row.rejected) == ("p", 0.5, True)
    alone = langid.identified(docs, langid.Languages(["p"], [text])).first()
    assert (alone.lang_pred, alone.score, alone.rejected) == ("p", 1.0, False)


def test_sizes_are_sums_over_all_blocks():
    model = langid.Languages(["p"], [langid.folded(speech(random.Random(9), "xb", 500))])
    c = model.compressors()
    text = langid.folded(speech(random.Random(10), "xb", 2000))
    parts = [text[i : i + langid.BLOCK] for i in range(0, len(text), langid.BLOCK)]
    assert langid.sizes(c, text) == [sum(langid.sizes(c, p)[0] for p in parts)]
    assert langid.sizes(c, b"") == [0]


# --- clusters


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        cents = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(cents)]
    placed = [(i, near(v)) for i, v in kept] if cents else []
    total = Counter()
    for _, (d, n) in placed:
        total[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is None, i or 0, n, d, total[n], sum(total.values()), sha[n]) for i, (d, n) in placed))


def cluster_rows(df, **kw):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in subvectors.clustered(df, **kw).collect())


@pytest.mark.parametrize("width", [1, 2, 5])
def test_clusters_are_brute_force(spark, width):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(64)]) for i in range(150)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(80)] + [(7, rows[7][1]), (7, hot), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, hot[:63]), (2003, hot[:63] + [None]), (2004, hot[:63] + [float("nan")]), (2005, hot[:63] + [float("-inf")]), (2006, [0.0] * 64), (2007, [-1000.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS id", "4 AS vec").repartition(3)
    assert cluster_rows(df, width=width) == brute_clusters(rows)
    assert cluster_rows(df.limit(0), width=width) == []
    few = rows[:5]
    assert cluster_rows(spark.createDataFrame(few, "vec_id long, embedding array<double>"), width=width) == brute_clusters(few)


def test_encoding_is_lossless():
    rng = np.random.default_rng(12)
    v = rng.integers(-9, 9, (300, 10))
    for width in (1, 3, 10):
        keys, codes, sizes, entries = subvectors.encode(list(range(300)), v, width)
        c = subvectors.Chunk(keys, codes, sizes, entries, 10, width)
        assert (np.concatenate([book[c.codes[:, b]] for b, book in enumerate(c.books)], axis=1) == v).all()
        cents = rng.integers(-9, 9, (4, 10))
        best, d = c.nearest(cents)
        full = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
        assert (best == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        assert (c.sums(best, 4) == np.stack([v[best == n].sum(axis=0) for n in range(4)])).all()


def test_components_too_large_say_so(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        subvectors.clustered(df).collect()
