"""Substring de-duplication against brute force over windows."""

import random
import re

from ratewright.llm.substring import LAST, Shard, without_repeats


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            win = tuple(w[i : i + width])
            first[win] = min(first.get(win, LAST), LAST if k is None else k)
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (LAST if k is None else k):
                gone.update(range(i, i + width))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def some_rows(rng):
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "the", "é", " x", "漢字", "a b"]
    text = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, k=n))
    passages = [text(n) for n in (13, 14, 25, 60, 200)]
    rows = []
    for i in range(150):
        parts = [text(rng.randrange(0, 40)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages).split(" ")
            a = rng.randrange(0, max(1, len(p) - 12))
            parts.insert(rng.randrange(len(parts) + 1), " ".join(p[a : a + rng.randrange(12, 80)]))
        rows.append((i * 3 % 151, " ".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(20)]
    same = "x " * 50
    rows += [(900, None), (901, ""), (902, " \n "), (903, "only twelve words here " * 3), (904, same), (905, same + "y"), (906, "x " * 12), (907, "x " * 13)]
    rows += [(910, rows[3][1]), (910, rows[3][1]), (None, rows[4][1]), (None, text(40)), (-5, rows[5][1]), (911, text(30000))]
    return rows


def test_removals_equal_brute_force(spark):
    rows = some_rows(random.Random(6))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS cuts", "3 AS n_words", "4 AS first")
    got = sorted((tuple(r) for r in without_repeats(df).collect()), key=str)
    assert got == brute(rows)
    # Wherever the line between shards and hot windows lies, the result is the same.
    for hot in (0, 6):
        assert sorted((tuple(r) for r in without_repeats(df, hot=hot).collect()), key=str) == brute(rows)
    kept = without_repeats(df, carry=("cuts", "first")).columns
    assert kept == ["doc_id", "cuts", "first", "n_words", "n_removed", "kept"]
    assert without_repeats(df.limit(0)).collect() == []


def test_a_hot_passage_is_found_everywhere(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join([*(f"{rng.random():.9f}" for _ in range(9)), passage, *(f"{rng.random():.9f}" for _ in range(9))])) for i in range(2000)]
    for hot in (500, 4096):
        got = {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
        assert got == {i: 30 if i else 0 for i in range(2000)}


def test_shards_work_in_portions():
    a, b = b" ".join(b"a%d" % i for i in range(15)), b" ".join(b"b%d" % i for i in range(13))
    shard = Shard(13)
    assert shard.portion([1, 1, 2], [1, 2, 4], [a, a, b]) == [[], [0, 1, 2], []]
    # A group that goes on in the next portion still knows its first key.
    assert shard.portion([2, 2], [4, 9], [b, b]) == [[], [0]]
