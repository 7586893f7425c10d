"""Substring de-duplication: repeated phrases are confirmed, compiled into sharded automata, and found in every document.

1. Every window of ``width`` words has a least hash among its runs of five words (its anchor). Equal windows have equal
   anchors, so only windows whose anchor occurs in two different texts can repeat. Counting anchors moves about a
   fifth of the words as hashes, pre-aggregated.
2. Each text learns which of its anchors recur and cuts out phrases: the stretch of words whose windows share one
   recurring anchor. Copies of a whole text are one text here; only the copy with the smallest key speaks for it.
3. Phrases go to shards by anchor, in key order. A shard confirms by the words themselves which windows occurred under a
   smaller key, compiles those into an Aho-Corasick automaton over word numbers, and streams its phrases through it.
   The automaton's hits are the windows to remove.
4. An anchor of more than HOT stretches would fill its shard. Its windows go by themselves, as 128-bit digests: their
   smallest keys are pre-aggregated and joined back, where Spark splits what is skewed.
5. Hits return to their texts as stretches of words, and each text is cut.

Hashes of five words only choose candidates; what is removed is decided by equal words, or digests of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import Words, grams, slices, stored, texts_of

WIDTH = 13
ANCHOR = 5
#: Stretches of an anchor that one shard still takes. It routes, and drops nothing.
HOT = 4_096
#: Phrases compiled into one automaton.
PORTION = 20_000
#: Different words that a shard numbers before it starts anew, at the next portion that begins with another anchor.
WORDS_KEPT = 500_000
#: A null key counts as larger than any other.
LAST = (1 << 63) - 1


def window_anchors(words: Words, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies within one text: its first word's number and its anchor (as signed numbers)."""
    g = grams(words.hashes(), k)
    span = width - k + 1
    if len(g) < span:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    least, reach = g, 1
    while 2 * reach <= span:
        least, reach = np.minimum(least[: len(least) - reach], least[reach:]), 2 * reach
    if reach < span:
        n = len(g) - span + 1
        least = np.minimum(least[:n], least[span - reach : span - reach + n])
    start = np.arange(len(least))
    inside = words.text_of()
    ok = inside[: len(start)] == inside[start + width - 1]
    return start[ok], least[ok].view(np.int64)


def _runs(start: np.ndarray, anchor: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of stretches of consecutive windows of one text with one anchor, as positions in the arrays."""
    if not len(start):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    new = np.flatnonzero((np.diff(start) != 1) | (np.diff(anchor) != 0) | (np.diff(text) != 0)) + 1
    return np.concatenate([[0], new]), np.concatenate([new, [len(start)]])


def _anchor_rows(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(anchor, class) of every text, one row for each stretch of windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(texts_of(batch))
            start, anchor = window_anchors(words, width, k)
            text = words.text_of()[start]
            a, _ = _runs(start, anchor, text)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[a]), batch.column(0).take(pa.array(text[a]))], names=["anchor", "class"])

    return rows.select("class", "text").mapInArrow(run, "anchor long, class long")


def _phrases(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(hot, anchor, key, class, at, phrase) from (key, class, text, anchors).

    For an anchor that recurs the phrase is a stretch of words whose windows share it; for a hot one, each window's digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            words = Words(texts)
            start, anchor = window_anchors(words, width, k)
            text = words.text_of()[start]
            lists = batch.column(batch.schema.get_field_index("anchors"))
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            known, hot = np.zeros(len(start), dtype=bool), np.zeros(len(start), dtype=bool)
            for i in range(len(texts)):
                a, b = bounds[i], bounds[i + 1]
                wanted, warm = (lists[i].values.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "hot"))
                known[a:b] = np.isin(anchor[a:b], wanted[~warm])
                if warm.any():
                    hot[a:b] = np.isin(anchor[a:b], wanted[warm])
            a, b = _runs(start[known], anchor[known], text[known])
            begin, last = np.concatenate([start[known][a], start[hot]]), np.concatenate([start[known][b - 1], start[hot]]) + width - 1
            low, high = words.starts[begin].tolist(), words.ends[last].tolist()
            cut = [words.data[x:y] for x, y in zip(low, high, strict=True)]
            for i in range(len(a), len(cut)):
                cut[i] = xxhash.xxh3_128_digest(b" ".join(cut[i].split()))
            at = np.concatenate([text[known][a], text[hot]])
            own = np.concatenate([anchor[known][a], anchor[hot]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(cut)) >= len(a)), pa.array(own), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array((begin - words.first[at]).astype(np.int32)), pa.array(cut, pa.binary())],
                names=["hot", "anchor", "key", "class", "at", "phrase"],
            )

    return rows.select("key", "class", "text", "anchors").mapInArrow(run, "hot boolean, anchor long, key long, class long, at int, phrase binary")


class Shard:
    """Finds the windows of phrases that occurred under a smaller key. Phrases come sorted by (anchor, key)."""

    def __init__(self, width: int):
        self.width, self.anchor, self.first, self.numbers = width, None, {}, {}

    def portion(self, anchors: list[int], keys: list[int], phrases: list[bytes]) -> list[list[int]]:
        """For each phrase the first words (numbers within it) of its windows to remove."""
        if len(self.numbers) > WORDS_KEPT and anchors[0] != self.anchor:
            self.numbers = {}
        width, numbers = self.width, self.numbers
        coded, confirmed = [], {}
        for anchor, key, phrase in zip(anchors, keys, phrases, strict=True):
            if anchor != self.anchor:
                # Equal windows have equal anchors, so what went before cannot be met again.
                self.anchor, self.first = anchor, {}
            ids = tuple([numbers.setdefault(w, len(numbers)) for w in phrase.split()])
            coded.append(ids)
            for i in range(len(ids) - width + 1):
                window = ids[i : i + width]
                if self.first.setdefault(window, key) < key:
                    confirmed[window] = self.first[window]
        out: list[list[int]] = [[] for _ in coded]
        if confirmed:
            machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, first in confirmed.items():
                machine.add_word(window, first)
            machine.make_automaton()
            for hits, key, ids in zip(out, keys, coded, strict=True):
                hits.extend(end - width + 1 for end, first in machine.iter(ids) if first < key)
        return out


def _removed_hot(windows: DataFrame, width: int) -> DataFrame:
    """(class, key, a, b): windows that a smaller key has too, from one row for each window."""
    firsts = windows.groupBy("phrase").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("phrase", "least")
    found = windows.join(firsts, "phrase").where("least < key")
    return found.select("class", "key", F.col("at").alias("a"), (F.col("at") + width).alias("b"))


def _removed(phrases: DataFrame, width: int) -> DataFrame:
    """(class, key, a, b): stretches of word numbers to remove from a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(width)
        for whole in batches:
            for i in range(0, whole.num_rows, PORTION):
                batch = whole.slice(i, PORTION).select(["anchor", "key", "class", "at", "phrase"])
                hits = shard.portion(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist())
                row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                begin = np.array([x for h in hits for x in h], dtype=np.int64)
                at = np.asarray(batch.column(3))[row] + begin
                # Windows of one phrase that follow one another make one stretch.
                new = np.flatnonzero((np.diff(row) != 0) | (np.diff(at) > width)) + 1
                a = np.concatenate([[0], new]).astype(np.int64) if len(at) else np.empty(0, dtype=np.int64)
                b = np.concatenate([new, [len(at)]]).astype(np.int64) - 1 if len(at) else a
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).take(pa.array(row[a])), batch.column(1).take(pa.array(row[a])), pa.array(at[a].astype(np.int32)), pa.array((at[b] + width).astype(np.int32))],
                    names=["class", "key", "a", "b"],
                )

    return phrases.mapInArrow(run, "class long, key long, a int, b int")


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """Adds n_words, n_removed and kept to the rows, and drops first and cuts."""
    names = [c for c in rows.columns if c not in ("first", "cuts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, firsts, cuts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "first", "cuts"))
            n_words, n_removed, kept = [], [], []
            for key, text, first, stretches in zip(keys, texts_of(batch), firsts, cuts, strict=True):
                words = text.split()
                n = len(words)
                if first < key and n >= width:
                    words = []
                elif stretches:
                    keep = np.ones(n, dtype=bool)
                    for c in stretches:
                        keep[c["a"] : c["b"]] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append((b" ".join(words)).decode())
            same = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*same, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    schema = rows.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return rows.mapInArrow(run, schema)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(key, carried columns, n_words, n_removed, kept): each row's text without words that a window repeats from a smaller key.

    A window is ``width`` consecutive words of one row's whole text; it repeats if the same words follow one another in
    a row with a smaller key. All windows are judged on the input. ``kept`` joins the other words by one space. A null
    or wordless text has no words; rows of fewer words than a window lose none. A null key counts as larger than any
    other; rows with equal keys take nothing from one another, so repeated rows come out alike. Keys are longs. An empty
    table gives an empty one; columns not named are not read.
    """
    parts = [F.coalesce(F.col(key), F.lit(LAST)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    texts = df.select(*parts).withColumns({"class": F.xxhash64("text"), "code": F.md5("text")})
    anchors = _anchor_rows(texts, width, anchor)
    twice = anchors.groupBy("anchor").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count(F.lit(1)).alias("n"))
    twice = stored(twice.where("a <> b").select("anchor", (F.col("n") > hot).alias("hot")), "anchors")
    firsts = stored(texts.groupBy("class", "code").agg(F.min("key").alias("first")), "firsts")
    sets = anchors.join(twice, "anchor").groupBy("class").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))
    sets = stored(sets.join(firsts, "class"), "sets")
    speaking = texts.join(sets, ["class", "code"]).where(F.col("key") == F.col("first"))
    phrases = stored(_phrases(speaking, width, anchor), "phrases")
    shards = phrases.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "key")
    found = _removed(shards, width).union(_removed_hot(phrases.where("hot"), width))
    cuts = found.groupBy("class", "key").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    cuts = stored(cuts.withColumnRenamed("key", "first"), "cuts")
    about = firsts.join(cuts, ["class", "first"], "left")
    carried = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    rows = df.select(*parts, F.col(key).isNull().alias("_null"), *carried).withColumns({"class": F.xxhash64("text"), "code": F.md5("text")})
    out = _cut(rows.join(about, ["class", "code"]).drop("class", "code"), width)
    named = [F.col(f"_{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.when(~F.col("_null"), F.col("key")).alias(key), *named, "n_words", "n_removed", "kept")
