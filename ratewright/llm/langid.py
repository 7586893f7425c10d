"""Language of texts by compression: the language whose dictionary shortens a text most.

Each learned language has a zstandard raw-content dictionary, made of pieces of its texts. A text is folded (lower case,
letters only), cut into blocks, and each block is compressed with every dictionary; a language's size is the sum over the
blocks. Blocks are compressed apart, so that a text cannot become its own dictionary. The smallest sum decides; a narrow
margin to the next is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import slices, texts_of

#: A fit reads at most PIECES pieces of PIECE characters a language; they make up its dictionary, of DICT_BYTES at most.
PIECES, PIECE, DICT_BYTES = 512, 512, 1 << 17
BLOCK, LEVEL = 1024, 6
#: Least saving against the next best language, as a share of that one's size, for a prediction that is not rejected.
MARGIN = 0.02
#: Bits of difference in size that halve the odds of a language, for the score.
HALVING = 16.0
UNKNOWN = "und"

_GAPS = regex.compile(r"[^\p{L}\p{M}']+")
_LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> bytes:
    """Lower-case letters, marks and apostrophes; anything else becomes one space."""
    return _GAPS.sub(" ", text.lower()).encode()


@dataclass
class Languages:
    """Names of the learned languages, most frequent first, and the content of their dictionaries."""

    names: list[str]
    contents: list[bytes]

    def compressors(self) -> list[zstd.ZstdCompressor]:
        made = []
        for content in self.contents:
            words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            how = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            words.precompute_compress(compression_params=how)
            made.append(zstd.ZstdCompressor(dict_data=words, compression_params=how))
        return made


def sizes(compressors: list[zstd.ZstdCompressor], text: bytes) -> list[int]:
    """Compressed bytes of a folded text under each language, summed over all its blocks."""
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def held_out(key: Column) -> Column:
    """Whether a row's language is kept from every fit; a null key is not held out, and not learned from either."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", pieces: int = PIECES) -> Languages:
    """Dictionaries from at most ``pieces`` different texts of each language, a piece of each; none of a row that is held out.

    Texts are drawn by a hash of the text, so copies count once and reruns agree; a bound on the hash, from the number of
    different texts, comes before any sorting. Rows with a null key, text or language, or a text without a letter, teach
    nothing. The result has one dictionary per language: the number of languages must be small, as it is of codes.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    open_rows = docs.where("key is not null and text is not null and lang is not null").where(~held_out(F.col("key")) & F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64("text")
    known = {r.lang: (r.rows, r.texts) for r in open_rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(place).alias("texts")).collect()}
    if not known:
        return Languages([], [])
    share = F.create_map(*[x for name, (_, n) in known.items() for x in (F.lit(name), F.lit(min(4 * pieces / max(n, 1), 1.0)))])
    drawn = open_rows.where(F.abs(place / F.lit(2.0**63)) < share[F.col("lang")])
    start = F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1
    drawn = drawn.groupBy("lang", place.alias("place")).agg(F.min(F.substring("text", start.cast("int"), F.lit(PIECE))).alias("piece"))
    # The bound has left about four times as many as are wanted of each language.
    order = Window.partitionBy("lang").orderBy(F.abs("place"), "place")
    few = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= pieces).select("lang", "n", "piece").collect()
    names = sorted(known, key=lambda x: (-known[x][0], x))
    contents = [b" ".join(folded(r.piece) for r in sorted(few) if r.lang == name)[:DICT_BYTES] for name in names]
    return Languages(names, contents)


def identified(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of each row's whole text.

    ``lang_pred``: the learned language with the smallest size, ties to the more frequent one; ``und`` if the text is null
    or has no letter, or nothing was learned. ``score``: that language's share when each 16 bits more halve the odds.
    ``rejected``: its size is not at least 2 % below the next one's (never with one language), or it is ``und``. Repeated
    rows come out alike; an empty table gives an empty one; other columns are not read.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = given.value.names
        compressors = given.value.compressors()
        for batch in slices(batches):
            found, score, rejected = [], [], []
            for raw in texts_of(batch):
                whole = raw.decode("utf-8", "replace")
                if not names or not _LETTER.search(whole):
                    found.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                size = np.array(sizes(compressors, folded(whole)), dtype=np.float64)
                best = int(size.argmin())
                rest = np.delete(size, best)
                found.append(names[best])
                score.append(float(1.0 / np.exp2((size[best] - size) * 8.0 / HALVING).sum()))
                rejected.append(bool(len(rest) and size[best] > (1 - MARGIN) * rest.min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["key", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)
