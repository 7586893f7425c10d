"""Token counts of whole texts for a sentencepiece model, by a whole-token shortcut.

No piece of the model holds the word mark behind another character (proved when the vocabulary is read), so merges
never cross from one pre-token (word marks, then other characters) to the next and their counts add up. Which
vocabulary strings encode alone as one token is proved offline by encoding each. In a text such pre-tokens count one
each at once; only the rest is merged, each distinct string once per task while the memory of counts lasts. That memory
is bounded in characters, and long strings aren't kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import slices

MARK = "▁"
PRE_TOKEN = re.compile(r" +[^ ]*")
#: Characters of merged strings that a task keeps; when full it starts again.
KEPT_CHARS = 1 << 22
#: Longest pre-token that is kept: texts without spaces are one pre-token each, and don't come twice.
LONGEST = 64


def single_tokens(model: sentencepiece.SentencePieceProcessor) -> dict[str, int]:
    """Pre-tokens (spaces for word marks) proved to encode as one token: {string: 1}."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross from word to word, so counts of words don't add up: {crossing[:3]}")
    whole = [p.replace(MARK, " ") for p in pieces if p.startswith(MARK)]
    return {w: 1 for w, n in zip(whole, _merged(model, whole), strict=True) if n == 1}


def _merged(model: sentencepiece.SentencePieceProcessor, pre_tokens: list[str]) -> list[int]:
    """Token counts by the library. It puts a mark before each text, so the pre-token's first one is left out; a lone mark is one token."""
    ids = model.encode([p[1:] for p in pre_tokens], num_threads=1)
    return [len(x) if len(p) > 1 else 1 for p, x in zip(pre_tokens, ids, strict=True)]


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, dict[str, int]]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, single_tokens(model)


class Counter:
    def __init__(self, path: str):
        self.model, self.single = _model(path)
        self._start_anew()

    def _start_anew(self) -> None:
        self.rest, self.chars = dict(self.single), 0

    def count(self, texts: list[str]) -> list[int]:
        split = [PRE_TOKEN.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if self.chars > KEPT_CHARS:
            self._start_anew()
        todo = list(set().union(*split) - self.rest.keys())
        self.rest.update(zip(todo, _merged(self.model, todo), strict=True))
        get = self.rest.__getitem__
        counts = [sum(map(get, s)) for s in split]
        for t in todo:
            if len(t) > LONGEST:
                del self.rest[t]
            else:
                self.chars += len(t)
        return counts


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row's whole text.

    ``model`` is a file that every worker's tokenizer package has. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows and null keys give a row each; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(public_tokenizers.path(model))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["key", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
