"""A training-data pipeline over documents: five stages, each written as a table before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import quality
from ratewright.llm.common import stored, table
from ratewright.llm.mixing import mixed
from ratewright.llm.segment import sampled
from ratewright.llm.simhash import shingle_classes
from ratewright.llm.substring import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates share four fifths of their distinct five-word shingles; fingerprints only find candidates. At just that
#: share 256-bit fingerprints differ in 39 bits on average (48 for four shingles of five, the worst case), with a deviation
#: of 6; the radius lies nearly six deviations above the worst case. Only texts that share a band key are compared.
SHINGLE, LANES, RADIUS, SHARE = 5, 4, 84, 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a grade above the lowest reaches the bar; null and wordless texts go.

    Rows with a null doc_id are judged like any other, repeated rows come out alike, an empty table gives an empty one, and
    columns other than those of documents are dropped. Labels say good or not and toxic or not; the middle grade, good but
    toxic, is made of the two.
    """
    model = quality.fit(docs, quality.label_grades(table(spark, sf_dir, "labels")))
    return quality.graded(docs.select(COLUMNS), model).where(F.col("tails")[0] >= quality.KEEP).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, each of its texts once.

    A doc_id with several texts stays, with all of them, if it is the smallest for one of them. Rows with a null doc_id stay
    as they are, and take no other row with them; null and empty texts are copies of one another. An empty table gives an
    empty one; columns other than those of documents are dropped.
    """
    classes = shingle_classes(docs, RADIUS, SHARE, shingle=SHINGLE, lanes=LANES).where("doc_id is not null")
    gone = classes.groupBy("doc_id").agg(F.max("component_id").alias("last")).where("last < doc_id").select("doc_id")
    left = docs.select(COLUMNS).where("doc_id is not null").join(gone, "doc_id", "left_anti")
    return left.dropDuplicates(["doc_id", "text"]).select(COLUMNS).union(docs.where("doc_id is null").select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what earlier documents say in the same 13 words or more; documents of which nothing is left go.

    Null and wordless texts have nothing to lose and stay. Rows that repeat a doc_id are one document to the windows, so none
    is cut for the other. An empty table gives an empty one; columns other than those of documents are dropped.
    """
    cut = without_repeats(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept"))
    left = cut.where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", text.alias("text"), "lang", "source", size.cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its words are taken, to the nearest whole time: rows repeat, or go where that is zero.

    Wordless and null texts have no words to take and go. Rows of one doc_id, those without one among them, are judged by
    their words together. A null source is a source like others. An empty table gives an empty one; columns other than those
    of documents are dropped.
    """
    taken = mixed(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    rows = docs.select(COLUMNS).join(taken.select(F.col("doc_id").alias("_id"), times.alias("times")), F.col("doc_id").eqNullSafe(F.col("_id")))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two different sampled encodings of each row's text, with their scores, and whether both decode to it.

    A null text is encoded as the empty one. Repeated rows come out alike, as samples are seeded by the row's key. An empty
    table gives an empty one; columns other than those of documents are dropped, as is the text.
    """
    return sampled(docs.select(COLUMNS)).drop("text")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", encoded),
]

#: Neither the classifier nor fingerprints nor sampled encodings can be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
