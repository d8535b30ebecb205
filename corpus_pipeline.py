"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame; the
runner writes it as Parquet and reads it again for the next. All but the last return the columns of documents.

1. quality classifier: texts whose perplexity is above their language's threshold go. Null, empty and blank texts go as well; a null language is one of its own;
   rows with a null id are judged but are never trusted;
2. MinHash near-duplicates at a similarity of 0.8: one document of each group stays, the one with the smallest id (rows alike in all columns are one). Null and empty texts, and
   rows with a null id, are copies of nothing and stay;
3. suffix-array dedup: bytes that repeat 50 bytes of a smaller document go (a character cut in part goes whole), n_chars follows. Null texts become empty; texts of which
   nothing is left stay as empty rows; rows with a null id stay whole;
4. mixing: each document as often as its source's target weight asks; a null source is one of its own, a null id draws as an empty one;
5. byte-pair encoding: ids and their number, and a digest of the text that they decode to; null and empty texts have no ids.

Empty tables stay empty through all stages. Very long texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, minhash, mixing, parsing, perplexity
from tracewell.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return perplexity.judged(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs, percent=80, bands=40).where("not kept").select("doc_id").distinct()
    # Texts move once: rows alike have one id, by which the join has dealt them already.
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS).dropDuplicates()


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parsing.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, decoded="decoded_sha256")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("repeated spans", repeated_spans), ("mixing", mix), ("encoding", encode)]

#: The model, the parsing and the encoding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again in the folder of checkpoints."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
