"""From raw documents to packed sequences: reject toxic texts, drop boilerplate lines, keep one of near copies, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import line_dedup, packing, simhash, toxicity
from lattica.llm.common import durable
from lattica.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.3, with the columns they have."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))  # so that no column meets those of the scores
    return toxicity.toxicity_scores(rows, labels, threshold=0.3).where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are on over a fiftieth, and five, of their source's different texts; n_chars is counted anew."""
    rows = docs.select("source", "text", F.struct(*docs.columns).alias("row"))
    cleaned = line_dedup.drop_boilerplate(rows, "source", ratio=0.02, min_pages=5, distinct_texts=True)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return cleaned.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by five-word shingles."""
    return simhash.keep_one(docs, words=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), room=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_copy),
    ("packing", pack_sequences),
]

#: Kneser-Ney scores, XXH64 with a seed and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on the table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
