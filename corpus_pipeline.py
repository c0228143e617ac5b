"""The corpus pipeline: five stages over documents, each calling one operator of ramplake.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the shared folder and read
again as the next stage's docs, so a lost executor never costs more than a stage and no plan grows. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ramplake.llm import bpe, jaccard, linededup, mixing, quality
from ramplake.llm.common import fresh_folder, load, unpacked

#: The classifier is trained and the tokenizer merges in Python, so SQL cannot express the rows.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above stay as they are."""
    return quality.keep_good(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred earlier go from the texts. A document that loses every line it had goes with them."""
    found = linededup.dedup_lines(docs)
    stays = found.filter((F.col("n_removed") == 0) | (F.trim(F.replace("cleaned", F.lit("\n"), F.lit(""))) != ""))
    changed = F.col("n_removed") > 0
    columns = {"text": F.when(changed, F.col("cleaned")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return stays.select(*(columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays, as
    it is. Fingerprints that op3's index matches are compared exactly; pairs too far apart for it are found by a prefix filter."""
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each time that the mix takes one."""
    ordered = mixing.in_training_order(mixing.mix(docs))
    return unpacked(ordered, "doc", docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, in the rows' order, with the text that they decode to as a digest."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(docs, path, lexicon=bpe.frequent_lexicon(docs, path), decode_too=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = load(spark, sf_dir, "documents"), fresh_folder(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
