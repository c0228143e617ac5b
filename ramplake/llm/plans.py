"""The corpus operators bound to the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ramplake.llm import bpe, licenses, linededup, mixing, periodic, quality, records, rules, runindex, simhash, sketch, topk, trie
from ramplake.llm.common import cut_lineage, fresh_folder, load, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def word_model() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_bpe_lexicon")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = load(spark, sf_dir, "documents"), word_model()
    return bpe.encode(docs, path, lexicon=bpe.frequent_lexicon(docs, path), decode_too=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_pu_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, load(spark, sf_dir, "labels")))


@query("op3_simhash_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query("op5_curriculum_mix", mixing.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut_lineage(load(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("words"), F.monotonically_increasing_id().alias("row")))
    mixed = cut_lineage(mixing.mix(sizes, size=F.col("words")))
    # what a document gives to the mix is read from the rows in training order, one for each time that it is taken
    ordered = cut_lineage(mixing.in_training_order(mixed))
    taken = ordered.groupBy("doc.row").agg(F.count("*").alias("copies"), F.min("position").alias("position"))
    found = mixed.withColumn("row", F.col("doc.row")).join(taken, "row", "left")
    return found.select("doc.doc_id", "size", "source_size", "target", (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"), "position")


@query("op6_token_records")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-records")
    records.write_records(load(spark, sf_dir, "documents"), folder, records.bpe_encoder(word_model()), end_id=1)
    read = records.read_records(spark, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op9_safe_rules", rules.oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.filter_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_norm_sorted_topk", topk.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "embeddings"))


@query("op8_winnowed_lines", linededup.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("cleaned", 256).alias("cleaned_sha256"))


@query("op7_license_digests", licenses.oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


@query("op10_run_index")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runindex.remove_repeats(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_periodic_runs", periodic.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(load(spark, sf_dir, "documents"), words=periodic.planted)
    listing = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", "runs", "collapsed", periodic.strongest().alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_scaled_sketch")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.compare_with_next(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("sketch")).alias("fingerprint"),
        F.lower(F.hex("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op13_prefix_trie", trie.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(load(spark, sf_dir, "conversations"))
