"""The pipeline stage by stage against brute force, and on an empty table."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ramplake.llm import mixing, quality
from test_documents import lines_by_brute_force, words
from test_jaccard import kept_by_brute_force


@pytest.fixture(scope="module")
def sf_dir(spark, messy, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    messy.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(10, 40)] + [(None, 1), (41, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def keyed(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality_stage, line_stage, near_stage, mix_stage, encode_stage = stages.values()

    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {(r["doc_id"], r["text"]) for r in quality.keep_good(docs, model).collect()}
    first = quality_stage(spark, docs, sf_dir)
    assert first.columns == docs.columns and set(keyed(first)) == good

    # from here on all documents, so that every case meets every stage
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    second = line_stage(spark, docs, sf_dir).cache()
    cleaned, cut = lines_by_brute_force(rows)
    want = Counter((d, t if t is None else cleaned[(d, t)]) for d, t in rows if not cut[(d, t)] or cleaned[(d, t)].replace("\n", "").strip(" "))
    assert second.columns == docs.columns and keyed(second) == want and len(list(want.elements())) < len(rows)

    third = near_stage(spark, second, sf_dir).cache()
    left = [tuple(r) for r in second.select("doc_id", "text").collect()]
    assert third.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in third.collect()) == kept_by_brute_force(left)

    fourth = mix_stage(spark, third, sf_dir).cache()
    mixed = mixing.mix(third).select("doc.doc_id", "doc.text", F.size("positions").alias("n")).collect()
    assert fourth.columns == docs.columns
    assert keyed(fourth) == Counter({(r["doc_id"], r["text"]): r["n"] for r in mixed if r["n"] > 0})
    assert sum(len(words(r["text"])) for r in fourth.collect()) == pytest.approx(1.5 * sum(len(words(r["text"])) for r in third.collect()), rel=0.2)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    fifth = encode_stage(spark, fourth, sf_dir)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in fourth.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in fifth.collect()) == want


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").filter("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
