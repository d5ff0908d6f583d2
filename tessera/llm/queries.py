"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, centroids, collocations, fingerprints, flac, licenses, mixing, near, ngrams, passages, quality, warc
from tessera.session import table, with_checkpoints

#: The vocabulary file of the encoding query.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scores(table(spark, sf_dir, "documents"), quality.remainder("doc_id", 7) == 2)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoints(spark)
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoints(spark)
    out = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.remainder("doc_id", 5) != 0)
    return out.select("doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoints(spark)
    return flac.digests(table(spark, sf_dir, "documents"))


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoints(spark)
    return near.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits(table(spark, sf_dir, "pages"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoints(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoints(spark)
    return passages.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_trie_scores, op2_bpe_round_trip, op3_nearest_vectors, op4_quality_discriminant, op5_flac_media, op6_license_notices, op7_jaccard_classes,
        op8_revisit_resolution, op9_source_mix, op10_shared_passages, op11_incremental_centroids, op12_order_minhash, op13_collocations,
    )
}
ORACLES: dict[str, str] = {"op8_revisit_resolution": warc.ORACLE, "op11_incremental_centroids": centroids.oracle(), "op13_collocations": collocations.ORACLE}
