"""The queries of this subpackage, over whole tables and with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import (
    alignment,
    fingerprints,
    language,
    nbest,
    neardup,
    neighbours,
    packing,
    quality,
    simhash,
    token_counts,
    token_files,
    warc,
    whitening,
)
from gatelens.llm.common import written
from gatelens.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL checks by query. None of these operators can be expressed in SQL; tests use brute force.
CHECKS: dict[str, str] = {}


def registered(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@registered
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@registered
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


@registered
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, percent=85)


@registered
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@registered
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    back = token_files.read_token_files(spark, path)
    return back.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@registered
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out("doc_id")
    model = language.train(docs.where(~out), "text", "lang")
    found = language.identify(docs.drop("lang"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@registered
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = written(quality.classify(docs, model).drop("text"), "quality")
    return quality.resample(scored, scored.where("kept").count() // 4)


@registered
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_bundles(table(spark, sf_dir, "pages"), path)
    return warc.read_bundles(spark, path)


@registered
def op10_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = nbest.encode_nbest(docs, public_tokenizers.path("piece_bpe_32k.model"))
    first = F.col("nbest")[0]
    return found.select(
        "doc_id",
        F.size("nbest").alias("n_best"),
        (F.octet_length(first["ids"]) / 4).cast("long").alias("n_pieces"),
        F.transform("nbest", lambda x: x["score"]).alias("scores"),
        F.transform("nbest", lambda x: F.crc32(x["ids"])).alias("ids_crc32"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        F.sha1("decoded").alias("decoded_sha1"),
    )


@registered
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors)


@registered
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.align(docs, *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")


@registered
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs)
