"""A corpus from raw documents to packed token sequences, stage by stage."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import language, neardup, packing, quality
from gatelens.llm.common import written

#: A language must be likelier than all others together.
SURE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose importance weight the fitted threshold accepts; all their columns stay as they are.

    The labels beside the documents fit the two models and the threshold. A filter must keep every
    clean document, so the weights decide by threshold here; the Gumbel top-k draw from the same
    weights, which keeps a document by chance, is for callers who want a sample (``quality.resample``).
    Null, empty and short texts say little and score near 0; equal texts are treated alike; ids may be
    null or repeat, such rows are scored by their own text. Without good or bad labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    found = _free(docs, "_quality")
    scored = docs.withColumn(found, quality.scorer(docs, model, "text"))
    return scored.where(F.col(found)["score"] >= model.threshold).drop(found)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters (null and empty texts, too) or without a
    clear language go.

    The model learns from the ``lang`` of all documents that have one and then reads the same ones, so
    a wrong ``lang`` of a document has a say in its own prediction; the prediction never replaces
    it. Where no document has a language there is nothing to learn from, and all stay.
    """
    model = language.train(docs, "text", "lang")
    if not model.languages:
        return docs
    found = _free(docs, "_language")
    read = docs.withColumn(found, language.predictor(docs, model, "text"))
    pred, score = F.col(found)["lang_pred"], F.col(found)["score"]
    return read.where((pred != language.UNKNOWN) & (score > SURE)).drop(found)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id; null ids come last.

    Rows that repeat an id, or have none, count by their own text. Texts without shingles stay, but
    of rows that repeat an id and such a text one stays.
    """
    if not (
        docs.where("doc_id IS NULL").take(1)
        or docs.groupBy("doc_id").count().where("count > 1").take(1)
    ):
        found = neardup.near_duplicates(docs)
        dropped = written(found.where(~F.col("kept")).select("doc_id"), "dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # numbers of stored rows do not change when a task runs again
    number = _free(docs, "_row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col(number).alias("_row"), "doc_id", "text")
    found = neardup.near_duplicates(keyed.select("_row", "text"), id_col="_row")
    facts = keyed.select("_row", "doc_id", F.xxhash64("text").alias("_text"))
    blank = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = F.struct(
        F.when(~blank, F.col("component_id")).alias("root"),
        F.when(blank, F.col("doc_id")).alias("id"),
        F.when(blank, F.col("_text")).alias("text"),
    )
    placed = written(found.join(facts, "_row").withColumn("_group", group), "placed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    first = placed.groupBy("_group").agg(least.alias("least")).select("least._row")
    dropped = written(placed.join(first, "_row", "left_anti").select(F.col("_row").alias(number)), "dropped")
    return rows.join(dropped, number, "left_anti").drop(number)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids from all documents that are left.

    A null or empty text is its end id alone; repeated rows are packed each, and null ids stay null.
    """
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("packing", packed),
]

#: No stage but the last is SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
