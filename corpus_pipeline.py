"""Corpus pipeline: language, quality, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages remove documents by id;
a document without an id cannot be addressed and stays.

Cases, for every stage: a null or empty text has no language, so the first stage drops it, and the others take it as
the empty text; texts are taken whole; an empty table gives an empty table; columns beside doc_id and text are passed
on as they are, whatever their names. Rows that share an id go together, except among near-duplicates, where texts
are compared one by one and rows that share an id and a text become the one that sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetline.llm import decontaminate, langid, neardup, quality, sentencepiece_codec
from facetline.llm.queries import fold, piece_model
from facetline.llm.staging import materialise, small_side

#: Language scores and quality scores below which documents go. Words that fit every learned language alike score the
#: share of one of them, 0.25 with four; a third is above that and what texts in other languages of their script reach.
LEAST_LANGUAGE, LEAST_QUALITY = 0.33, 0.5


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``removed``."""
    return docs.join(small_side(materialise(removed.select("doc_id").distinct(), "removed")), "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose words fit no learned language well."""
    found = langid.identify(docs, langid.train(docs, fold(F.col("doc_id"), 3) != 1))
    return without(docs, found.where((F.col("lang_pred") == langid.UND) | (F.col("score") < LEAST_LANGUAGE)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely of label 0 than of label 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = materialise(quality.statistics_table(docs), "statistics")
    scored = quality.score(stats, quality.train(stats, labels, fold(F.col("id"), 4) != 2))
    return without(docs, scored.where(F.col("score") < LEAST_QUALITY).withColumnRenamed("id", "doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Where an id stands for several rows, each of its texts is compared, under a negative id of its own.
    """
    columns = docs.columns
    repeated = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return without(docs, neardup.near_duplicates(docs, words=5, percent=80).where("NOT kept"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = docs.join(small_side(repeated), "doc_id", "left_semi").select(F.struct(*columns).alias("row"), text.alias("digest"))
    first = F.row_number().over(W.partitionBy("row.doc_id", "digest").orderBy(F.to_json("row")))
    shared = shared.withColumn("rank", first).where("rank = 1").select("row", (-F.abs(F.xxhash64("row.doc_id", "digest") / 2).cast("long") - 1).alias("doc_id"))
    single = docs.join(small_side(repeated), "doc_id", "left_anti").select(F.struct(*columns).alias("row"), "doc_id")
    own = materialise(single.unionByName(shared), "texts")
    found = neardup.near_duplicates(own.select("doc_id", "row.text"), words=5, percent=80)
    return without(own, found.where("NOT kept")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digests of the ids and of the text decoded from them."""
    both = sentencepiece_codec.encode_and_decode(docs, piece_model())
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), sentencepiece_codec.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Learned stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
