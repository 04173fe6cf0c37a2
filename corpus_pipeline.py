"""A corpus pipeline of five stages; each stage takes all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import decontaminate, jaccard, mixing, quality, suffixes
from linkspark.llm.common import save


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score of 0.3 or more)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _identified(docs: DataFrame) -> DataFrame:
    """docs with an id of each row's own content where doc_id is null: such rows are judged too, behind all others."""
    cells = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    made = F.shiftrightunsigned(F.xxhash64(*cells), 2) + F.lit(2**62)
    return docs.withColumn("linkspark_id", F.coalesce(F.col("doc_id").cast("long"), made)).withColumn("linkspark_order", F.xxhash64(*cells))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Rows that repeat a doc_id are one
    document, of which one row stays; rows without an id are judged by an id made of their content and stay if nothing
    before them is a near duplicate."""
    own = _identified(docs)
    judged = jaccard.near_duplicates(own.select(F.col("linkspark_id").alias("doc_id"), "text"))
    first = judged.where("kept").select(F.col("doc_id").alias("linkspark_id")).distinct()
    kept = own.join(first, "linkspark_id", "left_semi")
    one = kept.groupBy("linkspark_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "linkspark_order").alias("row"))
    return one.select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the strings that an earlier one holds."""
    return suffixes.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id are judged by their content."""
    own = _identified(docs)
    found = decontaminate.hits(own.select(F.col("linkspark_id").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean = own.join(found.select(F.col("doc_id").alias("linkspark_id")).distinct(), "linkspark_id", "left_anti")
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each drawing of a document: shard, place, the document's columns, words, and taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing_to_targets", mixing_to_targets),
]
#: Compression, SimHash and permuted draws are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again, so that no stage is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, _ = save(docs)
    return docs
