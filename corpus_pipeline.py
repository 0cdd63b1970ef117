"""The corpus pipeline: quality, language, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return rows
with the columns of docs.  ``run`` applies them to the documents table, writing each stage's rows as
Parquet in the shared folder and reading them again for the next.  Every stage takes empty tables, nulls in any
column, repeated rows, extra columns of any name and ids of any type with an order; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import language, quality
from fieldloom.llm.common import stored
from fieldloom.llm.decontaminate import hits
from fieldloom.llm.jaccard_join import similar_documents
from fieldloom.llm.packing import packed
from fieldloom.llm.rows import without

#: A text stays if this share of its letters, unknown ones included, is in one learned language.
LEAST_SHARE = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with column names that clash with nothing, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking, learned from the labels table, does not reject."""
    plain, at = _plain(docs)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(plain, model, at["doc_id"], at["text"]).where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of which a fair share is in one of the languages that the table names."""
    plain, at = _plain(docs)
    model = language.learn(docs)
    found = language.languages(plain, model, at["text"], spans=False)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*plain.columns).toDF(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that of the least id; wordless documents all stay."""
    found = stored(similar_documents(docs).where("class_key is not null").select(F.col("doc_id").alias("id"), "mark", "class_key"), "similar")
    best = stored(found.groupBy("class_key").agg(F.min(F.struct("id", "mark")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n"), "best")
    keys = found.groupBy("class_key", "id", "mark").agg(F.count("*").alias("times")).join(best, "class_key")
    first = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    return without(docs, stored(keys.where(~first | (F.col("times") > 1)).select("id", "mark", (~first).alias("drop")), "touched"), "doc_id", "text")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stored(found.select("id", "mark", F.lit(True).alias("drop")).distinct(), "contaminated"), "doc_id", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its length bucket, batch and slot."""
    return packed(docs)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_similar), ("decontamination", decontaminated), ("packing", packing)]

#: SQL expresses neither the trained stages nor the dynamic programme; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
