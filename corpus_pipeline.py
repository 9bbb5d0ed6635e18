"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import decontam, lang_ppm, line_dedup, lsh_forest, mixing
from starloom.llm.common import Workspace, fresh


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose best language has a posterior under one half."""
    names = docs.columns
    model = lang_ppm.fit(docs.where(~lang_ppm.held_out(F.col("doc_id"))))
    return lang_ppm.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*names)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document of which nothing but blank lines is left goes."""
    names = docs.columns
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"\S"))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text")), "n_chars": F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")) if "n_chars" in names else None}
    return kept.select(*(new[c].alias(c) if new.get(c) is not None else F.col(c) for c in names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that with the smallest doc_id, of several rows of this id the one with the smallest hash of its text."""
    ws = Workspace(spark, "stage-groups")
    groups = ws.table(lsh_forest.near_duplicates(docs).select("doc_id", "class_id", "group_key", "mark"), "groups")
    texts = groups.groupBy("group_key", "doc_id", "class_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    least = texts.where(F.col("group_key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    least = least.groupBy("group_key").agg(F.min(F.struct("mark", "n")).alias("least"), F.first("doc_id").alias("doc_id")).select("doc_id", "least.mark", "least.n")
    kept = ws.table(least.unionByName(texts.where(F.col("group_key").isNull()).select("doc_id", "mark", "n")), "kept")
    id_, mark = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_mark")

    def of(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark))
        return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"].cast("string")) == F.col(mark)), "left_semi")

    once, repeated = kept.where("n = 1"), kept.where("n > 1")
    if not repeated.limit(1).count():
        return of(once)
    return of(once).unionByName(of(repeated).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    names = docs.columns
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(*names)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated probabilities; returns the documents' columns, topic and probability."""
    names = docs.columns
    mixed = mixing.mix_sources(docs)
    return mixed.where("__sampled").select(*names, F.col("__topic").alias("topic"), F.col("__probability").alias("probability"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix)]

#: DuckDB SQL cannot express the language model or the raking; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
