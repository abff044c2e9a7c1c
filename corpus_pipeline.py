"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import decontaminate, langid, line_dedup, packing, similar_texts
from lexgrove.llm.common import cut, load

MIN_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is unsure."""
    model = langid.fit(docs)
    marked = langid.predict(docs.withColumn("lang_stage_text", F.col("text")), model, text_col="lang_stage_text")
    sure = (F.col("lang_pred") != "und") & ((F.col("score") >= MIN_SCORE) if model.langs else F.lit(True))
    return marked.where(sure).select(*docs.columns) if model.langs else docs.where(F.col("text").rlike(r"\p{L}"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents of which nothing is left go, n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines").drop("n_lines", "n_removed")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts whose sets of five-word shingles are 0.8 alike or more."""
    return similar_texts.drop_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: The model, the fingerprints and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
