"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; `run` writes it to the shared folder
and reads it back as the next stage's docs, so no stage is computed twice and a lost executor
costs no more than its tasks. All but the last keep the columns of documents, whatever their names.

What each decides: documents without a recognisable language go, and lang becomes the language recognised; lines that other documents hold
too are cut from all but one; of rows that are near copies of each other the one with the smallest id stays (null ids
last, then by content), and of rows without words one of those equal in every column; rows that
hold a benchmark item go; what remains is encoded. n_chars follows the text. The second stage decides by id, so rows that share an id are one document
to it; the others decide by row, so one that shares its id with a row that goes may stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm import bpe, decontaminate, jaccard_join, language, line_dedup
from cantabile.llm.common import remove, shared_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language was recognised, and names it in lang."""
    model = language.train(docs)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    found = docs.select(row, language.predict(F.col("text"), model)["lang_pred"].alias("found")).where("found <> 'und'")
    return found.select(*((F.col("found") if c == "lang" else F.col("doc")[c]).alias(c) for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and ids_sha256."""
    out = bpe.with_tokens(docs.select("doc_id", "text"))
    return out.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("tokens", encode),
]

#: SQL can express neither language identification nor BPE; tests hold `run` against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = shared_path(spark, "pipeline")
    before = None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
            if before:
                remove(spark, before)
            before = f"{root}/{name}"
    except BaseException:
        remove(spark, root)  # nothing of a run that failed stays
        raise
    return docs
