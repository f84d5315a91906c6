"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Language identification drops what it rejects; line dedup cuts repeated runs of lines; of each class of near copies one document stays;
documents that leak benchmark items go; what is left is encoded and decoded again. Every stage works on all rows it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import default_tokenizer, encoded_digests
from marlstone.llm.decontaminate import find_leaks
from marlstone.llm.jaccard import jaccard_classes
from marlstone.llm.langid import UNKNOWN, identify, train
from marlstone.llm.line_dedup import LINE, SHORT_RUN, dedup_lines
from marlstone.llm.shared import documents, materialize

#: A text is rejected if it has no letter, or if no language gets so much of the pooled probability.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is recognised. Null and empty texts and texts without letters go. A null lang becomes the prediction."""
    found = identify(docs, train(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of runs, or long single lines, that occur before; those with nothing left go; n_chars is counted anew."""
    cut = dedup_lines(docs, SHORT_RUN, LINE).filter((F.col("n_removed_lines") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class. Rows that share a doc_id stay or go together; rows without one stay."""
    copies = jaccard_classes(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark table in sf_dir."""
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("leaks") == 0).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return encoded_digests(docs, default_tokenizer())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("bpe", bpe)]
#: A trained network and a tokenizer are no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
