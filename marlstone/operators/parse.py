"""Question/answer pairs out of model responses: lines, blocks of a question, joined answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import ANSWER_LINE, QUESTION_LINE, TIMESTAMP_LINE, normalize_edges, parse_mmss_range


def response_lines(responses: DataFrame, key: str = "response_id", text: str = "text") -> DataFrame:
    return responses.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).withColumn("line", normalize_edges(F.col("raw")))


def parse_qa_pairs(responses: DataFrame, cap: int = 20, key: str = "response_id", text: str = "text") -> DataFrame:
    """(key, n, question, answer): a question owns the answer of its own block; the first ``cap`` answered questions, numbered from 1.

    A block is a question line and what follows up to the next one; its answer is the rest of the first answer line and all non-blank
    lines after it but timestamps. One shuffle by response: all windows and groups share it.
    """
    lines = response_lines(responses, key, text).filter(~F.col("line").rlike(TIMESTAMP_LINE))
    w = Window.partitionBy(key).orderBy("pos")
    asks = F.col("line").rlike(QUESTION_LINE)
    lines = lines.withColumn("block", F.sum(asks.cast("int")).over(w)).filter("block > 0").withColumn("asks", asks)
    answers = ~F.col("asks") & F.col("line").rlike(ANSWER_LINE)
    first = F.min(F.when(answers, F.col("pos"))).over(Window.partitionBy(key, "block"))
    lines = lines.withColumn("answer_at", first)
    rest = F.when(F.col("pos") == F.col("answer_at"), normalize_edges(F.regexp_replace("line", r"^[^:]*:?", ""))).otherwise(F.col("line"))
    part = F.when((F.col("pos") >= F.col("answer_at")) & (rest != ""), F.struct(F.col("pos").alias("pos"), rest.alias("text")))
    question = normalize_edges(F.regexp_replace(F.regexp_replace("line", QUESTION_LINE, ""), r"^[\s:*_]+|[\s*_]+$", ""))
    pairs = lines.groupBy(key, "block").agg(
        F.max(F.when(F.col("asks"), question)).alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), " ").alias("answer")
    )
    pairs = pairs.filter("question <> '' and answer <> ''")
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("block"))).filter(F.col("n") <= cap).select(key, "n", "question", "answer")


def attach_timestamps(pairs: DataFrame, responses: DataFrame, key: str = "response_id", text: str = "text") -> DataFrame:
    """pairs with timestamp and its start and end in seconds: by number if a response's numbers are distinct and enough, else by place."""
    marks = response_lines(responses, key, text).select(key, "pos", F.regexp_extract("line", TIMESTAMP_LINE, 1).try_cast("int").alias("number"), F.regexp_replace(F.regexp_extract("line", TIMESTAMP_LINE, 2), r"^[*_\s]+|[*_\s]+$", "").alias("value")).filter("value <> ''")
    w = Window.partitionBy(key)
    marks = marks.withColumn("place", F.row_number().over(w.orderBy("pos"))).join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("pairs")), key)
    good = (F.size(F.collect_set("number").over(w)) == F.count("number").over(w)) & (F.count("number").over(w) >= F.col("pairs"))
    at = marks.select(key, F.when(good, F.col("number")).otherwise(F.col("place")).alias("n"), F.col("value").alias("timestamp")).filter("n is not null")
    start, end = parse_mmss_range(F.col("timestamp"))
    return pairs.join(at, [key, "n"], "left").withColumns({"time_start_sec": start, "time_end_sec": end})


def parse_shortfall(pairs: DataFrame, expected: DataFrame, key: str = "response_id") -> DataFrame:
    """expected(key, expected) with found, where fewer pairs came out than expected."""
    n = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    return expected.join(n, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found < expected")
