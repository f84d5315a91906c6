"""The domain tables, derived from the star-schema tables by integer arithmetic, in Spark and as SQL text for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone import schemas as S
from marlstone.functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(n: str, labels: list[str]) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(labels)) + " END"


def _attribute(metric: str, shift: int, labels: list[str]) -> str:
    return f"CASE WHEN id % 13 = {shift} THEN NULL WHEN id % 97 = {shift} THEN 'Unclear' ELSE {_choose(f'(v + {shift} * k) % 4', labels)} END AS qna_{metric}_attribute"


def _issue(metric: str, shift: int, errors: list[str]) -> str:
    return f"CASE WHEN id % 11 = {shift} THEN NULL WHEN (v + {shift}) % 3 = 0 THEN 'No issue' WHEN v % 5 = 0 THEN '{errors[0]}; {errors[2]}' WHEN v % 29 = 0 THEN 'Typo' ELSE {_choose(f'(v + {shift}) % 4', errors)} END AS qna_{metric}_issue"


# Labels with some older names among them, so that aliases are at work.
_OLD = {"usefulness": ["Highly actionable", "Useful", "Limited usefulness", "Not useful"], "recommendation": ["Yes", "Yes, but with minor edits", "Only after major revisions", "No"]}
_SAFETY = ["Unsafe Medical or Health Advice", *S.ERRORS["care_safety"][1:]]
RATING_BASE = ["event_id AS id", "user_id AS u", "ts AS created_at", "event_type AS event_type", "CAST(floor(value) AS BIGINT) AS seconds_spent", "CAST(round(value * 100) AS BIGINT) AS v", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k"]
RATING_COLUMNS = [
    "id", "concat('s', CAST(u AS STRING)) AS session_id", "concat('a', CAST(u % 12 AS STRING)) AS annotator", "concat('q', CAST(k AS STRING)) AS qa_uid",
    "CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END AS dataset", "CASE WHEN k % 2 = 0 THEN 'SingleAgent' ELSE 'MultiAgent' END AS approach", "concat('b', CAST(u % 3 AS STRING)) AS batch",
    "created_at", "seconds_spent",
    *[_attribute(m, i, _OLD.get(m, S.SCALES[m])) for i, m in enumerate(S.ORDINAL)], *[_issue(m, i, _SAFETY if m == "care_safety" else S.ERRORS[m]) for i, m in enumerate(S.BINARY)],
    *[f"CASE WHEN id % 17 = {i} THEN NULL WHEN (v + {i} * k) % 4 < 2 THEN 'Yes' ELSE 'No' END AS qna_{m}_binary" for i, m in enumerate(S.BINARY)],
    f"CASE WHEN id % 19 = 0 THEN NULL ELSE {_choose('(v + 3 * k) % 4', _OLD['recommendation'])} END AS caregiver_recommendation",
]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating log out of the events: raters are users, pairs the keys of props."""
    return table(spark, sf_dir, "events").selectExpr(*RATING_BASE).selectExpr(*RATING_COLUMNS)


RATINGS = f"ratings AS (SELECT {', '.join(RATING_COLUMNS).replace('STRING', 'VARCHAR')} FROM (SELECT {', '.join(RATING_BASE)} FROM events))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, line_no, start_sec, end_sec, text): the lines of documents, 0.4 s a word."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select(F.col("doc_id").alias("video"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    ms = word_count(F.col("text")) * 400
    end = F.sum(ms).over(Window.partitionBy("video").orderBy("at"))
    return lines.select("video", (F.col("at") + 1).alias("line_no"), ((end - ms) / 1000).alias("start_sec"), (end / 1000).alias("end_sec"), "text")


WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"
SEGMENTS = f"""segments AS (SELECT video, line_no, (SUM(ms) OVER (PARTITION BY video ORDER BY line_no) - ms) / 1000.0 AS start_sec, SUM(ms) OVER (PARTITION BY video ORDER BY line_no) / 1000.0 AS end_sec, text
 FROM (SELECT *, CAST({WORDS.format('text')} * 400 AS BIGINT) AS ms FROM (SELECT doc_id AS video, unnest(x) AS text, unnest(range(1, len(x) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))))"""


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, video, approach, n, question, answer, time_start_sec, time_end_sec): user turns with the assistant turn that follows."""
    rows = table(spark, sf_dir, "conversations")
    a = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])
    return pairs.selectExpr(*QA_COLUMNS)


QA_COLUMNS = [
    "CASE WHEN conv_id % 3 = 0 THEN 'north' ELSE 'south' END AS dataset", "conv_id AS video", "CASE conv_id % 4 WHEN 0 THEN 'SingleAgent' WHEN 1 THEN 'DualAgent' WHEN 2 THEN 'MultiAgent' ELSE 'RAG' END AS approach",
    "turn AS n", "question", "answer", "CASE WHEN conv_id % 4 = 3 THEN NULL ELSE turn * 10.5 END AS time_start_sec", "CASE WHEN conv_id % 4 = 3 THEN NULL ELSE turn * 10.5 + 8 END AS time_end_sec",
]
QA = f"qa AS (SELECT {', '.join(QA_COLUMNS)} FROM (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'))"
CORPUS = (
    QA + ", corpus AS (SELECT dataset, video, approach, n, trim(question) AS question, trim(answer) AS answer, CAST(trunc(time_start_sec) AS BIGINT) AS t, CAST(trunc(time_end_sec) AS BIGINT) AS te, "
    "concat(dataset, '_v', video, '_', approach, '_q', n) AS uid FROM qa WHERE trim(question) <> '' AND trim(answer) <> '')"
)


def scored_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, segment, id, score): suppliers are videos, line numbers segments, orders questions."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return one.selectExpr("l_suppkey AS video", "CAST(l_linenumber AS BIGINT) AS segment", "l_orderkey * 10 + l_linenumber AS id", "CAST(1 + CAST(q AS BIGINT) % 10 AS DOUBLE) AS score")


POOL = "pool AS (SELECT l_suppkey AS video, CAST(l_linenumber AS BIGINT) AS segment, l_orderkey * 10 + l_linenumber AS id, CAST(1 + CAST(MAX(l_quantity) AS BIGINT) % 10 AS DOUBLE) AS score FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber)"


def blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, id, segment, title, topic, start_line, end_line, total_lines): line ranges over whole documents, seven at least, with gaps, overlaps and equal titles."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("video"), F.size(F.split("text", "\n")).cast("long").alias("total_lines"))
    return docs.withColumn("id", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("greatest(7, total_lines div 3 + 1)")))).selectExpr(*BLUEPRINT_COLUMNS)


BLUEPRINT_COLUMNS = [
    "video", "id", "id AS segment", "concat('t', CAST((video + id * id) % 3 AS STRING)) AS title", "concat('t', CAST((video + id * id) % 3 AS STRING)) AS topic",
    "(id - 1) * 3 + (video + id) % 4 AS start_line", "(id - 1) * 3 + (video * id) % 5 AS end_line", "total_lines",
]
BLUEPRINT = f"blueprint AS (SELECT {', '.join(BLUEPRINT_COLUMNS).replace('STRING', 'VARCHAR')} FROM (SELECT *, unnest(range(1, greatest(7, total_lines // 3 + 1) + 1)) AS id FROM (SELECT doc_id AS video, len(string_split(text, chr(10))) AS total_lines FROM documents WHERE text IS NOT NULL)))"


def caption_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("video"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 41 != 0, F.unix_millis(F.col("ts").cast("timestamp")) - F.lit(1704067200000)).alias("t_start_ms"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 5000).alias("d_duration_ms"), F.when(F.col("event_id") % 43 != 0, F.array(F.col("event_type"), F.lit("\n"), F.when(F.col("event_id") % 7 != 0, F.lit(" ok  now ")).otherwise(F.lit("")))).alias("texts"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, video, url, language): conversations 0 to 3/4 of all have a link, some videos none."""
    videos = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return videos.selectExpr(*MANIFEST_COLUMNS)


MANIFEST_COLUMNS = [
    "CASE WHEN conv_id % 3 = 0 THEN 'north' ELSE 'south' END AS dataset", "conv_id AS video", "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE concat('https://video.example.com/', CAST(conv_id AS STRING)) END AS url",
    "CASE WHEN conv_id % 5 = 0 THEN 'chinese' ELSE 'english' END AS language",
]
MANIFEST = f"manifest AS (SELECT {', '.join(MANIFEST_COLUMNS).replace('STRING', 'VARCHAR')} FROM (SELECT DISTINCT conv_id FROM conversations))"
