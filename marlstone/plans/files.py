"""Queries that write the tables in the formats of ``sources.io`` or feed them as a stream, read them back, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone import schemas as S
from marlstone.operators import corpus as C
from marlstone.plans import adapters as A
from marlstone.plans import ratings as R
from marlstone.plans import transcripts as T
from marlstone.sources import io
from marlstone.sources.scratch import new_folder
from marlstone.streaming.ratings import read_latest, read_progress, stream_latest_ratings, stream_progress, stream_session

#: What the rating exports are compared by: ids and one label column of each kind.
EXPORTED = ["id", "session_id", "qa_uid", "annotator", *[f"qna_{m}_attribute" for m in S.ORDINAL], *[f"qna_{m}_binary" for m in S.BINARY], "caregiver_recommendation"]


def manifest_file(spark, d):
    path = new_folder(spark, "manifest")
    A.manifest(spark, d).selectExpr("video AS index", "url", "language").write.csv(path, header=True)
    return io.read_manifest(spark, path, "tolerant")


def rating_exports(spark, d):
    """Even ids as an export of today, odd ones under the old column names; both are read back as one log."""
    log = A.ratings(spark, d).select(*EXPORTED)
    old = {new: old for old, new in S.RENAMED.items() if new in EXPORTED}
    paths = [new_folder(spark, f"export{k}") for k in range(2)]
    log.filter("id % 2 = 0").write.csv(paths[0], header=True)
    log.filter("id % 2 <> 0").withColumnsRenamed(old).write.csv(paths[1], header=True)
    return io.read_ratings(spark, paths).select(F.col("id").cast("long").alias("id"), *EXPORTED[1:])


def rating_folder(spark, d):
    """One folder with exports of three vintages: today's columns, old names, and today's in another order."""
    log = A.ratings(spark, d).select(*EXPORTED)
    old = {new: old for old, new in S.RENAMED.items() if new in EXPORTED}
    path = new_folder(spark, "exports")
    for k, part in enumerate((log, log.withColumnsRenamed(old), log.select(*reversed(EXPORTED)))):
        part.filter(F.col("id") % 3 == k).write.mode("append").csv(path, header=True)
    return io.read_ratings(spark, [path]).select(F.col("id").cast("long").alias("id"), *EXPORTED[1:])


_DATASET = "CASE WHEN video % 3 = 0 THEN 'north' ELSE 'south' END AS dataset"
_PLACE = r"([^/]+)/([0-9]+)/([^/]+)/[^/]+/[^/]+$"


def transcript_files(spark, d):
    """A file for each video, as downloads leave them, written and read back."""
    folder = new_folder(spark, "videos")
    io.write_transcripts(A.segments(spark, d).selectExpr("*", _DATASET, "'en' AS lang"), folder)
    return io.read_transcripts(spark, folder)


def caption_files(spark, d):
    folder = new_folder(spark, "captions")
    io.write_caption_events(A.caption_events(spark, d).selectExpr("*", _DATASET), folder)
    video = F.regexp_extract("path", r"([0-9]+)/Transcript/[^/]+$", 1).cast("long").alias("video")
    return io.read_caption_events(spark, folder).select(video, "seq", "t_start_ms", "d_duration_ms", F.array_join("texts", "|").alias("texts"))


def qa_files(spark, d):
    """The result files of all approaches; a pair's number is its place in its file."""
    folder = new_folder(spark, "results")
    io.write_qa_results(A.qa_pairs(spark, d), folder)
    digests = [F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("question", "answer")]
    return io.read_qa_results(spark, folder).select("dataset", "video", "approach", "n", "time_start_sec", "time_end_sec", *digests)


_LOGS = [
    "conv_id AS video", "CASE WHEN conv_id % 3 = 0 THEN 'north' ELSE 'south' END AS dataset", "turn AS line_no",
    "CASE WHEN role = 'assistant' AND conv_id % 4 <> 0 THEN concat('{\"agent_seconds\": ', 3 * turn, '}') ELSE concat('step ', turn) END AS line", "'RAG' AS approach",
]


def run_log_files(spark, d):
    """A log for each conversation, whose last line of seconds counts."""
    folder = new_folder(spark, "logs")
    io.write_run_logs(A.table(spark, d, "conversations").selectExpr(*_LOGS), folder)
    return io.read_run_logs(spark, folder, "*.log").select(F.regexp_extract("path", _PLACE, 1).alias("dataset"), F.regexp_extract("path", _PLACE, 2).cast("long").alias("video"), "agent_seconds")


def generation_meta_files(spark, d):
    """A sidecar for each data set and approach with what the corpus measures."""
    folder = new_folder(spark, "sidecars")
    words = C.word_count(F.col("answer"))
    own = C.corpus_pairs(A.qa_pairs(spark, d)).groupBy("dataset", "approach").agg(F.count(F.lit(1)).cast("int").alias("pairs"), F.max(words).cast("int").alias("answer_words_max"), F.lit(42).alias("seed"))
    io.write_generation_meta(own, folder)
    found = io.read_generation_meta(spark, folder, "*_generation_meta.json")
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dataset"), "approach", "seed", "pairs", "answer_words_max")


def srt_files(spark, d):
    folder = new_folder(spark, "srt")
    io.write_srt(A.segments(spark, d).selectExpr("*", _DATASET), folder)
    files = io.whole_files(spark, folder, "*.srt")
    return files.select(F.regexp_extract("path", r"([0-9]+)/Transcript/[^/]+$", 1).cast("long").alias("video"), F.md5(F.col("value").cast("binary")).alias("srt_md5"))


def corpus_export(spark, d):
    """The JSON export of the corpus, read back; the texts are compared by their digests."""
    path = new_folder(spark, "corpus")
    pairs = C.corpus_pairs(A.qa_pairs(spark, d))
    io.write_corpus(pairs, A.manifest(spark, d), path, as_json=True)
    digests = [F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("question", "answer")]
    return spark.read.schema(pairs.schema).json(f"{path}/json/pairs").select("uid", "dataset", "video", "approach", "n", "t", "te", *digests)


def _document(spark, d):
    folder = new_folder(spark, "document")
    io.write_corpus_document(C.corpus_pairs(A.qa_pairs(spark, d)), A.manifest(spark, d), folder)
    return io.read_corpus_document(spark, folder)


def corpus_document(spark, d):
    """The corpus as one document in ordered parts, its pairs read back."""
    digests = [F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("question", "answer")]
    return _document(spark, d)[0].select("uid", "dataset", "video", "approach", "n", "t", "te", *digests)


def pending_files(spark, d):
    """Transcripts of two documents in three are written; every document asks for its own."""
    folder = new_folder(spark, "videos")
    io.write_transcripts(A.segments(spark, d).filter("video % 3 <> 1").selectExpr("*", _DATASET, "'en' AS lang"), folder)
    asked = A.table(spark, d, "documents").select(F.col("doc_id").alias("video")).selectExpr("video", _DATASET)
    return io.pending_files(asked, folder, F.format_string("%s/%s/Transcript/transcript-en.json", "dataset", F.col("video").cast("string")))


def report_tables(spark, d):
    """The summary by approach as a report file, read back; the empty table beside it isn't written."""
    path = new_folder(spark, "report")
    summary = R.QUERIES["summary_by_approach"](spark, d)
    written = io.write_report_tables({"summary_by_approach": summary, "empty": summary.filter(F.lit(False))}, path)
    return spark.read.schema(summary.schema).csv(f"{path}/{written[0]}", header=True)


#: Parts of the state of the registered streams.
STATE_PARTS = 4


def stream_latest(spark, d):
    """The log as a stream in three runs from one checkpoint: later ids first, then the rest with a part of the first again."""
    arrived, checkpoint = new_folder(spark, "arrived"), new_folder(spark, "stream")
    log = A.ratings(spark, d).select("id", "session_id", "qa_uid", "created_at")
    own = stream_session(spark, STATE_PARTS)
    for part in ("id % 3 = 2", "id % 3 = 1 OR id % 6 = 2", "id % 3 = 0"):
        log.filter(part).write.mode("append").parquet(arrived)
        stream_latest_ratings(own.readStream.schema(log.schema).parquet(arrived), checkpoint).awaitTermination()
    return read_latest(spark, checkpoint, log.schema)


#: Runs of the progress stream. A rating comes in a run by its day of ten; one in ten comes a run late, too late for its hour unless the hour is near the end of what has come.
RUNS = 3
RUN = "least(2, CAST(floor((extract(DAY FROM created_at) - 1) / 10) AS INT) + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END)"


def stream_progress_hours(spark, d):
    """Hourly progress as an append stream that is stopped and started from its checkpoint twice, with ratings that come in no order."""
    arrived, out, checkpoint = (new_folder(spark, n) for n in ("arrived", "hours", "stream"))
    log = A.ratings(spark, d).selectExpr("id", "annotator", "CAST(created_at AS TIMESTAMP) AS created_at", f"{RUN} AS run")
    own = stream_session(spark, STATE_PARTS)
    for run in range(RUNS):
        log.filter(F.col("run") == run).drop("run").write.mode("append").parquet(arrived)
        stream_progress(own.readStream.schema("id long, annotator string, created_at timestamp").parquet(arrived), out, checkpoint).awaitTermination()
    return read_progress(spark, out).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


QUERIES = {
    "manifest_file": manifest_file,
    "rating_exports": rating_exports,
    "rating_folder": rating_folder,
    "transcript_files": transcript_files,
    "caption_files": caption_files,
    "qa_files": qa_files,
    "run_log_files": run_log_files,
    "generation_meta_files": generation_meta_files,
    "srt_files": srt_files,
    "corpus_export": corpus_export,
    "corpus_document": corpus_document,
    "corpus_document_videos": lambda s, d: _document(s, d)[1],
    "pending_files": pending_files,
    "report_tables": report_tables,
    "stream_latest_ratings": stream_latest,
    "stream_progress": stream_progress_hours,
}
ORACLE_SQL = {
    "manifest_file": f"WITH {A.MANIFEST} SELECT video AS index, url, language, false AS collides FROM manifest WHERE url IS NOT NULL",
    "rating_exports": f"WITH {A.RATINGS} SELECT {', '.join(EXPORTED)} FROM ratings",
    "rating_folder": f"WITH {A.RATINGS} SELECT {', '.join(EXPORTED)} FROM ratings",
    "transcript_files": f"WITH {A.SEGMENTS} SELECT {_DATASET}, video, 'transcript-en.json' AS name, line_no, start_sec, end_sec, text FROM segments",
    "caption_files": """SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, CASE WHEN event_id % 41 <> 0 THEN epoch_us(ts) // 1000 - 1704067200000 END AS t_start_ms, CASE WHEN event_type <> 'error' THEN event_id % 5000 END AS d_duration_ms,
 CASE WHEN event_id % 43 <> 0 THEN event_type || '|' || chr(10) || '|' || CASE WHEN event_id % 7 <> 0 THEN ' ok  now ' ELSE '' END END AS texts FROM events""",
    "qa_files": f"WITH {A.QA} SELECT dataset, video, approach, row_number() OVER (PARTITION BY dataset, video, approach ORDER BY n) AS n, time_start_sec, time_end_sec, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM qa",
    "run_log_files": "SELECT CASE WHEN conv_id % 3 = 0 THEN 'north' ELSE 'south' END AS dataset, conv_id AS video, coalesce(MAX(3 * turn) FILTER (role = 'assistant' AND conv_id % 4 <> 0), 0.0)::DOUBLE AS agent_seconds FROM conversations GROUP BY conv_id",
    "generation_meta_files": f"WITH {A.CORPUS} SELECT dataset, approach, 42 AS seed, COUNT(*) AS pairs, MAX({A.WORDS.format('answer')}) AS answer_words_max FROM corpus GROUP BY dataset, approach",
    "srt_files": T.ORACLE_SQL["write_srt"],
    "corpus_export": f"WITH {A.CORPUS} SELECT uid, dataset, video, approach, n, t, te, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM corpus",
    "corpus_document": f"WITH {A.CORPUS} SELECT uid, dataset, video, approach, n, t, te, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM corpus",
    "corpus_document_videos": f"WITH {A.MANIFEST} SELECT dataset, video, url, language FROM manifest WHERE url IS NOT NULL",
    "pending_files": f"SELECT video, dataset FROM (SELECT doc_id AS video, text, {_DATASET} FROM documents) WHERE video % 3 = 1 OR text IS NULL",
    "report_tables": R.ORACLE_SQL["summary_by_approach"],
    "stream_latest_ratings": R.ORACLE_SQL["latest_ratings"],
    "stream_progress": f"""WITH {A.RATINGS}, r AS (SELECT annotator, created_at, date_trunc('hour', created_at) AS hour, {RUN} AS run FROM ratings),
 seen AS (SELECT run, MAX(MAX(created_at)) OVER (ORDER BY run) AS until FROM r GROUP BY run),
 before AS (SELECT n.run, MAX(seen.until) AS until FROM (SELECT unnest(range({RUNS})) AS run) n LEFT JOIN seen ON seen.run < n.run GROUP BY n.run)
 SELECT hour, annotator, COUNT(*) AS submissions FROM r JOIN before USING (run) WHERE (until IS NULL OR hour + INTERVAL 1 HOUR > until - INTERVAL 2 HOUR) AND hour + INTERVAL 1 HOUR <= (SELECT MAX(created_at) FROM r) - INTERVAL 2 HOUR GROUP BY ALL""",
}
