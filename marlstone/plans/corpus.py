"""Queries of the question/answer corpus, of response parsing and of run books, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import corpus as C
from marlstone.operators import parse as P
from marlstone.operators import select as L
from marlstone.plans import adapters as A
from marlstone.streaming.ratings import progress_by_hour


def _corpus(spark, d):
    return C.corpus_pairs(A.qa_pairs(spark, d))


def _responses(spark, d):
    """Responses as a model would write them: each conversation's turns as questions, timestamps and answers."""
    rows = A.table(spark, d, "conversations").filter("text is not null").withColumn("one", F.regexp_replace("text", r"\s+", " "))
    line = (
        F.when(F.col("role") == "user", F.concat(F.lit("Question "), F.col("turn").cast("string"), F.lit(": "), F.col("one"), F.lit("\nTimestamp: "), F.col("turn").cast("string"), F.lit(":05-"), (F.col("turn") + 1).cast("string"), F.lit(":00")))
        .when(F.col("role") == "assistant", F.concat(F.lit("Answer "), F.col("turn").cast("string"), F.lit(": "), F.col("one"))).otherwise(F.concat(F.lit("Note "), F.col("one")))
    )
    items = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy(F.col("conv_id").alias("response_id")).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("text"))


def parse_qa_pairs(spark, d):
    out = P.parse_qa_pairs(_responses(spark, d))
    return out.select("response_id", "n", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


def attach_timestamps(spark, d):
    r = _responses(spark, d)
    return P.attach_timestamps(P.parse_qa_pairs(r), r).select("response_id", "n", "timestamp", "time_start_sec", "time_end_sec")


def parse_shortfall(spark, d):
    r = _responses(spark, d)
    return P.parse_shortfall(P.parse_qa_pairs(r), r.select("response_id", F.lit(4).alias("expected")))


def fenced_blueprints(spark, d):
    """Blueprints written as JSON in three dresses, with a reasoning block in front of some, and read again."""
    item = F.struct(F.col("id").cast("int").alias("id"), "title", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    raw = A.blueprint(spark, d).groupBy("video").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("j"))
    dress = F.when(F.col("video") % 4 == 0, F.col("j")).when(F.col("video") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), "j", F.lit("\n```"))).when(F.col("video") % 4 == 2, F.concat(F.lit("<think>[1] or [2]?</think>Here: "), "j", F.lit(" done"))).otherwise(F.lit("no list here"))
    return raw.select("video", F.explode(X.blueprint_or_fallback(dress)).alias("s")).select("video", "s.id", "s.title", "s.start_line", "s.end_line")


def caption_tracks(spark, d):
    names = "CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'en-orig' ELSE 'a-orig' END WHEN 2 THEN 'zh-Hant' WHEN 3 THEN 'a-auto' ELSE 'zh' END"
    t = A.table(spark, d, "events").selectExpr("user_id AS video", "CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang", f"{names} AS name")
    return C.pick_caption_track(t, ["video"])


def pick_transcript(spark, d):
    f = A.table(spark, d, "events").selectExpr("user_id AS video", "CASE WHEN event_id % 3 = 0 THEN concat('notes-', event_id, '.json') ELSE concat('transcript-', event_id % 7, '.json') END AS name")
    return C.pick_transcript(f, ["video"])


def pending_downloads(spark, d):
    asked = A.table(spark, d, "documents").select(F.col("doc_id").alias("video"))
    return C.pending(asked, A.table(spark, d, "labels").select(F.col("doc_id").alias("video")), ["video"])


def cap_answers(spark, d):
    pairs = A.qa_pairs(spark, d).withColumn("answer", F.when(F.col("n") % 4 == 1, F.concat("answer", F.lit(" Not available in the PROVIDED context."))).otherwise(F.col("answer")))
    return C.cap_answers(pairs, ["video"], 2).select("video", "n")


def compare_runs(spark, d):
    a = _corpus(spark, d)
    b = a.filter("(video + n) % 11 <> 0").withColumn("question", F.when(F.col("video") % 5 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")))
    return C.compare_runs(a, b, ["video", "approach"])


def auto_index(spark, d):
    m = A.table(spark, d, "customer").selectExpr("c_custkey AS pos", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS index")
    return C.auto_index(m, "pos")


def upsert_run_times(spark, d):
    m = A.table(spark, d, "customer").selectExpr("c_custkey AS index", "c_name AS url", "CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS approach1")
    u = A.table(spark, d, "orders").selectExpr("o_custkey * 2 AS index", "1 + o_orderkey % 3 AS approach", "o_totalprice / 7 AS seconds")
    return C.upsert_run_times(m, u, [1, 2, 3])


def agent_time_rollup(spark, d):
    m = A.table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice END AS approach1", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS approach2")
    return C.agent_time_rollup(m, [1, 2])


def _questions(spark, d):
    return A.table(spark, d, "documents").filter("text is not null").selectExpr("CAST(doc_id AS STRING) AS uid", "text AS question")


def near_duplicate_classes(spark, d):
    return C.near_duplicate_classes(_questions(spark, d))


def near_duplicate_questions(spark, d):
    return C.near_duplicate_questions(_questions(spark, d))


def length_profile(spark, d):
    return C.length_profile(_corpus(spark, d), ["approach"])


Z = A.CORPUS
ONE = "regexp_replace({0}, '\\s+', ' ', 'g')"
PARSED = f"""rows AS (SELECT conv_id, turn, role, trim({ONE.format('text')}) AS one FROM conversations WHERE text IS NOT NULL), qs AS (SELECT conv_id, turn, one, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000000) AS upto FROM rows WHERE role = 'user'),
 blocks AS (SELECT q.conv_id, q.turn, q.one AS question, MIN(a.turn) FILTER (a.role = 'assistant') AS first FROM qs q LEFT JOIN rows a ON a.conv_id = q.conv_id AND a.turn > q.turn AND a.turn < q.upto GROUP BY ALL),
 parsed AS (SELECT conv_id AS response_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, question, (SELECT one FROM rows r WHERE r.conv_id = b.conv_id AND r.turn = b.first) AS answer FROM blocks b WHERE first IS NOT NULL)"""

QUERIES = {
    "corpus_pairs": lambda s, d: _corpus(s, d).select("uid", "dataset", "video", "approach", "n", "t", "te"),
    "exclude_approaches": lambda s, d: C.exclude_approaches(_corpus(s, d), ["RAG", "DualAgent"]).select("uid", "approach"),
    "select_approaches": lambda s, d: C.select_approaches(_corpus(s, d), ["RAG", "SingleAgent", "DualAgent"], ["RAG"]).select("uid", "approach"),
    "select_videos": lambda s, d: C.select_videos(A.manifest(s, d).withColumnRenamed("video", "index"), start=20).select("dataset", "index"),
    "drop_refusals": lambda s, d: C.drop_refusals(_corpus(s, d).withColumn("answer", F.when(F.col("n") % 3 == 0, F.concat(F.lit("Not AVAILABLE in the provided context: "), "answer")).otherwise(F.col("answer")))).select("uid"),
    "cap_answers": cap_answers,
    "corpus_summary": lambda s, d: C.corpus_summary(_corpus(s, d)),
    "pairs_with_video": lambda s, d: C.pairs_with_video(_corpus(s, d), A.manifest(s, d)).select("uid", "url", "language"),
    "missing_video_links": lambda s, d: C.missing_video_links(_corpus(s, d), A.manifest(s, d)),
    "pending_downloads": pending_downloads,
    "pick_caption_track": caption_tracks,
    "pick_transcript": pick_transcript,
    "shared_ordered_set": lambda s, d: L.shared_ordered_set(_corpus(s, d).withColumnRenamed("n", "qa_number"), 50).select("uid"),
    "stratified_sample": lambda s, d: L.stratified_sample(_corpus(s, d), ["dataset", "video", "approach"], 1, "42").select("uid"),
    "length_profile": length_profile,
    "compare_runs": compare_runs,
    "near_duplicate_questions": near_duplicate_questions,
    "near_duplicate_classes": near_duplicate_classes,
    "near_duplicate_rate": lambda s, d: C.near_duplicate_rate(_questions(s, d)),
    "parse_qa_pairs": parse_qa_pairs,
    "attach_timestamps": attach_timestamps,
    "parse_shortfall": parse_shortfall,
    "blueprint_or_fallback": fenced_blueprints,
    "auto_index": auto_index,
    "upsert_run_times": upsert_run_times,
    "agent_time_rollup": agent_time_rollup,
    "progress_by_hour": lambda s, d: progress_by_hour(A.ratings(s, d)),
}
_LINKS = "links AS (SELECT * FROM manifest WHERE url IS NOT NULL)"
# Different questions, those that are near each other, and the classes that these links make.
NEAR = """d AS (SELECT text, MIN(CAST(doc_id AS VARCHAR)) AS uid FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT uid, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM d),
 g AS (SELECT DISTINCT uid, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM w WHERE len(w) > 0), n AS (SELECT uid, COUNT(*) AS n FROM g GROUP BY uid),
 c AS (SELECT a.uid AS uid_a, b.uid AS uid_b, COUNT(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.uid < b.uid GROUP BY ALL),
 near AS (SELECT uid_a, uid_b, round(c * 1.0 / (x.n + y.n - c), 6) AS jaccard FROM c JOIN n x ON x.uid = uid_a JOIN n y ON y.uid = uid_b WHERE round(c * 1.0 / (x.n + y.n - c), 6) >= 0.75)"""
CLASSES = """links(a, b) AS (SELECT uid_a, uid_b FROM near UNION ALL SELECT uid_b, uid_a FROM near), reach(id, label) AS (SELECT uid, uid FROM d UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.id),
 of AS (SELECT id, MIN(label) AS class FROM reach GROUP BY id), each AS (SELECT CAST(o.doc_id AS VARCHAR) AS uid, class, COUNT(*) OVER (PARTITION BY text) AS n_copies FROM documents o JOIN d USING (text) JOIN of ON of.id = d.uid),
 classes AS (SELECT *, COUNT(*) OVER (PARTITION BY class) AS class_size FROM each)"""


ORACLE_SQL = {
    "corpus_pairs": f"WITH {Z} SELECT uid, dataset, video, approach, n, t, te FROM corpus",
    "exclude_approaches": f"WITH {Z} SELECT uid, approach FROM corpus WHERE approach NOT IN ('RAG', 'DualAgent')",
    "select_approaches": f"WITH {Z} SELECT uid, approach FROM corpus WHERE approach IN ('SingleAgent', 'DualAgent')",
    "select_videos": f"WITH {A.MANIFEST} SELECT dataset, video AS index FROM manifest WHERE video >= 20",
    "drop_refusals": f"WITH {Z} SELECT uid FROM corpus WHERE n % 3 <> 0",
    "cap_answers": f"WITH {Z} SELECT video, n FROM qa WHERE n % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY video ORDER BY n) <= 2",
    "corpus_summary": f"WITH {Z} SELECT coalesce(dataset, 'TOTAL') AS dataset, coalesce(approach, 'TOTAL') AS approach, COUNT(DISTINCT (dataset, video)) AS videos, COUNT(*) AS pairs, COUNT(t) AS timed FROM corpus GROUP BY GROUPING SETS ((dataset, approach), ())",
    "pairs_with_video": f"WITH {Z}, {A.MANIFEST}, {_LINKS} SELECT uid, url, language FROM corpus LEFT JOIN links USING (dataset, video)",
    "missing_video_links": f"WITH {Z}, {A.MANIFEST}, {_LINKS} SELECT DISTINCT dataset, video FROM corpus ANTI JOIN links USING (dataset, video)",
    "pending_downloads": "SELECT doc_id AS video FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "pick_caption_track": """WITH t AS (SELECT user_id AS video, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'en-orig' ELSE 'a-orig' END WHEN 2 THEN 'zh-Hant' WHEN 3 THEN 'a-auto' ELSE 'zh' END AS name FROM events)
 SELECT video, lang, arg_min(name, CASE lang || ' ' || name WHEN 'en en-orig' THEN '0' WHEN 'en en' THEN '1' WHEN 'zh zh-Hans' THEN '0' WHEN 'zh zh-Hant' THEN '1' WHEN 'zh zh' THEN '2' ELSE '9' END || name) AS name FROM t GROUP BY video, lang""",
    "pick_transcript": "SELECT user_id AS video, MIN(concat('transcript-', event_id % 7, '.json')) AS name FROM events WHERE event_id % 3 <> 0 GROUP BY user_id",
    "shared_ordered_set": f"WITH {Z} SELECT uid FROM corpus ORDER BY n, video, dataset, approach, uid LIMIT 50",
    "stratified_sample": f"WITH {Z} SELECT uid FROM corpus QUALIFY row_number() OVER (PARTITION BY dataset, video, approach ORDER BY md5(uid || '42'), uid) <= 1",
    "length_profile": f"""WITH {Z}, w AS (SELECT *, {A.WORDS.format('answer')} AS w, greatest(len(regexp_extract_all(answer, '[.!?](\\s|$)')), 1) AS s, {A.WORDS.format('question')} AS qw FROM corpus)
 SELECT approach, COUNT(*) AS pairs, round(AVG(w), 6) AS words_mean, quantile_cont(w, 0.5) AS words_median, round(quantile_cont(w, 0.9), 6) AS words_p90, MAX(w) AS words_max, round(AVG(s), 6) AS sentences_mean, MAX(s) AS sentences_max,
 round(AVG(CASE WHEN w BETWEEN 60 AND 80 THEN 1 ELSE 0 END), 6) AS within_60_80, round(AVG(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END), 6) AS grounded, round(AVG(qw), 6) AS question_words_mean FROM w GROUP BY approach""",
    "compare_runs": f"""WITH {Z}, b AS (SELECT video, approach, n, CASE WHEN video % 5 = 0 THEN question || '?' ELSE question END AS question FROM corpus WHERE (video + n) % 11 <> 0),
 x AS (SELECT video, approach, COUNT(*) AS n, list_sort(list(DISTINCT question)) AS q FROM corpus GROUP BY ALL), y AS (SELECT video, approach, COUNT(*) AS n, list_sort(list(DISTINCT question)) AS q FROM b GROUP BY ALL)
 SELECT video, approach, coalesce(x.n, 0) AS pairs_a, coalesce(y.n, 0) AS pairs_b, coalesce(x.n = y.n, false) AS same_count, coalesce(x.q = y.q, false) AS same_questions, coalesce(len(list_intersect(x.q, y.q)), 0) AS common FROM x FULL JOIN y USING (video, approach)""",
    "near_duplicate_questions": f"""WITH {NEAR} SELECT uid_a, uid_b, jaccard FROM near
 UNION ALL SELECT DISTINCT d.uid, CAST(o.doc_id AS VARCHAR), 1.0 FROM documents o JOIN d USING (text) WHERE CAST(o.doc_id AS VARCHAR) <> d.uid""",
    "near_duplicate_classes": f"WITH RECURSIVE {NEAR}, {CLASSES} SELECT uid, class, class_size, n_copies, uid = class AS kept FROM classes",
    "near_duplicate_rate": f"WITH RECURSIVE {NEAR}, {CLASSES} SELECT COUNT(*) AS pairs, COUNT(*) FILTER (class_size > 1) AS near_duplicates, round(COUNT(*) FILTER (class_size > 1) * 1.0 / greatest(COUNT(*), 1), 6) AS share FROM classes",
    "parse_qa_pairs": f"WITH {PARSED} SELECT response_id, n, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM parsed WHERE n <= 20",
    "attach_timestamps": f"""WITH {PARSED}, m AS (SELECT conv_id AS response_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM rows WHERE role = 'user')
 SELECT response_id, p.n, m.turn || ':05-' || (m.turn + 1) || ':00' AS "timestamp", m.turn * 60 + 5 AS time_start_sec, (m.turn + 1) * 60 AS time_end_sec FROM parsed p LEFT JOIN m USING (response_id, n) WHERE p.n <= 20""",
    "parse_shortfall": f"WITH {PARSED}, c AS (SELECT conv_id AS response_id, 4 AS expected, coalesce((SELECT COUNT(*) FROM parsed p WHERE p.response_id = r.conv_id AND p.n <= 20), 0) AS found FROM (SELECT DISTINCT conv_id FROM rows) r) SELECT response_id, CAST(expected AS BIGINT) AS expected, found FROM c WHERE found < expected",
    "blueprint_or_fallback": f"WITH {A.BLUEPRINT} SELECT video, id, title, start_line, end_line FROM blueprint WHERE video % 4 < 3 UNION ALL SELECT DISTINCT video, 0, 'Raw Response', 0, 0 FROM blueprint WHERE video % 4 = 3",
    "auto_index": "WITH m AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey) ELSE c_custkey END AS index FROM customer) SELECT pos, index, COUNT(*) OVER (PARTITION BY index) > 1 AS collides FROM m",
    "upsert_run_times": """WITH m AS (SELECT c_custkey AS index, c_name AS url, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS approach1 FROM customer), u AS (SELECT o_custkey * 2 AS index, 1 + o_orderkey % 3 AS a, MAX(o_totalprice / 7) AS s FROM orders GROUP BY ALL),
 p AS (SELECT index, round(MAX(s) FILTER (a = 1), 3) AS a1, round(MAX(s) FILTER (a = 2), 3) AS a2, round(MAX(s) FILTER (a = 3), 3) AS a3 FROM u GROUP BY index) SELECT index, url, coalesce(a1, approach1) AS approach1, a2 AS approach2, a3 AS approach3 FROM m FULL JOIN p USING (index)""",
    "agent_time_rollup": """WITH l AS (SELECT 1 AS approach, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice END AS s FROM orders UNION ALL SELECT 2, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
 SELECT CAST(approach AS BIGINT) AS approach, COUNT(*) AS runs, COUNT(*) FILTER (s = 0) AS failed, round(AVG(s) FILTER (s > 0), 6) AS mean_s, MIN(s) FILTER (s > 0) AS min_s, MAX(s) FILTER (s > 0) AS max_s, round(SUM(s) FILTER (s > 0), 3) AS total_s FROM l GROUP BY approach""",
    "progress_by_hour": f"WITH {A.RATINGS} SELECT date_trunc('hour', created_at) AS hour, annotator, COUNT(*) AS submissions FROM ratings GROUP BY ALL",
}
