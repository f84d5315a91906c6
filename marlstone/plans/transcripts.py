"""Queries of transcripts, text functions, segments and selection, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import segments as G
from marlstone.operators import select as C
from marlstone.plans import adapters as A
from marlstone.sources.io import srt_documents

W = A.WORDS


def _docs(spark, d):
    return A.table(spark, d, "documents").filter("text is not null").select("doc_id", "text", "lang")


def _turns(spark, d):
    return A.table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", "text")


def _seconds(spark, d):
    return A.table(spark, d, "events").selectExpr("event_id AS id", "event_id * 0.5 + value / 7 AS sec")


def language_from_filename(spark, d):
    name = F.concat(F.lit("transcript-"), F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1), F.lit("-"), F.col("page_id").cast("string"), F.lit(".json"))
    code, language = X.language_from_filename(name)
    return A.table(spark, d, "pages").select("page_id", code.alias("code"), language.alias("language"))


def language_code(spark, d):
    names = "CASE conv_id % 6 WHEN 0 THEN ' English' WHEN 1 THEN 'CN' WHEN 2 THEN 'Hind' WHEN 3 THEN 'romanian' WHEN 4 THEN 'Old French' ELSE 'ja' END"
    return A.table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{names} AS name").select("conv_id", "turn", X.language_code(F.col("name")).alias("code"))


def sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(X.split_sentences(F.col("text"))).alias("s")).select("doc_id", "s.n", F.md5(F.col("s.sentence").cast("binary")).alias("sentence_md5"))


def marked_lines(spark, d):
    one = A.segments(spark, d).select("video", "line_no", X.marked_line(F.col("start_sec"), F.col("text")).alias("m")).filter("m is not null")
    return one.select("video", "line_no", F.md5(F.col("m").cast("binary")).alias("line_md5"))


def word_budget(spark, d):
    words = X.word_count(X.without_markers(F.col("text")))
    return _docs(spark, d).select("doc_id", words.alias("words"), X.qa_target(words).alias("qa_target"), X.approx_tokens(F.col("text")).alias("approx_tokens"), F.length(X.truncate_budget(F.col("text"), 5000)).alias("kept_chars"))


def numbered_lists(spark, d):
    """Each turn's sentences written as a numbered list, and read again in both ways."""
    listed = F.array_join(F.transform(F.split("text", r"\. "), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    one = _turns(spark, d).withColumn("listed", listed)
    return one.select("conv_id", "turn", F.size(X.parse_numbered_list(F.col("listed"))).alias("lines"), F.size(X.split_numbered(F.col("listed"))).alias("parts"))


def parse_scores(spark, d):
    reply = "CASE event_id % 4 WHEN 0 THEN concat('A=', event_id % 12, ' C = ', event_id % 7, ' E=', event_id % 15) WHEN 1 THEN concat('A=3 C=', event_id % 9) WHEN 2 THEN concat('about ', event_id % 30) ELSE 'none' END"
    one = A.table(spark, d, "events").selectExpr("event_id AS id", f"{reply} AS reply")
    return one.select("id", F.round(X.parse_score(F.col("reply")), 6).alias("score"), F.size(X.parse_ints(F.col("reply"))).alias("ints"))


def mmss_ranges(spark, d):
    text = "concat('at ', event_id % 200, ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), CASE WHEN event_id % 3 = 0 THEN ' to ' WHEN event_id % 3 = 1 THEN '-' ELSE ' / ' END, event_id % 150, ':30')"
    one = A.table(spark, d, "events").selectExpr("event_id AS id", f"{text} AS t")
    start, end = X.parse_mmss_range(F.col("t"))
    return one.select("id", start.alias("start"), end.alias("end"))


def end_marks(spark, d):
    one = A.segments(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("video"), "lang"), "video")
    return one.select("video", "line_no", F.md5(X.restore_end_mark(F.col("text"), F.col("lang")).cast("binary")).alias("text_md5"))


def clock(spark, d):
    return _seconds(spark, d).select("id", X.format_hhmmss(F.col("sec")).alias("hhmmss"), X.format_srt(F.col("sec")).alias("srt"))


def chunks(spark, d):
    return C.recursive_chunks(_docs(spark, d), ["doc_id"], "text").select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def flatten_transcript(spark, d):
    return G.flatten_transcript(A.segments(spark, d), ["video"]).select("video", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


def srt(spark, d):
    return srt_documents(A.segments(spark, d), ["video"]).select("video", F.md5(F.col("srt").cast("binary")).alias("srt_md5"))


def visual_references(spark, d):
    return A.segments(spark, d).select("video", "line_no", F.round(X.deictic_share(F.col("text")), 6).alias("share")).filter("share > 0.02")


def segment_content(spark, d):
    out = G.segment_content(A.blueprint(spark, d), A.segments(spark, d), ["video"])
    return out.select("video", "segment", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def segment_times(spark, d):
    return G.segment_times(A.blueprint(spark, d), A.segments(spark, d), ["video"]).select("video", "segment", F.round("time_start_sec", 6).alias("time_start_sec"), F.round("time_end_sec", 6).alias("time_end_sec"), "time_start_hhmmss", "time_end_hhmmss")


def question_context(spark, d):
    parts = G.segment_times(G.segment_content(A.blueprint(spark, d), A.segments(spark, d), ["video"]), A.segments(spark, d), ["video"])
    asked = C.select_proportional(A.scored_pool(spark, d), ["video"], 20).filter("selected").select("video", "segment", "id")
    return C.question_context(asked, parts, ["video", "segment"]).select("video", "segment", "id", F.length("content").alias("content_chars"), F.round("time_start_sec", 6).alias("time_start_sec"))


def repair_segments(spark, d):
    b = A.blueprint(spark, d)
    return G.repair_segments(b.select("video", "topic", "start_line", "end_line"), b.select("video", "total_lines").distinct(), ["video"])


def number_lines(spark, d):
    one = G.number_lines(_turns(spark, d), ["conv_id"], ["turn"])
    return one.select("conv_id", "turn", "line_no", F.md5(F.col("numbered").cast("binary")).alias("line_md5"))


def pick_min_overlap(spark, d):
    """At most 20 of a supplier's orders as clips in time."""
    one = A.scored_pool(spark, d).selectExpr("video", "id % 100000 AS idx", "CAST(id % 997 AS DOUBLE) AS start", "CAST(id % 997 + id % 61 AS DOUBLE) AS `end`", "concat('t', segment) AS topic", "id")
    return C.pick_min_overlap(one, ["video"], 20).select("video", "id")


def selection_status(spark, d):
    pool = A.scored_pool(spark, d)
    chosen = C.select_proportional(pool, ["video"], 20).filter("selected")
    return C.selection_status(pool.select("video", "segment", "id"), chosen, ["video", "id"])


def retrieve_top_k(spark, d):
    """Every vector whose id is divisible by 50 asks; all vectors are searched, so that each finds itself as well."""
    e = A.table(spark, d, "embeddings").filter("embedding is not null and label is not null")
    return C.retrieve_top_k(e.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("q_id"), "embedding"), e.select("label", F.col("vec_id").alias("chunk_id"), "embedding"), "label")


QUOTAS = f"""WITH {A.POOL}, q AS (SELECT video, segment, greatest(round(avg(score) - coalesce(stddev_samp(score), 0), 9), 0) AS quality FROM pool GROUP BY ALL),
 r AS (SELECT *, round(CASE WHEN SUM(quality) OVER (PARTITION BY video) > 0 THEN quality / SUM(quality) OVER (PARTITION BY video) ELSE 1.0 / COUNT(*) OVER (PARTITION BY video) END * 20, 9) AS raw FROM q),
 b AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM r),
 quotas AS (SELECT video, segment, quality, base + CASE WHEN row_number() OVER (PARTITION BY video ORDER BY round(raw - base, 9) DESC, segment) <= 20 - SUM(base) OVER (PARTITION BY video) THEN 1 ELSE 0 END AS quota FROM b)"""
_LEAST = "over, over - (ends - starts), seen, starts - ends, id"
MIN_OVERLAP = f"""WITH RECURSIVE {A.POOL}, walk AS (SELECT video, id, CAST(id % 997 AS BIGINT) AS starts, CAST(id % 997 + id % 61 AS BIGINT) AS ends, segment AS topic, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS seen, 1 AS step FROM pool
  UNION ALL SELECT video, id, starts, ends, topic, over + greatest(0, least(ends, best.ends) - greatest(starts, best.starts)), seen + CAST(topic = best.topic AS BIGINT), step + 1
   FROM (SELECT *, first_value({{'id': id, 'starts': starts, 'ends': ends, 'topic': topic}}) OVER (PARTITION BY video ORDER BY {_LEAST}) AS best FROM walk) w WHERE id <> best.id AND step < 20)
 SELECT video, id FROM walk QUALIFY row_number() OVER (PARTITION BY video, step ORDER BY {_LEAST}) = 1"""
ISLANDS = "f AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY video ORDER BY start_line, id) = title THEN 0 ELSE 1 END AS new FROM blueprint), r AS (SELECT *, SUM(new) OVER (PARTITION BY video ORDER BY start_line, id) AS island FROM f)"
SELECTED = QUOTAS + """, f AS (SELECT pool.*, row_number() OVER (PARTITION BY video, segment ORDER BY score DESC, id DESC) <= quota AS first FROM pool JOIN quotas USING (video, segment)),
 s AS (SELECT *, SUM(CAST(first AS INT)) OVER (PARTITION BY video) AS taken, row_number() OVER (PARTITION BY video, first ORDER BY score DESC, id DESC) AS rest FROM f)"""
CONTENT = f"{A.SEGMENTS}, {A.BLUEPRINT}, content AS (SELECT b.video, b.segment, coalesce(string_agg(s.line_no || ': ' || s.text, chr(10) ORDER BY s.line_no), '') AS content FROM blueprint b LEFT JOIN segments s ON s.video = b.video AND s.line_no BETWEEN b.start_line AND b.end_line GROUP BY b.video, b.segment)"
HMS = "lpad(CAST(CAST(round_even({0}, 0) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round_even({0}, 0) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round_even({0}, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0')"
MS = "CAST(round_even({0} * 1000, 0) AS BIGINT)"
SRT = f"lpad(CAST({MS} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({MS} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({MS} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({MS} % 1000 AS VARCHAR), 3, '0')"
TIMES = "times AS (SELECT b.video, b.segment, coalesce(f.start_sec, 0.0) AS a, coalesce(l.end_sec, 0.0) AS z FROM blueprint b LEFT JOIN segments f ON f.video = b.video AND f.line_no = b.start_line LEFT JOIN segments l ON l.video = b.video AND l.line_no = b.end_line)"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"

QUERIES = {
    "language_from_filename": language_from_filename,
    "language_code": language_code,
    "normalize_text": lambda s, d: _docs(s, d).select("doc_id", F.md5(X.normalize_text(F.col("text")).cast("binary")).alias("text_md5")),
    "restore_end_mark": end_marks,
    "format_times": clock,
    "marked_lines": marked_lines,
    "word_budget": word_budget,
    "split_sentences": sentences,
    "numbered_lists": numbered_lists,
    "parse_scores": parse_scores,
    "parse_mmss_range": mmss_ranges,
    "flatten_transcript": flatten_transcript,
    "write_srt": srt,
    "visual_references": visual_references,
    "drop_visual_references": lambda s, d: G.drop_visual_references(A.segments(s, d)).select("video", "line_no"),
    "recursive_chunks": chunks,
    "number_lines": number_lines,
    "captions_to_segments": lambda s, d: G.captions_to_segments(A.caption_events(s, d), ["video"]).select("video", "line_no", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "text"),
    "segment_content": segment_content,
    "segment_times": segment_times,
    "question_context": question_context,
    "distribute_questions": lambda s, d: G.distribute_questions(G.merge_consecutive(A.blueprint(s, d), ["video"]), ["video"], "id").select("video", F.col("id").alias("segment"), "questions"),
    "merge_consecutive": lambda s, d: G.merge_consecutive(A.blueprint(s, d), ["video"]),
    "deduplicate_segments": lambda s, d: G.deduplicate_segments(A.blueprint(s, d), ["video"]).select("video", "id", "title"),
    "repair_segments": repair_segments,
    "segment_quality": lambda s, d: C.segment_quality(A.scored_pool(s, d), ["video"]).withColumn("quality", F.round("quality", 6)),
    "largest_remainder_quotas": lambda s, d: C.largest_remainder_quotas(C.segment_quality(A.scored_pool(s, d), ["video"]), ["video"], F.lit(20)).select("video", "segment", "quota"),
    "calls_per_agent": lambda s, d: C.calls_per_agent(C.select_proportional(A.scored_pool(s, d), ["video"], 20), ["video"]),
    "select_proportional": lambda s, d: C.select_proportional(A.scored_pool(s, d), ["video"], 20).filter("selected").select("video", "segment", "id"),
    "selection_status": selection_status,
    "skip_topics": lambda s, d: C.skip_topics(A.blueprint(s, d), ["T1"]).select("video", "segment", "topic"),
    "pick_min_overlap": pick_min_overlap,
    "seeded_order": lambda s, d: C.seeded_order(A.scored_pool(s, d), ["video", "id"], "7").select("video", "id", "question_number"),
    "seeded_shuffle": lambda s, d: C.seeded_shuffle(A.scored_pool(s, d), ["video"], "id", "7").select("video", "id", "question_number"),
    "retrieve_top_k": retrieve_top_k,
}
_SC = "CASE event_id % 4 WHEN 0 THEN concat('A=', event_id % 12, ' C = ', event_id % 7, ' E=', event_id % 15) WHEN 1 THEN concat('A=3 C=', event_id % 9) WHEN 2 THEN concat('about ', event_id % 30) ELSE 'none' END"
ORACLE_SQL = {
    "language_from_filename": """WITH p AS (SELECT page_id, regexp_extract(url, '//[^/]+/([a-z]{2})/', 1) AS c FROM pages) SELECT page_id, CASE WHEN c IN ('zh', 'hi', 'ro') THEN c WHEN c = 'cn' THEN 'zh' ELSE 'en' END AS code,
 CASE WHEN c IN ('zh', 'cn') THEN 'Chinese' WHEN c = 'hi' THEN 'Hindi' WHEN c = 'ro' THEN 'Romanian' ELSE 'English' END AS language FROM p""",
    "language_code": "SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN 'hi' WHEN 3 THEN 'ro' WHEN 4 THEN 'old-french' ELSE 'ja' END AS code FROM conversations",
    "normalize_text": f"SELECT doc_id, md5({SQUEEZE.format('text')}) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "restore_end_mark": f"WITH {A.SEGMENTS}, n AS (SELECT video, line_no, {SQUEEZE.format('text')} AS t FROM segments) SELECT video, line_no, md5(CASE WHEN t = '' OR regexp_matches(t, '(…|[.?!？！。।,;:，；：])$') THEN t ELSE t || CASE lang WHEN 'hi' THEN '।' WHEN 'zh' THEN '。' WHEN 'ja' THEN '。' WHEN 'ko' THEN '。' ELSE '.' END END) AS text_md5 FROM n JOIN documents ON doc_id = video",
    "format_times": f"WITH t AS (SELECT event_id AS id, event_id * 0.5e0 + value / 7 AS sec FROM events) SELECT id, {HMS.format('sec')} AS hhmmss, {SRT.format('sec')} AS srt FROM t",
    "marked_lines": f"WITH {A.SEGMENTS} SELECT video, line_no, md5('[' || CAST(floor(start_sec) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(start_sec) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || trim(text)) AS line_md5 FROM segments WHERE {SQUEEZE.format('text')} <> ''",
    "word_budget": f"WITH w AS (SELECT doc_id, text, {W.format('''regexp_replace(text, '\\[[0-9]+:[0-9]{2}\\]', '', 'g')''')} AS words FROM documents WHERE text IS NOT NULL) SELECT doc_id, words, greatest(4, CAST(round_even(words / 250.0, 0) AS BIGINT)) AS qa_target, length(text) // 4 AS approx_tokens, least(length(text), 5000) AS kept_chars FROM w",
    "split_sentences": "WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS n FROM p) SELECT doc_id, n, md5(regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')) AS sentence_md5 FROM s WHERE regexp_replace(s, '\\s+', '', 'g') <> ''",
    "numbered_lists": r"""WITH l AS (SELECT conv_id, turn, array_to_string(list_transform(string_split(text, '. '), lambda x, i: i || '. ' || x), chr(10)) AS listed FROM conversations WHERE text IS NOT NULL)
 SELECT conv_id, turn, len(list_filter(string_split(listed, chr(10)), lambda x: regexp_matches(regexp_extract(x, '^\s*\d+\.\s*(.+)', 1), '\S'))) AS lines, len(list_filter(string_split_regex(listed, '\d+\.\s*'), lambda x: regexp_matches(x, '\S'))) AS parts FROM l""",
    "parse_scores": f"WITH r AS (SELECT event_id AS id, {_SC} AS reply FROM events), x AS (SELECT *, regexp_extract_all(reply, '[ACE]\\s*=\\s*([0-9]+)', 1) AS m, regexp_extract(reply, '([0-9]+)', 1) AS f FROM r) SELECT id, round(CASE WHEN len(m) = 3 THEN list_sum(list_transform(m, lambda v: least(greatest(CAST(v AS DOUBLE), 1.0), 10.0))) / 3 WHEN f <> '' THEN least(greatest(CAST(f AS DOUBLE), 1.0), 10.0) ELSE 5.0 END, 6) AS score, len(regexp_extract_all(reply, '[0-9]+')) AS ints FROM x",
    "parse_mmss_range": "SELECT event_id AS id, CASE WHEN event_id % 3 < 2 THEN event_id % 200 * 60 + event_id % 60 END AS start, CASE WHEN event_id % 3 < 2 THEN event_id % 150 * 60 + 30 END AS \"end\" FROM events",
    "flatten_transcript": f"WITH {A.SEGMENTS} SELECT video, md5(string_agg({SQUEEZE.format('text')}, ' ' ORDER BY line_no)) AS transcript_md5 FROM segments WHERE {SQUEEZE.format('text')} <> '' GROUP BY video",
    "write_srt": f"WITH {A.SEGMENTS} SELECT video, md5(string_agg(line_no || chr(10) || {SRT.format('start_sec')} || ' --> ' || {SRT.format('end_sec')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY line_no)) AS srt_md5 FROM segments GROUP BY video",
    "visual_references": f"WITH {A.SEGMENTS}, v AS (SELECT video, line_no, round(len(regexp_extract_all(lower(text), '\\b(here|this|like so|you can see|watch|notice how|as i''m showing)\\b')) * 1.0 / greatest({W.format('text')}, 1), 6) AS share FROM segments) SELECT * FROM v WHERE share > 0.02",
    "drop_visual_references": f"WITH {A.SEGMENTS} SELECT video, line_no FROM segments WHERE len(regexp_extract_all(lower(text), '\\b(here|this|like so|you can see|watch|notice how|as i''m showing)\\b')) * 1.0 / greatest({W.format('text')}, 1) <= 0.02",
    "number_lines": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no, md5(row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ': ' || text) AS line_md5 FROM conversations WHERE text IS NOT NULL",
    "captions_to_segments": """WITH e AS (SELECT user_id AS video, event_id AS seq, epoch_us(ts) // 1000 - 1704067200000 AS ms, CASE WHEN event_type <> 'error' THEN event_id % 5000 END AS dur, trim(event_type || ' ' || CASE WHEN event_id % 7 <> 0 THEN 'ok now' ELSE '' END) AS text FROM events WHERE event_id % 41 <> 0 AND event_id % 43 <> 0)
 SELECT video, row_number() OVER w AS line_no, round(ms / 1000.0, 6) AS start_sec, round(coalesce(ms / 1000.0 + dur / 1000.0, lead(ms) OVER w / 1000.0, ms / 1000.0), 6) AS end_sec, text FROM e WINDOW w AS (PARTITION BY video ORDER BY seq)""",
    "segment_content": f"WITH {CONTENT} SELECT video, segment, md5(content) AS content_md5 FROM content",
    "segment_times": f"WITH {CONTENT}, {TIMES} SELECT video, segment, round(a, 6) AS time_start_sec, round(z, 6) AS time_end_sec, {HMS.format('a')} AS time_start_hhmmss, {HMS.format('z')} AS time_end_hhmmss FROM times",
    "question_context": f"{SELECTED}, {CONTENT}, {TIMES} SELECT video, segment, id, length(content) AS content_chars, round(a, 6) AS time_start_sec FROM s JOIN content USING (video, segment) JOIN times USING (video, segment) WHERE (first OR rest <= 20 - taken) AND content <> ''",
    "distribute_questions": f"""WITH {A.BLUEPRINT}, {ISLANDS}, b AS (SELECT video, COUNT(*) OVER (PARTITION BY video) AS n, row_number() OVER (PARTITION BY video ORDER BY island) AS segment FROM (SELECT DISTINCT video, island FROM r))
 SELECT video, segment, 20 // n + CASE WHEN segment <= 20 % n THEN 1 ELSE 0 END AS questions FROM b""",
    "merge_consecutive": f"""WITH {A.BLUEPRINT}, {ISLANDS}
 SELECT video, any_value(title) AS title, MIN(start_line) AS start_line, arg_max(end_line, start_line * 1000 + id) AS end_line, row_number() OVER (PARTITION BY video ORDER BY island) AS id FROM r GROUP BY video, island""",
    "deduplicate_segments": f"WITH {A.BLUEPRINT} SELECT video, MIN(id) AS id, title FROM blueprint GROUP BY video, title",
    "repair_segments": f"""WITH RECURSIVE {A.BLUEPRINT}, o AS (SELECT video, topic, start_line, end_line, row_number() OVER (PARTITION BY video ORDER BY start_line, end_line, topic) AS i FROM blueprint),
 walk AS (SELECT DISTINCT video, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS cur, CAST(1 AS BIGINT) AS was, false AS taken, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS end_line, CAST(NULL AS VARCHAR) AS topic FROM o
  UNION ALL SELECT o.video, o.i, CASE WHEN o.start_line > o.end_line OR o.start_line < w.cur THEN w.cur ELSE o.end_line + 1 END, w.cur, NOT (o.start_line > o.end_line OR o.start_line < w.cur), o.start_line, o.end_line, o.topic FROM walk w JOIN o ON o.video = w.video AND o.i = w.i + 1),
 ends AS (SELECT w.video, arg_max(w.cur, w.i) AS cur, any_value(b.total_lines) AS total FROM walk w JOIN blueprint b USING (video) GROUP BY w.video),
 rows AS (SELECT video, start_line, end_line, topic FROM walk WHERE taken UNION ALL SELECT video, was, start_line - 1, NULL FROM walk WHERE taken AND start_line > was UNION ALL SELECT video, cur, total, NULL FROM ends WHERE cur <= total)
 SELECT video, row_number() OVER (PARTITION BY video ORDER BY start_line) AS segment, start_line, end_line, coalesce(topic, 'Uncategorized Content (Lines ' || start_line || '-' || end_line || ')') AS topic FROM rows""",
    "segment_quality": f"{QUOTAS} SELECT video, segment, round(quality, 6) AS quality FROM quotas",
    "largest_remainder_quotas": f"{QUOTAS} SELECT video, segment, CAST(quota AS BIGINT) AS quota FROM quotas",
    "calls_per_agent": f"""{SELECTED}, v AS (SELECT video, COUNT(DISTINCT segment) AS segments, COUNT(*) AS questions, COUNT(*) FILTER (first OR rest <= 20 - taken) AS selected FROM s GROUP BY video),
 c AS (SELECT COUNT(*) AS videos, SUM(segments) AS segments, SUM(questions) AS questions, SUM(selected) AS selected FROM v), l AS (SELECT videos, unnest(['Architect', 'Inquisitor', 'Scorer', 'Synthesizer']) AS agent, unnest([videos, segments, questions, selected]) AS calls FROM c)
 SELECT agent, CAST(calls AS BIGINT) AS calls, round(calls * 1.0 / videos, 6) AS per_video FROM l""",
    "select_proportional": f"{SELECTED} SELECT video, segment, id FROM s WHERE first OR rest <= 20 - taken",
    "selection_status": f"{SELECTED} SELECT video, segment, id, CASE WHEN first OR rest <= 20 - taken THEN 'Selected' ELSE 'Rejected' END AS status FROM s",
    "skip_topics": f"WITH {A.BLUEPRINT} SELECT video, segment, topic FROM blueprint WHERE topic <> 't1'",
    "pick_min_overlap": MIN_OVERLAP,
    "seeded_order": f"WITH {A.POOL} SELECT video, id, row_number() OVER (ORDER BY md5(video || '|' || id || '|7'), video, id) AS question_number FROM pool",
    "seeded_shuffle": f"WITH {A.POOL} SELECT video, id, row_number() OVER (PARTITION BY video ORDER BY md5(id || '|7'), id) AS question_number FROM pool",
    "retrieve_top_k": """WITH p AS (SELECT q.vec_id AS q_id, c.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 6) AS distance FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0)
 SELECT q_id, distance, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY distance, chunk_id) AS rank FROM p QUALIFY rank <= 5""",
}
