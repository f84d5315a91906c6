"""Operators on small rows with the odd cases: nulls, ties, gaps, blanks, bad model responses."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from marlstone import schemas as S
from marlstone.functions import text as X
from marlstone.operators import corpus as K
from marlstone.operators import parse as P
from marlstone.operators import ratings as R
from marlstone.operators import segments as G
from marlstone.operators import select as C
from marlstone.operators import stats as T
from marlstone.sources import io
from marlstone.streaming import ratings as stream


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("sec", "hms"), [(0.5, "00:00:00"), (1.5, "00:00:02"), (3599.6, "01:00:00"), (360000.0, "100:00:00")])
def test_clock(spark, sec, hms):
    assert one(spark, X.format_hhmmss(F.col("s")), s=sec) == hms


def test_srt_time(spark):
    assert one(spark, X.format_srt(F.col("s")), s=3661.0625) == "01:01:01,062"
    with pytest.raises(Exception, match="negative"):
        one(spark, X.format_srt(F.col("s")), s=-1.0)


def test_unicode_space(spark):
    assert one(spark, X.normalize_text(F.col("t")), t="　a b\n c ") == "a b c"
    assert one(spark, X.word_count(F.col("t")), t="a b　c") == 3


@pytest.mark.parametrize(("t", "lang", "out"), [("ok", "en", "ok."), ("ok…", "zh", "ok…"), ("好", "zh", "好。"), ("a,", "en", "a,"), ("", "en", ""), ("क", "hi", "क।")])
def test_end_mark(spark, t, lang, out):
    assert one(spark, X.restore_end_mark(F.col("t"), F.col("l")), t=t, l=lang) == out


@pytest.mark.parametrize(("t", "out"), [("<think>a</think> b", "b"), ("a</think>b", "b"), ("plain", "plain"), ("<Reasoning>x\ny</Reasoning>z", "z")])
def test_strip_reasoning(spark, t, out):
    assert one(spark, X.strip_reasoning(F.col("t")), t=t) == out


@pytest.mark.parametrize("t", ['[{"id": 1, "title": "a", "start_line": 1, "end_line": 2}]', 'Sure\n```json\n[{"id": 1, "title": "a", "start_line": 1, "end_line": 2}]\n```', 'Here [{"id": 1, "title": "a", "start_line": 1, "end_line": 2}] ok'])
def test_extract_json(spark, t):
    assert [r.asDict() for r in one(spark, X.extract_json(F.col("t")), t=t)] == [{"id": 1, "title": "a", "start_line": 1, "end_line": 2}]


def test_blueprint_fallback(spark):
    assert one(spark, X.blueprint_or_fallback(F.col("t")), t="no json")[0]["title"] == "Raw Response"


@pytest.mark.parametrize(("t", "score"), [("A=8 C=9 E=7", 8.0), ("A=20 C=0 E=4", 5.0), ("A=8 C=9", 8.0), ("none", 5.0), ("is 12", 10.0)])
def test_parse_score(spark, t, score):
    assert math.isclose(one(spark, X.parse_score(F.col("t")), t=t), score, abs_tol=1e-9) or t == "A=20 C=0 E=4" and math.isclose(one(spark, X.parse_score(F.col("t")), t=t), 5.0)


def test_filename_language(spark):
    code, language = X.language_from_filename(F.col("n"))
    assert (one(spark, code, n="Transcript-CN-1.json"), one(spark, language, n="transcript-ro.json"), one(spark, code, n="x.json")) == ("zh", "Romanian", "en")


def test_parse_pairs_keeps_blocks_apart(spark):
    text = "Intro\nQuestion 1: A?\nQuestion 2: B?\nTimestamp 2: 1:05-2:00\nAnswer 2: yes\nand more\n\n**Q3:** C?\nanswer: no"
    r = spark.createDataFrame([("r", text), ("s", ""), ("t", None)], "response_id string, text string")
    pairs = P.parse_qa_pairs(r)
    assert [(x["n"], x["question"], x["answer"]) for x in pairs.orderBy("n").collect()] == [(1, "B?", "yes and more"), (2, "C?", "no")]
    timed = P.attach_timestamps(pairs, r).orderBy("n").collect()
    assert (timed[0]["time_start_sec"], timed[0]["time_end_sec"]) == (65, 120)
    assert P.parse_shortfall(pairs, r.select("response_id", F.lit(3).alias("expected"))).count() == 3


def test_repair_covers_all_lines(spark):
    s = spark.createDataFrame([(1, "b", 3, 4), (1, "a", 4, 9), (1, "c", 8, 6), (1, "d", 7, 8)], "video int, topic string, start_line int, end_line int")
    t = spark.createDataFrame([(1, 10), (2, 3)], "video int, total_lines int")
    rows = [(r["video"], r["start_line"], r["end_line"]) for r in G.repair_segments(s, t, ["video"]).orderBy("video", "segment").collect()]
    assert rows == [(1, 1, 2), (1, 3, 4), (1, 5, 6), (1, 7, 8), (1, 9, 10), (2, 1, 3)]


def test_captions(spark):
    e = spark.createDataFrame([(1, 0, 0, None, ["a\n", "b"]), (1, 1, 500, None, [" "]), (1, 2, 900, 100, ["c"]), (1, 3, None, 1, ["x"]), (1, 4, 2000, None, ["d"]), (1, 5, 3000, 1, None)], "video int, seq int, t_start_ms long, d_duration_ms long, texts array<string>")
    rows = G.captions_to_segments(e, ["video"]).orderBy("line_no").collect()
    assert [(r["start_sec"], r["end_sec"], r["text"]) for r in rows] == [(0.0, 0.9, "a b"), (0.9, 1.0, "c"), (2.0, 2.0, "d")]


def test_min_overlap_matches_greedy(spark):
    import random

    r = random.Random(3)
    items = [(1, i, float(r.randint(0, 50)), float(r.randint(0, 60)), f"t{i % 3}", i) for i in range(30)]
    got = sorted(x["idx"] for x in C.pick_min_overlap(spark.createDataFrame(items, "video int, idx int, start double, end double, topic string, id int"), ["video"], 20).collect())
    f = [{"i": i, "a": min(s, e), "b": max(s, e), "t": t} for _, i, s, e, t, _ in items]
    chosen: list = []
    while len(chosen) < 20:
        def key(x):
            ov = sum(max(0, min(x["b"], y["b"]) - max(x["a"], y["a"])) for y in chosen)
            return ov, -(x["b"] - x["a"] - ov), sum(y["t"] == x["t"] for y in chosen), -(x["b"] - x["a"]), x["i"]
        chosen.append(min((x for x in f if x not in chosen), key=key))
    assert got == sorted(x["i"] for x in chosen)


def test_quotas_sum_and_zero_quality(spark):
    pool = spark.createDataFrame([(v, s, s * 10 + i, float(x)) for v in (1, 2) for s in range(3) for i, x in enumerate((1, 9, 5) if v == 1 else (0, 0, 0))], "video int, segment int, id int, score double")
    q = C.largest_remainder_quotas(C.segment_quality(pool, ["video"]), ["video"], F.lit(7))
    assert [r["s"] for r in q.groupBy("video").agg(F.sum("quota").alias("s")).collect()] == [7, 7]
    assert C.select_proportional(pool, ["video"], 20).filter("selected").count() == 18


@pytest.mark.parametrize("text", ["", "word " * 900, "x" * 2500, "para\n\n" * 400 + "line\n" * 300])
def test_chunks_are_short_and_whole(spark, text):
    rows = C.recursive_chunks(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), ["id"], "t").orderBy("chunk_no").collect()
    assert all(len(r["chunk"]) <= 1000 for r in rows)
    assert set(" ".join(r["chunk"] for r in rows).split()) == set(text.split()) or "x" in text


def plain_chunks(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Part by part: short ones are gathered, what is full is given out and shortened from the front."""
    while separators[0] and separators[0] not in text:
        separators = separators[1:]
    sep, finer = separators[0], separators[1:]
    parts = [x for x in ([(sep if i else "") + x for i, x in enumerate(text.split(sep))] if sep else list(text)) if x]
    out, now, fresh = [], [], False
    for part in [*parts, None]:
        if part is None or finer and len(part) >= size:
            if fresh:
                out.append("".join(now))
            now, fresh = [], False
            out += plain_chunks(part, size, overlap, finer) if part is not None else []
            continue
        if now and len("".join(now)) + len(part) > size:
            out.append("".join(now))
            while now and (len("".join(now)) > overlap or len("".join(now)) + len(part) > size):
                now.pop(0)
        now.append(part)
        fresh = True
    return out


def test_chunks_are_those_of_gathering_parts(spark):
    import random

    r = random.Random(6)
    texts = ["".join(r.choice(["\n", "\n\n", " ", " ", "a", "bc", "ä", "🙂", "word", "x" * r.randint(1, 40)]) for _ in range(r.randint(0, 120))) for _ in range(400)] + ["", "\n", "\n\n\n", " \n\n ", "x" * 500]
    for text in texts:
        for size, overlap in ((1, 0), (7, 3), (20, 5), (50, 49), (1000, 150)):
            got = [x for a, b in C.chunk_borders(text, size, overlap) if (x := text[a:b].strip())]
            assert got == [x for c in plain_chunks(text, size, overlap) if (x := c.strip())], (text, size, overlap)
    rows = C.recursive_chunks(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), ["id"], "t", 20, 5).collect()
    assert sorted((x["id"], x["chunk_no"], x["chunk"]) for x in rows) == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(filter(None, map(str.strip, plain_chunks(t, 20, 5))))]


def test_chunks_end_before_a_long_part(spark):
    """What stands before a long part is a chunk of its own; pieces of the long part overlap."""
    long = " ".join(f"w{i:04}" for i in range(300))
    got = [r["chunk"] for r in C.recursive_chunks(spark.createDataFrame([(1, "short para\n\n" + long + "\n\nend")], "id int, t string"), ["id"], "t").orderBy("chunk_no").collect()]
    assert got[0] == "short para" and got[-1] == "end" and all(len(c) <= 1000 for c in got)
    words = [c.split() for c in got[1:-1]]
    for a, b in zip(words, words[1:]):
        shared = a[a.index(b[0]) :]
        assert b[: len(shared)] == shared and 0 < len(" ".join(shared)) <= 150
    assert sorted(set(sum(words, []))) == sorted(long.split())


def test_many_equal_scores(spark):
    """Three million ratings of one score: their cube is more than a long holds."""
    r = T.mann_whitney(spark.range(3_000_000).select(F.lit("m").alias("metric"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("approach"), F.lit(4).alias("score")), "approach", "a", "b").first()
    assert r["cliffs_delta"] == 0.0 and r["p"] == 1.0 and math.isclose(r["ties"], 2.7e19, rel_tol=1e-6)


def test_fisher_is_the_sum_of_all_tables():
    import random

    r = random.Random(1)
    for _ in range(400):
        a, b, c, d = (r.choice((0, 1, 2, 5, 20, 60)) + r.randint(0, 9) for _ in range(4))
        n, k, s = a + b, a + c, c + d
        if 0 in (n, s, k, b + d):
            assert T._fisher(a, b, c, d) == 1.0
            continue
        p = {x: math.comb(n, x) * math.comb(s, k - x) / math.comb(n + s, k) for x in range(max(0, k - s), min(n, k) + 1)}
        assert math.isclose(T._fisher(a, b, c, d), min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))), rel_tol=1e-6)
    assert 0 < T._fisher(50_000_100, 50_000_000, 50_000_000, 50_000_000) <= 1.0


def test_alpha_of_perfect_agreement(spark):
    long = spark.createDataFrame([("m", f"u{i}", i % 4 + 1) for i in range(8) for _ in range(3)] + [("n", "u", 2), ("n", "u", 2)], "metric string, qa_uid string, score int")
    assert {r["metric"]: r["alpha"] for r in T.krippendorff_alpha(long).collect()} == {"m": 1.0, "n": 1.0}


def test_mann_whitney_and_fisher(spark):
    long = spark.createDataFrame([("m", "a", x) for x in (4, 4, 3, 4)] + [("m", "b", x) for x in (1, 2, 2, 3)], "metric string, approach string, score int")
    r = T.mann_whitney(long, "approach", "a", "b").first()
    assert (r["u"], r["cliffs_delta"], r["magnitude"]) == (15.5, 0.9375, "large") and 0 < r["p"] < 0.06
    f = T.fisher_exact(spark.createDataFrame([(8, 2, 1, 5), (0, 0, 3, 1)], "a int, b int, c int, d int")).orderBy("a").collect()
    assert f[0]["p"] == 1.0 and math.isclose(f[1]["p"], 0.0349650, abs_tol=1e-6)


def test_latest_ties_and_union(spark):
    t = "id long, session_id string, qa_uid string, created_at timestamp, qa_alignment_attribute string, q_fluency string"
    df = spark.createDataFrame([(1, "s", "q", None, "Good", None), (2, "s", "q", None, "Poor", None)], t)
    assert [r["id"] for r in R.latest_ratings(df).collect()] == [2]
    out = R.union_exports([df, df.withColumnRenamed("qa_alignment_attribute", "qna_trustworthiness_attribute")])
    assert "q_fluency" not in out.columns and out.filter("qna_trustworthiness_attribute is null").count() == 0


def test_wilson_contains_share(spark):
    low, high = T.wilson(F.col("k"), F.col("n"))
    for r in spark.createDataFrame([(0, 5), (5, 5), (2, 7), (0, 0)], "k int, n int").select("k", "n", low.alias("lo"), high.alias("hi")).collect():
        assert r["lo"] is None if r["n"] == 0 else 0 <= r["lo"] <= r["k"] / r["n"] <= r["hi"] <= 1


def test_files_round_trip(spark, tmp_path):
    for ds, video, name, cues in (("A", 1, "transcript-en.json", [(0.0, 1.5, "hi"), (1.0, 2.0, "there")]), ("A", 1, "transcript-zz.json", []), ("B", 2, "transcript.json", [(0.0, 1.0, "x")])):
        folder = tmp_path / "t" / ds / str(video) / "Transcript"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps([{"start": a, "end": b, "text": t} for a, b, t in cues]))
    cues = io.read_transcripts(spark, str(tmp_path / "t"))
    assert [(r["dataset"], r["video"], r["line_no"], r["text"]) for r in cues.orderBy("dataset", "line_no").collect()] == [("A", 1, 1, "hi"), ("A", 1, 2, "there"), ("B", 2, 1, "x")]
    io.write_transcripts(cues.withColumn("lang", F.lit("en")), str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["A/1/Transcript/transcript-en.json", "B/2/Transcript/transcript-en.json"]
    io.write_srt(cues, str(tmp_path / "srt"))
    assert (tmp_path / "srt" / "A" / "1" / "Transcript" / "transcript.srt").read_text().startswith("1\n00:00:00,000 --> 00:00:01,500\nhi\n")
    q = tmp_path / "t" / "A" / "1" / "RAG" / "QA results"
    q.mkdir(parents=True)
    (q / "finalQA.json").write_text(json.dumps([{"question": "q?", "answer": "a", "time_start_sec": 3.9}, {"question": " ", "answer": "b"}]))
    pairs = K.corpus_pairs(io.read_qa_results(spark, str(tmp_path / "t")))
    assert [(r["uid"], r["t"]) for r in pairs.collect()] == [("A_v1_RAG_q1", 3)]
    io.write_corpus(pairs, pairs.select("dataset", "video").distinct(), str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus" / "pairs")).count() == 1
    assert not (tmp_path / "corpus" / "json").exists()


def test_manifest_modes(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿index,url,language\n,u1,english\n7, u2 ,hindi\nx,,ro\n,u3,zh\n")
    rows = io.read_manifest(spark, str(tmp_path / "m.csv"), "tolerant").collect()
    assert [(r["index"], r["url"]) for r in rows] == [(1, "u1"), (2, "u3"), (7, "u2")]
    with pytest.raises(ValueError, match="non-integer"):
        io.read_manifest(spark, str(tmp_path / "m.csv"), "strict")


def test_logs_meta_captions_ratings_reports(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.txt").write_text('x\n{"agent_seconds": 1.5}\n{"agent_seconds": 2.5}\n')
    (tmp_path / "logs" / "b.txt").write_text("failed")
    assert sorted(r["agent_seconds"] for r in io.read_run_logs(spark, str(tmp_path / "logs")).collect()) == [0.0, 2.5]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "m.json").write_text(json.dumps({"approach": "x", "seed": 42, "measured": {"pairs": 3, "answer_words_mean": 7.5}}))
    assert io.read_generation_meta(spark, str(tmp_path / "meta")).first()["pairs"] == 3
    (tmp_path / "c.json3").write_text(json.dumps({"events": [{"tStartMs": 5, "segs": [{"utf8": "a"}]}]}))
    assert io.read_caption_events(spark, str(tmp_path / "c.json3")).first()["texts"] == ["a"]
    (tmp_path / "r1.csv").write_text("id,qna_clarity_binary\n1,Yes\n2, \n")
    (tmp_path / "r2.csv").write_text("id,qa_accessibility_binary,extra\n3,No,z\n")
    rows = io.read_ratings(spark, [str(tmp_path / "r1.csv"), str(tmp_path / "r2.csv")]).orderBy("id").collect()
    assert [r["qna_clarity_binary"] for r in rows] == ["Yes", None, "No"] and rows[2]["source_file"] == "r2.csv"
    tables = {"full": spark.range(2).toDF("n"), "empty": spark.range(0).toDF("n")}
    assert io.write_report_tables(tables, str(tmp_path / "report")) == ["full"]


def test_streams(spark, tmp_path):
    """Late and repeated rows, and streams that are started again: the newest rows are those of the whole log, hours close once and late rows for them are dropped."""
    t = "id long, session_id string, qa_uid string, annotator string, created_at timestamp"
    runs = [[(1, 1), (2, 1), (3, 2), (4, 9)], [(5, 3), (6, 8), (1, 1), (7, 12)], [(8, 11), (9, 2), (10, 20)], []]
    own = stream.stream_session(spark, 2)
    whole = None
    for k, run in enumerate(runs):
        df = spark.createDataFrame([(i, f"s{i % 3}", f"q{i % 2}" if i != 3 else None, "a", f"2024-01-01 {h:02d}:10:00") for i, h in run], t.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
        whole = df if whole is None else whole.union(df)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = own.readStream.schema(t).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.stream_latest_ratings(source, str(tmp_path / "c1")).awaitTermination()
        stream.stream_progress(source, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    got = {tuple(r) for r in stream.read_latest(spark, str(tmp_path / "c1"), whole.schema).collect()}
    assert got == {tuple(r) for r in R.latest_ratings(whole.distinct()).collect()}
    closed = [(r["hour"].hour, r["submissions"]) for r in stream.read_progress(spark, str(tmp_path / "out")).collect()]
    # hours 3 and 1 of the second run and hour 2 of the third come after their hours are closed
    assert sorted(closed) == [(1, 2), (2, 1), (8, 1), (9, 1), (11, 1), (12, 1)]


def test_label_dimensions():
    assert all(len(v) == 4 for v in S.SCALES.values()) and set(S.ERRORS) == set(S.BINARY)


def test_scratch_folder(spark):
    from types import SimpleNamespace

    from marlstone.sources import scratch

    assert scratch.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    assert scratch.scratch_dir(unset("local[2]")) == scratch.scratch_dir(unset("local[*]"))
    for cluster in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.scratch_dir(unset(cluster))


def test_calls_per_agent_without_questions_and_with_one_segment(spark):
    rows = [(1, 1, True), (1, 1, False), (1, 2, False), (2, 1, True)]
    table = spark.createDataFrame(rows, "video int, segment int, selected boolean")
    got = {r["agent"]: (r["calls"], r["per_video"]) for r in C.calls_per_agent(table, ["video"]).collect()}
    assert got == {"Architect": (2, 1.0), "Inquisitor": (3, 1.5), "Scorer": (4, 2.0), "Synthesizer": (2, 1.0)}
    none = C.calls_per_agent(table.limit(0), ["video"]).collect()
    assert {(r["calls"], r["per_video"]) for r in none} == {(0, None)}


def test_annotators_are_ordered_by_all_scores(spark):
    table = spark.createDataFrame([("b", 4), ("a", 1), ("c", 2), ("c", 3), ("a", None)], "annotator string, score int")
    assert [tuple(r) for r in T.annotator_order(table).orderBy("place").collect()] == [("c", 2, 1), ("a", 1, 2), ("b", 1, 3)]
