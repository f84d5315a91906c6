"""Files under chosen names: whole or not at all, and rating exports of any vintages in one folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone.sources import io
from marlstone.sources.named_files import write_named_files


def files(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_named_files(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("d%d/ä %d.txt", F.col("id") % 3, "id").alias("path"), F.when(F.col("id") != 5, F.concat(F.lit("t\n"), "id")).alias("value"), F.lit(1).alias("other"))
    write_named_files(rows.repartition(5), str(tmp_path / "a"))
    want = {f"d{i % 3}/ä {i}.txt": "" if i == 5 else f"t\n{i}" for i in range(40)}
    assert files(tmp_path / "a") == want
    write_named_files(spark.createDataFrame([("d0/ä 0.txt", "new")], "path string, value string"), f"file://{tmp_path}/a")
    assert files(tmp_path / "a") == want | {"d0/ä 0.txt": "new"}
    write_named_files(rows.limit(0), str(tmp_path / "a"))
    assert len(files(tmp_path / "a")) == 40


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.when(F.col("id") == 39, "../out").otherwise(F.concat(F.lit("x/"), "id")).alias("path"), F.lit("v").alias("value"))
    with pytest.raises(Exception, match="no place under the folder"):
        write_named_files(rows.repartition(4), str(tmp_path / "a"))
    assert not (tmp_path / "a").exists() or not list((tmp_path / "a").rglob("*"))


def test_a_task_that_is_lost_is_done_again(tmp_path):
    """Two retries of a failing task and a second job: what failed attempts staged is nowhere in the result."""
    import subprocess
    import sys

    code = f'''
import os
from pyspark.sql import SparkSession
from marlstone.sources.named_files import write_named_files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
def work(batches):
    for k, b in enumerate(batches):
        yield b
    if not os.path.exists("{tmp_path}/died"):
        open("{tmp_path}/died", "w").close()
        raise RuntimeError("lost")
rows = spark.range(0, 30, 1, 1).selectExpr("concat('v/', id) AS path", "'text' AS value").mapInArrow(work, "path string, value string")
write_named_files(rows, "{tmp_path}/out")
'''
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert (tmp_path / "died").exists() and files(tmp_path / "out") == {f"v/{i}": "text" for i in range(30)}


def test_a_corpus_document_is_one_json_document(spark, tmp_path, monkeypatch):
    """Parts of few items, odd names, left out and repeated videos, nulls; the files one after the other are what json reads."""
    import json

    monkeypatch.setattr(io, "PART", 3)
    pairs = [(f"u{i}", 'a"}{:\n' if i % 2 else "b", i % 5, "RAG", i, f"q,\n{i}", f'"ä{i}"', i if i % 3 else None, None) for i in range(20)]
    videos = [(ds, i, f"http://{ds}/{i}", None if i == 2 else "english") for ds in ('a"}{:\n', "b", "[c]") for i in range(7)]
    odd = [("b", 3, "http://a", "z"), ("b", 8, " ", "x"), ("b", 9, None, "x"), (None, 1, "u", "x"), ("b", None, "u", "x"), ("blank only", 1, "", "x")]
    p = spark.createDataFrame(pairs, "uid string, dataset string, video long, approach string, n int, question string, answer string, t int, te int")
    v = spark.createDataFrame(videos + odd, "dataset string, video long, url string, language string").repartition(4)
    folder = tmp_path / "doc"
    io.write_corpus_document(p, v, str(folder))
    got = json.loads("".join(f.read_text() for f in sorted(folder.iterdir())))
    names = p.columns
    assert got["pairs"] == [{k: x for k, x in zip(names, r, strict=True) if x is not None} for r in sorted(pairs, key=lambda r: (r[1], r[2], r[3], r[4]))]
    want: dict = {}
    for ds, i, url, language in videos:
        want.setdefault(ds, {})[str(i)] = {"url": url, "language": language or ""}
    want["b"]["3"] = {"url": "http://a", "language": "z"}
    assert got["videos"] == want and len(list(folder.iterdir())) == 3 + 7 + 9
    back, links = io.read_corpus_document(spark, str(folder))
    assert sorted(tuple(r[c] for c in names) for r in back.collect()) == sorted(pairs)
    assert {(r["dataset"], str(r["video"])): (r["url"], r["language"]) for r in links.collect()} == {(ds, i): (x["url"], x["language"]) for ds, m in want.items() for i, x in m.items()}
    with pytest.raises(Exception, match="isn't empty"):
        io.write_corpus_document(p, v, str(folder))
    io.write_corpus_document(p.limit(0), v.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").iterdir()))) == {"pairs": [], "videos": {}}
    assert [x.count() for x in io.read_corpus_document(spark, str(tmp_path / "none"))] == [0, 0]


def test_files_that_are_not_there(spark, tmp_path):
    (tmp_path / "a" / "dir").mkdir(parents=True)
    (tmp_path / "a" / "x 1").write_text("")
    rows = spark.createDataFrame([(1, "x 1"), (2, "x 2"), (3, "dir"), (4, None), (5, ""), (6, "x 1")], "id int, place string")
    for folder in (f"{tmp_path}/a/", f"file://{tmp_path}/a"):
        assert sorted(r["id"] for r in io.pending_files(rows, folder, F.col("place")).collect()) == [2, 3, 4, 5]
    assert io.pending_files(rows, f"{tmp_path}/none", F.col("place")).columns == ["id", "place"]
    assert io.pending_files(rows, f"{tmp_path}/none", F.col("place")).count() == 6


def test_exports_of_mixed_vintages_in_one_folder(spark, tmp_path):
    folder = tmp_path / "in [1]"
    folder.mkdir()
    (folder / "a b.csv").write_text("id,session_id,qna_clarity_binary\n1,s1,Yes\n")
    (folder / "b.csv").write_text("session_id,qna_clarity_binary,id\ns2,No,2\n")
    (folder / "c.csv").write_text("\ufeffid,qa_accessibility_binary,extra\r\n3,Yes,\"z\nz\"\r\n")
    (folder / "d.csv").write_text("id,session_id,qna_clarity_binary\n4,s4, \n")
    (folder / "empty.csv").write_text("")
    got = io.read_ratings(spark, [str(folder).replace("[", "\\[").replace("]", "\\]")]).orderBy("id").collect()
    assert [(r["id"], r["session_id"], r["qna_clarity_binary"], r["source_file"].replace("%20", " ")) for r in got] == [("1", "s1", "Yes", "a b.csv"), ("2", "s2", "No", "b.csv"), ("3", None, "Yes", "c.csv"), ("4", "s4", None, "d.csv")]
    assert got[2]["extra"].replace("\r", "") == "z\nz"
    (folder / "sub").mkdir()
    with pytest.raises(ValueError, match="no export"):
        io.read_ratings(spark, [f"{tmp_path}/in*/sub*"])


def test_manifest_numbers_follow_the_files(spark, tmp_path):
    """The same numbers whatever the split size, over several files that are cut into many splits."""
    folder = tmp_path / "m"
    folder.mkdir()
    for name in ("b.csv", "a.csv", "c.csv"):
        (folder / name).write_text("index,url,language\n" + "".join(f",{name}-{i:04d},english\n" for i in range(400)))
    want = [(k + 1, f"{n}.csv-{i:04d}") for k, (n, i) in enumerate((n, i) for n in "abc" for i in range(400))]
    for size in ("1k", "64m"):
        own = spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", size)
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        assert [(r["index"], r["url"]) for r in io.read_manifest(own, str(folder)).collect()] == want


def test_numbers_of_a_whole_table(spark):
    from marlstone.operators.order import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("old").alias("n")).repartition(9)
    assert all(r["n"] == r["x"] + 5 for r in numbered(rows, ["x"], "n", 5).collect())
    assert numbered(rows.limit(0), ["x"], "n").count() == 0


def test_tasks_list_and_read_files(spark, tmp_path, monkeypatch):
    """The files, names and texts of Spark's reader, which isn't asked, so the driver lists nothing; flat, deep and odd folders, and the first transcript of a video before any is read."""
    glob = "*.t?t"
    for name in ("a.txt", "x/b.txt", "x/y 1/ä%#[1].txt", "x/y 1/z/w/c.txt", "x/_h/d.txt", "x/.h/e.txt", "_f.txt", ".g.txt", "x/_k=1/i.txt", "x/j.json", "empty/k.txt", "bad/l.txt", *[f"flat/{i}.txt" for i in range(2500)]):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes({"k": b"", "l": b"\xff\xfe\n"}.get(name[-5], f"of\r\n{name}\n".encode()))
    (tmp_path / "in" / "none").mkdir()
    plain = spark.read.text(str(tmp_path / "in"), wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select("_metadata.file_path", F.hex("value"))
    want = sorted(tuple(r) for r in plain.collect())
    (tmp_path / "t" / "A" / "1" / "Transcript").mkdir(parents=True)
    (tmp_path / "t" / "A" / "1" / "Transcript" / "transcript-b.json").write_text("no list")
    (tmp_path / "t" / "A" / "1" / "Transcript" / "transcript-0.json").write_text("")
    (tmp_path / "t" / "A" / "1" / "Transcript" / "transcript-a.json").write_text('[{"start": 0, "end": 1, "text": "t"}]')
    with monkeypatch.context() as m:
        m.setattr(type(spark), "read", property(lambda self: pytest.fail("the driver lists files")))
        for folder in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
            assert sorted((r["path"], r["value"]) for r in io.whole_files(spark, folder, glob).select("path", F.hex("value").alias("value")).collect()) == want
        assert [r["path"] for r in io.whole_files(spark, f"{tmp_path}/in/x/b.txt", glob).collect()] == [f"file:{tmp_path}/in/x/b.txt"]
        assert io.whole_files(spark, f"{tmp_path}/in/none", glob).count() == 0
        assert [(r["name"], r["text"]) for r in io.read_transcripts(spark, f"{tmp_path}/t").collect()] == [("transcript-a.json", "t")]
        with pytest.raises(FileNotFoundError):
            io.whole_files(spark, f"{tmp_path}/nowhere", glob)
    assert len(want) == 2500 + 6 and sorted(r["path"] for r in io.whole_files(spark, f"{tmp_path}/i[n]", glob).collect()) == [p for p, _ in want]


def test_a_commit_holds_few_names(spark, tmp_path, monkeypatch):
    """Lists longer than what the driver holds at once are moved whole."""
    from marlstone.sources import named_files

    monkeypatch.setattr(named_files, "LINES", 7)
    writer = named_files.NamedFilesWriter(str(tmp_path / "out"))
    staged = tmp_path / "out" / writer.staging.rsplit("/", 1)[1] / "0-0"
    staged.mkdir(parents=True)
    for i in range(50):
        (staged / str(i)).write_text(str(i))
    (staged / "list").write_text("".join(f'["{staged}/{i}", "d{i % 9}/{i}"]\n' for i in range(50)))
    writer.commit([named_files.Listed(f"{staged}/list"), None, named_files.Listed(None)])
    assert files(tmp_path / "out") == {f"d{i % 9}/{i}": str(i) for i in range(50)}


def test_transcripts_are_listed_and_read_once(spark, tmp_path):
    """The first name of a video is found among the names: one listing in three steps and one reading; equal names under two roots are both first."""
    for root in ("r1", "r2"):
        (tmp_path / root / "A" / "1" / "Transcript").mkdir(parents=True)
        for name in ("transcript-a.json", "transcript-b.json"):
            (tmp_path / root / "A" / "1" / "Transcript" / name).write_text(f'[{{"start": 0, "end": 1, "text": "{root} {name}"}}]')
    out = io.read_transcripts(spark, str(tmp_path))
    assert sorted(r["text"] for r in out.collect()) == ["r1 transcript-a.json", "r2 transcript-a.json"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4


def test_no_reader_of_whole_files_asks_the_driver(spark, tmp_path, monkeypatch):
    """Captions of many videos: listed and read by tasks."""
    events = spark.range(600).selectExpr("CASE WHEN id % 2 = 0 THEN 'n' ELSE 's' END AS dataset", "id div 2 AS video", "id AS seq", "id AS t_start_ms", "5L AS d_duration_ms", "array('a', string(id)) AS texts")
    io.write_caption_events(events, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(type(spark), "read", property(lambda self: pytest.fail("the driver lists files")))
        got = io.read_caption_events(spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["seq"], r["t_start_ms"], r["texts"]) for r in got) == sorted((f"file:{tmp_path}/{'ns'[i % 2]}/{i // 2}/Transcript/captions.json3", 0, i, ["a", str(i)]) for i in range(600))
