"""Readers and writers of the files around transcripts, results, ratings and runs. Schemas are given, never inferred."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone import schemas as S
from marlstone.functions.text import format_srt
from marlstone.operators.corpus import auto_index
from marlstone.operators.order import numbered
from marlstone.operators.ratings import blank_to_null, union_exports
from marlstone.sources.named_files import named_paths, tasks_can_list, texts_of, without_file, write_named_files


def read_manifest(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    """CSV index,url,language. lenient: missing indices are numbered; tolerant: rows without url go, bad indices are numbered; strict: both raise.

    Numbers follow the input: files by name, rows as they stand in them, however Spark splits and packs the files.
    """
    raw = spark.read.csv(path, header=True, schema="index string, url string, language string", enforceSchema=False, encoding="UTF-8")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")]
    rows = raw.select(*[F.trim(F.regexp_replace(c, "^﻿", "")).alias(c) for c in raw.columns], *place)
    rows = rows.withColumn("number", F.col("index").try_cast("int"))
    if mode == "strict":
        bad = rows.filter("number is null or coalesce(url, '') = '' or coalesce(language, '') = ''").limit(5).collect()
        if bad:
            raise ValueError(f"the manifest has empty or non-integer values: {[r.asDict() for r in bad]}")
    if mode == "tolerant":
        rows = rows.filter("coalesce(url, '') <> ''")
    out = numbered(rows, ["_file", "_block", "_row"], "_place").select(F.col("number").cast("long").alias("index"), "url", "language", F.col("_place").alias("_at"))
    return auto_index(out, "_at").drop("_at").orderBy("index")


def whole_files(spark: SparkSession, path: str, glob: str, chosen: Callable[[DataFrame], DataFrame] = lambda files: files) -> DataFrame:
    """(path, value) of the files under path whose names match glob; folders are walked, so that one call reads all videos.

    ``chosen`` keeps the files that are wanted, before they are read. Tasks list and read them; what they can't list (see ``tasks_can_list``) is left to Spark's reader, whose driver holds the list of all files.
    """
    if tasks_can_list(path, glob):
        return texts_of(chosen(named_paths(spark, path, glob)), path)
    # the path of a row is asked for before any shuffle
    out = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return chosen(out.select(F.col("_metadata.file_path").alias("path"), "value"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """<dataset>/<video>/Transcript/transcript*.json -> (dataset, video, name, line_no, start_sec, end_sec, text): the first file by name of each video; one that is no list raises."""
    parts = [F.regexp_extract("path", r"([^/]+)/(\d+)/Transcript/(transcript[^/]*\.json)$", k).alias(c) for k, c in ((1, "dataset"), (2, "video"), (3, "name"))]

    def first(files: DataFrame) -> DataFrame:
        named = files.select("*", *parts).filter("name <> ''")
        return named.withColumn("_rank", F.rank().over(Window.partitionBy("dataset", "video").orderBy("name"))).filter("_rank = 1")

    files = whole_files(spark, path, "transcript*.json", first).select(*parts, "value")
    cues = F.from_json("value", F.lit("ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>"))
    listed = F.when(~F.coalesce(F.ltrim("value").startswith("["), F.lit(False)) | cues.isNull(), F.raise_error(F.concat(F.lit("no list of cues: "), "dataset", F.lit("/"), "video", F.lit("/"), "name"))).otherwise(cues)
    return files.select("dataset", F.col("video").cast("int").alias("video"), "name", F.posexplode(listed).alias("at", "c")).select("dataset", "video", "name", (F.col("at") + 1).alias("line_no"), F.col("c.start").alias("start_sec"), F.col("c.end").alias("end_sec"), "c.text")


def read_caption_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON3 payloads -> (path, seq, t_start_ms, d_duration_ms, texts); a file whose events are no list raises."""
    files = whole_files(spark, path, "*.json3").withColumn("p", F.from_json("value", F.lit(S.CAPTIONS.removeprefix("STRUCT<").removesuffix(">").replace("events:", "events"))))
    events = F.when(F.col("p.events").isNull(), F.raise_error(F.concat(F.lit("no list of events: "), F.col("path")))).otherwise(F.col("p.events"))
    return files.select("path", F.posexplode(events).alias("seq", "e")).select("path", "seq", F.col("e.tStartMs").alias("t_start_ms"), F.col("e.dDurationMs").alias("d_duration_ms"), F.col("e.segs.utf8").alias("texts"))


def read_qa_results(spark: SparkSession, path: str) -> DataFrame:
    """<dataset>/<video>/<approach>/QA results/finalQA.json -> a row for each pair, n counts from 1 in its file."""
    place = r"([^/]+)/(\d+)/([^/]+)/QA(?: |%20)results/finalQA\.json$"
    files = whole_files(spark, path, "finalQA.json").select(*[F.regexp_extract("path", place, k).alias(c) for k, c in ((1, "dataset"), (2, "video"), (3, "approach"))], "value").filter("dataset <> ''")
    return files.select("dataset", F.col("video").cast("int").alias("video"), "approach", F.posexplode(F.from_json("value", F.lit(f"ARRAY<{S.QA_PAIR}>"))).alias("at", "q")).select("dataset", "video", "approach", (F.col("at") + 1).alias("n"), "q.*")


#: Different headers that exports may have: each is a scan of its own.
HEADERS = 200


def _by_header(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, files) of the files under paths by their first line that isn't blank; the driver gets a row for each header with the names of its files."""
    lines = spark.read.text(paths, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.filter("start = 0").withColumns({"value": F.trim(F.regexp_replace("value", "^\ufeff|\r$", "")), "at": F.monotonically_increasing_id()}).filter("value <> ''")
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    groups = heads.orderBy("head").limit(HEADERS + 1).collect()
    if len(groups) > HEADERS:
        raise ValueError(f"the exports have more than {HEADERS} different headers")
    # names come encoded, and readers take them for patterns
    return [(_names(next(csv.reader([r["head"]]))), [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in r["paths"]]) for r in groups]


def _names(header: list[str]) -> list[str]:
    """The names of a header; those that are blank or stand there twice get their place."""
    known = [h.strip() for h in header]
    twice = {h.lower() for h in known if [x.lower() for x in known].count(h.lower()) > 1}
    return [f"_c{k}" if not h else f"{h}{k}" if h.lower() in twice else h for k, h in enumerate(known)]


def read_ratings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV exports of any vintages, mixed in folders as they may be, as one table with source_file; blank cells are null.

    A reader takes the first file's header for all files of a folder, so files are grouped by header and each group is read by itself: columns
    are matched by name, whatever their order. Files without a line are left out; if there are no others, that is an error.
    """
    groups = _by_header(spark, paths)
    if not groups:
        raise ValueError(f"no export under {paths}")
    strings = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names])
    one = [spark.read.csv(own, header=True, schema=strings(names), multiLine=True, escape='"').withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1)) for names, own in groups]
    return union_exports([blank_to_null(df) for df in one])


def read_run_logs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, agent_seconds): the last ``{"agent_seconds": n}`` of each log; 0 where there is none."""
    files = whole_files(spark, path, glob)
    hits = F.regexp_extract_all("value", F.lit(r'\{\s*"agent_seconds"\s*:\s*([0-9.]+)\s*\}'), F.lit(1))
    return files.select("path", F.coalesce(F.try_element_at(hits, F.lit(-1)).cast("double"), F.lit(0.0)).alias("agent_seconds"))


def read_generation_meta(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(the sidecar's values, path): a row for each such file under path."""
    out = spark.read.json(path, schema=S.GENERATION_META, multiLine=True, recursiveFileLookup=True, pathGlobFilter=glob).withColumn("path", F.col("_metadata.file_path"))
    return out.select(*[c for c in out.columns if c != "measured"], "measured.*")


def _listed(order: str, item: Column) -> Column:
    """A JSON array of a group's items in order."""
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item")))), lambda x: x["item"]))


def write_transcripts(segments: DataFrame, folder: str) -> None:
    """segments(dataset, video, lang, line_no, start_sec, end_sec, text) -> <dataset>/<video>/Transcript/transcript-<lang>.json, an array of cues each."""
    cue = F.struct(F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "text")
    files = segments.groupBy("dataset", "video", "lang").agg(_listed("line_no", cue).alias("value"))
    write_named_files(files.withColumn("path", F.format_string("%s/%s/Transcript/transcript-%s.json", "dataset", F.col("video").cast("string"), "lang")), folder)


def write_caption_events(events: DataFrame, folder: str) -> None:
    """events(dataset, video, seq, t_start_ms, d_duration_ms, texts) -> <dataset>/<video>/Transcript/captions.json3."""
    one = F.struct(F.col("t_start_ms").alias("tStartMs"), F.col("d_duration_ms").alias("dDurationMs"), F.transform("texts", lambda t: F.struct(t.alias("utf8"))).alias("segs"))
    files = events.groupBy("dataset", "video").agg(F.concat(F.lit('{"events":'), _listed("seq", one), F.lit("}")).alias("value"))
    write_named_files(files.withColumn("path", F.format_string("%s/%s/Transcript/captions.json3", "dataset", F.col("video").cast("string"))), folder)


def write_qa_results(pairs: DataFrame, folder: str) -> None:
    """pairs(dataset, video, approach, n, question, answer, ...) -> <dataset>/<video>/<approach>/QA results/finalQA.json, its pairs in order of n."""
    known = [c for c in re.findall(r"(\w+): ", S.QA_PAIR) if c in pairs.columns]
    files = pairs.groupBy("dataset", "video", "approach").agg(_listed("n", F.struct(*dict.fromkeys(known))).alias("value"))
    write_named_files(files.withColumn("path", F.format_string("%s/%s/%s/QA results/finalQA.json", "dataset", F.col("video").cast("string"), "approach")), folder)


def write_run_logs(lines: DataFrame, folder: str) -> None:
    """lines(dataset, video, approach, line_no, line) -> <dataset>/<video>/<approach>/intermediate/run.log."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    files = lines.groupBy("dataset", "video", "approach").agg(F.array_join(texts, "\n", "").alias("value"))
    write_named_files(files.withColumn("path", F.format_string("%s/%s/%s/intermediate/run.log", "dataset", F.col("video").cast("string"), "approach")), folder)


def write_generation_meta(sidecars: DataFrame, folder: str) -> None:
    """sidecars(dataset, approach, and other columns that read_generation_meta gives) -> <dataset>/<approach>_generation_meta.json."""
    measured = [c for c in re.findall(r"(\w+): ", S.GENERATION_META) if c in sidecars.columns]
    own = [c for c in re.findall(r"(?:^|, )(\w+) (?!STRUCT)[A-Z]+", S.GENERATION_META) if c in sidecars.columns]
    value = F.to_json(F.struct(*own, F.struct(*measured).alias("measured")))
    write_named_files(sidecars.select(F.format_string("%s/%s_generation_meta.json", "dataset", "approach").alias("path"), value.alias("value")), folder)


def srt_documents(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, srt): numbered blocks of a video's cues."""
    block = F.concat(F.col("line_no").cast("string"), F.lit("\n"), format_srt(F.col("start_sec")), F.lit(" --> "), format_srt(F.col("end_sec")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    items = F.array_sort(F.collect_list(F.struct("line_no", block.alias("b"))))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["b"]), "").alias("srt"))


def write_srt(segments: DataFrame, folder: str) -> None:
    """<dataset>/<video>/Transcript/transcript.srt for each video."""
    files = srt_documents(segments, ["dataset", "video"]).withColumnRenamed("srt", "value")
    write_named_files(files.withColumn("path", F.format_string("%s/%s/Transcript/transcript.srt", "dataset", F.col("video").cast("string"))), folder)


def write_corpus(pairs: DataFrame, videos: DataFrame, path: str, as_json: bool = False) -> None:
    """Both tables as Parquet and, if asked for, as JSON lines under ``json``: one document for all would be written by one task."""
    pairs.write.mode("overwrite").partitionBy("dataset", "approach").parquet(f"{path}/pairs")
    videos.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/videos")
    if as_json:
        pairs.write.mode("overwrite").json(f"{path}/json/pairs", encoding="UTF-8")
        videos.write.mode("overwrite").json(f"{path}/json/videos", encoding="UTF-8")


#: Pairs or videos of one part of a corpus document.
PART = 1000


def _parts(lines: DataFrame, kind: str) -> DataFrame:
    """lines(group, at, line) -> (path, value): the lines of a group in order, PART of them a file."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    files = lines.groupBy("group", F.expr(f"greatest(at, 0) div {PART}").alias("part")).agg(F.concat(F.array_join(texts, "\n", ""), F.lit("\n")).alias("value"))
    return files.select(F.format_string(f"{kind}-%06d-%012d.json", "group", "part").alias("path"), "value")


def write_corpus_document(pairs: DataFrame, videos: DataFrame, folder: str) -> None:
    """pairs(uid, dataset, video, approach, n, question, answer, t, te), videos(dataset, video, url, language) as one JSON document
    ``{"pairs": [pair, ...], "videos": {dataset: {video: {url, language}}}}``: the files of folder one after the other in the order of their names.

    Pairs come by dataset, video, approach, n and uid, without fields that are null; videos by dataset and number. Videos without dataset, number or url are left out; of
    those that repeat, the least url stays, a null language is empty. No task sees more than PART of either, and the folder must be empty before, so that no part of an older document stays.
    ``cat folder/*`` or ``hadoop fs -getmerge`` makes it a single file; ``read_corpus_document`` reads it as it is.
    """
    spark = pairs.sparkSession
    comma = lambda at: F.when(F.col(at) > 0, ",").otherwise("")
    pair = F.to_json(F.struct("uid", "dataset", "video", "approach", "n", "question", "answer", "t", "te"))
    listed = numbered(pairs, ["dataset", "video", "approach", "n", "uid"], "at").select(F.lit(0).alias("group"), "at", F.concat(comma("at"), pair).alias("line"))
    known = videos.filter("dataset is not null and video is not null and trim(url) <> ''").groupBy("dataset", "video").agg(F.min(F.struct("url", F.coalesce("language", F.lit("")).alias("language"))).alias("v"))
    placed = numbered(known, ["dataset", "video"], "at")
    groups = numbered(placed.groupBy("dataset").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("size")), ["dataset"], "group")
    entry = F.concat(F.lit('"'), F.col("video").cast("string"), F.lit('":'), F.to_json("v"))
    entries = placed.join(groups, "dataset").withColumn("at", F.col("at") - F.col("low")).select("group", "at", F.concat(comma("at"), entry).alias("line"))
    name = F.regexp_replace(F.to_json(F.array("dataset")), r"^\[|\]$", "")
    opened = groups.select("group", F.lit(-1).cast("long").alias("at"), F.concat(comma("group"), name, F.lit(":{")).alias("line"))
    closed = groups.select("group", F.col("size").alias("at"), F.lit("}").alias("line"))
    fixed = spark.createDataFrame([("0-head.json", '{"pairs":[\n'), ("2-videos.json", '],"videos":{\n'), ("4-end.json", "}}\n")], "path string, value string")
    write_named_files(_parts(listed, "1-pairs").unionByName(_parts(entries.union(opened).union(closed), "3-videos")).unionByName(fixed), folder, fresh=True)


def read_corpus_document(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, videos) of a folder that ``write_corpus_document`` has written; a line that is no such item raises."""
    lines = lambda glob: spark.read.text(folder, pathGlobFilter=glob).select(F.regexp_replace("value", "^,", "").alias("line"), F.regexp_extract("_metadata.file_path", r"-(\d+)-\d+\.json$", 1).alias("group"))
    strict = {"mode": "FAILFAST"}
    pair = "uid string, dataset string, video bigint, approach string, n bigint, question string, answer string, t int, te int"
    pairs = lines("1-pairs-*.json").select(F.from_json("line", pair, strict).alias("p")).select("p.*")
    held = lines("3-videos-*.json").filter("line <> '}'")
    opens = F.col("line").endswith(":{")
    names = held.filter(opens).select("group", F.element_at(F.from_json(F.concat(F.lit("["), F.regexp_replace("line", r":\{$", ""), F.lit("]")), "array<string>", strict), 1).alias("dataset"))
    one = held.filter(~opens).select("group", F.explode(F.from_json(F.concat(F.lit("{"), "line", F.lit("}")), "map<string, struct<url: string, language: string>>", strict)).alias("video", "v"))
    return pairs, one.join(names, "group").select("dataset", F.col("video").cast("long").alias("video"), "v.url", "v.language")


def pending_files(requested: DataFrame, folder: str, place: Column) -> DataFrame:
    """The requested rows whose file, at ``place`` under folder, isn't there yet; null places are pending."""
    return without_file(requested.withColumn("_place", place), folder, "_place").drop("_place")


def write_report_tables(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Each table that has rows as CSV under its name; the names written."""
    done = [name for name, df in tables.items() if not df.isEmpty()]
    for name in done:
        tables[name].write.mode("overwrite").csv(f"{path}/{name}", header=True)
    return done
