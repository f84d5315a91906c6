"""Transcripts: captions to cues, numbered lines, topic segments over line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import deictic_share, format_hhmmss, normalize_text


def captions_to_segments(events: DataFrame, keys: list[str]) -> DataFrame:
    """events(keys, seq, t_start_ms, d_duration_ms, texts array) -> (keys, line_no, start_sec, end_sec, text).

    An event without start or texts, or with blank text, is dropped; a missing duration ends at the next kept start, the last one at its own.
    """
    text = normalize_text(F.replace(F.array_join("texts", ""), F.lit("\n"), F.lit(" ")))
    kept = events.filter("t_start_ms is not null and texts is not null").withColumn("text", text).filter("text <> ''")
    w = Window.partitionBy(*keys).orderBy("seq")
    start = F.col("t_start_ms") / 1000
    end = F.coalesce(start + F.col("d_duration_ms") / 1000, F.lead(start).over(w), start)
    return kept.select(*keys, F.row_number().over(w).alias("line_no"), start.alias("start_sec"), end.alias("end_sec"), "text")


def number_lines(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return segments.withColumn("line_no", n).withColumn("numbered", F.concat(F.col("line_no").cast("string"), F.lit(": "), F.col("text")))


def _joined(items: Column, sep: str) -> Column:
    """Texts of structs (order, text) in their order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def flatten_transcript(segments: DataFrame, keys: list[str], order: str = "line_no", text: str = "text") -> DataFrame:
    item = F.struct(F.col(order).alias("order"), normalize_text(F.col(text)).alias("text"))
    return segments.filter(normalize_text(F.col(text)) != "").groupBy(*keys).agg(_joined(F.collect_list(item), " ").alias("transcript"))


def segment_content(segments: DataFrame, lines: DataFrame, keys: list[str], total_lines: str = "total_lines") -> DataFrame:
    """segments with content: the lines start_line..end_line as ``n: text``, missing ones skipped; a range join as an equi-join.

    The range is clipped to the lines that there are before it is spread out, so a senseless range costs nothing.
    """
    spread = segments.withColumn("line_no", F.explode(F.when(
        F.greatest("start_line", F.lit(1)) <= F.least("end_line", total_lines), F.sequence(F.greatest("start_line", F.lit(1)), F.least("end_line", total_lines))
    )))
    item = F.struct(F.col("line_no").alias("order"), F.concat(F.col("line_no").cast("string"), F.lit(": "), F.col("text")).alias("text"))
    found = spread.join(lines.select(*keys, "line_no", "text"), [*keys, "line_no"]).groupBy(*keys, "segment").agg(_joined(F.collect_list(item), "\n").alias("content"))
    return segments.join(found, [*keys, "segment"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def drop_visual_references(segments: DataFrame, most: float = 0.02, mask: bool = False) -> DataFrame:
    """Segments whose share of phrases that point at the picture is at most ``most``; with ``mask`` the others stay, without their text."""
    shown = deictic_share(F.col("text")) <= most
    return segments.withColumn("text", F.when(shown, F.col("text"))) if mask else segments.filter(shown)


def segment_times(segments: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """segments with the start of their first line and the end of their last one, 0 where a line is missing, in seconds and as HH:MM:SS."""
    first = lines.select(*keys, F.col("line_no").alias("start_line"), F.col("start_sec").alias("time_start_sec"))
    last = lines.select(*keys, F.col("line_no").alias("end_line"), F.col("end_sec").alias("time_end_sec"))
    out = segments.join(first, [*keys, "start_line"], "left").join(last, [*keys, "end_line"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("time_start_sec", "time_end_sec")})
    return out.withColumns({"time_start_hhmmss": format_hhmmss(F.col("time_start_sec")), "time_end_hhmmss": format_hhmmss(F.col("time_end_sec"))})


def distribute_questions(segments: DataFrame, keys: list[str], order: str, total: int = 20) -> DataFrame:
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return segments.withColumn("questions", (F.floor(F.lit(total) / n) + (i <= F.lit(total) % n).cast("int")).cast("int"))


def merge_consecutive(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours by start_line with equal titles become one, up to the last one's end; ids count from 1."""
    w = Window.partitionBy(*keys).orderBy("start_line", "id")
    new = F.coalesce((F.lag("title").over(w) != F.col("title")).cast("int"), F.lit(1))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = segments.withColumn("new", new).withColumn("island", island)
    out = runs.groupBy(*keys, "island").agg(F.first("title").alias("title"), F.min("start_line").alias("start_line"), F.max_by("end_line", F.struct("start_line", "id")).alias("end_line"))
    return out.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("island"))).drop("island")


def deduplicate_segments(segments: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The first segment of each trimmed title that isn't blank."""
    rest = [c for c in segments.columns if c not in keys]
    one = segments.withColumn("_title", F.trim("title")).filter("_title <> ''").groupBy(*keys, "_title").agg(F.min_by(F.struct(*rest), order).alias("s"))
    return one.select(*keys, "s.*")


def repair_segments(segments: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """segments(keys, topic, start_line, end_line), totals(keys, total_lines) -> lines 1..total covered in order.

    Taken by start: a segment that ends before it starts or starts before the last accepted one's end is dropped, and a gap becomes a segment of its
    own. What is accepted decides what comes next, so it is a fold over the few segments of a video.
    """
    item = F.struct(F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "topic")
    per = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s")).join(totals, keys, "right").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start_line:int,end_line:int,topic:string>>")))

    def filler(a: Column, b: Column) -> Column:
        name = F.concat(F.lit("Uncategorized Content (Lines "), a.cast("string"), F.lit("-"), b.cast("string"), F.lit(")"))
        return F.array(F.struct(a.cast("int").alias("start_line"), b.cast("int").alias("end_line"), name.alias("topic")))

    none = F.array().cast("array<struct<start_line:int,end_line:int,topic:string>>")
    start = F.struct(F.lit(1).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start_line"] > acc["at"], filler(acc["at"], x["start_line"] - 1)).otherwise(none)
        taken = F.struct((x["end_line"] + 1).cast("int").alias("at"), F.concat(acc["out"], gap, F.array(x)).alias("out"))
        return F.when((x["start_line"] > x["end_line"]) | (x["start_line"] < acc["at"]), acc).otherwise(taken)

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.when(acc["at"] <= F.col("total_lines"), filler(acc["at"], F.col("total_lines"))).otherwise(none))

    return per.withColumn("s", F.aggregate("s", start, step, finish)).select(*keys, F.posexplode("s").alias("segment", "x")).select(*keys, (F.col("segment") + 1).alias("segment"), "x.*")
