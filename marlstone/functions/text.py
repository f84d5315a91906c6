"""Scalar functions over text, time and model responses: columns in, columns out, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone import schemas as S

# Language codes in file names, and names of languages with their codes.
FILE_CODES = {"cn": "zh", "zh": "zh", "en": "en", "hi": "hi", "ro": "ro"}
LANGUAGE_NAMES = {"en": "English", "zh": "Chinese", "hi": "Hindi", "ro": "Romanian"}
LANGUAGE_CODES = {"english": "en", "en": "en", "eng": "en", "chinese": "zh", "zh": "zh", "cn": "zh", "ch": "zh", "hindi": "hi", "hi": "hi", "hind": "hi", "romanian": "ro", "ro": "ro"}
# Preferred caption tracks by language, best first.
TRACKS = {"en": ["en-orig", "en"], "zh": ["zh-Hans", "zh-Hant", "zh"], "hi": ["hi"], "ro": ["ro"]}
# The mark that ends a sentence, by language.
END_MARKS = {"hi": "।", "zh": "。", "ja": "。", "ko": "。"}
# Phrases that point at what can only be seen.
DEICTIC = ["here", "this", "like so", "you can see", "watch", "notice how", "as i'm showing"]
# The sentence of a refusal, and the forms of question, answer and timestamp lines in responses.
REFUSAL = "not available in the provided context"
QUESTION_LINE = r"(?i)^\s*(?:[-*>]\s*)?(?:\d+\s*:|(?:\d+\.\s*)?(?:\*{1,3}|_+)?\s*(?:question\s*\d*|q\d*)\s*(?:\*{1,3}|_+)?\s*:?)"
ANSWER_LINE = r"(?i)^(?:answer|a\d*)[:\s]"
TIMESTAMP_LINE = r"(?i)^\s*(?:[-*>]\s*)?(?:\*{1,3}|_+)?\s*timestamp\s*(\d*)\s*(?:\*{1,3}|_+)?\s*:\s*(.*)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def language_from_filename(name: Column) -> tuple[Column, Column]:
    """(iso code, language): the first of -cn -zh -en -hi -ro in a file name; English if there is none."""
    code = F.coalesce(F.try_element_at(_map(FILE_CODES), F.regexp_extract(F.lower(name), r"-(cn|zh|en|hi|ro)(?:-|\.|$)", 1)), F.lit("en"))
    return code, F.try_element_at(_map(LANGUAGE_NAMES), code)


def language_code(name: Column) -> Column:
    key = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(_map(LANGUAGE_CODES), key), F.replace(key, F.lit(" "), F.lit("-")))


def normalize_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def restore_end_mark(c: Column, lang: Column) -> Column:
    """The text with white space collapsed, and with the mark of its language at the end unless it ends in a mark."""
    text = normalize_text(c)
    ended = text.rlike(r"(?:\.\.\.|…|[.?!…？！。।,;:，；：])$")
    return F.when((text == "") | ended, text).otherwise(F.concat(text, F.coalesce(F.try_element_at(_map(END_MARKS), lang), F.lit("."))))


def format_hhmmss(sec: Column) -> Column:
    s = F.rint(sec).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def format_srt(sec: Column) -> Column:
    ms = F.when(sec < 0, F.raise_error(F.lit("negative time"))).otherwise(F.rint(sec * 1000).cast("long"))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def marked_line(start: Column, text: Column) -> Column:
    """``[m:ss] text`` with whole seconds cut off; null for a blank line."""
    s = F.floor(start).cast("long")
    return F.when(normalize_text(text) != "", F.format_string("[%d:%02d] %s", F.floor(s / 60).cast("long"), s % 60, F.trim(text)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def without_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\d+:\d{2}\]", "")


def qa_target(words: Column) -> Column:
    return F.greatest(F.lit(4), F.rint(words / 250).cast("int"))


def truncate_budget(c: Column, chars: int = 400_000) -> Column:
    return F.substring(c, 1, chars)


def approx_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def strip_reasoning(c: Column) -> Column:
    """Without paired reasoning blocks; a close tag that is left over takes all before it along."""
    paired = F.regexp_replace(c, r"(?is)<(think|thinking|reasoning)>.*?</\1>", "")
    orphan = F.regexp_replace(paired, r"(?is)^.*?</(?:think|thinking|reasoning)[^>]*>", "")
    return F.regexp_replace(F.when(paired.rlike(r"(?i)</(?:think|reasoning)"), orphan).otherwise(paired), r"^(?U)\s+|\s+$", "")


def extract_json(c: Column, schema: str = S.BLUEPRINT) -> Column:
    """The text, or its fenced part, or what is between the first [ and the last ], as ``schema``; null if none parses."""
    options = {"mode": "PERMISSIVE"}
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    between = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    parsed = lambda x: F.when(x.rlike(r"^\s*[\[{]"), F.from_json(x, schema, options))
    return F.coalesce(parsed(c), parsed(fenced), parsed(between))


def blueprint_or_fallback(c: Column) -> Column:
    raw = F.array(F.struct(F.lit(0).alias("id"), F.lit("Raw Response").alias("title"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), c.alias("raw_text")))
    parsed = F.transform(extract_json(strip_reasoning(c)), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.lit(None).cast("string").alias("raw_text")))
    return F.coalesce(parsed, raw)


def split_sentences(c: Column) -> Column:
    """array<struct(n, sentence)>: cut behind .!? and white space, numbered from 1 before blank ones are dropped."""
    parts = F.split(c, r"(?<=[.!?])(?U)\s+")
    return F.filter(F.transform(parts, lambda x, i: F.struct((i + 1).alias("n"), normalize_edges(x).alias("sentence"))), lambda x: x["sentence"] != "")


def normalize_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def parse_numbered_list(c: Column) -> Column:
    """The items of lines ``1. item``."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: normalize_edges(F.regexp_extract(x, r"^\s*\d+\.\s*(.+)", 1))), lambda x: x != "")


def split_numbered(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\d+\.\s*"), normalize_edges), lambda x: x != "")


def parse_ints(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(1.0)), F.lit(10.0))


def parse_score(c: Column) -> Column:
    """Mean of the values of A=, C= and E= if there are just three, else the first integer, each within 1 to 10; else 5."""
    marks = F.regexp_extract_all(c, F.lit(r"[ACE]\s*=\s*(\d+)"), F.lit(1))
    mean = F.aggregate(marks, F.lit(0.0), lambda a, x: a + _clamped(x)) / 3
    first = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(F.size(marks) == 3, mean).when(first != "", _clamped(first)).otherwise(5.0)


def parse_mmss_range(c: Column) -> tuple[Column, Column]:
    pattern = r"(\d{1,3}):(\d{2})\s*(?:-|–|—|to)\s*(\d{1,3}):(\d{2})"
    part = lambda k: F.regexp_extract(c, pattern, k).try_cast("int")
    return part(1) * 60 + part(2), part(3) * 60 + part(4)


def build_uid(dataset: Column, video: Column, approach: Column, n: Column) -> Column:
    return F.concat(dataset, F.lit("_v"), video.cast("string"), F.lit("_"), approach, F.lit("_q"), n.cast("string"))


def is_refusal(answer: Column) -> Column:
    return F.lower(answer).contains(REFUSAL)


def deictic_share(c: Column) -> Column:
    """Phrases that point at the picture, for each word."""
    hits = F.size(F.regexp_extract_all(F.lower(c), F.lit(r"\b(" + "|".join(DEICTIC) + r")\b"), F.lit(1)))
    return hits / F.greatest(word_count(c), F.lit(1))
