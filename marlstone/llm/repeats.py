"""Runs of segments (lines or sentences) that occur again later: found by their hashes, removed from the texts.

Order of occurrences: by doc_id (null last), then the hash of the text, then place. Rows that agree in doc_id and text are
one occurrence, so they lose the same segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.shared import discard, join_hot, materialize, tidy
from marlstone.llm.shingles import segments, slices

LAST = (1 << 63) - 1
KEYS = ["doc", "text_hash"]
#: Bytes of a single segment that count as many words: about 50 words, or 100 letters of a script without spaces.
BYTES = 300


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_text_hash": F.xxhash64("text")})


def span_rows(docs: DataFrame, sentences: bool, spans: Callable, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """(doc, text_hash, *fields): what ``spans(hashes, rows, words, sizes in bytes)`` gives for the segments of all texts: (rows, *columns)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, text_hash = np.asarray(b.column(0)), np.asarray(b.column(1))
            for first, _, at, data in slices(b.column(2)):
                h, start, end, row, words = segments(at, data, sentences)
                of, *columns = spans(h, row, words, end - start)
                yield pa.RecordBatch.from_arrays([pa.array(doc[of + first]), pa.array(text_hash[of + first]), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t, _) in zip(columns, fields, strict=True))], names=[*KEYS, *(n for n, _, _ in fields)])

    ddl = ", ".join(["doc long", "text_hash long", *(f"{n} {d}" for n, _, d in fields)])
    return keyed(docs).select("_doc", "_text_hash", "text").mapInArrow(tidy(work), ddl)


def later_ranges(spans: DataFrame) -> DataFrame:
    """spans(doc, text_hash, key, start, n) -> (doc, text_hash, ranges array<struct(start, end)>): spans whose key occurs before.

    A first occurrence is a minimum, so it is combined before the shuffle; frequent keys are joined back by broadcast. A span
    that overlaps its first occurrence in the same text loses only what lies beyond that one.
    """
    spans = materialize(spans, "spans")
    here = F.struct("doc", "text_hash", "start")
    firsts = spans.groupBy("key", "n").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count(F.lit(1)).alias("count"))
    firsts = materialize(firsts.filter("first <> last").select("key", "n", "first", "count"), "firsts")
    joined = join_hot(spans, firsts, ["key", "n"], "count", spans.count())
    later = joined.filter(here != F.col("first"))
    same = (F.col("first.doc") == F.col("doc")) & (F.col("first.text_hash") == F.col("text_hash"))
    start = F.when(same, F.greatest("start", F.col("first.start") + F.col("n"))).otherwise(F.col("start"))
    cut = later.select(*KEYS, start.alias("start"), (F.col("start") + F.col("n")).alias("end")).filter("start < end")
    out = materialize(cut.groupBy(*KEYS).agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "ranges")
    discard(spans, firsts)
    return out


def _without(raw: bytes, begin: list[int], drop: np.ndarray) -> str:
    """A text without the segments that begin at such places and are to go; what stands before the first one stays."""
    ends = [*begin[1:], len(raw)]
    whole = b"".join([raw[: begin[0]], *(raw[a:e] for a, e, d in zip(begin, ends, drop.tolist(), strict=True) if not d)])
    return (whole.rstrip() if drop[-1] else whole).decode()


def remove_ranges(docs: DataFrame, ranges: DataFrame, sentences: bool, total: str, removed: str) -> DataFrame:
    """docs with the segments of ``ranges`` cut out of ``text``, and counts of segments before and of those removed.

    Columns of docs named _doc, _text_hash or _mark_* are lost.
    """
    docs = docs.drop(total, removed, "_doc", "_text_hash", "_mark_doc", "_mark_hash", "_mark_ranges")
    schema = T.StructType([*docs.schema.fields, T.StructField(total, T.LongType()), T.StructField(removed, T.LongType())])
    where = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, at, data in slices(b.column(where)):
                part = b.slice(first, last - first)
                *columns, found = part.columns
                _, start, _, row, _ = segments(at, data, sentences)
                totals, gone = np.bincount(row, minlength=last - first), np.zeros(last - first, np.int64)
                if found.null_count < len(found):
                    texts, of = columns[where].to_pylist(), found.offsets.to_numpy()
                    starts, ends = (found.values.field(c).to_numpy() for c in ("start", "end"))
                    for k in np.flatnonzero(found.is_valid()).tolist():
                        begin = start[np.searchsorted(row, k) : np.searchsorted(row, k, "right")] - at[k]
                        step = np.zeros(len(begin) + 1, np.int64)
                        np.add.at(step, starts[of[k] : of[k + 1]], 1)
                        np.add.at(step, ends[of[k] : of[k + 1]], -1)
                        drop = np.cumsum(step[:-1]) > 0
                        gone[k] = drop.sum()
                        if gone[k]:
                            texts[k] = _without(data[at[k] : at[k + 1]].tobytes(), begin.tolist(), drop)
                    columns[where] = pa.array(texts, columns[where].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    # by sorting at every size: a table of ranges that is broadcast while it is small would hide what a larger one costs
    marks = ranges.withColumnsRenamed({"doc": "_mark_doc", "text_hash": "_mark_hash", "ranges": "_mark_ranges"}).hint("merge")
    rows = keyed(docs)
    joined = rows.join(marks, (F.col("_doc") == F.col("_mark_doc")) & (F.col("_text_hash") == F.col("_mark_hash")), "left")
    return joined.select(*docs.columns, "_mark_ranges").mapInArrow(tidy(cut), schema)
