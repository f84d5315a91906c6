"""Line dedup by winnowing over line hashes.

A line's hash is of its trimmed text; blank lines don't count. In every window of RUN lines the least hash is chosen (of equal
ones the last), so two texts that share a run of RUN lines choose the same line of it: the fingerprint is guaranteed. Chosen
lines are joined by hash over all documents, which drops lines that are in one place only. Around each match the RUN
windows that hold it are compared, so that a match extends to both sides as far as the lines agree with an earlier
place; a run of at least RUN lines that occurs before, in document order, is deleted where it comes later. A single line that
is long enough is a window by itself, so it is always chosen and needs no neighbour; a shorter one stays, however often it occurs alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.repeats import BYTES, KEYS, later_ranges, remove_ranges, span_rows
from marlstone.llm.shared import discard, documents, join_hot, materialize
from marlstone.llm.shingles import mixed, runs

RUN = 3
#: For whole tables: runs of two lines or more (longer ones are covered by theirs of two), and single lines of so many words or bytes.
SHORT_RUN, SHORT_LINE = 2, (5, 40)
#: The single lines of the pipeline's stage, which cuts passages only: so many words, or bytes of scripts without spaces.
LINE = (50, BYTES)


def winnow(h: np.ndarray, row: np.ndarray, run: int) -> np.ndarray:
    """Places of the lines that are least in some window of ``run`` lines of their row, of equal ones the last."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero(row[:n] == row[run - 1 :])
    best = inside + run - 1
    for j in range(run - 2, -1, -1):
        best = np.where(h[inside + j] < h[best], inside + j, best)
    return np.unique(best)


def _fingerprints(run: int, line: tuple[int, int] | None):
    def spans(h: np.ndarray, row: np.ndarray, words: np.ndarray, size: np.ndarray) -> tuple:
        p = winnow(h, row, run)
        key, first = runs(h, row, run)
        starts = np.searchsorted(row, row)  # the first segment of a segment's row
        ends = np.searchsorted(row, row, "right")
        low, high = np.maximum(p - run + 1, starts[p]), np.minimum(p, ends[p] - run)
        count = high - low + 1
        at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        w = np.repeat(low, count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
        index = np.searchsorted(first, w)
        windows = pa.ListArray.from_arrays(pa.array(at), pa.array(key[index].view(np.int64)))
        of, key_of, place, n = row[p], h[p], low - starts[p], np.full(len(p), run)
        if line:
            one = np.flatnonzero((words >= line[0]) | (size >= line[1]))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1, dtype=np.int32)), pa.array(h[one].view(np.int64)))
            windows = pa.concat_arrays([windows, own])
            of, key_of = np.concatenate([of, row[one]]), np.concatenate([key_of, mixed(h[one])])
            place, n = np.concatenate([place, one - starts[one]]), np.concatenate([n, np.ones(len(one), np.int64)])
        return of, key_of.view(np.int64), place.astype(np.int32), n.astype(np.int32), windows

    return spans


def dedup_lines(docs: DataFrame, run: int = RUN, line: tuple[int, int] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with later repeated runs of at least ``run`` lines cut out of text, n_lines and n_removed_lines.

    line: (words, bytes) from which a single repeated line goes too; None: no single line goes.
    All rows and columns stay; a text that is wholly repeated becomes empty. Null texts stay null and texts with fewer than ``run`` lines
    stay as they are, but for such lines. Ties: the smaller doc_id is the earlier one, null comes last; rows that agree in doc_id and text are alike.
    Columns named as the counts are replaced; ``_doc``, ``_text_hash`` and ``_mark_*`` are lost. No rows give no rows.
    """
    prints = span_rows(docs, False, _fingerprints(run, line), [("line", pa.int64(), "long"), ("low", pa.int32(), "int"), ("n", pa.int32(), "int"), ("windows", pa.list_(pa.int64()), "array<long>")])
    prints = materialize(prints, "prints")
    here = F.struct(*KEYS, "low")
    shared = prints.groupBy("line").agg(F.min(here).alias("a"), F.max(here).alias("b"), F.count(F.lit(1)).alias("count"))
    shared = materialize(shared.filter("a <> b").select("line", "count"), "lines")
    matched = join_hot(prints, shared, ["line"], "count", prints.count()).select(*KEYS, "low", "n", F.posexplode("windows").alias("i", "key"))
    spans = matched.select(*KEYS, "key", (F.col("low") + F.col("i")).alias("start"), "n").distinct()
    ranges = later_ranges(spans)
    discard(prints, shared)
    return remove_ranges(docs, ranges, False, "n_lines", "n_removed_lines")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), SHORT_RUN, SHORT_LINE).select("doc_id", "n_lines", "n_removed_lines", "text")
