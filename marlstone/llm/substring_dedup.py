"""Substring dedup by sliding sentence spans.

From every sentence on, and up to every sentence, the shortest run of two sentences or more that has enough words or bytes is hashed, and so are single sentences
that are long by themselves; the hashes are joined over all documents, and a sentence goes if a span that occurs before covers it. A longer run that
occurs before is covered by such shortest runs inside it, each of which occurs there too: so repeated runs of any length go whole, but
two short sentences that merely stand together again elsewhere stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.repeats import BYTES, later_ranges, remove_ranges, span_rows
from marlstone.llm.shared import documents
from marlstone.llm.shingles import folded, mixed

#: Words, or bytes of scripts without spaces, that a run of sentences must have, and a single sentence.
RUN, LONE = (8, 48), (50, BYTES)


def shortest_runs(row: np.ndarray, words: np.ndarray, size: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest runs of at least two segments of a row that have so many words or bytes, from each segment on and up to each one, every run once."""
    at = np.arange(len(row))
    first, last = np.searchsorted(row, row), np.searchsorted(row, row, "right")
    totals = [np.concatenate([[0], np.cumsum(x)]) for x in (words, size)]
    ahead = np.minimum(*(np.searchsorted(t, t[:-1] + need) for t, need in zip(totals, least, strict=True)))
    back = np.maximum(*(np.searchsorted(t, t[1:] - need, "right") - 1 for t, need in zip(totals, least, strict=True)))
    end, start = np.maximum(ahead, at + 2), np.minimum(back, at - 1)
    on, upto = end <= last, start >= first
    both = np.unique(np.concatenate([at[on] * (len(row) + 1) + end[on], start[upto] * (len(row) + 1) + at[upto] + 1]))
    return both // (len(row) + 1), both % (len(row) + 1)


def _spans(run: tuple[int, int], lone: tuple[int, int]):
    def spans(h: np.ndarray, row: np.ndarray, words: np.ndarray, size: np.ndarray) -> tuple:
        start, end = shortest_runs(row, words, size, run)
        one = np.flatnonzero((words >= lone[0]) | (size >= lone[1]))
        key = np.concatenate([folded(h, start, end - start), mixed(h[one])])
        start, n = np.concatenate([start, one]), np.concatenate([end - start, np.ones(len(one), np.int64)])
        return row[start], key.view(np.int64), start - np.searchsorted(row, row[start]), n

    return spans


def dedup_substrings(docs: DataFrame, run: tuple[int, int] = RUN, lone: tuple[int, int] = LONE) -> DataFrame:
    """docs(doc_id, text, ...) without the sentences of spans that occur before, with n_sentences and n_removed_sentences.

    run, lone: (words, bytes) of which a run of sentences, and a single one, must have either. A sentence ends at a line feed, or at white space after one of
    ``.!?``; what counts is trimmed. The first occurrence, by doc_id (null last) and place, stays whole.
    All rows and columns stay; a text that is wholly repeated becomes empty; null texts stay null; short texts stay as they are; rows that
    agree in doc_id and text are alike. Columns named as the counts are replaced; ``_doc``, ``_text_hash`` and
    ``_mark_*`` are lost. No rows give no rows.
    """
    spans = span_rows(docs, True, _spans(run, lone), [("key", pa.int64(), "long"), ("start", pa.int32(), "int"), ("n", pa.int32(), "int")])
    return remove_ranges(docs, later_ranges(spans), True, "n_sentences", "n_removed_sentences")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed_sentences", "text")
