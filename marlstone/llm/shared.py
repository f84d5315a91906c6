"""What the operators of this folder share: the shared scratch folder, and workers that give their memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.scratch import discard, materialize

__all__ = ["discard", "documents", "join_hot", "materialize", "tidy"]


def join_hot(rows: DataFrame, known: DataFrame, keys: list[str], count: str, total: int, most: int = 4096, least: int = 512) -> DataFrame:
    """rows joined with known(keys, count, ...), which has one row for each key and how many of the ``total`` rows have it.

    Keys of more than a ``most``-th of all rows are at most so many, so these are broadcast and none of their rows moves; all others are
    too few for one task to be long.
    """
    limit = max(least, total // most)
    hot, rest = known.filter(F.col(count) > limit), known.filter(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker's process outlives its task: what the task has freed goes back to the system for the next one."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
