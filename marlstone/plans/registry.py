"""The queries of the library outside ``llm``, by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans import corpus, files, ratings, transcripts


def _wide(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Whole numbers as long, decimals as double, so that types agree with those of the SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        to = lambda t: "bigint" if t in ("int", "smallint", "tinyint") else "double" if t.startswith(("decimal", "float")) else t
        return df.select(*[F.col(f"`{c}`").cast(to(t)).alias(c) if to(t) != t else F.col(f"`{c}`") for c, t in df.dtypes])

    return run


_PARTS = (ratings, transcripts, corpus, files)
QUERIES = {name: _wide(f) for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
