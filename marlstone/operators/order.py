"""One numbering of a whole table: a range exchange and counted offsets, so no task sees more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.scratch import materialize


def numbered(rows: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """rows with ``name``, consecutive numbers from ``start`` in ascending order (nulls first); rows that are equal in it are numbered as they happen to lie.

    The sorted rows are written to the scratch folder with their places; the driver gets the count of each partition of the sort, and these sums are
    all that is joined. A column of that name is replaced, columns named _at and _part are lost; no rows give no rows.
    """
    rows = rows.drop(name, "_at", "_part")
    by = [F.col(c).asc_nulls_first() if isinstance(c, str) else c.asc_nulls_first() for c in order]
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.min("_at").alias("low"), F.count(F.lit(1)).alias("n")).collect()
    shifts, below = [], start
    for r in sorted(counts, key=lambda r: r["_part"]):
        shifts.append((r["_part"], below - r["low"]))
        below += r["n"]
    offsets = rows.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return met.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
