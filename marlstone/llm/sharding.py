"""Sharding by histogram sort, under the law ``bytes``: shards of near equal size, each a run of the sorted rows.

The sort key is a long: 39 bits from the hash of the text, then 24 bits from the hash of doc_id. Equal texts so come
next to each other, yet a group of copies that holds a third of all rows can be cut anywhere.

Splitters are found by counting alone. A probe is a key prefix; each round counts rows and bytes exactly below all
probes that still bracket a wanted splitter, over all partitions, and opens just those brackets by STEP more bits. When every splitter is within
tolerance, or its bracket is one key, the rows go through one exchange, and a row's place is the count of rows below its piece (known from the
counts) plus its place in the piece; shards are ranges of places. A splitter can fall inside a key, whose rows repeat doc_id and text. Only the rows of
such keys are written out and numbered by counts for each partition, so they need no window and may be any part of the table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, documents, materialize

SHARDS = 8
#: Bits of a key, and bits that a round opens; a splitter may miss its target by so much of a piece.
BITS, STEP, TOLERANCE = 63, 4, 0.001


def _unsigned_key(text: Column, doc_id: Column) -> Column:
    """63 bits, so that prefixes are shifts of a number that is never negative."""
    return F.shiftrightunsigned(F.xxhash64(text), 24).bitwiseAND(F.lit((1 << 39) - 1)) * F.lit(1 << 24) + F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 24) - 1))


class Cut(NamedTuple):
    """A splitter: rows with a smaller key, and of those with an equal one the first ``inside``, come before it; in all these are ``rows``."""

    key: int
    rows: int
    inside: int = 0
    #: how many rows have that key, where the cut is inside of it
    same: int = 0


def find_cuts(keyed: DataFrame, pieces: int, slack_of: Callable[[int], float]) -> list[Cut]:
    """keyed(key long in [0, 2**63), size long) -> the splitters that cut the bytes into ``pieces``, in order.

    slack_of(i): the part of a piece by which the border before piece i may miss its target. The driver gets at most 16 counts for each piece at
    first, then 2**STEP for each border that is still open; a border stays open if the probes around it hold more than its slack.
    """
    spark = keyed.sparkSession
    width = BITS - max(10, pieces.bit_length() + 3)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")]
    counts = keyed.groupBy(F.shiftrightunsigned("key", width).alias("sub")).agg(*sums).withColumn("cell", F.lit(-1)).collect()
    total = sum(r["b"] for r in counts)
    below, at, done = {-1: (0, 0)}, dict.fromkeys(range(1, pieces), -1), {}
    while at:
        probes = _probes(counts, below)
        opened: dict[int, tuple[int, int]] = {}
        for i, bracket in list(at.items()):
            wanted, slack = total * i / pieces, total / pieces * slack_of(i)
            found = _nearest(probes.get(bracket, []), wanted, slack, width)
            if isinstance(found, Cut):
                done[i] = found
                del at[i]
            else:
                at[i], opened[found[0]] = found[0], found[1:]
        if not at:
            break
        step = min(STEP, width)
        wider, width, below = width, width - step, opened
        asked = spark.createDataFrame([(c,) for c in opened], "cell long")
        inside = keyed.withColumn("cell", F.shiftrightunsigned("key", wider)).join(F.broadcast(asked), "cell")
        counts = inside.groupBy("cell", F.shiftrightunsigned("key", width).alias("sub")).agg(*sums).collect()
    return [done[i] for i in range(1, pieces)]


def _probes(counts: list, below: dict[int, tuple[int, int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each bracket its probes in order: (cell, rows below, bytes below, rows, bytes)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    upto = dict(below)
    for r in sorted(counts, key=lambda r: r["sub"]):
        n, b = upto[r["cell"]]
        out.setdefault(r["cell"], []).append((r["sub"], n, b, r["n"], r["b"]))
        upto[r["cell"]] = n + r["n"], b + r["b"]
    return out


def _nearest(probes: list[tuple[int, int, int, int, int]], wanted: float, slack: float, width: int) -> Cut | tuple[int, int, int]:
    """The cut that is near enough, or (cell, rows below, bytes below) of the probe that has to be opened."""
    if not probes:
        return Cut(0, 0)
    cell, n, b, own, own_bytes = probes[max(0, bisect_right(probes, wanted, key=lambda p: p[2]) - 1)]
    low, high = abs(wanted - b), abs(b + own_bytes - wanted)
    if min(low, high) > slack and own > 1:
        if width:
            return cell, n, b
        # rows of one key have one text, so one size
        return Cut(cell, n + (inside := round(low * own / own_bytes)), inside, own)
    return Cut(cell << width, n) if low <= high else Cut(min((cell + 1) << width, (1 << BITS) - 1), n + own)


def _places_in_key(keyed: DataFrame, keys: list[int]) -> DataFrame:
    """The rows of some keys with _place, their number from 0 among those of their key; they are written out, in order of the key in each partition."""
    asked = keyed.sparkSession.createDataFrame([(k,) for k in keys], "_key long")
    rows = keyed.join(F.broadcast(asked), F.col("_shard_key") == F.col("_key"), "left_semi").sortWithinPartitions("_shard_key").withColumn("_shard_row", F.monotonically_increasing_id())
    rows = materialize(rows, "repeated")
    counts = rows.groupBy(F.col("_shard_key").alias("_key"), F.shiftright("_shard_row", 33).alias("_part")).agg(F.min("_shard_row").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_key", "_part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"))
    met = rows.join(offsets, (F.col("_shard_key") == F.col("_key")) & (F.shiftright("_shard_row", 33) == F.col("_part")))
    return met.withColumn("_place", F.col("_shard_row") + F.col("_shift")).drop("_key", "_part", "_shift", "_shard_row")


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, shard (0 to shards - 1) and slot (gapless from 0 in its shard), all rows and columns kept.

    size: UTF-8 bytes of the text plus 1; a null text has none, so 1. Columns of docs that are named size, shard, slot or start with ``_``
    are replaced or lost. Ties of the key are ordered by doc_id and size. Rows that repeat doc_id and text are sharded one by one, so shards can be cut among
    them, in an order that the table's partitions give. An empty table gives no rows. With fewer rows than shards some shards stay empty. Sizes of
    shards differ by the tolerance, plus half of the row on either border at most.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot", *[c for c in docs.columns if c.startswith("_")])
    keyed = docs.withColumns({"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, "_shard_key": _unsigned_key(F.col(text), F.col(doc_id))})
    narrow = materialize(keyed.select(F.col("_shard_key").alias("key"), "size"), "keys")
    # several pieces for each shard, so that all tasks share the work however few the shards are
    fine = shards * max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    each = fine // shards
    # the borders of shards count for themselves, within the tolerance; those between pieces of a shard may be rough
    cuts = find_cuts(narrow, fine, lambda i: tolerance * each if i % each == 0 else 0.5)
    discard(narrow)
    starts = np.maximum.accumulate(np.array([0, *(c.rows for c in cuts[each - 1 :: each])], np.int64))
    # a key that is cut inside is a piece of its own
    repeated = {c.key: c.rows - c.inside for c in cuts if c.inside}
    borders = {c.key: c.rows for c in cuts if not c.inside} | repeated | {c.key + 1: c.rows - c.inside + c.same for c in cuts if c.inside}
    keys = np.array(sorted(borders), np.int64)
    rows_below = np.array([0, *(borders[k] for k in keys.tolist())], np.int64)

    @F.pandas_udf("piece int, base long")
    def pieces(key: pd.Series) -> pd.DataFrame:
        piece = np.searchsorted(keys, key.to_numpy(np.int64), "right")
        return pd.DataFrame({"piece": piece.astype(np.int32), "base": rows_below[piece]})

    @F.pandas_udf("shard int, slot long")
    def placed(place: pd.Series) -> pd.DataFrame:
        at = place.to_numpy(np.int64)
        shard = np.searchsorted(starts, at, "right") - 1
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": at - starts[shard]})

    asked = spark.createDataFrame([(k,) for k in repeated], "_key long")
    rest = keyed.join(F.broadcast(asked), F.col("_shard_key") == F.col("_key"), "left_anti") if repeated else keyed
    rest = rest.withColumn("_piece", pieces("_shard_key"))
    place = F.row_number().over(Window.partitionBy(F.col("_piece.piece")).orderBy("_shard_key", doc_id, "size")).cast("long")
    out = rest.withColumn("_place", F.col("_piece.base") + place - 1).drop("_piece")
    if repeated:
        at = spark.createDataFrame(list(repeated.items()), "_key long, _below long")
        inside = _places_in_key(keyed, list(repeated)).join(F.broadcast(at), F.col("_shard_key") == F.col("_key"))
        out = out.unionByName(inside.withColumn("_place", F.col("_place") + F.col("_below")).drop("_key", "_below"))
    return out.withColumn("_shard_at", placed("_place")).withColumns({"shard": F.col("_shard_at.shard"), "slot": F.col("_shard_at.slot")}).drop("_shard_at", "_shard_key", "_place")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("text_crc32", F.crc32("text"))
    return histogram_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
