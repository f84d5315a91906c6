"""The rating log as a stream, on Spark's own state: the newest row of each rater and pair, and hourly progress with a lateness bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["session_id", "qa_uid"]


def stream_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session for stateful streams: state in RocksDB, on the executors' disks and in the checkpoint, in ``partitions`` parts that stay as many for the checkpoint's life."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def _ordered(schema: StructType) -> list[str]:
    """Columns of a row beside its keys, the newest first where rows are compared."""
    return ["created_at", "id", *[c for c in schema.names if c not in (*KEYS, "created_at", "id")]]


def stream_latest_ratings(source: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each (session_id, qa_uid) by (created_at, id) as the stream's state; read_latest reads it from the checkpoint.

    Rows may come in any order, late or again, and a stream that is started anew goes on from its checkpoint; so the state is the table, nothing else is
    written, and Spark lets old versions of it go. Of rows that agree in created_at and id the one with the greatest other columns is kept. A null created_at is the oldest.
    """
    newest = source.groupBy(*KEYS).agg(F.max(F.struct(*_ordered(source.schema))).alias("newest"))
    return newest.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """What ``stream_latest_ratings`` has kept, as rows of the source's schema."""
    kept = spark.read.format("statestore").load(checkpoint)
    value = kept.schema["value"].dataType.names[-1]
    return kept.select(*[F.col(f"key.{c}").alias(c) if c in KEYS else F.col("value")[value][c].alias(c) for c in schema.names])


def progress_by_hour(source: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, annotator, submissions): for streams, hours are closed once the watermark has passed."""
    hours = source.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"), "annotator").agg(F.count(F.lit(1)).alias("submissions"))
    return hours.select(F.col("w.start").alias("hour"), "annotator", "submissions")


def stream_progress(source: DataFrame, out: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Append each hour to ``out`` once, when it is closed: when a row has come that is more than ``late`` behind its end.

    What comes for a closed hour is dropped. A stream that is started anew goes on from its checkpoint; files are committed with their batch.
    """
    return progress_by_hour(source, late).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """The hours that ``stream_progress`` has closed."""
    return spark.read.schema("hour timestamp, annotator string, submissions long").parquet(out)
