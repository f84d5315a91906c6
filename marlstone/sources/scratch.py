"""The scratch folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset: a temporary folder on a local master, whose executor is the driver; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that nothing else uses."""
    return f"{scratch_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it again: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again: all that has been made of them is written itself."""
    for t in tables:
        spark = t.sparkSession
        mine = f"{scratch_dir(spark)}/marlstone/".split(":", 1)[-1].lstrip("/")
        folders = {f.rsplit("/", 1)[0] for f in t.inputFiles() if mine in f}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
