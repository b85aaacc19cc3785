"""Stored tables and text sources."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df in a checkpoint, in the folder that spark.checkpoint.dir names, which driver and executors share: a step that is read
    many times is worked out once, keeps its partitions, and outlives executors. Where the setting is unset a session on one
    machine gets a temporary folder, as in tests; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="pagemill-"))
    return df.checkpoint()


def read_url_list(spark: SparkSession, path: str, require_http: bool = False) -> DataFrame:
    """(file, block, line, url): one URL per line, trimmed; blank lines and those that begin with # are left out. Long lists
    are read in blocks; file, block and line give the order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace("value", "\r", "")).alias("url"))
    urls = lines.where("url <> '' and not startswith(url, '#')")
    return urls.where(F.col("url").rlike("^http")) if require_http else urls


def stream_table(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, at most `files` of them in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
