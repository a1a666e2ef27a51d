"""Keeping an index up to date from a stream of files: each micro-batch is an open-set update."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import index


def watch(spark: SparkSession, repo_root: str, index_dir: str, checkpoint: str, lite: bool = False, pattern: str = "*"):
    """A started query that indexes new files of a tree as they appear. Stop it, or await it, like any other.

    The file source remembers what it has seen in its checkpoint; a batch that runs again finds equal hashes
    and changes nothing.
    """
    repo_root = os.path.realpath(repo_root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(f"file://{repo_root}")

    def batch(df: DataFrame, number: int) -> None:
        paths = [r.p for r in df.select(F.regexp_replace("path", "^file:/+", "/").alias("p")).distinct().collect()]  # names of one micro-batch
        if paths:
            index.update_files(df.sparkSession, index_dir, repo_root, paths, lite)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
