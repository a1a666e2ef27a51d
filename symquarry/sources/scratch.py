"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own_dir: str | None = None


def materialised(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read again; where that is unset (one machine), to a local folder."""
    global _own_dir
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="symquarry-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        folder = f"file://{_own_dir}"
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
