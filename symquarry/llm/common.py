"""What the operators of this subpackage share: inputs, scratch tables and small columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts of this subpackage define it.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WORD_CACHE = 500_000

_own_dir: str | None = None


class Digests(dict):
    """The 8-byte hashes of words, as many as WORD_CACHE remembered."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh64_digest

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = found = xxh64_digest(word)
        return found


DIGESTS = Digests()


def release() -> None:
    """Give back to the system what this process has freed: Arrow and the C library keep it for themselves else.

    The driver's Python and the workers live on from stage to stage, and their memory counts beside the JVM's.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def forget() -> None:
    """For a worker that begins a stage without word hashes: what an earlier stage remembered goes."""
    if DIGESTS:
        DIGESTS.clear()
        release()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (tests, one machine) a local folder stands in.
    """
    global _own_dir
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="symquarry-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def counted_out(df: DataFrame, first: str, n: str, name: str, step: int = 10_000) -> DataFrame:
    """A row for each number from column `first` on, `n` of them, as `name`. No array holds more than `step` numbers or runs of them."""
    runs = df.withColumn("__run", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {step})")))
    return runs.withColumn(name, F.explode(F.expr(f"sequence({first} + __run * {step}, {first} + least({n}, (__run + 1) * {step}) - 1)"))).drop("__run")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)
