"""SimHash near-duplicates with multi-index hashing.

Fingerprints: one vote per 3-word shingle and bit. Links: 2 or fewer differing bits.

Search. The fingerprint has two segments of 32 bits. If two fingerprints differ in at most 2 bits, there
is a word at distance 1 or less from both: change one of the differing bits, which lies in one segment.
So every distinct fingerprint enumerates the radius-1 Hamming ball within each segment, the other segment
held exact, and files itself in the table under each variant (65 entries). Two fingerprints within the
radius always meet in a table entry. An entry holds at most 65 distinct fingerprints, whatever the data:
a table keyed by a segment alone would put a whole cluster of near copies in one bucket, and candidates
would grow with its square. Matches are verified by their complete distance.

Nulls: a null text has fingerprint zero, as has one without words; those link like any other. Rows with a
null id get a row but never lend their id to a component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import connected_components

SHINGLE = 3
SEED = 42


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # bytes: only A-Z change, and exactly \x20 \x09-\x0D divide
    if not words:
        return 0
    if len(words) < width:
        hashes = [digest(b" ".join(words), SEED)]
    elif width == 3:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)))]
    return majority(np.array(hashes, "<u8"))


def majority(hashes) -> int:
    """The signed word of the bits that are set in over half the hashes."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with __fp, the fingerprint of the whole text, and __uid, a number of the row; without the text where it isn't needed again."""
    where = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != where]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("__fp", T.LongType()), T.StructField("__uid", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            fps = [fingerprint(t) if t else 0 for t in b.column(where).cast(pa.string()).cast(pa.binary()).to_pylist()]
            new = [pa.array(fps, pa.int64()), pa.array(range(uid, uid + len(fps)), pa.int64())]
            uid += len(fps)
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), *new], schema.names)

    return docs.mapInArrow(run, schema)


def links(fps: DataFrame, bits: int = 64) -> DataFrame:
    """(u, v) between distinct fingerprints at distance 2 or less; enough of them to connect all such pairs.

    fps: distinct (fp). Members of a table entry are joined to its smallest one; they all lie within
    distance 2 of each other, since each lies within distance 1 of the entry's word.
    """
    at = F.col("at")
    # at = 64 keeps both segments exact; 0-31 varies the low segment, 32-63 the high one
    variant = F.when(at < bits, F.expr("fp ^ shiftleft(1L, at)")).otherwise(F.col("fp"))
    entries = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("at")).select(variant.alias("entry"), "fp")
    met = entries.groupBy("entry").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    pairs = met.select("u", F.explode("all").alias("v")).where("u <> v")
    return pairs.where(F.expr("bit_count(u ^ v) <= 2"))


def classes(prints: DataFrame, first) -> tuple[DataFrame, DataFrame]:
    """(fp, label) of every distinct fingerprint, and (label, lead) with the smallest `first` of each component.

    Both are written tables, so that in joins with them the partitions of a fingerprint or label that a third of
    the rows share can be split.
    """
    distinct = written(prints.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    labels = connected_components(links(distinct.select("fp")))
    placed = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    placed = written(placed, "simhash-placed")
    return placed.select("fp", "label"), written(placed.groupBy("label").agg(F.min("first").alias("lead")), "simhash-leads")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = written(with_fingerprints(slim, keep_text=False).select("doc_id", F.col("__fp").alias("fp")), "simhash")
    placed, leads = classes(prints, F.col("doc_id"))
    joined = written(placed.join(leads, "label").select("fp", F.col("lead").alias("component_id")), "simhash-classes")
    return prints.join(joined, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component: that with the smallest id (null ids last, then any one of equal ids)."""
    tagged = written(with_fingerprints(docs, text), "simhash-docs")
    slim = tagged.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__fp").alias("fp"), F.col("__uid").alias("uid"))
    _, leads = classes(slim, F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "uid"))
    return tagged.join(leads.select(F.col("lead.uid").alias("__uid")), "__uid", "left_semi").select(*docs.columns)


def op3_simhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
