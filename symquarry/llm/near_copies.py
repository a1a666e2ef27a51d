"""Near copies: groups of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Exact.

A text is the set of 64-bit hashes of its shingles of WIDTH lower-cased words, made from the words' own hashes; a shorter text is one shingle, one
without words the empty set. Texts with equal sets are one member from here on.

Search by SimHash. Every set has a fingerprint, a vote of its hashes for each bit, and fingerprints at 2 or fewer differing
bits are found by the multi-index hashing of `simhash`. Sets that meet so are candidates. Similar sets whose fingerprints
lie further apart, which is so for most sets near the bound, are found by a second, complete search.

Search by prefixes, for those. Let all shingles stand in one fixed order. Two sets with similarity t or more share a shingle
among the first |s| - ceil(t |s|) + 1 of each. The order is by the counts of 2 ** SKETCH hash buckets over all
texts, rarest first, so a line that many texts hold is in almost no prefix. The order changes costs, never results.
Of two sets, a shared shingle at places i and j leaves at most 1 + min(|u| - i - 1, |v| - j - 1) in common if it is the
first that they share; pairs for which that is too little meet at an earlier shingle or are not similar.

Links of either search are verified on the whole sets. First the SimHash candidates, and each member of a prefix shingle with the shingle's smallest one, which
joins a cluster of near copies in linear work; then only members whose groups still differ meet each other.

Sets are made from the texts whenever they are needed, not stored: they are larger than the texts.

Nulls: a null text is empty. Rows with a null id come last within their group, and of rows with equal ids any one
leads. Repeated rows are one group; an empty table stays empty; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import DIGESTS, drop_path, new_path, release, written
from .components import connected_components

WIDTH, SIMILAR = 5, (4, 5)  # similarity as a fraction, so that sizes are exact
SKETCH = 18
SEEN = 100_000  # keys that a task remembers
BROADCAST_KEYS = 1_000_000


def shingles(text: bytes):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np

    words = text.lower().split()
    h = np.frombuffer(b"".join(map(DIGESTS.__getitem__, words)), np.uint64)
    width = max(1, min(WIDTH, len(h)))
    s = np.full(len(h) - width + 1 if len(h) else 0, width, np.uint64)
    for i in range(width):
        s = (s ^ h[i : i + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def with_keys(docs: DataFrame, text: str) -> DataFrame:
    """docs with __key, a hash of the text's set of shingles, __fp, the SimHash fingerprint of that set, and __uid, a number of the row."""
    where = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("__key", T.LongType()), T.StructField("__fp", T.LongType()), T.StructField("__uid", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest as digest

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(where).cast(pa.string()).cast(pa.binary())
            found = [(digest(s.tobytes()), simhash.majority(s)) for s in (shingles(t.as_py() or b"") for t in texts)]
            keys = np.array([k for k, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys), pa.array([fp for _, fp in found], pa.int64()), pa.array(range(uid, uid + len(keys)), pa.int64())], schema.names)
            uid += len(keys)

    return docs.mapInArrow(run, schema)


def sets_of(batches: Iterator) -> Iterator:
    """(key, set) of the rows of (key, text) batches; a key that came shortly before is left out."""
    import pyarrow as pa

    seen: set[int] = set()
    for b in batches:
        for key, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                yield key, shingles(t.as_py() or b"")


def bucket_counts(texts: DataFrame):
    """How many texts hold shingles of each hash bucket: 2 ** SKETCH counts whatever the input."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(1 << SKETCH, np.int64)
        for _, s in sets_of(batches):
            np.add.at(counts, (s & np.uint64((1 << SKETCH) - 1)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["at", "n"])

    found = texts.select("key", "t").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH, np.int64)
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    del found
    release()
    return counts


def prefixes(texts: DataFrame, counts) -> DataFrame:
    """(shingle, key, size, at) of every set's prefix; at is the shingle's place in it. A key may come once from each task."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    top, of = SIMILAR

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n = shared.value
        out: list[list] = [[], [], [], []]

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()) for a in out], ["shingle", "key", "size", "at"])

        for key, s in sets_of(batches):
            if not len(s):
                continue
            first = len(s) - -(-top * len(s) // of) + 1
            order = np.lexsort((s, n[(s & np.uint64((1 << SKETCH) - 1)).astype(np.int64)]))[:first]
            for part, a in zip(out, (s[order].view(np.int64), np.full(first, key), np.full(first, len(s)), np.arange(first))):
                part.append(a)
            if len(out[0]) >= 1000:
                yield rows()
                out[:] = [], [], [], []
        if out[0]:
            yield rows()

    return texts.select("key", "t").mapInArrow(run, "shingle long, key long, size long, at long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): the pairs whose sets are similar enough. Only sets that stand in a pair are made again."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = list(sets_of([b.slice(start, 1000)]))
                offsets = np.cumsum([0, *(len(s) for _, s in part)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s for _, s in part]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), lists], ["key", "set"])

    top, of = SIMILAR
    pairs = written(pairs, "copies-pairs")
    keys = written(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct(), "copies-keys")
    few = keys.count() <= BROADCAST_KEYS
    chosen = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi").groupBy("key").agg(F.first("t").alias("t"))
    sets = written(chosen.mapInArrow(run, "key long, set array<long>"), "copies-sets")
    a, b = sets.select(F.col("key").alias("u"), F.col("set").alias("a")), sets.select(F.col("key").alias("v"), F.col("set").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(common * of >= (F.size("a") + F.size("b") - common) * top).select("u", "v")


def as_side(x: str, *columns: str) -> list:
    return [F.col(c).alias(x if c == "key" else f"{x}_{c}") for c in columns]


def simhash_candidates(prints: DataFrame) -> DataFrame:
    """(u, v) between keys whose fingerprints lie within the radius, enough of them to connect all such pairs.

    prints: distinct (key, fp). Keys with one fingerprint meet the smallest of them, and the smallest ones stand for their fingerprints.
    """
    leads = written(prints.groupBy("fp").agg(F.min("key").alias("u")), "copies-prints")
    same = prints.join(leads, "fp").select("u", F.col("key").alias("v")).where("u <> v")
    near = simhash.links(leads.select("fp")).withColumnsRenamed({"u": "fp", "v": "other"}).distinct()
    others = leads.select(F.col("fp").alias("other"), F.col("u").alias("v"))
    return same.union(near.join(leads, "fp").join(others, "other").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v) between keys, enough of them to connect all similar pairs. texts: (key, t), prints: distinct (key, fp), both written tables."""
    spark = texts.sparkSession
    top, of = SIMILAR
    fits = (F.col("u_size") * of >= F.col("v_size") * top) & (F.col("v_size") * of >= F.col("u_size") * top)
    in_common = F.least(F.col("u_size") - F.col("u_at"), F.col("v_size") - F.col("v_at"))
    fits &= in_common * (top + of) >= (F.col("u_size") + F.col("v_size")) * top
    used = [new_path(spark, f"copies-{name}") for name in ("met", "open")]
    # one shuffle: members stream by in order, each beside its shingle's smallest one
    order = Window.partitionBy("shingle").orderBy("key")
    first = F.first(F.struct("key", "size", "at")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = prefixes(texts, bucket_counts(texts)).withColumns({"least": first, "next": F.lead("key").over(order)})
    met = met.where(F.col("next").isNotNull() | (F.col("key") != F.col("least.key")))
    pivot = [F.col(f"least.{c}").alias(name) for c, name in (("key", "u"), ("size", "u_size"), ("at", "u_at"))]
    met = written(met.select("shingle", *pivot, *as_side("v", "key", "size", "at")), "copies-met", used[0])
    star = met.where(fits & (F.col("u") != F.col("v"))).select("u", "v")
    stars = written(verified(simhash_candidates(prints).union(star).distinct(), texts), "copies-links")
    labels = connected_components(stars)
    placed = met.select("shingle", F.col("v").alias("key"), F.col("v_size").alias("size"), F.col("v_at").alias("at"))
    placed = placed.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    placed = written(placed.join(mixed, "shingle").distinct(), "copies-open", used[1])
    u, v = (placed.select("shingle", *as_side(x, "key", "size", "at", "label")) for x in "uv")
    rest = u.join(v, "shingle").where((F.col("u") < F.col("v")) & (F.col("u_label") != F.col("v_label")) & fits)
    rest = written(verified(rest.select("u", "v").distinct(), texts), "copies-links")
    for path in used:
        drop_path(spark, path)
    return stars.unionByName(rest)


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group: that with the smallest id (null ids last, then any one of equal ids)."""
    tagged = written(with_keys(docs, text), "copies-docs")
    order = F.struct(F.col(id_col).cast("long").isNull().alias("absent"), F.col(id_col).cast("long").alias("id"), F.col("__uid").alias("uid"))
    firsts = written(tagged.select(F.col("__key").alias("key"), F.col("__fp").alias("fp"), order.alias("first")).groupBy("key").agg(F.min("first").alias("first"), F.min("fp").alias("fp")), "copies-firsts")
    labels = connected_components(links(tagged.select(F.col("__key").alias("key"), F.col(text).cast("string").alias("t")), firsts.select("key", "fp")))
    placed = firsts.join(labels.withColumnRenamed("node", "key"), "key", "left")
    leads = written(placed.groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("first").alias("lead")), "copies-leads")
    return tagged.join(leads.select(F.col("lead.uid").alias("__uid")), "__uid", "left_semi").select(*docs.columns)
