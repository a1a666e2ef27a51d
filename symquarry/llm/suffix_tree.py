"""Language-model scoring with a probabilistic suffix tree.

Tokens are lower-cased words and one end per document. Counts cover every training document.

* Root: P0(x) = (c + 0.5) / (N + 0.5 (V + 1)), over all training tokens.
* Candidate contexts: one to three words; a document starts after an end. Successors of a context, and so
  contexts too, have KEEP occurrences. There is no other limit: the tree grows with the corpus.
* A context s is retained if its successors diverge from those of its longest retained suffix s': the
  log-likelihood gain, sum of c(s, x) ln(P(x | s) / P(x | s')), must exceed half of ln c(s) for every
  successor kept (the cost of a parameter).
* P(x | s) = (c(s, x) + MU P(x | s')) / (c(s) + MU) for kept x; any other x has gamma(s) P(x | s'), where
  gamma makes the distribution sum to one. Scores walk from the longest suffix state towards the root.

That walk is a sum over word sequences (grams). Each context that a token stands after adds log gamma, and a kept
successor adds what it has over gamma and its shorter context; so every gram has one fixed value, and a text's
log-probability is the sum of its words' bases and of the values of all its grams of up to four words.

Texts are read once, into a written table of 64-bit hashes of their tokens; grams are hashes of those. The tree is
grown order by order: a gram is counted if its head and its tail have KEEP occurrences, without which it cannot have
them. Bit filters of fixed size, one for each order, spare the shuffle most others; a wrong yes costs a row and
changes nothing. Words and grams with their values are one written table. The most frequent of them, HOT at most, are
broadcast; the others are joined with the (row, gram) pairs that need them. No key of that join is hot, because the
frequent ones never enter it, and no count is dropped.

Nulls: a null text is empty (one token, the end); rows with a null id are scored, learnt from like others.
Without any training document N and V are 0 and every token has probability one. Repeated rows get a row each. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log10
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DIGESTS, drop_path, fold, new_path, table, written

FOLDS, HELD = 5, 1
END = b"\n"  # no word contains white space
ORDERS = 3
KEEP, MU = 8, 20.0
HOT = 1_000_000
BLOCK = 4 << 20  # bytes of text read at once
SLAB = 1 << 19  # tokens counted at once: a worker holds some twenty arrays of so many
MERGED = 1 << 21  # rows of counts that a task gathers from its slabs before it passes them on
FILTER = 20  # a filter has 2 ** FILTER words of 64 bits


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def end_hash():
    import numpy as np

    return np.frombuffer(DIGESTS[END], np.uint64)[0]


def encoded(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(uid, doc_id, h): rows numbered, with the hashes of their tokens, 8 bytes each, an end last."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            hashes: list[bytes] = []
            size = start = 0
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                raw = t.as_py() or b""
                hashes.append(b"".join(map(DIGESTS.__getitem__, (*words_of(raw), END))))
                size += len(raw)
                if size >= BLOCK or i + 1 == b.num_rows:
                    n = i + 1 - start
                    yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), b.column(0).slice(start, n), pa.array(hashes, pa.binary())], ["uid", "doc_id", "h"])
                    uid, start, size, hashes = uid + n, i + 1, 0, []

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "uid long, doc_id long, h binary")


def slabs(column) -> Iterator[tuple]:
    """(first row, row after the last, hashes of their tokens, tokens of each) of whole rows, about SLAB tokens at a time."""
    import numpy as np

    raw = column.buffers()
    if not len(column) or raw[2] is None:
        return
    wide = np.int64 if str(column.type) == "large_binary" else np.int32
    offsets = np.frombuffer(raw[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 8 * SLAB, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]].view(np.uint64), np.diff(offsets[at : end + 1]) // 8
        at = end


def grams(h, most: int):
    """For m = 1 to most, (hashes of the m words up to each token, whether there are so many).

    A gram may begin with the end before its document and stop with the document's own, but has none between.
    """
    import numpy as np

    end = end_hash()
    at = np.arange(1, len(h) + 1)
    last = np.zeros(len(h), np.int64)  # place of the last end before each token; 0 is the start
    last[1:] = np.maximum.accumulate(np.where(h == end, at, 0))[:-1]
    back = at - last
    found = [(h, np.ones(len(h), bool))]
    for m in range(2, most + 1):
        g = shifted(found[-1][0], end) * np.uint64(0x9E3779B97F4A7C15) + (h ^ np.uint64(m)) * np.uint64(0xC2B2AE3D27D4EB4F)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(29)
        found.append((g, back >= m - 1))
    return found


def shifted(a, first):
    """a, one token later."""
    import numpy as np

    out = np.empty_like(a)
    out[1:], out[:1] = a[:-1], first
    return out


def bit_filter(keys: DataFrame):
    """Bits of all keys (a long column `gram`), at most 2 ** FILTER words whatever the table."""
    import numpy as np

    slots = keys.select(F.expr(f"shiftrightunsigned(gram, 6) & {(1 << FILTER) - 1}L").alias("at"), F.expr("shiftleft(1L, cast(gram & 63L as int))").alias("bit"))
    found = slots.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER, np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def may_hold(bits, g):
    import numpy as np

    return (bits[(g >> np.uint64(6)) & np.uint64((1 << FILTER) - 1)] >> (g & np.uint64(63))) & np.uint64(1) > 0


def _batch(columns, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c.view("int64") if c.dtype.kind == "u" else c) for c in columns], names)


def merged(counts: Iterator[tuple]) -> Iterator[tuple]:
    """(keys, n) of slabs, summed by key over MERGED rows at a time, so that a key leaves a task about once and not from each slab."""
    import numpy as np

    held, size = [], 0

    def summed():
        keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")  # slabs are sorted: their runs are merged
        keys, n = keys[order], n[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[heads], np.add.reduceat(n, heads)

    for keys, n in counts:
        if len(keys):
            held.append((keys, n))
            size += len(keys)
        if size >= MERGED:
            yield summed() if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        yield summed() if len(held) > 1 else held[0]


def word_counts(tokens: DataFrame) -> DataFrame:
    """(gram, n) of all words and the end."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for counts in merged(np.unique(h, return_counts=True) for b in batches for _, _, h, _ in slabs(b.column(0))):
            yield _batch(counts, ["gram", "n"])

    return tokens.select("h").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_counts(tokens: DataFrame, order: int, shorter) -> DataFrame:
    """(gram, n) of all grams of order + 1 words with n >= KEEP. shorter: the filter of grams of `order` words."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        def counts():
            for b in batches:
                for _, _, h, _ in slabs(b.column(0)):
                    found = grams(h, order + 1)
                    (tail, whole), (g, valid) = found[-2:]
                    good = may_hold(shorter.value, tail)
                    # the first context is the end, which every text holds
                    head = shifted(good & whole, True)
                    if order == 1:
                        head |= shifted(h, end_hash()) == end_hash()
                    yield np.unique(g[good & valid & head], return_counts=True)

        for found in merged(counts()):
            yield _batch(found, ["gram", "n"])

    return tokens.select("h").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= KEEP)


def gram_parts(tokens: DataFrame, order: int, kept) -> DataFrame:
    """(gram, context, tail) of the grams of order + 1 words that the filter `kept` may hold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for b in batches:
            for _, _, h, _ in slabs(b.column(0)):
                (tail, _), (g, valid) = grams(h, order + 1)[-2:]
                at = np.flatnonzero(valid & may_hold(kept.value, g))
                some, first = np.unique(g[at], return_index=True)
                yield _batch([some, shifted(tail, end_hash())[at[first]], tail[at[first]]], ["gram", "context", "tail"])

    found = tokens.select("h").mapInArrow(run, "gram long, context long, tail long")
    return found.groupBy("gram").agg(F.min("context").alias("context"), F.min("tail").alias("tail"))


class Hot:
    """Values of the frequent grams, found by open addressing."""

    def __init__(self, keys, values, bases):
        import numpy as np

        self.mask = np.uint64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        self.keys, self.values, self.bases = keys, values, bases
        left, slot = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of those that want one slot, one gets it
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + np.uint64(1)) & self.mask

    def __call__(self, g):
        """The place of each gram, -1 for none."""
        import numpy as np

        out = self.slots[g & self.mask]
        if not len(self.keys):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != g))
        slot = g[open_] & self.mask
        while len(open_):
            slot = (slot + np.uint64(1)) & self.mask
            found = self.slots[slot]
            out[open_] = found
            more = (found >= 0) & (self.keys[found] != g[open_])
            open_, slot = open_[more], slot[more]
        return out


@dataclass
class Model:
    """total, kinds: N and V. entries: (gram, n, value, base) of all words and of the tree's grams; base is what a known word
    has over an unknown one, 0 for longer grams. bits: filter of the tree's grams of two words or more."""

    total: int
    kinds: int
    entries: DataFrame
    contexts: DataFrame
    bits: Any
    hot: Hot

    @property
    def unknown(self) -> float:
        """log10 probability, at the root, of a word that was never seen."""
        return log10(0.5) - log10(self.total + 0.5 * (self.kinds + 1))


def frequent(entries: DataFrame) -> Hot:
    """The entries above the least count that leaves HOT of them at most, by a histogram of fixed size."""
    import numpy as np

    step = F.floor(F.log2("n") * 16)
    bins = {r.bin: r.m for r in entries.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("m")).collect()}  # 16 for each power of 2
    least, held = 64 * 16, 0
    for b in sorted(bins, reverse=True):
        held += bins[b]
        if held > HOT:
            break
        least = b
    found = entries.where(step >= least).select("gram", "value", "base").toArrow()
    return Hot(np.ascontiguousarray(found["gram"].to_numpy()).view(np.uint64), found["value"].to_numpy(), found["base"].to_numpy())


def fit(train: DataFrame, text: str = "text", id_col: str = "doc_id") -> Model:
    return fit_encoded(written(encoded(train, text, id_col), "pst-tokens"))


def fit_encoded(tokens: DataFrame) -> Model:
    """The model of encoded rows: grown order by order. `p` of a gram: that of its last word after the longest retained context in it."""
    spark = tokens.sparkSession
    words = written(word_counts(tokens), "pst-words")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    denominator = float(facts.n + 0.5 * (facts.v + 1))
    shorter = words.where(F.col("n") >= KEEP).select("gram", "n", ((F.col("n") + 0.5) / denominator).alias("p"))
    parts, contexts, used = [], [], []

    def step(df: DataFrame, name: str) -> DataFrame:
        used.append(new_path(spark, f"pst-{name}"))
        return written(df, name, used[-1])

    for order in range(1, ORDERS + 1):
        bits = spark.sparkContext.broadcast(bit_filter(shorter))
        found = step(gram_counts(tokens, order, bits), "found")
        kept = spark.sparkContext.broadcast(bit_filter(found))
        named = step(found.join(gram_parts(tokens, order, kept), "gram"), "named")
        bits.unpersist()
        kept.unpersist()
        # hot contexts and tails: both sides are written tables, whose partitions Spark can split
        rows = named.join(shorter.select(F.col("gram").alias("tail"), F.col("p").alias("above")), "tail")
        rows = rows.join(shorter.select(F.col("gram").alias("context"), F.col("n").alias("all")), "context").select("gram", "context", "n", "all", "above")
        rows = step(rows, "rows")
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("above")))
        sums = rows.groupBy("context").agg(F.max("all").alias("all"), F.sum("n").alias("kept"), F.sum("above").alias("of"), gain.alias("gain"), F.count(F.lit(1)).alias("m"))
        rest, rest_above = F.greatest(F.lit(0), F.col("all") - F.col("kept")), F.greatest(F.lit(1e-12), 1 - F.col("of"))
        more = F.when(rest > 0, rest * F.log(rest / F.col("all") / rest_above)).otherwise(0.0)
        inside = (F.col("kept") + MU * F.col("of")) / (F.col("all") + MU)
        gamma = F.greatest(F.lit(1e-12), 1 - inside) / rest_above
        retained = sums.where(F.col("gain") + more > 0.5 * F.log("all") * F.col("m")).select("context", F.col("all").alias("c_n"), F.log10(gamma).alias("log_gamma"))
        contexts.append(written(retained, "pst-contexts"))
        smoothed = (F.col("n") + MU * F.col("above")) / (F.col("all") + MU)
        is_kept = F.col("log_gamma").isNotNull()
        judged = rows.join(contexts[-1].drop("c_n"), "context", "left")
        judged = judged.select("gram", "n", F.when(is_kept, smoothed).otherwise(F.col("above")).alias("p"), F.when(is_kept, F.log10(smoothed / F.col("above")) - F.col("log_gamma")).alias("value"))
        shorter = written(judged, "pst-grams")
        parts.append(shorter.where("value is not null").select("gram", "n", "value"))
        parts.append(contexts[-1].select(F.col("context").alias("gram"), F.col("c_n").alias("n"), F.col("log_gamma").alias("value")))
        while used:
            drop_path(spark, used.pop())
    tree = reduce(DataFrame.union, parts)
    every = tree.select("*", F.lit(0.0).alias("base")).union(words.select("gram", "n", F.lit(0.0).alias("value"), (F.log10(F.col("n") + 0.5) - log10(0.5)).alias("base")))
    entries = written(every.groupBy("gram").agg(F.max("n").alias("n"), F.sum("value").alias("value"), F.sum("base").alias("base")), "pst-entries")
    # contexts of one word are words, which are looked up without a filter
    bits = bit_filter(reduce(DataFrame.union, [p.select("gram") for i, p in enumerate(parts) if i != 1]))
    return Model(facts.n, facts.v, entries, reduce(DataFrame.union, contexts), bits, frequent(entries))


FACTS = "uid long, doc_id long, gram long, n long, known long, base double, value double"


def local_scores(tokens: DataFrame, model: Model) -> DataFrame:
    """For each row one line with what the frequent grams give (gram null), and a line for each other gram of it that may be an entry."""
    sc = tokens.sparkSession.sparkContext
    hot, bits, unknown = sc.broadcast(model.hot), sc.broadcast(model.bits), model.unknown

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        values, bases, names = hot.value.values, hot.value.bases, ["uid", "doc_id", "gram", "n", "known", "base", "value"]
        for b in batches:
            uids = b.column(0).to_numpy()
            for start, end, h, sizes in slabs(b.column(2)):
                owner = np.repeat(uids[start:end], sizes)
                value, rare = np.zeros(len(h)), []
                for m, (g, valid) in enumerate(grams(h, ORDERS + 1), 1):
                    at = np.arange(len(h)) if m == 1 else np.flatnonzero(valid & may_hold(bits.value, g))
                    place = hot.value(g[at])
                    here = place >= 0
                    value[at[here]] += values[place[here]]
                    if m == 1:
                        known, base = np.zeros(len(h), np.int64), np.full(len(h), unknown)
                        known[here] = bases[place[here]] > 0
                        base[here] += bases[place[here]]
                    rare.append((owner[at[~here]], g[at[~here]]))
                heads = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(a, heads) for a in (known, base, value)]
                n = end - start
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, n), b.column(1).slice(start, n), pa.nulls(n, pa.int64()), pa.array(sizes), *map(pa.array, sums)], names)
                for who, what in rare:
                    n = len(who)
                    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(n, pa.int64()), pa.array(what.view(np.int64)), *none], names)

    return tokens.select("uid", "doc_id", "h").mapInArrow(run, FACTS)


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    return score_encoded(written(encoded(docs, text, id_col), "pst-tokens"), model)


def score_encoded(tokens: DataFrame, model: Model) -> DataFrame:
    facts = written(local_scores(tokens, model), "pst-facts")
    rare = facts.where("gram is not null").select("uid", "gram").join(model.entries.select("gram", F.col("base").alias("more"), "value"), "gram")
    rare = rare.groupBy("uid").agg(F.sum("more").alias("rare_base"), F.sum("value").alias("rare_value"), F.sum((F.col("more") > 0).cast("long")).alias("rare_known"))
    joined = facts.where("gram is null").select("uid", "doc_id", "n", "known", "base", "value").join(rare, "uid", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("value") + F.coalesce("rare_value", F.lit(0.0))).alias("score"),
    )


def op6_suffix_tree(spark, sf_dir):
    tokens = written(encoded(table(spark, sf_dir, "documents")), "pst-tokens")
    model = fit_encoded(tokens.where(fold(F.col("doc_id"), FOLDS) != HELD))
    return score_encoded(tokens, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
