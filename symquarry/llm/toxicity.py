"""Toxicity by class-conditional Kneser-Ney models.

Symbols are the bytes of lower-cased words with a blank before and after, so inflected and compound forms of
a word share its evidence. Each class has its own counts of (context of up to CONTEXT bytes inside the word,
next byte), discounted by D; what is discounted goes to shared lower orders, Kneser-Ney continuation counts
pooled over both classes. A rare expression that neither class has seen gets the same backoff probability
from both, and decides nothing.

A word's evidence is the difference of its toxic and ordinary log-likelihoods. A document is compared by its
length-normalised log-likelihoods: the mean difference per word, and the same sum over the square root of
the word count. A few expressions in a long text move neither, so the strongest evidence of any word and of
any LOCAL words (their mean, the text's most toxic expressions) stand beside them, with the logarithm of the
length, from which chance maxima follow. A logistic regression turns these into a score between 0 and 1; it is
fitted across parts, on features of texts that gave their models no counts.

Fitting reads a bounded sample: `per_class` labelled documents of each class at most. Scoring reads every
whole text, in blocks of bounded size; the model (some MB, bounded by the sample) is broadcast.

Nulls: null and empty texts have no evidence either way and get the score of the class shares; rows with a
null id are scored, never learnt from. Without labels of both classes every score is the share of the class
that there is (0 without any). Repeated rows get a row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, forget, release, table
from .labelled import class_weights, labelled_sample, logistic

CONTEXT = 6  # 7 at most: context and symbol share 8 bytes
D = 0.9
PER_CLASS = 4000
FOLDS, HELD = 5, 0
PARTS = 3
BLOCK = 2 << 20  # bytes of text scored at once
SLAB = 1 << 15  # words whose events are made at once
LOCAL = 3
CACHE = 100_000  # words whose evidence a worker remembers


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def events(words: list[bytes]):
    """For each byte of each word and its closing blank: the packed context and byte, and the word's number.

    The low byte is the next symbol, the bytes above it are the context, nearest first; bytes before the
    opening blank are zero.
    """
    import numpy as np

    lengths = np.fromiter(map(len, words), np.int64, len(words))
    line = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    spans = lengths + 2
    start = np.repeat(np.cumsum(spans) - spans, spans)
    place = np.arange(len(line)) - start
    key = line.copy()
    for j in range(1, CONTEXT + 1):
        back = np.zeros_like(line)
        back[j:] = line[:-j]
        back[place < j] = 0
        key |= back << np.uint64(8 * j)
    real = place > 0
    return key[real], np.repeat(np.arange(len(words)), spans)[real]


class _Sums:
    """Sorted keys with a value each; absent keys have 0. Without values every key counts one."""

    def __init__(self, keys, values=None):
        import numpy as np

        if values is None:
            keys = np.sort(keys)
        else:
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.keys = keys[heads]
        sums = np.diff(np.append(heads, len(keys))) if values is None else np.add.reduceat(values, heads) if len(heads) else values
        self.values = sums.astype(np.float32)

    def __call__(self, keys):
        import numpy as np

        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


class KneserNeyPair:
    """The two class models over shared backoff counts."""

    def __init__(self, counts: tuple[Counter, Counter]):
        import numpy as np

        self.top, pooled = [], []
        for c in counts:
            words, seen = iter(c.items()), _Sums(np.zeros(0, np.uint64))
            while some := list(islice(words, SLAB)):
                key, word = events([w for w, _ in some])
                new = _Sums(key, np.fromiter((n for _, n in some), float, len(some))[word])
                seen = _Sums(np.concatenate([seen.keys, new.keys]), np.concatenate([seen.values, new.values]))
            context = seen.keys >> np.uint64(8)
            self.top.append((seen, _Sums(context, seen.values), _Sums(context)))
            pooled.append(seen.keys)
        kinds = np.unique(np.concatenate(pooled))
        self.lower = []
        for order in range(CONTEXT - 1, -1, -1):  # bytes of context
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            # continuation counts: distinct longer events that end in this one
            seen = _Sums(kinds & mask)
            context = seen.keys >> np.uint64(8)
            self.lower.append((mask, seen, _Sums(context, seen.values), _Sums(context)))
            kinds = seen.keys

    def evidence(self, words: list[bytes]):
        """Toxic minus ordinary log-likelihood of each word."""
        import numpy as np

        if len(words) > SLAB:
            return np.concatenate([self.evidence(words[i : i + SLAB]) for i in range(0, len(words), SLAB)])
        if not words:
            return np.zeros(0)
        every, word = events(words)
        key, which = np.unique(every, return_inverse=True)  # words share most of their events
        shared = np.full(len(key), 1 / 256)
        for mask, seen, total, kinds in reversed(self.lower):
            k = key & mask
            c = k >> np.uint64(8)
            n = total(c)
            known = np.maximum(n, 1)
            shared = np.where(n > 0, np.maximum(seen(k) - D, 0) / known + D * kinds(c) / known * shared, shared)
        logs = []
        for seen, total, kinds in self.top:
            c = key >> np.uint64(8)
            n = total(c)
            known = np.maximum(n, 1)
            logs.append(np.log(np.where(n > 0, np.maximum(seen(key) - D, 0) / known + D * kinds(c) / known * shared, shared)))
        return np.bincount(word, weights=(logs[1] - logs[0])[which], minlength=len(words))


class Scorer:
    def __init__(self, pair: KneserNeyPair | None, weights, share: float):
        self.pair, self.weights, self.share = pair, weights, share
        self.known: dict[bytes, float] = {}

    def features(self, texts: list[bytes]):
        """Mean evidence, its sum over the root of the length, strongest, mean of the LOCAL strongest, log length."""
        from heapq import nlargest
        from math import log1p

        import numpy as np

        out = np.zeros((len(texts), 5))
        at = 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            while end < len(texts) and size + len(texts[end]) <= BLOCK:
                size += len(texts[end])
                end += 1
            block = [words_of(t) for t in texts[at:end]]
            if len(self.known) > CACHE:
                self.known = {}
            new = list(set().union(*block).difference(self.known))
            self.known.update(zip(new, self.pair.evidence(new).tolist()))
            get = self.known.__getitem__
            for i, words in enumerate(block):
                if words:
                    found = list(map(get, words))
                    total, best = sum(found), nlargest(LOCAL, found)
                    out[at + i] = total / len(words), total / len(words) ** 0.5, best[0], sum(best) / LOCAL, log1p(len(words))
            at = end
        return out

    def __call__(self, texts: list[bytes]):
        import numpy as np

        if self.pair is None:
            return np.full(len(texts), self.share)
        f = self.features(texts)
        z = f @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def counted(texts: list[bytes], y, chosen) -> KneserNeyPair:
    """Models of the chosen texts. A text counts each of its words once: what one text repeats is no evidence."""
    classes = (Counter(), Counter())
    for i in chosen:
        classes[y[i]].update(set(words_of(texts[i])))
    return KneserNeyPair(classes)


def fit(ids, texts: list[bytes], y, counts: tuple[int, int]) -> Scorer:
    """Each of PARTS parts gets its features from models of the others; the regression sees them all, and the
    scorer has models of all texts."""
    import zlib

    import numpy as np

    y = np.asarray(y)
    share = counts[1] / max(1, sum(counts))
    if not len(y) or y.min() == y.max():
        return Scorer(None, None, share)
    part = np.array([zlib.crc32(str(i).encode()) // FOLDS % PARTS for i in ids])
    features = np.zeros((len(y), 5))
    for k in range(PARTS):
        inside, others = np.flatnonzero(part == k), np.flatnonzero(part != k)
        if len(set(y[others])) < 2:  # too few rows to keep the parts apart
            others = np.arange(len(y))
        features[inside] = Scorer(counted(texts, y, others), None, share).features([texts[i] for i in inside])
    weights = logistic(features, y, class_weights(y, counts))
    return Scorer(counted(texts, y, range(len(y))), weights, share)


def with_scores(docs: DataFrame, scorer: Scorer, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score for each row, in place of any column of that name."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(column)
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    where = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        for b in batches:
            texts = [t or b"" for t in b.column(where).cast(pa.string()).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value(texts), pa.float64())], [*b.schema.names, column])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, held: int = HELD) -> Scorer:
    rows, counts = labelled_sample(docs, labels, "toxic", folds, held, per_class)
    ids, y, texts = rows["doc_id"].to_pylist(), rows["y"].to_numpy(), [t.as_py().encode() for t in rows["text"]]
    del rows  # the texts are held once while models are made
    scorer = fit(ids, texts, y, counts)
    del texts
    release()
    return scorer


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
