"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: one entry for each distinct lower-cased word, hashed into 2 ** BITS slots and
scaled to unit length, and a few dense entries of its structure (share of capitals, digits, signs, repeated
words and lines, lengths). Every pair of entries interacts through K latent factors; the sum-of-squares
identity, sum over pairs of <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2 for each factor, makes
scoring linear in the entries.

Fitting reads a bounded sample, `per_class` labelled documents of each class at most, with Adagrad steps on
the driver; the labelled rows of one fold calibrate the score instead. Scoring reads every whole text.
Neither labels nor language, source or id are entries.

Nulls: null and empty texts have no words and the structure of the empty text. Rows with a null id are
scored, never learnt from. Without labels of both classes every score is the share of label 1 (0 without
any). Repeated rows get a row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p
from operator import eq
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, table
from .labelled import class_weights, labelled_sample, logistic

BITS, K = 16, 8
PER_CLASS = 4000
FOLDS, HELD, CALIBRATE = 4, 2, 3
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.05, 1e-4
DENSE = 12


def entries(text: bytes):
    """(slots of the distinct words, their value, dense entries) of one text."""
    import numpy as np

    words = text.split()
    counts = Counter(words)
    slots = np.unique(np.fromiter((crc32(w.lower()) & ((1 << BITS) - 1) for w in counts), np.int64, len(counts)))
    n, size = max(1, len(words)), max(1, len(text))
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    prose = by[[33, 39, 44, 46, 58, 59, 63]].sum()
    signs = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum() - prose
    lines = text.split(b"\n")
    dense = np.array([
        upper / max(1, upper + lower), digits / size, signs / n, by[124] / n, by[33] / n, prose / n,
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines), log1p(len(words)) / 8, len(text) / n / 8,
    ])
    return slots, 1 / max(1, len(slots)) ** 0.5, np.minimum(dense, 4.0)


class FactorisationMachine:
    """Slots 0 to 2 ** BITS - 1 are words, the next DENSE are structure."""

    def __init__(self, seed: int = 7):
        import numpy as np

        self.size = (1 << BITS) + DENSE
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (self.size, K))
        self.mean, self.scale = np.zeros(DENSE), np.ones(DENSE)
        self.calibration = np.array([1.0, 0.0])

    def row(self, text: bytes):
        import numpy as np

        slots, value, dense = entries(text)
        at = np.concatenate([slots, np.arange(1 << BITS, self.size)])
        x = np.concatenate([np.full(len(slots), value), np.clip((dense - self.mean) / self.scale, -5, 5) / DENSE**0.5])
        return at, x

    def margin(self, at, x) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))

    def fit(self, texts: list[bytes], y, weight, epochs: int = EPOCHS) -> None:
        import numpy as np

        parts = [entries(t) for t in texts]
        dense = np.array([p[2] for p in parts])
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        rows = [self.row(t) for t in texts]
        g0, gw, gv = 1.0, np.ones(self.size), np.ones((self.size, K))
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), BATCH):
                chosen = order[start : start + BATCH]
                lengths = np.array([len(rows[i][0]) for i in chosen])
                at, x = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
                owner = np.repeat(np.arange(len(chosen)), lengths)
                heads = np.cumsum(lengths) - lengths
                vx = self.v[at] * x[:, None]
                total = np.add.reduceat(vx, heads)
                z = self.w0 + np.add.reduceat(self.w[at] * x, heads) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), heads))
                error = weight[chosen] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
                e = error[owner] * x
                used, where = np.unique(at, return_inverse=True)
                dw = np.bincount(where, weights=e, minlength=len(used)) + DECAY * self.w[used]
                step = e[:, None] * (total[owner] - vx)
                dv = np.stack([np.bincount(where, weights=step[:, k], minlength=len(used)) for k in range(K)], axis=1) + DECAY * self.v[used]
                gw[used] += (dw * BATCH) ** 2
                gv[used] += (dv * BATCH) ** 2
                g0 += (error.sum() * BATCH) ** 2
                self.w[used] -= RATE * BATCH * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * BATCH * dv / np.sqrt(gv[used])
                self.w0 -= RATE * BATCH * error.sum() / g0**0.5

    def scores(self, texts: list[bytes]):
        import numpy as np

        z = np.array([self.margin(*self.row(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] * z + self.calibration[1], -35, 35)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[bytes]):
        return [self.share] * len(texts)


def fit(ids, texts: list[bytes], y, counts: tuple[int, int]):
    import numpy as np

    y = np.asarray(y)
    if not len(y) or y.min() == y.max():
        return Constant(counts[1] / max(1, sum(counts)))
    part = np.array([crc32(str(i).encode()) % FOLDS == CALIBRATE for i in ids])
    train = ~part
    if len(set(y[part])) < 2 or len(set(y[train])) < 2:  # too few rows to keep the parts apart
        part[:], train = True, np.ones(len(y), bool)
    machine = FactorisationMachine()
    machine.fit([texts[i] for i in np.flatnonzero(train)], y[train].astype(float), class_weights(y[train], (1, 1)))
    z = np.array([machine.margin(*machine.row(texts[i])) for i in np.flatnonzero(part)])
    machine.calibration = logistic(z[:, None], y[part], class_weights(y[part], counts))
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    return machine


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, held: int = HELD):
    rows, counts = labelled_sample(docs, labels, "quality", folds, held, per_class)
    texts = [t.encode() for t in rows["text"].to_pylist()]
    return fit(rows["doc_id"].to_pylist(), texts, rows["y"].to_numpy(), counts)


def with_scores(docs: DataFrame, machine, text: str = "text", column: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with a score for each row, in place of any column of that name; without the text where it isn't needed again."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(column)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    where = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != where]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [t or b"" for t in b.column(where).cast(pa.string()).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(model.value.scores(texts), pa.float64())], [*(b.schema.names[i] for i in kept), column])

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[i] for i in kept), StructField(column, DoubleType())]))


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
