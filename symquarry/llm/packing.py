"""Packing by vector bin packing with the dot-product heuristic.

A document is its token ids and an end id. It is cut into pieces of at most the sequence length; what is left
over is cut once more at a multiple of GRAIN, so the bulk of it fills sequences evenly and the small rests
fill the gaps. Each piece is a vector: tokens, one segment, loss-bearing tokens. A sequence has a limit on
each. The heuristic fills one sequence at a time, always with the piece that fits and has the largest dot
product of its vector with the room left, each dimension weighted by the pieces' mean demand for it
(Panigrahy et al., 2011). Pieces with equal vectors are counted together, so a pick costs the number of
different vectors and not of pieces.

Pieces are written to the shared folder without their ids and dealt out evenly to groups of GROUP, whatever
their documents; groups are packed independently in bounded memory, and each leaves one unfinished sequence.

Ids come from a public vocabulary file. It never joins text across white space and folds case, so every
distinct lower-cased chunk between white space is encoded once per worker (remembered up to CACHE chunks) and
documents are joined from the remembered ids; the result equals encoding the whole text.

Loss: of a plain document every token bears loss but its first, which nothing predicts.

Nulls: a null text is empty: one piece, the end id. A null id is kept. Repeated rows are packed each. Empty
tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

TOKENS, SEGMENTS, LOSS = 4096, 256, 4096
GRAIN, GROUP = 512, 8192
END = 2
CACHE = 700_000
BLOCK = 4 << 20
SIGNS = b".,;:!?%$#*&|()"
#: What ends in an ASCII letter or digit or a Latin-1 letter; what has only letters of these.
WORD = re.compile(rb".*(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])", re.S)
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
VOCABULARY = "word_bpe_49k.json"

PIECE = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of whole texts.

    The vocabulary folds case, so chunks are remembered in lower case. New chunks are encoded many at a time,
    joined by the vocabulary's own end mark, whose id then cuts the ids apart; a text that contains the start of
    such a mark is encoded as it stands.

    A chunk of ASCII or Latin-1 letters alone is one word to the vocabulary, already in normal form. Its ids come from the
    vocabulary's merges without normalizer and pattern, which take most of the time; the last id of a word, and no other, has
    the suffix of a word's end.
    """

    MARK, MARK_ID, OPENING = " <|endoftext|> ", 49407, b"<|"
    JOINED = 256
    SUFFIX = "</w>"

    def __init__(self, path: str, cache: int = CACHE):
        import json
        import os
        from pathlib import Path

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        self.merges = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocabulary = parts["model"]["vocab"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(self.SUFFIX)]] = True
        # the vocabulary writes bytes as signs: printable ones as themselves, the others as those from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.signs = np.arange(256, dtype="<u2")
        self.signs[[b for b in range(256) if b not in printable]] = 256 + np.arange(256 - len(printable))
        self.signs[32] = 32  # between words
        self.signs[0x80:0x9F] = self.signs[0xA0:0xBF]  # second bytes of Latin-1 letters, in lower case
        self.known: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, in order; block by block, so that new chunks are encoded many at a time."""
        import numpy as np

        at = 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            while end < len(texts) and size + len(texts[end]) <= BLOCK:
                size, end = size + len(texts[end]), end + 1
            # bytes: only A-Z change, and only ASCII white space divides
            block = [None if self.OPENING in t else t.lower().split() for t in texts[at:end]]
            every = set().union(*(c for c in block if c is not None))
            if len(self.known) > self.cache:
                self.known = {}
            self.learn(every.difference(self.known))
            get = self.known.__getitem__
            for text, chunks in zip(texts[at:end], block):
                if chunks is None:
                    yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield b"".join(map(get, chunks))
            at = end

    def learn(self, chunks: set[bytes]) -> None:
        """A letter or digit and the signs after it are always encoded apart, so words with signs behind them need no encoding of their own."""
        split = {c: (word, c[len(word) :]) for c in chunks if len(word := c.rstrip(SIGNS)) < len(c) and WORD.fullmatch(word)}
        plain = chunks.difference(split).union(x for pair in split.values() for x in pair).difference(self.known)
        words = [c for c in plain if c.isalpha() or LETTERS.fullmatch(c)]
        self.encode_words(words)
        self.encode(list(plain.difference(words)))
        known = self.known
        known.update((c, known[word] + known[signs]) for c, (word, signs) in split.items())

    def encode_words(self, words: list[bytes]) -> None:
        """Chunks that LETTERS matches."""
        import numpy as np

        parts = [words[i : i + self.JOINED] for i in range(0, len(words), self.JOINED)]
        texts = [self.signs[np.frombuffer(b" ".join(part), np.uint8)].tobytes().decode("utf-16-le") for part in parts]
        for part, e in zip(parts, self.merges.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for word, end in zip(part, (4 * np.flatnonzero(self.closes[ids]) + 4).tolist(), strict=True):
                self.known[word] = raw[at:end]
                at = end

    def encode(self, chunks: list[bytes]) -> None:
        import numpy as np

        parts = [chunks[i : i + self.JOINED] for i in range(0, len(chunks), self.JOINED)]
        texts = [self.MARK.join([c.decode() for c in part]) for part in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for chunk, end in zip(part, [*(4 * np.flatnonzero(ids == self.MARK_ID)).tolist(), len(raw)]):
                self.known[chunk] = raw[at:end]
                at = end + 4


def cuts(length: int, step: int, grain: int = GRAIN) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [step] * (length // step)
    rest = length % step
    if rest > grain and rest % grain:
        return [*out, rest - rest % grain, rest % grain]
    return [*out, rest] if rest else out


_encoders: dict[str, ChunkEncoder] = {}


def pieces(docs: DataFrame, path: str, step: int = TOKENS, grain: int = GRAIN, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, loss, ids_crc32, doc_tokens) of every piece."""

    def run(batches: Iterator) -> Iterator:
        import struct
        from zlib import crc32

        import pyarrow as pa

        forget()
        encode = _encoders.get(path) or _encoders.setdefault(path, ChunkEncoder(path))
        end = struct.pack("<I", END)
        for b in batches:
            rows: list[tuple] = []
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for doc, found in zip(b.column(0).to_pylist(), encode(texts)):
                ids = memoryview(found + end)
                total, start = len(ids) // 4, 0
                for n in cuts(total, step, grain):
                    rows.append((doc, start, n, n - (start == 0), crc32(ids[4 * start : 4 * (start + n)]), total))
                    start += n
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, PIECE)


def fill(length, loss, tokens: int = TOKENS, segments: int = SEGMENTS, loss_limit: int = LOSS):
    """(sequence, offset) of each piece; arrays in, arrays out. No piece may exceed the limits by itself."""
    import numpy as np

    n = len(length)
    vector, kind = np.unique(np.stack([length, loss], axis=1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    left = np.bincount(kind, minlength=len(vector))
    members = np.argsort(kind, kind="stable")
    at = np.cumsum(left) - left  # next member of each kind
    demand = np.stack([vector[:, 0] / tokens, np.full(len(vector), 1 / segments), vector[:, 1] / loss_limit])
    first, second, third = demand * (demand @ left / max(1, n))[:, None]  # weighted by the mean demand
    need = demand.copy()  # out of reach where a kind is used up
    need[0, left == 0] = np.inf
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    number, room, used, waiting = 0, np.ones(3), 0, n
    while waiting:
        a, b, c = room
        fits = (need[0] <= a + 1e-9) & (need[1] <= b + 1e-9) & (need[2] <= c + 1e-9)
        score = np.where(fits, first * a + second * b + third * c, -1.0)
        best = int(score.argmax())
        if score[best] < 0:
            if not used:
                raise ValueError("a piece exceeds the limits of a sequence by itself")
            number, room, used = number + 1, np.ones(3), 0
            continue
        piece = members[at[best]]
        at[best] += 1
        left[best] -= 1
        waiting -= 1
        sequence[piece], offset[piece] = number, used
        used += int(vector[best, 0])
        room = room - demand[:, best]
        if not left[best]:
            need[0, best] = np.inf
    return sequence, offset


def pack(items: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss_limit: int = LOSS, group: int = GROUP) -> DataFrame:
    """items with sequence_id and offset. items has length and loss (long); none may exceed the limits by itself."""
    from pyspark.sql.types import LongType, StructField, StructType

    kept = written(items, "packing-pieces")
    groups = max(1, -(-kept.count() // group))
    # the table is written, so a task that runs again numbers its rows alike
    dealt = kept.withColumn("__group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(key, t):
        import pyarrow as pa

        sequence, offset = fill(t["length"].to_numpy(), t["loss"].to_numpy(), tokens, segments, loss_limit)
        t = t.drop_columns(["__group"])
        return t.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("__group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss_limit: int = LOSS) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence."""
    cut = pieces(docs, path or vocabulary_path(), min(tokens, loss_limit))
    return pack(cut, tokens, segments, loss_limit).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss")


def op8_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
