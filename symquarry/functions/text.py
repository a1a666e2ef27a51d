"""Text functions as Column expressions: byte-wise lengths, ASCII case, the C locale's white space."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: LIKE needs an escape character; this one does not occur in source text.
ESCAPE = "\x01"

#: Built-in type names that never name a related symbol (fixed values).
BUILT_IN_TYPES = ("void", "bool", "byte", "sbyte", "char", "decimal", "double", "float", "int", "uint", "long", "ulong", "object", "short", "ushort", "string", "var")
#: A symbol is worth expanding if its kind contains one of these (fixed values).
EXPANDABLE = ("method", "function", "constructor", "property", "attribute", "field", "class", "struct", "interface", "trait", "enum", "type")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, "[ \t\n\\x0B\f\r]+", " "), F.lit(" "))


def count_of(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def before(c: Column, sign: str) -> Column:
    """What stands before the first sign."""
    return F.substring_index(c, sign, 1)


def before_hash(c: Column) -> Column:
    """What stands before the first # outside quotes; possessive, so that long lines need no stack."""
    return F.regexp_extract(c, r"""^((?:[^'"#]++|'[^']*+(?:'|$)|"[^"]*+(?:"|$))*+)""", 1)


def indentation(c: Column) -> Column:
    lead = F.regexp_extract(c, "^[ \t]*", 0)
    return F.length(lead) + 3 * count_of(lead, "\t")


def join_qualified(parent: Column, name: Column, separator: str = ".") -> Column:
    return F.concat_ws(separator, F.when(parent != "", parent), name)


def tail_name(c: Column) -> Column:
    """After the last of . : \\ /"""
    return F.regexp_extract(c, r"[^.:\\/]*$", 0)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case last extension with its dot; a name's first dot starts none."""
    return ascii_lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))


def like(c: Column, pattern: str) -> Column:
    """LIKE with ASCII case folding and no escape: % and _ are live, the backslash is ordinary."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER))
    return F.like(ascii_lower(c), F.lit(folded.replace(ESCAPE, ESCAPE * 2)), F.lit(ESCAPE))


def contains_like(c: Column, query: str) -> Column:
    return like(F.coalesce(c, F.lit("")), f"%{query}%")


def line_count(content: Column) -> Column:
    newlines = count_of(content, "\n")
    return F.when(F.length(content) == 0, 0).when(content.endswith("\n"), newlines).otherwise(newlines + 1)


def fnv1a64_of(values: list[bytes]) -> list[str]:
    """FNV-1a of each value as 16 hex digits. One step hashes the same position of all values at once."""
    import numpy as np

    sizes = np.array([len(v) for v in values], np.int64)
    state = np.full(len(values), 14695981039346656037, np.uint64)  # fixed values: offset basis and prime
    prime = np.uint64(1099511628211)
    line = np.frombuffer(b"".join(values), np.uint8)
    heads = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # those that reach a position stand first
    heads, ordered = heads[order], sizes[order]
    hashed = state[order]
    reach = len(values)
    at = 0
    with np.errstate(over="ignore"):
        while reach and at < ordered[0]:
            while ordered[reach - 1] <= at:
                reach -= 1
            if reach < 4:
                break
            hashed[:reach] = (hashed[:reach] ^ line[heads[:reach] + at]) * prime
            at += 1
    for i in range(reach):  # the few longest are finished one by one
        h = int(hashed[i])
        for byte in line[heads[i] + at : heads[i] + ordered[i]].tobytes():
            h = (h ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        hashed[i] = h
    state[order] = hashed
    return [f"{h:016x}" for h in state.tolist()]


def fnv1a64(content: Column) -> Column:
    """Content hash of a text (its UTF-8 bytes) or binary column; Arrow batches."""
    @F.pandas_udf("string")
    def hashed(c: pd.Series) -> pd.Series:
        return pd.Series(fnv1a64_of([bytes(v) if v is not None else b"" for v in c]))

    return hashed(content.cast("binary"))


def relation_type_name(c: Column) -> Column:
    """Whether a type text can name a symbol."""
    return (c != "") & ~c.isin(*BUILT_IN_TYPES)


def format_bytes(n: int) -> str:
    """12 B, 1.50 KB, 23.4 MB: 1024 a step, two decimals below ten."""
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB"):
        if abs(size) < 1024 or unit == "GB" or size < 0:
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.{2 if size < 10 else 1}f} {unit}"
