"""Lines of files: exploding, offsets, snippets, sections carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def line_array(content: Column) -> Column:
    """Lines without their ends; no empty line after a closing newline."""
    parts = F.split(content, "\n", -1)
    kept = F.when(content.endswith("\n") | (content == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(content.contains("\r"), F.transform(kept, lambda t: F.regexp_replace(t, "\r$", ""))).otherwise(kept)


def explode_lines(files: DataFrame, keys: list[str], content: str = "content", offsets: bool = True) -> DataFrame:
    """keys, line_no, text and, with offsets, char_start: the bytes before the line, carriage returns not counted."""
    lines = files.select(*keys, line_array(F.col(content)).alias("__lines"))
    if not offsets:
        return lines.select(*keys, F.posexplode("__lines").alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)
    sizes = F.transform("__lines", lambda t: (F.octet_length(t) + 1).cast("long"))
    placed = F.transform(F.array(F.struct(F.col("__lines").alias("text"), sizes.alias("size"))), _with_starts)[0]
    exploded = lines.select(*keys, F.posexplode(placed).alias("line_no", "__line"))
    return exploded.select(*keys, (F.col("line_no") + 1).alias("line_no"), "__line.text", "__line.char_start")


STEP = 256  # lines that are summed one by one


def _with_starts(x: Column) -> Column:
    """(text, char_start) of x's lines: a running total inside the row, by sums of STEP lines, without a shuffle."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v)
    whole = lambda i: (i / STEP).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), whole(F.size(x["size"]) - 1))), lambda k: total(F.slice(x["size"], k * STEP + 1, STEP)))
    ahead = F.transform(F.array(runs), lambda r: F.transform(r, lambda _, k: total(F.slice(r, 1, k))))[0]

    def placed(before: Column) -> Column:
        return F.transform(
            x["text"], lambda t, i: F.struct(t.alias("text"), (F.get(before, whole(i)) + total(F.slice(x["size"], whole(i) * STEP + 1, i % STEP))).alias("char_start"))
        )

    return F.transform(F.array(ahead), placed)[0]


def snippet(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end inclusive, each with its newline. Carriage returns stay."""
    inside = F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))
    return F.when(F.size(inside) > 0, F.concat(F.array_join(inside, "\n"), F.lit("\n"))).otherwise("")


def raw_lines(content: Column) -> Column:
    parts = F.split(content, "\n", -1)
    return F.when(content.endswith("\n") | (content == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def carry_forward(lines: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each line of a file."""
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))
