"""Benchmark decontamination by template canonicalisation. DataFrame operations only.

A text becomes a sequence of lower-cased words in which numbers, units that follow a number, and names
(capitalised words inside a sentence) are typed placeholders; their values are kept as slots. Windows of
WIDTH template words are hash-joined with the windows of the benchmark, so a question that was asked again
with other numbers or names still meets its template. Windows need LITERALS ordinary words. Two more views of the
same words stand beside the template: one where capitalised words that open a sentence are names too, and one of the
plain lower-cased words, by which verbatim passages match whatever their case. White space is folded first. An item
too dense in values to have a usable window has all its plain windows instead, and matches verbatim.

Matches of a document and an item along one alignment are then checked for slot consistency: each value of
the item must always have been replaced by the same value. Alignments that fail are coincidences of form and
are dropped. A document is contaminated by an item if the matches left cover half of the item's windows, or
RUN windows of it.

Only window hashes of the documents are exploded, and they meet the benchmark's distinct hashes in a
broadcast join while those number BROADCAST_WINDOWS at most (counted first); beyond that both are shuffled.
What follows has matched windows only. Items of SHORT to WIDTH - 1 words are one window of their own length;
those of 2 to SHORT - 1 words have no template and are one plain window, matched exactly. An item of a single word, or
of none, matches nothing.

Nulls: null texts are empty and match nothing; rows with a null id are matched like others. Repeated rows,
and items with equal texts, are each reported; equal (id, text) rows once. Empty tables give empty results.
Extra columns are ignored, and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table, written

WIDTH, SHORT, LITERALS = 8, 5, 4
COVERAGE, RUN = 0.5, 6
BROADCAST_WINDOWS = BROADCAST_KEYS = 1_000_000

# Units that become a placeholder after a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "w", "kw", "kwh", "v", "a",
    "j", "kj", "cal", "kcal", "n", "pa", "kpa", "mph", "kmh", "ft", "in", "yd", "mi", "oz", "lb", "lbs", "usd", "eur", "percent",
    "meters", "metres", "miles", "inches", "feet", "grams", "kilograms", "litres", "liters", "seconds", "minutes", "hours", "days",
    "weeks", "months", "years", "degrees", "dollars", "euros", "cents",
)

# Marks put before a value's text: name, unit; in place of the point inside a number; and before a capitalised word
# that opens a sentence. Private-use characters.
NAME, UNIT, POINT, START = "", "", "", ""


def template_words(text: Column) -> Column:
    """Words in order; a value starts with NAME or UNIT or a digit, a possible name at a sentence's start with START."""
    folded = F.regexp_replace(text, r"[\t-\r]\s*| \s+", " ")
    # every pattern begins with the rarest thing it needs, and looks behind only from there
    opened = F.regexp_replace(folded, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}])", START)
    named = F.regexp_replace(opened, rf"{START}(?<=[\p{{Ll}}\p{{N}},;:] {START})", NAME)
    low = F.lower(named)
    joined = F.regexp_replace(low, r"[.,](?<=[0-9].)(?=[0-9])", POINT)
    united = F.regexp_replace(joined, rf"([0-9])\s?({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", rf"$1 {UNIT}$2")
    ready = F.when(text.rlike("[0-9]"), united).otherwise(low)
    return F.regexp_extract_all(ready, F.lit(rf"[\p{{L}}\p{{N}}{NAME}-{START}]+"), F.lit(0))


# Codes of words. From NUMBER on they are values.
WORD, OPENER, NUMBER, MEASURE, PERSON = range(5)
VIEWS = 3


def _code(first: Column) -> Column:
    """The code of a word, by its first character's number."""
    marks = {UNIT: MEASURE, NAME: PERSON, START: OPENER}
    code = F.when((first > ord("9")) & (first < ord(NAME)), WORD).when((first >= ord("0")) & (first <= ord("9")), NUMBER)
    for mark, of in marks.items():
        code = code.when(first == ord(mark), of)
    return code.otherwise(WORD)


def _bare(word: Column, code: Column) -> Column:
    return F.when((code == WORD) | (code == NUMBER), word).otherwise(F.substring(word, 2, 1 << 30))


def slots_of(view: Column) -> Column:
    """A window's values in order, null where there are none; `view` is the window's. Reads part_words, part_codes."""
    least = F.when(view == 0, NUMBER).otherwise(OPENER)
    held = F.filter(F.zip_with("part_codes", "part_words", lambda c, w: F.when(c >= least, _bare(w, c))), lambda v: v.isNotNull())
    return F.when((view < 2) & (F.array_max("part_codes") >= least), held)


def windows(df: DataFrame, keys: list[str], text: Column, widths: list[int], every: bool = False) -> DataFrame:
    """keys, view, pos, width, window (hash), part_words, part_codes (the window's words and their codes).

    view 0 has placeholders for values; view 1 takes words that open a sentence for names too; view 2 has the plain
    words. Views that don't differ in a window are given once, as the first of them, or all if `every`.

    Each word is hashed once; a window is the hash of its words' hashes, made after the explode, in generated code.
    """
    words = df.select(*keys, template_words(text).alias("words"))
    coded = words.withColumn("codes", F.transform(F.transform("words", F.ascii), _code))
    plain = coded.withColumn("plain", F.zip_with("words", "codes", lambda w, c: F.xxhash64(_bare(w, c))))
    plain = plain.withColumn("special", F.array_max("codes") >= NUMBER).withColumn("opened", F.array_contains("codes", OPENER))
    # a point stands for a number: no word is that alone, so the windows of values and those of words stay apart
    number, measure, person = (F.xxhash64(F.lit(mark)) for mark in (POINT, UNIT, NAME))
    held = F.zip_with("plain", "codes", lambda h, c: F.when(c < NUMBER, h).when(c == NUMBER, number).when(c == MEASURE, measure).otherwise(person))
    template = plain.withColumn("template", F.when(F.col("special"), held).otherwise(F.col("plain")))
    named = F.zip_with("template", "codes", lambda h, c: F.when(c == OPENER, person).otherwise(h))
    typed = template.withColumn("wide", F.when(F.col("opened"), named).otherwise(F.col("template")))
    # outer: a plain explode would add a filter on the array, for which all of the above would be done twice
    placed = typed.select(*keys, "words", "codes", "special", "opened", "plain", "template", "wide", F.posexplode_outer("codes").alias("at", "code"))

    def part(array: str, width) -> Column:
        return F.slice(array, F.col("at") + 1, width)

    hashes = []
    for width in widths:
        whole = F.col("at") + width <= F.size("codes")
        opening = F.lit(True) if every else F.col("opened") & F.array_contains(part("codes", width), OPENER)
        valued = F.lit(True) if every else F.col("special") & (F.array_max(part("codes", width)) >= NUMBER)
        for array, given in (("template", F.lit(True)), ("wide", opening), ("plain", valued)):
            hashes.append(F.when(whole & given, F.xxhash64(part(array, width), F.lit(width))))
    found = placed.select(*keys, "words", "codes", "at", F.posexplode(F.array(*hashes)).alias("which", "window")).where("window is not null")
    width = F.lit(widths[0]) if len(widths) == 1 else F.element_at(F.array(*map(F.lit, widths)), (F.col("which") / VIEWS).cast("int") + 1)
    parts = [part(name, width).alias(f"part_{name}") for name in ("words", "codes")]
    return found.select(*keys, (F.col("which") % VIEWS).alias("view"), (F.col("at") + 1).alias("pos"), width.alias("width"), "window", *parts)


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """Windows of every item with `total`, the item's number of usable ones; and the widths in use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("t"), F.xxhash64("item_id", "text").alias("item_key"))
    length = F.size(template_words(F.col("t")))
    sized = items.select("*", F.least(length, F.lit(WIDTH)).alias("w")).where(F.col("w") >= 2)
    widths = sorted(r.w for r in sized.select("w").distinct().collect())  # 2 to WIDTH: a few values
    parts = [windows(sized.where(F.col("w") == w), ["item_id", "item_key"], F.col("t"), [w], every=True) for w in widths]
    if not parts:
        parts = [windows(sized, ["item_id", "item_key"], F.col("t"), [WIDTH], every=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("slots", slots_of(F.col("view"))).drop("part_words", "part_codes")
    literal = F.col("width") - F.coalesce(F.size("slots"), F.lit(0)) >= F.least(F.lit(LITERALS), F.col("width") - 1)
    spare = F.min(F.when(F.col("view") == 0, literal)).over(W.partitionBy("item_key", "pos", "width"))
    judged = every.withColumn("ordinary", spare)
    # an item whose values leave no template is searched by all its plain windows, values included
    dense = ~F.max("ordinary").over(W.partitionBy("item_key"))
    templated = (F.col("width") >= SHORT) & literal & F.col("ordinary")
    exact = (F.col("dense") | (F.col("width") < SHORT)) & (F.col("view") == 2)
    usable = judged.withColumn("dense", dense).where(templated | exact).drop("ordinary", "dense")
    usable = usable.dropDuplicates(["item_key", "view", "pos", "width"])
    totals = usable.groupBy("item_key", "view").agg(F.count(F.lit(1)).alias("total"))
    return usable.join(totals, ["item_key", "view"]), widths or [WIDTH]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, doc_key, item_id, matched, total, coverage, changed): contaminated documents, a row for each item.

    changed: a value of the item stands replaced in the document.
    """
    items, widths = item_windows(benchmark)
    items = items.select("item_id", "item_key", "view", F.col("pos").alias("item_pos"), "width", "window", F.col("slots").alias("item_slots"), "total")
    items = written(items, "benchmark-windows")
    small = items.count() <= BROADCAST_WINDOWS
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("t"), F.xxhash64(F.col(id_col).cast("long"), body).alias("doc_key"))
    found = windows(rows, ["doc_id", "doc_key"], F.col("t"), widths).withColumnRenamed("view", "doc_view")
    # the hash holds the width; slots are made of matched windows only
    met = found.drop("width").join(F.broadcast(items) if small else items, "window").withColumn("slots", slots_of(F.col("doc_view")))
    pair = F.transform(
        F.arrays_zip(F.coalesce("item_slots", F.array().cast("array<string>")).alias("a"), F.coalesce("slots", F.array().cast("array<string>")).alias("b")),
        lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")),
    )
    # along one alignment an item's window occurs once, so these arrays are bounded by the item
    lines = met.groupBy("doc_id", "doc_key", "item_id", "item_key", "view", "total", (F.col("pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs")
    )
    values = F.array_distinct(F.transform("pairs", lambda p: p["a"]))
    consistent = lines.where(F.size(values) == F.size("pairs"))
    changed = F.exists("pairs", lambda p: p["a"] != p["b"])
    each = consistent.select("doc_id", "doc_key", "item_id", "item_key", "view", "total", changed.alias("changed"), F.explode("at").alias("item_pos"))
    summed = (
        each.groupBy("doc_id", "doc_key", "item_id", "item_key", "view", "total", "item_pos")
        .agg(F.max("changed").alias("changed"))
        .groupBy("doc_id", "doc_key", "item_id", "item_key", "view", "total")
        .agg(F.count(F.lit(1)).alias("matched"), F.max("changed").alias("changed"))
    )
    # the views of an item count by themselves; the fullest one is reported
    best = F.max(F.struct((F.col("matched") / F.col("total")).alias("coverage"), "matched", "total", "changed")).alias("best")
    hit = (F.col("matched") >= RUN) | (F.col("matched") >= COVERAGE * F.col("total"))
    reported = summed.where(hit).groupBy("doc_id", "doc_key", "item_id", "item_key").agg(best)
    return reported.select("doc_id", "doc_key", "item_id", "best.matched", "best.total", "best.coverage", "best.changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the contaminated rows. Their keys are broadcast while they number BROADCAST_KEYS at most (counted first)."""
    bad = written(matches(docs, benchmark, text, id_col).select("doc_key").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    key = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    names = docs.columns
    return docs.withColumn("__key", key).join(bad.withColumnRenamed("doc_key", "__key"), "__key", "left_anti").select(*names)


def op1_decontamination(spark, sf_dir):
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "total", "coverage", "changed")
