"""Secret scan: fixed patterns, and a randomness test battery for what no pattern names. DataFrame operations only.

Candidates are maximal runs of [A-Za-z0-9+/_-] of at least `MIN_RUN` characters (with closing `=`). The
encoding is inferred from the characters used: hex, base32, base36 (letters of one case and digits), else base64.
Under "drawn uniformly from that alphabet" these statistics have known laws:

* chi-squared uniformity over equal slices of the alphabet (4, 8 or 16 slices, by length), and over its
  classes of characters (lower case, upper case, the rest) with their own shares;
* the Wald-Wolfowitz runs test on symbols above and below the middle of the alphabet;
* lag-1 serial correlation of the symbols' ordinals.

A run that any of them rejects at `UNIFORM_LEVEL` (Bonferroni over the four) is not random text. That
alone would let short ordinary words pass, so each run also gets a p-value under "ordinary text": words,
paths and identifiers follow the letter pairs of LETTER_PAIRS and change between lower case, upper case, digits
and signs once in 1 / `SWITCH_RATE` characters. The likelihood ratio of the encoding to that model exceeds e^x
with probability e^-x at most in ordinary text (Markov), whatever the encoding, so e^-x is the p-value.
Benjamini-Hochberg over the ordinary-text p-values of all candidates of the input, from a
histogram of fixed size, keeps the share of false discoveries at `FALSE_DISCOVERY`. Runs found both ways
become spans of kind `random`, unless they overlap a span of the patterns.

Work is linear in a text and its matches, however many. Runs under MIN_RUN characters aren't tested: they cannot give
enough evidence to pass among all words of a corpus.

Nulls: a null text is empty. Texts without matches have empty span strings. Rows share nothing but the cut of the
false-discovery control, which depends on all candidates; repeated rows each get their row; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

# The three base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough
ASSIGN_MIN, ACCESS_MIN = 8, 16
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}"
UNIFORM_LEVEL, FALSE_DISCOVERY, SWITCH_RATE = 0.01, 0.05, 0.125
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# -10 ln P(letter | letter before it), rounded down, from chr(48) on; a row for each letter before. Counted over the words
# of ordinary documents in four languages, a tenth of the mass spread evenly.
LETTER_PAIRS = "".join(
    [
        "U^QUQgdZKdgYa<TfbOIAFb_ggg",
        "gggg:gggggg8ggJgggggggggMg",
        "ggfgdgg4>ggeggLgggggeggggg",
        "KVeg:ggPGggWgQBggUPLYgWggg",
        "G\\\\JOgbYJecS_ATab>GRV`_gg\\",
        "JU\\fFfZSXg\\Zg];]gBSE][bgg\\",
        "BT]g9g^OQg_TgRL_gWLM\\^Wgg^",
        "AU_g:g`OMg`UfQL`fUPK`_Wgga",
        "WbNdDge_[eg^\\:BbaZNEebcggg",
        "1ggggggggggggggggggggggggg",
        "gggg1ggggggggggggggggggggg",
        "Hebe9gegJegGcgYgec`eeggg>g",
        "cgfg4ggf>ggggg_dgfffgggggg",
        "MTYBFgEQPeaT^RL_`TOA^^Xgga",
        "^d_c`GdfPdgdY9bgdCPbAgfggg",
        "7gggg:gg_ggcggIgggggeggggg",
        "gggggggggggggggggggg1ggggg",
        "IS[e8g^POe`UbRL_dNPL^^Xgg`",
        "RZE^Mg^?S^gZ[YTg_WY:Xg_ggg",
        "R[cgIgd8@gd]fZMcfQXTdc^ggT",
        "OY[g<[bXRgaW\\APZ^PVPa\\_Bgb",
        "gggg7ggg:gggggGggggggggggg",
        "Fgggggg3Gggggbbggggggggggg",
        "CgNgAgggNggNOgDONHgGgNgggg",
        "IQdfAggIKggPgJEggQIDggQggg",
        "PSS`OgW[X^YX[g`[_\\TS5Zggg[",
    ]
)
STEP = 256  # values that a running total combines one by one
PIECE = 4096  # characters of a text that are cut out together
BIN = 0.05  # width of the histogram of -ln p
LAST_BIN = 2000

SPAN = "array<struct<start:bigint,end:bigint,kind:int,match:string>>"


def named(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine, zero) -> Column:
    """For each value, what `combine` makes of those before it.

    Values are combined in runs of STEP, and those before a run by runs: about STEP steps a value for millions of them.
    """
    fold = lambda part: F.aggregate(part, F.lit(zero).cast("bigint"), combine)
    direct = lambda of: F.transform(of, lambda _, i: fold(F.slice(of, 1, i)))
    runs = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / STEP).cast("int")), lambda k: fold(F.slice(values, k * STEP + 1, STEP)))
    within = lambda ahead: F.transform(values, lambda _, i: combine(F.get(ahead, (i / STEP).cast("int")), fold(F.slice(values, (i / STEP).cast("int") * STEP + 1, i % STEP))))
    return named(named(runs, direct), within)


def added(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def spans_of(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters; code points."""
    extract = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def placed(x: Column) -> Column:
        def one(begins: Column) -> Column:
            def span(f: Column, i: Column) -> Column:
                begin = F.get(begins, i) + F.char_length(F.get(x["gaps"], i))
                return F.struct(begin.alias("start"), (begin + F.char_length(f)).alias("end"), F.lit(kind).alias("kind"), f.alias("match"), F.char_length(F.get(x["tested"], i)).alias("size"))

            return F.transform(F.filter(F.transform(x["found"], span), lambda s: s["size"] >= least), lambda s: s.dropFields("size"))

        lengths = F.transform(x["found"], lambda f, i: (F.char_length(f) + F.char_length(F.get(x["gaps"], i))).cast("bigint"))
        return named(lengths, lambda n: named(running(n, added, 0), one))

    def spans(found: Column) -> Column:
        parts = F.struct(found.alias("found"), (extract(group) if group else found).alias("tested"), F.split(text, pattern, -1).alias("gaps"))
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(named(parts, placed).cast(SPAN))

    return named(extract(0), spans)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal; Zelen and Severo's polynomial, error below 1e-7."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + a * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def battery(token: Column) -> Column:
    """struct(encoding, p_uniform, ordinary_nats) of one run of characters."""
    return named(F.rtrim(F.translate(token, "-_=", "+/ ")), _inferred)


def _inferred(body: Column) -> Column:
    encoding = (
        F.when(body.rlike("^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^[A-Z0-9]+$"), "base36")
        .when(body.rlike("^[a-z2-7]+$"), "base32")
        .when(body.rlike("^[a-z0-9]+$"), "base36")
        .otherwise("base64")
    )

    def spelled(e: Column) -> Column:
        cased = F.when(e == "hex", F.lower(body)).when(e != "base64", F.upper(body)).otherwise(body)
        alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), e)
        return named(F.struct(e.alias("encoding"), F.split(cased, "").alias("chars"), alphabet.alias("alphabet")), _measured)

    return named(encoding, spelled)


def _measured(x: Column) -> Column:
    """Each value is named once, so that none is computed twice."""
    chars, size = x["chars"], F.length(x["alphabet"])
    at = F.transform(chars, lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
    kind = F.transform(chars, lambda c: F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).when(c.between("0", "9"), 3).otherwise(4))
    letter = F.transform(chars, lambda c: F.ascii(F.lower(c)) - 97)
    high = F.transform(chars, lambda c: F.instr(x["alphabet"], c) * 2 - 2 >= size)
    return named(
        F.struct(
            F.size(chars).cast("double").alias("n"), size.cast("double").alias("size"), at.alias("at"), kind.alias("kind"), letter.alias("letter"),
            high.alias("high"), x["encoding"].alias("encoding"),
        ),
        _statistics,
    )


def _statistics(x: Column) -> Column:
    n, size, at, high = x["n"], x["size"], x["at"], x["high"]
    steps = F.sequence(F.lit(1), n.cast("int") - 1)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    ones = lambda c: total(F.transform(c, lambda v: v.cast("double")))

    slices = F.when(n < 40, 4).when(n < 80, 8).otherwise(16)
    expected = n / slices
    counts = F.transform(F.sequence(F.lit(0), slices - 1), lambda b: F.size(F.filter(at, lambda v: F.floor(v * slices / size) == b)))
    chi = total(F.transform(counts, lambda c: (c - expected) * (c - expected) / expected))
    df = (slices - 1).cast("double")
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
    p_chi = upper_tail(z_chi)

    # the share of each class of characters; counts of the classes that an encoding doesn't tell apart are joined
    of_kind = lambda k: F.size(F.filter(x["kind"], lambda v: v == k)).cast("double")
    letters, capitals, others = of_kind(1), of_kind(2), of_kind(3) + of_kind(4)
    off = lambda seen, share: (seen - n * share) * (seen - n * share) / (n * share)
    digits = F.when(size == 16, 10 / 16).when(size == 32, 6 / 32).otherwise(10 / 36)
    two = off(letters + capitals, 1 - digits) + off(others, digits)
    three = off(letters, F.lit(26 / 64)) + off(capitals, F.lit(26 / 64)) + off(others, F.lit(12 / 64))
    p_class = F.when(size == 64, F.exp(-three / 2)).otherwise(2 * upper_tail(F.sqrt(two)))

    up = ones(high)
    down = n - up
    runs = 1 + ones(F.transform(steps, lambda i: F.get(high, i) != F.get(high, i - 1)))
    mean = 2 * up * down / n + 1
    spread = F.sqrt(F.greatest(F.lit(1e-9), 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))))
    p_runs = F.when((up == 0) | (down == 0), F.lit(0.0)).otherwise(2 * upper_tail(F.abs(runs - mean) / spread))

    middle, variance = (size - 1) / 2, (size * size - 1) / 12
    serial = total(F.transform(steps, lambda i: (F.get(at, i) - middle) * (F.get(at, i - 1) - middle)))
    p_serial = 2 * upper_tail(F.abs(serial / (variance * F.sqrt(n - 1))))

    # ln P of each character under the encoding over that in ordinary text, which changes class at SWITCH_RATE
    def cost(i: Column) -> Column:
        now, was = F.get(x["kind"], i), F.get(x["kind"], i - 1)
        pair = (F.ascii(F.get(F.split(F.lit(LETTER_PAIRS), ""), F.get(x["letter"], i - 1) * 26 + F.get(x["letter"], i))) - 48) / 10.0
        inside = F.when(now <= 2, pair).when(now == 3, math.log(10)).otherwise(math.log(2))
        entered = F.when(now <= 2, math.log(26)).when(now == 3, math.log(10)).otherwise(math.log(2))
        return F.when(now == was, inside - math.log(1 - SWITCH_RATE)).otherwise(entered - math.log(SWITCH_RATE / 3))

    nats = F.greatest(F.lit(0.0), total(F.transform(steps, cost)) - (n - 1) * F.log(size))
    return F.struct(
        x["encoding"].alias("encoding"), F.least(F.lit(1.0), 4 * F.least(p_chi, p_class, p_runs, p_serial)).alias("p_uniform"), nats.alias("ordinary_nats")
    )


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base (spans of the patterns) and __candidates (spans with the battery's results)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(spans_of(t, ASSIGN, 0, ASSIGN_MIN, 2), spans_of(t, ACCESS, 1, ACCESS_MIN), spans_of(t, HEX, 2, 32))
    marked = docs.withColumn("__base", base).withColumn("__candidates", spans_of(t, CANDIDATE, 3, MIN_RUN))
    tested = F.transform("__candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["match"]).alias("test")))
    return marked.withColumn("__base", F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).withColumn("__candidates", tested)


def discovery_threshold(found: DataFrame) -> DataFrame:
    """One row (__least_nats): the Benjamini-Hochberg cut over all candidates, to the next bin; no row passes if null."""
    nats = found.select(F.explode("__candidates.test.ordinary_nats").alias("nats"))
    bins = nats.groupBy(F.least(F.floor(F.col("nats") / BIN), F.lit(LAST_BIN)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # at most LAST_BIN + 1 rows from here on
    ranked = bins.withColumn("above", F.sum("n").over(W.orderBy(F.desc("bin")))).withColumn("m", F.sum("n").over(W.partitionBy()))
    passing = F.exp(-F.col("bin") * BIN) <= F.lit(FALSE_DISCOVERY) * F.col("above") / F.col("m")
    return ranked.where(passing).agg((F.min("bin") * BIN).alias("__least_nats"))


def with_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """docs with __secrets: array of (start, end, kind), by start and kind. docs is written once, with what was found."""
    return _judged(written(scanned(docs, text), name))


def _judged(found: DataFrame) -> DataFrame:
    judged = found.crossJoin(F.broadcast(discovery_threshold(found)))  # one row
    blank = lambda t: F.lit(None).cast(t)
    base = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), blank("double").alias("uniform"), blank("double").alias("nats")))
    candidates = F.transform(
        "__candidates", lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"), c["test"]["p_uniform"].alias("uniform"), c["test"]["ordinary_nats"].alias("nats"))
    )
    random = F.filter(candidates, lambda c: (c["uniform"] >= UNIFORM_LEVEL) & (c["nats"] >= F.col("__least_nats")))
    every = named(F.sort_array(F.concat(base, random)), _free)
    return judged.withColumn("__secrets", every).drop("__base", "__candidates", "__least_nats")


def _free(spans: Column) -> Column:
    """(start, end, kind) of spans, which are sorted by start and kind, without random ones that overlap another kind."""
    far = (1 << 63) - 1
    fixed = lambda s: s["kind"] < 3
    before = running_over(spans, lambda s: F.when(fixed(s), s["end"]).otherwise(0), larger, 0)
    after = F.reverse(running_over(F.reverse(spans), lambda s: F.when(fixed(s), s["start"]).otherwise(far), smaller, far))

    def marked(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            free = fixed(s) | ((F.get(x["before"], i) <= s["start"]) & (F.get(x["after"], i) >= s["end"]))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), free.alias("free"))

        return F.transform(F.filter(F.transform(spans, one), lambda s: s["free"]), lambda s: s.dropFields("free"))

    # texts without a candidate left, and those with nothing else, need no look at overlaps
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    mixed = F.exists(spans, fixed) & F.exists(spans, lambda s: ~fixed(s))
    return F.when(mixed, named(F.struct(before.alias("before"), after.alias("after")), marked)).otherwise(plain)


def running_over(spans: Column, value, combine, zero) -> Column:
    return named(F.transform(spans, lambda s: value(s).cast("bigint")), lambda v: running(v, combine, zero))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret (overlapping ones together) replaced by `mask`; other columns as they were, null texts stay null."""
    columns = docs.columns
    marked = with_secrets(docs, text, "redact")
    t = F.col(text)
    secrets = F.col("__secrets")

    def masked(cut) -> Column:
        """cut(a, b): the characters from a up to b, to the end if b is None."""

        def joined(x: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                at = F.get(x["before"], i)
                return F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit(mask))).otherwise("")

            last = F.greatest(F.element_at(x["before"], -1), F.element_at(secrets, -1)["end"])
            return F.concat(F.array_join(F.transform(secrets, one), ""), cut(last, None))

        return named(F.struct(running_over(secrets, lambda s: s["end"], larger, 0).alias("before")), joined)

    def by_pieces(pieces: Column) -> Column:
        whole = F.char_length(t).cast("bigint")

        def cut(a: Column, b: Column | None) -> Column:
            b = whole if b is None else b
            first, last = (a / PIECE).cast("int"), (b / PIECE).cast("int")
            inside = F.substring(F.get(pieces, first), (a % PIECE + 1).cast("int"), (b - a).cast("int"))
            head = F.substring(F.get(pieces, first), (a % PIECE + 1).cast("int"), F.lit(PIECE))
            tail = F.coalesce(F.substring(F.get(pieces, last), F.lit(1), (b % PIECE).cast("int")), F.lit(""))
            across = F.concat(F.coalesce(head, F.lit("")), F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), tail)
            return F.when(first == last, F.coalesce(inside, F.lit(""))).otherwise(across)

        return masked(cut)

    # a character's place is counted from the start of its string, so texts with secrets are cut into pieces first
    done = named(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), by_pieces)
    return marked.withColumn(text, F.when(F.size(secrets) == 0, t).otherwise(done)).select(*columns)


def secret_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(scanned(kept).drop("text"), "secrets")
    judged = _judged(found)
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("__secrets", lambda s: s["kind"] == k)).cast("long")
    return judged.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(line(F.filter("__secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        line(F.col("__secrets")).alias("spans"),
    )


def op10_secret_scan(spark, sf_dir):
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
