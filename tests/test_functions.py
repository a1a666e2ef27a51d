import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symquarry.functions import text as T
from symquarry.operators import context as C


def test_content_hash_known_values():
    assert T.fnv1a64_of([b"", b"a", b"hi"]) == ["cbf29ce484222325", "af63dc4c8601ec8c", "08ba5f07b55ec3da"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=30))
def test_content_hash_equals_the_plain_loop(values):
    def plain(v):
        h = 14695981039346656037
        for b in v:
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return f"{h:016x}"

    assert T.fnv1a64_of(values) == [plain(v) for v in values]


def test_like_agrees_with_sqlite(spark):
    names = ["aXb", "a_b", "App\\User", "ÀB", "àb", "100%", "", "x\ny"]
    queries = ["a_b", "%", "app\\user", "àb", "ab", "0%", "_", ""]
    db = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for q in queries:
        got = [r.h for r in df.select(T.contains_like(F.col("n"), q).alias("h")).collect()]
        want = [bool(db.execute("select ? like ?", (n, f"%{q}%")).fetchone()[0]) for n in names]
        assert got == want, q


def test_line_counts_and_extensions(spark):
    df = spark.createDataFrame([("", ""), ("a", "x/.bashrc"), ("a\n", "x/a.tar.GZ"), ("a\n\n", "a.")], "t string, p string")
    rows = df.select(T.line_count(F.col("t")).alias("n"), T.extension(F.col("p")).alias("e")).collect()
    assert [(r.n, r.e) for r in rows] == [(0, ""), (1, ""), (1, ".gz"), (2, ".")]


def test_format_bytes():
    assert [T.format_bytes(n) for n in (0, 1023, 1536, 20 * 1024, -5, 3 << 30)] == ["0 B", "1023 B", "1.50 KB", "20.0 KB", "-5 B", "3.00 GB"]


def spend_model(sizes, budget):
    left, out = budget, []
    for n in sizes:
        taken = min(n, left) if left > 0 else 0
        out.append((taken, left <= 0 or n > left))
        left -= taken
    return out


def test_budget_equals_the_greedy_model(spark):
    cases = [([10, 10, 5], 15), ([10, 10, 5], 20), ([], 3), ([0, 4, 0, 9], 4), ([3], 0), ([5, 5, 5], 100)]
    for sizes, budget in cases:
        rows = [(i, "q", bytearray(b"x" * n)) for i, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "seq long, qualified_name string, code binary")
        got = [(r.taken, r.truncated) for r in C.spend(df, budget).orderBy("seq").collect()]
        assert got == spend_model(sizes, budget)
