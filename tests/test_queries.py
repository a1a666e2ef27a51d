"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from symquarry.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(df):
    def text(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, float):
            return repr(round(v, 6)) if v != int(v) else str(int(v))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, db, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_queries_without_sql_give_rows(spark, sf_dir):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_related_types_of_every_relation(spark, sf_dir):
    from collections import Counter, defaultdict

    by_text = defaultdict(list)
    for r in catalog.sym(spark, sf_dir).where("kind in ('class', 'interface', 'struct', 'enum')").collect():
        for text in {r["name"], r["qualified_name"]}:
            by_text[text].append((r["qualified_name"], r["relative_path"], r["symbol_id"]))
    want = Counter()
    for r in catalog.QUERIES["relations_types"](spark, sf_dir).collect():
        for rank, (qualified, _, i) in enumerate(sorted(by_text[r["target_text"]])[:5], 1):
            want[r["relative_path"], r["source"], r["relation_type"], r["source_text"], r["target_text"], i, qualified, rank] += 1
    got = Counter(tuple(r) for r in catalog.QUERIES["related_types_all"](spark, sf_dir).collect())
    assert got == want and any(k[1] % 4 for k in want) and len({k[2] for k in want}) > 1


def test_entry_module_lists_them():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql())


def test_first_references_are_those_of_a_plain_search(spark):
    import re

    from symquarry.operators import context as C
    from symquarry.sources.scratch import materialised

    codes = ["the my-tool a.b.run\n", "the the café_x run ++ $v\n", "my tool -tool-x ++\n", "x--y my-tool-x é\n", ""]
    names = ["the", "my-tool", "tool", "run", "café_x", "++", "+++", "$v", "x--y", "-tool-x", "--y", "ab", "", "b.run"]
    items = spark.createDataFrame([(i, i, c.encode()) for i, c in enumerate(codes)], "seq long, symbol_id long, code binary")
    symbols = spark.createDataFrame([(100 + i, "class", n, f"q.{n}") for i, n in enumerate(names * 3)], "symbol_id long, kind string, name string, qualified_name string")
    want = {}
    for i, n in enumerate(names * 3):
        for word in {n, re.search(r"[^.:\\/]*$", f"q.{n}").group() or n}:
            found = [s for s, c in enumerate(codes) if len(word.encode()) >= 3 and re.search(rf"(?<![A-Za-z0-9_$]){re.escape(word)}(?![A-Za-z0-9_$])", c)]
            if found:
                want[100 + i] = min(found[0], want.get(100 + i, 99))
    assert {r.symbol_id: r.source_seq for r in C.first_references(items, symbols, materialised).collect()} == want
    assert len(want) > 20


def test_levels_keep_no_table_of_all_symbols(spark, sf_dir):
    spark.catalog.clearCache()
    catalog.QUERIES["level_expand_2"](spark, sf_dir).count()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
