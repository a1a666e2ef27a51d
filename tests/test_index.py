"""A small tree through init, update, edits, queries and maintenance."""

import json
import os
import urllib.request
from threading import Thread

import pytest

from symquarry import cli, serve
from symquarry.plans import answers as A
from symquarry.plans import index as I
from symquarry.sources import tree
from symquarry.streaming.watch import watch


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "node_modules/q").mkdir(parents=True)
    (root / "src/a.py").write_text("class A:\n    def run(self, b):\n        return helper(b)\n\ndef helper(x):\n    return x\n")
    (root / "src/c.cs").write_text("namespace N {\n  public class C : B {\n    public B Make(B b) {\n      return b;\n    }\n  }\n  public class B { }\n}\n")
    (root / "node_modules/q/i.js").write_text("x\n")
    (root / "readme.txt").write_text("data\n")
    return str(root), str(tmp_path / "index")


def counts(s):
    return tuple(s[k] for k in ("added", "modified", "deleted", "unchanged"))


def test_life_of_an_index(spark, repo):
    root, index = repo
    I.init(spark, root, index)
    s = I.update(spark, index)
    assert counts(s) == (3, 0, 0, 0) and (s["discovered"], s["ignored"]) == (4, 1) and s["parsed"] == 2 and s["skipped"] == 1
    d = I.diagnostics(spark, index)
    assert d["files"] == 3 and d["changes"] == 3 and d["snapshots"] == 1
    # 3 relations of Make and its class, containment both ways
    assert d["symbol_relations"] == 2 + 2 + 3

    found = A.search(spark, index, "MAKE")["results"]
    assert [(r["type"], r["name"]) for r in found] == [("symbol", "Make")]
    c = A.context(spark, index, ["A.run", "nope"], level=1, tree_paths=True)
    assert [(x["name"], x["level"]) for x in c["symbols"]] == [("run", 0), ("helper", 1)]
    assert c["warnings"] == ["Symbol not found: nope"] and c["reduced_file_tree"] == ["readme.txt", "src/a.py", "src/c.cs"]
    t = A.context(spark, index, ["Make"], types=True)["symbols"]
    assert [(x["name"], x["relation_type"]) for x in t] == [("Make", ""), ("B", "accepts_parameter_type")]
    small = A.context(spark, index, ["Make"], budget=5)
    assert small["symbols"][0]["truncated"] and small["warnings"] == ["Snippet truncated by budget: N.C.Make"] and small["budget"]["remaining_chars"] == 0
    assert set(A.context(spark, index, ["Make"], basic=True)) == {"symbols", "warnings"}

    with open(f"{root}/src/a.py", "a") as f:
        f.write("def more():\n    pass\n")
    os.rename(f"{root}/src/c.cs", f"{root}/src/d.cs")
    s = I.update(spark, index)
    assert counts(s) == (1, 1, 1, 1) and s["symbols_deactivated"] == 4
    os.rename(f"{root}/src/d.cs", f"{root}/src/c.cs")
    s = I.update(spark, index)
    assert counts(s) == (1, 0, 1, 2)
    assert counts(I.update(spark, index)) == (0, 0, 0, 3)
    before = I.diagnostics(spark, index)
    assert I.compact(spark, index)["size_after"] > 0
    after = I.diagnostics(spark, index)
    assert {k: before[k] for k in ("files", "symbols", "changes")} == {k: after[k] for k in ("files", "symbols", "changes")}


def fake():
    class Fake:  # local, so that it travels to the workers by value
        model = "fake"

        def enabled(self):
            return True

        def enrich(self, symbol):
            return ("", "") if symbol["name"] == "A" else ("about " + symbol["name"], "x,y")

    return Fake()


def test_chosen_files_lite_staged_and_enrichment(spark, repo):
    root, index = repo
    s = I.update_files(spark, index, root, ["src/a.py"], lite=True)
    assert counts(s) == (1, 0, 0, 0) and s["snapshot_id"] == 0
    assert A.grow(spark, index, ["Make"], ["src/c.cs"]) and not A.grow(spark, index, ["Make"], ["src/c.cs"])
    lite, full = I.update_staged(spark, index)
    assert counts(full) == (0, 0, 0, 3) and full["parsed"] == 2
    assert A.enrich(spark, index) == {"processed": 0, "enriched": 0, "failed": 0, "skipped": 0}
    e = A.enrich(spark, index, provider=fake())
    assert (e["enriched"], e["failed"]) == (e["processed"] - 1, 1)
    assert A.enrich(spark, index, True, fake())["processed"] == 1
    s = I.update_files(spark, index, root, ["src/a.py"], replace=True)
    assert s["deleted"] == 2


def test_direct_context(spark, repo):
    root, _ = repo
    d = A.direct_context(spark, f"{root}/src/a.py", "helper")
    assert [x["name"] for x in d["symbols"]] == ["helper"] and d["repository"]["last_indexed_at"] == "realtime"
    assert A.direct_context(spark, f"{root}/src/a.py", "zzz")["warnings"] == ["Signature not found in file: zzz"]
    with pytest.raises(ValueError):
        A.direct_context(spark, f"{root}/src/a.py", "x", f"{root}/node_modules")


def test_refusals(spark, repo, tmp_path):
    root, index = repo
    with pytest.raises(ValueError):
        I.init(spark, root, f"{root}/inside")
    with pytest.raises(FileNotFoundError):
        I.update(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        I.update_files(spark, index, root, ["missing.py"])
    with pytest.raises(ValueError):
        A.grow(spark, index, ["x"], [])


def test_include_and_exclude(spark, repo):
    root, _ = repo
    files, counts_ = tree.scan(spark, root, ["src", "src/a.py", "missing"], ["src/c.cs"])
    assert [r.relative_path for r in files.select("relative_path").collect()] == ["src/a.py"]
    assert tree.plan_includes(root, ["src"], ["src"])[2] == 1
    assert tree.scan(spark, root, ["node_modules/q"])[0].count() == 1


def test_http(spark, repo):
    root, index = repo
    I.init(spark, root, index)
    assert serve.respond(spark, index, "POST", "/update", b'{"lite": true}')[1]["added"] == 3
    assert serve.respond(spark, index, "POST", "/search", b"{}")[0] == 400
    assert serve.respond(spark, index, "POST", "/context", b"{}")[0] == 400
    assert serve.respond(spark, index, "POST", "/context", b"not json")[0] == 400
    assert serve.respond(spark, index, "GET", "/nothing", b"")[0] == 404
    assert serve.respond(spark, index + "x", "GET", "/status", b"")[0] == 500
    http = serve.server(spark, index, 0)
    Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}"
    assert json.load(urllib.request.urlopen(url + "/health")) == {"status": "ok"}
    body = json.dumps({"query": "helper", "limit": 1}).encode()
    assert json.load(urllib.request.urlopen(urllib.request.Request(url + "/search", body)))["results"][0]["name"] == "helper"
    http.shutdown()


def test_watching(spark, repo, tmp_path):
    root, index = repo
    watch(spark, root, index, str(tmp_path / "ck"), pattern="*.py").awaitTermination()
    assert I.diagnostics(spark, index)["files"] == 1
    with open(f"{root}/src/b.py", "w") as f:
        f.write("x = 1\n")
    watch(spark, root, index, str(tmp_path / "ck"), pattern="*.py").awaitTermination()
    assert I.diagnostics(spark, index)["files"] == 2


def test_command_line(spark, repo, capsys, monkeypatch):
    root, index = repo
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["init", root, "--index-dir", index]) == 0
    assert cli.main(["update", "--index-dir", index, "--format", "json"]) == 0
    assert cli.main(["search", "--index-dir", index, "--query", "helper"]) == 0
    assert cli.main(["context", "--index-dir", index, "--symbols", "helper", "--basic"]) == 0
    assert cli.main(["status", "--index-dir", index]) == 0
    assert cli.main(["status", "--index-dir", index + "none"]) == 1
    assert cli.main([]) == 0
    said = capsys.readouterr().out
    assert "python_function helper  src/a.py:5-6" in said


def test_updateroot_reads_path_lists(spark, repo, tmp_path):
    root, index = repo
    (tmp_path / "in.txt").write_text(f'# roots\n"{root}/src"\n\n')
    s = I.update_root(spark, index, str(tmp_path / "in.txt"))
    assert s["added"] == 2 and s["repo_root"] == f"{root}/src"


def test_names_with_pattern_signs_are_names(spark, tmp_path):
    from symquarry.sources import tree

    (tmp_path / "src[a]").mkdir()
    for n in ("[id].ts", "a*b.py", "{x}.py", "q?.py", "i.ts", "ab.py"):
        (tmp_path / "src[a]" / n).write_text("x = 1\n")
    chosen = [f"src[a]/{n}" for n in ("[id].ts", "a*b.py", "{x}.py", "q?.py")]
    assert {r.relative_path for r in tree.scan_files(spark, str(tmp_path), chosen).collect()} == set(chosen)


def test_an_update_without_changes_writes_no_rows_and_reports(spark, tmp_path):
    from symquarry.cli import bar
    from symquarry.plans import index as I
    from symquarry.plans.store import Store

    root, at = tmp_path / "r", str(tmp_path / "i")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    pass\n")
    I.init(spark, str(root), at)
    seen = []
    I.update(spark, at, reporter=lambda *x: seen.append(x))
    assert seen == [("scanned", 1, 1), ("parsed", 0, 1), ("parsed", 1, 1)]
    store = Store(spark, at)
    before = store.read("symbols").inputFiles()
    again = I.update(spark, at)
    assert again["unchanged"] == 1 and again["symbols_after"] == 1 and Store(spark, at).read("symbols").inputFiles() == before
    assert bar("parsed", 1, 4, 8) == "[##------] 1 / 4 parsed" and bar("parsed", 0, 0, 2) == "[##] 0 / 0 parsed"


def test_failed_requests_leave_symbols_pending_and_keys_come_from_the_environment(spark, monkeypatch):
    from symquarry.plans import enrich as E

    class broken:
        model = "m"

        def enabled(self):
            return True

        def enrich(self, symbol):
            assert symbol["relative_path"] == "a.py"
            raise OSError("no answer")

    df = spark.createDataFrame([(1, "f", "g", "g", "s", "a.py", 3)], "id long, kind string, name string, qualified_name string, signature string, relative_path string, line_start int")
    assert [(r.symbol_id, r.description) for r in E.run_provider(df, broken()).collect()] == [(1, "")]
    monkeypatch.setenv("SOME_KEY", "k")
    assert E.provider_of({"enabled": True, "endpoint": "http://x", "api_key_env": "SOME_KEY"}).key == "k"
