"""Hand-written sources and the symbols they must give."""

import re

import pytest

from symquarry.operators.grammar import Walk, parameters, split_lines
from symquarry.operators.languages import BY_EXTENSION, BY_NAME, grammar_of, language_of, parse
from symquarry.plans.catalog import EXPECTED, FIXTURES, _parts


def rows(path, text):
    language, symbols = parse(path, text.encode())
    return language, [f"{s['kind']} {s['name']} [{s['qualified_name']}] {s['line_start']}-{s['line_end']}" for s in symbols]


CASES = {
    "a.cs": "namespace N [N] 1-10; class C [N.C] 2-9; field n [N.C.n] 3-3; property Name [N.C.Name] 4-4; constructor C [N.C.C] 5-5; method Add [N.C.Add] 6-8",
    "a.py": "python_import os [os] 1-1; python_class A [A] 2-6; python_field x [A.x] 3-3; python_async_method f [A.f] 4-5; python_function g [g] 7-8",
    "A.java": "java_package p [p] 1-1; java_class A [p.A] 2-6; java_method f [p.A.f] 3-5; java_method g [p.A.g] 4-4",
    "a.sh": "shell_export PATH_X [PATH_X] 2-2; shell_function greet [greet] 3-3; shell_command echo [echo] 4-4",
    "db/migrations/001_init.sql": "sql_migration 001_init.sql [001_init.sql] 1-1; sql_table users [users] 2-2; sql_view v_users [v_users] 5-5",
    "a.html": "html_id main [main] 1-1; html_class a [a] 1-1; html_class b [b] 1-1",
    "a.css": "css_selector .a [.a] 1-1; css_selector .b:hover [.b:hover] 1-1; css_custom_property --gap [--gap] 2-2; css_keyframes spin [spin] 4-4",
    "a.yaml": "yaml_section services [services] 1-1; compose_service web [web] 2-2; compose_service image [image] 3-3",
    "a.tf": "terraform_resource aws_s3_bucket.b [aws_s3_bucket.b] 1-1",
    "Dockerfile": "docker_from alpine:3 [alpine:3] 1-1",
    "requirements.txt": "python_dependency requests [requests] 1-1",
    "go.mod": "go_module example.com/m [example.com/m] 1-1; go_dependency github.com/a/b [github.com/a/b] 3-3",
    "a.h": "",
    "a.ts": "angular_component X [X] 2-7; js_method go [X.go] 3-6; react_hook useIt [useIt] 8-9; ts_interface Q [Q] 10-10",
    "a.rb": "ruby_module M [M] 1-7; ruby_class C [M::C] 2-6; ruby_attribute a [M::C::a] 3-3; ruby_attribute b [M::C::b] 3-3; ruby_method x [M::C::x] 4-5; rails_route /x [/x] 8-8",
    "a.rs": "rust_use std::fmt [std::fmt] 1-1; rust_struct S [S] 2-3; rust_impl S [S] 4-7; rust_method f [S::f] 5-6; rust_module x [x] 8-8; rust_macro mm [mm] 9-9",
    "a.php": "php_namespace App [App] 2-2; php_class U [App\\U] 3-8; php_property $a [App\\U\\$a] 5-5; php_constructor __construct [App\\U\\__construct] 6-7; php_function g [App\\g] 9-10",
    "a.go": "go_package p [p] 1-1; go_import fmt [fmt] 3-3; go_method F [p.F] 5-6; go_function G [p.G] 7-8; go_struct S [p.S] 9-10; go_variable X [p.X] 11-11",
    "a.kt": "kotlin_package p [p] 1-1; kotlin_class A [p.A] 2-5; kotlin_method f [p.A.f] 3-4; kotlin_variable z [p.z] 6-6",
    "pom.xml": "maven_artifact me [me] 1-1; maven_dependency g:a [g:a] 2-2",
    "x.m": "matlab_class A [A] 1-7; matlab_property p [A.p] 3-3; matlab_method f [A.f] 5-6",
    "a.vue": "html_id q [q] 2-2; css_selector .z [.z] 11-11; js_class A [A] 5-8; js_method m [A.m] 6-7",
    "composer.json": "composer_package v/p [v/p] 2-2; composer_dependency a/b [a/b] 4-4; composer_autoload psr-4 [autoload.psr-4] 7-7",
    "CMakeLists.txt": "cmake_project P [P] 1-1; cmake_target lib [lib] 2-2",
    "Makefile": "make_target all [all] 1-1",
}


def sources():
    return {p.partition("\n")[0]: p.partition("\n")[2] for p in FIXTURES.read_text(encoding="utf-8").split("=== ")[1:]}


@pytest.mark.parametrize("path", CASES)
def test_symbols(path):
    _, got = rows(path, sources()[path])
    assert "; ".join(got) == CASES[path]


@pytest.mark.parametrize("path", _parts(EXPECTED))
def test_expected_rows(path):
    """All hand-derived rows, which are also the SQL of the grammar queries."""
    _, got = rows(path, sources()[path])
    assert got == _parts(EXPECTED)[path].splitlines() and CASES.get(path, "; ".join(got)) == "; ".join(got)


def test_csharp_details():
    _, s = parse("a.cs", sources()["a.cs"].encode())
    assert s[1]["base_types"] == ["B", "IX"] and s[1]["visibility"] == "public"
    assert [(p["name"], p["type"], p["default_value"], p["direction"]) for p in s[5]["parameters"]] == [("x", "int", "", "ref"), ("y", "int", "1", "")]
    assert [x["parent_index"] for x in s] == [-1, -1, 1, 1, 1, 1]


def test_every_grammar_reads_something_or_nothing_without_error():
    for name in [*BY_NAME, *("f" + e for e in BY_EXTENSION), "f.vue"]:
        for text in ("", "\n", "x", "{\n}\n}", 'a "b\n' * 3, "é\x00\xff"):
            language, symbols = parse(name, text.encode())
            assert language and all(s["line_end"] >= s["line_start"] or s["kind"] == "project" for s in symbols)


def test_headers_are_read_as_objective_c():
    assert language_of("a.h") == "objective-c" and language_of("a.hpp") == "cpp"


def test_dispatch_prefers_whole_names():
    assert grammar_of("x/Cargo.toml").language == "cargo" and grammar_of("x/package.json").language == "npm"
    assert language_of("x.dockerfile") == "yaml" and language_of("noext") is None and language_of(".bashrc") is None


def test_matlab_files_can_be_objective_c():
    assert parse("a.m", b"@interface Foo\n- (int)bar;\n")[0] == "objective-c"


def test_line_offsets_ignore_carriage_returns():
    assert [(x.text, x.start) for x in split_lines("a\r\nbc\r\n")] == [("a", 0), ("bc", 2)]
    assert split_lines("") == [] and len(split_lines("a\n\n")) == 2


def test_every_comma_divides_parameters():
    assert [p["name"] for p in parameters("Map<K, V> m", "last")] == ["Map<K", "m"]
    assert parameters("void", "pair_void") == [] and parameters("int", "first")[0]["type"] == "int"


def test_forward_declaration_opens_a_scope():
    _, got = rows("a.cpp", "class X;\nint f() {\n}\n")
    assert got[0].startswith("class X [X] 1-")


def test_file_scoped_namespace_never_closes():
    _, got = rows("a.cs", "namespace N;\nclass A { }\n")
    assert got == ["namespace N [N] 1-1", "class A [N.A] 2-2"]


def test_long_lines_need_no_stack():
    parse("a.sh", ("x" * 50 + "'#' ") .encode() * 2000)
    assert re.match("shell", parse("a.sh", b"echo " + b"a" * 100000)[0])


def test_walk_positions_are_bytes():
    _, s = parse("a.sh", "é='x'\nexport A=1\n".encode())
    assert s[-1]["char_start"] == len("é='x'\nexport ".encode())
    assert isinstance(Walk, type)
