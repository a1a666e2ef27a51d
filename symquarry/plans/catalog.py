"""Every registered query of the engine, with the SQL that must give the same rows.

The corpus views turn the driver tables into a source tree; each query applies one operator to it. SQL is
DuckDB's and states the meaning independently of the operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import context as C
from ..operators import diff as D
from ..operators import lines as L
from ..operators import parse as P
from ..operators import relations as R
from ..operators import search as S
from ..sources import corpus, tree
from ..sources.scratch import materialised
from . import enrich

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---- SQL of the corpus views

DOCS = "docs AS (SELECT 'documents/' || source || '/' || lang || '/' || doc_id || '.sh' AS relative_path, text AS content, doc_id, lang, source FROM documents)"
PAGES = "pgs AS (SELECT 'pages/' || page_id || '.html' AS relative_path, replace(html, '><', '>' || chr(10) || '<') AS content FROM pages)"
FILES = f"{DOCS}, {PAGES}, fls AS (SELECT relative_path, content FROM docs UNION ALL SELECT relative_path, content FROM pgs)"
BYTES = "octet_length(encode(content))"
NEWLINES = "(length(content) - length(replace(content, chr(10), '')))"
LINES = """parts AS (SELECT relative_path, doc_id, lang, source, string_split(content, chr(10)) AS p FROM docs),
kept AS (SELECT * EXCLUDE p, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lns AS (SELECT relative_path, doc_id, lang, source, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS text FROM kept)"""
SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
CODE = f"""code AS (SELECT *, trim(regexp_extract(text, '^((?:[^''"#]+|''[^'']*(?:''|$)|"[^"]*(?:"|$))*)', 1), {SPACES}) AS c FROM lns)"""
COMMANDS = """cmd AS (SELECT *, regexp_extract(c, '^([A-Za-z_](?:[A-Za-z0-9_.\\-]*[A-Za-z0-9_])?)', 1) AS name FROM code WHERE c <> '')"""
SYM_RULES = """
  CASE WHEN regexp_matches(c, '^(?:function\\s+)?[A-Za-z_][A-Za-z0-9_]*\\s*(?:\\(\\))?\\s*\\{') THEN 'shell_function'
       WHEN regexp_matches(c, '^export\\s+[A-Za-z_][A-Za-z0-9_]*=?') THEN 'shell_export'
       WHEN regexp_matches(c, '^alias\\s+[A-Za-z_][A-Za-z0-9_\\-]*=') THEN 'shell_alias'
       WHEN regexp_matches(c, '^(?:source|\\.)\\s+.+') THEN 'shell_source'
       WHEN name <> '' THEN 'shell_command' END"""
SYM_NAMES = """
  CASE WHEN kind = 'shell_function' THEN regexp_extract(c, '^(?:function\\s+)?([A-Za-z_][A-Za-z0-9_]*)', 1)
       WHEN kind = 'shell_export' THEN regexp_extract(c, '^export\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)
       WHEN kind = 'shell_alias' THEN regexp_extract(c, '^alias\\s+([A-Za-z_][A-Za-z0-9_\\-]*)', 1)
       WHEN kind = 'shell_source' THEN trim(regexp_extract(c, '^(?:source|\\.)\\s+(.+)', 1)) ELSE name END"""
SHELL = f"""{DOCS}, {LINES}, {CODE}, {COMMANDS}, ruled AS (SELECT *, {SYM_RULES} AS kind FROM cmd),
shell AS (SELECT relative_path, doc_id, lang, source, line_no, kind, {SYM_NAMES} AS name, regexp_replace(c, '\\s+', ' ', 'g') AS signature, text, c FROM ruled
  WHERE kind IS NOT NULL AND NOT (kind = 'shell_command' AND name IN ('if', 'then', 'fi', 'for', 'do', 'done', 'case', 'esac')))"""
KINDS = "['class', 'interface', 'method', 'function', 'field', 'enum']"
SYM = f"""{SHELL}, sym AS (SELECT doc_id * 100000 + line_no AS symbol_id, relative_path, doc_id, line_no, name, lang || '.' || source || '.' || name AS qualified_name, signature,
  {KINDS}[1 + CAST((doc_id + line_no) % 6 AS INTEGER)] AS kind, coalesce(string_split(signature, ' ')[2], '') AS return_type, line_no AS line_start, line_no AS line_end FROM shell)"""


def ascii_like(column: str, text: str) -> str:
    return f"translate(coalesce({column}, ''), '{T.UPPER}', '{T.LOWER}') LIKE '%{text}%'"


def symbol_like(text: str) -> str:
    return "(" + " OR ".join(ascii_like(c, text) for c in ("name", "qualified_name", "signature")) + ")"


# ---- views of the corpus in Spark


def shell_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents_as_files(spark, sf_dir)
    return P.shell_lines(docs, ["relative_path", "doc_id", "lang", "source"])


def sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell commands under kinds that queries can expand."""
    kinds = F.array(*map(F.lit, ("class", "interface", "method", "function", "field", "enum")))
    s = shell_symbols(spark, sf_dir)
    second = F.coalesce(F.get(F.split("signature", " "), F.lit(1)), F.lit(""))
    return s.select(
        (F.col("doc_id") * 100000 + F.col("line_no")).alias("symbol_id"), "relative_path", "doc_id", "line_no", "name",
        F.concat_ws(".", "lang", "source", "name").alias("qualified_name"), "signature",
        F.element_at(kinds, (1 + F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(6))).cast("int")).alias("kind"),
        second.alias("return_type"), F.col("line_no").cast("int").alias("line_start"), F.col("line_no").cast("int").alias("line_end"),
    )


def active_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    return f.select("relative_path", F.concat(F.lit("/repo/"), "relative_path").alias("absolute_path"))


# ---- scanning

STATS_SQL = f"""WITH {FILES} SELECT relative_path, CAST({BYTES} AS BIGINT) AS size_bytes, CAST({BYTES} AS BIGINT) AS char_count,
CAST(CASE WHEN content = '' THEN 0 WHEN content LIKE '%' || chr(10) THEN {NEWLINES} ELSE {NEWLINES} + 1 END AS BIGINT) AS line_count FROM fls"""


@query(STATS_SQL)
def scan_file_stats(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    size = F.octet_length("content").cast("long")
    return f.select("relative_path", size.alias("size_bytes"), size.alias("char_count"), T.line_count(F.col("content")).cast("long").alias("line_count"))


@query(
    """WITH h AS (SELECT item_id, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(0, octet_length(encode(text))),
  lambda i: CAST(('0x' || substr(hex(encode(text)), 2 * i + 1, 2)) AS UHUGEINT))), lambda a, b: (xor(a, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)) AS v FROM benchmark)
SELECT item_id, lower(lpad(hex(CAST(v AS UBIGINT)), 16, '0')) AS content_hash FROM h"""
)
def fnv1a_hash(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", T.fnv1a64(F.col("text")).alias("content_hash"))


IGNORED_ROOT = "CASE WHEN page_id % 7 = 0 THEN 'node_modules/x/' WHEN page_id % 11 = 0 THEN 'src/bin/' WHEN page_id % 5 = 0 THEN 'Bin/' ELSE 'src/' END"


def _tree_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    i = F.col("page_id")
    top = F.when(i % 7 == 0, "node_modules/x/").when(i % 11 == 0, "src/bin/").when(i % 5 == 0, "Bin/").otherwise("src/")
    return p.select(F.concat(top, F.lit("p"), i.cast("string"), F.lit(".html")).alias("relative_path"))


@query(
    f"""WITH p AS (SELECT {IGNORED_ROOT} || 'p' || page_id || '.html' AS relative_path FROM pages)
SELECT relative_path FROM p WHERE NOT regexp_matches(relative_path, '(^|/)(\\.git|bin|obj|node_modules|build|dist|\\.vs|\\.idea)/')"""
)
def scan_filter_ignored(spark, sf_dir):
    return _tree_paths(spark, sf_dir).where(tree.pruned_prefix(F.col("relative_path")) == "")


@query(
    f"""WITH p AS (SELECT {IGNORED_ROOT} || 'p' || page_id || '.html' AS relative_path FROM pages),
d AS (SELECT DISTINCT regexp_extract(relative_path, '^((?:[^/]+/)*?(?:\\.git|bin|obj|node_modules|build|dist|\\.vs|\\.idea))/', 1) AS d FROM p), k AS (SELECT count(*) AS n FROM d WHERE d <> '')
SELECT CAST(n AS BIGINT) AS ignored, CAST(n + (SELECT count(*) FROM p WHERE NOT regexp_matches(relative_path, '(^|/)(\\.git|bin|obj|node_modules|build|dist|\\.vs|\\.idea)/')) AS BIGINT) AS discovered FROM k"""
)
def scan_counts(spark, sf_dir):
    p = _tree_paths(spark, sf_dir).withColumn("pruned", tree.pruned_prefix(F.col("relative_path")))
    dirs = F.countDistinct(F.when(F.col("pruned") != "", F.col("pruned")))
    files = F.sum((F.col("pruned") == "").cast("long"))
    return p.agg(dirs.alias("ignored"), (dirs + files).alias("discovered"))


@query(
    f"""WITH {FILES}, a AS (SELECT relative_path, '/repo/' || relative_path AS p FROM fls)
SELECT relative_path FROM a WHERE (lower(p) LIKE '/repo/documents/src1/%' OR lower(p) LIKE '/repo/pages/%') AND NOT lower(p) LIKE '/repo/documents/src1/de/%'"""
)
def include_exclude(spark, sf_dir):
    f = active_files(spark, sf_dir)
    return f.where(tree.is_under(F.col("absolute_path"), ["/repo/Documents/src1", "/repo/pages"]) & ~tree.is_under(F.col("absolute_path"), ["/repo/documents/src1/de"])).select("relative_path")


# ---- lines and text functions


@query(
    f"""WITH {DOCS}, {LINES} SELECT relative_path, CAST(line_no AS INTEGER) AS line_no, text,
CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY relative_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM lns"""
)
def explode_lines_offsets(spark, sf_dir):
    docs = corpus.documents_as_files(spark, sf_dir)
    return L.explode_lines(docs, ["relative_path"])


@query(
    f"""WITH {DOCS} SELECT doc_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS squeezed, trim(content, {SPACES}) AS trimmed, translate(lang, '{T.UPPER}', '{T.LOWER}') AS low,
CAST(length(content) - length(replace(content, 'e', '')) AS INTEGER) AS e_count FROM docs"""
)
def text_functions(spark, sf_dir):
    docs = corpus.documents_as_files(spark, sf_dir)
    c = F.col("content")
    return docs.select("doc_id", T.squeeze(c).alias("squeezed"), T.trim(c).alias("trimmed"), T.ascii_lower(F.col("lang")).alias("low"), T.count_of(c, "e").cast("int").alias("e_count"))


@query(f"WITH {DOCS}, {LINES}, {CODE} SELECT relative_path, CAST(line_no AS INTEGER) AS line_no, c AS code, string_split(text, '//')[1] AS before_slashes FROM code")
def strip_comment(spark, sf_dir):
    lines = L.explode_lines(corpus.documents_as_files(spark, sf_dir), ["relative_path"], offsets=False)
    return lines.select("relative_path", "line_no", T.trim(T.before_hash(F.col("text"))).alias("code"), T.before(F.col("text"), "//").alias("before_slashes"))


@query(
    f"""WITH {FILES} SELECT relative_path, lower(regexp_extract(string_split(relative_path, '/')[-1], '^.+(\\.[^.]*)$', 1)) AS extension,
regexp_extract(relative_path, '[^.:\\\\/]*$') AS tail, string_split(relative_path, '/')[-1] AS file_name, 'pkg' || '::' || string_split(relative_path, '/')[-1] AS joined FROM fls"""
)
def path_functions(spark, sf_dir):
    p = F.col("relative_path")
    f = corpus.files(spark, sf_dir)
    return f.select(p, T.extension(p).alias("extension"), T.tail_name(p).alias("tail"), T.file_name(p).alias("file_name"), T.join_qualified(F.lit("pkg"), T.file_name(p), "::").alias("joined"))


@query(
    """WITH t AS (SELECT event_id, props, string_split(props, ',') AS parts FROM events),
u AS (SELECT event_id, list_filter(list_transform(parts, lambda p: trim(p)), lambda p: p <> '') AS parts FROM t), e AS (SELECT event_id, unnest(range(0, len(parts))) AS position, unnest(parts) AS p FROM u)
SELECT event_id, CAST(position AS INTEGER) AS position, trim(string_split(p, '=')[1]) AS name, CASE WHEN strpos(p, '=') > 0 THEN trim(substr(p, strpos(p, '=') + 1)) ELSE '' END AS default_value FROM e"""
)
def params_split(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.inline(P.split_parameters(F.col("props"))))


# ---- dispatch and parsers

DISPATCH_NAMES = ("a.cs", "b.CSPROJ", "Dockerfile", "x.dockerfile", "pom.xml", "Cargo.toml", "q.rs", "package.json", "z.json", "n.h", "n.hpp", "m.m", "e.vue", "none", "f.unknown", ".bashrc", "Makefile", "k.mk", "t.tf", "r.Rmd")
DISPATCH_LANGUAGES = ("csharp", "msbuild", "dockerfile", "yaml", "maven", "cargo", "rust", "npm", "json", "objective-c", "cpp", "matlab-octave", "vue", None, None, None, "make", "make", "terraform", "rmarkdown")


@query(
    "WITH n AS (SELECT event_id, [" + ", ".join(f"'{n}'" for n in DISPATCH_NAMES) + "][1 + CAST(event_id % " + str(len(DISPATCH_NAMES)) + " AS INTEGER)] AS name, ["
    + ", ".join("NULL" if x is None else f"'{x}'" for x in DISPATCH_LANGUAGES) + "][1 + CAST(event_id % " + str(len(DISPATCH_NAMES)) + " AS INTEGER)] AS language FROM events) SELECT event_id, name, language FROM n"
)
def dispatch_language(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.element_at(F.array(*map(F.lit, DISPATCH_NAMES)), (1 + F.col("event_id") % len(DISPATCH_NAMES)).cast("int"))
    return e.select("event_id", name.alias("name")).withColumn("language", P.dispatch_language(F.concat(F.lit("src/"), "name")))


@query(f"WITH {SHELL} SELECT relative_path, CAST(line_no AS INTEGER) AS line_no, kind, name, signature FROM shell")
def parse_shell(spark, sf_dir):
    return shell_symbols(spark, sf_dir).select("relative_path", "line_no", "kind", "name", "signature")


@query(f"WITH {SHELL} SELECT relative_path, CAST(line_no AS INTEGER) AS line_no, kind, name, signature FROM shell")
def parse_shell_grammar(spark, sf_dir):
    """The same symbols by way of the general parser."""
    docs = corpus.documents_as_files(spark, sf_dir).select("relative_path", "content")
    symbols = P.explode_symbols(P.parse_files(docs, ["relative_path"]), ["relative_path"])
    return symbols.select("relative_path", F.col("line_start").alias("line_no"), "kind", "name", "signature")


HTML_SQL = f"""WITH {PAGES}, parts AS (SELECT relative_path, string_split(content, chr(10)) AS p FROM pgs),
lns AS (SELECT relative_path, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS text FROM parts),
t AS (SELECT relative_path, line_no, trim(text, {SPACES}) AS t FROM lns), g AS (SELECT *, regexp_extract(t, '^[^<]*<([^\\s>/!?][^\\s>/]*)', 1) AS tag FROM t),
a AS (SELECT *, regexp_extract(t, '^(?s:.*?)class=[^"'']*(?:"([^"]*)"|''([^'']*)'')', 1) || regexp_extract(t, '^(?s:.*?)class=[^"'']*(?:"([^"]*)"|''([^'']*)'')', 2) AS classes,
 regexp_extract(t, '^(?s:.*?)id=[^"'']*(?:"([^"]*)"|''([^'']*)'')', 1) || regexp_extract(t, '^(?s:.*?)id=[^"'']*(?:"([^"]*)"|''([^'']*)'')', 2) AS ids FROM g WHERE tag <> '')
SELECT relative_path, CAST(line_no AS INTEGER) AS line_no, 'html_id' AS kind, ids AS name, tag AS return_type FROM a WHERE ids <> ''
UNION ALL SELECT * FROM (SELECT relative_path, CAST(line_no AS INTEGER) AS line_no, 'html_class' AS kind, unnest(string_split_regex(trim(classes, {SPACES}), '\\s+')) AS name, tag AS return_type FROM a) WHERE name <> ''"""


@query(HTML_SQL)
def parse_html(spark, sf_dir):
    return P.html_lines(corpus.pages_as_files(spark, sf_dir), ["relative_path"])


@query(HTML_SQL)
def parse_html_grammar(spark, sf_dir):
    symbols = P.explode_symbols(P.parse_files(corpus.pages_as_files(spark, sf_dir), ["relative_path"]), ["relative_path"])
    return symbols.select("relative_path", F.col("line_start").alias("line_no"), "kind", "name", "return_type")


DOCKER_RULES = [("docker_" + k.lower(), rf"^{k}\s+(.+)", 1) for k in ("FROM", "RUN", "COPY", "ADD", "CMD", "ENTRYPOINT", "ARG", "ENV", "EXPOSE", "WORKDIR")]


@query(
    """WITH t AS (SELECT o_orderkey, ['FROM ', 'run  ', 'Env ', 'echo '][1 + CAST(o_orderkey % 4 AS INTEGER)] || o_orderpriority || ' ' AS line FROM orders)
SELECT o_orderkey, 1 AS line_no, 'docker_' || lower(regexp_extract(line, '(?i)^(FROM|RUN|ENV)\\s', 1)) AS kind, trim(regexp_extract(line, '(?i)^(?:FROM|RUN|ENV)\\s+(.+)', 1)) AS name FROM t WHERE regexp_matches(line, '(?i)^(FROM|RUN|ENV)\\s')"""
)
def parse_dockerfile(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    head = F.element_at(F.array(*map(F.lit, ("FROM ", "run  ", "Env ", "echo "))), (1 + F.col("o_orderkey") % 4).cast("int"))
    return P.pattern_lines(o.select("o_orderkey", F.concat(head, "o_orderpriority", F.lit(" ")).alias("content")), ["o_orderkey"], DOCKER_RULES, flags="(?i)")


R_RULES = [("r_package", r"\b(?:library|require)\s*\(\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)", 1), ("r_variable", r"^([A-Za-z_][A-Za-z0-9_]*)\s*(?:<-|=)", 1)]


@query(
    """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'library(' || regexp_replace(p_brand, '[^A-Za-z]', '', 'g') || ')' WHEN p_partkey % 3 = 1 THEN 'x' || p_size || ' <- 1' ELSE 'print(x)' END AS t FROM part)
SELECT p_partkey, 1 AS line_no, CASE WHEN t LIKE 'library(%' THEN 'r_package' ELSE 'r_variable' END AS kind, CASE WHEN t LIKE 'library(%' THEN regexp_extract(t, '\\(([A-Za-z]+)\\)', 1) ELSE regexp_extract(t, '^([a-z0-9]+)', 1) END AS name FROM t WHERE t <> 'print(x)'"""
)
def parse_r(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("library("), F.regexp_replace("p_brand", "[^A-Za-z]", ""), F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("x"), F.col("p_size").cast("string"), F.lit(" <- 1"))).otherwise("print(x)")
    return P.pattern_lines(p.select("p_partkey", text.alias("content")), ["p_partkey"], R_RULES)


@query(
    f"""WITH {DOCS}, {LINES}, m AS (SELECT *, CASE WHEN line_no % 5 = 1 THEN 's' || line_no END AS mark FROM lns)
SELECT relative_path, CAST(line_no AS INTEGER) AS line_no, last_value(mark IGNORE NULLS) OVER (PARTITION BY relative_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM m"""
)
def section_carry_forward(spark, sf_dir):
    lines = L.explode_lines(corpus.documents_as_files(spark, sf_dir), ["relative_path"], offsets=False)
    mark = F.when(F.col("line_no") % 5 == 1, F.concat(F.lit("s"), F.col("line_no").cast("string")))
    return L.carry_forward(lines, ["relative_path"], mark, "section").select("relative_path", "line_no", "section")


# ---- search


def search_sql(text: str, kind: str = "", limit: int = 20) -> str:
    cols = "kind, name, qualified_name, signature, relative_path AS file_path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end"
    only = f" AND kind = '{kind}'" if kind else ""
    symbols = f"SELECT 0 AS part, 'symbol' AS result_type, {cols}, kind AS k1, name AS k2 FROM sym WHERE {symbol_like(text)}{only}"
    files = f"SELECT 1 AS part, 'file' AS result_type, 'file' AS kind, relative_path AS name, '' AS qualified_name, '' AS signature, relative_path AS file_path, 0 AS line_start, 0 AS line_end, '' AS k1, '' AS k2 FROM fls2 WHERE {ascii_like('relative_path', text)} OR {ascii_like(chr(39) + '/repo/' + chr(39) + ' || relative_path', text)}"
    every = files if kind == "file" else symbols if kind else f"{symbols} UNION ALL {files}"
    return f"""WITH {SYM}, {PAGES}, fls2 AS (SELECT relative_path FROM docs UNION ALL SELECT relative_path FROM pgs), u AS ({every})
SELECT result_type, kind, name, qualified_name, signature, file_path, line_start, line_end FROM u ORDER BY part, k1, k2, file_path, line_start LIMIT {limit}"""


def search_query(name: str, text: str, kind: str = "", limit: int = 20) -> None:
    def run(spark, sf_dir):
        return S.search(sym(spark, sf_dir), active_files(spark, sf_dir), text, kind, limit)

    run.__name__ = name
    query(search_sql(text.lower(), kind, limit if limit > 0 else 20))(run)


search_query("search_symbols", "the")
search_query("search_kind", "TH", "method")
search_query("search_files", "src1/", "file", 50)
search_query("search_mixed_limit", "src1", "", 5000)
search_query("search_wildcard", "a_d%e")
search_query("search_default_limit", "on", "", 0)


# ---- context


def find_sql(names: list[str], partial: bool = False) -> str:
    parts = []
    for i, n in enumerate(names):
        exact = f"(name = '{n}' OR qualified_name = '{n}')"
        where = f"{exact} OR {symbol_like(n.lower())}" if partial else exact
        first = f"CASE WHEN {exact} THEN 0 ELSE 1 END" if partial else "0"
        parts.append(f"SELECT {i} AS request, '{n}' AS requested_symbol, {first} AS first, * FROM sym WHERE {where}")
    return "fnd AS (SELECT *, row_number() OVER (ORDER BY request, first, kind, qualified_name, relative_path, symbol_id) AS seq FROM (" + " UNION ALL ".join(parts) + "))"


FOUND = "seq, requested_symbol, symbol_id, kind, name, qualified_name, relative_path"


@query(f"WITH {SYM}, {find_sql(['The', 'en.src1.Of', 'The'])} SELECT {FOUND} FROM fnd")
def context_exact(spark, sf_dir):
    return C.find(sym(spark, sf_dir), ["The", "en.src1.Of", "The"]).select(*FOUND.split(", "))


@query(f"WITH {SYM}, {find_sql(['Ther', 'de_r'], True)} SELECT {FOUND} FROM fnd")
def context_partial_ranked(spark, sf_dir):
    return C.find(sym(spark, sf_dir), ["Ther", "de_r"], True).select(*FOUND.split(", "))


ASKED = ["The", "Of", "no such symbol"]


@query(
    f"""WITH {SYM}, {find_sql(ASKED)}, r AS (SELECT unnest([0, 1, 2]) AS request, unnest({ASKED}) AS requested_symbol)
SELECT r.requested_symbol, count(f.seq) AS matches, CASE WHEN count(f.seq) = 0 THEN 'Symbol not found: ' || r.requested_symbol WHEN count(f.seq) > 1 THEN 'Ambiguous symbol: ' || r.requested_symbol || ' matched ' || count(f.seq) || ' candidates' ELSE '' END AS warning
FROM r LEFT JOIN fnd f ON f.request = r.request GROUP BY r.request, r.requested_symbol"""
)
def context_ambiguity(spark, sf_dir):
    counts = C.ambiguity(C.find(sym(spark, sf_dir), ASKED), ASKED)
    n = F.col("matches")
    warning = F.when(n == 0, F.concat(F.lit("Symbol not found: "), "requested_symbol")).when(n > 1, F.concat(F.lit("Ambiguous symbol: "), "requested_symbol", F.lit(" matched "), n.cast("string"), F.lit(" candidates"))).otherwise("")
    return counts.withColumn("warning", warning)


BUDGET = 3000
SPENT = f"""cod AS (SELECT f.*, t.text || chr(10) AS code FROM fnd f JOIN lns t ON t.relative_path = f.relative_path AND t.line_no = f.line_start),
sz AS (SELECT *, octet_length(encode(code)) AS n, greatest(0, {BUDGET} - coalesce(sum(octet_length(encode(code))) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remaining FROM cod)"""


@query(
    f"""WITH {SYM}, {find_sql(['The', 'Of'])}, {SPENT} SELECT seq, symbol_id, CAST(least(n, remaining) AS BIGINT) AS taken, remaining = 0 OR n > remaining AS truncated,
CASE WHEN remaining = 0 THEN 'Snippet omitted by budget: ' || qualified_name WHEN n > remaining THEN 'Snippet truncated by budget: ' || qualified_name ELSE '' END AS warning FROM sz"""
)
def context_budget(spark, sf_dir):
    files = corpus.documents_as_files(spark, sf_dir).select("relative_path", "content")
    items = C.context(sym(spark, sf_dir), files, ["The", "Of"], budget=BUDGET)
    said = items.join(C.warnings(items), "seq", "left")
    return said.select("seq", "symbol_id", "taken", "truncated", F.coalesce("warning", F.lit("")).alias("warning"))


@query(f"WITH {SYM}, {find_sql(['And'])}, cod AS (SELECT f.seq, f.symbol_id, t.text || chr(10) AS code FROM fnd f JOIN lns t ON t.relative_path = f.relative_path AND t.line_no = f.line_start) SELECT * FROM cod")
def context_snippets(spark, sf_dir):
    files = corpus.documents_as_files(spark, sf_dir).select("relative_path", "content")
    items = C.with_code(C.find(sym(spark, sf_dir), ["And"]), files)
    return items.select("seq", "symbol_id", F.decode("code", "UTF-8").alias("code"))


EXPANDED = "regexp_matches(kind, 'method|function|constructor|property|attribute|field|class|struct|interface|trait|enum|type')"
TAIL = "regexp_extract(qualified_name, '[^.:\\\\/]*$')"
PLAIN = "'^[A-Za-z0-9_$]+$'"
LEVEL_ROOTS = ["Ananreat", "Aiantion"]


def level_sql(levels: int) -> str:
    """Each level: words of the codes so far meet names; names with other signs are matched as patterns."""
    sql = f"""WITH {SYM}, {find_sql(LEVEL_ROOTS)},
nms AS (SELECT symbol_id, name AS word FROM sym WHERE {EXPANDED} AND length(name) >= 3 AND regexp_matches(name, {PLAIN})
  UNION SELECT symbol_id, {TAIL} FROM sym WHERE {EXPANDED} AND length({TAIL}) >= 3 AND regexp_matches({TAIL}, {PLAIN})),
odd AS (SELECT symbol_id, name AS word FROM sym WHERE {EXPANDED} AND length(name) >= 3 AND NOT regexp_matches(name, {PLAIN})),
itm0 AS (SELECT seq, symbol_id, qualified_name, relative_path, line_start, 0 AS level, '' AS source_qualified_name FROM fnd)"""
    for n in range(levels):
        sql += f""",
cod{n} AS (SELECT i.seq, i.symbol_id, i.qualified_name, t.text || chr(10) AS code FROM itm{n} i JOIN lns t ON t.relative_path = i.relative_path AND t.line_no = i.line_start WHERE i.level = {n}),
wrd{n} AS (SELECT DISTINCT seq, symbol_id AS own, unnest(regexp_extract_all(code, '[A-Za-z0-9_$]+')) AS word FROM cod{n}),
hit{n} AS (SELECT w.seq, m.symbol_id FROM wrd{n} w JOIN nms m ON m.word = w.word WHERE w.own <> m.symbol_id
  UNION SELECT c.seq, o.symbol_id FROM cod{n} c JOIN odd o ON regexp_matches(c.code, '(^|[^A-Za-z0-9_$])' || replace(replace(o.word, '.', '\\.'), '-', '\\-') || '($|[^A-Za-z0-9_$])') WHERE c.symbol_id <> o.symbol_id),
fst{n} AS (SELECT symbol_id, min(seq) AS source_seq FROM hit{n} WHERE symbol_id NOT IN (SELECT symbol_id FROM itm{n}) GROUP BY symbol_id),
itm{n + 1} AS (SELECT * FROM itm{n} UNION ALL SELECT (SELECT max(seq) FROM itm{n}) + row_number() OVER (ORDER BY source_seq, length(s.name) DESC, s.qualified_name, s.relative_path, s.symbol_id), s.symbol_id, s.qualified_name, s.relative_path, s.line_start, {n + 1}, c.qualified_name
  FROM fst{n} f JOIN sym s ON s.symbol_id = f.symbol_id JOIN cod{n} c ON c.seq = f.source_seq)"""
    return sql + f" SELECT seq, symbol_id, CAST(level AS INTEGER) AS level, source_qualified_name FROM itm{levels}"


def levels(spark, sf_dir, level: int) -> DataFrame:
    files = corpus.documents_as_files(spark, sf_dir).select("relative_path", "content")
    # names are asked for at every level; signatures, most of the table, are not in the answer
    symbols = sym(spark, sf_dir).select("symbol_id", "kind", "name", "qualified_name", "relative_path", "line_start", "line_end")
    items = C.context(materialised(symbols).withColumn("signature", F.lit("")), files, LEVEL_ROOTS, budget=1 << 40, level=level)
    return items.select("seq", "symbol_id", "level", "source_qualified_name")


@query(level_sql(1))
def level_expand_1(spark, sf_dir):
    return levels(spark, sf_dir, 1)


@query(level_sql(2))
def level_expand_2(spark, sf_dir):
    return levels(spark, sf_dir, 2)


@query(
    f"""WITH {SYM}, x AS (SELECT *, 'the' AS s FROM sym) SELECT symbol_id, name FROM x WHERE name = 'The' OR qualified_name = 'The' OR signature = 'The' OR strpos(signature, 'The') > 0 OR strpos(qualified_name, 'The') > 0"""
)
def direct_context(spark, sf_dir):
    return sym(spark, sf_dir).where(C.matches_signature("The")).select("symbol_id", "name")


# ---- relations

CHILDREN = "chd AS (SELECT relative_path, line_no, name, kind, return_type, symbol_id, max(line_no) FILTER (WHERE line_no % 3 = 1) OVER (PARTITION BY relative_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM sym)"


def with_parents(spark, sf_dir):
    """sym with the nearest earlier symbol on a line 1 modulo 3 as parent."""
    w = W.partitionBy("relative_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    parent = F.max(F.when(F.col("line_no") % 3 == 1, F.col("line_no"))).over(w)
    return sym(spark, sf_dir).withColumn("parent", F.coalesce(parent, F.lit(-1)))


@query(
    f"""WITH {SYM}, {CHILDREN}, prs AS (SELECT c.relative_path, c.line_no AS child, c.name, p.line_no AS parent, p.name AS parent_name FROM chd c JOIN sym p ON p.relative_path = c.relative_path AND p.line_no = c.parent)
SELECT relative_path, CAST(parent AS INTEGER) AS source, CAST(child AS INTEGER) AS target, 'contains' AS relation_type, parent_name AS source_text, name AS target_text FROM prs
UNION ALL SELECT relative_path, CAST(child AS INTEGER), CAST(parent AS INTEGER), 'contained_by', name, parent_name FROM prs"""
)
def relations_contains(spark, sf_dir):
    return R.containment(with_parents(spark, sf_dir), "relative_path", "line_no", "parent")


TYPES = "('void', 'bool', 'byte', 'sbyte', 'char', 'decimal', 'double', 'float', 'int', 'uint', 'long', 'ulong', 'object', 'short', 'ushort', 'string', 'var')"
TYPE_RELATIONS = f"""rel AS (SELECT relative_path, line_no AS source, 'returns_type' AS relation_type, name AS source_text, return_type AS target_text, symbol_id FROM sym WHERE kind IN ('method', 'property') AND return_type <> '' AND return_type NOT IN {TYPES}
UNION ALL SELECT relative_path, line_no, 'accepts_parameter_type', name, return_type, symbol_id FROM sym WHERE kind IN ('method', 'constructor') AND return_type <> '' AND return_type NOT IN {TYPES}
UNION ALL SELECT relative_path, line_no, CASE WHEN kind = 'class' THEN 'inherits' ELSE 'implements' END, name, name || 'x', symbol_id FROM sym WHERE kind IN ('class', 'interface', 'struct')
UNION ALL SELECT relative_path, line_no, 'implements', name, return_type, symbol_id FROM sym WHERE kind IN ('class', 'interface', 'struct') AND return_type <> '' AND return_type NOT IN {TYPES})"""


def typed(spark, sf_dir):
    s = sym(spark, sf_dir)
    p = F.array(F.struct(F.col("return_type").alias("type")))
    bases = F.filter(F.array(F.concat("name", F.lit("x")), "return_type"), lambda b: b != "")
    return s.withColumns({"parameters": p, "base_types": bases})


@query(f"WITH {SYM}, {TYPE_RELATIONS} SELECT relative_path, CAST(source AS INTEGER) AS source, relation_type, source_text, target_text FROM rel")
def relations_types(spark, sf_dir):
    return R.type_relations(typed(spark, sf_dir), "relative_path", "line_no")


@query(
    f"""WITH {SYM}, {TYPE_RELATIONS}, k AS (SELECT symbol_id AS type_id, name AS tn, qualified_name AS tq, relative_path AS tp FROM sym WHERE kind IN ('class', 'interface', 'struct', 'enum')),
w AS (SELECT * FROM rel WHERE relation_type = 'returns_type'),
j AS (SELECT w.symbol_id, w.target_text, k.* FROM w JOIN k ON k.tn = w.target_text OR k.tq = w.target_text),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY tq, tp, type_id) AS rank FROM j)
SELECT symbol_id AS relation_id, target_text, type_id, tq AS type_qualified_name, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def related_types_top5(spark, sf_dir):
    s = sym(spark, sf_dir)
    wanted = s.where((F.col("kind") == "method") & T.relation_type_name(F.col("return_type"))).select(
        F.col("symbol_id").alias("relation_id"), F.lit("returns_type").alias("relation_type"), F.col("return_type").alias("target_text")
    )
    return R.related_types(wanted, s).select("relation_id", "target_text", "type_id", "type_qualified_name", "rank")


@query()
def related_types_all(spark, sf_dir):
    """The first types of every relation: returned, parameter and base types of all symbols, no line left out.

    Relations with equal texts have equal types, so the ranking is made once for each text.
    """
    s = typed(spark, sf_dir)
    every = R.type_relations(s, "relative_path", "line_no")
    texts = every.select(F.col("target_text").alias("relation_id"), F.lit(R.TYPE_RELATIONS[0]).alias("relation_type"), "target_text").distinct()
    ranked = R.related_types(texts, s).select("target_text", "type_id", "type_qualified_name", "rank")
    return every.join(ranked, "target_text").select("relative_path", "source", "relation_type", "source_text", "target_text", "type_id", "type_qualified_name", "rank")


# ---- change detection

V1 = "v1 AS (SELECT doc_id AS id, relative_path, md5(content) AS h, doc_id % 13 <> 0 AS is_active FROM docs WHERE doc_id % 10 <> 0)"
V2 = "v2 AS (SELECT relative_path, md5(CASE WHEN doc_id % 10 = 2 THEN content || chr(10) || 'x' ELSE content END) AS h FROM docs WHERE doc_id % 10 <> 1)"
STATUS = "CASE WHEN v2.relative_path IS NOT NULL AND NOT coalesce(is_active, false) THEN 'file_added' WHEN v2.relative_path IS NOT NULL AND v1.h <> v2.h THEN 'file_modified' WHEN v2.relative_path IS NOT NULL THEN 'unchanged' WHEN is_active THEN 'file_deleted' ELSE 'gone' END"
DIFF = f"{DOCS}, {V1}, {V2}, dif AS (SELECT coalesce(v1.relative_path, v2.relative_path) AS relative_path, {STATUS} AS status, v1.id AS file_id, coalesce(v1.h, '') AS old_hash, coalesce(v2.h, '') AS new_hash FROM v1 FULL JOIN v2 ON v1.relative_path = v2.relative_path)"


def versions(spark, sf_dir):
    docs = corpus.documents_as_files(spark, sf_dir)
    i = F.col("doc_id")
    stored = docs.where(i % 10 != 0).select(i.alias("id"), "relative_path", F.md5("content").alias("content_hash"), (i % 13 != 0).alias("is_active"))
    new = F.when(i % 10 == 2, F.concat("content", F.lit("\nx"))).otherwise(F.col("content"))
    return docs.where(i % 10 != 1).select("relative_path", F.md5(new).alias("content_hash")), stored


@query(f"WITH {DIFF} SELECT * FROM dif")
def diff_classify(spark, sf_dir):
    return D.classify(*versions(spark, sf_dir))


@query(f"WITH {DIFF} SELECT CAST(sum((status = 'file_added')::INT) AS BIGINT) AS added, CAST(sum((status = 'file_modified')::INT) AS BIGINT) AS modified, CAST(sum((status = 'file_deleted')::INT) AS BIGINT) AS deleted, CAST(sum((status = 'unchanged')::INT) AS BIGINT) AS unchanged FROM dif")
def diff_summary(spark, sf_dir):
    return D.summary(D.classify(*versions(spark, sf_dir)))


@query(
    f"""WITH {DIFF} SELECT 'file' AS entity_type, status AS change_type, CASE WHEN status <> 'file_added' THEN old_hash ELSE '' END AS old_hash, CASE WHEN status <> 'file_deleted' THEN new_hash ELSE '' END AS new_hash,
CASE WHEN status <> 'file_added' THEN relative_path ELSE '' END AS old_path, CASE WHEN status <> 'file_deleted' THEN relative_path ELSE '' END AS new_path FROM dif WHERE status IN ('file_added', 'file_modified', 'file_deleted')"""
)
def change_log(spark, sf_dir):
    return D.changes(D.classify(*versions(spark, sf_dir)))


@query(f"WITH {DIFF} SELECT * FROM dif WHERE new_hash <> ''")
def update_files_open(spark, sf_dir):
    return D.classify(*versions(spark, sf_dir), closed=False)


@query(f"WITH {DIFF} SELECT v1.relative_path, CASE WHEN d.status = 'file_deleted' THEN false ELSE v1.is_active OR d.status = 'file_added' END AS is_active FROM v1 JOIN dif d ON d.relative_path = v1.relative_path")
def soft_delete(spark, sf_dir):
    scanned, stored = versions(spark, sf_dir)
    diff = D.classify(scanned, stored).select("relative_path", "status")
    now = F.when(F.col("status") == D.DELETED, False).otherwise(F.col("is_active") | (F.col("status") == D.ADDED))
    return stored.join(diff, "relative_path").select("relative_path", now.alias("is_active"))


@query(
    f"""WITH {DIFF}, {LINES}, o AS (SELECT relative_path, count(*) AS old FROM lns WHERE relative_path IN (SELECT relative_path FROM dif WHERE status IN ('file_modified', 'file_added')) GROUP BY 1),
n AS (SELECT relative_path, old + CASE WHEN relative_path IN (SELECT relative_path FROM dif WHERE status = 'file_modified') THEN 1 ELSE -1 END AS new FROM o)
SELECT CAST(sum(new) AS BIGINT) AS added, CAST(sum(least(old, new)) AS BIGINT) AS updated, CAST(sum(greatest(0, old - new)) AS BIGINT) AS deleted FROM o JOIN n USING (relative_path)"""
)
def update_replace(spark, sf_dir):
    """Lines stand for symbols: modified files gain one, files added again lose one."""
    scanned, stored = versions(spark, sf_dir)
    diff = D.classify(scanned, stored).where(F.col("status").isin(D.MODIFIED, D.ADDED)).select("relative_path", "status")
    lines = L.explode_lines(corpus.documents_as_files(spark, sf_dir), ["relative_path"], offsets=False).join(diff, "relative_path")
    last = F.max("line_no").over(W.partitionBy("relative_path"))
    marked = lines.withColumn("last", F.col("line_no") == last)
    copies = F.when(F.col("last") & (F.col("status") == D.MODIFIED), 2).when(F.col("last"), 0).otherwise(1)
    new = marked.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return D.symbol_counts(lines, new, "relative_path")


# ---- index tables

COUNTS = f"""WITH {SYM}, {PAGES} SELECT 'files' AS table_name, CAST((SELECT count(*) FROM docs) + (SELECT count(*) FROM pgs) AS BIGINT) AS n
UNION ALL SELECT 'symbols', count(*) FROM sym UNION ALL SELECT 'symbol_relations', 0 UNION ALL SELECT 'changes', 0"""


@query(COUNTS)
def diagnostics_counts(spark, sf_dir):
    """Row counts of a lite index: relations and changes are empty."""
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
    none = spark.range(0)
    out = count("files", active_files(spark, sf_dir))
    for name, df in (("symbols", sym(spark, sf_dir)), ("symbol_relations", none), ("changes", none)):
        out = out.unionByName(count(name, df))
    return out


@query(f"WITH {SYM} SELECT count(*) AS active_symbols FROM sym WHERE doc_id % 13 <> 0")
def active_symbol_count(spark, sf_dir):
    docs = corpus.documents_as_files(spark, sf_dir)
    files = docs.select(F.col("doc_id").alias("id"), "relative_path", F.lit("").alias("absolute_path"), (F.col("doc_id") % 13 != 0).alias("is_active"))
    symbols = sym(spark, sf_dir).drop("relative_path").withColumns({"file_id": F.col("doc_id"), "is_active": F.lit(True)})
    return S.active(symbols, files).agg(F.count(F.lit(1)).alias("active_symbols"))


@query(f"WITH {FILES} SELECT relative_path FROM fls ORDER BY relative_path")
def file_tree(spark, sf_dir):
    return active_files(spark, sf_dir).select("relative_path").orderBy("relative_path")


@query("SELECT o_orderkey AS id, o_orderpriority AS repo_root FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def latest_repository(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("repo_root")).orderBy(F.desc("id")).limit(1)


@query(f"WITH {SYM}, e AS (SELECT *, CASE WHEN symbol_id % 3 = 0 THEN 'd' ELSE '' END AS d FROM sym) SELECT symbol_id, qualified_name FROM e WHERE d = ''")
def enrichment_pending(spark, sf_dir):
    s = sym(spark, sf_dir).withColumns({"ai_description": F.when(F.col("symbol_id") % 3 == 0, "d"), "ai_enriched_at": F.when(F.col("symbol_id") % 3 == 0, F.lit("2024-01-01"))})
    return enrich.pending(s).select("symbol_id", "qualified_name")


@query(f"WITH {SYM} SELECT symbol_id, CASE WHEN symbol_id % 3 = 1 THEN 'about ' || name ELSE '' END AS description, CASE WHEN symbol_id % 3 = 1 THEN kind || ',code' ELSE '' END AS tags FROM sym")
def enrichment_apply(spark, sf_dir):
    s = sym(spark, sf_dir).withColumns({c: F.lit("") for c in ("description", "tags", "ai_description", "ai_tags", "ai_model")}).withColumn("ai_enriched_at", F.lit(None).cast("timestamp"))
    results = s.where(F.col("symbol_id") % 3 == 1).select("symbol_id", F.concat(F.lit("about "), "name").alias("description"), F.concat("kind", F.lit(",code")).alias("tags"), F.lit("m").alias("model"))
    return enrich.apply(s, results, "symbol_id").select("symbol_id", "description", "tags")


# ---- grammars without a table of their own: hand-written sources, one file each

FIXTURES, EXPECTED = Path(__file__).with_name("fixtures.txt"), Path(__file__).with_name("expected.txt")


def _parts(path: Path) -> dict[str, str]:
    """Texts by file name; each stands under a line `=== name`."""
    return {p.partition("\n")[0]: p.partition("\n")[2] for p in path.read_text(encoding="utf-8").split("=== ")[1:]}


@query()
def parse_all_grammars(spark, sf_dir):
    """Symbols of a small source in every supported language."""
    files = spark.createDataFrame(list(_parts(FIXTURES).items()), "relative_path string, content string")
    return P.explode_symbols(P.parse_files(files, ["relative_path"]), ["relative_path"])


def grammar_query(path: str, source: str, expected: str) -> tuple[Query, str]:
    """A query that parses a copy of one source for each nation, and the SQL of the rows that were derived for it by hand."""

    def run(spark, sf_dir):
        nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
        files = nations.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(f"/{path}")).alias("relative_path"), F.lit(source).alias("content"))
        return P.explode_symbols(P.parse_files(files, ["relative_path"]), ["relative_path"]).select("relative_path", "kind", "name", "qualified_name", "line_start", "line_end")

    rows = [re.fullmatch(r"(\S+) (.*) \[(.*)\] (\d+)-(\d+)", r).groups() for r in expected.splitlines()]
    text = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({text(kind)}, {text(name)}, {text(qualified)}, {first}, {last})" for kind, name, qualified, first, last in rows)
    if not rows:
        values = "('', '', '', 0, 0)"
    sql = f"""SELECT n_nationkey || {text("/" + path)} AS relative_path, kind, name, qualified_name, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end
FROM nation CROSS JOIN (VALUES {values}) AS v(kind, name, qualified_name, line_start, line_end) WHERE kind <> ''"""
    return run, sql


for _path, _rows in _parts(EXPECTED).items():
    _name = "grammar_" + re.sub(r"\W+", "_", _path).lower()
    QUERIES[_name], ORACLES[_name] = grammar_query(_path, _parts(FIXTURES)[_path], _rows)
