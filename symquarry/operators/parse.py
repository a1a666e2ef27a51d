"""Files to symbols: dispatch by name, the Arrow path for all languages, native paths for line-wise ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import SYMBOL
from . import languages
from .lines import explode_lines

PARSED = f"language string, symbols array<{SYMBOL}>"
FIELDS = ("kind", "name", "qualified_name", "signature", "return_type", "visibility", "modifiers", "line_start", "line_end", "char_start", "char_end", "char_count")


def dispatch_language(path: Column) -> Column:
    """Language by whole name, then by extension; null if nobody reads the file. JVM-side map lookups."""

    def lookup(table: dict, key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, g in sorted(table.items()) for x in (k, g.language)]), key)

    by_extension = lookup(languages.BY_EXTENSION, T.extension(path))
    by_name = lookup(languages.BY_NAME, T.ascii_lower(T.file_name(path)))
    return F.coalesce(by_name, by_extension, F.when(T.extension(path) == languages.VUE_EXTENSION, "vue"))


def parse_files(files: DataFrame, keys: list[str], path: str = "relative_path", content: str = "content") -> DataFrame:
    """keys, language, symbols, failed: one row for each file that some grammar reads.

    Files without a grammar never reach Python. A file whose parser raises keeps its row, with failed set.
    """
    from pyspark.sql.types import BooleanType, StructField, StructType, _parse_datatype_string

    readable = files.where(dispatch_language(F.col(path)).isNotNull())
    chosen = readable.select(*keys, F.col(path).alias("__path"), F.col(content).cast("binary").alias("__content"))
    key_fields = [chosen.schema[k] for k in keys]
    schema = StructType([*key_fields, *_parse_datatype_string(PARSED).fields, StructField("failed", BooleanType())])
    n = len(keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["symbols"].dataType)
        for b in batches:
            named, found, failed = [], [], []
            for p, c in zip(b.column(n).to_pylist(), b.column(n + 1)):
                try:
                    language, symbols = languages.parse(p, c.as_py() or b"")
                    named.append(language)
                    found.append(symbols)
                    failed.append(False)
                except Exception:  # noqa: BLE001  one file's parser must not end the job; the row says so
                    named.append(languages.language_of(p))
                    found.append(None)
                    failed.append(True)
            arrays = [*(b.column(i) for i in range(n)), pa.array(named, pa.string()), pa.array(found, kind), pa.array(failed)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return chosen.mapInArrow(run, schema)


def explode_symbols(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, language, ordinal and the fields of each symbol; parent_index refers to ordinal."""
    rows = parsed.where(~F.col("failed")).select(*keys, "language", F.posexplode("symbols").alias("ordinal", "s"))
    return rows.select(*keys, "language", "ordinal", "s.*")


def explode_parameters(symbols: DataFrame, keys: list[str]) -> DataFrame:
    return symbols.select(*keys, "ordinal", F.explode("parameters").alias("p")).select(*keys, "ordinal", "p.*")


def _line_rows(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    return explode_lines(files, keys, content, offsets=False)


def shell_lines(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Shell symbols of line-wise rules as Column expressions: nothing leaves the JVM."""
    words = list(languages.SHELL_WORDS)
    lines = _line_rows(files, keys, content)
    # generators stand between the steps, so that filters are not pushed below them and nothing is matched twice
    code = F.filter(F.array(T.trim(T.before_hash(F.col("text")))), lambda c: c != "")
    coded = lines.select(*keys, "line_no", "text", F.explode(code).alias("code"))
    take = lambda pattern, group=1: F.regexp_extract("code", pattern, group)
    identifier = languages.ID
    rules = [
        ("shell_function", rf"^(?:function\s+)?({identifier})\s*(?:\(\))?\s*\{{"),
        ("shell_export", rf"^export\s+({identifier})=?"),
        ("shell_alias", r"^alias\s+([A-Za-z_][A-Za-z0-9_\-]*)="),
        ("shell_source", r"^(?:source|\.)\s+(.+)"),
        ("shell_command", r"^([A-Za-z_](?:[A-Za-z0-9_.\-]*[A-Za-z0-9_])?)"),  # without \b, which knows Unicode letters here
    ]
    found = F.coalesce(*[F.when(F.col("code").rlike(p), F.struct(F.lit(k).alias("kind"), T.trim(take(p)).alias("name"))) for k, p in rules])
    kept = F.filter(F.array(found), lambda s: s.isNotNull() & ((s["kind"] != "shell_command") | ~s["name"].isin(words)))
    rows = coded.select(*keys, "line_no", "text", "code", F.explode(kept).alias("s"))
    return rows.select(*keys, "line_no", "s.kind", "s.name", T.squeeze(F.col("code")).alias("signature"), "text")


def attribute(c: Column, name: str) -> Column:
    """Value of the first attribute whose name ends so; '' if there is none or its quote never closes."""
    m = rf"""^(?s:.*?){name}=[^"']*(?:"([^"]*)"|'([^']*)')"""
    return F.concat(F.regexp_extract(c, m, 1), F.regexp_extract(c, m, 2))


def first_tag(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^<]*<(?![/!?])([^\s>/]+)", 1)


def html_lines(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Ids and classes of the first tag of each line."""
    lines = _line_rows(files, keys, content)
    rows = lines.withColumn("t", T.trim(F.col("text"))).withColumn("tag", first_tag(F.col("t"))).where("tag <> ''")
    identity = F.filter(F.array(F.struct(F.lit("html_id").alias("kind"), attribute(F.col("t"), "id").alias("name"))), lambda s: s["name"] != "")
    classes = F.filter(F.split(T.squeeze(attribute(F.col("t"), "class")), " "), lambda w: w != "")
    marked = F.transform(classes, lambda w: F.struct(F.lit("html_class").alias("kind"), w.alias("name")))
    return rows.select(*keys, "line_no", F.explode(F.concat(identity, marked)).alias("s"), F.col("tag").alias("return_type")).select(*keys, "line_no", "s.kind", "s.name", "return_type")


def pattern_lines(files: DataFrame, keys: list[str], rules: list[tuple[str, str, int]], content: str = "content", flags: str = "") -> DataFrame:
    """First matching (kind, pattern, group) of each trimmed line: the native path of any stateless grammar."""
    lines = _line_rows(files, keys, content).withColumn("t", T.trim(F.col("text")))
    found = F.coalesce(
        *[F.when(F.col("t").rlike(flags + p), F.struct(F.lit(k).alias("kind"), T.trim(F.regexp_extract("t", flags + p, g)).alias("name"))) for k, p, g in rules]
    )
    return lines.withColumn("s", found).where(F.col("s").isNotNull() & (F.col("s.name") != "")).select(*keys, "line_no", "s.kind", "s.name")


def split_parameters(c: Column) -> Column:
    """(position, name, default_value) of a comma-separated list; every comma divides."""
    parts = F.filter(F.transform(F.split(c, ","), T.trim), lambda p: p != "")
    return F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("position"),
            T.trim(F.substring_index(p, "=", 1)).alias("name"),
            F.when(F.instr(p, "=") > 0, T.trim(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("default_value"),
        ),
    )
