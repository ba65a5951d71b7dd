"""Column functions over texts, paths and labels. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a module.
STOP_WORDS = ("the", "this", "that", "with", "from", "into", "using", "module", "file", "function", "class", "and", "for", "data")
#: Markers of paths.
EXCLUDED_FOLDERS = ("tests", "migrations", "alembic", "fixtures")
SUPPORT = ("utils", "helpers", "__init__.py")
STRONG_EXECUTION = ("cli", "main.py", "pipeline", "orchestr", "job", "worker", "runner", "invoke", "entrypoint")
SOME_EXECUTION = ("plugin", "dagster", "airflow", "executor")
ABSTRACTIONS = ("base.py", "types.py", "constants.py")
LOGIC_EXTENSIONS = ("py", "sql", "scala", "java", "js", "ts", "ipynb")
OPERATIONAL_PREFIXES = ("install ", "load ", "checkpoint", "vacuum", "analyze", "pragma ", "set ", "use ", "show ", "describe ", "explain ", "call ", "begin", "commit", "rollback")
GENERIC_LABELS = ("test", "tests", "job", "jobs", "run", "tmp", "temp", "embed_tokens", "token", "tokens")


#: Ends of lines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def any_of(text: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def how_many(text: Column, markers) -> Column:
    """How many of the markers a text has (each counts once)."""
    out = F.lit(0)
    for m in markers:
        out = out + F.contains(text, F.lit(m)).cast("int")
    return out


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lines(text: Column) -> Column:
    """The lines of a text (null: none), at any of the usual ends; the last one is none if it is empty."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def loc(text: Column) -> Column:
    return F.size(lines(text))


def comment_ratio(text: Column) -> Column:
    """The share of lines that start with #, // or --."""
    marked = F.size(F.filter(lines(text), lambda x: F.rlike(x, F.lit(r"^\s*(#|//|--)"))))
    return F.when(loc(text) > 0, marked / loc(text)).otherwise(F.lit(0.0))


def keywords(text: Column) -> Column:
    """Distinct words of three letters or more in lower case, sorted, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_]+"), F.lit(0)))
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*map(F.lit, STOP_WORDS))))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs in a text, without overlaps; 0 for an empty part."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.nullif(F.length(part), F.lit(0))
    return F.coalesce(n, F.lit(0.0)).cast("long")


def docstring(text: Column) -> Column:
    """The text between the triple quotes that a module starts with, else ''."""
    return F.trim(F.regexp_extract(F.trim(text), "(?s)^(\"\"\"|''')(.*?)\\1", 2))


def drift(doc: Column, purpose: Column) -> Column:
    """Struct (contradictions, imbalance, overlap, drift, severity) of a docstring against a purpose statement."""
    d, p = keywords(doc), keywords(purpose)
    has = lambda x, *w: F.arrays_overlap(x, F.array(*map(F.lit, w)))
    read, write = ("read", "reader", "ingest"), ("write", "writer", "export")
    n = (has(d, "api", "http") & has(p, "sql", "table", "pipeline")).cast("int") + (has(d, *read) & has(p, *write)).cast("int") + (has(d, *write) & has(p, *read)).cast("int")
    gap, overlap = F.abs(F.size(d) - F.size(p)), F.size(F.array_intersect(d, p))
    found = (F.trim(F.coalesce(doc, F.lit(""))) != "") & ((n > 0) | ((gap >= 4) & (overlap <= 1)))
    severity = F.when(~found, "none").when(n >= 2, "high").when((n > 0) | (gap >= 6), "medium").otherwise("low")
    return F.struct(n.alias("contradictions"), gap.alias("imbalance"), overlap.alias("overlap"), found.alias("drift"), severity.alias("severity"))


def purpose(text: Column, language: Column, public: Column) -> Column:
    """A sentence on what a module does, from words in its text and the number of its public functions."""
    low = F.lower(text)
    signals = F.array(
        F.when(F.contains(low, F.lit("sql")), "SQL transformation or query logic"),
        F.when(any_of(low, ("airflow", "dag")), "pipeline orchestration"),
        F.when(any_of(low, ("pandas", "spark")), "data processing"),
        F.when(public > 0, F.concat(public.cast("string"), F.lit(" public entry points"))),
    )
    said = F.array_compact(signals)
    said = F.when(F.size(said) == 0, F.array(F.lit("general application or utility logic"))).otherwise(said)
    return F.concat(F.lit("This module primarily handles "), F.array_join(said, ", "), F.lit(". It appears in the "), language, F.lit(" layer and exposes key behaviors through code-defined interfaces."))


def is_deprecated(text: Column) -> Column:
    low = F.lower(text)
    return any_of(low, ("deprecated", "do not import")) & F.contains(low, F.lit("raise importerror"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def is_excluded(path: Column) -> Column:
    low = F.lower(F.trim(path))
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, EXCLUDED_FOLDERS))) | F.startswith(file_name(low), F.lit("test_"))


def is_support(path: Column) -> Column:
    return any_of(F.lower(path), SUPPORT)


def is_abstraction(path: Column) -> Column:
    return file_name(F.lower(path)).isin(*ABSTRACTIONS)


def is_logic(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*LOGIC_EXTENSIONS)


def execution_priority(path: Column) -> Column:
    low = F.lower(path)
    return F.when(any_of(low, STRONG_EXECUTION), 2).when(any_of(low, SOME_EXECUTION), 1).otherwise(0)


def is_noise(label: Column) -> Column:
    low = F.lower(F.trim(label))
    out = (low == "") | F.contains(low, F.lit("<dynamic>")) | F.contains(low, F.lit("dynamic reference, cannot resolve"))
    for p in OPERATIONAL_PREFIXES:
        out = out | F.startswith(low, F.lit(p))
    return out


def is_weak_label(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return (F.length(low) <= 3) | low.isin(*GENERIC_LABELS) | F.startswith(low, F.lit("test_")) | F.startswith(low, F.lit("tmp_"))


def clean_label(label: Column, most: int = 180) -> Column:
    """A label without type prefix, quotes and runs of white space; null if it is noise, empty or too long."""
    bare = F.regexp_replace(F.regexp_replace(label, r"^(dataset|transform|config|pipeline)::", ""), "[`\"']", "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(~is_noise(bare) & (F.length(bare) <= most), bare)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def sql_class(statement: Column, is_write: Column) -> Column:
    low = F.lower(statement)
    out = F.when(F.contains(low, F.lit("merge ")), "sql_merge_upsert").when(F.contains(low, F.lit("insert ")), "sql_insert").when(F.contains(low, F.lit("update ")), "sql_update")
    out = out.when(F.contains(low, F.lit("delete ")), "sql_delete").when(F.rlike(low, F.lit(r"create .*\bas select")), "sql_ctas")
    return out.when(is_write, "sql_write").otherwise("sql_model_select")


def python_class(reads_sql: Column, reads_file: Column, writes_table: Column, writes_file: Column) -> Column:
    """What a Python file does with data, from what it reads and writes."""
    reads, writes = reads_sql | reads_file, writes_table | writes_file
    return (
        F.when(reads_sql & writes_table, "python_sql_etl").when(reads_file & writes_file, "python_file_transform").when(reads_file & writes_table, "python_ingestion")
        .when(reads_sql & writes_file, "python_export").when(reads & writes, "python_etl").when(writes_table, "python_table_write").when(writes_file, "python_file_write")
        .when(reads_sql, "python_sql_read").when(reads_file, "python_file_read").otherwise("python_other")
    )


def notebook_class(reads: Column, writes: Column) -> Column:
    return F.when(reads & writes, "notebook_etl").when(reads, "notebook_ingestion").when(writes, "notebook_export").otherwise("notebook_analysis")


#: What a path in a text ends in.
PATH_ENDS = "py|sql|ya?ml|js|ts|ipynb|json|md"


def paths_in(text: Column) -> Column:
    """The distinct paths of files that a text names, in its order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([\w./-]+\.(?:{PATH_ENDS}))\b"), F.lit(1)))


def ordered_union(*lists: Column) -> Column:
    """The values of several lists one after the other, each where it comes first."""
    return F.array_distinct(F.concat(*lists))


def line_range(start: Column, end: Column) -> Column:
    """A range of lines: what is missing or negative is 0, an end before the start is the start."""
    a, b = (F.greatest(F.lit(0), F.coalesce(x.cast("int"), F.lit(0))) for x in (start, end))
    return F.struct(a.alias("start"), F.greatest(a, b).alias("end"))
