"""Source trees as rows: scan, language, notebooks, and state of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Extensions that are read, and folders that are not.
LANGUAGES = {"py": "python", "sql": "sql", "yaml": "yaml", "yml": "yaml", "js": "javascript", "ts": "typescript", "ipynb": "notebook"}
IGNORED = (".git", "__pycache__", ".venv", "venv", "node_modules", ".cartography", ".lodestone", "dist", "build")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language that the extension tells, else unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[extension(path)], F.lit("unknown"))


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Files of no bytes under root, which Spark's readers pass over; a package may well start with one."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def scan(spark: SparkSession, root: str, include: DataFrame | None = None) -> DataFrame:
    """path (from root), ext, language, text, size, mtime of the supported files under root.

    include: (path); only those. Bytes that are not UTF-8 are replaced.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    none = spark.createDataFrame([(p,) for p in empty_files(spark, root)], "path string")
    raw = raw.unionByName(none.withColumns({"length": F.lit(0).cast("long"), "content": F.lit(b"")}), allowMissingColumns=True)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 2, F.lit(10_000))
    files = raw.withColumn("path", path).where(extension(F.col("path")).isin(*LANGUAGES) & ~ignored(F.col("path")))
    if include is not None:
        files = files.join(include.select("path"), "path", "left_semi")
    return files.select("path", extension(F.col("path")).alias("ext"), language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def notebook_code(text: Column) -> Column:
    """The sources of a notebook's code cells, one after the other."""
    cells = F.from_json(text, "cells array<struct<cell_type string, source array<string>>>")["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    return F.array_join(F.transform(code, lambda c: F.array_join(c["source"], "")), "\n")


#: What a notebook's text is searched for, and what each says.
NOTEBOOK_TOKENS = (("read_csv", "CONSUMES"), ("read_parquet", "CONSUMES"), ("read_sql", "CONSUMES"), ("to_csv", "PRODUCES"), ("to_parquet", "PRODUCES"), ("to_sql", "PRODUCES"))


def notebook_io(files: DataFrame) -> DataFrame:
    """(path, class, token, flow, line, unresolved): the first place of each reading or writing token; the name is never known.

    class says what the notebook does, by all of its tokens.
    """
    code = files.where("ext = 'ipynb'").select("path", notebook_code(F.col("text")).alias("code"))
    tokens = [F.struct(F.lit(t).alias("token"), F.lit(f).alias("flow"), F.instr("code", t).alias("at")) for t, f in NOTEBOOK_TOKENS]
    found = code.select("path", "code", F.filter(F.array(*tokens), lambda x: x["at"] > 0).alias("found"))
    has = lambda flow: F.exists("found", lambda x: x["flow"] == flow)
    found = found.select("path", "code", T.notebook_class(has("CONSUMES"), has("PRODUCES")).alias("class"), F.inline("found"))
    line = F.length(F.regexp_replace(F.substring("code", F.lit(1), F.col("at")), "[^\n]", "")) + 1
    return found.select("path", "class", "token", "flow", line.cast("int").alias("line"), F.lit(True).alias("unresolved"))


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed since `before` (path, digest), by content."""
    now = files.select("path", F.sha2("text", 256).alias("digest"))
    both = now.alias("n").join(before.alias("b"), "path", "full")
    kind = F.when(F.col("b.digest").isNull(), "added").when(F.col("n.digest").isNull(), "removed").when(F.col("n.digest") != F.col("b.digest"), "modified")
    return both.select("path", kind.alias("change")).where("change is not null")


def either(*sets: DataFrame) -> DataFrame:
    """The distinct paths of several sets of files."""
    out = sets[0].select("path")
    for x in sets[1:]:
        out = out.union(x.select("path"))
    return out.distinct()


def module_path(dotted: Column) -> Column:
    return F.replace(dotted, F.lit("."), F.lit("/"))


def resolve_relative(importer: Column, name: Column) -> Column:
    """The dotted name that a relative import means: each dot after the first climbs a folder; '' beyond the root."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.regexp_replace(name, r"^\.+", "")
    folders = F.slice(F.split(importer, "/"), 1, F.greatest(F.size(F.split(importer, "/")) - 1, F.lit(0)))
    base = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0)))
    parts = F.concat(base, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest)))
    return F.when(dots == 0, name).when(dots - 1 > F.size(folders), F.lit("")).otherwise(F.array_join(parts, "."))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, name, target): imports(importer, name) resolved to files, the longest dotted prefix first.

    For a prefix, <p>.py comes before <p>/__init__.py, and both before the same under src/. Each full name is resolved
    once, by one equi-join of its candidates, whatever the number of files that import it; rank decides. imports is
    read twice.
    """
    parts = F.split("full", r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    forms = F.flatten(F.transform(prefixes, lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    candidates = F.concat(forms, F.transform(forms, lambda f: F.concat(F.lit("src/"), f)))
    full = imports.withColumn("full", resolve_relative(F.col("importer"), F.col("name"))).where("full <> ''")
    tried = full.select("full").distinct().select("full", F.posexplode(candidates).alias("rank", "target"))
    hit = tried.join(files.select(F.col("path").alias("target")).distinct(), "target")
    first = hit.groupBy("full").agg(F.min_by("target", "rank").alias("target"))
    return full.join(first, "full").select("importer", "name", "target").distinct()
