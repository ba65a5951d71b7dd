"""Facts from YAML, JavaScript and TypeScript: keys, configured dependencies, imports, functions, classes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import table_function


def _documents(text: str, read: str) -> Iterator:
    """What yaml's compose_all or safe_load_all gives, up to the first error. libyaml reads where it is there; a text that it refuses is read again without it."""
    import yaml

    if hasattr(yaml, "CSafeLoader"):
        try:
            return iter([*getattr(yaml, read)(text, yaml.CSafeLoader)])
        except yaml.YAMLError:
            pass
    return getattr(yaml, read)(text, yaml.SafeLoader)


def yaml_keys(text: str) -> tuple[list[str], list[str], int]:
    """Every mapping key (sorted), the paths of keys ([] for items), and 1 + the number of pairs."""
    import yaml

    keys, paths, pairs = set(), set(), 0

    def walk(node, at: str) -> None:
        nonlocal pairs
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                name = str(getattr(k, "value", k))
                pairs += 1
                keys.add(name)
                paths.add(path := f"{at}.{name}" if at else name)
                walk(v, path)
        elif isinstance(node, yaml.SequenceNode):
            for v in node.value:
                walk(v, at + "[]")

    try:
        for doc in _documents(text, "compose_all"):
            walk(doc, "")
    except yaml.YAMLError:
        pass
    return sorted(keys), sorted(paths), 1 + pairs


def yaml_dependencies(text: str) -> list[dict]:
    """Edges of models[].depends_on (a list, a name, or nodes) and tasks[].downstream, with the line that names both."""
    import yaml

    try:
        docs = [d for d in _documents(text, "load_all") if isinstance(d, dict)]
    except yaml.YAMLError:
        return []
    lines, out = text.splitlines(), []

    def names(x) -> list[str]:
        x = x.get("nodes") if isinstance(x, dict) else x
        return [str(v) for v in x] if isinstance(x, list) else [str(x)] if x else []

    def line(*anchors: str) -> int:
        for test in (all, any):
            for k, text_line in enumerate(lines, 1):
                if test(a in text_line for a in anchors):
                    return k
        return 1

    def add(a: str, b: str, how: str) -> None:
        out.append({"source": a, "target": b, "method": how, "start": line(a, b), "end": line(a, b)})

    for d in docs:
        for m in d.get("models") or []:
            if isinstance(m, dict) and m.get("name"):
                for dep in names(m.get("depends_on")):
                    add(dep, str(m["name"]), "dbt_schema_dependency")
        for t in d.get("tasks") or []:
            me = t.get("name") or t.get("id") or t.get("task_id") if isinstance(t, dict) else None
            if me:
                for down in names(t.get("downstream")):
                    add(str(me), down, "yaml_task_dependency")
    return out


def yaml_structure(files: DataFrame) -> DataFrame:
    def one(text: str) -> list[dict]:
        keys, paths, n = yaml_keys(text)
        return [{"public_functions": keys, "key_paths": paths, "complexity": float(n)}]

    return table_function(files, one, "public_functions array<string>, key_paths array<string>, complexity double")


def yaml_edges(files: DataFrame) -> DataFrame:
    return table_function(files, yaml_dependencies, "source string, target string, method string, start int, end int")


def _all(text: Column, pattern: str, *groups: int) -> Column:
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda x: x != "")))


def js_structure(files: DataFrame) -> DataFrame:
    """(path, imports, public_functions, classes, complexity) of JavaScript and TypeScript, by patterns."""
    t = F.col("text")
    imports = _all(t, r"""(?:\bfrom|\bimport|\brequire\s*\()\s*\(?\s*['"]([^'"]+)['"]""", 1)
    named = _all(t, r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>", 1, 2)
    classes = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\bclass\s+([A-Za-z_$][\w$]*(?:\s+extends\s+[\w$.]+)?)"), F.lit(1)), lambda c: F.regexp_replace(c, r"\s+extends\s+([\w$.]+)", "($1)"))))
    branches = F.regexp_count(t, F.lit(r"\b(?:if|for|while|switch|try)\b"))
    return files.select("path", imports.alias("imports"), F.array_sort(F.array_distinct(F.transform(named, lambda n: F.regexp_replace(n, "^_+", "")))).alias("public_functions"), classes.alias("classes"), (1 + branches).cast("double").alias("complexity"))
