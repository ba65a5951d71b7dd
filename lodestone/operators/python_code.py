"""Facts from Python sources: structure, reads and writes, task order. Files are parsed where their rows lie.

Each extractor is a plain function of a text and a table function of rows (path, text) around it. A text that does not
parse gives an issue, and what patterns can still find.
"""

from __future__ import annotations

import ast
import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .shapes import Trees
from .sql_code import statement_tables
from .tables import table_function

#: Marks a name that is only known when the code runs.
DYNAMIC = "<dynamic>"
#: Methods that write, by what they write to.
FILE_WRITERS = {"to_csv", "to_parquet", "to_json", "to_excel", "to_feather", "to_pickle", "to_hdf"}
TABLE_WRITERS = {"to_sql", "to_gbq"}
SPARK_WRITERS = {"csv", "json", "parquet", "orc", "text", "save", "jdbc", "format", "saveAsTable", "insertInto"}
SPARK_READERS = {"csv", "json", "parquet", "orc", "text", "load", "jdbc", "table"}
#: Statements that move no data.
OPERATIONAL = ("install", "load", "set", "pragma", "attach", "detach", "use", "begin", "commit", "rollback", "vacuum", "analyze", "checkpoint", "call", "show")
PATH_WORDS = ("path", "filepath", "filepath_or_buffer", "path_or_buf", "path_or_buffer", "io", "name", "table", "table_name", "tableName", "con")


def dotted(node: ast.AST) -> str:
    """a.b.c of a chain of attributes and calls; what is neither is left out."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Name):
            parts.append(node.id)
            break
        else:
            break
    return ".".join(reversed(parts))


def last_name(node: ast.AST) -> str:
    """What dotted() ends with."""
    while isinstance(node, ast.Call):
        node = node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


class _Children(dict):
    """The fields of a class of nodes that can hold other nodes; what is no node has none."""

    def __missing__(self, cls: type) -> tuple[str, ...]:
        leaf = not issubclass(cls, ast.AST) or cls in (ast.Constant, ast.Name, ast.alias)
        self[cls] = () if leaf else tuple(f for f in cls._fields if f not in ("ctx", "op", "ops", "attr", "level", "kind", "type_comment", "type_ignores"))
        return self[cls]


_CHILDREN = _Children()


class Found(dict):
    """Nodes by their classes, in the order of ast.walk; contexts and operators are left out."""

    def __init__(self, roots: list[ast.AST]):
        todo = list(roots)
        for n in todo:  # grows on the way
            cls = n.__class__
            if cls in self:
                self[cls].append(n)
            else:
                self[cls] = [n]
            for f in _CHILDREN[cls]:
                x = getattr(n, f, None)
                if x.__class__ is list:
                    todo += x
                elif x is not None:
                    todo.append(x)

    def of(self, *kinds: type) -> list:
        return self.get(kinds[0], []) if len(kinds) == 1 else [n for k in kinds for n in self.get(k, ())]

    # What follows is the same for all texts of a shape, and is found once.

    @functools.cached_property
    def complexity(self) -> int:
        return complexity_of(self)

    @functools.cached_property
    def defined(self) -> list[tuple[ast.AST, ast.ClassDef | None]]:
        """A module's classes and functions, and those in its classes, each with the class it stands in."""
        out: list[tuple[ast.AST, ast.ClassDef | None]] = []

        def visit(body: list[ast.stmt], owner: ast.ClassDef | None) -> None:
            for n in body:
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    out.append((n, owner))
                    if isinstance(n, ast.ClassDef):
                        visit(n.body, n)
                elif isinstance(n, (ast.If, ast.Try, ast.With)):
                    visit([c for c in ast.iter_child_nodes(n) if isinstance(c, ast.stmt)], owner)

        for n in self.of(ast.Module):
            visit(n.body, None)
        return out


_trees = Trees(lambda tree: Found([tree]))


@functools.lru_cache(maxsize=1)
def parsed(text: str) -> tuple[ast.Module | None, Found, str]:
    """(tree, its nodes, "") of a text, or (None, none, what is wrong). The last one is kept: several extractors read the same tree.

    The next text may fill in the same tree, so nobody keeps nodes. Columns are not those of the text.
    """
    try:
        return *_trees.of(text), ""
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, Found([]), f"line {getattr(e, 'lineno', 0) or 0}: {e.__class__.__name__}"


def imports_of(nodes: Found) -> list[str]:
    found = {a.name for n in nodes.of(ast.Import) for a in n.names}
    for n in nodes.of(ast.ImportFrom):
        if n.module != "__future__":
            base = "." * n.level + (n.module or "")
            for a in n.names:
                found.add(base if a.name == "*" else base + ("" if not n.module else ".") + a.name)
    return sorted(found)


def imports(text: str) -> list[str]:
    """The names that a module imports; by patterns if it does not parse."""
    tree, nodes, _ = parsed(text)
    if tree is None:
        found = re.findall(r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))", text, re.M)
        return sorted({a or b for a, b in found})
    return imports_of(nodes)


def complexity_of(nodes: Found) -> int:
    """1 and the if, for, while, try and with statements; an elif is part of its if."""
    chained = sum(len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset for n in nodes.of(ast.If))
    return 1 + len(nodes.of(ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith)) - chained


def written(node: ast.expr) -> str:
    """ast.unparse(), without its cost for names and attributes of names."""
    inner = node
    while inner.__class__ is ast.Attribute:
        inner = inner.value
    return dotted(node) if inner.__class__ is ast.Name else ast.unparse(node)


def parameters(a: ast.arguments) -> str:
    """ast.unparse(), without its cost for plain parameters and defaults that are names or whole numbers."""
    given = [*a.posonlyargs, *a.args, *filter(None, (a.vararg,)), *a.kwonlyargs, *filter(None, (a.kwarg,))]
    defaults = [*a.defaults, *filter(None, a.kw_defaults)]
    plain = all(d.__class__ is ast.Name or d.__class__ is ast.Constant and d.value.__class__ in (int, bool, type(None)) for d in defaults)
    if a.posonlyargs or a.kwonlyargs or not plain or any(x.annotation for x in given):
        return ast.unparse(a)
    value = [""] * (len(a.args) - len(a.defaults)) + ["=" + (d.id if d.__class__ is ast.Name else repr(d.value)) for d in a.defaults]
    more = [star + x.arg for star, x in (("*", a.vararg), ("**", a.kwarg)) if x]
    return ", ".join([*(x.arg + v for x, v in zip(a.args, value)), *more])


def structure(text: str, calls: bool = True) -> dict:
    """imports, functions (name, qualified, signature, decorators, calls), classes, complexity, issues of a module.

    Without calls, functions have their names only.
    """
    out = {"imports": [], "functions": [], "classes": [], "complexity": 1, "issues": []}
    tree, nodes, wrong = parsed(text)
    out["imports"] = imports(text)
    if tree is None:
        out["issues"] = [wrong]
        out["classes"] = [{"name": c, "bases": []} for c in sorted(set(re.findall(r"^class\s+(\w+)", text, re.M)))]
        return out
    out["complexity"] = nodes.complexity
    for n, owner in nodes.defined:
        if n.__class__ is ast.ClassDef:
            out["classes"].append({"name": n.name, "bases": [written(b) for b in n.bases]})
            continue
        name = f"{owner.name}.{n.name}" if owner else n.name
        if not calls:
            out["functions"].append({"name": n.name, "qualified": name})
            continue
        inside = n.__dict__.get("inside")  # a shape's tree comes again
        if inside is None:
            inside = n.inside = Found([n.args, *n.body])  # not the decorators
        called = sorted({last_name(c.func) for c in inside.of(ast.Call)} - {""})
        out["functions"].append({"name": n.name, "qualified": name, "signature": f"{name}({parameters(n.args)})", "decorators": [dotted(d) for d in n.decorator_list], "calls": called, "line": n.lineno, "end_line": n.end_lineno})
    return out


def _constants(nodes: Found) -> dict[str, ast.expr]:
    return {n.targets[0].id: n.value for n in nodes.of(ast.Assign) if len(n.targets) == 1 and isinstance(n.targets[0], ast.Name)}


def value_of(node: ast.expr | None, constants: dict[str, ast.expr], depth: int = 0) -> str:
    """The string that an expression holds, through variables, + and text(...); else DYNAMIC."""
    if depth > 20 or node is None:
        return DYNAMIC
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.Name) and node.id in constants:
        return value_of(constants[node.id], constants, depth + 1)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        parts = [value_of(x, constants, depth + 1) for x in (node.left, node.right)]
        return DYNAMIC if DYNAMIC in parts else "".join(parts)
    if isinstance(node, ast.Call) and dotted(node.func).rpartition(".")[2] == "text" and node.args:
        return value_of(node.args[0], constants, depth + 1)
    return DYNAMIC


def _argument(call: ast.Call, words: tuple[str, ...], constants: dict[str, ast.expr]) -> str:
    named = {k.arg: k.value for k in call.keywords}
    chosen = next((named[w] for w in words if w in named), call.args[0] if call.args else None)
    return value_of(chosen, constants)


def is_operational(sql: str) -> bool:
    head = re.match(r"\s*(\w+)", sql)
    return bool(head) and head[1].lower() in OPERATIONAL


def data_flow(text: str) -> list[dict]:
    """Reads and writes: flow (CONSUMES, PRODUCES), dataset, storage, method (python, python_sql), unresolved, start, end of each."""
    _, nodes, _ = parsed(text)
    constants, out = _constants(nodes), []

    def add(call: ast.Call, flow: str, storage: str, names: list[str], method: str = "python") -> None:
        for n in names or [DYNAMIC]:
            out.append({"flow": flow, "dataset": n, "storage": storage, "method": method, "unresolved": n == DYNAMIC, "start": call.lineno, "end": call.end_lineno or call.lineno})

    for call in nodes.of(ast.Call):
        path = dotted(call.func)
        last = path.rpartition(".")[2]
        if "." not in path:
            continue
        if last in ("read_csv", "read_parquet", "read_json", "read_excel"):
            add(call, "CONSUMES", "file", [_argument(call, PATH_WORDS, constants)])
        elif last in ("read_sql", "read_sql_query", "execute", "sql"):
            sql = _argument(call, ("sql", "query", "statement"), constants)
            if sql == DYNAMIC:
                add(call, "CONSUMES", "table", [])
            elif not is_operational(sql):
                sources, targets = statement_tables(sql)
                if last in ("execute", "sql") and targets:
                    add(call, "PRODUCES", "table", targets, "python_sql")
                if sources or not targets:
                    add(call, "CONSUMES", "table", sources or re.findall(r"(?i)\b(?:from|join)\s+([\w.]+)", sql) or ([sql] if re.fullmatch(r"[\w.]+", sql) else []), "python_sql")
        elif last in FILE_WRITERS or last in TABLE_WRITERS:
            words = ("name", "destination_table") if last in TABLE_WRITERS else PATH_WORDS
            add(call, "PRODUCES", "table" if last in TABLE_WRITERS else "file", [_argument(call, words, constants)])
        elif last in SPARK_WRITERS and ".write." in f".{path}." and last != "format":
            add(call, "PRODUCES", "table" if last in ("saveAsTable", "insertInto", "jdbc") else "file", [_argument(call, PATH_WORDS, constants)])
        elif last in SPARK_READERS and (".read." in f".{path}." or path.startswith("spark.table")):
            add(call, "CONSUMES", "table" if last in ("table", "jdbc") else "file", [_argument(call, PATH_WORDS, constants)])
    return sorted(out, key=lambda e: (e["start"], e["flow"], e["dataset"]))


def _names(node: ast.expr) -> list[str]:
    if isinstance(node, (ast.List, ast.Tuple)):
        return [x for n in node.elts for x in _names(n)]
    if isinstance(node, (ast.Name, ast.Attribute)):
        return [dotted(node)]
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.RShift, ast.LShift)):
        return _names(node.right)
    return []


def task_order(text: str) -> list[dict]:
    """Edges between tasks: a >> b, b << a, set_downstream, set_upstream; lists give all pairs."""
    _, nodes, _ = parsed(text)
    found = []
    for n in nodes.of(ast.BinOp, ast.Call):
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.RShift, ast.LShift)):
            a, b = _names(n.left), _names(n.right)
            a, b = (a, b) if isinstance(n.op, ast.RShift) else (b, a)
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("set_downstream", "set_upstream") and n.args:
            a, b = _names(n.func.value), _names(n.args[0])
            a, b = (a, b) if n.func.attr == "set_downstream" else (b, a)
        else:
            continue
        found += [{"source": x, "target": y, "start": n.lineno, "end": n.end_lineno or n.lineno} for x in a for y in b]
    return [dict(t) for t in sorted({tuple(e.items()) for e in found})]


def without_docstrings(text: str) -> str:
    """The source without docstrings, comments and blank lines."""
    tree, nodes, _ = parsed(text)
    if tree is None:
        return text
    gone: set[int] = set()
    for n in nodes.of(ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef):
        if n.body and ast.get_docstring(n, clean=False) is not None:
            gone |= set(range(n.body[0].lineno, (n.body[0].end_lineno or n.body[0].lineno) + 1))
    return "\n".join(x for k, x in enumerate(text.splitlines(), 1) if k not in gone and x.strip() and not x.lstrip().startswith("#"))


_MODULE = "imports array<string>, public_functions array<string>, classes array<string>, class_inheritance map<string, array<string>>, complexity double, issues array<string>"
_FUNCTION = "name string, qualified string, signature string, decorators array<string>, calls array<string>, line int, end_line int"
_FLOW = "flow string, dataset string, storage string, method string, unresolved boolean, start int, end int"
_ORDER = "source string, target string, start int, end int"


def _struct(ddl: str) -> str:
    return "struct<" + re.sub(r"(\w+) (\w+<.*?>+|\w+)(?=,|$)", r"\1: \2", ddl) + ">"


def _module(s: dict) -> dict:
    return {
        "imports": s["imports"], "public_functions": sorted({f["name"].lstrip("_") for f in s["functions"]}),
        "classes": sorted(c["name"] + (f"({', '.join(c['bases'])})" if c["bases"] else "") for c in s["classes"]),
        "class_inheritance": [*{c["name"]: c["bases"] for c in s["classes"]}.items()], "complexity": float(s["complexity"]), "issues": s["issues"],
    }


#: The columns of facts() and what they hold.
KINDS = {"module": _struct(_MODULE), "imports": "array<string>", "functions": f"array<{_struct(_FUNCTION)}>", "flows": f"array<{_struct(_FLOW)}>", "orders": f"array<{_struct(_ORDER)}>"}


def facts(files: DataFrame, *kinds: str) -> DataFrame:
    """(path, module, imports, functions, flows, orders, issue): all that one parse of each file gives, or some kinds of it.

    imports are those of module, for who needs no more.
    """
    kinds = kinds or tuple(KINDS)

    def one(text: str) -> list[dict]:
        s = structure(text, calls="functions" in kinds) if "module" in kinds or "functions" in kinds else {}
        tell = {"module": lambda: _module(s), "imports": lambda: imports(text), "functions": lambda: s["functions"], "flows": lambda: data_flow(text), "orders": lambda: task_order(text)}
        return [{k: tell[k]() for k in kinds}]

    return table_function(files, one, ", ".join(f"{k} {KINDS[k]}" for k in kinds) + ", issue string", issues="issue")


def modules(found: DataFrame) -> DataFrame:
    """From facts(): a row for each file; one on which an extractor failed has that as its issue."""
    none = F.array().cast("array<string>")
    failed = F.when(F.col("issue").isNotNull(), F.array("issue")).otherwise(none)
    row = found.select("path", "module.*", failed.alias("failed"))
    return row.withColumns({c: F.coalesce(c, none) for c in ("imports", "public_functions", "classes")} | {"issues": F.concat(F.coalesce("issues", none), "failed"), "complexity": F.coalesce("complexity", F.lit(1.0))}).drop("failed")


def functions(found: DataFrame) -> DataFrame:
    """From facts(): a row for each function; local are its calls that name functions of the same file."""
    names = F.transform("functions", lambda f: f["qualified"]).alias("names")
    return found.select("path", names, F.inline("functions")).withColumn("local", F.array_intersect("calls", "names")).drop("names")


def flows(found: DataFrame) -> DataFrame:
    """(path, class, flow, dataset, ...); class says what the file does, by all of its flows."""
    has = lambda a, b: F.exists("flows", lambda x: (x["flow"] == a) & (x["storage"] == b))
    kind = T.python_class(has("CONSUMES", "table"), has("CONSUMES", "file"), has("PRODUCES", "table"), has("PRODUCES", "file"))
    return found.select("path", kind.alias("class"), F.inline("flows"))


def orders(found: DataFrame) -> DataFrame:
    return found.select("path", F.inline("orders"))


def excerpts(files: DataFrame, most: int = 4000) -> DataFrame:
    """(path, excerpt): Python without docstrings, other languages without comments and blank lines, `most` characters of it."""
    def one(text: str, path: str) -> list[dict]:
        plain = without_docstrings(text) if path.endswith(".py") else "\n".join(x for x in text.splitlines() if x.strip() and not re.match(r"\s*(#|//|--)", x))
        return [{"excerpt": plain[:most]}]

    return table_function(files, one, "excerpt string", named=True)
