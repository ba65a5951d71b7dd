"""Table lineage of SQL texts: a tokenizer and a scope-aware reader of FROM, JOIN, WITH and targets."""

from __future__ import annotations

import contextlib
import functools
import re
import sys

from pyspark.sql import DataFrame

from .tables import table_function

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|\#[^\n]*|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\[[A-Za-z_][^\]\n]*\]|[A-Za-z_\u0080-￿][\w$]*|\d[\w.]*|::|[(),;.]|\S""", re.S)
_CLAUSES = set("select from where group having order limit union intersect except on using join inner left right full cross outer lateral natural window qualify set values returning when then else end as and or not with fetch offset for tablesample pivot unpivot recursive".split())
_DBT = re.compile(r"""\{\{\s*(ref|source)\s*\(\s*['"]([^'"]+)['"]\s*(?:,\s*['"]([^'"]+)['"]\s*)?\)\s*\}\}""")
_TEMPLATE = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)
WRITES = ("insert", "create", "merge", "update", "delete")


def dbt_references(text: str) -> list[str]:
    return sorted({f"{a}.{b}" if b else a for _, a, b in _DBT.findall(text)})


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*", "#"))]


def _is_name(t: str) -> bool:
    return bool(t) and (t[0] in '"`[' or t[0].isalpha() or t[0] == "_")


def _bare(t: str) -> str:
    return t[1:-1] if t[0] in '"`[' else t


class Reader:
    """The tables that a statement reads and writes. CTEs are replaced by what they read; unused ones count for nothing."""

    def __init__(self, words: list[str]):
        self.t, self.low = words, [w.lower() for w in words]
        self.closing, opened = {}, []
        for k, w in enumerate(words):
            if w == "(":
                opened.append(k)
            elif w == ")" and opened:
                self.closing[opened.pop()] = k

    def name(self, k: int) -> tuple[str, int]:
        parts = []
        while k < len(self.t) and _is_name(self.t[k]):
            parts.append(_bare(self.t[k]))
            k += 1
            if k + 1 < len(self.t) and self.t[k] == "." and _is_name(self.t[k + 1]):
                k += 1
            else:
                break
        return ".".join(parts), k

    def close(self, k: int) -> int:
        """The place of the bracket that closes the one at k; the end if none does."""
        return self.closing.get(k, len(self.t))

    def reads(self, a: int, b: int, scope: dict[str, set[str]]) -> set[str]:
        """Tables read in [a, b)."""
        found, k, scope = set(), a, dict(scope)
        while k < b:
            w = self.low[k]
            if w == "with" and (k == a or self.t[k - 1] == "(" or self.low[k - 1] in ("as", ")") or k + 1 < b and self._opens_cte(k)):
                k = self.ctes(k + 1, b, scope)
            elif w in ("from", "join") and not (w == "from" and self._inside_call(a, k)) or w == "using" and self._is_source(k + 1):
                k = self.sources(k + 1, b, scope, found, commas=w == "from")
            elif w == "(":
                z = min(b, self.close(k))
                found |= self.reads(k + 1, z, scope)
                k = z + 1
            else:
                k += 1
        return found

    def _opens_cte(self, k: int) -> bool:
        j = k + 1 + (self.low[k + 1] == "recursive")
        return j + 1 < len(self.t) and _is_name(self.t[j]) and self.low[j + 1] in ("as", "(")

    def _is_source(self, k: int) -> bool:
        """After USING: a table or a query, not a list of columns."""
        return k < len(self.t) and (self.t[k] != "(" or k + 1 < len(self.t) and self.low[k + 1] in ("select", "with", "values", "("))

    def _inside_call(self, a: int, k: int) -> bool:
        """extract(year from x), substring(x from 1), trim(both from x), is distinct from y."""
        if self.low[k - 1] == "distinct":
            return True
        return a > 1 and self.t[a - 1] == "(" and _is_name(self.t[a - 2]) and self.low[a - 2] in ("extract", "substring", "trim", "overlay", "position")

    def ctes(self, k: int, b: int, scope: dict[str, set[str]]) -> int:
        k += k < b and self.low[k] == "recursive"
        while k < b and _is_name(self.t[k]):
            alias = _bare(self.t[k]).lower()
            k += 1
            if k < b and self.t[k] == "(":
                k = self.close(k) + 1
            k += k < b and self.low[k] == "as"
            while k < b and self.low[k] in ("not", "materialized"):
                k += 1
            if k >= b or self.t[k] != "(":
                break
            z = self.close(k)
            inner = {n: t for n, t in scope.items() if n != alias}  # its own name inside is the table of that name
            scope[alias] = self.reads(k + 1, min(z, b), inner)
            k = z + 1
            if k < b and self.t[k] == ",":
                k += 1
            else:
                break
        return k

    def sources(self, k: int, b: int, scope: dict[str, set[str]], found: set[str], commas: bool) -> int:
        while k < b:
            while k < b and self.low[k] in ("lateral", "only", "table"):
                k += 1
            if k < b and self.t[k] == "(":
                z = min(b, self.close(k))
                inner = self.low[k + 1] if k + 1 < z else ""
                if inner in ("select", "with", "values", "("):
                    found |= self.reads(k + 1, z, scope)
                else:
                    self.sources(k + 1, z, scope, found, True)
                    found |= self.reads(k + 1, z, scope)
                k = z + 1
            elif k < b and _is_name(self.t[k]) and self.low[k] not in _CLAUSES:
                name, k = self.name(k)
                if k < b and self.t[k] == "(":  # a table function: only what it reads
                    z = min(b, self.close(k))
                    found |= self.reads(k + 1, z, scope)
                    k = z + 1
                else:
                    found |= scope[name.lower()] if name.lower() in scope else {name}
            else:
                break
            k += k < b and self.low[k] == "as"
            if k < b and _is_name(self.t[k]) and self.low[k] not in _CLAUSES:
                k += 1
                if k < b and self.t[k] == "(":
                    k = self.close(k) + 1
            if commas and k < b and self.t[k] == ",":
                k += 1
            else:
                break
        return k


@contextlib.contextmanager
def room_for(words: list[str]):
    """Room for the calls that the deepest brackets need."""
    depth = most = 0
    for w in words:
        depth += (w == "(") - (w == ")")
        most = max(most, depth)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + 8 * most))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def statements(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        if w == ";":
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


def target_of(words: list[str]) -> tuple[str | None, int, str]:
    """(target, words of its clause, operation) of a statement."""
    low = [w.lower() for w in words]
    r, k = Reader(words), 0
    if low[:1] == ["with"]:  # the statement after its CTEs
        k = r.ctes(1, len(words), {})
    op = low[k] if k < len(low) else ""
    if op not in WRITES:
        return None, 0, "select" if op in ("select", "(", "values", "from") else op
    j = k + 1
    skip = {"insert": ("into", "overwrite", "table", "or", "ignore", "replace"), "create": ("or", "replace", "temp", "temporary", "external", "materialized", "table", "view", "if", "not", "exists", "transient", "unlogged"), "merge": ("into",), "update": ("only",), "delete": ("from",)}[op]
    while j < len(low) and low[j] in skip:
        j += 1
    name, z = r.name(j)
    return name or None, z, op


@functools.lru_cache(maxsize=1024)
def statement_tables(sql: str) -> tuple[list[str], list[str]]:
    """(sources, targets) of all statements of a text; a target is no source of its own statement."""
    sources, targets = set(), set()
    for words in statements(tokens(_TEMPLATE.sub(" ", sql))):
        s, t, _ = statement_lineage(words)
        sources |= s
        targets |= {t} if t else set()
    return sorted(sources), sorted(targets)


def statement_lineage(words: list[str]) -> tuple[set[str], str | None, str]:
    """(sources, target, operation) of a statement, however deep its sub-queries."""
    with room_for(words):
        return _statement_lineage(words)


def _statement_lineage(words: list[str]) -> tuple[set[str], str | None, str]:
    target, end, op = target_of(words)
    r, scope = Reader(words), {}
    k = r.ctes(1, len(words), scope) if words[0].lower() == "with" else 0
    begin = end if target else k
    if target and begin < len(words) and words[begin] == "(" and (begin + 1 >= len(words) or words[begin + 1].lower() not in ("select", "with")):
        begin = r.close(begin) + 1  # the list of columns
    found = r.reads(begin, len(words), scope)
    return found - ({target} if target else set()), target, op


def classify(op: str, text: str) -> str:
    if op == "create":
        return "sql_ctas" if re.search(r"(?i)\bas\s*\(?\s*(select|with)\b", text) else "sql_write"
    return {"merge": "sql_merge_upsert", "insert": "sql_insert", "update": "sql_update", "delete": "sql_delete"}.get(op, "sql_model_select")


def lines_of(text: str, part: str) -> tuple[int, int]:
    """Lines of a part of a text: as it stands, else with white space and case folded, else the whole text."""
    k = text.find(part)
    if k < 0:
        folded, where = [], []
        for i, c in enumerate(text):
            if not c.isspace():
                folded.append(c.lower())
                where.append(i)
        wanted = "".join(part.split()).lower()
        j = "".join(folded).find(wanted) if wanted else -1
        if j < 0:
            return 1, max(1, text.count("\n") + 1)
        k, end = where[j], where[j + len(wanted) - 1]
    else:
        end = k + max(0, len(part.rstrip()) - 1)
    return text.count("\n", 0, k) + 1, text.count("\n", 0, end + 1) + 1


def lineage(text: str, stem: str = "") -> list[dict]:
    """One row for each statement: sources, targets, operation, class, dialect, lines.

    A file that only selects writes the table of its own name (stem). Template references count as sources.
    """
    refs, out = dbt_references(text), []
    plain = _TEMPLATE.sub(lambda m: "ref_" if _DBT.fullmatch(m[0]) else " ", text)
    for part in re.split(r";(?=(?:[^']*'[^']*')*[^']*$)", plain):
        words = tokens(part)
        if not words:
            continue
        sources, target, op = statement_lineage(words)
        sources = {s for s in sources if s not in ("ref_", "ref", "source")} | set(refs if "ref_" in part else ())
        if not sources and not target:
            continue
        start, end = lines_of(plain, part.strip())
        out.append({"sources": sorted(sources), "targets": [target] if target else [stem] if stem and sources else [], "operation": "write" if op in WRITES else "read", "class": classify(op, part), "dialect": "dbt_template" if "ref_" in part else "sql", "start": start, "end": end})
    if not out and refs:
        out.append({"sources": refs, "targets": [stem] if stem else [], "operation": "read", "class": "sql_model_select", "dialect": "dbt_template", "start": 1, "end": text.count("\n") + 1})
    return out


def structure(text: str) -> dict:
    """Operations, table candidates and complexity (1 and the operations) of a SQL text."""
    low = [w.lower() for w in tokens(_TEMPLATE.sub(" ", text))]
    ops = [w for w in low if w in ("select", "insert", "update", "delete", "merge", "create", "union", "join", "with")]
    names = [m[0] or m[1] for m in re.findall(r"(?i)\b(?:from|join|into|update|table)\s+(?:\"([\w.]+)\"|([A-Za-z_][\w.]*))", text)]
    return {"operations": sorted({"cte" if o == "with" else o for o in ops}), "tables": sorted({n for n in names if n.lower() not in _CLAUSES}), "complexity": 1 + len(ops)}


def lineages(files: DataFrame) -> DataFrame:
    """(path, sources, targets, operation, class, dialect, start, end, issue) of the statements of SQL files; an issue where one fails."""
    def one(text: str, path: str) -> list[dict]:
        return lineage(text, path.rsplit("/", 1)[-1].rsplit(".", 1)[0])

    return table_function(files, one, "sources array<string>, targets array<string>, operation string, class string, dialect string, start int, end int, issue string", issues="issue", named=True)


def references(files: DataFrame) -> DataFrame:
    """(path, refs): template references of each text."""
    return table_function(files, lambda t: [{"refs": dbt_references(t)}], "refs array<string>")


def structures(files: DataFrame) -> DataFrame:
    return table_function(files, lambda t: [structure(t)], "operations array<string>, tables array<string>, complexity int")


def places(files: DataFrame, part: str) -> DataFrame:
    """(path, start, end): the lines of a part of each text."""
    return table_function(files, lambda t: [dict(zip(("start", "end"), lines_of(t, part)))], "start int, end int")
