"""Facts of Python files: symbols, calls, imports, types, locals, one row each.

Files are parsed one by one in Arrow batches; a file that cannot be parsed yields one row that says so and nothing
else. What the facts mean across files is left to joins.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.operators.intervals import MODULE

SCHEMA = "path string, fact string, scope string, name string, kind string, receiver string, line int, end int, ord int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
PLAIN_BASES = {"object", "ABC", "Generic", "Protocol"}
#: Characters of files of a task, bytes of a batch of files, facts of a batch of results (those of a file at least).
TASK_CHARS, BATCH_BYTES, BATCH_FACTS = 4_000_000, "4m", 10_000


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a name or attribute chain."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super":
        return ".".join(["super()", *reversed(parts)]) if parts else "super()"
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class Facts(ast.NodeVisitor):
    """Collects rows; functions within functions belong to the symbol around them."""

    def __init__(self, path: str):
        self.path, self.rows, self.scope, self.is_class = path, [], MODULE, False
        self.seen: set[str] = set()
        self.types: dict[tuple[str, str], str] = {}

    def add(self, fact, name, kind=None, receiver=None, node=None, end=None, scope=None):
        self.rows.append((self.path, fact, scope or self.scope, name, kind, receiver, getattr(node, "lineno", None), end, len(self.rows)))

    def define(self, node, kind):
        qual = node.name if self.scope == MODULE else f"{self.scope}.{node.name}"
        if qual not in self.seen:  # the first of overloads and property setters counts
            self.seen.add(qual)
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            self.rows.append((self.path, "symbol", self.scope, qual, kind, None, first, node.end_lineno, len(self.rows)))
        return qual

    def visit_ClassDef(self, node):
        if self.scope != MODULE and not self.is_class:
            return self.generic_visit(node)
        qual = self.define(node, "class")
        for base in node.bases:
            name = dotted(base.value if isinstance(base, ast.Subscript) else base)
            if name and name.rsplit(".", 1)[-1] not in PLAIN_BASES:
                self.add("base", name, scope=qual, node=base)
        self._inside(qual, True, [*node.decorator_list, *node.body])

    def visit_FunctionDef(self, node):
        inner = self.scope != MODULE and not self.is_class
        qual = self.scope if inner else self.define(node, "method" if self.is_class else "function")
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]:
            self.add("local", a.arg, scope=qual, node=a)
            if a.annotation is not None:
                self.types[qual, a.arg] = ast.unparse(a.annotation)
                self.add("type", a.arg, self.types[qual, a.arg], scope=qual, node=a)
        if node.returns is not None and not inner:
            self.add("returns", qual, ast.unparse(node.returns), scope=qual, node=node)
        self._inside(qual, False, [*node.decorator_list, *node.body])

    visit_AsyncFunctionDef = visit_FunctionDef

    def _inside(self, qual, is_class, nodes):
        outer = self.scope, self.is_class
        self.scope, self.is_class = qual, is_class
        for n in nodes:
            self.visit(n)
        self.scope, self.is_class = outer

    def visit_Call(self, node):
        func = node.func
        if isinstance(func, ast.Name):
            if func.id != "super":
                self.add("call", func.id, "name", node=node)
        elif isinstance(func, ast.Attribute):
            receiver = dotted(func.value)
            self.add("call", func.attr, "super" if receiver == "super()" else "attr", None if receiver == "super()" else receiver, node=node)
            if receiver is None:
                self.visit(func.value)
        else:
            self.visit(func)
        for child in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(child)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self.add("ref", node.id, node=node)
        elif self.scope != MODULE and not self.is_class:
            self.add("local", node.id, node=node)

    def visit_Attribute(self, node):
        name = dotted(node)
        if name:
            self.add("ref", name, node=node)
        else:
            self.generic_visit(node)

    def visit_Assign(self, node):
        made = node.value.value if isinstance(node.value, ast.Await) else node.value
        if isinstance(made, ast.Call) and (root := dotted(made.func)):
            for t in node.targets:
                if name := dotted(t):
                    self.typed(name, root, node)
        elif isinstance(node.value, ast.Name) and (known := self.types.get((self.scope, node.value.id))):
            for t in node.targets:  # self.x = x has the type of the parameter
                if name := dotted(t):
                    self.typed(name, known, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if name := dotted(node.target):
            self.typed(name, ast.unparse(node.annotation), node)
        self.generic_visit(node)

    def typed(self, name, kind, node):
        own = name.startswith("self.") and "." in self.scope
        scope = self.scope.rsplit(".", 1)[0] if own else self.scope
        self.types[scope, name] = kind
        self.add("type", name, kind, scope=scope, node=node)

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", a.asname or a.name.split(".")[0], None, a.name if a.asname else a.name.split(".")[0], node)
            if not a.asname and "." in a.name:
                self.add("import", a.name, None, a.name, node)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", a.asname or a.name, a.name, module, node)


def facts_of(path: str, source: str) -> list[tuple]:
    found = Facts(path)
    try:
        found.visit(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError):
        return [(path, "failed", MODULE, None, None, None, None, None, 0)]
    lines = max(1, len(source.splitlines()))
    return [(path, "symbol", None, MODULE, "module", None, 1, lines, -1), *found.rows]


def python_facts(files: DataFrame) -> DataFrame:
    """Fact rows of ``files`` (path, content). Filter files before: what comes in is parsed.

    Files are dealt to tasks by their characters, as many small ones may come from one split; a worker holds the facts of a few files.
    """
    held = files.select("path", "content")
    chars = held.agg(F.sum(F.length("content"))).first()[0] or 0
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=COLUMNS).astype({"line": "Int32", "end": "Int32", "ord": "Int32"})
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows += facts_of(path, content or "")
                if len(rows) >= BATCH_FACTS:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return held.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "path").mapInPandas(run, SCHEMA)
