"""Parser queries: source files written from the symbols and uses of the driver tables, parsed back into facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.operators import serving as S
from facetline.plans import entities as N
from facetline.sources import python_facts as PY
from facetline.sources import script_facts as JS


#: Ids whose symbols of one path share a file.
FILE_IDS = 1000


def _numbered(spark, d):
    """Symbols with their place k in their file, and one symbol that each calls (the next of the file)."""
    # more symbols are more files, not longer ones
    held = N.symbols(spark, d).withColumn("path", F.concat("path", F.lit("."), F.floor(F.col("id") / FILE_IDS).cast("string")))
    w = W.partitionBy("path").orderBy("id")
    return held.select("path", "id", "qual", "kind", F.row_number().over(w).alias("k"), F.lead("qual").over(w).alias("next"))


def python_files(spark, d):
    """path, content: three lines for each symbol of a file; files of brand 7 are broken."""
    head = F.when(F.col("kind") == "class", F.concat(F.lit("class "), F.col("qual"), F.lit("(Base):"))).otherwise(F.concat(F.lit("def "), F.col("qual"), F.lit("(a, b: int):")))
    body = F.when(F.col("kind") == "class", F.lit("    field = make()")).otherwise(F.concat(F.lit("    return a."), F.coalesce("next", F.lit("last")), F.lit("(b)")))
    rows = _numbered(spark, d).select("path", "k", F.concat_ws("\n", head, body, F.lit("")).alias("text"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return files.withColumn("content", F.when(F.contains("path", F.lit("/brand7/")), F.concat("content", F.lit("\ndef ("))).otherwise(F.col("content")))


def python_symbols(spark, d):
    return PY.python_facts(python_files(spark, d)).where("fact = 'symbol' AND name <> '<module>'").select("path", "name", "kind", F.col("line").alias("start"), "end")


def python_modules(spark, d):
    return PY.python_facts(python_files(spark, d)).where("name = '<module>'").select("path", F.col("end").alias("lines"))


def python_calls(spark, d):
    return PY.python_facts(python_files(spark, d)).where("fact = 'call'").select("path", "scope", "name", "kind", "receiver", "line")


def python_locals(spark, d):
    return PY.python_facts(python_files(spark, d)).where("fact IN ('local', 'base', 'type', 'failed')").select("path", "scope", "fact", "name", F.col("kind").alias("type"))


def typed_files(spark, d):
    """path, content: a file per symbol with imports of all kinds, a class, typed attributes and a property with a setter."""
    key = F.col("p_partkey").cast("string")
    lines = [
        F.concat(F.lit("import pkg.q"), key, F.lit(".sub")), F.lit("import numpy as np"), F.lit("from .m import n as a, b"), F.lit("from x import *"),
        F.concat(F.lit("class C"), key, F.lit("(Base, Generic[T], ABC):")),
        F.concat(F.lit("    def __init__(self, repo: R"), key, F.lit("):")), F.lit("        self.repo = repo"), F.lit("        self.made = mk.Maker(repo)"),
        F.lit("    @property"), F.concat(F.lit("    def size(self) -> T"), key, F.lit(": return self.made")),
        F.lit("    @size.setter"), F.lit("    def size(self, v): self.v = v"),
    ]
    return N.table(spark, d, "part").select(F.concat(F.lit("f"), key, F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("content"))


def class_symbols(spark, d):
    """A setter with its property's name is no second symbol; spans begin with decorators."""
    return PY.python_facts(typed_files(spark, d)).where("fact = 'symbol' AND name <> '<module>'").select("path", "name", "kind", F.col("line").alias("start"), "end")


def class_types(spark, d):
    """Types of parameters, of attributes that take them or a call's result, of returns; bases that say nothing are left out."""
    return PY.python_facts(typed_files(spark, d)).where("fact IN ('type', 'returns', 'base')").select("path", "scope", "fact", "name", F.col("kind").alias("type"))


def class_imports(spark, d):
    return PY.python_facts(typed_files(spark, d)).where("fact = 'import'").select("path", F.col("name").alias("local"), F.col("receiver").alias("module"), F.col("kind").alias("name"))


def script_files(spark, d):
    head = F.when(F.col("kind") == "class", F.concat(F.lit("export class "), F.col("qual"), F.lit(" {"))).when(F.col("kind") == "module", F.concat(F.lit("export const "), F.col("qual"), F.lit(" = (a) => {"))).otherwise(F.concat(F.lit("function "), F.col("qual"), F.lit("(a, b) {")))
    body = F.concat(F.lit("  if (a) { return api."), F.coalesce("next", F.lit("last")), F.lit("(new Box(b)); } // old(1)"))
    first = F.concat(F.lit("import Def, { one, two as three } from './m"), F.col("k").cast("string"), F.lit("';"))
    rows = _numbered(spark, d).select("path", "k", F.concat_ws("\n", first, head, body, F.lit("}")).alias("text"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("content"))


def script_symbols(spark, d):
    return JS.symbols(JS.read(script_files(spark, d)))


def script_imports(spark, d):
    return JS.imports(JS.read(script_files(spark, d)))


def script_exports(spark, d):
    return JS.exports(JS.read(script_files(spark, d))).select("path", "exported", "local")


def script_calls(spark, d):
    return JS.calls(JS.read(script_files(spark, d))).drop("scope", "k")


CLASS_TEXT = """/* note: don't
  { */ import { a } from './a';
const s = '{ // not';
export class NAME extends lib.Base<T> implements Other {
  static count = 0;
  constructor(private repo: Repo, public readonly name?: string, plain: number) {
    super("}");
  }
  load = async (x) => {
    return x;
  };
  async find(
    id: string): Promise<void> {
    if (id) { this.load(id); }
  }
}
const api_NAME = {
  get: () => 1,
  post(a) { return a; },
};
const data_NAME = {
  size: 1,
};
NAME.Item = api_NAME;"""
#: Lines of the text.
CLASS_LINES = CLASS_TEXT.count("\n") + 1


def class_files(spark, d):
    """path, content: a class with members, object literals, comments and strings for each symbol of a file."""
    rows = _numbered(spark, d).select("path", "k", F.replace(F.lit(CLASS_TEXT), F.lit("NAME"), F.col("qual")).alias("text"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("content"))


def script_members(spark, d):
    return JS.symbols(JS.read(class_files(spark, d)))


def script_bases(spark, d):
    return JS.bases(JS.read(class_files(spark, d)))


def script_parameters(spark, d):
    return JS.accessor_parameters(JS.read(class_files(spark, d))).drop("class")


def script_static_members(spark, d):
    return JS.static_members(JS.read(class_files(spark, d)))


def call_sites(spark, d):
    """The lines from which callers reach a symbol: the first line of each edge, else the caller's first."""
    owners = _numbered(spark, d).select("id", "path", F.lit(1).alias("start"))
    text = python_files(spark, d).select("path", F.posexplode(F.split("content", "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")
    return S.call_sites(N.edges(spark, d), owners, text)


QUERIES = {
    "tf4_python_definitions": class_symbols,
    "tf8_python_types": class_types,
    "tf9_python_imports": class_imports,
    "tf1_python_symbols": python_symbols,
    "tf3_python_modules": python_modules,
    "tf7_python_calls": python_calls,
    "tf6_python_locals": python_locals,
    "tf10_script_symbols": script_symbols,
    "tf16_script_imports": script_imports,
    "tf10_script_members": script_members,
    "tf11_script_bases": script_bases,
    "tf12_script_parameters": script_parameters,
    "tf14_script_static_members": script_static_members,
    "jn25_call_sites": call_sites,
    "tf13_script_exports": script_exports,
    "tf15_script_calls": script_calls,
}

BASE = f"WITH {N.SYMBOLS}, k AS (SELECT path, id, qual, kind, row_number() OVER w AS k, lead(qual) OVER w AS nxt FROM (SELECT * REPLACE (path || '.' || (id // {FILE_IDS}) AS path) FROM symbols) q WINDOW w AS (PARTITION BY path ORDER BY id)), good AS (SELECT * FROM k WHERE NOT contains(path, '/brand7/'))"

KEYED = "SELECT 'f' || p_partkey || '.py' AS path, 'C' || p_partkey AS c, p_partkey AS k FROM part"

ORACLES = {
    "tf4_python_definitions": f"SELECT path, unnest([c, c || '.__init__', c || '.size']) AS name, unnest(['class', 'method', 'method']) AS kind, unnest([5, 6, 9]) AS start, unnest([12, 8, 10]) AS \"end\" FROM ({KEYED}) q",
    "tf8_python_types": f"SELECT path, unnest([c, c || '.__init__', c, c, c || '.size']) AS scope, unnest(['base', 'type', 'type', 'type', 'returns']) AS fact, unnest(['Base', 'repo', 'self.repo', 'self.made', c || '.size']) AS name, unnest([NULL, 'R' || k, 'R' || k, 'mk.Maker', 'T' || k]) AS type FROM ({KEYED}) q",
    "tf9_python_imports": f"SELECT path, unnest(['pkg', 'pkg.q' || k || '.sub', 'np', 'a', 'b', '*']) AS local, unnest(['pkg', 'pkg.q' || k || '.sub', 'numpy', '.m', '.m', 'x']) AS module, unnest([NULL, NULL, NULL, 'n', 'b', '*']) AS name FROM ({KEYED}) q",
    "tf1_python_symbols": f"{BASE} SELECT path, qual AS name, CASE kind WHEN 'class' THEN 'class' ELSE 'function' END AS kind, 3 * k - 2 AS start, 3 * k - 1 AS \"end\" FROM good",
    "tf3_python_modules": f"{BASE} SELECT path, 3 * max(k) - 1 AS lines FROM good GROUP BY path",
    "tf7_python_calls": f"{BASE} SELECT path, qual AS scope, CASE kind WHEN 'class' THEN 'make' ELSE coalesce(nxt, 'last') END AS name, CASE kind WHEN 'class' THEN 'name' ELSE 'attr' END AS kind, CASE WHEN kind <> 'class' THEN 'a' END AS receiver, 3 * k - 1 AS line FROM good",
    "tf6_python_locals": f"{BASE} SELECT path, qual AS scope, unnest(CASE kind WHEN 'class' THEN ['base', 'type'] ELSE ['local', 'local', 'type'] END) AS fact, unnest(CASE kind WHEN 'class' THEN ['Base', 'field'] ELSE ['a', 'b', 'b'] END) AS name, unnest(CASE kind WHEN 'class' THEN [NULL, 'make'] ELSE [NULL, NULL, 'int'] END) AS type FROM good UNION ALL SELECT DISTINCT path, '<module>', 'failed', NULL, NULL FROM k WHERE contains(path, '/brand7/')",
    "tf10_script_symbols": f"{BASE} SELECT path, qual AS name, CASE kind WHEN 'class' THEN 'class' ELSE 'function' END AS kind, 4 * k - 2 AS start, 4 * k AS \"end\" FROM k",
    "tf16_script_imports": f"{BASE} SELECT path, unnest(['Def', 'one', 'three']) AS local, './m' || k AS module, unnest(['default', 'one', 'two']) AS name FROM k",
    "tf13_script_exports": f"{BASE} SELECT path, qual AS exported, qual AS local FROM k WHERE kind IN ('class', 'module')",
    "tf15_script_calls": f"{BASE} SELECT path, 4 * k - 1 AS line, unnest([coalesce(nxt, 'last'), 'Box']) AS name, unnest(['attr', 'new']) AS kind, unnest(['api', NULL]) AS receiver FROM k",
    "tf10_script_members": f"{BASE}, m AS (SELECT path, qual, {CLASS_LINES} * (k - 1) AS base FROM k) SELECT path, unnest([qual, qual || '.constructor', qual || '.load', qual || '.find', 'api_' || qual, 'api_' || qual || '.get', 'api_' || qual || '.post']) AS name, unnest(['class', 'method', 'method', 'method', 'object', 'method', 'method']) AS kind, base + unnest([4, 6, 9, 12, 17, 18, 19]) AS start, base + unnest([16, 8, 11, 15, 20, 18, 19]) AS \"end\" FROM m",
    "tf11_script_bases": f"{BASE} SELECT path, qual AS name, unnest(['lib.Base', 'Other']) AS base FROM k",
    "tf12_script_parameters": f"{BASE} SELECT path, {CLASS_LINES} * (k - 1) + 6 AS line, unnest(['repo', 'name']) AS field, unnest(['Repo', 'string']) AS type FROM k",
    "tf14_script_static_members": f"{BASE} SELECT path, qual AS owner, 'Item' AS member, 'api_' || qual AS target FROM k",
    "jn25_call_sites": f"""{BASE}, {N.USES}, {N.EDGES}, l AS (SELECT src, dst, arg_min(line, ord) AS line FROM uses GROUP BY src, dst),
t AS (SELECT path, 3 * k - 2 AS line, CASE kind WHEN 'class' THEN 'class ' || qual || '(Base):' ELSE 'def ' || qual || '(a, b: int):' END AS text FROM k
  UNION ALL SELECT path, 3 * k - 1, CASE kind WHEN 'class' THEN 'field = make()' ELSE 'return a.' || coalesce(nxt, 'last') || '(b)' END FROM k
  UNION ALL SELECT path, 3 * k, '' FROM k
  UNION ALL SELECT path, 3 * max(k) + 1, 'def (' FROM k WHERE contains(path, '/brand7/') GROUP BY path)
SELECT e.src, e.dst, o.path, l.line, t.text FROM edges e JOIN l ON l.src = e.src AND l.dst = e.dst JOIN k o ON o.id = e.src JOIN t ON t.path = o.path AND t.line = l.line""",
}
