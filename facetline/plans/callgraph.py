"""Queries on what calls, types, names and aliases lead to, over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetline.functions import text as X
from facetline.operators import calls as C
from facetline.operators import dangling as G
from facetline.operators import resolve as R
from facetline.plans import entities as N


def _bases(spark, d):
    """Every part's class is derived from those of a half and a third of its key."""
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("class")).where("class > 0")
    first = part.select("class", F.lit(0).alias("ord"), F.floor(F.col("class") / 2).alias("base"))
    return first.unionAll(part.where("class % 3 = 0").select("class", F.lit(1).alias("ord"), F.floor(F.col("class") / 3).alias("base")))


def _m(column):
    return F.concat(F.lit("m"), column.cast("string"))


def call_targets(spark, d):
    """Calls between parts that follow each other in an order; each part is a file with one class, some have names, locals and imports."""
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size")
    key = F.col("key")
    where = F.col("line") % 5
    receiver = F.when((where == 0) | (where == 4), F.concat(F.lit("r"), (F.col("dst") % 8).cast("string"), F.lit(".x")))
    calls = N.uses(spark, d).select(
        F.col("ord").alias("id"), F.col("src").alias("path"), F.lit("py").alias("family"), (F.col("src") % 2 == 1).alias("loose"),
        F.when(F.col("dst") % 6 == 0, "<module>").otherwise("f").alias("scope"),
        F.when(where == 1, "super").when(where == 3, "name").otherwise("attr").alias("kind"),
        F.when(F.col("dst") % 10 == 0, "constructor").otherwise(_m(F.col("dst") % 4)).alias("name"),
        receiver.alias("receiver"), "dst",
    )
    on = F.element_at(F.array(*[F.lit(k) for k in ("module", "class", "object", "interface")]), (F.col("dst") % 8 + 1).cast("int"))
    receivers = calls.where("receiver IS NOT NULL AND dst % 8 < 4").select("id", F.when(F.col("dst") % 8 == 0, F.col("dst") % 5).otherwise(F.col("dst")).alias("target"), on.alias("kind"))
    members = part.where("key % 7 = 0").select(key.alias("class"), _m(F.col("p_size") % 4).alias("name"), key.alias("target"))
    members = members.unionAll(part.where("key % 5 = 0").select(key.alias("class"), F.lit("constructor").alias("name"), (key + 1000000).alias("target")))
    nation = N.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("module"))
    few = nation.select(F.lit("py").alias("family"), _m(F.col("n") % 12).alias("name"), F.col("n").alias("path"), "n")
    return C.call_targets(
        calls.drop("dst"),
        containers=part.select(key.alias("path"), F.lit("f").alias("scope"), key.alias("container")),
        bases=_bases(spark, d),
        members=members,
        locals_=part.where("key % 3 = 0").select(key.alias("path"), F.lit("f").alias("scope"), _m(key % 4).alias("name")),
        bound=part.where("key % 4 <> 0").select(key.alias("path"), _m(F.floor(key / 3) % 4).alias("local"), F.when(key % 2 == 0, key + 2000000).alias("target")),
        receivers=receivers,
        module_members=nation.select("module", _m(F.col("n") % 4).alias("name"), (F.col("n") + 3000000).alias("target")),
        external=part.where("key % 3 = 1").select(key.alias("path"), F.concat(F.lit("r"), (key % 8).cast("string")).alias("local")),
        methods=few.select("family", "name", (F.col("n") + 4000000).alias("target")),
        top_level=few.select("family", "name", "path", (F.col("n") + 5000000).alias("target")),
    )


def type_chains(spark, d):
    """Types of parts by a dotted prefix that their file knows; functions and methods pass on to what they return."""
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    key, path = F.col("id"), F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))
    t = lambda n, *more: F.concat(F.lit("T"), F.floor(key / n).cast("string"), *[F.lit(x) for x in more])
    names = part.select(path.alias("path"), t(50).alias("name"), key.alias("target")).unionAll(part.where("id % 3 = 0").select(path.alias("path"), t(50, ".b").alias("name"), F.floor(key / 2).alias("target")))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("class", "function", "method", "module")]), (key % 4 + 1).cast("int"))
    symbols = part.select("id", path.alias("path"), kind.alias("kind"), F.when(key % 5 == 1, F.concat(F.lit("Optional["), t(100, ".b.c"), F.lit("]"))).when(key % 5 == 2, F.concat(t(100, ".b.c"), F.lit(" | None"))).when(key % 5 == 3, F.concat(F.lit("Promise<"), t(100), F.lit(">"))).when(key % 5 == 4, t(100, ".b.c")).alias("returns"))
    return C.type_classes(part.select("id", path.alias("path"), t(150, ".b.z").alias("type")), names, symbols)


def attribute_types(spark, d):
    """Attributes that customers declare for classes, two customers a class, asked through direct bases."""
    requests = N.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("class"), F.concat(F.lit("a"), (F.col("p_partkey") % 3).cast("string")).alias("attr"))
    declared = N.table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 2).alias("class"), F.concat(F.lit("a"), (F.col("c_nationkey") % 3).cast("string")).alias("attr"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("ord"))
    return C.attribute_types(requests, declared, _bases(spark, d))


def _star_tables(spark, d):
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.lit("x").alias("local"))
    key, open_ = F.col("path"), part.where("path % 9 <> 0")
    to = lambda rows, n, ord_: rows.select("path", F.lit(ord_).alias("ord"), F.floor(key / n).alias("module"))
    odd = open_.where("path % 2 = 1")
    imports = to(odd, 3, 0).unionAll(to(odd, 7, 1)).select("path", F.lit("x").alias("local"), "module", F.lit("x").alias("name"), "ord")
    stars = to(open_, 2, 0).unionAll(to(open_, 5, 1)).unionAll(to(open_.where("path % 11 = 0"), 1, 2))
    return part, imports, part.where("path % 9 = 0").select("path", "local", key.alias("target")), stars


def star_exports(spark, d):
    """Names over imports, else over stars of files that may have stars of their own; every eleventh file has itself as a star."""
    return C.followed_names(*_star_tables(spark, d), deep=True).select("path", "target")


def star_imports(spark, d):
    """Names over imports, and over stars that answer with their own definitions only."""
    return C.followed_names(*_star_tables(spark, d), deep=False).select("path", "target")


def config_aliases(spark, d):
    """A configuration per part; odd ones extend that of half the key; every third has a base, every fifth aliases."""
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    key, text = F.col("id"), F.col("id").cast("string")
    aliases = F.create_map(F.lit("@x/*"), F.array(F.lit("lib/*/i"), F.lit("./y")), F.lit("exact"), F.array(F.lit("../z")))
    configs = part.select(
        F.concat(F.lit("d"), text, F.lit("/tsconfig.json")).alias("path"),
        F.when(key % 2 == 1, F.concat(F.lit("../d"), F.floor(key / 2).cast("string"), F.when(key % 4 == 1, "/tsconfig").otherwise("/tsconfig.json"))).alias("extends"),
        F.when(key % 3 == 0, F.concat(F.lit("./b"), (key % 4).cast("string"))).alias("base_url"),
        F.when(key % 5 == 0, aliases).alias("aliases"),
    )
    spec = F.element_at(F.array(F.lit("@x/q"), F.lit("exact"), F.lit("other")), (key % 3 + 1).cast("int"))
    requests = part.select("id", F.concat(F.lit("d"), text, F.lit("/s/f.ts")).alias("from_path"), spec.alias("spec"))
    return R.alias_candidates(requests, R.merged_configs(configs))


def unquoted_paths(spark, d):
    """Addresses of pages, every byte as an octal escape, and between them escapes by letter."""
    raw = F.encode(F.concat("url", F.lit("é日")), "UTF-8")
    octal = F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.concat(F.lit("\\"), F.lpad(F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 8), 3, "0"))), "")
    return N.table(spark, d, "pages").select("page_id", X.unquote(F.concat(F.lit('"é\\t\\"'), octal, F.lit('\\\\q"'))).alias("path"), X.unquote(F.col("url")).alias("plain"))


def header_paths(spark, d):
    """Diff headers of addresses: twice the same, quoted with a blank, and two that differ."""
    url, turn = F.col("url"), F.col("page_id") % 3
    rest = F.when(turn == 0, F.concat(F.lit("a/"), url, F.lit(" b/"), url)).when(turn == 1, F.concat(F.lit('"a/\\"'), url, F.lit('" b/n '), url)).otherwise(F.concat(F.lit("a/x"), url, F.lit(" b/y"), url))
    return N.table(spark, d, "pages").select("page_id", X.header_paths(rest).alias("p")).select("page_id", F.col("p.old").alias("old_path"), F.col("p.new").alias("new_path"))


def deleted_still_used(spark, d):
    """Parts that one side lost, and what still calls, mentions or imports them; 60 files, three keys share a name."""
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    key, file = F.col("id"), F.col("id") % 60
    name = F.concat(F.lit("n"), F.floor(key / 3).cast("string"))
    owner = F.when(key % 4 == 0, F.floor(key / 2))
    deleted = part.where("p_size % 5 = 0").select("id", file.alias("path"), F.lit("py").alias("family"), name.alias("name"), owner.alias("owner"), F.concat(F.lit("C"), owner.cast("string")).alias("owner_qual"))
    alive = part.where("p_size % 5 = 1 AND floor(id / 3) % 7 = 0").select(F.lit("py").alias("family"), name.alias("name"))
    still = part.where("id % 8 = 1").select(file.alias("path"), name.alias("name"))
    members = part.where("id % 12 = 0").select(F.floor(key / 4).alias("class"), name.alias("name"), key.alias("target"))
    gone = G.replaced_by_nothing(deleted, alive, still, _bases(spark, d), members)

    src, dst = F.col("src"), F.col("dst")
    scope = F.when(src % 3 == 0, "<module>").when(src % 3 == 1, "f").otherwise(F.concat(F.lit("C"), F.floor(dst / 2).cast("string"), F.lit(".m")))
    receiver = F.when(dst % 5 == 1, "self").when(dst % 5 == 2, "mod").when(dst % 5 == 3, "obj").when(dst % 5 == 4, "a.b")
    called = F.concat(F.lit("n"), F.floor(dst / 3).cast("string"))
    seen = N.uses(spark, d).select(F.col("ord").alias("use"), (src % 60).alias("path"), F.lit("py").alias("family"), scope.alias("scope"), F.when(F.col("line") % 4 == 1, "name").when(F.col("line") % 4 == 2, "ref").otherwise("attr").alias("kind"), called.alias("name"), receiver.alias("receiver"), "line", "dst")
    mentions = seen.where("kind = 'ref'").select("use", "path", "family", "scope", F.concat_ws(".", "receiver", "name").alias("ref"), "line")
    uses = seen.where("kind <> 'ref'").drop("dst").unionByName(G.reference_uses(mentions))

    locals_ = part.where("id % 10 = 0").select(file.alias("path"), F.when(key % 20 == 0, "f").otherwise("<module>").alias("scope"), name.alias("name"))
    imports = part.where("id % 6 = 1").select((key * 7 % 60).alias("path"), F.lit("py").alias("family"), name.alias("local"), F.when(key % 4 == 1, "other").otherwise(name).alias("name"), (key % 5 == 0).alias("bound"), F.lit(None).cast("long").alias("module"), file.alias("means"), F.lit(1).alias("line"))
    modules = part.where("id < 60").select(key.alias("path"), F.lit("py").alias("family"), F.lit("mod").alias("local"), F.lit("*").alias("name"), F.lit(True).alias("bound"), (key * 3 % 60).alias("module"), (key * 3 % 60).alias("means"), F.lit(1).alias("line"))
    starred = part.where("id < 60 AND id % 11 = 0").select(key.alias("path"))
    receivers = seen.where("receiver = 'obj' AND use % 2 = 0").select("use", F.floor(dst / 2).alias("target"))
    return G.dangling_uses(gone, uses, locals_, imports.unionAll(modules), starred, receivers)


FORMS = ["export const alpha = memo(x)", "  alpha(a) {", "alpha: number = 3", "alpha == 3", "export { b2, alpha as x }", "static async get (x)", "alpha: x\ny == 2", "alpha: x\n  b2 = 4", "export default function* b2()", "export {\n get", "let alphabet = 1", "b2 =", "x.alpha = 1", "def get(self):", "async def b2(a):", "type alpha<T> = T"]


def still_defined(spark, d):
    """Deleted names that whole documents with a line of code between define no more: each of three names as a method and as none."""
    docs = N.table(spark, d, "documents")
    form = F.element_at(F.array(*[F.lit(x) for x in FORMS]), (F.col("doc_id") % len(FORMS) + 1).cast("int"))
    texts = docs.select(F.col("doc_id").alias("path"), F.concat("text", F.lit("\n"), form, F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("\n"), F.col("text")))).alias("content"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).cast("long").alias("owner")) for n in ("alpha", "b2", "get") for o in (None, 1)]))
    gone = docs.select(F.col("doc_id").alias("path"), names.alias("n")).select("path", "n.name", "n.owner")
    return G.without_definition(gone, texts).select("path", "name", F.col("owner").isNotNull().alias("method"))


def import_lines(spark, d):
    """Lines of whole documents that name their language, those that import first."""
    return N.table(spark, d, "documents").select("doc_id", X.import_line(F.concat(F.lit("x\n"), "text", F.lit("\nrequire z\n"), "source"), F.when(F.col("doc_id") % 3 == 0, "z").otherwise(F.col("source"))).cast("long").alias("line"))


QUERIES = {
    "gr9_still_defined": still_defined,
    "gr9_deleted_still_used": deleted_still_used,
    "fn_import_lines": import_lines,
    "gr11_call_targets": call_targets,
    "jn15_type_chains": type_chains,
    "jn15_attribute_types": attribute_types,
    "jn7_star_exports": star_exports,
    "jn7_star_imports": star_imports,
    "jn11_config_aliases": config_aliases,
    "fn_unquoted_paths": unquoted_paths,
    "fn_header_paths": header_paths,
}

BASES = "b AS (SELECT p_partkey AS class, '0000' AS o, p_partkey // 2 AS base FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, '0001', p_partkey // 3 FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0)"


def _stars(edges: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 9 <> 0),
s AS (SELECT k, k // 2 AS nxt, '0001' AS way FROM o UNION ALL SELECT k, k // 5, '0002' FROM o UNION ALL SELECT k, k, '0003' FROM o WHERE k % 11 = 0),
e AS (SELECT k, k // 3 AS nxt, '0000' AS way, false AS last FROM o WHERE k % 2 = 1 UNION ALL {edges}),
w AS (SELECT p_partkey AS path, p_partkey AS now, '' AS pos, false AS last, 0 AS n FROM part UNION ALL SELECT w.path, e.nxt, pos || way, e.last, n + 1 FROM w JOIN e ON e.k = w.now WHERE NOT w.last AND n < 8)
SELECT w.path, arg_min(now, pos) AS target FROM w JOIN part ON p_partkey = now WHERE now % 9 = 0 GROUP BY 1"""


ORACLES = {
    "gr9_deleted_still_used": f"""WITH RECURSIVE {N.USES}, {BASES},
dd AS (SELECT p_partkey AS id, p_partkey % 60 AS home, p_partkey // 3 AS nm, CASE WHEN p_partkey % 4 = 0 THEN p_partkey // 2 END AS owner FROM part WHERE p_size % 5 = 0 AND p_partkey // 3 NOT IN (SELECT p_partkey // 3 FROM part WHERE p_size % 5 = 1 AND (p_partkey // 3) % 7 = 0)),
w AS (SELECT id, nm, owner AS class, 0 AS lv FROM dd WHERE owner IS NOT NULL UNION SELECT id, nm, base, lv + 1 FROM w JOIN b ON b.class = w.class WHERE lv < 7),
inh AS (SELECT DISTINCT w.id FROM w JOIN part ON p_partkey % 12 = 0 AND p_partkey // 4 = w.class AND p_partkey // 3 = w.nm),
g AS (SELECT * FROM dd WHERE CASE WHEN owner IS NULL THEN NOT EXISTS (SELECT 1 FROM part WHERE p_partkey % 8 = 1 AND p_partkey % 60 = home AND p_partkey // 3 = nm) ELSE id NOT IN (SELECT id FROM inh) END),
u AS (SELECT ord, src % 60 AS path, src % 3 AS sc, dst, dst // 3 AS nm, line, line % 4 AS z, dst % 5 AS rc FROM uses),
loc AS (SELECT p_partkey % 60 AS path, p_partkey % 20 = 0 AS f, p_partkey // 3 AS nm FROM part WHERE p_partkey % 10 = 0),
imp AS (SELECT p_partkey * 7 % 60 AS path, p_partkey // 3 AS nm, p_partkey % 4 = 1 AS other, p_partkey % 5 = 0 AS bound, p_partkey % 60 AS means FROM part WHERE p_partkey % 6 = 1),
r AS (SELECT g.*, u.* EXCLUDE (nm), i.nm IS NOT NULL AS has, i.other, i.bound, i.means,
    EXISTS (SELECT 1 FROM loc WHERE loc.path = u.path AND loc.nm = u.nm AND loc.f) AS in_f, EXISTS (SELECT 1 FROM loc WHERE loc.path = u.path AND loc.nm = u.nm AND NOT loc.f) AS on_top
  FROM g JOIN u ON u.nm = g.nm LEFT JOIN imp i ON i.path = u.path AND i.nm = u.nm),
h AS (SELECT id, path, line FROM r WHERE CASE
    WHEN rc = 4 AND z = 2 THEN false
    WHEN owner IS NOT NULL THEN z <> 1 AND (CASE rc WHEN 1 THEN path = home AND sc = 2 AND dst // 2 = owner WHEN 3 THEN ord % 2 = 0 AND dst // 2 = owner ELSE false END)
    WHEN rc = 0 THEN z IN (1, 2) AND NOT (sc = 1 AND in_f) AND NOT (sc = 0 AND on_top) AND CASE WHEN has THEN NOT other AND NOT bound AND means = home ELSE path = home AND path % 11 <> 0 AND NOT on_top END
    WHEN rc = 2 THEN path * 3 % 60 = home ELSE false END
  UNION SELECT g.id, imp.path, 1 FROM g JOIN imp ON imp.nm = g.nm AND imp.means = g.home WHERE g.owner IS NULL AND NOT other AND NOT bound)
SELECT id, path, line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path, line) AS k FROM h) q WHERE k <= 25""",
    "fn_import_lines": """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'z' ELSE source END AS name, string_split('x' || chr(10) || text || chr(10) || 'require z' || chr(10) || source, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, name, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM l)
SELECT doc_id, coalesce(min(n) FILTER (contains(line, name) AND (contains(line, 'import') OR contains(line, 'require'))), min(n) FILTER (contains(line, name)), 1) AS line FROM e GROUP BY doc_id""",
    "gr11_call_targets": f"""WITH RECURSIVE {N.USES}, {BASES},
c AS (SELECT ord AS id, src, dst, line % 5 AS z, dst % 6 = 0 AS outer_, CASE WHEN dst % 10 = 0 THEN 'constructor' ELSE 'm' || (dst % 4) END AS name FROM uses),
mm AS (SELECT p_partkey AS class, 'm' || (p_size % 4) AS name, p_partkey AS target FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'constructor', p_partkey + 1000000 FROM part WHERE p_partkey % 5 = 0),
w AS (SELECT id, name, dst AS class, '' AS pos, 0 AS lv FROM c WHERE z IN (0, 4) AND dst % 8 IN (1, 2, 3)
  UNION ALL SELECT id, name, base, o, 0 FROM c JOIN b ON b.class = src WHERE z = 1 AND NOT outer_ AND (name <> 'constructor' OR o = '0000')
  UNION ALL SELECT id, name, b.base, pos || o, lv + 1 FROM w JOIN b ON b.class = w.class WHERE lv < 7),
found AS (SELECT id, arg_min(mm.target, pos) AS t FROM w JOIN mm ON mm.class = w.class AND mm.name = w.name GROUP BY id),
r AS (SELECT c.*, found.t,
    (SELECT min(n_nationkey) + 3000000 FROM nation WHERE n_regionkey = c.dst % 5 AND 'm' || (n_nationkey % 4) = c.name) AS within,
    NOT outer_ AND src % 3 = 0 AND name = 'm' || (src % 4) AS hidden, src % 4 <> 0 AND name = 'm' || ((src // 3) % 4) AS bound, src % 3 = 1 AND src % 8 = dst % 8 AS outside
  FROM c LEFT JOIN found ON found.id = c.id),
h AS (SELECT *, CASE
    WHEN z = 1 THEN CASE WHEN t IS NOT NULL OR (name = 'constructor' AND NOT outer_ AND src > 0) THEN 'super' END
    WHEN z = 2 THEN 'guess'
    WHEN z = 3 THEN CASE WHEN hidden THEN NULL WHEN bound THEN CASE WHEN src % 2 = 0 THEN 'name' END WHEN src % 2 = 1 THEN 'guess_top' END
    WHEN dst % 8 = 0 THEN CASE WHEN within IS NOT NULL THEN 'module' END
    WHEN t IS NOT NULL THEN 'member' WHEN dst % 8 IN (1, 3) THEN NULL WHEN outside THEN NULL ELSE 'guess' END AS how FROM r)
SELECT id, CASE how WHEN 'super' THEN coalesce(t, src // 2) WHEN 'name' THEN src + 2000000 WHEN 'module' THEN within ELSE t END AS target, false AS fuzzy, how FROM h WHERE how IN ('super', 'name', 'module', 'member')
UNION ALL SELECT id, n_nationkey + CASE how WHEN 'guess' THEN 4000000 ELSE 5000000 END, true, how FROM h JOIN nation ON 'm' || (n_nationkey % 12) = name WHERE how = 'guess' OR (how = 'guess_top' AND n_nationkey <> src)""",
    "jn15_type_chains": """WITH RECURSIVE w AS (SELECT p_partkey AS id, 50 * (p_partkey // 150) + p_partkey % 50 AS k, 0 AS n FROM part
  UNION ALL SELECT id, 50 * (t // 100) + t % 50, n + 1 FROM (SELECT id, n, CASE WHEN k % 3 = 0 THEN k // 2 ELSE k END AS t FROM w JOIN part ON p_partkey = k) q WHERE t % 4 IN (1, 2) AND t % 5 NOT IN (0, 3) AND n < 3)
SELECT id, CASE WHEN k % 3 = 0 THEN k // 2 ELSE k END AS class FROM w JOIN part ON p_partkey = k WHERE (CASE WHEN k % 3 = 0 THEN k // 2 ELSE k END) % 4 = 0""",
    "jn15_attribute_types": f"""WITH {BASES}, a AS (SELECT c_custkey // 2 AS owner, 'a' || (c_nationkey % 3) AS attr, arg_min(c_mktsegment, c_custkey) AS type FROM customer GROUP BY 1, 2),
o AS (SELECT p_partkey AS id, p_partkey AS owner, '' AS k FROM part UNION ALL SELECT class, base, o FROM b)
SELECT id, arg_min(owner, k) AS owner, arg_min(type, k) AS type FROM o JOIN a USING (owner) WHERE attr = 'a' || (id % 3) GROUP BY id""",
    "jn7_star_exports": _stars("SELECT *, false FROM s WHERE k % 2 = 0"),
    "jn7_star_imports": _stars("SELECT *, true FROM s"),
    "jn11_config_aliases": """WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey AS now, 0 AS n FROM part UNION ALL SELECT id, now // 2, n + 1 FROM w WHERE now % 2 = 1 AND n < 5),
m AS (SELECT id, arg_min(now, n) FILTER (now % 3 = 0) AS b, bool_or(now % 5 = 0) AS aliased FROM w GROUP BY id),
r AS (SELECT id, CASE WHEN b IS NULL THEN 'd' || id ELSE 'd' || b || '/b' || (b % 4) END AS base, CASE WHEN b IS NULL THEN '' ELSE 'd' || b || '/' END AS up, aliased FROM m WHERE b IS NOT NULL OR aliased),
o AS (SELECT id, CASE WHEN NOT aliased THEN [] WHEN id % 3 = 0 THEN [base || '/lib/q/i', base || '/y'] WHEN id % 3 = 1 THEN [up || 'z'] ELSE [] END AS l, base || '/' || ['@x/q', 'exact', 'other'][(id % 3 + 1)::INTEGER] AS own FROM r)
SELECT id, unnest(range(1, len(l) + 2))::INTEGER AS k, unnest(list_append(l, own)) AS base FROM o""",
    "gr9_still_defined": f"""WITH t AS (SELECT doc_id AS path, text || chr(10) || ([{", ".join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in FORMS)}])[(doc_id % {len(FORMS)} + 1)::INTEGER] || CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || text END AS content FROM documents),
g AS (SELECT path, name, method, content FROM t, (VALUES ('alpha'), ('b2'), ('get')) n(name), (VALUES (true), (false)) m(method))
SELECT path, name, method FROM g WHERE NOT coalesce(CASE WHEN method THEN regexp_matches(content, '(?m)^\\s*(?:(?:public|private|protected|static|async|readonly|override|get|set|def)\\s+)*' || name || '\\s*[(=:<]')
  ELSE regexp_matches(content, '(?m)^\\s*(?:export\\s+)?(?:default\\s+)?(?:declare\\s+)?(?:async\\s+)?(?:const|let|var|function\\*?|class|def|interface|type|enum|namespace)\\s+' || name || '\\b|^\\s*' || name || '\\s*(?::[^=]*)?=(?:[^=]|\\z)|export\\s*\\{{[^}}]*\\b' || name || '\\b') END, false)""",
    "fn_unquoted_paths": "SELECT page_id, 'é' || chr(9) || '\"' || url || 'é日' || '\\q' AS path, url AS plain FROM pages",
    "fn_header_paths": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url END AS old_path, CASE page_id % 3 WHEN 0 THEN url END AS new_path FROM pages WHERE page_id % 3 <> 1
UNION ALL SELECT page_id, '"' || url, 'n ' || url FROM pages WHERE page_id % 3 = 1""",
}
