"""Name-resolution queries over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetline.functions import paths as P
from facetline.operators import resolve as R
from facetline.plans import entities as N
from facetline.sources import tables as T


def longest_prefix(spark, d):
    """Dotted names brand.type.name against those brands and brand.types that exist as names."""
    part = N.table(spark, d, "part")
    brand, kind = F.regexp_replace("p_brand", "#", ""), F.lower("p_type")
    requests = part.select(F.col("p_partkey").alias("id"), F.concat_ws(".", brand, kind, F.regexp_replace("p_name", " ", "_"), F.lit("x")).alias("dotted"))
    names = part.where("p_size > 25").select(F.concat_ws(".", brand, kind).alias("name")).unionAll(part.select(brand.alias("name"))).distinct().withColumn("target", F.upper("name"))
    return R.longest_prefix(requests, names)


def _modules(spark, d):
    return N.symbols(spark, d).select("path").distinct().withColumn("dotted", F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", "."))


def suffix_module(spark, d):
    """Files ask for the module of the next type by its bare name; the one in their own directory is nearest."""
    symbols = N.symbols(spark, d)
    spec = F.when(F.col("id") % 3 == 0, "economy").when(F.col("id") % 3 == 1, "brand3.large").otherwise("src.brand4.small")
    return R.suffix_module(symbols.select("id", spec.alias("spec"), F.col("path").alias("from_path")), _modules(spark, d))


def script_file(spark, d):
    """Paths without their extension, looked up again."""
    files = N.paths(spark, d)
    bases = files.select("id", F.when(F.col("id") % 4 == 0, F.col("path")).when(F.col("id") % 4 == 1, P.dirname(F.col("path"))).otherwise(F.regexp_replace("path", r"\.[^./]*$", "")).alias("base"))
    return R.script_file(bases, files)


def nearest_alias(spark, d):
    """Aliases @lib/ in two kinds of directories, expanded from the nearest config upwards."""
    requests = N.paths(spark, d).select("id", F.col("path").alias("from_path"), F.lit("@lib/x/../y").alias("spec"))
    configs = spark.createDataFrame([("", "@lib/", "shared/"), ("src", "@lib/", "lib/"), ("web", "@lib/x", "z")], "dir string, prefix string, target string")
    return R.aliased_bases(requests, configs)


def workspace_package(spark, d):
    packages = N.table(spark, d, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("@"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("name")).distinct()
    nested = packages.select(F.concat("name", F.lit("/promo")).alias("name"))
    held = packages.unionAll(nested).withColumn("dir", F.concat(F.lit("packages/"), F.expr("substring(name, 2)")))
    requests = N.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("@"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/"), F.lower("p_type"), F.lit("/index")).alias("spec"))
    return R.workspace_package(requests, held)


def conventional_alias(spark, d):
    specs = N.paths(spark, d).select("id", F.concat(F.when(F.col("id") % 2 == 0, "@/").otherwise("~/"), F.regexp_replace("path", "^src/", "")).alias("spec"))
    options = R.conventional_bases(specs).withColumnRenamed("base", "path")
    return R.first_existing(options, N.paths(spark, d))


def inherited_member(spark, d):
    """Every part's class is derived from those of a half and a third of its key; members sit on every seventh."""
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("class"), "p_size")
    first = part.where("class > 0").select("class", F.lit(0).alias("ord"), F.floor(F.col("class") / 2).alias("base"))
    second = part.where("class > 0 AND class % 3 = 0").select("class", F.lit(1).alias("ord"), F.floor(F.col("class") / 3).alias("base"))
    members = part.where("class % 7 = 0").select("class", F.concat(F.lit("m"), (F.col("p_size") % 4).cast("string")).alias("name"), F.col("class").alias("target"))
    requests = part.select(F.col("class").alias("id"), "class", F.concat(F.lit("m"), (F.col("class") % 4).cast("string")).alias("name"))
    return R.inherited_member(requests, first.unionAll(second), members)


def _methods(spark, d):
    """Methods named after a part's name and size."""
    part = N.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 50 == 0, "append").otherwise(F.concat(F.regexp_replace("p_name", " ", "_"), (F.col("p_size") % 9).cast("string")))
    return part.select(F.lit("py").alias("family"), name.alias("name"), F.col("p_partkey").alias("target"), F.concat(F.lit("f"), (F.col("p_partkey") % 20).cast("string")).alias("path"))


def fuzzy_methods(spark, d):
    methods = _methods(spark, d)
    calls = N.uses(spark, d).join(methods.select(F.col("target").alias("dst"), "family", "name"), "dst").select(F.col("ord").alias("id"), "family", "name")
    return R.fuzzy_methods(calls, methods)


def fuzzy_top_level(spark, d):
    methods = _methods(spark, d)
    calls = N.uses(spark, d).join(methods.select(F.col("target").alias("dst"), "family", "name"), "dst").select(F.col("ord").alias("id"), "family", "name", F.concat(F.lit("f"), (F.col("src") % 20).cast("string")).alias("path"))
    return R.fuzzy_top_level(calls, methods)


def external_receivers(spark, d):
    calls = N.uses(spark, d).select(F.col("ord").alias("id"), (F.col("src") % 40).alias("path"), (F.col("dst") % 9).alias("head"))
    unresolved = N.table(spark, d, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_regionkey").alias("local"))
    return R.not_external(calls, unresolved).select("id")


def local_shadowing(spark, d):
    uses = N.uses(spark, d).select(F.col("ord").alias("id"), (F.col("src") % 40).alias("path"), F.when(F.col("dst") % 2 == 0, "<module>").otherwise("f").alias("scope"), (F.col("dst") % 9).alias("name"))
    held = N.table(spark, d, "nation").select(F.col("n_nationkey").alias("path"), F.explode(F.array(F.lit("<module>"), F.lit("f"))).alias("scope"), F.col("n_regionkey").alias("name"))
    return R.not_local(uses, held).select("id")


def ancestor_links(spark, d):
    """Links from members to what contains them go: quals are made of region, nation and customer."""
    qual = F.concat_ws(".", (F.col("src") % 3).cast("string"), F.when(F.col("src") % 2 == 0, (F.col("src") % 5).cast("string")))
    other = F.concat_ws(".", (F.col("dst") % 3).cast("string"), F.when(F.col("dst") % 4 == 0, (F.col("dst") % 5).cast("string")))
    links = N.uses(spark, d).select("ord", (F.col("src") % 2).alias("src_path"), qual.alias("src_qual"), (F.col("dst") % 2).alias("dst_path"), other.alias("dst_qual"))
    return R.not_related(links).select("ord")


def binding_fixpoint(spark, d):
    """Parts re-export from a third of their key; every ninth defines; 501 and 502 of each thousand go in circles."""
    part = N.table(spark, d, "part").select(F.col("p_partkey").alias("path"))
    key, turn = F.col("path"), F.col("path") % 1000
    module = F.when(turn == 501, key + 1).when(turn == 502, key - 1).otherwise(F.floor(key / 3))
    imports = part.where("path % 9 <> 0").select("path", F.lit("x").alias("local"), module.alias("module"), F.lit("x").alias("name"))
    definitions = part.where("path % 9 = 0").select("path", F.lit("x").alias("local"), key.alias("target"))
    return R.bindings(imports, definitions).select("path", "target")


def _calls(spark, d):
    symbols = N.symbols(spark, d)
    target = symbols.select(F.col("id").alias("dst"), F.concat("name", (F.col("size") % 9).cast("string")).alias("name"))
    source = symbols.select(F.col("id").alias("src"), "path")
    return N.uses(spark, d).join(target, "dst").join(source, "src").select(F.col("ord").alias("id"), "path", F.lit("py").alias("family"), "name", "line", "kind")


def resolve_calls(spark, d):
    """Calls by name: of the caller's file, imported by the file, or guessed."""
    named = N.symbols(spark, d).select("path", F.concat("name", (F.col("size") % 9).cast("string")).alias("name"), "id")
    imports = named.where("id % 4 = 0").select(F.concat(F.lit("src/brand"), (F.col("id") % 25).cast("string"), F.lit("/small.py")).alias("path"), F.col("name").alias("local"), "id")
    bound = imports.groupBy("path", "local").agg(F.min("id").alias("target"))
    methods = named.select(F.lit("py").alias("family"), "name", F.col("id").alias("target"))
    return R.resolve_calls(_calls(spark, d), named, bound, methods)


def edge_kinds(spark, d):
    kinds = N.symbols(spark, d).select(F.col("id").alias("dst"), F.col("kind").alias("target_kind"))
    return N.uses(spark, d).join(kinds, "dst").select("ord", R.edge_kind(F.when(F.col("line") == 1, "jsx").otherwise("name"), F.col("target_kind")).alias("edge"))


def reference_edges(spark, d):
    uses = N.uses(spark, d)
    edges = uses.where("kind <> 'references'").groupBy("src", "dst").agg(F.max("kind").alias("kind"))
    return R.with_references(edges, uses.where("kind = 'references'").select("src", "dst"))


def receiver_types(spark, d):
    """Receivers by order: self in a customer's scope, or names that the nearest scope gives a type."""
    orders = N.table(spark, d, "orders")
    scope = F.concat_ws(".", (F.col("o_custkey") % 10).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 7).cast("string")))
    calls = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("path"), scope.alias("scope"), F.when(F.col("o_orderkey") % 11 == 0, "self").otherwise(F.concat(F.lit("v"), (F.col("o_orderkey") % 4).cast("string"))).alias("receiver"))
    customers = N.table(spark, d, "customer")
    types = customers.select((F.col("c_custkey") % 5).alias("path"), F.when(F.col("c_custkey") % 6 == 0, "<module>").otherwise((F.col("c_custkey") % 10).cast("string")).alias("scope"), F.concat(F.lit("v"), (F.col("c_nationkey") % 4).cast("string")).alias("var"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("ord"))
    containers = calls.select("path", "scope").distinct().withColumn("container", F.concat(F.lit("C"), F.split_part("scope", F.lit("."), F.lit(1))))
    return R.receiver_type(calls, types, containers)


def dangling_references(spark, d):
    """Symbols that one side lost, and calls that still name them in their own file or through a module."""
    named = N.symbols(spark, d).select("id", "path", F.lit("py").alias("family"), F.concat("name", (F.col("size") % 9).cast("string")).alias("name"), "size")
    deleted, alive = named.where("size % 5 = 0"), named.where("size % 5 <> 0 AND size % 2 = 0").select("family", "name")
    via = F.when(F.col("id") % 3 == 0, F.concat(F.lit("src/brand"), (F.col("id") % 25).cast("string"), F.lit("/small.py")))
    return R.dangling_references(deleted, _calls(spark, d).withColumn("via", via).select("path", "family", "name", "line", "via"), alive)


def rename_aware(spark, d):
    """Head files meet the base side under their old path."""
    orders = N.table(spark, d, "orders")
    files = orders.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") + 1).alias("old_path"))
    base = orders.select(F.col("o_orderkey").alias("base_path"), "o_totalprice")
    return files.withColumn("base_path", F.coalesce("old_path", "path")).join(base, "base_path").select("path", "base_path", "o_totalprice")


def snapshot_id(spark, d):
    files = N.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("sha"))
    return T.snapshot_id(files)


def branches(spark, d):
    refs = N.table(spark, d, "orders").where("o_custkey % 50 = 0").select(F.concat("o_orderpriority", F.lit("/"), F.when(F.col("o_orderkey") % 9 == 0, "HEAD").otherwise(F.col("o_orderkey").cast("string"))).alias("name"), (F.col("o_orderstatus") == "O").alias("remote"), F.col("o_orderdate").alias("date"))
    return T.branches(refs).select("name", "remote")


def remotes(spark, d):
    return T.remotes(N.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("url"), F.col("c_custkey").alias("ord")))


def commit_ancestors(spark, d):
    """Commits are orders; parents are a half of the key, and for every third the key before."""
    return T.ancestors(_parents(spark, d), N.table(spark, d, "orders").where("o_orderkey = 1000").select(F.col("o_orderkey").alias("id")))


def _parents(spark, d):
    orders = N.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.where("id > 0").select("id", F.floor(F.col("id") / 2).alias("parent")).unionAll(orders.where("id % 3 = 0 AND id > 0").select("id", (F.col("id") - 1).alias("parent")))


def merge_base(spark, d):
    one = lambda n: N.table(spark, d, "orders").where(f"o_orderkey = {n}").select(F.col("o_orderkey").alias("id"))
    return T.merge_base(_parents(spark, d), one(1000), one(801))


def commit_count(spark, d):
    """Commits of one head that the base does not have."""
    one = lambda n: N.table(spark, d, "orders").where(f"o_orderkey = {n}").select(F.col("o_orderkey").alias("id"))
    parents = _parents(spark, d)
    held = T.history(parents)
    own = T.ancestors(parents, one(1000), held).join(T.ancestors(parents, one(801), held).select("id"), "id", "left_anti")
    return own.agg(F.count("*").alias("n"))


def worktree_counts(spark, d):
    status = N.table(spark, d, "orders").select(F.concat(F.when(F.col("o_orderstatus") == "P", "?? ").otherwise(" M "), F.col("o_orderkey").cast("string")).alias("line"))
    return T.worktree_counts(status)


def tree_entries(spark, d):
    """Documents as a tree listing; every tenth is a link, every fifteenth a tree."""
    docs = N.table(spark, d, "documents")
    listing = docs.select(F.when(F.col("doc_id") % 10 == 0, "120000").otherwise("100644").alias("mode"), F.when(F.col("doc_id") % 15 == 0, "tree").otherwise("blob").alias("type"), F.md5("text").alias("sha"), F.octet_length("text").alias("size"), F.col("doc_id").cast("string").alias("path"))
    return T.tree(listing)


def read_blobs(spark, d):
    """Contents of every second document's hash, each once; hashes that nothing has are absent."""
    docs = N.table(spark, d, "documents")
    store = docs.select(F.md5("text").alias("sha"), F.col("text").alias("content"))
    wanted = docs.where("doc_id % 2 = 0").select(F.md5("text").alias("sha")).unionAll(docs.select(F.md5(F.col("doc_id").cast("string")).alias("sha")))
    return T.blobs(wanted, store).select("sha", F.octet_length("content").alias("bytes"))


QUERIES = {
    "jn8_longest_prefix": longest_prefix,
    "jn9_suffix_module": suffix_module,
    "jn10_script_file": script_file,
    "jn11_nearest_alias": nearest_alias,
    "jn12_workspace_package": workspace_package,
    "jn13_conventional_alias": conventional_alias,
    "jn14_inherited_member": inherited_member,
    "jn16_fuzzy_methods": fuzzy_methods,
    "jn17_fuzzy_top_level": fuzzy_top_level,
    "jn18_external_receivers": external_receivers,
    "jn19_local_shadowing": local_shadowing,
    "jn20_ancestor_links": ancestor_links,
    "gr8_binding_fixpoint": binding_fixpoint,
    "gr11_resolve_calls": resolve_calls,
    "gr13_edge_kinds": edge_kinds,
    "gr13_reference_edges": reference_edges,
    "jn15_receiver_types": receiver_types,
    "gr9_dangling_references": dangling_references,
    "jn5_rename_aware": rename_aware,
    "sc12_snapshot_id": snapshot_id,
    "sc8_branches": branches,
    "sc9_remotes": remotes,
    "sc10_commit_ancestors": commit_ancestors,
    "sc10_merge_base": merge_base,
    "sc10_commit_count": commit_count,
    "sc11_worktree_counts": worktree_counts,
    "sc1_tree_entries": tree_entries,
    "sc2_read_blobs": read_blobs,
}

B = "replace(p_brand, '#', '')"
METHODS = "methods AS (SELECT 'py' AS family, CASE WHEN p_partkey % 50 = 0 THEN 'append' ELSE replace(p_name, ' ', '_') || (p_size % 9) END AS name, p_partkey AS target, 'f' || (p_partkey % 20) AS path FROM part)"
FEW = f"WITH {N.USES}, {METHODS}, few AS (SELECT name FROM methods WHERE name <> 'append' GROUP BY name HAVING count(*) <= 3)"
NAMED = f"WITH {N.SYMBOLS}, {N.USES}, named AS (SELECT id, path, name || (size % 9) AS name, size FROM symbols), calls AS (SELECT u.ord AS id, s.path, t.name, u.line FROM uses u JOIN named t ON t.id = u.dst JOIN symbols s ON s.id = u.src)"
PARENTS = "par AS (SELECT o_orderkey AS id, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey, o_orderkey - 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey > 0)"
_walk = lambda n: f"a{n} AS (SELECT o_orderkey AS id, 0 AS distance FROM orders WHERE o_orderkey = {n} UNION SELECT p.parent, distance + 1 FROM a{n} x JOIN par p ON p.id = x.id WHERE distance < 40)"
ONE, BOTH = f"WITH RECURSIVE {PARENTS}, {_walk(1000)}", f"WITH RECURSIVE {PARENTS}, {_walk(1000)}, {_walk(801)}"
OPTIONS = "list_concat([base], list_concat(list_transform(exts, lambda e: base || e), list_transform(exts, lambda e: base || '/index' || e)))"

ORACLES = {
    "jn8_longest_prefix": f"WITH n AS (SELECT DISTINCT {B} || '.' || lower(p_type) AS name FROM part WHERE p_size > 25 UNION SELECT {B} FROM part) SELECT p_partkey AS id, max(name) AS matched, upper(max(name)) AS target FROM part JOIN n ON name = {B} OR name = {B} || '.' || lower(p_type) GROUP BY 1",
    "jn9_suffix_module": f"""WITH {N.SYMBOLS}, mods AS (SELECT DISTINCT path, replace(replace(path, '.py', ''), '/', '.') AS dotted FROM symbols),
r AS (SELECT id, path AS from_path, CASE id % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'brand3.large' ELSE 'src.brand4.small' END AS spec FROM symbols),
c AS (SELECT r.id, m.path, m.dotted <> r.spec AS inexact, CASE WHEN string_split(m.path, '/')[1] <> string_split(from_path, '/')[1] THEN 0 WHEN string_split(m.path, '/')[2] <> string_split(from_path, '/')[2] THEN 1 ELSE 2 END AS near FROM r JOIN mods m ON m.dotted = r.spec OR m.dotted LIKE '%.' || r.spec)
SELECT id, path FROM (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY inexact, near DESC, length(path), path) AS k FROM c) q WHERE k = 1""",
    "jn10_script_file": f"WITH {N.PATHS}, b AS (SELECT id, CASE WHEN id % 4 = 0 THEN path WHEN id % 4 = 1 THEN regexp_replace(path, '/?[^/]*$', '') ELSE regexp_replace(path, '\\.[^./]*$', '') END AS base, {R.SCRIPT_EXT!r} AS exts FROM paths), o AS (SELECT id, unnest({OPTIONS}) AS path, unnest(range(17)) AS k FROM b) SELECT id, arg_min(path, k) AS path FROM o WHERE path IN (SELECT path FROM paths) GROUP BY id",
    "jn11_nearest_alias": f"WITH {N.PATHS}, c AS (SELECT id, CASE WHEN starts_with(path, 'src/') THEN 2 WHEN starts_with(path, 'web/') THEN 1 ELSE 0 END AS z FROM paths), o AS (SELECT id, 1 AS k, CASE z WHEN 2 THEN 'src/lib/y' WHEN 1 THEN 'web/y' ELSE 'shared/y' END AS base FROM c UNION ALL SELECT id, 2, 'shared/y' FROM c WHERE z > 0) SELECT id, k, base FROM o",
    "jn12_workspace_package": f"WITH p AS (SELECT DISTINCT '@' || lower({B}) AS name FROM part WHERE p_partkey % 5 = 0), r AS (SELECT p_partkey AS id, '@' || lower({B}) AS b, lower(p_type) AS t FROM part) SELECT id, CASE WHEN t = 'promo' THEN b || '/promo' ELSE b END AS name, 'packages/' || substr(CASE WHEN t = 'promo' THEN b || '/promo' ELSE b END, 2) AS dir, CASE WHEN t = 'promo' THEN 'index' ELSE t || '/index' END AS rest FROM r JOIN p ON p.name = r.b",
    "jn13_conventional_alias": f"WITH {N.PATHS}, o AS (SELECT id, unnest(['src/' || r, 'app/' || r, r]) AS path, unnest([0, 1, 2]) AS k FROM (SELECT id, regexp_replace(path, '^src/', '') AS r FROM paths) q) SELECT id, arg_min(path, k) AS path FROM o WHERE path IN (SELECT path FROM paths) GROUP BY id",
    "jn14_inherited_member": """WITH RECURSIVE b AS (SELECT p_partkey AS class, '0000' AS o, p_partkey // 2 AS base FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, '0001', p_partkey // 3 FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0),
w AS (SELECT p_partkey AS id, p_partkey AS class, '' AS pos, 0 AS lv FROM part UNION ALL SELECT w.id, b.base, pos || o, lv + 1 FROM w JOIN b ON b.class = w.class WHERE lv < 7)
SELECT id, arg_min(w.class, pos) AS target FROM w JOIN part p ON p.p_partkey = w.class WHERE w.class % 7 = 0 AND p.p_size % 4 = w.id % 4 GROUP BY id""",
    "jn16_fuzzy_methods": f"{FEW} SELECT u.ord AS id, m.target FROM uses u JOIN methods t ON t.target = u.dst JOIN few f ON f.name = t.name JOIN methods m ON m.name = t.name",
    "jn17_fuzzy_top_level": f"WITH {N.USES}, {METHODS} SELECT u.ord AS id, m.target FROM uses u JOIN methods t ON t.target = u.dst JOIN methods m ON m.name = t.name WHERE m.path <> 'f' || (u.src % 20) QUALIFY count(*) OVER (PARTITION BY u.ord) <= 3",
    "jn18_external_receivers": f"WITH {N.USES} SELECT ord AS id FROM uses WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = src % 40 AND n_regionkey = dst % 9)",
    "jn19_local_shadowing": f"WITH {N.USES} SELECT ord AS id FROM uses WHERE dst % 2 = 0 OR NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = src % 40 AND n_regionkey = dst % 9)",
    "jn20_ancestor_links": f"WITH {N.USES} SELECT ord FROM uses WHERE NOT (src % 2 = dst % 2 AND src % 2 = 0 AND dst % 4 <> 0 AND src % 3 = dst % 3)",
    "gr8_binding_fixpoint": """WITH RECURSIVE w AS (SELECT p_partkey AS path, p_partkey AS now, 0 AS n FROM part UNION ALL
  SELECT path, CASE now % 1000 WHEN 501 THEN now + 1 WHEN 502 THEN now - 1 ELSE now // 3 END, n + 1 FROM w WHERE now % 9 <> 0 AND n < 8)
SELECT w.path, w.now AS target FROM w JOIN part ON p_partkey = now WHERE now % 9 = 0""",
    "gr11_resolve_calls": f"""{NAMED}, own AS (SELECT path, name, min(id) AS t FROM named GROUP BY 1, 2),
imp AS (SELECT 'src/brand' || (id % 25) || '/small.py' AS path, name, min(id) AS t FROM named WHERE id % 4 = 0 GROUP BY 1, 2),
few AS (SELECT name FROM named GROUP BY name HAVING count(*) <= 3),
r AS (SELECT c.id, c.name, o.t AS a, i.t AS b FROM calls c LEFT JOIN own o ON o.path = c.path AND o.name = c.name LEFT JOIN imp i ON i.path = c.path AND i.name = c.name)
SELECT id, coalesce(a, b) AS target, false AS fuzzy, CASE WHEN a IS NOT NULL THEN 'local' ELSE 'import' END AS how FROM r WHERE coalesce(a, b) IS NOT NULL
UNION ALL SELECT r.id, n.id, true, 'guess' FROM r JOIN few f ON f.name = r.name JOIN named n ON n.name = r.name WHERE a IS NULL AND b IS NULL""",
    "gr13_edge_kinds": f"WITH {N.SYMBOLS}, {N.USES} SELECT ord, CASE WHEN line = 1 THEN 'renders' WHEN s.kind = 'class' THEN 'instantiates' ELSE 'calls' END AS edge FROM uses JOIN symbols s ON s.id = dst",
    "gr13_reference_edges": f"WITH {N.USES}, e AS (SELECT src, dst, max(kind) AS kind FROM uses WHERE kind <> 'references' GROUP BY 1, 2) SELECT * FROM e UNION ALL SELECT DISTINCT src, dst, 'references' FROM uses u WHERE kind = 'references' AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = u.src AND e.dst = u.dst)",
    "jn15_receiver_types": """WITH c AS (SELECT o_orderkey AS id, o_custkey % 5 AS path, (o_custkey % 10)::VARCHAR AS top, CASE WHEN o_orderkey % 11 = 0 THEN 'self' ELSE 'v' || (o_orderkey % 4) END AS r FROM orders),
t AS (SELECT c_custkey % 5 AS path, CASE WHEN c_custkey % 6 = 0 THEN '<module>' ELSE (c_custkey % 10)::VARCHAR END AS scope, 'v' || (c_nationkey % 4) AS var, arg_min(c_mktsegment, c_custkey) AS type FROM customer GROUP BY 1, 2, 3)
SELECT id, type FROM (SELECT c.id, CASE WHEN r = 'self' THEN 'C' || top ELSE coalesce(a.type, b.type) END AS type FROM c LEFT JOIN t a ON a.path = c.path AND a.scope = c.top AND a.var = r LEFT JOIN t b ON b.path = c.path AND b.scope = '<module>' AND b.var = r) q WHERE type IS NOT NULL""",
    "gr9_dangling_references": f"""{NAMED}, gone AS (SELECT * FROM named WHERE size % 5 = 0 AND name NOT IN (SELECT name FROM named WHERE size % 5 <> 0 AND size % 2 = 0)),
h AS (SELECT DISTINCT g.id, c.path, c.line FROM gone g JOIN calls c ON c.name = g.name WHERE c.path = g.path OR (c.id % 3 = 0 AND 'src/brand' || (c.id % 25) || '/small.py' = g.path))
SELECT id, path, line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path, line) AS k FROM h) q WHERE k <= 25""",
    "jn5_rename_aware": "SELECT o.o_orderkey AS path, b.o_orderkey AS base_path, b.o_totalprice FROM orders o JOIN orders b ON b.o_orderkey = CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_orderkey + 1 ELSE o.o_orderkey END",
    "sc12_snapshot_id": "SELECT count(*) AS files, substr(sha256(count(*) || ':' || sum(('0x' || substr(sha256(doc_id || chr(0) || md5(text)), 1, 15))::BIGINT)), 1, 40) AS id FROM documents",
    "sc8_branches": "SELECT name, remote FROM (SELECT o_orderpriority || '/' || CASE WHEN o_orderkey % 9 = 0 THEN 'HEAD' ELSE o_orderkey::VARCHAR END AS name, o_orderstatus = 'O' AS remote FROM orders WHERE o_custkey % 50 = 0) q WHERE name NOT LIKE '%/HEAD'",
    "sc9_remotes": "SELECT c_mktsegment AS name, arg_min(c_name, c_custkey) AS url FROM customer GROUP BY 1",
    "sc10_commit_ancestors": f"{ONE} SELECT id, min(distance) AS distance FROM a1000 GROUP BY id",
    "sc10_merge_base": f"{BOTH}, c AS (SELECT DISTINCT id FROM a1000 WHERE id IN (SELECT id FROM a801)) SELECT min(id) AS id FROM c WHERE id NOT IN (SELECT parent FROM par JOIN c USING (id))",
    "sc10_commit_count": f"{BOTH} SELECT count(DISTINCT id) AS n FROM a1000 WHERE id NOT IN (SELECT id FROM a801)",
    "sc11_worktree_counts": "SELECT count(*) FILTER (o_orderstatus <> 'P') AS tracked, count(*) FILTER (o_orderstatus = 'P') AS untracked FROM orders",
    "sc1_tree_entries": "SELECT doc_id::VARCHAR AS path, md5(text) AS sha, strlen(text) AS size FROM documents WHERE doc_id % 15 <> 0 AND doc_id % 10 <> 0",
    "sc2_read_blobs": "SELECT DISTINCT md5(text) AS sha, strlen(text) AS bytes FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)",
}
