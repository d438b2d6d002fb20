"""Graph queries over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.operators import edges as E
from facetline.operators import jobs as J
from facetline.operators import planning as P
from facetline.operators import serving as S
from facetline.operators import traversal as T
from facetline.operators.staging import materialise
from facetline.plans import entities as N

GRAPH = N.GRAPH


def _sets(spark: SparkSession, d: str):
    """symbols, edges and changes, written once for a snapshot of the tables, and the live core."""
    written = lambda: [materialise(rows(spark, d), name) for name, rows in (("symbols", N.symbols), ("edges", N.edges), ("changes", N.changes))]
    symbols, edges, changes = J.recent(spark, "graph", J.stamp(spark, f"{d}/part.parquet", f"{d}/lineitem.parquet"), written)
    core = changes.where("category <> 'test' AND kind <> 'module'").select("id")
    return symbols, edges, changes, core


def edge_merge(spark, d):
    return E.merge_edges(N.uses(spark, d)).select("src", "dst", "kind", "fuzzy", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def degrees(spark, d):
    return E.degrees(N.symbols(spark, d), N.edges(spark, d))


def edge_filter(spark, d):
    return N.edges(spark, d).where(E.edge_ok(["calls", "inherits"], fuzzy=False)).select("src", "dst", "kind")


def node_filter(spark, d):
    symbols = N.symbols(spark, d)
    kept = symbols.where(~F.col("category").isin("test")).select("id")
    return E.induced(N.edges(spark, d), kept).select("src", "dst")


def node_projection(spark, d):
    symbols, edges, changes, _ = _sets(spark, d)
    rows = symbols.join(E.degrees(symbols, edges), "id").join(changes.select("id", "status"), "id", "left")
    label = F.when(F.col("kind") == "module", F.col("name")).otherwise(F.col("qual"))
    return rows.select("id", label.alias("label"), "path", "kind", "category", "start", "end", "parent", "callers", "callees", F.col("status").alias("change"), F.col("status").isNotNull().alias("in_pr"))


def overview_module_filter(spark, d):
    symbols, edges, changes, _ = _sets(spark, d)
    inside = E.induced(edges, changes.select("id"))
    ends = inside.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    return changes.join(ends, "id", "left").where("kind <> 'module' OR linked").select("id", "kind")


def neighborhood(spark, d):
    symbols, edges, _, _ = _sets(spark, d)
    walk, _ = T.neighborhood(symbols, edges, [0, 1, 2, 10], depth_in=2, depth_out=3, max_nodes=10**7, kinds=["calls", "inherits", "references"], fuzzy=True, node_ok=F.col("category") != "test")
    return T.roles(walk)


def neighborhood_capped(spark, d):
    symbols, edges, _, _ = _sets(spark, d)
    return T.roles(T.neighborhood(symbols, edges, [0, 1, 2, 10], depth_in=2, depth_out=2, max_nodes=60)[0])


def overview(spark, d):
    symbols, edges, _, core = _sets(spark, d)
    return T.overview(core, symbols, edges, max_nodes=10**6, fuzzy=False)


def overview_capped(spark, d):
    symbols, edges, _, core = _sets(spark, d)
    return T.overview(core, symbols, edges, max_nodes=60, neighbors=True)


def top_connected(spark, d):
    _, edges, _, core = _sets(spark, d)
    return T.top_connected(core, edges, 25)


def components(spark, d):
    symbols, edges, _, core = _sets(spark, d)
    return T.components(core, E.induced(edges.where("NOT fuzzy"), core))


def bridges(spark, d):
    _, edges, changes, core = _sets(spark, d)
    return E.bridges(edges.where("NOT fuzzy"), core, changes)


def bridge_nodes(spark, d):
    _, edges, _, core = _sets(spark, d)
    return E.bridge_nodes(edges.where("NOT fuzzy"), core).withColumnRenamed("x", "id")


def induced(spark, d):
    _, edges, changes, _ = _sets(spark, d)
    return E.induced(edges, changes.select("id")).select("src", "dst", "kind", "fuzzy")


def sibling_chain(spark, d):
    symbols, _, _, core = _sets(spark, d)
    return P.sibling_chain(symbols, core)


def link_weights(spark, d):
    symbols, edges, changes, core = _sets(spark, d)
    return P.link_weights(core, symbols, edges, changes)


def _clusters(spark, d):
    symbols, edges, changes, core = _sets(spark, d)
    weights = materialise(P.link_weights(core, symbols, edges, changes), "link-weights")
    return symbols, edges, changes, core, materialise(P.core_clusters(core, weights), "clusters")


def core_clusters(spark, d):
    return _clusters(spark, d)[4]


def satellite_votes(spark, d):
    symbols, edges, changes, core = _sets(spark, d)
    roots = T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster")
    satellites = changes.join(core, "id", "left_anti").select("id", (F.col("kind") == "module").alias("skip_refs"))
    return P.votes(satellites, roots, edges, changes.select("id"), core)


def satellite_owner(spark, d):
    symbols, edges, changes, core = _sets(spark, d)
    roots = materialise(T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster"), "roots")
    satellites = changes.join(core, "id", "left_anti").select("id", (F.col("kind") == "module").alias("skip_refs"))
    return P.elected(P.votes(satellites, roots, edges, changes.select("id"), core), roots)


def loose_tests(spark, d):
    """Test clusters of their own: tests without a link to core, joined over exact links and parents; named t:<smallest id>."""
    symbols, edges, changes, core = _sets(spark, d)
    owned = satellite_owner(spark, d).select("id")
    loose = materialise(changes.where("category = 'test' AND kind <> 'module'").join(owned, "id", "left_anti").select("id", "parent"), "loose")
    links = E.induced(edges.where("NOT fuzzy"), loose).select("src", "dst")
    family = loose.where("parent IS NOT NULL").groupBy("parent").agg(F.min("id").alias("dst")).join(loose, "parent").select(F.col("id").alias("src"), "dst")
    return T.components(loose, links.unionAll(family)).select("id", F.concat(F.lit("t:"), F.col("root").cast("string")).alias("cluster"))


def file_owner_votes(spark, d):
    """Module code without votes of its own follows the cluster that most symbols of its file have."""
    symbols, edges, changes, core = _sets(spark, d)
    roots = materialise(T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster"), "roots")
    voted = P.votes(changes.where("kind = 'module'").select("id", F.lit(True).alias("skip_refs")), roots, edges, changes.select("id"), core).select("id").distinct()
    left = changes.where("kind = 'module'").join(voted, "id", "left_anti").select("id", "path")
    by_file = roots.join(changes.select("id", "path"), "id").groupBy("path", "cluster").agg(F.count("*").alias("votes"))
    return left.join(P.elected_by_file(by_file, roots), "path").select("id", "cluster")


def risk(spark, d):
    symbols, edges, changes, _ = _sets(spark, d)
    rows = P.risk(changes.select("id"), symbols, edges, changes.select("path").distinct())
    return rows.withColumn("test_callers", F.array_join(F.col("test_callers").cast("array<string>"), ","))


def entry_points(spark, d):
    symbols, edges, changes, core = _sets(spark, d)
    roots = materialise(T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster"), "roots")
    members = changes.select("id", "path", "start", (F.col("additions") + F.col("deletions")).alias("churn"), F.lit(True).alias("counts"))
    return P.entry_points(roots, P.adjacency(core, edges, changes), members)


def reading_order(spark, d):
    """Three segments, as the id decides."""
    symbols, edges, changes, core = _sets(spark, d)
    roots = materialise(T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster"), "roots")
    links = materialise(P.adjacency(core, edges, changes), "adjacency")
    segment = F.when(F.col("id") % 7 == 1, 1).when(F.col("id") % 5 == 1, 2).otherwise(0)
    members = changes.select("id", "path", "start", (F.col("additions") + F.col("deletions")).alias("churn"), F.lit(True).alias("counts"), segment.alias("segment"))
    return P.reading_order(roots, links, members, materialise(P.entry_points(roots, links, members), "entries"))


def adjacency(spark, d):
    _, edges, changes, core = _sets(spark, d)
    return P.adjacency(core, edges, changes)


def cluster_statistics(spark, d):
    symbols, edges, changes, core = _sets(spark, d)
    roots = T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster")
    order = roots.withColumn("position", F.col("id"))
    made = P.cluster_table(order, changes)
    return made.select("id", "cluster", "title", "symbols", "additions", "deletions", F.array_join("files", ",").alias("files"))


def category_shares(spark, d):
    clusters = N.changes(spark, d).select(F.col("path").alias("cluster"), "kind").withColumnRenamed("kind", "category")
    return S.shares(clusters)


def link_partners(spark, d):
    """Distinct callers and callees of the changed symbols of each file."""
    _, edges, changes, _ = _sets(spark, d)
    own = changes.select("id", "path")
    ends = edges.join(own.withColumnRenamed("id", "dst"), "dst").select("path", F.col("src").alias("caller"), F.lit(None).cast("long").alias("callee")).unionAll(edges.join(own.withColumnRenamed("id", "src"), "src").select("path", F.lit(None).cast("long"), "dst"))
    return ends.groupBy("path").agg(F.count_distinct("caller").alias("callers"), F.count_distinct("callee").alias("callees"))


def client_highlight(spark, d):
    """The closed neighbourhood of the changed classes."""
    _, edges, changes, _ = _sets(spark, d)
    chosen = changes.where("kind = 'class'").select("id")
    out = edges.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    inn = edges.join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return chosen.unionAll(out).unionAll(inn).distinct()


def index_stats(spark, d):
    symbols, edges, changes, _ = _sets(spark, d)
    count = lambda t, name: t.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(symbols, "symbols").unionAll(count(edges, "edges")).unionAll(count(changes, "changes"))


def graph_legend(spark, d):
    symbols, _, changes, _ = _sets(spark, d)
    return symbols.select(F.lit("category").alias("what"), F.col("category").alias("value")).unionAll(changes.select(F.lit("change"), "status")).distinct()


def untested(spark, d):
    """Changed source symbols without a test within two hops, no module code."""
    symbols, edges, changes, core = _sets(spark, d)
    return P.risk(core, symbols, edges, changes.select("path").distinct()).where("NOT tested").select("id")


def search_symbols(spark, d):
    return S.search(N.symbols(spark, d), " Red_W").select("id", "score", "qual")


def ancestor_walk(spark, d):
    """All containers of every symbol, where that of each is the one with a third of its key."""
    return T.ancestors(N.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("parent")))


def wide_reach(spark, d):
    symbols, edges, changes, _ = _sets(spark, d)
    return S.wide_reach(P.risk(changes.select("id"), symbols, edges, changes.select("path").distinct()))


def cluster_scope(spark, d):
    """The changed files of the largest cluster, in its order."""
    symbols, edges, changes, core = _sets(spark, d)
    roots = T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster")
    made = P.cluster_table(roots.withColumn("position", F.col("id")), changes).where("id = 'c1'")
    return S.cluster_scope(changes, made)


def payload_order(spark, d):
    return S.payload_order(N.changes(spark, d).select("path", "start", "id", "status"), "path", "start", "id")


QUERIES = {
    "ag3_edge_merge": edge_merge,
    "ag4_degrees": degrees,
    "pf8_edge_filter": edge_filter,
    "pf9_node_filter": node_filter,
    "pf10_node_projection": node_projection,
    "pf20_hide_isolated_modules": overview_module_filter,
    "gr1_neighborhood": neighborhood,
    "sl3_neighborhood_capped": neighborhood_capped,
    "gr2_overview": overview,
    "sl5_overview_capped": overview_capped,
    "sl2_top_connected": top_connected,
    "gr3_components": components,
    "jn21_bridges": bridges,
    "sl4_bridge_nodes": bridge_nodes,
    "st3_induced_subgraph": induced,
    "wn2_sibling_chain": sibling_chain,
    "gr4_link_weights": link_weights,
    "gr5_core_clusters": core_clusters,
    "ag10_satellite_votes": satellite_votes,
    "ag11_vote_winner": satellite_owner,
    "gr7_loose_tests": loose_tests,
    "ag12_file_owner_votes": file_owner_votes,
    "gr10_risk": risk,
    "pf17_untested": untested,
    "sl12_entry_points": entry_points,
    "sl11_reading_order": reading_order,
    "gr4_adjacency": adjacency,
    "ag7_cluster_statistics": cluster_statistics,
    "ag15_category_shares": category_shares,
    "ag18_link_partners": link_partners,
    "gr15_client_highlight": client_highlight,
    "ag19_index_stats": index_stats,
    "rp7_graph_legend": graph_legend,
    "sl1_search": search_symbols,
    "gr14_ancestors": ancestor_walk,
    "pf16_wide_reach": wide_reach,
    "pf18_cluster_scope": cluster_scope,
    "sl9_payload_order": payload_order,
}

CORE = f"{GRAPH}, core AS (SELECT id FROM changes WHERE category <> 'test' AND kind <> 'module')"
EXACT = f"{CORE}, exact AS (SELECT * FROM edges WHERE NOT fuzzy), inner_links AS (SELECT src, dst FROM exact WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core))"
ROOTS = EXACT.replace("WITH ", "WITH RECURSIVE ", 1) + """,
both_ways AS (SELECT src AS u, dst AS v FROM inner_links UNION SELECT dst, src FROM inner_links),
reach AS (SELECT id AS u, id AS v FROM core UNION SELECT reach.u, b.v FROM reach JOIN both_ways b ON b.u = reach.v),
roots AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY u)"""
VOTES = ROOTS + """,
sat AS (SELECT id, kind = 'module' AS skip_refs FROM changes WHERE id NOT IN (SELECT id FROM core)),
ballots AS (
  SELECT s.id, e.dst AS b, 2 AS n FROM sat s JOIN exact e ON e.src = s.id WHERE NOT skip_refs OR e.kind <> 'references'
  UNION ALL SELECT s.id, e.src, 2 FROM sat s JOIN exact e ON e.dst = s.id JOIN changes c ON c.id = e.src WHERE NOT skip_refs OR e.kind <> 'references'
  UNION ALL SELECT s.id, f.dst, 1 FROM sat s JOIN exact e ON e.src = s.id JOIN exact f ON f.src = e.dst WHERE (NOT skip_refs OR e.kind <> 'references') AND e.dst NOT IN (SELECT id FROM changes) AND f.dst <> s.id),
tally AS (SELECT s.id, r.root AS cluster, sum(n)::BIGINT AS votes FROM ballots s JOIN roots r ON r.id = s.b GROUP BY 1, 2)"""
ADJ = """,
adj AS (SELECT src AS a, dst AS b FROM inner_links UNION
  SELECT e.src, f.dst FROM exact e JOIN exact f ON f.src = e.dst JOIN core c ON c.id = e.src JOIN core d ON d.id = f.dst WHERE e.src <> f.dst AND e.dst NOT IN (SELECT id FROM changes) AND e.dst NOT IN (SELECT id FROM core))"""
ENTRIES = ADJ + """,
inside AS (SELECT a, b, x.root FROM adj JOIN roots x ON x.id = a JOIN roots y ON y.id = b WHERE x.root = y.root AND a <> b),
rated AS (SELECT r.root AS cluster, c.id, c.id IN (SELECT b FROM inside) AS called, (SELECT count(DISTINCT b) FROM inside WHERE a = c.id) AS deg, c.additions + c.deletions AS churn, c.path, c.start FROM roots r JOIN changes c ON c.id = r.id),
marked AS (SELECT *, bool_or(NOT called) OVER (PARTITION BY cluster) AS any_free, row_number() OVER (PARTITION BY cluster ORDER BY deg DESC, churn DESC, path, start, id) AS best FROM rated),
entries AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY deg DESC, churn DESC, path, start, id) AS rank FROM marked WHERE (any_free AND NOT called) OR (NOT any_free AND best = 1))"""

ORACLES = {
    "ag3_edge_merge": f"WITH {N.USES}, {N.EDGES}, l AS (SELECT src, dst, line, min(ord) AS ord FROM uses GROUP BY 1, 2, 3) SELECT e.*, (SELECT array_to_string(list(line ORDER BY ord)[1:25], ',') FROM l WHERE l.src = e.src AND l.dst = e.dst) AS lines FROM edges e",
    "ag4_degrees": f"{GRAPH} SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS callers, (SELECT count(*) FROM edges WHERE src = id) AS callees FROM symbols",
    "pf8_edge_filter": f"{GRAPH} SELECT src, dst, kind FROM edges WHERE kind IN ('calls', 'inherits') AND NOT fuzzy",
    "pf9_node_filter": f"{GRAPH} SELECT src, dst FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.category <> 'test' AND b.category <> 'test'",
    "pf10_node_projection": f'{GRAPH} SELECT s.id, CASE WHEN s.kind = \'module\' THEN s.name ELSE s.qual END AS label, s.path, s.kind, s.category, s.start, s."end", s.parent, (SELECT count(*) FROM edges WHERE dst = s.id) AS callers, (SELECT count(*) FROM edges WHERE src = s.id) AS callees, c.status AS change, c.id IS NOT NULL AS in_pr FROM symbols s LEFT JOIN changes c ON c.id = s.id',
    "pf20_hide_isolated_modules": f"{GRAPH}, i AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM changes) AND dst IN (SELECT id FROM changes)) SELECT id, kind FROM changes WHERE kind <> 'module' OR id IN (SELECT src FROM i) OR id IN (SELECT dst FROM i)",
    "gr1_neighborhood": GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """,
focus AS (SELECT id FROM symbols WHERE id IN (0, 1, 2, 10) UNION SELECT s.id FROM symbols s JOIN symbols p ON p.id = s.parent WHERE p.id IN (0, 1, 2, 10) AND p.kind IN ('class', 'object', 'interface')),
o1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM focus) AND dst IN (SELECT id FROM symbols WHERE category <> 'test') AND dst NOT IN (SELECT id FROM focus)),
v1 AS (SELECT id FROM focus UNION SELECT id FROM o1),
i1 AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM focus) AND src IN (SELECT id FROM symbols WHERE category <> 'test') AND src NOT IN (SELECT id FROM v1)),
v2 AS (SELECT id FROM v1 UNION SELECT id FROM i1),
o2 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM o1) AND dst IN (SELECT id FROM symbols WHERE category <> 'test') AND dst NOT IN (SELECT id FROM v2)),
v3 AS (SELECT id FROM v2 UNION SELECT id FROM o2),
i2 AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM i1) AND src IN (SELECT id FROM symbols WHERE category <> 'test') AND src NOT IN (SELECT id FROM v3)),
v4 AS (SELECT id FROM v3 UNION SELECT id FROM i2),
o3 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM o2) AND dst IN (SELECT id FROM symbols WHERE category <> 'test') AND dst NOT IN (SELECT id FROM v4))
SELECT id, 0 AS depth, 'focus' AS role FROM focus UNION ALL SELECT id, 1, 'callee' FROM o1 UNION ALL SELECT id, -1, 'caller' FROM i1 UNION ALL SELECT id, 2, 'callee' FROM o2 UNION ALL SELECT id, -2, 'caller' FROM i2 UNION ALL SELECT id, 3, 'callee' FROM o3""",
    "gr2_overview": f"{EXACT}, br AS (SELECT DISTINCT e.dst AS id FROM exact e JOIN exact f ON f.src = e.dst WHERE e.src IN (SELECT id FROM core) AND f.dst IN (SELECT id FROM core) AND e.src <> f.dst AND e.dst NOT IN (SELECT id FROM core)), r AS (SELECT id, 'changed' AS role FROM core UNION ALL SELECT id, 'bridge' FROM br), i AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)) SELECT r.id, r.role FROM r JOIN symbols s ON s.id = r.id WHERE s.kind <> 'module' OR r.id IN (SELECT src FROM i) OR r.id IN (SELECT dst FROM i)",
    "sl2_top_connected": f"{CORE}, i AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)) SELECT id, (SELECT count(*) FROM i WHERE src = id) + (SELECT count(*) FROM i WHERE dst = id) AS links FROM core ORDER BY links DESC, id LIMIT 25",
    "gr3_components": f"{ROOTS} SELECT id, root FROM roots",
    "jn21_bridges": f"{EXACT} SELECT DISTINCT e.src AS a, e.dst AS x, f.dst AS b FROM exact e JOIN exact f ON f.src = e.dst WHERE e.src IN (SELECT id FROM core) AND f.dst IN (SELECT id FROM core) AND e.src <> f.dst AND e.dst NOT IN (SELECT id FROM changes)",
    "sl4_bridge_nodes": f"{EXACT} SELECT DISTINCT e.dst AS id FROM exact e JOIN exact f ON f.src = e.dst WHERE e.src IN (SELECT id FROM core) AND f.dst IN (SELECT id FROM core) AND e.src <> f.dst AND e.dst NOT IN (SELECT id FROM core)",
    "st3_induced_subgraph": f"{GRAPH} SELECT src, dst, kind, fuzzy FROM edges WHERE src IN (SELECT id FROM changes) AND dst IN (SELECT id FROM changes)",
    "wn2_sibling_chain": f"{CORE} SELECT src, dst FROM (SELECT s.id AS src, lead(s.id) OVER (PARTITION BY parent ORDER BY path, start, s.id) AS dst FROM symbols s JOIN core c ON c.id = s.id WHERE parent IS NOT NULL) q WHERE dst IS NOT NULL",
    "gr4_link_weights": f"""{EXACT}, l AS (
  SELECT src, dst, CASE WHEN kind = 'references' THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS w FROM exact WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)
  UNION ALL SELECT e.src, f.dst, 1.0 FROM exact e JOIN exact f ON f.src = e.dst WHERE e.src IN (SELECT id FROM core) AND f.dst IN (SELECT id FROM core) AND e.src <> f.dst AND e.dst NOT IN (SELECT id FROM changes)
  UNION ALL SELECT s.id, s.parent, 1.0 FROM symbols s WHERE s.id IN (SELECT id FROM core) AND s.parent IN (SELECT id FROM core)
  UNION ALL SELECT src, dst, 1.0 FROM (SELECT s.id AS src, lead(s.id) OVER (PARTITION BY parent ORDER BY path, start, s.id) AS dst FROM symbols s JOIN core c ON c.id = s.id WHERE parent IS NOT NULL) q WHERE dst IS NOT NULL)
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS weight FROM l WHERE src <> dst GROUP BY 1, 2""",
    "ag10_satellite_votes": f"{VOTES} SELECT * FROM tally",
    "ag11_vote_winner": f"{VOTES}, z AS (SELECT root, count(*) AS size FROM roots GROUP BY root) SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY votes DESC, size DESC, cluster) AS k FROM tally JOIN z ON z.root = cluster) q WHERE k = 1",
    "gr7_loose_tests": f"""{VOTES}, loose AS (SELECT id, parent FROM changes WHERE category = 'test' AND kind <> 'module' AND id NOT IN (SELECT id FROM tally)),
tl AS (SELECT src AS u, dst AS v FROM exact WHERE src IN (SELECT id FROM loose) AND dst IN (SELECT id FROM loose) UNION SELECT a.id, b.id FROM loose a JOIN loose b ON a.parent = b.parent),
tb AS (SELECT u, v FROM tl UNION SELECT v, u FROM tl), tr AS (SELECT id AS u, id AS v FROM loose UNION SELECT tr.u, tb.v FROM tr JOIN tb ON tb.u = tr.v)
SELECT u AS id, 't:' || min(v) AS cluster FROM tr GROUP BY u""",
    "ag12_file_owner_votes": f"""{VOTES}, z AS (SELECT root, count(*) AS size FROM roots GROUP BY root),
m AS (SELECT id, path FROM changes WHERE kind = 'module' AND id NOT IN (SELECT id FROM tally)),
f AS (SELECT c.path, r.root AS cluster, count(*) AS votes FROM roots r JOIN changes c ON c.id = r.id GROUP BY 1, 2)
SELECT id, cluster FROM (SELECT m.id, f.cluster, row_number() OVER (PARTITION BY m.id ORDER BY votes DESC, size DESC, f.cluster) AS k FROM m JOIN f ON f.path = m.path JOIN z ON z.root = f.cluster) q WHERE k = 1""",
    "gr10_risk": f"""{GRAPH}, t AS (SELECT e.src AS test, e.dst AS t_to, e.fuzzy FROM edges e JOIN symbols s ON s.id = e.src WHERE s.category = 'test'),
cand AS (SELECT c.id, t.test, 1 AS hop, t.fuzzy AS f1, lpad(t.test::VARCHAR, 20, '0') AS c1, false AS f2 FROM changes c JOIN t ON t.t_to = c.id
  UNION ALL SELECT c.id, t.test, 2, e.fuzzy, lpad(e.src::VARCHAR, 20, '0'), t.fuzzy FROM changes c JOIN edges e ON e.dst = c.id JOIN t ON t.t_to = e.src),
firsts AS (SELECT id, test, min(struct_pack(hop := hop, f1 := f1, c1 := c1, f2 := f2)) AS o FROM cand WHERE test <> id GROUP BY id, test),
ranked AS (SELECT id, test, row_number() OVER (PARTITION BY id ORDER BY o, test) AS k FROM firsts),
named AS (SELECT id, array_to_string(list(test ORDER BY k), ',') AS tests FROM ranked WHERE k <= 5 GROUP BY id)
SELECT c.id, (SELECT count(*) FROM edges WHERE dst = c.id) AS callers,
  (SELECT count(*) FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst = c.id AND s.path NOT IN (SELECT path FROM changes)) AS external_callers,
  (SELECT count(*) FROM edges WHERE src = c.id) AS fan_out, n.id IS NOT NULL AS tested, coalesce(n.tests, '') AS test_callers
FROM changes c LEFT JOIN named n ON n.id = c.id""",
    "pf17_untested": f"""{CORE}, t AS (SELECT e.src AS test, e.dst AS t_to FROM edges e JOIN symbols s ON s.id = e.src WHERE s.category = 'test')
SELECT id FROM core WHERE id NOT IN (SELECT t_to FROM t WHERE test <> t_to) AND id NOT IN (SELECT e.dst FROM edges e JOIN t ON t.t_to = e.src WHERE t.test <> e.dst)""",
    "sl12_entry_points": f"{ROOTS}{ENTRIES} SELECT cluster, id, rank FROM entries",
    "gr4_adjacency": f"{EXACT}{ADJ} SELECT a, b FROM adj",
    "sl11_reading_order": f"""{ROOTS}{ENTRIES},
sg AS (SELECT r.root AS cluster, c.id, c.path, c.start, CASE WHEN c.id % 7 = 1 THEN 1 WHEN c.id % 5 = 1 THEN 2 ELSE 0 END AS segment FROM roots r JOIN changes c ON c.id = r.id),
il AS (SELECT DISTINCT i.a, i.b FROM inside i JOIN sg x ON x.id = i.a JOIN sg y ON y.id = i.b WHERE i.a <> i.b AND x.cluster = y.cluster AND x.segment = y.segment),
pl AS (SELECT sg.*, row_number() OVER (PARTITION BY sg.cluster, segment ORDER BY CASE WHEN segment <> 1 THEN e.rank END NULLS LAST, sg.id IN (SELECT b FROM il), path, start, sg.id) AS place,
    lpad((row_number() OVER (PARTITION BY sg.cluster ORDER BY path, start, sg.id))::VARCHAR, 5, '0') AS k FROM sg LEFT JOIN entries e ON e.id = sg.id),
-- the first root that reaches each, and from there the least path of keys of fewest steps
rc AS (SELECT place, id FROM pl UNION SELECT rc.place, il.b FROM rc JOIN il ON il.a = rc.id),
rt AS (SELECT pl.*, m.root FROM pl JOIN (SELECT id, min(place) AS root FROM rc GROUP BY id) m USING (id)),
pw AS (SELECT id, 0 AS level, k AS way FROM rt WHERE place = root
  UNION SELECT b.id, pw.level + 1, min(pw.way || b.k) FROM pw JOIN rt a ON a.id = pw.id JOIN il ON il.a = a.id JOIN rt b ON b.id = il.b AND b.root = a.root WHERE pw.level < 60 GROUP BY b.id, pw.level + 1),
fw AS (SELECT id, min(level) AS level, arg_min(way, level) AS way FROM pw GROUP BY id)
SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY segment, root, level, way) AS position FROM rt JOIN fw USING (id)""",
    "ag7_cluster_statistics": f"""{ROOTS}, x AS (SELECT r.root AS cluster, c.* FROM roots r JOIN changes c ON c.id = r.id),
s AS (SELECT cluster, count(*) AS symbols, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, arg_min(name, id) AS title FROM x GROUP BY cluster),
f AS (SELECT cluster, array_to_string(list(path ORDER BY m), ',') AS files FROM (SELECT cluster, path, min(id) AS m FROM x GROUP BY 1, 2) q GROUP BY cluster)
SELECT 'c' || row_number() OVER (ORDER BY symbols DESC, additions + deletions DESC, title, s.cluster) AS id, s.*, f.files FROM s JOIN f ON f.cluster = s.cluster""",
    "ag15_category_shares": f"{GRAPH} SELECT path AS cluster, kind AS category, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY path) AS share FROM changes GROUP BY path, kind",
    "ag18_link_partners": f"{GRAPH} SELECT p.path, (SELECT count(DISTINCT src) FROM edges JOIN changes c ON c.id = dst WHERE c.path = p.path) AS callers, (SELECT count(DISTINCT dst) FROM edges JOIN changes c ON c.id = src WHERE c.path = p.path) AS callees FROM (SELECT DISTINCT path FROM changes JOIN edges ON id = src OR id = dst) p",
    "gr15_client_highlight": f"{GRAPH}, k AS (SELECT id FROM changes WHERE kind = 'class') SELECT id FROM k UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM k) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM k)",
    "ag19_index_stats": f"{GRAPH} SELECT 'symbols' AS what, count(*) AS n FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'changes', count(*) FROM changes",
    "rp7_graph_legend": f"{GRAPH} SELECT 'category' AS what, category AS value FROM symbols UNION SELECT 'change', status FROM changes",
    "sl1_search": f"{GRAPH} SELECT id, score, qual FROM (SELECT *, CASE WHEN lower(name) = 'red_w' THEN 0 WHEN starts_with(lower(name), 'red_w') THEN 1 WHEN contains(lower(qual), 'red_w') THEN 2 WHEN contains(lower(path), 'red_w') THEN 3 END AS score FROM symbols WHERE kind <> 'module') q WHERE score IS NOT NULL ORDER BY score, length(qual), path, id LIMIT 40",
    "gr14_ancestors": "WITH RECURSIVE u AS (SELECT p_partkey AS id, p_partkey // 3 AS ancestor, 1 AS depth FROM part WHERE p_partkey > 0 UNION ALL SELECT id, ancestor // 3, depth + 1 FROM u WHERE ancestor > 0) SELECT * FROM u",
    "pf16_wide_reach": f"{GRAPH} SELECT * FROM (SELECT c.id, (SELECT count(*) FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst = c.id AND s.path NOT IN (SELECT path FROM changes)) AS external_callers FROM changes c) q WHERE external_callers >= 3 ORDER BY external_callers DESC, id LIMIT 6",
    "pf18_cluster_scope": f"""{ROOTS}, x AS (SELECT r.root AS cluster, c.* FROM roots r JOIN changes c ON c.id = r.id),
s AS (SELECT cluster FROM (SELECT cluster, count(*) AS n, sum(additions) + sum(deletions) AS churn, arg_min(name, id) AS title FROM x GROUP BY cluster) q ORDER BY n DESC, churn DESC, title, cluster LIMIT 1)
SELECT path, row_number() OVER (ORDER BY m) AS position FROM (SELECT path, min(id) AS m FROM x JOIN s USING (cluster) GROUP BY path) q""",
    "sl9_payload_order": f"{GRAPH} SELECT path, start, id, status FROM changes ORDER BY path, start, id",
}
