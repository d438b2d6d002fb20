"""The review plan over the driver tables, whole, and its SQL. Changed symbols of size 3 are deleted; every changed file and those of sizes 6 to 8 are files of the review."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetline.operators import edges as E
from facetline.operators import jobs as J
from facetline.operators import planning as P
from facetline.operators import review as V
from facetline.operators import traversal as T
from facetline.operators.staging import materialise
from facetline.plans import entities as N


def _tables(spark, d):
    """symbols, edges, changes and files, written once for a snapshot of the tables."""

    def written():
        changes = N.changes(spark, d).withColumn("status", F.when(F.col("size") == 3, "deleted").otherwise(F.col("status")))
        files = N.symbols(spark, d).where("size <= 8 OR size IN (10, 17)").select("path").distinct()
        return [materialise(x, name) for name, x in (("symbols", N.symbols(spark, d)), ("edges", N.edges(spark, d)), ("changes", changes), ("files", files))]

    return J.recent(spark, "review", J.stamp(spark, f"{d}/part.parquet", f"{d}/lineitem.parquet"), written)


def _core(changes):
    return changes.where((F.col("status") != "deleted") & V.is_core(F.col("kind"), F.col("category"))).select("id")


def _by_components(spark, d):
    """The tables of a review whose core clusters are components over exact links, which SQL can express."""

    def made():
        symbols, edges, changes, files = _tables(spark, d)
        core = _core(changes)
        clusters = materialise(T.components(core, E.induced(edges.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster"), "roots")
        return V.review(clusters, symbols, edges, changes, files)

    return J.recent(spark, "review-components", J.stamp(spark, f"{d}/part.parquet", f"{d}/lineitem.parquet"), made)


def attached(spark, d):
    """The cluster of every live changed symbol: core, tests and module code."""
    return _by_components(spark, d)["order"].select("id", "cluster")


def plan_entries(spark, d):
    return _by_components(spark, d)["entries"].select("cluster", "id", "rank")


def plan_clusters(spark, d):
    made = _by_components(spark, d)["clusters"]
    return made.select("id", "cluster", "title", "symbols", "additions", "deletions", F.to_json("categories").alias("categories"))


def plan_segments(spark, d):
    """Where each segment of a cluster begins and ends in its reading order."""
    _, _, changes, _ = _tables(spark, d)
    order = _by_components(spark, d)["order"].join(changes.select("id", "kind", "category"), "id")
    return order.groupBy("cluster", V.segment(F.col("kind"), F.col("category")).alias("segment")).agg(F.min("position").cast("long").alias("first"), F.max("position").cast("long").alias("last"))


def unmapped_files(spark, d):
    return _by_components(spark, d)["unmapped"]


def plan_risk(spark, d):
    """Risk of live symbols only, callers outside of all changed files."""
    rows = _by_components(spark, d)["risk"]
    return rows.select("id", "callers", "external_callers", "fan_out", "tested")


def review_plan(spark, d):
    """The whole plan with communities as clusters of the core: numbered clusters with titles, ordered files, sums and categories, then files without one."""
    symbols, edges, changes, files = _tables(spark, d)
    core = materialise(_core(changes), "core")
    weights = materialise(P.link_weights(core, symbols, edges, changes), "link-weights")
    made = V.review(materialise(P.core_clusters(core, weights), "clusters"), symbols, edges, changes, files)
    clusters = made["clusters"].select("id", "title", "symbols", "additions", "deletions", F.array_join("files", ",").alias("files"), F.to_json("categories").alias("categories"))
    # a file of no cluster is a row without a title
    rest = made["unmapped"].select(F.lit("unmapped").alias("id"), F.lit(None).cast("string").alias("title"), F.lit(0).cast("long").alias("symbols"), F.lit(0).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"), F.col("path").alias("files"), F.lit("{}").alias("categories"))
    return clusters.unionByName(rest)


QUERIES = {
    "e2_review_plan": review_plan,
    "e2_plan_clusters": plan_clusters,
    "e2_plan_entries": plan_entries,
    "e2_plan_segments": plan_segments,
    "e2_plan_risk": plan_risk,
    "e2_unmapped_files": unmapped_files,
    "gr7_attached": attached,
}

LIVE = N.GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """,
live AS (SELECT * FROM changes WHERE size <> 3), core AS (SELECT * FROM live WHERE kind <> 'module' AND category <> 'test'), exact AS (SELECT * FROM edges WHERE NOT fuzzy),
cl AS (SELECT src AS u, dst AS v FROM exact WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)), cb AS (SELECT u, v FROM cl UNION SELECT v, u FROM cl),
reach AS (SELECT id AS u, id AS v FROM core UNION SELECT r.u, l.v FROM reach r JOIN cb l ON l.u = r.v), roots AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY u),
sizes AS (SELECT root, count(*) AS size FROM roots GROUP BY root),
sat AS (SELECT id, path, parent, kind = 'module' AS m FROM live WHERE id NOT IN (SELECT id FROM core)),
near AS (SELECT s.id, e.dst AS b FROM sat s JOIN exact e ON e.src = s.id JOIN live l ON l.id = e.dst WHERE NOT m OR e.kind <> 'references'
  UNION ALL SELECT s.id, e.src FROM sat s JOIN exact e ON e.dst = s.id JOIN live l ON l.id = e.src WHERE NOT m OR e.kind <> 'references'),
say AS (SELECT id, b, 2 AS n FROM near UNION ALL SELECT s.id, f.dst, 1 FROM sat s JOIN exact e ON e.src = s.id JOIN exact f ON f.src = e.dst JOIN live l ON l.id = f.dst
  WHERE (NOT m OR e.kind <> 'references') AND e.dst NOT IN (SELECT id FROM changes) AND f.dst <> s.id)"""
ATTACHED = LIVE + """,
won AS (SELECT id, cluster FROM (SELECT s.id, r.root AS cluster, row_number() OVER (PARTITION BY s.id ORDER BY sum(n) DESC, any_value(size) DESC, r.root) AS k FROM say s JOIN roots r ON r.id = s.b JOIN sizes z ON z.root = r.root GROUP BY s.id, r.root) q WHERE k = 1),
loose AS (SELECT id, parent FROM sat WHERE NOT m AND id NOT IN (SELECT id FROM won)),
ll AS (SELECT id AS u, b AS v FROM say WHERE id IN (SELECT id FROM loose) AND b IN (SELECT id FROM loose) UNION SELECT a.id, b.id FROM loose a JOIN loose b ON b.parent = a.parent UNION SELECT id, parent FROM loose WHERE parent IN (SELECT id FROM loose)),
lb AS (SELECT u, v FROM ll UNION SELECT v, u FROM ll), lr AS (SELECT id AS u, id AS v FROM loose UNION SELECT lr.u, lb.v FROM lr JOIN lb ON lb.u = lr.v), lg AS (SELECT u AS id, min(v) AS root FROM lr GROUP BY u),
company AS (SELECT root, cluster FROM (SELECT lg.root, w.cluster, row_number() OVER (PARTITION BY lg.root ORDER BY count(*) DESC, any_value(size) DESC, w.cluster) AS k FROM near n JOIN lg ON lg.id = n.id JOIN won w ON w.id = n.b JOIN sizes z ON z.root = w.cluster GROUP BY lg.root, w.cluster) q WHERE k = 1),
base AS (SELECT id, root AS cluster FROM roots UNION ALL SELECT id, cluster FROM won UNION ALL SELECT lg.id, coalesce(c.cluster, lg.root) FROM lg LEFT JOIN company c ON c.root = lg.root),
mods AS (SELECT id, path, row_number() OVER (ORDER BY id) AS k FROM sat WHERE m AND id NOT IN (SELECT id FROM won)),
bv AS (SELECT s.id, o.cluster, sum(n) AS n FROM say s JOIN mods USING (id) JOIN base o ON o.id = s.b GROUP BY 1, 2),
mv AS (SELECT s.id, s.b, sum(n) AS n FROM say s JOIN mods x ON x.id = s.id JOIN mods y ON y.id = s.b WHERE s.b < s.id GROUP BY 1, 2),
filed AS (SELECT id, cluster FROM (SELECT m.id, o.cluster, row_number() OVER (PARTITION BY m.id ORDER BY count(*) DESC, coalesce(any_value(z.size), 0) DESC, o.cluster) AS k FROM mods m JOIN live l ON l.path = m.path JOIN base o ON o.id = l.id LEFT JOIN sizes z ON z.root = o.cluster GROUP BY m.id, o.cluster) q WHERE k = 1),
-- module code in the order of ids, each with what came before it in hand
st AS (SELECT 0::BIGINT AS k, MAP()::MAP(BIGINT, BIGINT) AS own UNION ALL
  SELECT st.k + 1, map_concat(own, MAP {m.id: coalesce((SELECT cluster FROM (SELECT cluster, n FROM bv WHERE bv.id = m.id UNION ALL SELECT own[mv.b], n FROM mv WHERE mv.id = m.id AND own[mv.b] IS NOT NULL) q LEFT JOIN sizes z ON z.root = q.cluster GROUP BY cluster ORDER BY sum(n) DESC, coalesce(any_value(size), 0) DESC, cluster LIMIT 1), (SELECT cluster FROM filed WHERE filed.id = m.id))})
  FROM st JOIN mods m ON m.k = st.k + 1),
owner AS (SELECT id, cluster FROM base UNION ALL SELECT e.key, e.value FROM (SELECT unnest(map_entries(own)) AS e FROM (SELECT own FROM st ORDER BY k DESC LIMIT 1) q) p WHERE e.value IS NOT NULL)"""
ENTRIES = ATTACHED + """,
fa AS (SELECT o.cluster, c.id, c.path, c.start, c.additions + c.deletions AS churn, CASE WHEN category = 'test' THEN 2 WHEN kind = 'module' THEN 1 ELSE 0 END AS segment, kind FROM owner o JOIN live c ON c.id = o.id),
fb AS (SELECT *, kind <> 'module' AND (segment <> 2 OR min(segment) OVER (PARTITION BY cluster) = 2) AS counts FROM fa), fc AS (SELECT *, counts OR NOT bool_or(counts) OVER (PARTITION BY cluster) AS may FROM fb),
fo AS (SELECT e.src, e.dst FROM exact e JOIN live l ON l.id = e.src WHERE l.kind <> 'module' OR e.kind <> 'references'),
adj AS (SELECT src AS a, dst AS b FROM fo WHERE dst IN (SELECT id FROM live) UNION SELECT o.src, f.dst FROM fo o JOIN exact f ON f.src = o.dst WHERE o.dst NOT IN (SELECT id FROM changes) AND f.dst IN (SELECT id FROM live) AND f.dst <> o.src),
ins AS (SELECT a, b, x.counts FROM adj JOIN fc x ON x.id = a JOIN fc y ON y.id = b WHERE x.cluster = y.cluster AND a <> b),
ra AS (SELECT fc.*, id IN (SELECT b FROM ins WHERE counts) AS called, (SELECT count(*) FROM ins WHERE a = fc.id) AS deg FROM fc WHERE may),
rb AS (SELECT *, bool_or(NOT called) OVER (PARTITION BY cluster) AS any_free, row_number() OVER (PARTITION BY cluster ORDER BY deg DESC, churn DESC, path, start, id) AS best FROM ra),
entries AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY deg DESC, churn DESC, path, start, id) AS rank FROM rb WHERE (any_free AND NOT called) OR (NOT any_free AND best = 1))"""

ORACLES = {
    "gr7_attached": f"{ATTACHED} SELECT id, cluster FROM owner",
    "e2_plan_entries": f"{ENTRIES} SELECT cluster, id, rank FROM entries",
    "e2_plan_clusters": f"""{ENTRIES},
ct AS (SELECT cluster, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS categories FROM (SELECT o.cluster, l.category, count(*) AS n FROM owner o JOIN live l ON l.id = o.id GROUP BY 1, 2) q GROUP BY cluster),
sm AS (SELECT o.cluster, count(*) AS symbols, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM owner o JOIN live l ON l.id = o.id GROUP BY 1),
tt AS (SELECT e.cluster, CASE WHEN kind = 'module' THEN name ELSE qual END AS title FROM entries e JOIN live l ON l.id = e.id WHERE rank = 1)
SELECT 'c' || row_number() OVER (ORDER BY symbols DESC, additions + deletions DESC, title, cluster) AS id, cluster, title, symbols, additions, deletions, categories FROM sm JOIN tt USING (cluster) JOIN ct USING (cluster)""",
    "e2_plan_segments": f"{ENTRIES}, n AS (SELECT cluster, segment, count(*) AS n FROM fa GROUP BY 1, 2) SELECT cluster, segment, (sum(n) OVER w - n + 1)::BIGINT AS first, (sum(n) OVER w)::BIGINT AS last FROM n WINDOW w AS (PARTITION BY cluster ORDER BY segment)",
    "e2_unmapped_files": f"{ATTACHED} SELECT DISTINCT path FROM symbols WHERE (size <= 8 OR size IN (10, 17)) AND path NOT IN (SELECT path FROM live JOIN owner USING (id))",
    "e2_plan_risk": f"""{LIVE}, t AS (SELECT e.src AS test, e.dst AS t_to FROM edges e JOIN symbols s ON s.id = e.src WHERE s.category = 'test')
SELECT c.id, (SELECT count(*) FROM edges WHERE dst = c.id) AS callers, (SELECT count(*) FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst = c.id AND s.path NOT IN (SELECT path FROM symbols WHERE size <= 8 OR size IN (10, 17))) AS external_callers,
  (SELECT count(*) FROM edges WHERE src = c.id) AS fan_out, c.id IN (SELECT t_to FROM t WHERE test <> t_to) OR EXISTS (SELECT 1 FROM edges e JOIN t ON t.t_to = e.src WHERE e.dst = c.id AND t.test <> c.id) AS tested FROM live c""",
}
