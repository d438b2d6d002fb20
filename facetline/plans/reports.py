"""Reports over the driver tables: files, symbols, reviews; and the incremental run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.operators import edges as E
from facetline.operators import planning as P
from facetline.operators import report as R
from facetline.operators.staging import materialise, shared_dir
from facetline.plans import entities as N
from facetline.sources import diff as D
from facetline.sources import tables as T
from facetline.streaming import incremental as I


def file_detail(spark, d):
    """All symbols of each file with change and degrees; module code only if it changed."""
    symbols, edges = N.symbols(spark, d), N.edges(spark, d)
    rows = symbols.join(E.degrees(symbols, edges), "id").join(N.changes(spark, d).select("id", "status", "additions", "deletions"), "id", "left")
    return rows.where("kind <> 'module' OR status IS NOT NULL").select("path", "id", "qual", "kind", "start", "callers", "callees", "status", "additions", "deletions")


def symbols_in_file(spark, d):
    return N.symbols(spark, d).select("path", "id", F.row_number().over(W.partitionBy("path").orderBy("id")).alias("position"))


def file_symbol_split(spark, d):
    symbols = N.symbols(spark, d).where("kind <> 'module'").join(N.changes(spark, d).select("id", F.lit(True).alias("c")), "id", "left")
    return symbols.groupBy("path").agg(F.count_if("c").alias("changed"), F.count_if(F.col("c").isNull()).alias("unchanged"))


def review_summary(spark, d):
    changes = N.changes(spark, d)
    return changes.groupBy("path").agg(F.count("*").alias("symbols"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count_if(F.col("status") == "added").alias("added"))


def overview_elements(spark, d):
    """One zone per file, the changed nodes, and the edges between them."""
    changes = materialise(N.changes(spark, d), "changes")
    zones = changes.select(F.lit("zone").alias("what"), F.col("path").alias("key")).distinct()
    nodes = changes.select(F.lit("node"), F.col("id").cast("string"))
    links = E.induced(N.edges(spark, d), changes.select("id")).select(F.lit("edge"), F.concat_ws("->", "src", "dst"))
    return zones.unionAll(nodes).unionAll(links)


def symbol_report(spark, d):
    """Context of every changed symbol: its place, its callers and callees with what they are to the change, and its risk, as one text."""
    symbols, edges, changes = N.symbols(spark, d), materialise(N.edges(spark, d), "edges"), materialise(N.changes(spark, d), "changes")
    names = symbols.select("id", "qual")
    mark = lambda other: F.concat("qual", F.lit(" ("), "kind", F.when(F.col("fuzzy"), ", guess").otherwise(""), F.lit(")"))
    listed = lambda own, other: edges.join(changes.select(F.col("id").alias(own)), own, "left_semi").join(names.withColumnRenamed("id", other), other).withColumn("rank", F.row_number().over(_w(own, other))).where("rank <= 12").groupBy(F.col(own).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", mark(other).alias("m")))), lambda x: x["m"]), "; ").alias("list"))
    callers, callees = listed("dst", "src").withColumnRenamed("list", "callers"), listed("src", "dst").withColumnRenamed("list", "callees")
    risk = P.risk(changes.select("id"), symbols, edges, changes.select("path").distinct()).select("id", "external_callers", "tested")
    rows = changes.join(callers, "id", "left").join(callees, "id", "left").join(risk, "id")
    text = F.concat_ws(
        "\n",
        F.concat_ws(" ", "kind", "qual", F.lit("in"), "path", "status"),
        F.concat_ws(" ", F.lit("lines"), F.concat_ws("-", "start", "end"), F.concat(F.lit("+"), F.col("additions").cast("string")), F.concat(F.lit("-"), F.col("deletions").cast("string"))),
        F.concat(F.lit("called by: "), F.coalesce("callers", F.lit("nothing"))),
        F.concat(F.lit("calls: "), F.coalesce("callees", F.lit("nothing"))),
        F.concat(F.lit("outside callers: "), F.col("external_callers").cast("string"), F.when(F.col("tested"), ", tested").otherwise(", untested")),
    )
    return rows.select("id", text.alias("report"))


def _supplier_diffs(spark, d):
    """path, n, type, text, old_no, new_no, hunk: the lines of each supplier as one file's diff, in hunks of 16 lines."""
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    kind = F.when(F.col("l_returnflag") == "R", "del").when(F.col("l_returnflag") == "A", "add").otherwise("ctx")
    rows = N.table(spark, d, "lineitem").withColumn("type", kind)
    count = lambda other: F.count_if(F.col("type") != other).over(upto)
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), F.row_number().over(w).alias("n"), "type", F.concat(F.lit("  p"), F.col("l_partkey").cast("string")).alias("text"), count("add").alias("old_no"), count("del").alias("new_no")).withColumn("hunk", F.floor((F.col("n") - 1) / 16))


def symbol_context(spark, d):
    """Hunks, numbered source and call sites of four symbols per supplier's file, within their budgets; the last one of each is deleted."""
    diff = materialise(_supplier_diffs(spark, d), "supplier-diffs")
    at = lambda side, other: (F.min(f"{side}_no") + F.when(F.min_by("type", "n") == other, 1).otherwise(0)).cast("int")
    hunks = diff.groupBy("path", "hunk").agg(F.count("*").alias("size"), at("old", "add").alias("old_start"), F.count_if(F.col("type") != "add").cast("int").alias("old_lines"), at("new", "del").alias("new_start"), F.count_if(F.col("type") != "del").cast("int").alias("new_lines"))
    header = F.concat(F.lit("@@ -"), "old_start", F.lit(","), "old_lines", F.lit(" +"), "new_start", F.lit(","), "new_lines", F.lit(" @@"))
    hunks = hunks.withColumn("header", header)
    of_side = lambda no, other, old: diff.where(F.col("type") != other).select("path", F.lit(old).alias("deleted"), F.col(no).cast("int").alias("line"), "text")
    texts = of_side("old_no", "add", True).unionAll(of_side("new_no", "del", False))
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(j == 3).alias("deleted"), F.lit(j).alias("j")) for j, (a, b) in enumerate(((1, 10), (5, 350), (20, 50000), (3, 290)))])
    made = N.table(spark, d, "supplier").select("s_suppkey", F.explode(spans).alias("x")).select((F.col("s_suppkey") * 4 + F.col("x.j")).alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), "x.start", "x.end", "x.deleted")
    edges = made.select(F.col("id").alias("src"), F.floor(F.col("id") / 9).alias("dst"), (F.col("id") % 2 == 0).alias("fuzzy"), F.when(F.col("id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("id") % 7 * 60).cast("int"))).alias("lines"))
    return R.symbol_context(made, made, edges, hunks, diff.select("path", "hunk", F.col("n").alias("pos"), "type", "text"), texts)


def _w(own, other):
    return W.partitionBy(own).orderBy("fuzzy", other)


def single_file_hunks(spark, d):
    """Ranges of single lines, from the lines of a diff."""
    return D.changed_lines(D.diff_lines(N.diff_lines(spark, d))).select("path", "side", F.col("line").alias("first"), F.lit(1).alias("count"))


def file_lookup(spark, d):
    return N.paths(spark, d).where("path = 'src/src1_en/main.py'").select("id", "path")


def many_file_diff(spark, d):
    """All orders' diffs as one text with file headers, taken apart again into ranges."""
    lines = N.diff_lines(spark, d).select(F.col("path").cast("long").alias("n"), "pos", "text")
    first = lines.select("n").distinct().select("n", F.posexplode(F.array(F.concat(F.lit("diff --git a/"), "n", F.lit(" b/"), "n"), F.concat(F.lit("--- a/"), "n"), F.when(F.col("n") % 3 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/new"), "n")))).alias("pos", "text"))
    both = first.select("n", (F.col("pos") - 10).cast("long").alias("pos"), "text").unionAll(lines.select("n", F.col("pos").cast("long"), "text"))
    return D.file_ranges(both.select(F.floor(F.col("n") / 50).alias("source"), F.struct("n", "pos").alias("pos"), "text"))


def incremental_parse(spark, d):
    """Events as a stream of contents: each property text is parsed once."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").select(F.col("props").alias("key"))
    query = I.parse_new(stream, f"{base}/cache", lambda rows: rows.select("key", F.get_json_object("key", "$.k").cast("int").alias("k")), f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/cache").select("key", "k")


def stream_progress(spark, d):
    """Events that come in three parts, a batch each, as the stream goes on from its checkpoint: what each batch parsed and what was known."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = N.table(spark, d, "events").select(F.col("props").alias("key"), (F.col("event_id") % 3).alias("part"))
    for part in range(3):
        events.where(F.col("part") == part).select("key").write.parquet(f"{base}/in/part={part}")
        stream = spark.readStream.schema("key string, part int").parquet(f"{base}/in").select("key")
        I.parse_new(stream, f"{base}/cache", lambda rows: rows.select("key", F.length("key").alias("n")), f"{base}/checkpoint", f"{base}/progress").awaitTermination()
    return I.read_progress(spark, f"{base}/progress")


def file_diff(spark, d):
    """The first six lines of one order's diff."""
    return D.file_diff(N.diff_lines(spark, d), "1", 6).select("path", F.floor(F.col("pos") / 2).alias("n"), "text")


def pull_requests(spark, d):
    """Orders as a listing in JSON lines, read back: the forty open ones of latest date."""
    path = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"
    state = F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED")
    rows = N.table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("login")).alias("author"), state.alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updatedAt"))
    rows.write.json(path)
    return T.read_pull_requests(spark, path, state="OPEN").select("number", "title", F.col("author.login").alias("login"), F.col("updatedAt").alias("updated_at"))


def put_cache(spark, d):
    """Parts are a cache, returned lines failures, other lines what was parsed since: the newest of a key and version stays."""
    cache = N.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("v"), (F.col("p_size") % 2).cast("string")).alias("version"), F.lit("old").alias("data"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    parsed = N.table(spark, d, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("key"), F.concat(F.lit("v"), (F.col("l_linenumber") % 2).cast("string")).alias("version"), F.concat(F.lit("d"), at.cast("string")).alias("data"), (F.col("l_returnflag") == "R").alias("failed"), at.alias("at"))
    return T.put_cache(cache, parsed)


QUERIES = {
    "sc6_file_diff": file_diff,
    "sc13_pull_requests": pull_requests,
    "sc15_put_cache": put_cache,
    "rp2_file_detail": file_detail,
    "rp6_symbols_in_file": symbols_in_file,
    "rp5_file_symbol_split": file_symbol_split,
    "rp4_review_summary": review_summary,
    "rp8_overview_elements": overview_elements,
    "rp1_symbol_report": symbol_report,
    "rp1_symbol_context": symbol_context,
    "rp3_single_file_hunks": single_file_hunks,
    "rp9_file_lookup": file_lookup,
    "sc5_many_file_diff": many_file_diff,
    "sm1_incremental_parse": incremental_parse,
    "sm2_stream_progress": stream_progress,
}

SUPPLIER_DIFFS = """sd AS (SELECT 's' || l_suppkey AS path, row_number() OVER w AS n, type, '  p' || l_partkey AS text, count(*) FILTER (type <> 'add') OVER u AS old_no, count(*) FILTER (type <> 'del') OVER u AS new_no
  FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'del' WHEN 'A' THEN 'add' ELSE 'ctx' END AS type FROM lineitem)
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice), u AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
hk AS (SELECT path, (n - 1) // 16 AS hunk, count(*) AS size, min(old_no) + (arg_min(type, n) = 'add')::INT AS os, count(*) FILTER (type <> 'add') AS ol, min(new_no) + (arg_min(type, n) = 'del')::INT AS ns, count(*) FILTER (type <> 'del') AS nl FROM sd GROUP BY 1, 2),
sy AS (SELECT s_suppkey * 4 + j AS id, 's' || s_suppkey AS path, a AS start, b AS "end", j = 3 AS gone FROM supplier, (VALUES (0, 1, 10), (1, 5, 350), (2, 20, 50000), (3, 3, 290)) v(j, a, b)),
dl AS (SELECT y.id, h.hunk, x.n, x.t FROM sy y JOIN hk h ON h.path = y.path AND CASE WHEN gone THEN os ELSE ns END <= y."end" AND CASE WHEN gone THEN os + greatest(ol, 1) - 1 ELSE ns + greatest(nl, 1) - 1 END >= y.start
  JOIN (SELECT path, hunk, 0 AS n, '@@ -' || os || ',' || ol || ' +' || ns || ',' || nl || ' @@' AS t FROM hk UNION ALL SELECT path, (n - 1) // 16, n, CASE type WHEN 'add' THEN '+' WHEN 'del' THEN '-' ELSE ' ' END || text FROM sd) x ON x.path = h.path AND x.hunk = h.hunk),
dk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hunk, n) AS k FROM dl),
df AS (SELECT id, string_agg(t, chr(10) ORDER BY k) FILTER (k <= 400) || CASE WHEN count(*) > 400 THEN chr(10) || '... (diff truncated)' ELSE '' END AS diff FROM dk GROUP BY id),
tx AS (SELECT path, true AS gone, old_no AS line, text FROM sd WHERE type <> 'add' UNION ALL SELECT path, false, new_no, text FROM sd WHERE type <> 'del'),
sr AS (SELECT y.id, string_agg(lpad(line::VARCHAR, 5, ' ') || '  ' || text, chr(10) ORDER BY line) || CASE WHEN max(line) < any_value(y."end") THEN chr(10) || '... (truncated)' ELSE '' END AS source FROM sy y JOIN tx t ON t.path = y.path AND t.gone = y.gone AND line BETWEEN y.start AND least(y."end", y.start + 299) GROUP BY y.id),
ca AS (SELECT id // 9 AS id, row_number() OVER (PARTITION BY id // 9 ORDER BY id % 2 = 0, id) AS k, path, CASE WHEN id % 3 = 0 THEN start ELSE id % 7 * 60 END AS line FROM sy WHERE id <> id // 9),
cs AS (SELECT c.id, string_agg(c.path || ':' || c.line || ': ' || trim(text), chr(10) ORDER BY k) AS sites FROM ca c JOIN tx t ON t.path = c.path AND NOT t.gone AND t.line = c.line WHERE k <= 6 GROUP BY c.id)"""

ORACLES = {
    "rp1_symbol_context": f"WITH {SUPPLIER_DIFFS} SELECT sy.id, diff, source, sites FROM sy LEFT JOIN df ON df.id = sy.id LEFT JOIN sr ON sr.id = sy.id LEFT JOIN cs ON cs.id = sy.id",
    "sc6_file_diff": f"""WITH {N.DIFF}, r AS (SELECT n, 2 * n + k AS pos, x.text FROM (SELECT n, unnest(CASE WHEN (n - 1) % 4 = 0 THEN [0, 1] ELSE [0] END) AS k,
    unnest(CASE WHEN (n - 1) % 4 = 0 THEN ['@@ -' || ((n - 1) * 10 + l_linenumber) || ',4 +' || ((n - 1) * 11 + 1) || ' @@ s' || l_suppkey, b] ELSE [b] END) AS text
    FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END || 'p' || l_partkey AS b FROM raw_lines WHERE path = '1') q) x)
SELECT '1' AS path, n, text FROM r ORDER BY pos LIMIT 6""",
    "sc13_pull_requests": "SELECT o_orderkey AS number, o_orderpriority AS title, 'c' || o_custkey AS login, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40",
    "sc15_put_cache": """WITH f AS (SELECT l_partkey AS key, 'v' || (l_linenumber % 2) AS version, max(l_orderkey * 10 + l_linenumber) AS at FROM lineitem WHERE l_partkey % 3 <> 0 AND l_returnflag <> 'R' GROUP BY 1, 2)
SELECT key, version, 'd' || f.at AS data FROM f UNION ALL SELECT p_partkey, 'v' || (p_size % 2), 'old' FROM part WHERE NOT EXISTS (SELECT 1 FROM f WHERE key = p_partkey AND version = 'v' || (p_size % 2))""",
    "rp2_file_detail": f"{N.GRAPH} SELECT s.path, s.id, s.qual, s.kind, s.start, (SELECT count(*) FROM edges WHERE dst = s.id) AS callers, (SELECT count(*) FROM edges WHERE src = s.id) AS callees, c.status, c.additions, c.deletions FROM symbols s LEFT JOIN changes c ON c.id = s.id WHERE s.kind <> 'module' OR c.id IS NOT NULL",
    "rp6_symbols_in_file": f"WITH {N.SYMBOLS} SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY id) AS position FROM symbols",
    "rp5_file_symbol_split": f"WITH {N.SYMBOLS} SELECT path, count(*) FILTER (size <= 5 OR size IN (10, 17)) AS changed, count(*) FILTER (NOT (size <= 5 OR size IN (10, 17))) AS unchanged FROM symbols WHERE kind <> 'module' GROUP BY path",
    "rp4_review_summary": f"WITH {N.SYMBOLS}, {N.CHANGES} SELECT path, count(*) AS symbols, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(*) FILTER (status = 'added') AS added FROM changes GROUP BY path",
    "rp8_overview_elements": f"{N.GRAPH} SELECT DISTINCT 'zone' AS what, path AS key FROM changes UNION ALL SELECT 'node', id::VARCHAR FROM changes UNION ALL SELECT 'edge', src || '->' || dst FROM edges WHERE src IN (SELECT id FROM changes) AND dst IN (SELECT id FROM changes)",
    "rp3_single_file_hunks": f"WITH {N.DIFF} SELECT DISTINCT path, CASE type WHEN 'add' THEN 'head' ELSE 'base' END AS side, CASE type WHEN 'add' THEN new_no ELSE old_no END AS first, 1 AS count FROM diff WHERE type <> 'ctx'",
    "rp9_file_lookup": f"WITH {N.PATHS} SELECT id, path FROM paths WHERE path = 'src/src1_en/main.py'",
    "sc5_many_file_diff": f"WITH {N.DIFF}, h AS (SELECT DISTINCT CASE WHEN path::BIGINT % 3 = 0 THEN path ELSE 'new' || path END AS path, hunk, old_start, new_start FROM body_lines) SELECT path, 'base' AS side, old_start AS first, 4 AS count FROM h UNION ALL SELECT path, 'head', new_start, 1 FROM h",
    "sm1_incremental_parse": "SELECT DISTINCT props AS key, (props::JSON->>'k')::INTEGER AS k FROM events",
    "sm2_stream_progress": """WITH k AS (SELECT props, min(event_id % 3) AS f FROM events GROUP BY 1), b AS (SELECT event_id % 3 AS batch, count(*) AS rows, count(DISTINCT e.props) AS keys, count(DISTINCT CASE WHEN f = event_id % 3 THEN e.props END) AS parsed FROM events e LEFT JOIN k ON k.props = e.props GROUP BY 1)
SELECT batch, rows, keys, parsed, keys - parsed AS known, (sum(parsed) OVER (ORDER BY batch))::BIGINT AS done, (sum(rows) OVER (ORDER BY batch))::BIGINT AS total FROM b""",
    "rp1_symbol_report": f"""{N.GRAPH}, x AS (SELECT dst AS id, array_to_string(list(q ORDER BY k), '; ') AS l FROM (SELECT e.dst, s.qual || ' (' || e.kind || CASE WHEN e.fuzzy THEN ', guess' ELSE '' END || ')' AS q, row_number() OVER (PARTITION BY e.dst ORDER BY e.fuzzy, e.src) AS k FROM edges e JOIN symbols s ON s.id = e.src) a WHERE k <= 12 GROUP BY dst),
y AS (SELECT src AS id, array_to_string(list(q ORDER BY k), '; ') AS l FROM (SELECT e.src, s.qual || ' (' || e.kind || CASE WHEN e.fuzzy THEN ', guess' ELSE '' END || ')' AS q, row_number() OVER (PARTITION BY e.src ORDER BY e.fuzzy, e.dst) AS k FROM edges e JOIN symbols s ON s.id = e.dst) a WHERE k <= 12 GROUP BY src),
t AS (SELECT e.src AS test, e.dst AS t_to FROM edges e JOIN symbols s ON s.id = e.src WHERE s.category = 'test')
SELECT c.id, c.kind || ' ' || c.qual || ' in ' || c.path || ' ' || c.status || chr(10) || 'lines ' || c.start || '-' || c."end" || ' +' || c.additions || ' -' || c.deletions || chr(10) || 'called by: ' || coalesce(x.l, 'nothing') || chr(10) || 'calls: ' || coalesce(y.l, 'nothing') || chr(10) || 'outside callers: ' || (SELECT count(*) FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst = c.id AND s.path NOT IN (SELECT path FROM changes)) ||
  CASE WHEN c.id IN (SELECT t_to FROM t WHERE test <> t_to) OR EXISTS (SELECT 1 FROM edges e JOIN t ON t.t_to = e.src WHERE e.dst = c.id AND t.test <> c.id) THEN ', tested' ELSE ', untested' END AS report
FROM changes c LEFT JOIN x ON x.id = c.id LEFT JOIN y ON y.id = c.id""",
}
