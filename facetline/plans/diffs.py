"""Diff and change queries over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetline.operators import changes as C
from facetline.operators import intervals as I
from facetline.operators import serving as S
from facetline.plans import entities as N
from facetline.sources import diff as D


def _spans(spark, d):
    """path, start, end, qual, ord of the symbols."""
    return N.symbols(spark, d).select("path", "start", "end", F.when(F.col("kind") == "module", "<module>").otherwise(F.col("qual")).alias("qual"), F.col("id").alias("ord"))


def _lines(spark, d):
    """path, line: every returned line touches a line of the file of its part."""
    files = N.symbols(spark, d).select(F.col("id").alias("l_partkey"), "path")
    returned = N.table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", ((F.col("l_suppkey") * 11 + F.col("l_orderkey")) % 1000 + 1).cast("int").alias("line"), F.col("l_linenumber").alias("n"))
    return returned.join(files, "l_partkey").select("path", "line", "n")


def diff_lines(spark, d):
    return D.diff_lines(N.diff_lines(spark, d)).select("path", "hunk", F.floor(F.col("pos") / 2).alias("n"), "type", "old_no", "new_no", "text", "section")


def changed_lines(spark, d):
    return D.changed_lines(D.diff_lines(N.diff_lines(spark, d)))


def zero_context_ranges(spark, d):
    return D.ranges(N.diff_lines(spark, d))


def innermost(spark, d):
    return I.innermost(_lines(spark, d), _spans(spark, d))


def lines_per_symbol(spark, d):
    return I.owner_counts(_lines(spark, d).select("path", F.col("line").alias("first"), F.col("n").alias("count")), _spans(spark, d))


def merged_ranges(spark, d):
    return I.merged_ranges(_lines(spark, d).select("path", F.col("line").alias("first"), F.col("n").alias("count")).distinct())


def hunk_symbols(spark, d):
    hunks = _lines(spark, d).select("path", F.col("line").alias("start"), F.col("n").alias("lines")).distinct().withColumn("hunk", F.col("start") * 10 + F.col("lines"))
    return I.hunk_symbols(hunks, _spans(spark, d))


def start_markers(spark, d):
    return I.at_start(_lines(spark, d), _spans(spark, d))


def reconcile(spark, d):
    """Two sides of a snapshot: parts of even and of odd size classes; what each file's symbols gained and lost."""
    symbols = N.symbols(spark, d).where("kind <> 'module'")
    head, base = symbols.where("size % 5 <> 0").select("path", "qual", "start", "end"), symbols.where("size % 7 <> 0").select("path", "qual", "start", "end")
    files = symbols.select("path").distinct().select("path", F.lit(None).cast("string").alias("old_path"), F.when(F.length("path") % 3 == 0, "added").otherwise("modified").alias("status"), (F.length("path") % 2 == 0).alias("base_known"))
    added = symbols.where("size % 5 <> 0 AND size % 3 = 0").select("path", F.col("qual").alias("owner"), F.col("size").cast("long").alias("lines"))
    deleted = symbols.where("size % 7 <> 0 AND size % 4 = 0").select("path", F.col("qual").alias("owner"), F.col("size").cast("long").alias("lines"))
    return C.reconcile(files, head, base, added, deleted)


def changed_files(spark, d):
    """Orders as changed files: the raw list and the statistics are two tables that meet on the path."""
    orders = N.table(spark, d, "orders")
    raw = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.lit(None).cast("string").alias("old_path"), F.col("o_orderstatus").alias("letter"))
    stats = orders.where("o_custkey % 4 <> 0").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_custkey") % 5 == 0, "-").otherwise(F.col("o_custkey").cast("string")).alias("adds"), F.when(F.col("o_custkey") % 5 == 0, "-").otherwise((F.col("o_custkey") % 7).cast("string")).alias("dels"))
    return C.changed_files(raw, stats)


def totals(spark, d):
    return N.changes(spark, d).agg(F.count_distinct("path").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def changes_by_file(spark, d):
    rows = N.changes(spark, d).groupBy("path").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("start", "id"))), lambda x: x["id"]).alias("ids"))
    return rows.select("path", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def prefix_budget(spark, d):
    hunks = D.diff_lines(N.diff_lines(spark, d)).groupBy("path", "hunk").agg(F.count("*").alias("lines"))
    return S.prefix_budget(hunks, budget=6)


def largest_by_churn(spark, d):
    """The three symbols of each file with most churn."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc(F.col("additions") + F.col("deletions")), "id"))
    return N.changes(spark, d).select("path", "id", rank.alias("rank")).where("rank <= 3")


QUERIES = {
    "tf17_diff_lines": diff_lines,
    "tf19_changed_lines": changed_lines,
    "tf18_zero_context_ranges": zero_context_ranges,
    "jn3_innermost": innermost,
    "ag2_lines_per_symbol": lines_per_symbol,
    "wn5_merged_ranges": merged_ranges,
    "jn23_hunk_symbols": hunk_symbols,
    "jn24_start_markers": start_markers,
    "jn4_reconcile": reconcile,
    "sc4_changed_files": changed_files,
    "ag1_totals": totals,
    "ag17_changes_by_file": changes_by_file,
    "wn3_prefix_budget": prefix_budget,
    "pf16_largest_by_churn": largest_by_churn,
}

SPANS = f"WITH {N.SYMBOLS}, {N.CHANGES}, spans AS (SELECT path, start, \"end\", CASE WHEN kind = 'module' THEN '<module>' ELSE qual END AS qual, id AS ord FROM symbols), touched AS (SELECT path, ((l_suppkey * 11 + l_orderkey) % 1000 + 1)::INTEGER AS line, l_linenumber AS n FROM lineitem JOIN symbols ON id = l_partkey WHERE l_returnflag = 'R')"
RANGES = SPANS + ", expanded AS (SELECT DISTINCT path, unnest(range(line, line + n)) AS line FROM touched)"

ORACLES = {
    "tf17_diff_lines": f"WITH {N.DIFF} SELECT * FROM diff",
    "tf19_changed_lines": f"WITH {N.DIFF} SELECT DISTINCT path, CASE type WHEN 'add' THEN 'head' ELSE 'base' END AS side, CASE type WHEN 'add' THEN new_no ELSE old_no END AS line FROM diff WHERE type <> 'ctx'",
    "tf18_zero_context_ranges": f"WITH {N.DIFF}, h AS (SELECT DISTINCT path, hunk, old_start, new_start FROM body_lines) SELECT path, 'base' AS side, old_start AS first, 4 AS count FROM h UNION ALL SELECT path, 'head', new_start, 1 FROM h",
    "jn3_innermost": f"{SPANS}, x AS (SELECT DISTINCT path, line FROM touched) SELECT x.path, x.line, coalesce((SELECT first(s.qual ORDER BY s.\"end\" - s.start, s.ord) FROM spans s WHERE s.path = x.path AND s.qual <> '<module>' AND x.line BETWEEN s.start AND s.\"end\"), '<module>') AS owner FROM x",
    "ag2_lines_per_symbol": f"{RANGES} SELECT path, owner, count(*) AS lines FROM (SELECT x.path, coalesce((SELECT first(s.qual ORDER BY s.\"end\" - s.start, s.ord) FROM spans s WHERE s.path = x.path AND s.qual <> '<module>' AND x.line BETWEEN s.start AND s.\"end\"), '<module>') AS owner FROM expanded x) q GROUP BY path, owner",
    "wn5_merged_ranges": f"{SPANS}, r AS (SELECT DISTINCT path, line AS first, n, line + n - 1 AS last FROM touched) SELECT path, greatest(first, coalesce(done + 1, first)) AS first, last FROM (SELECT *, max(last) OVER (PARTITION BY path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM r) q WHERE greatest(first, coalesce(done + 1, first)) <= last",
    "jn23_hunk_symbols": f"{SPANS}, h AS (SELECT DISTINCT path, line AS hs, n, line * 10 + n AS hunk FROM touched) SELECT path, hunk, qual, rank FROM (SELECT h.path, h.hunk, s.qual, row_number() OVER (PARTITION BY h.path, h.hunk ORDER BY s.\"end\" - s.start, s.ord) AS rank FROM h JOIN spans s ON s.path = h.path AND s.start <= hs + greatest(n, 1) - 1 AND s.\"end\" >= hs AND s.\"end\" >= s.start AND s.qual <> '<module>') q WHERE rank <= 4",
    "jn24_start_markers": f"{SPANS} SELECT DISTINCT t.path, t.line, s.qual, s.ord FROM touched t JOIN spans s ON s.path = t.path AND s.start = t.line".replace("SELECT DISTINCT t.path, t.line, s.qual, s.ord FROM", "SELECT path, line, qual FROM (SELECT DISTINCT t.path, t.line, s.qual, s.ord FROM") + ") q",
    "jn4_reconcile": f"""{SPANS}, m AS (SELECT * FROM symbols WHERE kind <> 'module')
SELECT path, qual, CASE WHEN size % 7 <> 0 AND size % 5 = 0 THEN 'deleted' WHEN size % 5 <> 0 AND (length(path) % 3 = 0 OR (length(path) % 2 = 0 AND size % 7 = 0)) THEN 'added' ELSE 'modified' END AS status,
  a AS additions, CASE WHEN size % 7 <> 0 AND size % 5 = 0 AND d = 0 THEN "end" - start + 1 ELSE d END AS deletions
FROM (SELECT *, CASE WHEN size % 5 <> 0 AND size % 3 = 0 THEN size ELSE 0 END AS a, CASE WHEN size % 7 <> 0 AND size % 4 = 0 THEN size ELSE 0 END AS d FROM m) q
WHERE (size % 7 <> 0 AND size % 5 = 0) OR (size % 5 <> 0 AND a + d > 0)""",
    "sc4_changed_files": """SELECT o_orderkey::VARCHAR AS path, NULL::VARCHAR AS old_path, 'modified' AS status, CASE WHEN o_custkey % 4 = 0 OR o_custkey % 5 = 0 THEN 0 ELSE o_custkey END AS additions, CASE WHEN o_custkey % 4 = 0 OR o_custkey % 5 = 0 THEN 0 ELSE o_custkey % 7 END AS deletions, o_custkey % 4 <> 0 AND o_custkey % 5 = 0 AS "binary" FROM orders""",
    "ag1_totals": f"WITH {N.SYMBOLS}, {N.CHANGES} SELECT count(DISTINCT path) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM changes",
    "ag17_changes_by_file": f"WITH {N.SYMBOLS}, {N.CHANGES} SELECT path, count(*) AS n, array_to_string(list(id ORDER BY start, id), ',') AS ids FROM changes GROUP BY path",
    "wn3_prefix_budget": f"WITH {N.DIFF}, h AS (SELECT path, hunk, count(*) AS lines FROM diff GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(lines) OVER (PARTITION BY path ORDER BY hunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT path, hunk, least(lines, greatest(6 - before, 0))::BIGINT AS kept, least(lines, greatest(6 - before, 0)) < lines AS truncated FROM b",
    "pf16_largest_by_churn": f"WITH {N.SYMBOLS}, {N.CHANGES} SELECT path, id, rank FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY additions + deletions DESC, id) AS rank FROM changes) q WHERE rank <= 3",
}
