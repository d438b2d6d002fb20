"""Queries that serve a review: search, facets, filters, lists, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.functions.globs import pattern_filter


def search(symbols: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """Symbols by name: 0 exact, 1 prefix, 2 within qual, 3 within path; then shorter qual, path, id. Modules and blank queries give none."""
    q = query.strip().lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    name = F.lower("name")
    score = F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).when(has("qual"), 2).when(has("path"), 3)
    scored = symbols.where((F.col("kind") != "module") & F.lit(bool(q))).withColumn("score", score).where("score IS NOT NULL")
    return scored.orderBy("score", F.length("qual"), "path", "id").limit(limit)


def file_filter(categories: list[str] | None = None, extensions: list[str] | None = None, patterns: str = "") -> Column:
    """Condition on files (path, category, ext); None is no restriction."""
    return _in("category", categories) & _in("ext", extensions) & pattern_filter(F.col("path"), patterns)


def _in(column: str, wanted: list[str] | None) -> Column:
    return F.lit(True) if wanted is None else F.col(column).isin(wanted)


def facets(files: DataFrame, categories: list[str] | None, extensions: list[str] | None, patterns: str = "") -> DataFrame:
    """(facet, value, n): counts per category without the category filter, per extension without the extension filter.

    One pass: each row goes to the facets whose other filters it passes.
    """
    passing = files.where(pattern_filter(F.col("path"), patterns))
    by_category = F.when(_in("ext", extensions), F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")))
    by_ext = F.when(_in("category", categories), F.struct(F.lit("ext").alias("facet"), F.col("ext").alias("value")))
    return passing.select(F.explode(F.array_compact(F.array(by_category, by_ext))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def universe(counts: DataFrame, order: list[str]) -> DataFrame:
    """Facet values in display order: categories as given, extensions by most files, then name."""
    place = F.coalesce(F.array_position(F.lit(order), F.col("value")), F.lit(0))
    key = F.when(F.col("facet") == "category", F.struct(F.when(place == 0, 10**9).otherwise(place).cast("long").alias("a"), F.col("value").alias("b"))).otherwise(F.struct((-F.col("n")).alias("a"), F.col("value").alias("b")))
    return counts.withColumn("position", F.row_number().over(W.partitionBy("facet").orderBy(key)))


def toggle(selected: Column, value: Column, all_values: Column, exclusive: bool = False) -> Column:
    """A chip of a filter array: from none to one, in or out; nothing and everything become null. Exclusive: all others."""
    others = F.array_except(all_values, F.array(value))
    changed = F.when(selected.isNull(), F.array(value)).when(F.array_contains(selected, value), F.array_except(selected, F.array(value))).otherwise(F.array_union(selected, F.array(value)))
    result = others if exclusive else changed
    empty = F.size(result) == 0
    full = (F.size(F.array_except(all_values, result)) == 0) if not exclusive else F.lit(False)
    return F.when(~(empty | full), result)


# Presets of the file filter and the categories that each shows; none is every category. None restricts extensions.
PRESETS = {
    "all": None,
    "logic": ["source"],
    "tests": ["test"],
    "templates": ["template", "style"],
    "no-noise": ["source", "template", "style", "config", "migration", "other"],
}


def same_list(a: Column, b: list[str] | None) -> Column:
    """Whether a list has as many values as another and none beside its own; only no list is like no list."""
    if b is None:
        return a.isNull()
    return a.isNotNull() & (F.size(a) == len(b)) & (F.size(F.array_except(a, F.array(*[F.lit(x) for x in b]))) == 0)


def active_preset(categories: Column, extensions: Column, patterns: Column) -> Column:
    """The preset that a filter is, null if it is none or has patterns."""
    plain = extensions.isNull() & (F.regexp_replace(patterns, r"\s", "") == "")
    return F.when(plain, F.coalesce(*[F.when(same_list(categories, c), F.lit(name)) for name, c in PRESETS.items()]))


def shares(clusters: DataFrame) -> DataFrame:
    """(cluster, category, n, share) from (cluster, category) rows."""
    counted = clusters.groupBy("cluster", "category").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cluster")))


def progress(files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(cluster, total, done) of (cluster, path) against reviewed (path)."""
    marked = files.join(reviewed.select("path", F.lit(True).alias("seen")).distinct(), "path", "left")
    return marked.groupBy("cluster").agg(F.count("*").alias("total"), F.count_if("seen").alias("done"))


def next_unreviewed(files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(pos, next): for each position the next one that is not reviewed, around the end; null if there is none.

    ``files``: list, pos, path.
    """
    open_pos = F.when(F.col("seen").isNull(), F.col("pos"))
    marked = files.join(reviewed.select("path", F.lit(True).alias("seen")).distinct(), "path", "left")
    ahead = F.min(open_pos).over(W.partitionBy("list").orderBy("pos").rowsBetween(1, W.unboundedFollowing))
    first = F.min(open_pos).over(W.partitionBy("list"))
    return marked.select("list", "pos", F.coalesce(ahead, first).alias("next"))


def recent(opened: DataFrame, keep: int = 30) -> DataFrame:
    """The last opening of each id, most recent first, at most ``keep`` per owner. ``opened``: owner, id, at."""
    last = opened.groupBy("owner", "id").agg(F.max("at").alias("at"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("at"), "id"))).where(F.col("rank") <= keep)


def prefix_budget(hunks: DataFrame, budget: int = 6000) -> DataFrame:
    """(path, hunk, kept, truncated): how many of a hunk's lines fit into the budget of its file, in order."""
    before = F.coalesce(F.sum("lines").over(W.partitionBy("path").orderBy("hunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = F.least("lines", F.greatest(F.lit(budget) - before, F.lit(0)))
    return hunks.select("path", "hunk", kept.alias("kept"), (kept < F.col("lines")).alias("truncated"))


def source_slice(files: DataFrame, first: Column, last: Column) -> DataFrame:
    """path, total, from, lines: lines first..last of ``files`` (path, content), clamped to what there is, at least one line."""
    rows = F.split("content", "\n")
    total = F.size(rows)
    start = F.greatest(F.lit(1), F.least(first, total))
    end = F.greatest(start, F.least(last, total))
    return files.select("path", total.alias("total"), start.alias("from"), F.slice(rows, start, end - start + 1).alias("lines"))


def cache_split(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted blobs (path, key) with hit: whether the cache (key) has them; the path is the requester's."""
    return wanted.join(cache.select("key", F.lit(True).alias("hit")).distinct(), "key", "left").select("path", "key", F.coalesce("hit", F.lit(False)).alias("hit"))


def unmapped(files: DataFrame, covered: DataFrame) -> DataFrame:
    """Files (path) in no cluster."""
    return files.join(covered.select("path"), "path", "left_anti")


def tree_nodes(paths: DataFrame) -> DataFrame:
    """(parent, name, kind, files): the directory tree of ``paths`` (path), chains of single directories collapsed.

    A directory that holds one directory and nothing else is joined with it to one node.
    """
    parts = F.split("path", "/")
    dirs = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).where("dir <> ''").groupBy("dir").agg(F.count("*").alias("files"))
    parent = lambda c: F.regexp_replace(F.when(F.contains(c, F.lit("/")), c).otherwise(F.lit("")), "/?[^/]*$", "")
    children = dirs.groupBy(parent(F.col("dir")).alias("dir")).agg(F.count("*").alias("dirs"))
    direct = paths.groupBy(parent(F.col("path")).alias("dir")).agg(F.count("*").alias("leaves"))
    shown = dirs.join(children, "dir", "left").join(direct, "dir", "left").where((F.coalesce("dirs", F.lit(0)) != 1) | F.col("leaves").isNotNull())
    return shown.select("dir", "files", F.coalesce("dirs", F.lit(0)).alias("dirs"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


def call_sites(edges: DataFrame, owners: DataFrame, lines: DataFrame, width: int = 200) -> DataFrame:
    """src, dst, path, line, text: the caller's line for each edge (src, dst, lines), its first, else the start of the caller (id, path, start).

    ``lines`` (path, line, text) are the callers' files; a line that a file has not gives no row.
    """
    first = F.coalesce(F.get("lines", F.lit(0)), F.col("start"))
    at = edges.select("src", "dst", "lines").join(owners.select(F.col("id").alias("src"), "path", "start"), "src").select("src", "dst", "path", first.cast("int").alias("line"))
    return at.join(lines, ["path", "line"]).select("src", "dst", "path", "line", F.substring(F.trim("text"), 1, width).alias("text"))


def wide_reach(risk: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """id, external_callers: the changed symbols (id, external_callers) that most other files call, ``most`` of them; ties by id."""
    return risk.where(F.col("external_callers") >= least).select("id", "external_callers").orderBy(F.desc("external_callers"), "id").limit(most)


def cluster_scope(files: DataFrame, ranked: DataFrame) -> DataFrame:
    """path, position: of ``files`` (path) those of one cluster, in its order, an array of paths (files) in one row."""
    return ranked.select(F.posexplode("files").alias("position", "path")).join(files.select("path").distinct(), "path").select("path", (F.col("position") + 1).alias("position"))


def payload_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in the order in which they are delivered, by a range-partitioned sort; give it columns that leave no ties."""
    return rows.orderBy(*columns)
