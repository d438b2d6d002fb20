"""Path, filter and facet queries over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetline.functions import globs as G
from facetline.functions import paths as P
from facetline.functions import text as X
from facetline.operators import serving as S
from facetline.plans import entities as N
from facetline.sources.jsonc import parse_jsonc


def _files(spark, d):
    return N.paths(spark, d).select("id", "path", P.category(F.col("path")).alias("category"), F.coalesce(F.nullif(P.extension(F.col("path")), F.lit("")), F.lit("(none)")).alias("ext"))


def classify(spark, d):
    return N.paths(spark, d).select("id", P.builtin_category(F.col("path")).alias("category"))


def classify_override(spark, d):
    overrides = {"docs": ["*.svg", "!logo.svg"], "nonsense": ["*"], "config": ["src/", "/Docs/**/*.md"], "style": ["*.rs"]}
    return N.paths(spark, d).select("id", P.category(F.col("path"), overrides).alias("category"))


def language(spark, d):
    return N.paths(spark, d).select("id", P.language_of(F.col("path")).alias("language"), P.extension(F.col("path")).alias("ext"))


def analyzable(spark, d):
    return N.paths(spark, d).select("id", P.analyzable(F.col("path")).alias("analyzable"))


def scan_route(spark, d):
    return N.paths(spark, d).select("id", P.scan_route(F.col("path"), F.col("size"), max_bytes=3000).alias("route"))


def path_parts(spark, d):
    p = F.col("path")
    return N.paths(spark, d).select("id", P.basename(p).alias("name"), P.dirname(p).alias("dir"), P.normalize(F.concat(F.lit("./a/../"), p, F.lit("/../x"))).alias("normal"), F.array_join(P.ancestors(p), "|").alias("above"))


def file_filter(spark, d):
    return _files(spark, d).where(S.file_filter(["source", "config", "test"], None, "MAIN, app !*.lock")).select("id", "path")


def glob_filter(spark, d):
    return N.paths(spark, d).where(G.pattern_filter(F.col("path"), "src/**/*.ts* !test readme")).select("id", "path")


def facets(spark, d):
    return S.facets(_files(spark, d), ["source", "test"], [".py", ".ts", "(none)"], "")


def facet_universe(spark, d):
    return S.universe(S.facets(_files(spark, d), None, None), P.CATEGORIES)


def chip_toggle(spark, d):
    words = F.array_distinct(F.array("o_orderstatus", "o_orderpriority", F.lit("F")))
    every = F.array(*[F.lit(x) for x in ("F", "O", "P", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    out = S.toggle(F.when(F.col("o_orderkey") % 3 != 0, words), F.col("o_orderstatus"), every)
    alone = S.toggle(words, F.col("o_orderstatus"), every, exclusive=True)
    return N.table(spark, d, "orders").select("o_orderkey", F.array_join(out, ",").alias("toggled"), F.array_join(alone, ",").alias("others"))


def preset_equal(spark, d):
    """The preset that a filter is: lists of categories in any order, extensions and patterns, made up from a file's number."""
    k = F.col("id") % 9
    pick = lambda *c: F.array(*[F.lit(x) for x in c])
    categories = (
        F.when(k == 0, pick("source")).when(k == 1, pick("test")).when(k == 2, pick("style", "template")).when(k == 3, pick("other", "migration", "config", "style", "template", "source"))
        .when(k == 4, pick("source", "test")).when(k == 5, pick("source", "source")).when(k == 6, F.array("category")).when(k == 7, pick().cast("array<string>"))
    )
    extensions = F.when(F.col("id") % 5 == 0, pick(".py")).when(F.col("id") % 5 == 1, pick().cast("array<string>"))
    patterns = F.when(F.col("id") % 7 == 0, " src/** ").when(F.col("id") % 7 == 1, " \n ").otherwise("")
    return _files(spark, d).select("id", S.active_preset(categories, extensions, patterns).alias("preset"))


def excluded_categories(spark, d):
    every = F.array(*[F.lit(x) for x in P.CATEGORIES])
    sets = _files(spark, d).groupBy("ext").agg(F.collect_set("category").alias("c"))
    return sets.select("ext", F.array_join(F.array_except(every, "c"), ",").alias("excluded"))


def category_histogram(spark, d):
    return _files(spark, d).groupBy("category", "ext").agg(F.count("*").alias("n"))


def directory_tree(spark, d):
    return S.tree_nodes(N.paths(spark, d).select("path").distinct())


def jsonc(spark, d):
    """Event properties dressed up with comments and trailing commas, and parsed."""
    text = F.concat(F.lit("// note\n{/* a */ \"u\": \"http://x//y\", "), F.expr("substring(props, 2, length(props) - 2)"), F.lit(",\n}"))
    parsed = parse_jsonc(text, "u string, k int")
    return N.table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["u"].alias("u"))


def source_slice(spark, d):
    docs = N.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), "n_chars")
    rows = S.source_slice(docs.select("path", "content"), F.pmod("path", F.lit(5)).cast("int"), F.pmod("path", F.lit(9)).cast("int"))
    return rows.select("path", "total", "from", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n")).alias("digest"))


def cache_split(spark, d):
    """Every third document's text is in the cache already."""
    docs = N.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("key"))
    return S.cache_split(docs, docs.where("path % 3 = 0"))


def blob_sizes(spark, d):
    return N.table(spark, d, "documents").groupBy(F.md5("text").alias("sha")).agg(F.max(F.octet_length("text")).alias("size"))


def first_of_key(spark, d):
    from facetline.sources.tables import first_wins

    rows = N.table(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("var"), F.col("o_totalprice").alias("type"), F.col("o_orderkey").alias("ord"))
    return first_wins(rows, ["scope", "var"], "type", "ord")


def last_of_key(spark, d):
    from facetline.sources.tables import last_wins

    rows = N.table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("local"), F.col("o_totalprice").alias("module"), F.col("o_orderkey").alias("ord"))
    return last_wins(rows, ["path", "local"], "ord")


def recent_list(spark, d):
    """The last opening of each page of a user, by event time, most recent first, five per user."""
    opened = N.table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("props").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return S.recent(opened, keep=5)


def review_progress(spark, d):
    files = N.table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("path"))
    reviewed = N.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    return S.progress(files, reviewed)


def next_unreviewed(spark, d):
    orders = N.table(spark, d, "orders")
    files = orders.select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("path"))
    return S.next_unreviewed(files, orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("path")))


def relative_time(spark, d):
    """Events seen from a while later that doubles with their number, from a second before to decades after."""
    seconds = F.pow(F.lit(2.0), F.col("event_id") % 31) + F.col("event_id") % 7 - 2.5
    then = F.col("ts").cast("timestamp")
    now = F.timestamp_micros(F.unix_micros(then) + (seconds * 1_000_000).cast("long"))
    return N.table(spark, d, "events").select("event_id", X.relative_time(then, now).alias("label"))


def remote_names(spark, d):
    """Addresses of customers on two hosts, with and without ending, and some that name no repository."""
    k, name = F.col("c_custkey"), F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_name"))
    start = F.element_at(F.array(*[F.lit(x) for x in ("git@github.com:", "https://github.com/", " ssh://git@github.com//", "git@example.org:", "https://github.com/a/")]), (k % 5 + 1).cast("int"))
    url = F.concat(start, name, F.when(k % 3 == 0, ".git").when(k % 3 == 1, "/").otherwise(".git/"))
    return N.table(spark, d, "customer").select("c_custkey", X.normalize_remote(url).alias("remote"))


def request_numbers(spark, d):
    value = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("#"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://x/o/r/pull/"), F.col("o_orderkey").cast("string"), F.lit("/files"))).otherwise("branch")
    return N.table(spark, d, "orders").select("o_orderkey", X.request_number(value).alias("number"))


def type_names(spark, d):
    """Annotations of both languages around a brand: wrappers, several deep, generics, unions, quotes, names of no class."""
    brand = F.regexp_replace("p_brand", "#", "")
    around = [("Optional[", "]"), ("", " | None"), ("Promise<Array<", ">>"), ("str", ""), ('"', '.Inner"'), ("List[", "]"), ("Annotated[", ", x]"), ("Map<A, ", ">"), ("Repo<", ">"), ("Type[Final[Optional['", "']]]"), ("Type[Type[Type[Type[", "]]]]"), ("null | undefined | ", "[]"), ("None", "x"), ("Readonly<", ">"), ("Optional[", " | None, int]"), ("  '", "' "), ("(", ")"), ("Callable[[", "], int]")]
    kind = F.col("p_partkey") % len(around)
    raw = F.element_at(F.array(*[F.concat(F.lit(a), F.lit("") if a == "str" else brand, F.lit(b)) for a, b in around]), (kind + 1).cast("int"))
    return N.table(spark, d, "part").select("p_partkey", X.normalize_type(raw).alias("type"))


def request_filter(spark, d):
    """Substring filter over number, title, author and branch."""
    held = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus"))
    return N.table(spark, d, "orders").where(F.contains(held, F.lit("urgent f"))).select("o_orderkey")


def base_commits(spark, d):
    from facetline.sources.tables import base_commit

    state = F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("MERGED")
    return N.table(spark, d, "orders").select("o_orderkey", base_commit(state, F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey"))).alias("base"))


def unmapped_files(spark, d):
    files = N.paths(spark, d).select("path").distinct()
    return S.unmapped(files, _files(spark, d).where("category IN ('source', 'test')").select("path"))


def union_of_names(spark, d):
    part, nation = N.table(spark, d, "part").select(F.col("p_name").alias("name")), N.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return part.unionByName(nation).distinct()


def ordered_distinct(spark, d):
    """Priorities of a customer's orders, each once, as they first came."""
    firsts = N.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    listed = firsts.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("p"))
    return listed.select("o_custkey", F.array_join("p", ",").alias("priorities"))


def base_targets(spark, d):
    """Base sides of the documents' paths: every fourth is renamed, a half of these from an excluded folder; some are added, binary, links or not stored."""
    from facetline.operators.changes import base_targets

    n, sha = F.col("id"), F.concat(F.lit("s"), F.col("id"))
    old = F.when(n % 8 == 1, F.concat(F.lit("vendor/"), "path")).when(n % 8 == 5, F.concat(F.lit("old/"), "path"))
    status = F.when(n % 4 == 1, "renamed").when(n % 4 == 2, "added").when(n % 12 == 3, "deleted").otherwise("modified")
    mode = F.when(n % 11 == 0, "120000").when(n % 13 == 0, "160000").otherwise("100644")
    files = N.paths(spark, d)
    rows = files.select("path", old.alias("old_path"), status.alias("status"), (n % 9 == 0).alias("binary"), F.when(n % 7 != 0, sha).alias("sha"), mode.alias("mode"))
    return base_targets(rows, files.where("id % 5 <> 0").select(sha.alias("sha"), "size"), most=3000)


def status_letters(spark, d):
    """Orders as changed files of every status letter, renames and copies with their old path and a similarity."""
    from facetline.operators.changes import changed_files

    letters = F.element_at(F.array(*[F.lit(x) for x in ("A", "M", "D", "R100", "C075", "T", "X")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    key = F.col("o_orderkey").cast("string")
    orders = N.table(spark, d, "orders").select(key.alias("path"), F.when(letters.isin("R100", "C075"), F.concat(F.lit("old/"), key)).alias("old_path"), letters.alias("letter"), (F.col("o_custkey") % 50).cast("string").alias("adds"), F.lit("1").alias("dels"))
    return changed_files(orders.select("path", "old_path", "letter"), orders.select("path", "adds", "dels"))


QUERIES = {
    "pf7_base_targets": base_targets,
    "sc4_status_letters": status_letters,
    "pf1_classify": classify,
    "pf2_classify_override": classify_override,
    "pf3_language": language,
    "pf4_analyzable": analyzable,
    "pf6_scan_route": scan_route,
    "fn_path_parts": path_parts,
    "pf11_file_filter": file_filter,
    "pf12_glob_filter": glob_filter,
    "ag13_facets": facets,
    "ag14_facet_universe": facet_universe,
    "pf14_chip_toggle": chip_toggle,
    "pf13_preset_equal": preset_equal,
    "pf19_excluded_categories": excluded_categories,
    "ag7_category_histogram": category_histogram,
    "sl13_directory_tree": directory_tree,
    "sc16_jsonc": jsonc,
    "sc18_source_slice": source_slice,
    "jn2_cache_split": cache_split,
    "sc3_blob_sizes": blob_sizes,
    "ag20_first_wins": first_of_key,
    "sc15_last_wins": last_of_key,
    "sc20_recent_list": recent_list,
    "ag16_review_progress": review_progress,
    "sl14_next_unreviewed": next_unreviewed,
    "fn_relative_time": relative_time,
    "jn27_remote_names": remote_names,
    "fn_request_numbers": request_numbers,
    "fn_type_names": type_names,
    "pf15_request_filter": request_filter,
    "sc14_base_commits": base_commits,
    "st2_unmapped_files": unmapped_files,
    "st1_union_of_names": union_of_names,
    "st4_ordered_distinct": ordered_distinct,
}

_q = lambda names: ", ".join(f"'{x}'" for x in names)
EXT = r"regexp_extract(lower(regexp_extract(path, '[^/]*$')), '^\.*[^.].*?(\.[^.]*)$', 1)"
CATEGORY = f"""CASE
  WHEN name IN ({_q(P.GENERATED_NAMES)}) OR regexp_matches(name, '{P.GENERATED_FILE}') OR regexp_matches(lower, '{P.GENERATED_DIR}') THEN 'generated'
  WHEN regexp_matches(name, '{P.TEST_FILE}') OR regexp_matches(lower, '{P.TEST_DIR}') THEN 'test'
  WHEN regexp_matches(lower, '{P.MIGRATION_DIR}') AND ext IN ({_q(P.MIGRATION_EXT)}) THEN 'migration'
  WHEN ext IN ({_q(P.TEMPLATE_EXT)}) OR (ext = '.txt' AND contains('/' || lower, '/templates/')) THEN 'template'
  WHEN ext IN ({_q(P.STYLE_EXT)}) THEN 'style' WHEN ext IN ({_q(P.ASSET_EXT)}) THEN 'asset'
  WHEN name IN ({_q(P.CONFIG_NAMES)}) OR regexp_matches(name, '{P.CONFIG_FILE}') OR regexp_matches(lower, '{P.CONFIG_DIR}') THEN 'config'
  WHEN ext IN ({_q(P.DOCS_EXT)}) OR starts_with(lower, 'docs/') OR name IN ({_q(P.DOCS_NAMES)}) THEN 'docs'
  WHEN ext IN ({_q(P.CONFIG_EXT)}) THEN 'config' WHEN ext IN ({_q([*P.LANGUAGES, *P.MORE_SOURCE_EXT])}) THEN 'source' ELSE 'other' END"""
FILES = f"WITH {N.PATHS}, parts AS (SELECT *, lower(path) AS lower, lower(regexp_extract(path, '[^/]*$')) AS name, {EXT} AS ext FROM paths), files AS (SELECT id, path, {CATEGORY} AS category, CASE WHEN ext = '' THEN '(none)' ELSE ext END AS ext FROM parts)"
EXCLUDED = r"(^|.*/)(node_modules|bower_components|vendor|dist|build|\.next|coverage|site-packages|\.venv|venv)/.*|(.*/)?[^/]*(\.min\.js|\.bundle\.js|\.d\.ts)(/.*)?"
LANG = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"

ORACLES = {
    "pf7_base_targets": f"""WITH {N.PATHS}, t AS (SELECT id, size, 's' || id AS sha, CASE id % 8 WHEN 1 THEN 'vendor/' || path WHEN 5 THEN 'old/' || path ELSE path END AS path FROM paths), p AS (SELECT *, {EXT} AS ext FROM t)
SELECT path, sha FROM p WHERE id % 4 <> 2 AND id % 9 <> 0 AND id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0 AND id % 5 <> 0 AND size <= 3000 AND coalesce({LANG} IN ({_q(P.ANALYZABLE)}), false) AND NOT regexp_full_match(path, '{EXCLUDED}')""",
    "sc4_status_letters": """SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 7 IN (3, 4) THEN 'old/' || o_orderkey END AS old_path, ['added', 'modified', 'deleted', 'renamed', 'copied', 'typechange', 'modified'][o_orderkey % 7 + 1] AS status, (o_custkey % 50)::INTEGER AS additions, 1 AS deletions, false AS "binary" FROM orders""",
    "pf1_classify": f"{FILES} SELECT id, category FROM files",
    "pf2_classify_override": f"{FILES} SELECT id, CASE WHEN path LIKE '%.svg' AND regexp_extract(path, '[^/]*$') <> 'logo.svg' THEN 'docs' WHEN regexp_matches(path, '(^|/)src/') OR regexp_matches(path, '^Docs/.*\\.md$') THEN 'config' WHEN path LIKE '%.rs' THEN 'style' ELSE category END AS category FROM files",
    "pf3_language": f"WITH {N.PATHS}, p AS (SELECT id, {EXT} AS ext FROM paths) SELECT id, {LANG} AS language, ext FROM p",
    "pf4_analyzable": f"WITH {N.PATHS}, p AS (SELECT id, path, {EXT} AS ext FROM paths) SELECT id, coalesce({LANG} IN ({_q(P.ANALYZABLE)}), false) AND NOT regexp_full_match(path, '{EXCLUDED}') AS analyzable FROM p",
    "pf6_scan_route": f"WITH {N.PATHS}, p AS (SELECT id, path, size, {EXT} AS ext, regexp_extract(path, '[^/]*$') AS name FROM paths) SELECT id, CASE WHEN regexp_full_match(path, '{EXCLUDED}') THEN NULL WHEN name = 'tsconfig.json' THEN 'tsconfig' WHEN name = 'package.json' THEN 'package' WHEN {LANG} IN ({_q(P.ANALYZABLE)}) AND size <= 3000 THEN 'source' END AS route FROM p",
    "fn_path_parts": f"WITH {N.PATHS}, p AS (SELECT id, path, string_split(path, '/') AS s FROM paths) SELECT id, s[-1] AS name, array_to_string(s[1:len(s) - 1], '/') AS dir, array_to_string(s[1:len(s) - 1] || ['x'], '/') AS normal, array_to_string(list_transform(range(len(s) - 1, -1, -1), lambda i: array_to_string(s[1:i], '/')), '|') AS above FROM p",
    "pf11_file_filter": f"{FILES} SELECT id, path FROM files WHERE category IN ('source', 'config', 'test') AND regexp_matches(lower(path), '(^|/)[^/]*(main|app)[^/]*$') AND NOT regexp_full_match(lower(path), '[^/]*\\.lock')",
    "pf12_glob_filter": f"{FILES} SELECT id, path FROM files WHERE (regexp_matches(lower(path), '^src/(.*/)?[^/]*\\.ts[^/]*$') OR regexp_matches(lower(path), '(^|/)[^/]*readme[^/]*$')) AND NOT regexp_matches(lower(path), '(^|/)[^/]*test[^/]*$')",
    "ag13_facets": f"{FILES} SELECT 'category' AS facet, category AS value, count(*) AS n FROM files WHERE ext IN ('.py', '.ts', '(none)') GROUP BY category UNION ALL SELECT 'ext', ext, count(*) FROM files WHERE category IN ('source', 'test') GROUP BY ext",
    "ag14_facet_universe": f"{FILES}, c AS (SELECT 'category' AS facet, category AS value, count(*) AS n FROM files GROUP BY category), e AS (SELECT 'ext' AS facet, ext AS value, count(*) AS n FROM files GROUP BY ext) SELECT *, row_number() OVER (ORDER BY list_position([{_q(P.CATEGORIES)}], value)) AS position FROM c UNION ALL SELECT *, row_number() OVER (ORDER BY n DESC, value) FROM e",
    "pf14_chip_toggle": "WITH u AS (SELECT ['F', 'O', 'P', '1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] AS every) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderpriority || ',F' END AS toggled, array_to_string(list_filter(every, lambda x: x <> o_orderstatus), ',') AS others FROM orders, u",
    "pf13_preset_equal": f"""{FILES}, k AS (SELECT id, category, id % 5 AS e, id % 7 AS p, id % 9 AS k FROM files)
SELECT id, CASE WHEN e IN (0, 1) OR p = 0 THEN NULL WHEN k = 8 THEN 'all' WHEN k = 0 OR (k = 6 AND category = 'source') THEN 'logic'
  WHEN k = 1 OR (k = 6 AND category = 'test') THEN 'tests' WHEN k = 2 THEN 'templates' WHEN k = 3 THEN 'no-noise' WHEN k = 5 THEN NULL END AS preset FROM k""",
    "pf19_excluded_categories": f"{FILES}, s AS (SELECT ext, list(DISTINCT category) AS c FROM files GROUP BY ext) SELECT ext, array_to_string(list_filter([{_q(P.CATEGORIES)}], lambda x: NOT list_contains(c, x)), ',') AS excluded FROM s",
    "ag7_category_histogram": f"{FILES} SELECT category, ext, count(*) AS n FROM files GROUP BY 1, 2",
    "sl13_directory_tree": f"""WITH {N.PATHS}, p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM paths),
d AS (SELECT array_to_string(s[1:i], '/') AS dir, count(*) AS files FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p) q GROUP BY 1),
k AS (SELECT array_to_string(string_split(dir, '/')[1:len(string_split(dir, '/')) - 1], '/') AS dir, count(*) AS dirs FROM d GROUP BY 1),
l AS (SELECT array_to_string(s[1:len(s) - 1], '/') AS dir, count(*) AS leaves FROM p GROUP BY 1)
SELECT d.dir, d.files, coalesce(k.dirs, 0) AS dirs, coalesce(l.leaves, 0) AS leaves FROM d LEFT JOIN k USING (dir) LEFT JOIN l USING (dir) WHERE coalesce(k.dirs, 0) <> 1 OR l.leaves IS NOT NULL""",
    "sc16_jsonc": "SELECT event_id, (props::JSON->>'k')::INTEGER AS k, 'http://x//y' AS u FROM events",
    "sc18_source_slice": "WITH s AS (SELECT doc_id AS path, string_split(text, chr(10)) AS x, (doc_id % 5)::INTEGER AS a, (doc_id % 9)::INTEGER AS b FROM documents), t AS (SELECT path, x, len(x) AS total, greatest(1, least(a, len(x))) AS f, b FROM s), u AS (SELECT *, greatest(f, least(b, total)) AS e FROM t) SELECT path, total, f AS \"from\", e - f + 1 AS n, md5(array_to_string(x[f:e], chr(10))) AS digest FROM u",
    "jn2_cache_split": "SELECT doc_id AS path, md5(text) AS key, md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents",
    "sc3_blob_sizes": "SELECT md5(text) AS sha, max(strlen(text)) AS size FROM documents GROUP BY 1",
    "ag20_first_wins": "SELECT o_custkey AS scope, o_orderpriority AS var, arg_min(o_totalprice, o_orderkey) AS type FROM orders GROUP BY 1, 2",
    "sc15_last_wins": "SELECT o_custkey AS path, o_orderpriority AS local, arg_max(o_totalprice, o_orderkey) AS module, max(o_orderkey) AS ord FROM orders GROUP BY 1, 2",
    "sc20_recent_list": 'SELECT owner, id, "at", rank FROM (SELECT user_id AS owner, props AS id, max(epoch_us(ts)) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, props) AS rank FROM events GROUP BY 1, 2) q WHERE rank <= 5',
    "ag16_review_progress": "SELECT o_custkey AS cluster, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1",
    "sl14_next_unreviewed": "SELECT o_custkey AS list, o_orderkey AS pos, coalesce(min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER (PARTITION BY o_custkey)) AS next FROM orders",
    "fn_relative_time": """WITH s AS (SELECT event_id, greatest(2::DOUBLE ** (event_id % 31) + event_id % 7 - 2.5, 0) AS s FROM events),
u AS (SELECT event_id, s, CASE WHEN s < 60 THEN 1 WHEN s < 3600 THEN 60 WHEN s < 86400 THEN 3600 WHEN s < 2592000 THEN 86400 WHEN s < 31104000 THEN 2592000 ELSE 31104000 END AS z FROM s),
n AS (SELECT event_id, z, floor(s / z)::BIGINT AS n FROM u)
SELECT event_id, CASE WHEN z = 1 AND n <= 1 THEN 'just now' ELSE n || CASE z WHEN 1 THEN ' second' WHEN 60 THEN ' minute' WHEN 3600 THEN ' hour' WHEN 86400 THEN ' day' WHEN 2592000 THEN ' month' ELSE ' year' END || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' END AS label FROM n""",
    "jn27_remote_names": "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN lower(c_mktsegment || '/' || c_name) END AS remote FROM customer",
    "fn_request_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey::INTEGER END AS number FROM orders",
    "fn_type_names": """SELECT p_partkey, CASE p_partkey % 18 WHEN 0 THEN b WHEN 1 THEN b WHEN 4 THEN b || '.Inner' WHEN 5 THEN 'List' WHEN 6 THEN b WHEN 8 THEN 'Repo' WHEN 9 THEN b
  WHEN 10 THEN 'Type' WHEN 11 THEN b WHEN 12 THEN 'None' || b || 'x' WHEN 13 THEN 'Readonly' WHEN 14 THEN b WHEN 15 THEN b END AS type
FROM (SELECT p_partkey, replace(p_brand, '#', '') AS b FROM part)""",
    "pf15_request_filter": "SELECT o_orderkey FROM orders WHERE lower(o_orderkey || ' ' || o_orderpriority || ' ' || o_orderstatus) LIKE '%urgent f%'",
    "sc14_base_commits": "WITH x AS (SELECT *, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS oid, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey END AS tip FROM orders) SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' OR oid IS NULL THEN tip ELSE oid END, oid) AS base FROM x",
    "st2_unmapped_files": f"{FILES} SELECT DISTINCT path FROM files WHERE category NOT IN ('source', 'test')",
    "st1_union_of_names": "SELECT p_name AS name FROM part UNION SELECT n_name FROM nation",
    "st4_ordered_distinct": "SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY f), ',') AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) q GROUP BY 1",
}
