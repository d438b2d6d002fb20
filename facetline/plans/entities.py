"""The entities of a review as projections of the driver tables, for queries and for their SQL.

part gives symbols and changes, lineitem gives uses, edges, changed lines and diff lines, orders give the two
sides of a snapshot, documents give blobs, pages and documents give paths, events give configuration texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.operators.edges import merge_edges

Entity = DataFrame
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, name, qual, kind, start, end, category, parent (the last class before it in its file)."""
    part = table(spark, sf_dir, "part")
    brand, kind = F.lower(F.regexp_replace("p_brand", "#", "")), F.lower("p_type")
    test = F.col("p_type") == "PROMO"
    path = F.when(test, F.concat(F.lit("tests/"), brand, F.lit("/test_promo.py"))).otherwise(F.concat(F.lit("src/"), brand, F.lit("/"), kind, F.lit(".py")))
    name = F.regexp_replace("p_name", " ", "_")
    rows = part.select(
        F.col("p_partkey").alias("id"),
        path.alias("path"),
        name.alias("name"),
        F.concat(name, F.lit("_"), F.col("p_partkey").cast("string")).alias("qual"),
        F.when(F.col("p_size") % 10 == 0, "class").when(F.col("p_size") % 17 == 0, "module").otherwise("function").alias("kind"),
        ((F.col("p_partkey") * 7) % 997 + 1).cast("int").alias("start"),
        ((F.col("p_partkey") * 7) % 997 + 1 + F.col("p_size") - 3).cast("int").alias("end"),
        F.when(test, "test").otherwise("source").alias("category"),
        F.col("p_size").alias("size"),
    )
    before = W.partitionBy("path").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    last_class = F.max(F.when(F.col("kind") == "class", F.col("id"))).over(before)
    return rows.withColumn("parent", F.when(F.col("kind") == "function", last_class))


SYMBOLS = """symbols AS (
  SELECT *, CASE WHEN kind = 'function' THEN max(CASE WHEN kind = 'class' THEN id END) OVER (PARTITION BY path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent
  FROM (SELECT p_partkey AS id,
    CASE WHEN p_type = 'PROMO' THEN 'tests/' || lower(replace(p_brand, '#', '')) || '/test_promo.py' ELSE 'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.py' END AS path,
    replace(p_name, ' ', '_') AS name, replace(p_name, ' ', '_') || '_' || p_partkey AS qual,
    CASE WHEN p_size % 10 = 0 THEN 'class' WHEN p_size % 17 = 0 THEN 'module' ELSE 'function' END AS kind,
    ((p_partkey * 7) % 997 + 1)::INTEGER AS start, ((p_partkey * 7) % 997 + 1 + p_size - 3)::INTEGER AS "end",
    CASE WHEN p_type = 'PROMO' THEN 'test' ELSE 'source' END AS category, p_size AS size FROM part) q)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, name, kind, category, status, additions, deletions, parent, start of the changed symbols (small parts)."""
    held = symbols(spark, sf_dir).where("size <= 5 OR size IN (10, 17)")
    return held.withColumns({"status": F.when(F.col("size") == 1, "added").otherwise("modified"), "additions": F.col("size") * 2, "deletions": F.col("size")})


CHANGES = "changes AS (SELECT *, CASE WHEN size = 1 THEN 'added' ELSE 'modified' END AS status, size * 2 AS additions, size AS deletions FROM symbols WHERE size <= 5 OR size IN (10, 17))"


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, fuzzy, line, ord: parts that follow each other in an order."""
    w = W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"),
        F.lead("l_partkey").over(w).alias("dst"),
        F.when(F.col("l_returnflag") == "R", "calls").when(F.col("l_returnflag") == "A", "inherits").otherwise("references").alias("kind"),
        (F.col("l_linestatus") == "F").alias("fuzzy"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("ord"),
        "l_discount",
    )
    return rows.where("l_discount >= 0.09 AND dst IS NOT NULL AND src <> dst").drop("l_discount")


USES = """uses AS (SELECT src, dst, kind, fuzzy, line, ord FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst,
    CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'inherits' ELSE 'references' END AS kind, l_linestatus = 'F' AS fuzzy, l_linenumber AS line,
    l_orderkey * 1000 + row_number() OVER w AS ord, l_discount
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) q
  WHERE l_discount >= 0.09 AND dst IS NOT NULL AND src <> dst)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_edges(uses(spark, sf_dir))


EDGES = """edges AS (SELECT src, dst, first(kind ORDER BY CASE kind WHEN 'calls' THEN 5 WHEN 'inherits' THEN 4 ELSE 1 END DESC, ord) AS kind, bool_and(fuzzy) AS fuzzy FROM uses GROUP BY src, dst)"""

GRAPH = f"WITH {SYMBOLS}, {CHANGES}, {USES}, {EDGES}"


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, pos, text: every order is a file with one unified diff: hunk headers and body lines."""
    w = W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.row_number().over(w).alias("n"), "l_returnflag", "l_partkey", "l_suppkey", "l_linenumber")
    mark = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    body = F.concat(mark, F.lit("p"), F.col("l_partkey").cast("string"))
    header = F.concat(F.lit("@@ -"), ((F.col("n") - 1) * 10 + F.col("l_linenumber")).cast("string"), F.lit(",4 +"), ((F.col("n") - 1) * 11 + 1).cast("string"), F.lit(" @@ s"), F.col("l_suppkey").cast("string"))
    lines = F.when((F.col("n") - 1) % 4 == 0, F.array(header, body)).otherwise(F.array(body))
    return rows.select("path", "n", F.posexplode(lines).alias("k", "text")).select("path", (F.col("n") * 2 + F.col("k")).alias("pos"), "text")


DIFF = """raw_lines AS (SELECT l_orderkey::VARCHAR AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n,
    l_returnflag, l_partkey, l_suppkey, l_linenumber FROM lineitem),
  body_lines AS (SELECT path, n, CASE l_returnflag WHEN 'R' THEN 'del' WHEN 'A' THEN 'add' ELSE 'ctx' END AS type, 'p' || l_partkey AS text,
    (n - 1) // 4 AS hunk, first_value((n - 1) * 10 + l_linenumber) OVER h AS old_start, first_value((n - 1) * 11 + 1) OVER h AS new_start, first_value('s' || l_suppkey) OVER h AS section
    FROM raw_lines WINDOW h AS (PARTITION BY path, (n - 1) // 4 ORDER BY n)),
  diff AS (SELECT path, hunk, n, type, text, section,
    CASE WHEN type <> 'add' THEN old_start + count(*) FILTER (type <> 'add') OVER r - 1 END AS old_no,
    CASE WHEN type <> 'del' THEN new_start + count(*) FILTER (type <> 'del') OVER r - 1 END AS new_no
    FROM body_lines WINDOW r AS (PARTITION BY path, hunk ORDER BY n))"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, size: a repository tree made of documents, by source, language and size."""
    docs = table(spark, sf_dir, "documents")
    dirs = F.array(*[F.lit(x) for x in DIRS])
    names = F.array(*[F.lit(x) for x in NAMES])
    directory = F.element_at(dirs, (F.col("doc_id") % len(DIRS) + 1).cast("int"))
    name = F.element_at(names, (F.floor(F.col("doc_id") / len(DIRS)) % len(NAMES) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(directory, F.col("source"), F.lit("_"), F.col("lang"), F.lit("/"), name).alias("path"), F.col("n_chars").alias("size"))


DIRS = ["", "src/", "tests/", "Docs/", "app/migrations/", "vendor/lib/", "web/templates/", ".github/", "src/__tests__/", "deploy/k8s/", "dist/"]
NAMES = ["main.py", "test_main.py", "App.tsx", "app.test.ts", "index.html", "notes.txt", "style.SCSS", "logo.svg", "Dockerfile", "package-lock.json", "tsconfig.json", "x.min.js", "README.md", "settings.toml", "query.sql", "LICENSE", ".eslintrc.js", "lib.rs", "archive.tar.gz", "types.d.ts", "requirements-dev.txt", "0001_initial.py", "UserTest.java", "noext", "package.json"]
PATHS = f"paths AS (SELECT doc_id AS id, ({DIRS!r})[(doc_id % {len(DIRS)} + 1)::INTEGER] || source || '_' || lang || '/' || ({NAMES!r})[((doc_id // {len(DIRS)}) % {len(NAMES)} + 1)::INTEGER] AS path, n_chars AS size FROM documents)"
