"""The numbered queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.llm import bm25, codebooks, decontaminate, exactdedup, langid, license_scan, neardup, quality, runs, sentencepiece_codec, sharding, staging, token_counts, warc

N_SHARDS = 24


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = sentencepiece_codec.encode_and_decode(docs, piece_model())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sentencepiece_codec.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits that its own text decides: an insertion, a deletion, a new end."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    size = F.length("text")
    change = lambda at, delete, insert: F.struct(at.cast("int").alias("at"), delete.cast("int").alias("delete"), insert.alias("insert"))  # noqa: E731
    edits = F.array(
        change(F.pmod(F.crc32("text"), size + 1), F.lit(0), F.concat_ws(" ", F.lit(" edit"), "doc_id")),
        change(F.floor(size / 2), F.lit(24), F.lit("")),
        change(F.greatest(size - 7, F.lit(0)), F.lit(7), F.substring("text", 1, 40)),
    )
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = token_counts.build_trees(docs.withColumn("edits", edits), ranks, pattern, keep=["edits"])
    after = token_counts.apply_edits(trees, "edits", ranks, pattern)
    return after.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "encoded", (F.octet_length("leaf_chars") / 4).cast("long").alias("n_leaves"), F.sha2("text", 256).alias("edited_sha256"))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(id_col.cast("string")) % folds


def is_held_out(id_col: Column, folds: int, remainder: int) -> Column:
    """Whether nothing is learned from a row; nothing is from a row without an id."""
    return F.coalesce(fold(id_col, folds) == remainder, F.lit(True))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = staging.materialise(quality.statistics_table(docs), "statistics")
    held_out = is_held_out(F.col("id"), 4, 2)
    scored = quality.score(stats, quality.train(stats, labels, ~held_out))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = is_held_out(F.col("doc_id"), 3, 1)
    found = langid.identify(docs, langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, asked by all terms of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = bm25.build_index(docs)
    asked = bm25.document_queries(docs.where(F.col("doc_id") % 100 == 0), index)
    return bm25.search(index, asked, k=10).withColumnRenamed("query", "query_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.overlaps(docs, benchmark)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return neardup.near_duplicates(docs, words=2, percent=80)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.read_archives(warc.write_archives(pages, min_bytes=0)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.withColumns({"size": sharding.text_size(F.col("text")), "text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    return sharding.shard(sized, N_SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    numbers = hashlib.sha256(",".join(map(str, books.numbers())).encode()).hexdigest()
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return codebooks.with_label_errors(coded).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(numbers).alias("codebooks_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, as the id decides, go on in a period of their own from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, runs.words_of(F.col("text"))).alias("w")).withColumn("n", F.size("w"))
    a = F.when(F.col("n") > 0, F.pmod("g", "n"))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    planned = chosen.withColumn("a", a).withColumn("p", period)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))  # noqa: E731
    changed = F.transform("w", lambda _, i: F.get("w", place(i).cast("int")))
    return planned.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", changed)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    better = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))  # noqa: E731
    best = F.array_max(F.transform("runs", better))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return digests.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_token_counts": op2_token_counts,
        "op3_license_scan": op3_license_scan,
        "op4_quality": op4_quality,
        "op5_top_k_search": op5_top_k_search,
        "op6_decontamination": op6_decontamination,
        "op7_near_dedup": op7_near_dedup,
        "op8_language_id": op8_language_id,
        "op9_warc": op9_warc,
        "op10_sharding": op10_sharding,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_vector_codes": op12_vector_codes,
        "op13_periodic_runs": op13_periodic_runs,
    }


#: Hex SHA-1 to base32: 20 bits, so four letters, from every five hex digits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INTEGER, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM g
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))
                      WHEN len(ws) = 1 THEN ws ELSE [] END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
f AS (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS df FROM e),
-- the rarest shingles of a set of n, n - ceil(0.8 n) + 1 of them, meet those of any set that is similar enough
r AS (SELECT f.doc_id, g, n, row_number() OVER (PARTITION BY f.doc_id ORDER BY df, g) AS k FROM f JOIN n USING (doc_id)),
p AS (SELECT doc_id, g, n FROM r WHERE k <= n - ceil(n * 80 / 100.0) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
l AS (
  SELECT a, b FROM (
    SELECT c.a, c.b, count(*) AS x FROM c JOIN e ea ON ea.doc_id = c.a JOIN e eb ON eb.doc_id = c.b AND eb.g = ea.g GROUP BY c.a, c.b) i
  JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b
  WHERE 100 * x >= 80 * (na.n + nb.n - x)),
u AS (SELECT a AS v, b AS w FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS w FROM documents UNION SELECT reach.v, u.w FROM reach JOIN u ON u.v = reach.w)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT v, min(w) AS component_id FROM reach GROUP BY v) m ON m.v = n.doc_id
"""


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS k FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""


def _op12_sql() -> str:
    """Four rounds, each a pair of tables: entries e of the round, and the nearest entry n of each part."""
    near = """n{r} AS (
  SELECT id, p, min_by(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT v.id, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN e{r} b USING (p)) GROUP BY id, p)"""
    refine = """e{s} AS (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM e{r} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS x FROM (
      SELECT n.p, n.e, i, ((sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
      FROM n{r} n JOIN v USING (id, p), unnest(range(1, len(v.x) + 1)) AS u(i) GROUP BY n.p, n.e, i) GROUP BY p, e) m USING (p, e))"""
    steps = [near.format(r=0)]
    for r in range(4):
        steps += [refine.format(r=r, s=r + 1), near.format(r=r + 1)]
    return """
WITH q AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, p, list_slice(x, p * len(x) // 4 + 1, (p + 1) * len(x) // 4) AS x FROM q, range(4) AS u(p)),
e0 AS (SELECT p, id AS e, x FROM v WHERE id < 256),
""" + ",\n".join(steps) + """,
c AS (SELECT id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n4 GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN q USING (id), h
"""


#: crc32 bit by bit over the eight-bit characters of a decimal number.
_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda t, i: xor(t >> 1, 3988292384 * (t & 1))))"""

OP13_SQL = rf"""
WITH h AS (SELECT doc_id, row_number() OVER () AS r, xor({_CRC32}, 4294967295) AS h,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS o FROM documents),
s AS (SELECT doc_id, r, h, h // 10 AS g, o, len(o) AS n FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM s),
w AS (SELECT doc_id, r, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
        list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w FROM a),
x AS (SELECT r, n, u.i - 1 AS i, w[u.i] AS w FROM w, unnest(range(1, n + 1)) AS u(i)),
-- equal places of each diagonal, and their stretches
m AS (SELECT y.r, y.i, z.i - y.i AS q FROM x y JOIN x z ON y.r = z.r AND y.w = z.w AND z.i > y.i AND 4 * (z.i - y.i) <= y.n),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m),
t AS (SELECT r, q, min(i) AS i, count(*) + q AS l FROM k GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
-- one with a smaller period lies in a run of that period
f AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.r = t.r AND b.q < t.q AND b.i <= t.i AND b.i + b.l >= t.i + t.l)),
b AS (SELECT r, count(*) AS n_runs, min(struct_pack(l := -l, i := i, q := q)) AS b, string_agg(i || ',' || l || ',' || q || chr(10), '' ORDER BY i, q) AS lines FROM f GROUP BY r),
gone AS (SELECT DISTINCT r, u.i FROM f, unnest(range(f.i + f.q, f.i + f.l)) AS u(i)),
c AS (SELECT x.r, string_agg(w, ' ' ORDER BY x.i) AS c FROM x ANTI JOIN gone ON gone.r = x.r AND gone.i = x.i GROUP BY x.r)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.b.i::BIGINT AS start, (-b.b.l)::BIGINT AS length, b.b.q::BIGINT AS period,
       (1000 * -b.b.l // b.b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM w LEFT JOIN b USING (r) LEFT JOIN c USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_near_dedup": OP7_SQL, "op9_warc": OP9_SQL, "op11_exact_dedup": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_periodic_runs": OP13_SQL}
