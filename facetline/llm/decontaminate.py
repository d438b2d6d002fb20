"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of word positions, some of which it ignores. The words that it keeps are hashed at
every position of every test item and training text; equal hashes are hits, which survive substitutions at
ignored positions. A diagonal (same shift between text and item) with a hit is compared word by word over its whole
length: some stretch of it, at least ``LEAST`` words or the whole item, must have its ``SHARE`` of equal words. Texts are
cut to what the diagonals near each other reach, and diagonals with one pattern of equal words are one, so that a text
takes work by its length even if it repeats one word.

Only DataFrame functions are used. The seeds of the benchmark are broadcast if a count shows them to be few, so
that the training texts are scanned without a shuffle; beyond that Spark shuffles narrow hash rows.

Cases: null and empty texts have no hits; an item with fewer words than the shortest mask spans must occur as it is;
a text with fewer words than that matches such items only; texts are taken whole; repeated rows, and rows that share an id, give one row per (id, item); rows with
a null id on either side are ignored; empty tables give an empty table. Only the named columns are read, so
other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.llm.staging import materialise, small_side

#: Word positions: 1 is hashed, 0 is ignored.
MASKS = ("11011011", "1110100111", "101101001011")
#: Least stretch (or the whole item), and its share of equal words.
LEAST, SHARE = 13, 0.75
#: Shifts of a text against an item that are compared from one cut of the text.
CUT_SHIFTS = 1024


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def seeds(rows: DataFrame, id_col: str, text_col: str, masks: tuple[str, ...] = MASKS, whole: tuple[str, ...] = ()) -> DataFrame:
    """id, pos, seed: the hash of every mask at every position where it fits; of every mask in ``whole`` where it is all of the row."""
    words = F.col("words")
    fits = lambda m: F.size(words) == len(m) if m in whole else F.col("pos") + len(m) <= F.size(words)
    hashed = [F.when(fits(m), F.xxhash64(F.lit(m), *[F.get(words, F.col("pos") + j) for j, c in enumerate(m) if c == "1"])) for m in masks]
    held = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).where(F.col("words")[0] != "")
    at = held.select("id", "words", F.posexplode("words").alias("pos", "word"))
    return at.select("id", "pos", F.explode(F.array(*hashed)).alias("seed")).where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """One row per contaminated document and item, of its best stretch: id_col, item_col, overlap_words (its length),
    equal_words, doc_start and item_start (word positions)."""
    item_size = F.size(words_of(F.col(item_text_col)))
    short = benchmark.where(F.col(item_col).isNotNull() & (words_of(F.col(item_text_col))[0] != "") & (item_size < min(map(len, masks)))).select(item_size.alias("n")).distinct()
    # fewer numbers than the shortest mask has positions
    whole = tuple("1" * r.n for r in short.orderBy("n").collect())
    test = materialise(seeds(benchmark, item_col, item_text_col, masks + whole, whole).select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "seed"), "benchmark-seeds")
    hits = seeds(docs, id_col, text_col, masks + whole).join(small_side(test), "seed")
    diagonals = hits.select(F.col("id").alias("doc"), "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    diagonals = materialise(diagonals, "diagonals")

    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("item_words"))
    sizes = materialise(items.groupBy("item").agg(F.max(F.size("item_words")).alias("longest")), "item-sizes")
    # shifts that lie near each other share a cut of the text, which is as long as they reach; a text is read once
    near = diagonals.join(small_side(sizes), "item").groupBy("doc", "item", F.floor(F.col("shift") / CUT_SHIFTS).alias("cut")).agg(F.sort_array(F.collect_set("shift")).alias("shifts"), F.max("longest").alias("longest"))
    near = near.withColumn("base", F.greatest(F.lit(0), F.get("shifts", F.lit(0))))
    cuts = near.select("doc", F.struct("item", "shifts", "base", (F.array_max("shifts") + F.col("longest") - F.col("base")).alias("reach")).alias("cut"))
    cuts = materialise(cuts.groupBy("doc").agg(F.collect_list("cut").alias("cuts")), "cuts")
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(small_side(cuts), "doc").select("doc", words_of(F.col("text")).alias("words"), "cuts")
    part = lambda c: F.struct(c["item"].alias("item"), c["shifts"].alias("shifts"), c["base"].alias("base"), F.slice("words", c["base"] + 1, F.greatest(F.lit(0), c["reach"])).alias("part"))
    parts = texts.select("doc", F.size("words").alias("n_words"), F.explode(F.transform("cuts", part)).alias("c")).select("doc", "n_words", "c.*")
    both = parts.join(small_side(materialise(items, "items")), "item").withColumn("need", F.least(F.lit(least), F.size("item_words")))

    def compared(shift: Column) -> Column:
        first = F.greatest(F.lit(0), -shift)
        n = F.greatest(F.lit(0), F.least(F.size("item_words"), F.col("n_words") - shift) - first)
        equal = F.zip_with(F.slice("part", first + shift - F.col("base") + 1, n), F.slice("item_words", first + 1, n), lambda a, b: (a == b).cast("int"))
        return F.struct(shift.alias("shift"), first.alias("first"), equal.alias("equal"))

    each = both.select("doc", "item", "need", F.explode(F.transform("shifts", compared)).alias("d")).select("doc", "item", "need", "d.*")
    enough = each.where(F.size(F.filter("equal", lambda x: x == 1)) >= F.col("need") * share)
    # diagonals of one pattern differ in where they are in the text only, and of equal stretches the first counts
    patterns = enough.groupBy("doc", "item", "first", "need", "equal").agg(F.min("shift").alias("shift")).withColumn("which", F.xxhash64("need", "equal"))
    found = stretches(patterns, share)
    at = F.col("first") + F.col("shift")
    best = found.groupBy("doc", "item").agg(F.max(F.struct("equal", -F.col("n"), "n", -at, at.alias("at"), "first")).alias("x"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("x.n").alias("overlap_words"), F.col("x.equal").alias("equal_words"), F.col("x.at").alias("doc_start"), F.col("x.first").alias("item_start"))


def stretches(diagonals: DataFrame, share: float) -> DataFrame:
    """doc, item, shift, first, n, equal: for every place where a stretch of a diagonal can end, the one with most equal words.

    ``diagonals``: doc, item, shift, which, first (item position where it begins), need (least length), equal (0 or 1
    per word). With P = equal words - share * words, summed up to a place, a stretch has its share if P is no less at
    its end than at its start; the first place where P is no greater is the best start, by a running minimum in
    order of P. Unequal words at either end then go as long as the stretch stays long enough.
    """
    own = ["doc", "item", "shift", "which"]
    rate = round(share * 10_000)
    along = W.partitionBy(*own).orderBy("i")
    # place i is before word i of the diagonal; its row holds word i - 1
    places = diagonals.select(*own, "first", "need", F.posexplode(F.concat(F.array(F.lit(0)), "equal")).alias("i", "word"))
    summed = places.withColumns({
        "equal": F.sum("word").over(along),
        "last": F.max(F.when(F.col("word") == 1, F.col("i"))).over(along),
        "next": F.min(F.when(F.col("word") == 1, F.col("i") - 1)).over(along.rowsBetween(1, W.unboundedFollowing)),
    }).withColumn("p", F.col("equal") * 10_000 - F.col("i") * rate)
    start = F.min(F.struct("i", "equal", "next")).over(W.partitionBy(*own).orderBy("p"))
    ended = summed.withColumn("start", start).where(F.col("i") - F.col("start.i") >= F.col("need"))
    end = F.greatest("last", F.col("start.i") + F.col("need"))
    begin = F.least("start.next", F.col("end") - F.col("need"))
    whole = ended.withColumn("end", end).withColumn("begin", begin)
    return whole.select("doc", "item", "shift", (F.col("first") + F.col("begin")).alias("first"), (F.col("end") - F.col("begin")).cast("int").alias("n"), (F.col("equal") - F.col("start.equal")).cast("int").alias("equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that ``overlaps`` finds; rows with a null id stay."""
    id_col = settings.get("id_col", "doc_id")
    found = materialise(overlaps(docs, benchmark, **settings).select(id_col).distinct(), "contaminated")
    return docs.join(small_side(found), id_col, "left_anti").select(*docs.columns)
