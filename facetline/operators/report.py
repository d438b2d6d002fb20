"""What a reader of one symbol is given: its hunks, its numbered source and where it is called, each within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.operators.staging import measured_joins

# Lines of a diff, lines of source, call sites and characters of a call's line that are shown.
DIFF_LINES, SOURCE_LINES, CALL_SITES, SITE_LENGTH = 400, 300, 6, 200
#: Lines per segment of the interval join.
SEGMENT = 512


def _segments(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / SEGMENT), F.floor(last / SEGMENT)))


def _gathered(rows: DataFrame, keys: list[str], order: str, text: Column) -> DataFrame:
    """keys, body: the texts of each key in order, one a line; the rows of a key are within a budget already."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("all"))
    return held.select(*keys, F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("body"))


def symbol_hunks(symbols: DataFrame, hunks: DataFrame, lines: DataFrame, most: int = DIFF_LINES) -> DataFrame:
    """(id, diff): the hunks that meet a symbol, on the base side where it is deleted, else on the head side; symbols without one are absent.

    ``symbols``: id, path, start, end, deleted. ``hunks``: path, hunk, header, old_start, old_lines, new_start, new_lines, size (body
    lines). ``lines``: path, hunk, pos, type, text. A side without lines stands at its one line. Hunks are added until there are more than
    ``most`` lines, headers among them; then the first ``most`` stay and a mark follows. Only lines that are shown are gathered.
    """
    sides = F.array(*[F.struct(F.lit(old).alias("deleted"), F.col(f"{s}_start").alias("first"), (F.col(f"{s}_start") + F.greatest(f"{s}_lines", F.lit(1)) - 1).alias("last")) for old, s in ((True, "old"), (False, "new"))])
    placed = hunks.select("path", "hunk", "header", "size", F.explode(sides).alias("r")).select("path", "hunk", "header", "size", "r.*")
    a = symbols.select("id", "path", "deleted", "start", "end", _segments(F.col("start"), F.col("end")).alias("at"))
    b = placed.select("*", _segments(F.col("first"), F.col("last")).alias("at"))
    met = a.join(b, ["path", "deleted", "at"]).where("first <= end AND last >= start").where(F.col("at") == F.floor(F.greatest("start", "first") / SEGMENT))
    # a hunk has two lines at least, so no more of them can count
    few = met.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("hunk"))).where(F.col("n") <= most)
    upto = W.partitionBy("id").orderBy("hunk").rowsBetween(W.unboundedPreceding, 0)
    summed = few.withColumn("upto", F.sum(F.col("size") + 1).over(upto)).withColumn("before", F.col("upto") - F.col("size") - 1).where(F.col("before") <= most)
    cut = summed.groupBy("id").agg((F.max("upto") > most).alias("cut"))
    heads = summed.select("id", (F.col("before") + 1).alias("at"), F.col("header").alias("text"))
    sign = F.when(F.col("type") == "add", "+").when(F.col("type") == "del", "-").otherwise(" ")
    numbered = lines.withColumn("k", F.row_number().over(W.partitionBy("path", "hunk").orderBy("pos")))
    bodies = numbered.join(summed.select("id", "path", "hunk", "before"), ["path", "hunk"]).select("id", (F.col("before") + 1 + F.col("k")).alias("at"), F.concat(sign, "text").alias("text"))
    shown = _gathered(heads.unionByName(bodies).where(F.col("at") <= most), ["id"], "at", F.col("text")).join(cut, "id")
    return shown.select("id", F.concat("body", F.when(F.col("cut"), "\n... (diff truncated)").otherwise("")).alias("diff"))


def symbol_source(symbols: DataFrame, texts: DataFrame, most: int = SOURCE_LINES) -> DataFrame:
    """(id, source): numbered lines of each symbol on its side, ``most`` at most, with a mark where its end is not shown.

    ``texts``: path, deleted (the base side), line, text. Symbols that begin beyond their file, or whose file is absent, are absent.
    """
    wanted = symbols.select("id", "path", "deleted", "end", F.explode(F.sequence("start", F.least("end", F.col("start") + most - 1))).alias("line"))
    found = wanted.join(texts, ["path", "deleted", "line"])
    last = found.groupBy("id").agg((F.max("line") < F.max("end")).alias("cut"))
    body = _gathered(found, ["id"], "line", F.format_string("%5d  %s", F.col("line").cast("long"), F.col("text")))
    return body.join(last, "id").select("id", F.concat("body", F.when(F.col("cut"), "\n... (truncated)").otherwise("")).alias("source"))


def call_sites(symbols: DataFrame, places: DataFrame, edges: DataFrame, texts: DataFrame, most: int = CALL_SITES) -> DataFrame:
    """(id, sites): `path:line: text` of the first ``most`` callers of each symbol, exact ones first, then by id.

    A caller's line is the first one of its edge, else its own start (``places``: id, path, start); callers whose line their file does not
    have give none, and take a place all the same. ``edges``: src, dst, fuzzy, lines.
    """
    into = edges.join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst")
    first = into.withColumn("rank", F.row_number().over(W.partitionBy("dst").orderBy("fuzzy", "src"))).where(F.col("rank") <= most)
    at = first.join(places.select(F.col("id").alias("src"), "path", "start"), "src").select(F.col("dst").alias("id"), "rank", "path", F.coalesce(F.try_element_at("lines", F.lit(1)), F.col("start")).alias("line"))
    read = at.join(texts.where("NOT deleted").select("path", "line", "text"), ["path", "line"])
    site = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.left(F.trim("text"), F.lit(SITE_LENGTH)))
    return _gathered(read, ["id"], "rank", site).withColumnRenamed("body", "sites")


def symbol_context(symbols: DataFrame, places: DataFrame, edges: DataFrame, hunks: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, diff, source, sites) of every symbol, null where there is none: see the three parts. Each id is given once."""
    measured_joins(symbols.sparkSession)
    parts = symbols.select("id").join(symbol_hunks(symbols, hunks, lines), "id", "left")
    return parts.join(symbol_source(symbols, texts), "id", "left").join(call_sites(symbols, places, edges, texts), "id", "left")
