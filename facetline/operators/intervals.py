"""Line intervals: innermost owner, counts per owner, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MODULE = "<module>"
#: Lines per segment of the range join: spans are copied to the segments that they touch, lines look in theirs only.
SEGMENT = 64


def _segmented(spans: DataFrame, first: str, last: str, width: int) -> DataFrame:
    return spans.withColumn("segment", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` by path and segment in as many parts as shuffles have. Few bytes of lines and spans meet in many rows, so their parts are not
    put together by bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "segment")


def innermost(lines: DataFrame, spans: DataFrame, width: int = SEGMENT) -> DataFrame:
    """path, line, owner of every line: the smallest span around it, the first (ord) of equals, else ``<module>``.

    ``lines`` (path, line), ``spans`` (path, start, end, qual, ord); spans that end before they start, and module
    spans, never win. The range condition is an equi-join on path and line segment.
    """
    real = spans.where((F.col("end") >= F.col("start")) & (F.col("qual") != MODULE))
    cut = _segmented(real, "start", "end", width)
    lined = lines.select("path", "line").distinct().withColumn("segment", F.floor(F.col("line") / width))
    inside = _dealt(lined).join(cut, ["path", "segment"]).where("line BETWEEN start AND end")
    best = inside.groupBy("path", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "ord", "qual")).alias("b"))
    return lined.join(best, ["path", "line"], "left").select("path", "line", F.coalesce("b.qual", F.lit(MODULE)).alias("owner"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(path, first, last): closed ranges without overlaps, from ``ranges`` (path, first, count).

    Each range is clipped to what lies behind the furthest end before it; what is left of it is kept.
    """
    last = F.col("first") + F.col("count") - 1
    ahead = W.partitionBy("path").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    clipped = ranges.where("count > 0").withColumn("last", last).withColumn("done", F.max("last").over(ahead))
    return clipped.select("path", F.greatest("first", F.coalesce(F.col("done") + 1, "first")).alias("first"), "last").where("first <= last")


def owner_counts(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, owner, lines): changed lines by innermost owner; a line in overlapping ranges counts once.

    Boundaries cut the file into stretches with one owner each, and ranges are intersected with these, so ranges
    need not be expanded into lines.
    """
    real = spans.where((F.col("end") >= F.col("start")) & (F.col("qual") != MODULE))
    # owners of stretches between boundaries
    bounds = real.select("path", F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("at")).distinct()
    stretch = bounds.select("path", F.col("at").alias("from"), (F.lead("at").over(W.partitionBy("path").orderBy("at")) - 1).alias("to")).where("to IS NOT NULL")
    owners = innermost(stretch.select("path", F.col("from").alias("line")), real).withColumnRenamed("line", "from")
    owned = stretch.join(owners, ["path", "from"]).where(F.col("owner") != MODULE)
    # of ranges that begin on one line the longest covers all, so what is merged is bounded by the lines and not by the ranges
    merged = merged_ranges(ranges.where("count > 0").groupBy("path", "first").agg(F.max("count").alias("count")))
    pieces = _dealt(_segmented(merged, "first", "last", SEGMENT)).join(_segmented(owned, "from", "to", SEGMENT), ["path", "segment"])
    pieces = pieces.select("path", "owner", F.greatest("first", "from", F.col("segment") * SEGMENT).alias("a"), F.least("last", "to", F.col("segment") * SEGMENT + SEGMENT - 1).alias("b")).where("a <= b")
    inside = pieces.groupBy("path", "owner").agg(F.sum(F.col("b") - F.col("a") + 1).alias("lines"))
    total = merged.groupBy("path").agg(F.sum(F.col("last") - F.col("first") + 1).alias("total"))
    rest = total.join(inside.groupBy("path").agg(F.sum("lines").alias("own")), "path", "left").select("path", F.lit(MODULE).alias("owner"), (F.col("total") - F.coalesce("own", F.lit(0))).alias("lines"))
    return inside.unionByName(rest.where("lines > 0"))


def hunk_symbols(hunks: DataFrame, spans: DataFrame, most: int = 4) -> DataFrame:
    """(path, hunk, qual, rank): for each hunk (path, hunk, start, lines) the symbols it overlaps, smallest first.

    A symbol overlaps a hunk if it begins in it, where of each line only the ``most`` smallest count, or if it is around its first line, which
    is asked once per line. So a hunk meets few candidates, however many symbols lie over each other.
    """
    ends = hunks.withColumn("hunk_end", F.col("start") + F.greatest("lines", F.lit(1)) - 1).withColumnRenamed("start", "hunk_start")
    sized = spans.where((F.col("end") >= F.col("start")) & (F.col("qual") != MODULE)).select("path", "start", "end", "qual", "ord", (F.col("end") - F.col("start")).alias("size"))
    # symbols that are the same but for their place share a rank
    rank = lambda *by: F.dense_rank().over(W.partitionBy("path", *by).orderBy("size", "ord", "qual"))
    first = sized.withColumn("n", rank("start")).where(F.col("n") <= most)
    beginning = _dealt(_segmented(ends, "hunk_start", "hunk_end", SEGMENT)).join(first.withColumn("segment", F.floor(F.col("start") / SEGMENT)), ["path", "segment"]).where("start > hunk_start AND start <= hunk_end")
    lines = ends.select("path", "hunk_start").distinct().withColumn("segment", F.floor(F.col("hunk_start") / SEGMENT))
    over = _dealt(lines).join(_segmented(sized, "start", "end", SEGMENT), ["path", "segment"]).where("hunk_start BETWEEN start AND end").select("path", "hunk_start", "size", "ord", "qual")
    over = over.withColumn("n", rank("hunk_start")).where(F.col("n") <= most)
    around = ends.join(over, ["path", "hunk_start"])
    columns = ["path", "hunk", "qual", "ord", "size"]
    once = beginning.select(*columns).unionByName(around.select(*columns)).distinct()
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("path", "hunk").orderBy("size", "ord")))
    return ranked.where(F.col("rank") <= most).select("path", "hunk", "qual", "rank")


def at_start(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, qual): lines at which a symbol starts."""
    return lines.select("path", "line").distinct().join(spans.select("path", F.col("start").alias("line"), "qual"), ["path", "line"])
