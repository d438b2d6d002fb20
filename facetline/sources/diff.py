"""Unified diffs as tables: numbered lines, changed ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.functions.text import hunk_header, unquote
from facetline.operators.staging import materialise

HEADER = r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"


def text_lines(texts: DataFrame) -> DataFrame:
    """path, pos, text: the lines of each text (path, text)."""
    return texts.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def diff_lines(lines: DataFrame) -> DataFrame:
    """path, hunk, pos, type, old_no, new_no, text, section of the body lines of diffs (path, pos, text).

    What stands before the first hunk header, and '\\ No newline' marks, are skipped; lines without a mark are
    context. Numbers are running counts within the hunk.
    """
    # one order serves all: the header before a line is the last one so far, and counts within a hunk are counts of the file less those at its header
    upto = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    mark = F.substring("text", 1, 1)
    kind = F.when(mark == "+", "add").when(mark == "-", "del").otherwise("ctx")
    numbered = lines.withColumn("is_header", F.col("text").rlike(HEADER)).withColumn("is_body", ~F.col("is_header") & ~F.startswith(F.col("text"), F.lit("\\")))
    numbered = numbered.withColumn("type", kind).withColumns({"hunk": F.sum(F.col("is_header").cast("int")).over(upto) - 1, **{f"not_{x}": F.count_if(F.col("is_body") & (F.col("type") != x)).over(upto) for x in ("add", "del")}})
    head = F.when(F.col("is_header"), F.struct(*[v.alias(k) for k, v in hunk_header(F.col("text")).items()], "not_add", "not_del"))
    typed = numbered.withColumn("head", F.last(head, ignorenulls=True).over(upto)).where("hunk >= 0").where("is_body").withColumn("section", F.col("head.section"))
    old = F.when(F.col("type") != "add", F.col("head.old_start") + F.col("not_add") - F.col("head.not_add") - 1)
    new = F.when(F.col("type") != "del", F.col("head.new_start") + F.col("not_del") - F.col("head.not_del") - 1)
    content = F.when(mark.isin("+", "-", " "), F.expr("substring(text, 2)")).otherwise(F.col("text"))
    return typed.select("path", "hunk", "pos", "type", old.alias("old_no"), new.alias("new_no"), content.alias("text"), "section")


def file_diff(lines: DataFrame, path: str, most: int | None = None) -> DataFrame:
    """The lines (path, pos, text) of one file's diff in order, on request only the first ``most``, so that no more is read than is shown."""
    one = lines.where(F.col("path") == path).orderBy("pos")
    return one if most is None else one.limit(most)


def changed_lines(numbered: DataFrame) -> DataFrame:
    """path, side, line: added lines by their new number, deleted ones by their old number, each once."""
    return numbered.where("type <> 'ctx'").select("path", F.when(F.col("type") == "add", "head").otherwise("base").alias("side"), F.coalesce(F.when(F.col("type") == "add", F.col("new_no")), F.col("old_no")).alias("line")).distinct()


def ranges(lines: DataFrame) -> DataFrame:
    """path, side, first, count of the hunk headers of diffs without context; empty sides give no range."""
    head = hunk_header(F.col("text"))
    found = lines.where(F.col("text").rlike(HEADER)).select("path", "pos", *[v.alias(k) for k, v in head.items()])
    sides = F.array(F.struct(F.lit("base").alias("side"), F.col("old_start").alias("first"), F.col("old_lines").alias("count")), F.struct(F.lit("head").alias("side"), F.col("new_start").alias("first"), F.col("new_lines").alias("count")))
    return found.select("path", F.explode(sides).alias("r")).select("path", "r.*").where("count > 0")


def file_ranges(lines: DataFrame) -> DataFrame:
    """path, side, first, count from one diff text of many files (pos, text).

    A header block starts at 'diff --git' and ends at the first hunk header; only there are '---' and '+++' file
    names, so body lines that look like them are not. /dev/null, quoting and trailing tabs are handled; a file has
    the path of its new side, or of its old side if it is deleted. One diff may be larger than a task: only marks are sorted,
    in ranges of positions, and counts are carried from range to range.
    """
    starts, header = F.startswith(F.col("text"), F.lit("diff --git ")), F.col("text").rlike(HEADER)
    named = F.startswith(F.col("text"), F.lit("+++ ")) | F.startswith(F.col("text"), F.lit("--- "))
    # a block is what one task holds of the sorted marks; blocks are counted first, then lines within each
    blocks = materialise(lines.where(starts | header | named).repartitionByRange("source", "pos").select("source", "pos", "text", F.spark_partition_id().alias("block")), "diff-marks")
    counted = blocks.groupBy("source", "block").agg(F.count_if(starts).alias("files"))
    before = counted.select("source", "block", (F.sum("files").over(W.partitionBy("source").orderBy("block")) - F.col("files")).alias("before"))
    running = F.count_if(starts).over(W.partitionBy("source", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    staged = blocks.withColumn("run", running).join(before, ["source", "block"]).withColumn("file", F.col("run") + F.col("before")).where("file > 0")
    first = staged.groupBy("source", "file").agg(F.min(F.when(header, F.col("pos"))).alias("first"))
    heads = staged.where(named).join(first, ["source", "file"]).where("first IS NULL OR pos < first")
    name = lambda prefix: F.regexp_replace(unquote(F.regexp_replace(F.expr("substring(text, 5)"), "\t.*$", "")), f"^{prefix}/", "")
    of_side = lambda mark, prefix: F.max(F.when(F.startswith(F.col("text"), F.lit(mark)) & (name(prefix) != "/dev/null"), name(prefix)))
    names = heads.groupBy("source", "file").agg(of_side("+++ ", "b").alias("new"), of_side("--- ", "a").alias("old"))
    headers = staged.where(header).join(names, ["source", "file"]).select(F.coalesce("new", "old").alias("path"), "pos", "text")
    return ranges(headers)
