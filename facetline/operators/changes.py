"""Changed symbols: reconciling the symbols of both sides of a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.functions.paths import analyzable
from facetline.operators.intervals import MODULE

# Modes of links and submodules, which hold no source; bytes up to which a file is parsed.
NO_SOURCE, MOST_BYTES = ("120000", "160000"), 512 * 1024


def reconcile(files: DataFrame, head: DataFrame, base: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """path, qual, status, additions, deletions of every changed symbol.

    ``files``: path, old_path, status, base_known. ``head`` and ``base``: path, qual, start, end (the base under
    its own path). ``added`` and ``deleted``: path, owner, lines, under the head and the base path. A symbol with
    lines of its own is added if its file is, or if the base is known and lacks it; else modified. One that only
    the base has is deleted, and counts its span if no deleted line was counted.
    """
    keyed = files.select(F.col("path"), F.coalesce("old_path", "path").alias("base_path"), F.col("status").alias("file_status"), "base_known")
    mine = lambda t, side: keyed.join(t.withColumnRenamed("path", side), side)
    h = mine(head, "path").select("path", "qual", F.lit(True).alias("in_head"))
    b = mine(base, "base_path").select("path", "qual", (F.col("end") - F.col("start") + 1).alias("span"), F.lit(True).alias("in_base"))
    more = mine(added, "path").select("path", F.col("owner").alias("qual"), F.col("lines").alias("additions"))
    less = mine(deleted, "base_path").select("path", F.col("owner").alias("qual"), F.col("lines").alias("deletions"))
    both = h.join(b, ["path", "qual"], "full_outer").join(more, ["path", "qual"], "full_outer").join(less, ["path", "qual"], "full_outer").join(keyed.select("path", "file_status", "base_known"), "path")
    additions, deletions = F.coalesce("additions", F.lit(0)), F.coalesce("deletions", F.lit(0))
    here, there, module = F.coalesce("in_head", F.lit(False)), F.coalesce("in_base", F.lit(False)), F.col("qual") == MODULE
    is_new = (F.col("file_status") == "added") | (F.col("base_known") & ~there & ~module)
    gone = there & ~here & ~module
    status = F.when(gone, "deleted").when(here & is_new, "added").otherwise("modified")
    touched = gone | (additions + deletions > 0)
    return both.where(touched & (here | gone | module)).select("path", "qual", status.alias("status"), additions.alias("additions"), F.when(gone & (deletions == 0), F.col("span")).otherwise(deletions).alias("deletions"))


def changed_files(raw: DataFrame, stats: DataFrame) -> DataFrame:
    """Changed files (path, old_path, letter, shas) with their counts (path, adds, dels); without a count 0, '-' is binary."""
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    joined = raw.join(stats, "path", "left")
    number = lambda c: F.coalesce(F.try_cast(F.col(c), "int") if hasattr(F, "try_cast") else F.col(c).try_cast("int"), F.lit(0))
    return joined.select("path", "old_path", F.coalesce(F.element_at(names, F.substring("letter", 1, 1)), F.lit("modified")).alias("status"), number("adds").alias("additions"), number("dels").alias("deletions"), F.coalesce(F.col("adds") == "-", F.lit(False)).alias("binary"))


def base_targets(files: DataFrame, sizes: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path, sha of the base sides that a review parses; paths are those of the base.

    ``files``: path, old_path, status, binary, sha, mode (of the base). Added and binary files have none, nor have
    links, submodules, missing blobs, other languages and excluded paths on either side, or blobs (``sizes``: sha,
    size) above ``most`` bytes or not in the store.
    """
    base = F.coalesce("old_path", "path")
    usable = ~F.col("binary") & (F.col("status") != "added") & (F.coalesce("sha", F.lit("")) != "") & ~F.coalesce("mode", F.lit("")).isin(*NO_SOURCE)
    wanted = files.where(usable & analyzable(F.col("path")) & analyzable(base)).select(base.alias("path"), "sha")
    return wanted.join(sizes.where(F.col("size") <= most).select("sha").distinct(), "sha", "left_semi").select("path", "sha")


# Status letters of a raw diff.
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "typechange"}
