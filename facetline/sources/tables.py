"""Stored facts: snapshots, the parse cache, pull requests, branches and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.operators.staging import materialise, small_side

PULL_REQUEST = "number int, title string, url string, author struct<login: string>, state string, isDraft boolean, baseRefName string, headRefName string, baseRefOid string, headRefOid string, body string, updatedAt string"


def snapshot_id(files: DataFrame) -> DataFrame:
    """One row: an id that the same set of (path, sha) always gets. Hashes add up, so no list of files is gathered."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x00", "path", "sha"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.sum(h).alias("mix")).select("files", F.substring(F.sha2(F.concat_ws(":", F.col("files").cast("string"), F.col("mix").cast("string")), 256), 1, 40).alias("id"))


def write_snapshot(files: DataFrame, folder: str) -> str:
    """Write (path, sha, content) below its id and return the id; a snapshot that exists is not written again."""
    found = snapshot_id(files).first()["id"]
    files.write.mode("ignore").parquet(f"{folder}/{found}")
    return found


def tree(entries: DataFrame) -> DataFrame:
    """Regular files of a tree listing (mode, type, sha, size, path)."""
    return entries.where("type = 'blob' AND mode <> '120000'").select("path", "sha", "size")


def blobs(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Contents (sha, content) of the wanted shas; those that the store lacks are absent."""
    return store.join(wanted.select("sha").distinct(), "sha", "left_semi").select("sha", "content").dropDuplicates(["sha"])


def put_cache(cache: DataFrame, parsed: DataFrame) -> DataFrame:
    """The cache (key, version, data) with the new rows (key, version, data, failed, at): the newest of each key; failures stay out."""
    fresh = parsed.where("NOT failed").groupBy("key", "version").agg(F.max_by("data", "at").alias("data"))
    return cache.join(fresh, ["key", "version"], "left_anti").select("key", "version", "data").unionByName(fresh)


def read_pull_requests(spark: SparkSession, path: str, limit: int = 40, state: str | None = None) -> DataFrame:
    """Pull requests from JSON lines, of one state or all, the newest first; a limit is part of the listing."""
    held = spark.read.schema(PULL_REQUEST).json(path)
    return held.where(F.lit(True) if state is None else F.col("state") == state).orderBy(F.desc("updatedAt"), "number").limit(limit)


def base_commit(state: Column, base_oid: Column, tip: Column) -> Column:
    """The base of a pull request: the branch's tip while it is open or nothing is recorded, else the recorded commit; that too where the branch is gone."""
    return F.coalesce(F.when((state == "OPEN") | base_oid.isNull(), tip).otherwise(base_oid), base_oid)


def branches(refs: DataFrame) -> DataFrame:
    """Branches (name, remote, date) without */HEAD: local ones first, each group the latest first."""
    return refs.where(~F.endswith(F.col("name"), F.lit("/HEAD"))).orderBy("remote", F.desc("date"), "name")


def remotes(rows: DataFrame) -> DataFrame:
    """name, url: the first address of each remote (name, url, ord)."""
    return rows.groupBy("name").agg(F.min_by("url", "ord").alias("url"))


def default_branch(names: DataFrame, head: str | None = None) -> DataFrame:
    """One row: the remote's head, else the first of main, master, develop that exists."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("main", "master", "develop")]), F.col("name"))
    known = names.where(order > 0).agg(F.min_by("name", order).alias("name"))
    return known.select(F.coalesce(F.lit(head), "name").alias("name"))


def history(parents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of a history (id, parent) for all walks over it: jumps (id, to) of 1, 2, 4 ... commits along first parents, and other parents (id, parent).

    The first parent is that of the least ``position``, if there is such a column, else the smallest.
    """
    links = parents.where("parent IS NOT NULL AND parent <> id")
    by = "position" if "position" in parents.columns else "parent"
    first = materialise(links.groupBy("id").agg(F.min_by("parent", by).alias("to")), "first-parents")
    other = materialise(links.join(first, "id").where("parent <> to").select("id", "parent").distinct(), "other-parents")
    jumps = [first]
    while True:
        last = jumps[-1]
        twice = materialise(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("over")), "to").select("id", F.col("over").alias("to")), "jumps")
        if twice.isEmpty():
            return jumps, other
        jumps.append(twice)


def ancestors(parents: DataFrame, start: DataFrame, known_history: tuple[list[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, distance): all commits reachable from ``start`` (id) over (id, parent), with the fewest steps; the start itself at 0.

    First parents make lines down the history. Jumps of 1, 2, 4 ... commits along them are tables (``history``, given where several walks
    share it), so that a line of any length is walked in one job for each; then other parents open new lines, and that repeats until no
    distance falls. Rounds are as many as lines that a shortest way changes between, not as generations. Distances don't depend on which
    parent is the first. A parent that has no row of its own is a commit without parents. Repeated rows change nothing; the history must
    not lead back to itself.
    """
    jumps, other = history(parents) if known_history is None else known_history

    def along(known: DataFrame) -> DataFrame:
        """Distances carried down all lines: after the jump of n commits, each commit has heard of all within 2n - 1 above it."""
        for n, jump in enumerate(jumps):
            # few commits are walked of a long history, so they go to the jumps and not the jumps to them
            known = materialise(known, "walk")
            on = jump.join(small_side(known), "id").select(F.col("to").alias("id"), (F.col("distance") + 2**n).alias("distance"))
            known = known.unionAll(on).groupBy("id").agg(F.min("distance").alias("distance"))
        return known

    seen = materialise(along(start.select("id").distinct().withColumn("distance", F.lit(0))), "commits")
    fresh = seen
    while True:
        met = fresh.join(other, "id").groupBy(F.col("parent").alias("id")).agg((F.min("distance") + 1).alias("near"))
        better = materialise(met.join(seen, "id", "left").where("distance IS NULL OR near < distance").select("id", F.col("near").alias("distance")), "turns")
        if better.isEmpty():
            return seen
        told = along(better).withColumnRenamed("distance", "near")
        # what a line tells is of use where nothing as near was known
        fresh = materialise(told.join(seen, "id", "left").where("distance IS NULL OR near < distance").select("id", F.col("near").alias("distance")), "fresh")
        seen = materialise(seen.unionAll(fresh).groupBy("id").agg(F.min("distance").alias("distance")), "commits")


def merge_base(parents: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(id): common ancestors that are no ancestors of another common ancestor, the smallest of them."""
    held = history(parents)
    common = materialise(ancestors(parents, a, held).join(ancestors(parents, b, held).select("id"), "id", "left_semi").select("id"), "common")
    inner = parents.join(common, "id", "left_semi").select(F.col("parent").alias("id"))
    return common.join(inner, "id", "left_anti").agg(F.min("id").alias("id"))


def worktree_counts(status: DataFrame) -> DataFrame:
    """One row: tracked and untracked changes of status lines (line)."""
    untracked = F.startswith(F.col("line"), F.lit("??"))
    return status.where("line <> ''").agg(F.count_if(~untracked).alias("tracked"), F.count_if(untracked).alias("untracked"))


def first_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value that came first for each key."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
