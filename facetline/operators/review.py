"""A whole review plan: every changed symbol in a cluster, clusters in reading order, risk, files that no cluster has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetline.operators import planning as P
from facetline.operators.staging import materialise
from facetline.operators.traversal import components

#: Vote of a loose test's group for the cluster of a test that it is linked with.
VOTE_COMPANION = 1


def is_core(kind: Column, category: Column) -> Column:
    """Whether a changed symbol makes clusters: neither a test nor module code."""
    return (kind != "module") & (category != "test")


def segment(kind: Column, category: Column) -> Column:
    """Reading segment: 0 logic, 1 module code, 2 tests."""
    return F.when(category == "test", 2).when(kind == "module", 1).otherwise(0)


class _Links:
    """Exact links of satellites, as tables: ``near`` (id, b) to and from live symbols, once a direction; ``hops`` (id, x) to symbols
    outside the change and ``beyond`` (x, b) from there to live ones, never paired with each other."""

    def __init__(self, satellites: DataFrame, live: DataFrame, changed: DataFrame, edges: DataFrame) -> None:
        exact = edges.where("NOT fuzzy").select("src", "dst", "kind")
        # references of module code do not count on its own hop
        counts = "NOT is_module OR kind <> 'references'"
        flags, ids = satellites.select("id", "is_module"), live.select("id")
        out = exact.join(flags.withColumnRenamed("id", "src"), "src").where(counts)
        into = exact.join(flags.withColumnRenamed("id", "dst"), "dst").where(counts)
        direct = out.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("b"))
        incoming = into.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("b"))
        self.near = materialise(direct.unionAll(incoming).where("id <> b"), "near")
        self.hops = materialise(out.join(changed.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"), F.col("dst").alias("x")), "hops")
        through = exact.join(self.hops.select(F.col("x").alias("src")).distinct(), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        self.beyond = materialise(through.select(F.col("src").alias("x"), F.col("dst").alias("b")), "beyond")

    def ballots(self, voters: DataFrame, owner: DataFrame, link: int = P.VOTE_LINK, bridge: int = P.VOTE_BRIDGE) -> DataFrame:
        """(id, cluster, votes) of the voters (id), none of which is in ``owner`` (id, cluster).

        What lies beyond a hub is counted by cluster first, so a hub's callers meet its clusters and not its callees.
        """
        mine, of = voters.select("id"), owner.select(F.col("id").alias("b"), "cluster")
        direct = self.near.join(mine, "id", "left_semi").join(of, "b").groupBy("id", "cluster").agg((F.count("*") * link).alias("n"))
        reach = self.beyond.join(of, "b").groupBy("x", "cluster").agg((F.count("*") * bridge).alias("n"))
        bridged = self.hops.join(mine, "id", "left_semi").join(reach, "x").select("id", "cluster", "n")
        return direct.unionAll(bridged).groupBy("id", "cluster").agg(F.sum("n").alias("votes"))

    def groups(self, loose: DataFrame) -> DataFrame:
        """(id, root) of loose satellites (id, parent): joined by links, by symbols that both sides use, by a parent.

        All that a hub leads from and to is one group, so each is linked with the least one of the other side.
        """
        ids = loose.select("id")
        near = self.near.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("id", "b")
        a, b = self.hops.join(ids, "id", "left_semi"), self.beyond.join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
        over = a.join(b.groupBy("x").agg(F.min("b").alias("b")), "x").select("id", "b").unionAll(b.join(a.groupBy("x").agg(F.min("id").alias("id")), "x").select("id", "b"))
        held = loose.where("parent IS NOT NULL")
        first = held.join(held.groupBy("parent").agg(F.min("id").alias("b")), "parent").select("id", "b")
        parent = held.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id", F.col("parent").alias("b"))
        links = near.unionAll(over).unionAll(first).unionAll(parent).where("id <> b")
        return components(ids, links.select(F.col("id").alias("src"), F.col("b").alias("dst")))

    def waiting(self, modules: DataFrame) -> DataFrame:
        """(id): those of the modules (id) that are linked with one of a smaller id among them."""
        ids = modules.select("id")
        near = self.near.where("b < id").join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("id")
        least = self.beyond.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").groupBy("x").agg(F.min("b").alias("least"))
        over = self.hops.join(ids, "id", "left_semi").join(least, "x").where("least < id").select("id")
        return near.unionAll(over).distinct()


def attached(clusters: DataFrame, live: DataFrame, changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) of all live symbols (id, path, kind, category, parent): the core as ``clusters`` (id, cluster) has it, and its satellites.

    ``changed`` (id) holds the deleted symbols too: no bridge leads through them. Only exact edges count.

    * Tests and module code go to the cluster of the core with most votes: two for each link, one for each way over a symbol that
      did not change; then to the larger one, then to the smaller label.
    * Tests without a vote form groups by their links and parents. A group goes where most of the tests and modules that it is
      linked with went, else it is a cluster of its own, labelled by its smallest id.
    * Module code without a vote goes, in the order of ids, by votes over all that have a cluster by then, else where most symbols of its
      file are, else nowhere. Modules wait for linked ones of smaller ids only, so hardly ever is there more than a round.

    A symbol that is linked with itself only is linked with nothing. Empty tables give empty ones.
    """
    outside = live.join(clusters.select("id"), "id", "left_anti")
    own = materialise(outside.select("id", "path", "parent", (F.col("kind") == "module").alias("is_module")), "satellites")
    links = _Links(own, live, changed, edges)
    won = materialise(P.elected(links.ballots(own, clusters), clusters), "won")

    loose = materialise(own.where("NOT is_module").join(won, "id", "left_anti").select("id", "parent"), "loose")
    groups = materialise(links.groups(loose), "groups")
    seen = links.near.join(groups, "id").join(won.select(F.col("id").alias("b"), "cluster"), "b")
    company = P.elected(seen.groupBy(F.col("root").alias("id"), "cluster").agg((F.count("*") * VOTE_COMPANION).alias("votes")), clusters)
    tests = groups.join(company.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("cluster", "root").alias("cluster"))
    owner = materialise(clusters.select("id", "cluster").unionByName(won).unionByName(tests), "owners")

    by_file = owner.join(live.select("id", "path"), "id").groupBy("path", "cluster").agg(F.count("*").alias("votes"))
    pending = materialise(own.where("is_module").join(won, "id", "left_anti").select("id", "path"), "modules")
    filed = materialise(pending.join(P.elected_by_file(by_file, clusters), "path").select("id", F.col("cluster").alias("filed")), "filed")
    while not pending.isEmpty():
        later = materialise(pending.join(links.waiting(pending), "id", "left_semi"), "modules")
        ready = pending.join(later.select("id"), "id", "left_anti")
        voted = P.elected(links.ballots(ready, owner), clusters)
        placed = ready.select("id").join(voted, "id", "left").join(filed, "id", "left").select("id", F.coalesce("cluster", "filed").alias("cluster")).where("cluster IS NOT NULL")
        owner, pending = materialise(owner.unionByName(placed), "owners"), later
    return owner


def ordered(owner: DataFrame, live: DataFrame, changed: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entry points (cluster, id, rank) and reading order (cluster, id, position) of attached symbols (id, cluster).

    Entry points are logic that no other logic of the cluster calls; in a cluster of tests only, tests; in one without either,
    whatever is in it. Logic comes first, then module code, then tests. ``live``: id, path, start, kind, category, additions, deletions.
    """
    facts = live.select("id", "path", "start", "kind", (F.col("additions") + F.col("deletions")).alias("churn"), segment(F.col("kind"), F.col("category")).alias("segment"))
    rows = owner.join(facts, "id")
    only = rows.groupBy("cluster").agg((F.min("segment") == 2).alias("tests_only"))
    rows = rows.join(only, "cluster").withColumn("counts", (F.col("kind") != "module") & (F.col("tests_only") | (F.col("segment") != 2)))
    some = rows.groupBy("cluster").agg(F.bool_or("counts").alias("some"))
    members = materialise(rows.join(some, "cluster").withColumn("candidate", F.col("counts") | ~F.col("some")).drop("cluster", "some"), "members")
    # references of changed module code lead nowhere
    modules = live.where("kind = 'module'").select(F.col("id").alias("src"), F.lit(True).alias("of_module"))
    kept = edges.join(modules, "src", "left").where("of_module IS NULL OR kind <> 'references'").drop("of_module")
    links = materialise(P.adjacency(live.select("id"), kept, changed.select("id")), "adjacency")
    entries = materialise(P.entry_points(owner, links, members), "entries")
    first = entries.join(members.where("segment <> 2 OR tests_only").select("id"), "id", "left_semi").select("cluster", "id", "rank")
    return entries, materialise(P.reading_order(owner, links, members, first), "order")


def review(core: DataFrame, symbols: DataFrame, edges: DataFrame, changes: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables of a review from clusters of the changed core (id, cluster).

    ``changes``: id, path, name, qual, kind, category, parent, start, status, additions, deletions; ``files`` (path): all changed
    files. Returned: ``clusters`` (as ``cluster_table``; titled by the first entry point), ``order`` (cluster, id, position),
    ``entries``, ``unmapped`` (path: files of which no cluster has a symbol) and ``risk`` of the live symbols. What still uses
    deleted symbols comes from names, not from edges: see ``operators.dangling``.
    """
    live = changes.where("status <> 'deleted'")
    owner = attached(core, live, changes.select("id"), edges)
    entries, order = ordered(owner, live, changes, edges)
    title = F.when(F.col("kind") == "module", F.col("name")).otherwise(F.col("qual"))
    titles = entries.where("rank = 1").join(live.select("id", title.alias("title")), "id").select("cluster", "title")
    made = P.cluster_table(order, live, titles)
    covered = order.join(live.select("id", "path"), "id").select("path").distinct()
    unmapped = files.select("path").distinct().join(covered, "path", "left_anti")
    return {"clusters": made, "order": order, "entries": entries, "unmapped": unmapped, "risk": P.risk(live.select("id"), symbols, edges, files)}
