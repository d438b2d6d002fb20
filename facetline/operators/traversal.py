"""Graph walks: bounded neighbourhoods, the overview of a change, components.

Walks are driver loops over levels; every level is a join of a frontier with the edges and an anti-join with what
has been visited, written to the shared folder, so plans don't grow and a lost executor repeats one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.operators.edges import bridge_nodes, edge_ok, induced
from facetline.operators.staging import materialise

CONTAINERS = ("class", "object", "interface")


def neighborhood(symbols: DataFrame, edges: DataFrame, seeds: list, depth_in: int, depth_out: int, max_nodes: int = 150, kinds: list[str] | None = None, fuzzy: bool = True, node_ok: Column | None = None) -> tuple[DataFrame, bool]:
    """(id, depth), and whether the cap cut it: seeds and members of container seeds at 0, callees at +n, callers at -n.

    Levels go outwards, out before in, each from its own frontier; a node keeps its first depth. Within a level
    nodes are found in the order of their finder, then by id, and at most ``max_nodes`` are kept; seeds and members of
    container seeds always are, however many.
    """
    spark = symbols.sparkSession
    wanted = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds))], symbols.select("id", F.lit(0).alias("at")).schema)
    focus = symbols.join(F.broadcast(wanted), "id").select("id", "kind", "at")
    members = symbols.join(F.broadcast(focus.where(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("parent"), "at")), "parent").select("id", "at", F.lit(1).alias("sub"))
    ordered = focus.select("id", "at", F.lit(0).alias("sub")).unionAll(members).groupBy("id").agg(F.min(F.struct("at", "sub", "id")).alias("o"))
    seen = materialise(ordered.select("id", F.lit(0).alias("depth"), F.row_number().over(W.orderBy("o")).cast("long").alias("rank")), "walk")
    held = seen.count()
    usable = edges.where(edge_ok(kinds, fuzzy))
    allowed = symbols.where(F.lit(True) if node_ok is None else node_ok).select("id")
    frontiers, truncated = {"out": seen, "in": seen}, False
    for level in range(1, max(depth_in, depth_out) + 1):
        for way, limit in (("out", depth_out), ("in", depth_in)):
            if level > limit or truncated:
                continue
            here, there = ("src", "dst") if way == "out" else ("dst", "src")
            found = usable.join(frontiers[way].select(F.col("id").alias(here), "rank"), here).groupBy(F.col(there).alias("id")).agg(F.min("rank").alias("by"))
            found = found.join(allowed, "id", "left_semi").join(seen, "id", "left_anti")
            # only the best that fit are ranked, one more than is kept; a level is written once
            room = max(0, max_nodes - held)
            best = found.orderBy("by", "id").limit(room + 1)
            ranked = best.select("id", F.lit(level if way == "out" else -level).alias("depth"), F.row_number().over(W.orderBy("by", "id")).cast("long").alias("rank"))
            fresh = materialise(ranked, "walk")
            n = fresh.count()
            truncated = n > room
            frontiers[way] = fresh.where(F.col("rank") <= room)
            seen = seen.unionAll(frontiers[way])
            held += min(n, room)
    return seen.select("id", "depth"), truncated


def roles(walk: DataFrame) -> DataFrame:
    """id, depth, role of a walk."""
    return walk.withColumn("role", F.when(F.col("depth") == 0, "focus").when(F.col("depth") > 0, "callee").otherwise("caller"))


def top_connected(core: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` core nodes with most links inside core (both directions); ties by id."""
    inner = induced(edges, core)
    links = inner.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return core.select("id").join(links, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links")).orderBy(F.desc("links"), "id").limit(most)


def overview(core: DataFrame, symbols: DataFrame, edges: DataFrame, max_nodes: int = 250, neighbors: bool = False, kinds: list[str] | None = None, fuzzy: bool = True, node_ok: Column | None = None) -> DataFrame:
    """(id, role): the changed core, bridges between core nodes, and on request their neighbours.

    The core is cut to the best connected, whatever the edge filters; bridges and neighbours pass the filters.
    Bridges are taken by id up to twice the cap, neighbours by (core node, id) up to the cap; module nodes without
    an edge in the result go.
    """
    core = materialise(top_connected(core, edges, max_nodes).select("id"), "core")
    usable = edges.where(edge_ok(kinds, fuzzy))
    allowed = symbols.where(F.lit(True) if node_ok is None else node_ok).select("id")
    between = bridge_nodes(usable, core).withColumnRenamed("x", "id").join(allowed, "id", "left_semi")
    n_core = core.count()
    parts = core.withColumn("role", F.lit("changed")).unionAll(between.orderBy("id").limit(max(0, 2 * max_nodes - n_core)).withColumn("role", F.lit("bridge")))
    parts = materialise(parts, "roles")
    if neighbors:
        ends = usable.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("id")), F.struct(F.col("dst").alias("a"), F.col("src").alias("id")))).alias("e")).select("e.*")
        near = ends.join(core.select(F.col("id").alias("a")), "a", "left_semi").groupBy("id").agg(F.min("a").alias("a")).join(parts, "id", "left_anti").join(allowed, "id", "left_semi")
        room = max(0, max_nodes - parts.count())
        parts = materialise(parts.unionAll(near.orderBy("a", "id").limit(room).select("id", F.lit("neighbor").alias("role"))), "roles")
    connected = induced(edges, parts).select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    shown = parts.join(symbols.select("id", "kind"), "id").join(connected, "id", "left").where("kind <> 'module' OR linked")
    return shown.select("id", "role")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over ``links`` (src, dst), for every node (id)."""
    both = materialise(links.select("src", "dst").unionAll(links.select("dst", "src")).toDF("u", "v").distinct(), "links")
    labels = materialise(nodes.select("id", F.col("id").alias("root")).distinct(), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("root").alias("seen"))
        lower = labels.join(near, labels["id"] == near["u"], "left").select("id", F.least("root", "seen").alias("root"), (F.col("seen") < F.col("root")).alias("moved"))
        above = labels.select(F.col("id").alias("p"), F.col("root").alias("above"))
        stepped = materialise(lower.join(above, lower["root"] == above["p"], "left").select("id", F.least("root", "above").alias("root"), "moved"), "labels")
        labels = stepped.select("id", "root")
        if stepped.where("moved").isEmpty():
            return labels


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, depth): all containers of each (id, parent), the direct one at depth 1. A circle ends where it comes back.

    Every round doubles the steps: what is known up to depth n goes on from the containers that are exactly n steps above, so that a pair
    is met through one container between and not through all, and hubs near the root meet only what is n steps below them.
    """
    known, n = materialise(parents.where("parent IS NOT NULL AND parent <> id").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "ancestors"), 1
    while True:
        farthest = known.where(F.col("depth") == n)
        if farthest.isEmpty():
            return known
        upper = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        further = farthest.join(upper, "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).where("id <> ancestor")
        known, n = materialise(known.unionAll(further).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), "ancestors"), 2 * n
