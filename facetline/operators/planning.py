"""Review planning: links between changed symbols, clusters, votes, entry points, reading order, risk."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from facetline.operators.edges import bridges, degrees
from facetline.operators.staging import materialise
from facetline.operators.traversal import components

#: Weights of links: direct, reference, bridged, member and parent, neighbours in a class.
DIRECT, REFERENCE, BRIDGED, PARENT, SIBLING = 3.0, 1.0, 1.0, 1.0, 1.0
#: Votes for a cluster: by a direct or incoming link, by a bridged one.
VOTE_LINK, VOTE_BRIDGE = 2, 1
#: Members above which a component is split, and how often; levels of communities, rounds of moves of one half on each (two are a sweep);
#: test callers shown.
SPLIT_ABOVE, SPLITS, LEVELS, ROUNDS, TEST_CALLERS = 40, 3, 10, 40, 5
#: Members and links up to which one cluster is split within a task; larger ones are split by joins.
IN_TASK = 500_000


def sibling_chain(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(src, dst): neighbours in order of (path, start, id) among the changed members of one parent. A chain, not all pairs."""
    members = symbols.where("parent IS NOT NULL").join(changed.select("id"), "id", "left_semi")
    chain = F.lead("id").over(W.partitionBy("parent").orderBy("path", "start", "id"))
    return members.select(F.col("id").alias("src"), chain.alias("dst")).where("dst IS NOT NULL")


def link_weights(core: DataFrame, symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(src, dst, weight), each link once with src < dst: exact edges, two-hop bridges through unchanged symbols,
    parents and class neighbours, added up."""
    exact = edges.where("NOT fuzzy")
    inside = exact.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
    direct = inside.select("src", "dst", F.when(F.col("kind") == "references", REFERENCE).otherwise(DIRECT).alias("weight"))
    # a bridge counts once for each symbol that it leads through
    bridged = bridges(exact, core, changed).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(BRIDGED).alias("weight"))
    own = symbols.join(core.select("id"), "id", "left_semi")
    parents = own.where("parent IS NOT NULL").join(core.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit(PARENT).alias("weight"))
    chain = sibling_chain(symbols, core).withColumn("weight", F.lit(SIBLING))
    every = direct.unionAll(bridged).unionAll(parents).unionAll(chain).where("src <> dst")
    return every.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def _moved(both: DataFrame, degrees: DataFrame) -> tuple[DataFrame, bool]:
    """(id, community) after greedy modularity moves of the nodes (id, degree, m2: twice the weight of all links of its cluster) of (u, v, w), and whether any moved.

    In every round one half of the nodes, as a bit of their hash decides, move to the neighbouring community with the largest
    gain in modularity, if there is one; gains are joins and sums over the edges, so no component has to fit into a
    task. Of equal gains the smaller label wins. After one half comes the other, then the next bit makes other halves, so
    that no two nodes always move at once. Rounds end when nothing moves in either half; as nodes move at once,
    ``ROUNDS`` ends what swings to and fro.
    """
    state, still, any_moved = materialise(degrees.select("id", "degree", "m2", F.col("id").alias("community")), "communities"), 0, False
    between = both.where("u <> v")
    for n in range(ROUNDS):
        total = state.groupBy("community").agg(F.sum("degree").alias("total"))
        near = between.join(state.select(F.col("id").alias("v"), F.col("community").alias("target")), "v").groupBy("u", "target").agg(F.sum("w").alias("links"))
        movers = state.where(F.pmod(F.shiftright(F.xxhash64("id"), n // 2), F.lit(2)) == n % 2).withColumnRenamed("community", "current")
        options = near.join(movers, near["u"] == movers["id"]).join(total.withColumnRenamed("community", "target"), "target")
        others = F.col("total") - F.when(F.col("target") == F.col("current"), F.col("degree")).otherwise(0.0)
        gained = options.select("id", "current", "target", F.round(F.col("links") - others * F.col("degree") / F.col("m2"), 9).alias("gain"))
        # a node without a link into its own community loses what its size costs there
        alone = movers.join(total.withColumnRenamed("community", "current"), "current").select("id", F.round(-(F.col("total") - F.col("degree")) * F.col("degree") / F.col("m2"), 9).alias("alone"))
        best = gained.groupBy("id").agg(F.max(F.when(F.col("target") != F.col("current"), F.col("gain"))).alias("top"), F.max(F.when(F.col("target") == F.col("current"), F.col("gain"))).alias("stay"))
        better = best.join(alone, "id").where(F.col("top") > F.coalesce("stay", "alone") + 1e-9)
        chosen = gained.where("target <> current").join(better, "id").where("gain = top").groupBy("id").agg(F.min("target").alias("to"))
        moved = materialise(state.join(chosen, "id", "left").select("id", "degree", "m2", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")), "communities")
        still = 0 if not moved.where("moved").isEmpty() else still + 1
        any_moved = any_moved or not still
        state = moved.drop("moved")
        if still >= 2 and n % 2:
            break
    return state.select("id", "community"), any_moved


def communities(nodes: DataFrame, weights: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, community): modularity communities of all nodes (id, cluster), each cluster by itself, named by their smallest members.

    ``weights`` lead from nodes of a cluster to others of it. After the moves of a level every community becomes one
    node, with what is linked within it as a loop, and the communities move on, until none does.
    """
    both = materialise(weights.select("src", "dst", "weight").unionAll(weights.select("dst", "src", "weight")).toDF("u", "v", "w"), "weights")
    ends = nodes.select(F.col("id").alias("u"), "cluster")
    m2 = materialise(ends.join(both.join(ends, "u").groupBy("cluster").agg(F.sum("w").alias("m2")), "cluster").select(F.col("u").alias("id"), "m2"), "totals")
    of = nodes.select("id", F.col("id").alias("community"))
    for _ in range(levels):
        degrees = both.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("degree")).join(m2, "id")
        state, any_moved = _moved(both, degrees)
        if not any_moved:
            break
        step = state.toDF("community", "to")
        of = materialise(of.join(step, "community", "left").select("id", F.coalesce("to", "community").alias("community")), "communities")
        ends = both.join(state.toDF("u", "cu"), "u").join(state.toDF("v", "cv"), "v")
        both = materialise(ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "weights")
    return of.select("id", F.min("id").over(W.partitionBy("community")).alias("community"))


def _half_moved(state: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, degree: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Communities after one round of :func:`_moved` for the nodes whose ``turn`` it is; loops are in ``degree`` alone."""
    n, m2 = len(state), degree.sum()
    total = np.bincount(state, degree, n)
    key, at = np.unique(u * n + state[v], return_inverse=True)
    node, target = key // n, key % n
    own = target == state[node]
    gain = np.round(np.bincount(at, w, len(key)) - (total[target] - np.where(own, degree[node], 0)) * degree[node] / m2, 9)
    stay = np.round(-(total[state] - degree) * degree / m2, 9)
    stay[node[own]] = gain[own]
    top = np.full(n, -np.inf)
    np.maximum.at(top, node[~own], gain[~own])
    # of equal gains the first is kept, so they are set from the last to the first
    best = np.flatnonzero(~own & turn[node] & (gain == top[node]) & (gain > stay[node] + 1e-9))[::-1]
    moved = state.copy()
    moved[node[best]] = target[best]
    return moved


def _split_in_task(rows: pd.DataFrame) -> pd.DataFrame:
    """:func:`communities` of one cluster (src, dst, weight, hash), where every node has a row from itself to itself, without weight."""
    ids, at = np.unique(np.concatenate((rows["src"], rows["dst"])), return_inverse=True)
    a, b = at[: len(rows)], at[len(rows) :]
    bits = np.zeros(len(ids), np.int64)
    bits[a] = rows["hash"]
    linked = (rows["weight"] > 0).to_numpy()
    u, v, w = np.concatenate((a[linked], b[linked])), np.concatenate((b[linked], a[linked])), np.tile(rows["weight"].to_numpy()[linked], 2)
    of, n = np.arange(len(ids)), len(ids)
    for _ in range(LEVELS if len(w) else 0):
        degree, state, still, any_moved, between = np.bincount(u, w, n), np.arange(n), 0, False, u != v
        for r in range(ROUNDS):
            moved = _half_moved(state, u[between], v[between], w[between], degree, (bits >> r // 2) % 2 == r % 2)
            still = 0 if (moved != state).any() else still + 1
            any_moved, state = any_moved or not still, moved
            if still >= 2 and r % 2:
                break
        if not any_moved:
            break
        of = state[of]
        key, at = np.unique(state[u] * n + state[v], return_inverse=True)
        u, v, w = key // n, key % n, np.bincount(at, w, len(key))
    least = np.full(n, n)
    np.minimum.at(least, of, np.arange(n))
    return pd.DataFrame({"id": ids, "community": ids[least[of]]})


def core_clusters(core: DataFrame, weights: DataFrame, split_above: int = SPLIT_ABOVE, in_task: int = IN_TASK) -> DataFrame:
    """(id, cluster): components of the links; those above ``split_above`` members are split into communities, and these again, ``SPLITS`` times at most.

    Clusters of up to ``in_task`` members and links are split in a task each, larger ones by joins, with one result.
    """
    parts = materialise(components(core, weights).withColumnRenamed("root", "cluster"), "components")
    for _ in range(SPLITS):
        large = parts.groupBy("cluster").count().where(F.col("count") > split_above).select("cluster")
        members = parts.join(large, "cluster", "left_semi").select("id", "cluster")
        a, b = members.toDF("src", "cluster"), members.toDF("dst", "dst_cluster")
        inner = weights.join(a, "src").join(b, "dst").where("cluster = dst_cluster").select("cluster", "src", "dst", "weight")
        loops = members.select("cluster", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"))
        rows = materialise(loops.unionAll(inner).withColumn("hash", F.xxhash64("src")), "large")
        sizes = materialise(rows.groupBy("cluster").agg(F.count("*").alias("rows")), "sizes")
        n, most = sizes.agg(F.count("*"), F.max("rows")).first()
        if not n:
            break
        split = rows.join(sizes.where(F.col("rows") <= in_task), "cluster", "left_semi").groupBy("cluster").applyInPandas(lambda x: _split_in_task(x), core.select("id", F.col("id").alias("community")).schema)
        if most > in_task:
            rest = materialise(rows.join(sizes.where(F.col("rows") > in_task), "cluster", "left_semi"), "rest")
            split = split.unionAll(communities(rest.where("src = dst").select(F.col("src").alias("id"), "cluster"), rest.where("src <> dst")))
        parts = materialise(parts.join(split, "id", "left").select("id", F.coalesce("community", "cluster").alias("cluster")), "components")
    return parts


def votes(satellites: DataFrame, clusters: DataFrame, edges: DataFrame, changed: DataFrame, changed_core: DataFrame) -> DataFrame:
    """(id, cluster, votes): exact links of each satellite (id, skip_refs) with core members, in either direction or bridged.

    Of module-level satellites (skip_refs) references do not count on the first hop.
    """
    exact = edges.where("NOT fuzzy")
    first = exact.join(satellites.withColumnRenamed("id", "src"), "src").where("NOT skip_refs OR kind <> 'references'")
    owner = clusters.select(F.col("id").alias("b"), "cluster")
    direct = first.select(F.col("src").alias("id"), F.col("dst").alias("b"), F.lit(VOTE_LINK).alias("n"))
    incoming = exact.join(satellites.withColumnRenamed("id", "dst"), "dst").where("NOT skip_refs OR kind <> 'references'").join(changed.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("b"), F.lit(VOTE_LINK).alias("n"))
    hop = first.join(changed.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"), F.col("dst").alias("x"))
    bridged = hop.join(exact.select(F.col("src").alias("x"), F.col("dst").alias("b")), "x").where("b <> id").select("id", "b", F.lit(VOTE_BRIDGE).alias("n"))
    every = direct.unionAll(incoming).unionAll(bridged)
    return every.join(owner, "b").join(changed_core.select(F.col("id").alias("b")), "b", "left_semi").groupBy("id", "cluster").agg(F.sum("n").alias("votes"))


def elected(ballots: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster) with most votes; then the larger cluster, then the smaller label."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    ranked = ballots.join(sizes, "cluster", "left").withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("votes"), F.desc(F.coalesce("size", F.lit(0))), "cluster")))
    return ranked.where("rank = 1").select("id", "cluster")


def elected_by_file(ballots: DataFrame, clusters: DataFrame) -> DataFrame:
    """(path, cluster) with most votes of (path, cluster, votes). A file elects once, so its symbols never meet all its clusters."""
    return elected(ballots.select(F.col("path").alias("id"), "cluster", "votes"), clusters).withColumnRenamed("id", "path")


def adjacency(live: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(a, b): reading-order links among live symbols: exact edges, and bridges through unchanged symbols."""
    exact = edges.where("NOT fuzzy")
    direct = exact.join(live.select(F.col("id").alias("src")), "src", "left_semi").join(live.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return direct.unionAll(bridges(exact, live, changed).select("a", "b")).distinct()


def entry_points(clusters: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, id, rank): members that no counted member of their cluster calls, else the one with the best priority.

    Priority: most links inside, most churn, then (path, start, id). ``members``: id, path, start, churn, counts; where a column
    ``candidate`` is given, it says who may be an entry point, and ``counts`` only whose calls make others none.
    """
    may = "candidate" if "candidate" in members.columns else "counts"
    own = clusters.join(members, "id")
    inner = links.join(clusters.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(clusters.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb AND a <> b")
    called = inner.join(members.where("counts").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("called", F.lit(True))
    out = inner.groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("inside"))
    rated = own.where(may).join(called, "id", "left").join(out, "id", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    order = [F.desc("inside"), F.desc("churn"), "path", "start", "id"]
    free = F.max(F.col("called").isNull()).over(W.partitionBy("cluster"))
    chosen = rated.withColumns({"any_free": free, "best": F.row_number().over(W.partitionBy("cluster").orderBy(*order))}).where((F.col("any_free") & F.col("called").isNull()) | (~F.col("any_free") & (F.col("best") == 1)))
    return chosen.select("cluster", "id", F.row_number().over(W.partitionBy("cluster").orderBy(*order)).alias("rank"))


def _discovery(rows: pd.DataFrame) -> pd.DataFrame:
    """:func:`_discovered` of one cluster: its members (id, segment, place, key) and links from ``id`` to ``b``, in one frame."""
    is_link = rows["b"].notna().to_numpy()
    nodes = rows[~is_link].sort_values(["segment", "place"])
    ids, keys, places = nodes["id"].to_numpy(), nodes["key"].to_numpy(), nodes["place"].to_numpy()
    at = {x: i for i, x in enumerate(ids)}
    links = rows[is_link]
    after: list[list[int]] = [[] for _ in ids]
    for a, b in zip(links["id"].tolist(), links["b"].astype(ids.dtype).tolist(), strict=True):
        after[at[a]].append(at[b])
    for x in after:
        x.sort(key=keys.__getitem__)
    seen, order = np.zeros(len(ids), bool), []
    for root in range(len(ids)):
        if seen[root]:
            continue
        seen[root] = True
        order.append(root)
        for node in itertools.islice(order, len(order) - 1, None):  # grows while it is walked
            for b in after[node]:
                if not seen[b]:
                    seen[b] = True
                    order.append(b)
    cluster = rows["cluster"].iloc[0]
    return pd.DataFrame({"cluster": cluster, "id": ids[order], "position": np.arange(1, len(ids) + 1)})


def _discovered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster, id, position) of the nodes (cluster, id, segment, place, key) over links (id, b) within a cluster and segment.

    The root of a node is the first place from which it can be reached, by passing on least places until none changes. Then
    levels go out from all roots at once: of a level, nodes stand in the order of their first finder, then of their keys.
    """
    state = materialise(nodes.withColumn("root", F.col("place")), "roots")
    while True:
        less = links.join(state.select("id", "root"), "id").groupBy(F.col("b").alias("id")).agg(F.min("root").alias("seen"))
        moved = materialise(state.join(less, "id", "left").select("cluster", "id", "segment", "place", "key", F.least("root", F.coalesce("seen", "root")).alias("root"), (F.col("seen") < F.col("root")).alias("moved")), "roots")
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    # what an earlier root reaches as well is none of a later root's
    ends = links.join(state.select("id", "root"), "id").join(state.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b")
    links = materialise(ends.where("root = root_b").select("id", "b"), "inner")
    within = W.partitionBy("cluster").orderBy("segment", "root", "finder", "key")
    seen = materialise(state.where("place = root").withColumns({"level": F.lit(0), "finder": F.lit(0).cast("long")}).withColumn("rank", F.row_number().over(within).cast("long")), "levels")
    frontier, level = seen, 0
    while True:
        level += 1
        met = links.join(frontier.select("id", F.col("rank").alias("finder")), "id").groupBy(F.col("b").alias("id")).agg(F.min("finder").alias("finder"))
        fresh = state.join(met, "id").join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level)).withColumn("rank", F.row_number().over(within).cast("long"))
        frontier = materialise(fresh.select(*seen.columns), "levels")
        if frontier.isEmpty():
            break
        seen = materialise(seen.unionAll(frontier), "levels") if level % 8 == 0 else seen.unionAll(frontier)
    return seen.select("cluster", "id", F.row_number().over(W.partitionBy("cluster").orderBy("segment", "root", "level", "rank")).alias("position"))


def reading_order(clusters: DataFrame, links: DataFrame, members: DataFrame, entries: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(cluster, id, position): in the order of discovery, breadth first, from one root after the other; logic, then module code, then tests.

    Roots of a segment are the entry points (but of module code), then what nothing in the segment leads to, then the
    rest, each by (path, start, id); what a root reaches comes before the next root, and of one node's successors the
    least (path, start, id) first. Clusters of up to ``in_task`` members and links are walked in a task each, larger ones by joins
    over all of them, with one result. ``members``: id, path, start, segment (0 logic, 1 module, 2 test).
    """
    placed = clusters.join(members.select("id", "path", "start", "segment"), "id")
    own = placed.select("id", "cluster", "segment")
    ends = links.where("a <> b").join(own.toDF("a", "ca", "sa"), "a").join(own.toDF("b", "cb", "sb"), "b")
    inner = materialise(ends.where("ca = cb AND sa = sb").select(F.col("ca").alias("cluster"), F.col("a").alias("id"), "b").distinct(), "inner")
    called = inner.select(F.col("b").alias("id")).distinct().withColumn("called", F.lit(True))
    rows = placed.join(entries.select("id", F.col("rank").alias("entry")), "id", "left").join(called, "id", "left")
    entry = F.when(F.col("segment") != 1, F.col("entry"))
    place = F.row_number().over(W.partitionBy("cluster", "segment").orderBy(F.asc_nulls_last(entry), F.coalesce("called", F.lit(False)), "path", "start", "id"))
    key = F.row_number().over(W.partitionBy("cluster").orderBy("path", "start", "id"))
    nodes = materialise(rows.select("cluster", "id", F.col("segment").cast("int").alias("segment"), place.alias("place"), key.alias("key")), "places")
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("n")).join(inner.groupBy("cluster").agg(F.count("*").alias("m")), "cluster", "left")
    sizes = materialise(sizes.select("cluster", (F.col("n") + F.coalesce("m", F.lit(0))).alias("size")), "sizes")
    none = F.lit(None)
    both = nodes.withColumn("b", none.cast(inner.schema["b"].dataType)).unionByName(inner.select("cluster", "id", none.cast("int").alias("segment"), none.cast("int").alias("place"), none.cast("int").alias("key"), "b"))
    schema = T.StructType([nodes.schema["cluster"], nodes.schema["id"], T.StructField("position", T.IntegerType())])
    small = both.join(sizes.where(F.col("size") <= in_task), "cluster", "left_semi").groupBy("cluster").applyInPandas(_discovery, schema)
    large = sizes.where(F.col("size") > in_task)
    if large.isEmpty():
        return small
    return small.unionByName(_discovered(nodes.join(large, "cluster", "left_semi"), inner.join(large, "cluster", "left_semi").select("id", "b")))


def cluster_table(order: DataFrame, changes: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row per cluster, numbered by most symbols, most churn, first title: sums, ordered files, categories.

    ``changes``: id, path, name, category, additions, deletions; the title is that of ``titles`` (cluster, title), else the
    name of the first symbol.
    """
    rows = order.join(changes, "id")
    files = rows.groupBy("cluster", "path").agg(F.min("position").alias("first")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "path"))), lambda x: x["path"]).alias("files"))
    kinds = rows.groupBy("cluster", "category").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    sums = rows.groupBy("cluster").agg(F.count("*").alias("symbols"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.min_by("name", "position").alias("title"))
    if titles is not None:
        sums = sums.drop("title").join(titles, "cluster")
    # one row per cluster: numbering them is a sort of a table that is far smaller than the symbols
    number = F.row_number().over(W.orderBy(F.desc("symbols"), F.desc(F.col("additions") + F.col("deletions")), "title", "cluster"))
    return sums.join(files, "cluster").join(kinds, "cluster").withColumn("id", F.concat(F.lit("c"), number))


def risk(live: DataFrame, symbols: DataFrame, edges: DataFrame, changed_paths: DataFrame, most: int = TEST_CALLERS) -> DataFrame:
    """id, callers, external_callers, fan_out, tested, test_callers of every live symbol.

    Tests within two hops upstream, at most ``most``: direct ones first, exact before fuzzy, then by id; then those
    of the callers, in the callers' order. All edge kinds count. ``symbols``: id, path, category.
    """
    callers = edges.join(live.select(F.col("id").alias("dst")), "dst", "left_semi")
    of_caller = callers.join(symbols.select(F.col("id").alias("src"), "path"), "src").join(changed_paths.select("path", F.lit(True).alias("inside")), "path", "left")
    external = of_caller.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("inside").isNull()).alias("external_callers"))
    tests = symbols.where("category = 'test'").select(F.col("id").alias("src"))
    test_edges = edges.join(tests, "src", "left_semi").select(F.col("src").alias("test"), F.col("dst").alias("to"), F.col("fuzzy").alias("test_fuzzy"))
    near = test_edges.join(live.select(F.col("id").alias("to")), "to", "left_semi").select(F.col("to").alias("id"), "test", F.struct(F.lit(1).alias("hop"), F.col("test_fuzzy").alias("f1"), F.lpad(F.col("test").cast("string"), 20, "0").alias("c"), F.lit(False).alias("f2"), F.col("test").alias("t")).alias("o"))
    # of one caller's tests no more can be shown, and one may be the symbol itself
    first = test_edges.withColumn("n", F.row_number().over(W.partitionBy("to").orderBy("test_fuzzy", "test"))).where(F.col("n") <= most + 1)
    far = callers.select(F.col("src").alias("to"), F.col("dst").alias("id"), "fuzzy").join(first, "to").select("id", "test", F.struct(F.lit(2).alias("hop"), F.col("fuzzy").alias("f1"), F.lpad(F.col("to").cast("string"), 20, "0").alias("c"), F.col("test_fuzzy").alias("f2"), F.col("test").alias("t")).alias("o"))
    found = near.unionByName(far).where("test <> id").groupBy("id", "test").agg(F.min("o").alias("o"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("o"))).where(F.col("rank") <= most)
    listed = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "test"))), lambda x: x["test"]).alias("test_callers"))
    counted = degrees(live, edges).withColumnRenamed("callees", "fan_out")
    rows = counted.join(external, "id", "left").join(listed, "id", "left")
    return rows.select("id", "callers", F.coalesce("external_callers", F.lit(0)).alias("external_callers"), "fan_out", F.col("test_callers").isNotNull().alias("tested"), F.coalesce("test_callers", F.array().cast(listed.schema["test_callers"].dataType)).alias("test_callers"))
