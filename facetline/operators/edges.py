"""Edge tables: merging raw uses, degrees, filters, two-hop links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Strength of an edge kind.
STRENGTH = {"calls": 5, "instantiates": 5, "renders": 5, "inherits": 4, "references": 1}
#: Lines that an edge keeps.
LINE_CAP = 25


def strength(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair]), kind), F.lit(0))


def merge_edges(uses: DataFrame, cap: int = LINE_CAP) -> DataFrame:
    """One edge per (src, dst) of ``uses`` (src, dst, kind, fuzzy, line, ord): the strongest kind, the first of equals;
    fuzzy only if all are; the first ``cap`` distinct lines in order of ``ord``. Self-loops go."""
    firsts = uses.where("src <> dst").groupBy("src", "dst", "line").agg(
        F.min("ord").alias("ord"),
        F.max(F.struct(strength(F.col("kind")).alias("s"), (-F.col("ord")).alias("o"), "kind")).alias("best"),
        F.bool_and("fuzzy").alias("fuzzy"),
    )
    # all lines count for the kind, and no more than ``cap`` of them are gathered
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy("src", "dst").orderBy("ord", "line")))
    held = F.array_sort(F.collect_list(F.when(F.col("rank") <= cap, F.struct("rank", "line"))))
    merged = ranked.groupBy("src", "dst").agg(F.max("best").alias("best"), F.bool_and("fuzzy").alias("fuzzy"), F.transform(held, lambda x: x["line"]).alias("lines"))
    return merged.select("src", "dst", F.col("best.kind").alias("kind"), "fuzzy", "lines")


def edge_ok(kinds: list[str] | None = None, fuzzy: bool = True) -> Column:
    """Condition on an edge: one of the kinds, and exact unless fuzzy ones are allowed."""
    wanted = F.lit(True) if kinds is None else F.col("kind").isin(kinds)
    return wanted & (F.lit(fuzzy) | ~F.col("fuzzy"))


def degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, callers, callees of every symbol: all kinds, fuzzy ones too."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.sum("e.i").alias("callers"), F.sum("e.o").alias("callees"))
    return symbols.select("id").join(counted, "id", "left").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def bridges(edges: DataFrame, core: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(a, x, b): core a reaches another core b through one x outside core (and outside ``changed``).

    The two hops are equi-joins on x; nothing is paired that has no edge.
    """
    outside = core if changed is None else core.select("id").unionAll(changed.select("id"))
    first = edges.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(outside.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("a"), F.col("dst").alias("x"))
    second = edges.join(core.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("x"), F.col("dst").alias("b"))
    return first.join(second, "x").where("a <> b").select("a", "x", "b").distinct()


def bridge_nodes(edges: DataFrame, core: DataFrame) -> DataFrame:
    """(x): nodes outside core between two different core nodes.

    The distinct core successors of x are reduced to their number and least member first, so a hub is not paired
    with all its neighbours.
    """
    succ = edges.join(core.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("x")).agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("least"))
    pred = edges.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("a"), F.col("dst").alias("x"))
    return pred.join(succ, "x").where((F.col("n") > 1) | (F.col("least") != F.col("a"))).select("x").distinct()
