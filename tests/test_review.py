"""Satellites of a review against one symbol after the other, on random graphs with chains of module code and on empty tables."""

import random
from collections import Counter

import pytest

from facetline.operators import edges as E
from facetline.operators import planning as P
from facetline.operators import review as V
from facetline.operators import traversal as T

LIVE = "id long, path string, kind string, category string, parent long, start int, name string, qual string, status string, additions long, deletions long"
EDGES = "src long, dst long, kind string, fuzzy boolean"


def one_by_one(symbols, edges, core):
    """(id -> cluster) by rules over dicts: symbols {id: (path, kind, category, parent, status)}, core {id: cluster}."""
    live = {i for i, s in symbols.items() if s[4] not in ("deleted", None)}
    exact = {(a, b): k for a, b, k, fuzzy in edges if not fuzzy}
    sizes, owner, ways = Counter(core.values()), dict(core), {}
    pick = lambda votes: min(votes, key=lambda c: (-votes[c], -sizes[c], c)) if votes else None
    for s in sorted(live - core.keys()):
        fine = lambda k, m=symbols[s][1] == "module": not m or k != "references"
        near = [b for (a, b), k in exact.items() if a == s and b in live and fine(k)] + [a for (a, b), k in exact.items() if b == s and a in live and fine(k)]
        over = [c for (a, x), k in exact.items() if a == s and fine(k) and symbols[x][4] is None for (y, c) in exact if y == x and c in live and c != s]
        ways[s] = near, over
    vote = lambda s, known, link, bridge: sum((Counter({known[b]: w}) for found, w in zip(ways[s], (link, bridge), strict=True) for b in found if w and b in known), Counter())
    won = {s: pick(vote(s, core, 2, 1)) for s in ways}
    owner |= {s: c for s, c in won.items() if c is not None}
    loose = [s for s in ways if won[s] is None and symbols[s][1] != "module"]
    group = {s: s for s in loose}
    moved = True
    while moved:
        moved = False
        for s in loose:
            kin = [b for b in (*ways[s][0], *ways[s][1], symbols[s][3]) if b in group] + [b for b in loose if symbols[s][3] is not None and symbols[b][3] == symbols[s][3]]
            for b in kin:
                if group[b] != group[s]:
                    group[b] = group[s] = min(group[b], group[s])
                    moved = True
    attached = {s: c for s, c in owner.items() if s not in core}
    for root in set(group.values()):
        votes = sum((vote(s, attached, 1, 0) for s in loose if group[s] == root), Counter())
        owner |= {s: root if (c := pick(votes)) is None else c for s in loose if group[s] == root}
    by_file = {}
    for s, c in owner.items():
        by_file.setdefault(symbols[s][0], Counter())[c] += 1
    for s in sorted(ways):
        if won[s] is None and symbols[s][1] == "module":
            c = pick(vote(s, owner, 2, 1))
            c = pick(by_file.get(symbols[s][0])) if c is None else c
            if c is not None:
                owner[s] = c
    return owner


@pytest.mark.parametrize("seed", [1, 2])
def test_satellites_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    symbols = {}
    for i in range(150):
        status = rng.choice(["modified"] * 6 + ["deleted", None, None])
        symbols[i] = (f"p{rng.randrange(40)}", rng.choice(["function", "module", "module", "class"]), rng.choice(["source", "test"]), rng.choice([None, rng.randrange(150)]), status)
    kinds = ["calls", "references", "inherits"]
    pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(110)} | {(i, i + 2) for i in range(60, 90)}
    edges = [(a, b, rng.choice(kinds), rng.random() < 0.1) for a, b in sorted(pairs) if a != b]
    rows = [(i, p, k, c, q, i, f"n{i}", f"q{i}", s, 1, 1) for i, (p, k, c, q, s) in symbols.items()]
    table, links = spark.createDataFrame(rows, LIVE), spark.createDataFrame(edges, EDGES)
    changes = table.where("status IS NOT NULL")
    live = changes.where("status <> 'deleted'")
    core = live.where("kind <> 'module' AND category <> 'test'").select("id")
    clusters = T.components(core, E.induced(links.where("NOT fuzzy"), core)).withColumnRenamed("root", "cluster")
    want = one_by_one(symbols, edges, {r.id: r.cluster for r in clusters.collect()})
    got = {r.id: r.cluster for r in V.attached(clusters, live, changes.select("id"), links).collect()}
    assert got == want
    made = V.review(clusters, table, links, changes, changes.select("path"))
    order = {r.id: (r.cluster, r.position) for r in made["order"].collect()}
    assert {i: c for i, (c, _) in order.items()} == want
    # logic, then module code, then tests; positions without a gap
    rank = lambda i: 2 if symbols[i][2] == "test" else 1 if symbols[i][1] == "module" else 0
    for cluster in set(want.values()):
        ids = sorted((i for i in want if want[i] == cluster), key=lambda i: order[i][1])
        assert [order[i][1] for i in ids] == list(range(1, len(ids) + 1)) and [rank(i) for i in ids] == sorted(map(rank, ids))
    assert {r.path for r in made["unmapped"].collect()} == {s[0] for s in symbols.values() if s[4]} - {symbols[i][0] for i in want}


def test_nothing_changed(spark):
    none, edges = spark.createDataFrame([], LIVE), spark.createDataFrame([], EDGES)
    files = spark.createDataFrame([("a",)], "path string")
    made = V.review(none.select("id", none.id.alias("cluster")), none, edges, none, files)
    assert made["clusters"].count() == 0 and made["order"].count() == 0 and made["risk"].count() == 0
    assert [r.path for r in made["unmapped"].collect()] == ["a"]


def test_a_caller_with_many_tests_is_cut_before_it_is_joined(spark):
    """Of 300 tests of one caller of 50 symbols the first five stay, exact ones before others."""
    tests = [(i, "t", "test") for i in range(100, 400)]
    symbols = spark.createDataFrame([(i, "s", "source") for i in range(100)] + tests, "id long, path string, category string")
    edges = spark.createDataFrame([(50, i, "calls", False) for i in range(50)] + [(t, 50, "calls", t % 2 == 0) for t, _, _ in tests] + [(101, 3, "calls", False)], EDGES)
    rows = P.risk(symbols.where("id < 50").select("id"), symbols, edges, symbols.select("path").distinct())
    found = {r.id: r.test_callers for r in rows.collect()}
    assert found[3] == [101, 103, 105, 107, 109] and found[4] == [101, 103, 105, 107, 109]
