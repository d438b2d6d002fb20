"""Commit ancestry: a long line in bounded time, merges against a queue."""

import random
import time
from collections import deque

from facetline.sources import tables


def test_a_line_of_ten_thousand_commits(spark):
    parents = spark.range(1, 10_000).selectExpr("id", "id - 1 AS parent")
    began = time.monotonic()
    found = tables.ancestors(parents, spark.createDataFrame([(9_999,)], "id long")).selectExpr("count(*)", "sum(distance)", "max(distance)").first()
    assert tuple(found) == (10_000, 9_999 * 5_000, 9_999)
    assert time.monotonic() - began < 120


def test_merges_equal_a_queue(spark):
    rng = random.Random(4)
    links = {(i, rng.randrange(max(0, i - 12), i)) for i in range(1, 400) for _ in range(rng.choice([1, 1, 2, 3]))}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    want, queue = {399: 0, 380: 0}, deque([399, 380])
    while queue:
        a = queue.popleft()
        for b in near.get(a, ()):
            if b not in want:
                want[b] = want[a] + 1
                queue.append(b)
    start = spark.createDataFrame([(399,), (380,), (399,)], "id long")
    got = tables.ancestors(spark.createDataFrame([*links, (5, None)], "id long, parent long"), start)
    assert {r.id: r.distance for r in got.collect()} == want


def test_no_history(spark):
    none = spark.createDataFrame([], "id long, parent long")
    assert [tuple(r) for r in tables.ancestors(none, spark.createDataFrame([(7,)], "id long")).collect()] == [(7, 0)]
    assert tables.ancestors(none, none.select("id")).count() == 0


def test_two_walks_share_a_history(spark, monkeypatch):
    written, write = [], tables.materialise
    monkeypatch.setattr(tables, "materialise", lambda df, name, **options: written.append(name) or write(df, name, **options))
    parents = spark.range(1, 20).selectExpr("id", "id div 2 AS parent")
    one = lambda n: spark.createDataFrame([(n,)], "id long")
    assert tables.merge_base(parents, one(19), one(16)).first().id == 4
    # jumps of 2 and 4 commits, and an empty table
    assert written.count("first-parents") == 1 and written.count("jumps") == 3
