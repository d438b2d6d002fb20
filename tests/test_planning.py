"""Reading order against a queue, communities against a sequential pass, walks whose seeds exceed the cap."""

import random
from collections import defaultdict, deque

from facetline.operators import planning, traversal


def by_queue(members, links, entries):
    """Positions by a queue per root: members {id: (path, start, segment, cluster)}, links of pairs, entries {id: rank}."""
    out = {}
    for cluster in {m[3] for m in members.values()}:
        order, visited = [], set()
        for segment in range(3):
            allowed = {i for i, m in members.items() if m[3] == cluster and m[2] == segment}
            key = lambda i: (*members[i][:2], i)
            after = defaultdict(set)
            for a, b in links:
                if a in allowed and b in allowed and a != b:
                    after[a].add(b)
            called = set().union(*after.values()) if after else set()
            first = sorted((i for i in allowed if i in entries), key=entries.get) if segment != 1 else []
            for root in [*first, *sorted(allowed - called, key=key), *sorted(allowed, key=key)]:
                queue = deque([root] if root not in visited else [])
                visited.add(root)
                while queue:
                    order.append(node := queue.popleft())
                    for b in sorted(after[node] - visited, key=key):
                        visited.add(b)
                        queue.append(b)
        out |= {i: (cluster, n) for n, i in enumerate(order, 1)}
    return out


def test_reading_order_equals_a_queue(spark):
    rng = random.Random(9)
    members = {i: (f"p{rng.randrange(6)}", rng.randrange(9), rng.choice([0, 0, 0, 1, 2]), rng.randrange(5)) for i in range(160)}
    links = {(rng.randrange(160), rng.randrange(160)) for _ in range(900)} | {(i, i + 5) for i in range(0, 150, 2)}
    entries = {i: n for n, i in enumerate(rng.sample(range(160), 25), 1)}
    clusters = spark.createDataFrame([(i, m[3]) for i, m in members.items()], "id long, cluster long")
    rows = spark.createDataFrame([(i, *m[:3]) for i, m in members.items()], "id long, path string, start int, segment int")
    table = spark.createDataFrame(list(links), "a long, b long")
    starts = spark.createDataFrame([(members[i][3], i, n) for i, n in entries.items()], "cluster long, id long, rank int")
    want = by_queue(members, links, entries)
    for in_task in (planning.IN_TASK, 100, 0):  # all in tasks, some by joins, all by joins
        got = planning.reading_order(clusters, table, rows, starts, in_task)
        assert {r.id: (r.cluster, r.position) for r in got.collect()} == want


def modularity(links, of):
    total, inside, degree = 0.0, 0.0, defaultdict(float)
    for (a, b), w in links.items():
        total += w
        inside += w * (of[a] == of[b])
        degree[of[a]] += w
        degree[of[b]] += w
    return inside / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def sequential(links, n):
    """Greedy moves of one node after the other until none gains."""
    near, degree, m2 = defaultdict(dict), defaultdict(float), 2 * sum(links.values())
    for (a, b), w in links.items():
        near[a][b] = near[b][a] = w
        degree[a] += w
        degree[b] += w
    of, moved = list(range(n)), True
    while moved:
        moved = False
        for v in range(n):
            size, to = defaultdict(float), defaultdict(float)
            for x in range(n):
                if x != v:
                    size[of[x]] += degree[x]
            for x, w in near[v].items():
                to[of[x]] += w
            gain = {c: to[c] - size[c] * degree[v] / m2 for c in {*to, of[v]}}
            best = max(gain, key=lambda c: (gain[c], -c))
            if gain[best] > gain[of[v]] + 1e-9:
                of[v], moved = best, True
    return of


def test_communities_reach_the_modularity_of_a_sequential_pass(spark):
    rng = random.Random(12)
    n = 120
    links = {}
    for _ in range(900):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b and (a // 12 == b // 12 or rng.random() < 0.15):
            links[min(a, b), max(a, b)] = float(rng.choice([1, 1, 3]))
    nodes = spark.createDataFrame([(i, 0) for i in range(n)], "id long, cluster long")
    weights = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, weight double")
    of = {r.id: r.community for r in planning.communities(nodes, weights).collect()}
    assert modularity(links, of) >= 0.97 * modularity(links, sequential(links, n))


def test_seeds_beyond_the_cap_stay(spark):
    symbols = spark.createDataFrame([(0, "class", None)] + [(i, "method", 0) for i in range(1, 11)] + [(i, "function", None) for i in range(11, 30)], "id long, kind string, parent long")
    edges = spark.createDataFrame([(1, 11, "calls", False), (12, 1, "calls", False), (11, 13, "calls", False)], "src long, dst long, kind string, fuzzy boolean")
    walk, cut = traversal.neighborhood(symbols, edges, [0], 1, 1, max_nodes=5)
    assert {r.id for r in walk.collect()} == set(range(11)) and cut
    walk, cut = traversal.neighborhood(symbols, edges, [0], 1, 1, max_nodes=11)
    assert {r.id for r in walk.collect()} == set(range(11)) and cut
    walk, cut = traversal.neighborhood(symbols, edges, [0], 1, 1, max_nodes=12)
    assert {(r.id, r.depth) for r in walk.where("depth <> 0").collect()} == {(11, 1)} and cut
    walk, cut = traversal.neighborhood(symbols, edges, [0], 2, 1, max_nodes=150)
    assert {(r.id, r.depth) for r in walk.where("depth <> 0").collect()} == {(11, 1), (12, -1)} and not cut
