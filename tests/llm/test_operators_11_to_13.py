"""Exact deduplication, vector codes and periodic runs on awkward rows, on empty tables, and against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from facetline.llm import codebooks, exactdedup, queries, runs

SF = "/root/testdata/sf0.001"


def plain_groups(rows):
    """(id, keep_id, group_size, kept, sha256) of (id, text) rows."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        out += [(i, ids[0], len(ids), at == 0, hashlib.sha256(text.encode()).hexdigest()) for at, i in enumerate(ids)]
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


#: Settings that force splits, chains of one hash, several rows per text, and texts that go out more than once.
FORCED = [{}, {"hash_bits": 3}, {"hash_bits": 1, "row_ids": 2}, {"bucket_bytes": 40, "row_ids": 1, "held_bytes": 0}, {"bucket_bytes": 1, "range_bytes": 50, "held_bytes": 300, "hash_bits": 9}]


@pytest.mark.parametrize("settings", FORCED)
def test_exact_duplicates(spark, awkward, settings):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", " ", "a", "a ", "A", "é", "é", "x" * 300, *map(str, range(12))])) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(exactdedup.exact_duplicates(docs, **settings)) == plain_groups(rows)
    own = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(exactdedup.exact_duplicates(awkward, **settings)) == plain_groups(own)


def test_exact_duplicates_of_nothing(spark, nothing):
    assert exactdedup.exact_duplicates(nothing).count() == 0
    assert exactdedup.build_index(nothing).columns == [x.split()[0] for x in exactdedup.INDEX.split(", ")]


def test_hot_text_keeps_its_rows(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same', concat('text ', id)) AS text").repartition(8)
    index = exactdedup.build_index(docs, row_ids=1000)
    assert index.where("text = 'the same'").count() == 1 and index.where("part > 0").count() > 5
    rows = exactdedup.members(index)
    assert rows.count() == 30_000
    hot = rows.where("group_size > 1")
    assert hot.count() == 10_000 and [tuple(r) for r in hot.where("kept").select("doc_id", "keep_id", "group_size").collect()] == [(29_997, 29_997, 10_000)]


def test_directory_splits_and_doubles():
    index, rnd = exactdedup.ExtendibleHash(capacity=100, bits=16), random.Random(1)
    texts = {}
    for n in range(500):
        key = rnd.randrange(1 << 16) if n % 5 else 7  # many texts of one hash
        texts[(key, b"%d" % n)] = index.link(key, b"%d" % n)
    for (key, text), link in texts.items():
        assert index.link(key, text) is link
    held = list(index.buckets())
    assert len({id(b) for b in index.directory}) == len(held) > 8 and len(index.directory) == 1 << index.depth
    for b in held:
        assert b.size == sum(len(x.text) for c in b.chains.values() for x in c)
        assert b.size <= 100 or len(b.chains) == 1 or b.depth == 16
        assert all(key & ((1 << b.depth) - 1) == b.slot for key in b.chains)
        assert sum(x is b for x in index.directory) == 1 << (index.depth - b.depth)
    assert sum(len(b.chains) for b in held) == len({k for k, _ in texts})


def plain_codes(rows, parts, entries, rounds):
    """(id, codes, errors) and the entries of (id, vector) rows, by lists of integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cuts = np.cumsum([0, *map(len, np.array_split(range(len(kept[0][1])), parts))])
    split = [[v[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for _, v in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for s in split:
                members[nearest(s[p], books[p])[1]].append(s[p])
            books[p] = [[sum(c) // len(members[n]) for c in zip(*members[n], strict=True)] if n in members else e for n, e in enumerate(books[p])]
    coded = [(kept[k][0], *zip(*[nearest(s[p], books[p])[::-1] for p in range(parts)], strict=True)) for k, s in enumerate(split)]
    return sorted(map(str, coded)), [x for b in books for e in b for x in e]


@pytest.mark.parametrize(("dim", "parts", "entries"), [(8, 4, 6), (7, 3, 40), (3, 4, 2)])
def test_vector_codes(spark, dim, parts, entries):
    rnd = random.Random(dim)
    rows = [(n // 2 if n % 7 else None, [rnd.choice([-0.5, -1e-4, 0.0, 0.25, 1.0, rnd.random()]) for _ in range(dim)]) for n in range(60)]
    rows += rows[:9]  # repeated rows
    bad = [(100, None), (101, []), (102, [None] * dim), (103, [float("nan")] * dim), (104, [float("inf")] + [0.0] * (dim - 1))]
    table = spark.createDataFrame([(i, v, "n", 1, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, label string, v int, codes int")
    coded, books = codebooks.compress(table, parts=parts, entries=entries)
    want, numbers = plain_codes(rows, parts, entries, 4)
    assert books.numbers() == numbers
    assert sorted(str((r.id, tuple(r.codes), tuple(r.errors))) for r in coded.collect()) == want


def test_vector_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = codebooks.compress(spark.createDataFrame([], schema))
    assert codebooks.with_label_errors(coded).count() == 0 and books.numbers() == []
    rows = [(1, [1.0] * 4, None), (2, [1.0, 2.0], 1), (3, [3e38] * 4, None), (4, [-3e38] * 4, 5)]
    coded, books = codebooks.compress(spark.createDataFrame(rows, schema), entries=2)
    out = {r.id: r for r in codebooks.with_label_errors(coded).collect()}
    assert sorted(out) == [1, 3, 4]  # the other length goes
    assert out[1].label_error == out[3].label_error == out[1].error + out[3].error and out[4].label_error == out[4].error


def test_trie_shares_prefixes():
    rnd = np.random.default_rng(2)
    parts = np.unique(rnd.integers(0, 3, (5000, 8)), axis=0)
    entries = rnd.integers(-5, 5, (20, 8))
    walk = codebooks.TrieWalk(entries)
    got = [walk.nearest(parts[i : i + 700]) for i in range(0, len(parts), 700)]
    distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (np.concatenate([x[0] for x in got]) == distance.argmin(axis=1)).all()
    assert (np.concatenate([x[1] for x in got]) == distance.min(axis=1)).all()
    prefixes = sum(len(np.unique(parts[:, : d + 1], axis=0)) for d in range(8))
    assert walk.nodes == prefixes < walk.components / 2  # each prefix is summed up once, over batches and blocks


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def made_words(rnd):
    w, letters = [], rnd.choice([1, 2, 2, 3, 5])
    for _ in range(rnd.randrange(8)):
        part = [str(rnd.randrange(letters)) for _ in range(rnd.randrange(1, 14))]
        w += part * rnd.choice([1, 1, 3, 4, 5, 8]) + part[: rnd.randrange(len(part) + 1)]
    return w


def test_periodic_runs(spark, awkward, nothing):
    rnd = random.Random(11)
    texts = [" \t".join(made_words(rnd)) for _ in range(800)]
    rows = [(n if n % 9 else None, t, 1) for n, t in enumerate(texts)] + [(r.doc_id, r.text, 1) for r in awkward.collect() if len(r.text or "") < 1000]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"))
    want, total = [], 0
    for i, text, _ in rows:
        words = [x.decode() for x in (text or "").encode().split()]
        own = plain_runs(words)
        gone = {k for s, n, q in own for k in range(s + q, s + n)}
        want.append(str((i, len(words), own, " ".join(w for k, w in enumerate(words) if k not in gone))))
        total += len(own)
    assert total > 500
    assert sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got.collect()) == sorted(want)
    assert runs.periodic_runs(nothing).count() == 0
    long = {r.doc_id: r for r in runs.periodic_runs(awkward).collect()}[8]
    assert [tuple(x) for x in long.runs] == [(1, 20_000, 1)] and long.collapsed == "x" * 50_000 + " y"


def test_periodic_runs_take_time_by_length():
    import time

    a, b = ["a"], ["a", "b"]
    while len(b) < 100_000:
        a, b = b, b + a
    rnd = random.Random(4)
    for words in (["a"] * 100_000, b, [str(n % 5000) for n in range(100_000)], [rnd.choice("ab") for _ in range(100_000)]):
        began = time.time()
        list(runs._documents([[w.encode() for w in words]]))
        assert time.time() - began < 10


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_vector_codes", "op13_periodic_runs"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, sql.fetchall()))
