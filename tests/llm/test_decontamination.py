"""Benchmark passages by a direct scan of every diagonal, in the query and on texts that repeat few words."""

import random
import time

import regex
from pyspark.sql import functions as F

from facetline.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).strip().split()


def best_stretch(doc, item):
    """(equal, -n, n, -at, at, first) of the best stretch on any diagonal that a mask hits, tried one by one."""
    best, need = None, min(decontaminate.LEAST, len(item))
    if not item or len(item) < min(map(len, decontaminate.MASKS)):
        return max(((len(item), -len(item), len(item), -p, p, 0) for p in range(len(doc) - len(item) + 1) if item and doc[p : p + len(item)] == item), default=None)
    for shift in range(1 - len(item), len(doc)):
        first = max(0, -shift)
        equal = [doc[q + shift] == item[q] for q in range(first, min(len(item), len(doc) - shift))]
        if sum(equal) < 5 or not any(all(equal[p + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(len(equal) - len(m) + 1)):
            continue
        for a in range(len(equal)):
            for b in range(a + need, len(equal) + 1):
                same = sum(equal[a:b])
                if same >= decontaminate.SHARE * (b - a):
                    found = (same, a - b, b - a, -(first + a + shift), first + a + shift, first + a)
                    best = found if best is None or found > best else best
    return best


def scanned(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            if best := best_stretch(words(text), words(item)):
                out.add((d, i, best[2], best[0], best[4], best[5]))
    return out


def rows(df):
    return {tuple(r) for r in df.select(df.columns[0], df.columns[1], "overlap_words", "equal_words", "doc_start", "item_start").collect()}


def test_few_words_and_ties_equal_a_scan(spark):
    rng = random.Random(8)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.randint(3, 24), rng.choice([1, 2, 3, 8]))) for i in range(12)]
    docs = [(d, text(rng.randint(0, 50), rng.choice([1, 2, 3, 8]))) for d in range(40)]
    docs += [(100 + i, f"x {t} y {t}") for i, t in items]  # an item twice: the first counts
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = scanned(docs, items)
    assert len(want) > 50 and rows(got) == want


def test_query_equals_a_scan(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # documents without a common run of four words with an item have no mask of it
    grams = lambda t: set(zip(t, t[1:], strict=False))
    held = {i: grams(words(t)) for i, t in items}
    want = set()
    for d, text in docs:
        own = grams(words(text))
        near = [(i, t) for i, t in items if len(held[i] & own) >= 2 or len(held[i]) < 8]
        want |= scanned([(d, text)], near)
    assert want and rows(queries.op6_decontamination(spark, SF)) == want


def test_one_word_over_and_over(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "same " * n), (2, "same other " * (n // 2)), (3, "x " * n + "same " * 70), (4, "y " * n)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same " * 60)], "item_id long, text string")
    decontaminate.overlaps(docs.limit(0), items).count()
    began = time.time()
    got = decontaminate.overlaps(docs, items)
    assert rows(got) == {(1, 1, 60, 60, 0, 0), (3, 1, 60, 60, n, 0)}
    assert time.time() - began < 30
    assert got.where(F.col("doc_id") == 4).count() == 0
