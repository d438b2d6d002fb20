"""The ten operators on awkward rows, on empty tables, and against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from facetline.llm import bm25, components, decontaminate, langid, license_scan, neardup, quality, queries, sentencepiece_codec, sharding, token_counts, warc

SF = "/root/testdata/sf0.001"


def test_sentencepiece_equals_library(spark, awkward, nothing):
    import sentencepiece

    model = queries.piece_model()
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(awkward, model), model)
    assert both.columns == ["doc_id", "ids", "decoded"]
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in both.collect())
    want = sorted((str(r.doc_id), processor.encode(r.text or ""), processor.decode(processor.encode(r.text or ""))) for r in awkward.collect())
    assert got == want
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in sentencepiece_codec.encode_and_decode(awkward, model).collect()) == want
    assert sentencepiece_codec.encode_and_decode(nothing, model).count() == 0
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(nothing, model), model).count() == 0


def test_sentencepiece_table_overflow():
    processor = sentencepiece_codec.load(open(queries.piece_model(), "rb").read())
    table = sentencepiece_codec.ChunkTable(processor, limit=50)
    for text in ("a b c", "  many   blanks  ", "ddd eee fff ggg hhh", "a b c", " ", "x▁y"):
        assert np.frombuffer(table.encode([text])[0], "<i4").tolist() == processor.encode(text)


def test_op1_on_driver_table(spark):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_sentencepiece(spark, SF).collect():
        ids = processor.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return token_counts.Tokenizer(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


def test_edits_follow_full_counts(tokenizer):
    rng, letters = random.Random(5), "ab '\n  \t!?é1 2ll s re"
    pick = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    for _ in range(600):
        text = pick(30)
        tree = token_counts.Tree(*tokenizer.leaves(text))
        for _ in range(4):
            text, _n = token_counts.edit(text, tree, tokenizer, rng.randint(-2, len(text) + 2), rng.randint(0, 6), pick(5))
            assert (tree.tokens, tree.chars) == (len(tokenizer.encoding.encode_ordinary(text)), len(text))
            assert tree.leaves()[0].tolist() == tokenizer.leaves(text)[0].tolist()


def test_token_counts_state_is_a_table(spark, awkward, nothing, tokenizer):
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    edits = F.array(F.struct(F.lit(2).alias("at"), F.lit(3).alias("delete"), F.lit("new words").alias("insert")), F.lit(None), F.struct(F.lit(None).cast("int").alias("at"), F.lit(99_999_999).alias("delete"), F.lit(None).cast("string").alias("insert")))
    trees = token_counts.build_trees(awkward.withColumn("e", F.when(F.col("doc_id") != 6, edits)), ranks, pattern, keep=["e"])
    rows = token_counts.apply_edits(trees, "e", ranks, pattern).collect()
    assert len(rows) == awkward.count()
    assert all(r.text == "" and r.n_tokens == 0 for r in rows if r.doc_id not in (6, None))
    assert [r.n_tokens for r in rows if r.doc_id == 6] == [1]
    assert token_counts.build_trees(nothing, ranks, pattern).count() == 0


def test_op2_equals_full_recount(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = was = docs[r.doc_id]
        n = len(was)
        for at, delete, insert in ((zlib.crc32(was.encode()) % (n + 1), 0, f" edit {r.doc_id}"), (n // 2, 24, ""), (max(n - 7, 0), 7, was[:40])):
            text = text[:at] + insert + text[at + delete :]
        count = lambda x: len(tokenizer.encoding.encode_ordinary(x))
        assert (r.n_tokens, r.n_tokens_edited, r.edited_sha256) == (count(was), count(text), hashlib.sha256(text.encode()).hexdigest())


def _dice(unit, template):
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())
    grams = lambda t: set(zip(words(t), words(t)[1:], strict=False))
    a, b = grams(unit), grams(template)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_license_scan_equals_brute_force(spark, awkward, nothing):
    mit = license_scan.TEMPLATES["MIT"][3]
    rows = [(1, "intro\nReleased under the MIT License.\n\nmore", "x"), (2, mit.replace("free of charge", "gratis"), "x"), (3, mit[:200] + "\n" + mit[200:] + "\n\nother", "x"), (4, "released UNDER the mit licence!", "x"), (5, None, "x"), (6, "", "x"), (None, mit, "x"),
            (7, "Copyright (c) 2020 A. Person\n\n" + license_scan.FULL_TEXTS["MIT"], "x"), (8, license_scan.FULL_TEXTS["BSD-3-Clause"], "x"), (8, license_scan.FULL_TEXTS["BSD-3-Clause"], "x"), (9, "licensed under cc by nc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {(r.doc_id, r.unit, r.unit_no, r.license): r.dice for r in license_scan.scan(docs).collect()}
    want = {}
    for doc, text, _ in rows:
        lines = [("line", i, x) for i, x in enumerate((text or "").split("\n"))]
        blocks = [("block", i, x) for i, x in enumerate(regex.split(r"\n[ \t\r]*\n", text or "")) if "\n" in x]
        parts = [("text", 0, text)] if regex.search(r"\n[ \t\r]*\n", text or "") else []
        for unit, i, x in lines + blocks + parts if doc is not None else []:
            for name, templates in license_scan.TEMPLATES.items():
                best = max(_dice(x, t) for t in templates)
                if best >= license_scan.LEAST:
                    want[doc, unit, i, name] = best
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {k[0] for k in want} == {1, 2, 3, 7, 8, 9} and want[9, "line", 0, "CC-BY-NC-4.0"] == 0.8
    assert {(7, "text", 0, "MIT"), (8, "text", 0, "BSD-3-Clause"), (8, "text", 0, "BSD-2-Clause")} <= want.keys() and want[8, "text", 0, "BSD-3-Clause"] == 1
    assert license_scan.scan(awkward).count() == 0 and license_scan.scan(nothing).count() == 0


def test_license_scan_reads_long_units(spark):
    notice = "Licensed under CC BY-NC 4.0."
    rows = [(1, " ".join([notice] * 100)), (2, "\n".join([notice] * 100)), (3, "nothing of the kind " * 2000)]
    got = {(r.doc_id, r.unit): r.dice for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("unit_no = 0").collect()}
    assert got == {(1, "line"): pytest.approx(12 / 13), (2, "line"): 1.0, (2, "block"): pytest.approx(12 / 13)}


def test_op3_on_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(r.doc_id, i, name) for r in docs for i, x in enumerate(r.text.split("\n")) for name, ts in license_scan.TEMPLATES.items() if max(_dice(x, t) for t in ts) >= license_scan.LEAST}
    assert {(r.doc_id, r.unit_no, r.license) for r in queries.op3_license_scan(spark, SF).where("unit = 'line'").collect()} == want


def test_isotonic_pools_violators():
    x, v = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 1.0, 1.0, 1.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert x.tolist() == [0.0, 1.5, 3.0] and v.tolist() == [0.0, 0.5, 1.0]


def test_quality_held_out_accuracy(spark, awkward, nothing):
    rows = queries.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    stats = quality.statistics_table(awkward)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(stats, quality.train(stats, no_labels, F.lit(True))).collect()
    assert len(scored) == awkward.count() and {r.score for r in scored} == {0.5}
    one_kind = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(stats, quality.train(stats, one_kind, F.lit(True))).collect()} == {1.0}
    assert quality.score(quality.statistics_table(nothing), quality.train(stats, no_labels, F.lit(True))).count() == 0


def test_search_is_exact(spark, awkward, nothing):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(12_000)]
    rows = [(i // 2 if i < 40 else i, " ".join(words[i * 30 : i * 30 + rng.randint(0, 30)]), "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, term string").repartition(3)
    index = bm25.build_index(docs)
    asked = bm25.document_queries(docs.where("doc_id % 10 = 0"), index, most=8)
    got = defaultdict(list)
    for r in bm25.search(index, asked, k=5).orderBy("query", "rank").collect():
        got[r.query].append((round(r.score * bm25.UNIT), r.doc_id))
    n, lengths = len(rows), [len(t.split()) for _, t, _ in rows]
    mean, df = sum(lengths) / n, Counter(t for _, x, _ in rows for t in set(x.split()))
    wanted = defaultdict(list)
    for q in asked.collect():
        wanted[q.query].append((q.term, q.weight))
    for q, terms in wanted.items():
        scores = []
        for (doc, text, _), length in zip(rows, lengths, strict=True):
            tf = Counter(text.split())
            s = sum(m * int(np.rint(bm25.UNIT * bm25.idf(df[t], n) * tf[t] * (bm25.K1 + 1) / (tf[t] + bm25.K1 * (1 - bm25.B + bm25.B * length / mean)))) for t, m in terms if t in tf)
            if s:
                scores.append((-s, doc))
        assert got[q] == [(-s, d) for s, d in sorted(scores)[:5]]
    awkward_index = bm25.build_index(awkward)
    found = bm25.search(awkward_index, bm25.document_queries(awkward, awkward_index), k=3).collect()
    assert {r.query for r in found} == {1, 2, 6, 7, 8, 9}
    empty = bm25.build_index(nothing)
    assert bm25.search(empty, bm25.document_queries(nothing, empty)).count() == 0


def test_search_asks_whole_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join({f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(rng.choice((6, 20, 500)))})) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    index = bm25.build_index(docs)
    asked = bm25.document_queries(docs.where("doc_id < 20"), index)
    sizes = {r.query: r["count"] for r in asked.groupBy("query").count().collect()}
    assert sizes == {i: len(t.split()) for i, t in rows[:20]} and min(sizes.values()) <= bm25.SHORT_QUERY < max(sizes.values())
    got = defaultdict(list)
    for r in bm25.search(index, asked, k=5).orderBy("query", "rank").collect():
        got[r.query].append((-round(r.score * bm25.UNIT), r.doc_id))
    texts, n = {i: t.split() for i, t in rows}, len(rows)
    df, mean = Counter(t for x in texts.values() for t in x), sum(map(len, texts.values())) / n
    for q in range(20):
        rate = lambda t, size: int(np.rint(bm25.UNIT * bm25.idf(df[t], n) * (bm25.K1 + 1) / (1 + bm25.K1 * (1 - bm25.B + bm25.B * size / mean))))
        common = {d: set(x) & set(texts[q]) for d, x in texts.items()}
        assert got[q] == sorted((-sum(rate(t, len(texts[d])) for t in c), d) for d, c in common.items() if c)[:5]


def test_op5_equals_floating_bm25(spark):
    """The query on the driver table against plain BM25 of every document, for a part of its queries."""
    found = defaultdict(dict)
    for r in queries.op5_top_k_search(spark, SF).collect():
        found[r.query_id][r.rank] = (r.doc_id, r.score)
    rows = [(r.doc_id, bm25.terms_of(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, mean = len(rows), sum(len(t) for _, t in rows) / len(rows)
    counts = [(d, Counter(t), len(t)) for d, t in rows]
    df = Counter(t for _, c, _ in counts for t in c)
    asked = [(d, c) for d, c, size in counts if d % 100 == 0 and size]
    assert asked and set(found) == {d for d, _ in asked}
    for q, terms in asked:
        scores = {d: sum(m * bm25.idf(df[t], n) * c[t] * (bm25.K1 + 1) / (c[t] + bm25.K1 * (1 - bm25.B + bm25.B * size / mean)) for t, m in terms.items() if t in c) for d, c, size in counts}
        scores = {d: s for d, s in scores.items() if s > 0}
        best = sorted(scores.values(), reverse=True)[:10]
        assert sorted(found[q]) == list(range(1, len(best) + 1))
        for rank, (doc, score) in found[q].items():
            assert abs(score - best[rank - 1]) < 0.01 and abs(score - scores[doc]) < 0.01


def test_decontamination_tolerates_substitutions(spark, awkward, nothing):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(rng.randint(14, 50)) for i in range(30)}
    rows, want = [], set()
    for doc in range(200):
        body = text(rng.randint(0, 120))
        if doc % 4 == 0:
            item = rng.randrange(30)
            passage = [w if rng.random() > 0.06 else "other" for w in items[item]]
            at = rng.randint(0, len(body))
            body = body[:at] + passage + body[at:]
            want.add((doc, item))
        rows.append((doc, ", ".join(body).upper(), doc))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(98, None), (99, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, tests).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    kept = decontaminate.decontaminate(docs, tests)
    assert kept.columns == docs.columns and kept.count() == 200 - len({d for d, _ in got})
    assert decontaminate.overlaps(awkward, tests).count() == 0 and decontaminate.overlaps(nothing, tests).count() == 0
    assert decontaminate.decontaminate(awkward, tests).count() == awkward.count()


def test_decontamination_short_items_occur_whole(spark):
    items = spark.createDataFrame([(1, "Alpha beta gamma!"), (2, "one two three four five six seven"), (3, ""), (4, None), (5, "single")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alpha, beta; gamma it is"), (2, "alpha beta delta"), (3, "one two three four five six seven"), (4, "one two three four five six"), (5, None), (6, ""), (7, "a single word"), (7, "a single word")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.overlap_words, r.doc_start) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 1): (3, 1), (3, 2): (7, 0), (7, 5): (1, 1)}


def test_decontamination_finds_parts_of_items(spark):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    item, short = text(59), text(9)
    cases = {n: item[12 : 12 + n] for n in (13, 16, 20, 24, 28, 32, 35)}  # verbatim from the middle
    cases[100] = item[2:18] + text(25) + item[43:57]  # two passages on one diagonal, far apart
    cases[101] = item[10:22] + ["other"] + item[23:30]
    cases[102] = item[10:19]  # nine words: no stretch of 13 has ten equal ones
    cases[103] = short
    docs = spark.createDataFrame([(d, " ".join(text(40) + w + text(40))) for d, w in cases.items()] + [(13, " ".join(text(30)))], "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.overlap_words, r.equal_words, r.doc_start, r.item_start) for r in decontaminate.overlaps(docs, tests).collect()}
    want = {(n, 1): (n, n, 40, 12) for n in cases if n < 100}
    want |= {(100, 1): (16, 16, 40, 2), (101, 1): (20, 19, 40, 10), (103, 2): (9, 9, 40, 0)}
    assert got == want


def _components(sets, percent=80):
    """Smallest ids over all links, by comparing every pair of sets."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def _shingles(text, n):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, words):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = {}
    for i in range(320):
        if i % 4 == 0:  # one large group of near copies, more than a list holds
            w = [x if rng.random() > 0.05 / (words - 1) else rng.choice(vocabulary) for x in base]
        elif i % 4 == 1:  # a passage that many share
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] + passage
        elif i % 4 == 2 and i > 20:  # copies of what came before
            w = texts[rng.randrange(i)].upper().split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, component_id int")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, words=words).collect()}
    sets = {i: _shingles(t, words) for i, t in texts.items()}
    assert {i: r.component_id for i, r in got.items()} == _components(sets)
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_within_a_template(spark):
    """500 pairs (0.86) among 1,000 texts on one template that are below the threshold otherwise (0.64)."""
    rng = random.Random(8)
    word = lambda: f"w{rng.getrandbits(40)}"
    template, rows = [word() for _ in range(101)], []
    for i in range(0, 1000, 2):
        own = [word() for _ in range(28)]
        rows += [(i, " ".join(template + own)), (i + 1, " ".join(template + own[:18] + [word() for _ in range(10)]))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 for i in range(1000)}


def test_near_duplicates_awkward(spark, awkward, nothing):
    rows = neardup.near_duplicates(awkward, words=2).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == awkward.count() and by_id[2].component_id == 1 and not by_id[2].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (3, 4, 5)) and by_id[6].n_shingles == 1
    assert by_id[None].component_id is None and neardup.near_duplicates(nothing).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (60, 61), (61, 60)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 60: 60, 61: 60}


def test_viterbi_equals_search():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 1, 6, 3])
    scores = rng.normal(0, 3, (lengths.sum(), 3)).astype(np.float32)
    labels, at = langid.viterbi(scores, lengths, switch=2.0), 0
    for n in lengths:
        own = scores[at : at + n]
        value = lambda path: sum(own[i][p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        paths = np.array(np.meshgrid(*[range(3)] * n)).T.reshape(-1, n)
        assert math.isclose(value(labels[at : at + n].tolist()), max(value(p) for p in paths.tolist()), abs_tol=1e-4)
        at += n


def test_languages_held_out(spark):
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def test_language_spans_and_awkward_rows(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, F.col("doc_id") % 3 != 1)
    de, fr = (docs.where(f"doc_id % 3 = 1 AND lang = '{x}' AND n_chars BETWEEN 300 AND 900").orderBy("doc_id").first().text for x in ("de", "fr"))
    mixed = spark.createDataFrame([(1, f"{de}\n{fr}")], "doc_id long, text string")
    row = langid.identify(mixed, model, spans=True).first()
    assert [s.lang for s in row.spans][0] == "de" and [s.lang for s in row.spans][-1] == "fr" and len(row.spans) <= 4
    assert all(0 <= s["first"] < s["end"] <= len(de) + len(fr) + 1 for s in row.spans)
    found = {r.doc_id: r for r in langid.identify(awkward, model, spans=True).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].spans == [] for i in (3, 4, 5))
    assert langid.identify(nothing, model).count() == 0
    blank = langid.train(nothing, F.lit(True))
    assert {r.lang_pred for r in langid.identify(awkward, blank).collect()} == {"und"}


def test_words_are_letters_only():
    assert langid.words_of("½ ² ① Ⅷ x²y Straße_4") == ["x", "y", "Straße"] and langid.words_of("½ ² ① Ⅷ") == []
    assert len(langid.only_letters("a½b")) == 3


def test_scripts_narrow_languages():
    counts = langid.scripts_of(["word", "слово", "λόγος", "漢字", "ⵣⵣ"])
    assert [langid.SCRIPT_NAMES[i] for i in counts] == ["latin", "cyrillic", "greek", "han", "other"]


PAGES = [(1, "http://a", "same"), (2, "http://b\r\nX: 1", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é" * 100_000), (None, "http://f", "lost"), (6, "http://g", "WARC/1.1\r\n\r\nfake\r\n\r\n")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages)
    rows = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert rows.keys() == {None, 1, 2, 3, 4, 5, 6}
    for page, _, html in PAGES:
        if page is not None:
            data = (html or "").encode()
            r = rows[page]
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload_bytes == len(data)
            assert bytes(r.payload) == data if r.record_type == "response" else r.payload is None
    assert {p: (r.record_type, r.refers_to) for p, r in rows.items() if r.refers_to} == {1: ("revisit", 2), 3: ("revisit", 4)}
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, min_bytes=10_000)).collect()} == {"response"}
    sizes = warc.save_volumes(archives, str(tmp_path)).collect()
    for s in sizes:
        data = (tmp_path / s.archive).read_bytes()
        assert len(data) == s.bytes and all(warc.parse_record(x)[0]["WARC-Type"] in ("response", "revisit") for x in warc.read_volume(data))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_sharding_is_balanced_and_gapless(spark, awkward, nothing):
    docs = spark.createDataFrame([(i, f"text {i % 700} " * (1 + i % 13), "own") for i in range(3000)] + [(9000 + i, "hot copy", "own") for i in range(1500)], "doc_id long, text string, size string")
    rows = sharding.shard(docs, 8, range_rows=100).withColumn("n", F.octet_length("text") + 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total = sum(r.n for r in rows)
    assert len(rows) == 4500 and by.keys() == set(range(8)) and rows[0].size == "own"
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert all(abs(sum(r.n for r in x) - total / 8) <= 2 * sharding.TOLERANCE * total / 8 + 200 for x in by.values())
    split = Counter(t for t, s in {(r.text, r.shard) for r in rows})
    assert {t for t, k in split.items() if k > 1} <= {"hot copy"}
    odd = sharding.shard(awkward, 3).collect()
    assert len(odd) == awkward.count() and sorted({r.shard for r in odd}) <= [0, 1, 2]
    assert sharding.shard(nothing, 3).count() == 0


def test_op10_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_sharding(spark, SF).collect()
    assert all(r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
