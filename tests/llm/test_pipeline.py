"""Every stage against a brute-force version on the smallest table."""

import random

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from facetline.llm import langid, queries
from tests.llm.test_operators import _components, _shingles

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language_id", "quality", "near_dedup", "decontamination", "sentencepiece"]

    out = named["language_id"](spark, docs, SF)
    found = {r.doc_id: r for r in langid.identify(docs, langid.train(docs, queries.fold(F.col("doc_id"), 3) != 1)).collect()}
    assert out.columns == columns
    assert {r.doc_id for r in out.collect()} == {d for d in seen if found[d].lang_pred != "und" and found[d].score >= corpus_pipeline.LEAST_LANGUAGE}

    out = named["quality"](spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == columns and sum((d in kept) == bool(q) for d, q in labels.items()) >= 0.9 * len(labels)

    out = named["near_dedup"](spark, docs.unionAll(docs.limit(3)), SF)
    roots = _components({d: _shingles(t, 5) for d, t in seen.items()})
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(set(roots.values()))

    out = named["decontamination"](spark, docs, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == columns and all((d in kept) == (not any(i in t for i in items)) for d, t in seen.items())

    rows = named["sentencepiece"](spark, docs, SF).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert all(r.ids == processor.encode(seen[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows) and len(rows) == len(seen)


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)


def test_other_languages_and_random_letters_go(spark):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    odd = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(10)]
    odd.append("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä")
    more = docs.limit(1).select("lang", "source", "n_chars").crossJoin(spark.createDataFrame([(900_001 + 3 * i, t) for i, t in enumerate(odd)], "doc_id long, text string")).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), SF).collect()}
    clean = {r.doc_id for r in docs.collect() if r.text and r.lang and len(r.text) > 200}
    # texts of random letters fit one of the few languages by chance now and then
    assert clean <= kept and len([d for d in kept if d > 900_000]) <= 3 and 900_031 not in kept


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing):
    rows = awkward.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF)
        assert out.columns == awkward.columns and out.count() <= rows
        assert stage(spark, nothing, SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, awkward, SF).count() == rows and last(spark, nothing, SF).count() == 0


def test_texts_that_share_an_id_are_compared_one_by_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text + " end", "b"), (2, "another text under the same id", "c"), (2, "another text under the same id", "d"), (3, "alone", "e"), (None, text, "f"), (4, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted((r.doc_id or 0, r.row) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert len(kept) == 5 and {(0, "f"), (2, "c"), (3, "e"), (4, "g")} <= set(kept) and ({(1, "a")} <= set(kept)) != ({(2, "b")} <= set(kept))
