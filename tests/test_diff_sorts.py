"""Lines of diffs are numbered in one order of each file."""

from facetline.sources import diff


def test_numbering_sorts_once(spark):
    texts = ["lost", "@@ -3,4 +5,2 @@ f", "-a", "+b", "\\ No newline at end of file", " c", "d", "@@ -9 +7 @@", "+e", "-f", None, "@@ -20,0 +30,2 @@ g", "+h", "+i"]
    lines = spark.createDataFrame([(p, i, t) for p in ("p", "q") for i, t in enumerate(texts)], "path string, pos int, text string").repartition(3)
    rows = diff.diff_lines(lines)
    want = [
        (0, 2, "del", 3, None, "a", "f"), (0, 3, "add", None, 5, "b", "f"), (0, 5, "ctx", 4, 6, "c", "f"), (0, 6, "ctx", 5, 7, "d", "f"),
        (1, 8, "add", None, 7, "e", ""), (1, 9, "del", 9, None, "f", ""), (2, 12, "add", None, 30, "h", "g"), (2, 13, "add", None, 31, "i", "g"),
    ]
    assert sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[2])) == [(p, *w) for p in "pq" for w in want]
    assert rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 1
