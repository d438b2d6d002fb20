"""One diff over many tasks against a reading line by line."""

import random
import re

from facetline.sources import diff


def line_by_line(text):
    out, old, new, hunks = [], None, None, None
    for t in text:
        if t.startswith("diff --git "):
            old, new, hunks = None, None, 0
        elif hunks is None:
            continue
        elif not hunks and t.startswith("--- ") and t != "--- /dev/null":
            old = t[6:].split("\t")[0]
        elif not hunks and t.startswith("+++ ") and t != "+++ /dev/null":
            new = t[6:].split("\t")[0]
        elif found := re.match(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", t):
            hunks += 1
            a, b, c, d = (1 if x is None else int(x) for x in found.groups())
            out += [(new or old, side, at, n) for side, at, n in (("base", a, b), ("head", c, d)) if n]
    return out


def test_one_diff_over_many_tasks(spark):
    rng, text = random.Random(3), ["a line before the first file", "@@ -1 +1 @@"]
    for f in range(400):
        text += [f"diff --git a/f{f} b/f{f}", f"--- a/f{f}" if f % 7 else "--- /dev/null", f"+++ b/f{f}\t" if f % 5 or not f % 7 else "+++ /dev/null"]
        for _ in range(rng.randrange(5)):
            text += [f"@@ -{rng.randrange(99)},{rng.randrange(3)} +{rng.randrange(99)} @@ s", "--- a/no name", "+++ b/none", " @@ -1 +1 @@"] + ["+x"] * rng.randrange(4)
    rows = [(1, i, t) for i, t in enumerate(text)] + [(2, i, t) for i, t in enumerate(text[2:200])]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, let it be many tasks
        got = diff.file_ranges(spark.createDataFrame(rows, "source int, pos int, text string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(map(tuple, got)) == sorted(line_by_line(text) + line_by_line(text[2:200]))


def test_no_diff(spark):
    assert diff.file_ranges(spark.createDataFrame([], "source int, pos int, text string")).count() == 0
