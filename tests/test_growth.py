"""What must not grow into the driver, one task or one group."""

import numpy as np
from pyspark.sql import functions as F

from facetline.operators import intervals as I
from facetline.operators import report as R
from facetline.operators import traversal
from facetline.sources import python_facts as PY
from facetline.sources import script_facts as J
from facetline.sources import script_tokens, token_boxes


def _planned(df) -> str:
    """The plan before anything has been measured."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_script_texts_are_dealt_and_their_tables_not_broadcast_by_estimate(spark, monkeypatch):
    monkeypatch.setattr(script_tokens, "TASK_CHARS", 1000)
    text = "import { a } from './m';\nexport class C { go() { return f(a); } }\n"
    files = spark.range(400, numPartitions=1).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit(text).alias("content"))
    dealt = script_tokens.dealt(files)
    assert dealt.rdd.getNumPartitions() == -(-400 * len(text) // 1000)
    script = J.parse(files)
    for found in (J.imports(script), J.calls(script), J.exports(script)):
        assert "Broadcast" not in _planned(found)
    assert J.imports(script).count() == 400


def test_what_stands_before_a_mark_is_looked_at_only_there():
    for pattern, mark in ((script_tokens._PATTERN, "/"), (script_tokens._TAG, "<")):
        assert pattern.startswith(f"(?={mark})")


def test_python_files_of_one_split_are_dealt_and_parsed_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(PY, "TASK_CHARS", 1000)
    monkeypatch.setattr(PY, "BATCH_FACTS", 7)
    text = "import a.b\nclass C(Base):\n    def go(self, x: T): return self.y.z(x)\n"
    files = spark.range(300, numPartitions=1).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.lit(text).alias("content"))
    found = PY.python_facts(files)
    assert found.rdd.getNumPartitions() == -(-300 * len(text) // 1000)
    assert found.count() == 300 * len(PY.facts_of("f.py", text))


def _rows_of_joins(df) -> int:
    """The most rows that a join of ``df`` put out."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), [0]

    def walk(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            walk(node.plan())

    walk(plan)
    return max(found)


def test_hunks_meet_the_smallest_symbols_of_their_lines_only(spark):
    # 100 hunks begin on one line, and as many symbols are around it
    spans = [("p", 1 + i % 3, 30 + i, f"s{i}", i) for i in range(100)] + [("p", 12, 12 + i, f"t{i}", 200 + i) for i in range(20)] + [("p", 11, 10, "none", 300), ("p", 1, 99, "<module>", 301)]
    hunks = [("p", h, 10, h % 5) for h in range(100)] + [("q", 1000, 10, 2)]
    found = I.hunk_symbols(spark.createDataFrame(hunks, "path string, hunk int, start int, lines int"), spark.createDataFrame(spans, "path string, start int, end int, qual string, ord int"))
    expected = set()
    for path, hunk, start, lines in hunks:
        met = sorted((e - s, o, q) for p, s, e, q, o in spans if p == path and s <= start + max(lines, 1) - 1 and e >= start and e >= s and q != "<module>")
        expected |= {(path, hunk, q, i + 1) for i, (_, _, q) in enumerate(met[:4])}
    assert {tuple(r) for r in found.collect()} == expected
    assert 0 < _rows_of_joins(found) < 1000


def test_lines_of_many_equal_ranges_are_merged_once(spark, monkeypatch):
    seen, merge = [], I.merged_ranges
    monkeypatch.setattr(I, "merged_ranges", lambda r: seen.append(r.count()) or merge(r))
    ranges = [("p", 1 + i % 10, 1 + i % 4) for i in range(400)]
    spans = [("p", 2, 3, "a", 1), ("p", 5, 20, "b", 2)]
    found = I.owner_counts(spark.createDataFrame(ranges, "path string, first int, count int"), spark.createDataFrame(spans, "path string, start int, end int, qual string, ord int"))
    lines = {x for _, a, n in ranges for x in range(a, a + n)}
    assert {(r.owner, r.lines) for r in found.collect()} == {("a", 2), ("b", len([x for x in lines if x >= 5])), ("<module>", len(lines & {1, 4}))}
    assert seen == [10]


def test_context_of_symbols_is_not_broadcast_by_estimate(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    ids = spark.range(3)
    spans = ids.selectExpr("id", "'p' AS path", "1 AS start", "90000 AS end", "false AS deleted")
    hunks = ids.selectExpr("'p' AS path", "id AS hunk", "'@@' AS header", "2L AS size", "1 AS old_start", "1 AS old_lines", "1 AS new_start", "1 AS new_lines")
    lines = ids.selectExpr("'p' AS path", "id AS hunk", "1 AS pos", "'add' AS type", "'x' AS text")
    texts = ids.selectExpr("'p' AS path", "false AS deleted", "int(id + 1) AS line", "'x' AS text")
    edges = ids.selectExpr("id AS src", "id % 2 AS dst", "false AS fuzzy", "array(1) AS lines")
    found = R.symbol_context(spans, spans, edges, hunks, lines, texts)
    assert "BroadcastHashJoin" not in _planned(found)
    assert found.where("source = '    1  x\n    2  x\n    3  x\n... (truncated)'").count() == 3


def test_boxes_of_tokens_are_found_without_windows(spark, monkeypatch):
    monkeypatch.setattr(script_tokens, "materialise", lambda df, name: df)
    monkeypatch.setattr(token_boxes, "BATCH_TOKENS", 10)
    text = "import { a } from './m';\nexport class C { go() { return f(a); } }\n"
    files = spark.range(40).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit(text).alias("content"))
    found = script_tokens.tokens(files)
    assert "Window" not in _planned(found) and "Sort" not in _planned(found)
    rows = found.where("path = 'f7.ts'").orderBy("k").collect()
    opened = []
    for r in rows:
        while opened and r.k > opened[-1].close:
            opened.pop()
        assert r.box == (opened[-1].k if opened else -1)
        if r.close is not None:
            opened.append(r)
    assert [r.t for r in rows if r.close is not None] == ["{", "{", "(", "{", "("]
    assert found.count() == 40 * len(rows)


def test_statements_and_parts_are_made_where_their_files_are_read(spark, monkeypatch):
    plans, write = {}, J.materialise
    monkeypatch.setattr(J, "materialise", lambda df, name: plans.setdefault(name, _planned(df)) and write(df, name))
    script = J.parse(spark.createDataFrame([("a.ts", "const a = 1, b = f(c, d);\nlet e")], "path string, content string"))
    assert "Exchange" not in plans["statements"] + plans["parts"] and "Aggregate" not in plans["statements"] + plans["parts"]
    assert {(r.box, r.s) for r in script.statements.collect()} == {(-1, "const a = 0 , b = f ( ;"), (-1, "let e"), (8, "c , d")}
    assert {(r.box, r.s) for r in script.parts.collect()} == {(-1, "const a = 0"), (-1, "b = f ( ;"), (-1, "let e"), (8, "c"), (8, "d")}
    assert "tokens" not in script.__dict__


def test_containers_are_met_through_one_container_between(spark, monkeypatch):
    seen, write = [], traversal.materialise
    monkeypatch.setattr(traversal, "materialise", lambda df, name: seen.append(_rows_of_joins(df)) or write(df, name))
    line = [(i, i - 1) for i in range(1, 40)] + [(0, None), (50, 20), (50, 3), (60, 61), (61, 62), (62, 60)]
    found = traversal.ancestors(spark.createDataFrame(line, "id long, parent long"))
    above, expected = {}, {}
    for i, p in line:
        above.setdefault(i, []).append(p)
    for start in above:
        level, depth = {start}, 0
        while level := {p for x in level for p in above.get(x, []) if p is not None and p != start and (start, p) not in expected}:
            depth += 1
            expected |= {(start, p): depth for p in level}
    assert {(r.id, r.ancestor): r.depth for r in found.collect()} == expected
    assert found.count() == len(expected) and sum(seen) <= len(expected)


def test_facts_of_scripts_are_found_without_a_table_of_tokens_and_without_windows_of_boxes(spark, monkeypatch):
    plans, write = {}, J.materialise
    monkeypatch.setattr(J, "materialise", lambda df, name: plans.setdefault(name, _planned(df)) and write(df, name))
    text = "import { a } from './m';\nconst r = require('./r');\nexport class C { x: T; go(p) { const q = a.b<T>(p); return q.d(x => x.y); } }\nexport default make(C)\n"
    script = J.parse(spark.createDataFrame([("f.ts", text)], "path string, content string"))
    chains, bound = J.chains(script), J.bound_names(script)
    facts = [J.imports(script), J.exports(script), J.calls(script, chains), J.references(script, chains, bound), J.locals_(script, bound), J.variable_types(script)]
    assert [f.count() for f in facts] == [2, 3, 3, 5, 3, 2]
    assert "tokens" not in script.__dict__
    assert plans["chains"].count("Window ") == 1 and "Window" not in plans["places"] + plans["bound-names"]


def test_only_tables_that_a_fact_needs_are_written(spark):
    script = J.read(spark.createDataFrame([("a.ts", "class A {}\nA.Item = b.c;\n")], "path string, content string"))
    assert [tuple(r) for r in J.static_members(script).collect()] == [("a.ts", "A", "Item", "b.c")]
    assert "parts" not in script.__dict__ and "symbols" not in script.__dict__


def test_the_first_mark_after_a_token_is_looked_for_in_its_box_only():
    where, starts = np.array([True, False, True, False, True]), np.array([0, 0, 0, 3, 3])
    assert token_boxes._following(where, starts).tolist() == [2, 2, -1, 4, -1]


def test_types_are_normalised_once_from_written_rows_and_patterns_are_followed_by_few_rows(spark, monkeypatch):
    plans, write = {}, J.materialise
    monkeypatch.setattr(J, "materialise", lambda df, name: plans.setdefault(name, _planned(df)) and write(df, name))
    text = "class A { f(x: T, { y: [z, { u }], v = 1 }) { const { w: [q] } = x; } }\n"
    script = J.parse(spark.createDataFrame([("a.ts", text)], "path string, content string"))
    assert {tuple(r) for r in J.variable_types(script).select("var", "type").collect()} == {("x", "T")}
    assert {r.name for r in J.bound_names(script).collect()} == {"x", "z", "u", "v", "q"}
    assert _planned(J.variable_types(script)).count("FileScan") == 1
    # each round reads what binds a further pattern, not lines
    assert "ts#" not in plans["patterns"] and {"bindings", "inner-patterns", "declared-types"} <= plans.keys()
