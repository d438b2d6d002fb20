"""Scopes of script facts: only what needs one is shuffled, with what it is compared to."""

from facetline.sources import script_facts as J

SOURCE = """import { a as b, c } from './m'
import * as ns from './n'
export { c as d }
class K { static size = 3; go(x) { this.run(b); return <Box.Item on={x}>{c.e}</Box.Item> } }
function outer(p) { const q = p.z; call(q, ns.w); return new Thing(q) }
outer(c)
"""


def _read(spark):
    return J.parse(spark.createDataFrame([("p.tsx", SOURCE), ("q.ts", "f(g)\n")], "path string, content string"))


def test_rows_at_excluded_places_and_in_lists_are_left_out(spark):
    script = _read(spark)
    rows = spark.createDataFrame([("p.tsx", k, box) for k, box in ((0, -1), (5, -1), (6, 5), (7, 5), (9, 8), (40, -1))] + [("q.ts", 5, -1)], "path string, k int, box int")
    out, lists = (spark.createDataFrame(x, "path string, k int") for x in ([("p.tsx", 40), ("p.tsx", 40)], [("p.tsx", 0), ("p.tsx", 5)]))
    assert {(r.path, r.k) for r in J.scoped(script, rows, out, lists).collect()} == {("p.tsx", 9), ("q.ts", 5)}
    assert J.scoped(script, rows).count() == 7


def test_calls_and_references_shuffle_what_they_keep(spark, monkeypatch):
    script, shuffled, scoped = _read(spark), [], J.scoped

    def counted(script, rows, *more):
        shuffled.append((set(rows.columns), rows.count()))
        return scoped(script, rows, *more)

    monkeypatch.setattr(J, "scoped", counted)
    calls = {(r.path, r.scope, r.name, r.kind, r.receiver) for r in J.calls(script).collect()}
    assert calls == {("p.tsx", "K.go", "run", "attr", "this"), ("p.tsx", "K.go", "Item", "jsx", "Box"), ("p.tsx", "outer", "call", "name", None), ("p.tsx", "outer", "Thing", "new", None), ("p.tsx", "<module>", "outer", "name", None), ("q.ts", "<module>", "f", "name", None)}
    references = {(r.path, r.scope, r.name) for r in J.references(script).collect()}
    assert references == {("p.tsx", "K.go", n) for n in ("b", "x", "c.e")} | {("p.tsx", "outer", n) for n in ("p.z", "q", "ns.w")} | {("p.tsx", "<module>", "c"), ("q.ts", "<module>", "g")}
    columns, rows = shuffled[0]
    assert columns == {"path", "k", "line", "name", "kind", "receiver"} and rows <= len(calls) + 1
    assert {"path", "box", "k", "text"} in [c for c, _ in shuffled]
