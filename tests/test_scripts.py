"""Script tokens and facts on sources as they are written."""

import pytest

from facetline.sources import script_facts as J
from facetline.sources import script_tokens

SOURCE = """import {
 a,
 b as c
} from './m'
export const Wrapped = memo(function Inner(p) { return <Foo.Bar x={p.y}>don t <b/>{c.d}</Foo.Bar> })
export const handler = debounce((e) => {
  use(`at ${e.place()} and
 ${later(e)}`);
}, 100);
export * as ns2 from './star'
class A extends ns.Base<T1> {
  count = 0
  other = new Maker(1);
  constructor(readonly n?: string, plain: number) { super(plain); this.z = build(n) }
  get z() { return 3; }
  static async load<T>({ id, opt: { deep = c } }: Args, ...rest): Promise<Order> {
    const [one, , two] = id, pattern = /["'`{(]/.test(one) // no call(x)
    for (const w of rest) { this.repo.find(w).then((res) => res.ok(two)); }
    return super.load(one)
  }
  arrow = async (v) => {
    const out: Order = await fetchIt(v)
    return useState<Foo>(out)
  }
}
const api = {
  get: () => ns.go(),
  post(body) { return a.b.c(body) },
}
export default connect(mapState)(Wrapped)
interface Shape extends P1, P2<X> { area(): number; name: string }
"""


@pytest.fixture(scope="module")
def script(spark):
    return J.parse(spark.createDataFrame([("p.tsx", SOURCE), ("empty.ts", ""), ("none.ts", None), ("odd.ts", "} ) f(x { [")], "path string, content string"))


def rows(df, *columns):
    return {tuple(r) for r in df.where("path = 'p.tsx'").select(*columns).collect()}


def test_symbols_of_broken_lines(script):
    assert rows(J.symbols(script), "name", "kind", "start", "end") == {
        ("Wrapped", "function", 5, 5), ("handler", "function", 6, 9), ("A", "class", 11, 25), ("A.constructor", "method", 14, 14), ("A.z", "method", 15, 15), ("A.load", "method", 16, 20),
        ("A.arrow", "method", 21, 24), ("api", "object", 26, 29), ("api.get", "method", 27, 27), ("api.post", "method", 28, 28), ("Shape", "interface", 31, 31),
    }
    assert {(r.name, r.returns) for r in script.symbols.where("returns IS NOT NULL").collect()} == {("A.load", "Promise<Order>")}


def test_imports_and_exports(script):
    assert rows(J.imports(script), "local", "module", "name") == {("a", "./m", "a"), ("c", "./m", "b")}
    assert rows(J.exports(script), "exported", "local", "module", "ord") == {
        ("Wrapped", "Wrapped", None, 0), ("handler", "handler", None, 0), ("ns2", "*", "./star", 0), ("default", "Wrapped", None, 0), ("default", "mapState", None, 1), ("default", "connect", None, 2),
    }
    assert rows(J.bases(script), "name", "base") == {("A", "ns.Base"), ("Shape", "P1"), ("Shape", "P2")}


def test_calls_and_references(script):
    assert rows(J.calls(script), "line", "scope", "name", "kind", "receiver") == {
        (5, "Wrapped", "memo", "name", None), (5, "Wrapped", "Bar", "jsx", "Foo"), (6, "handler", "debounce", "name", None), (7, "handler", "use", "name", None), (7, "handler", "place", "attr", "e"), (7, "handler", "later", "name", None),
        (13, "A", "Maker", "new", None), (14, "A.constructor", "constructor", "super", None), (14, "A.constructor", "build", "name", None), (17, "A.load", "test", "attr", None),
        (18, "A.load", "find", "attr", "this.repo"), (18, "A.load", "then", "attr", None), (18, "A.load", "ok", "attr", "res"), (19, "A.load", "load", "super", None),
        (22, "A.arrow", "fetchIt", "name", None), (23, "A.arrow", "useState", "name", None), (27, "api.get", "go", "attr", "ns"), (28, "api.post", "c", "attr", "a.b"), (30, "<module>", "connect", "name", None),
    }
    found = rows(J.references(script), "scope", "name")
    assert {("Wrapped", "p.y"), ("Wrapped", "c.d"), ("A.load", "c"), ("A.load", "Args"), ("A.arrow", "Foo"), ("<module>", "Wrapped"), ("<module>", "mapState"), ("Shape", "P1"), ("<module>", "ns.Base")} <= found
    assert not any(name in ("don", "x", "Inner", "body", "area", "id", "deep", "ns2", "b") and scope != "A.load" and (scope, name) != ("api.post", "body") for scope, name in found)


def test_locals_and_types(script):
    assert rows(J.locals_(script), "scope", "name") == {
        ("Wrapped", "p"), ("handler", "e"), ("A.constructor", "n"), ("A.constructor", "plain"), *[("A.load", x) for x in "id deep rest one two pattern res".split()], ("A.arrow", "v"), ("A.arrow", "out"), ("api.post", "body"),
    }
    assert rows(J.variable_types(script), "scope", "var", "type") == {("A", "this.other", "Maker"), ("A", "this.z", "build"), ("A.arrow", "out", "Order")}
    assert rows(J.accessor_parameters(script), "class", "field", "type") == {("A", "n", "string")}


def test_brackets_that_do_not_match(script):
    assert [r.t for r in script.tokens.where("path = 'odd.ts'").orderBy("k").collect()] == ["f", "(", "x", "{", "["]
    assert script_tokens.tokens(script.tokens.select("path").limit(0).selectExpr("path", "path AS content")).count() == 0
