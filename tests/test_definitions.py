"""Names that a text still defines, against one pattern per name; absent files; a long text of keys."""

import re
import time

from facetline.operators import dangling

TEXTS = {
    "plain": "const a = 1\nexport default class B {\n  static async get c() {}\n  d = 2\n  e: Map<x,\n y> = 3\n}\nexport { f, g as h }\n",
    "equals": "a == 1\nb: c\n == 2\nd: e\n=\nf =",
    "open": "export { a,\n b",
    "words": "def get(self):\n  get set(x)\n  override static <T>\nasync def run(): pass\nlet abc=1\nx.d = 1",
    "empty": "",
}
NAMES = "a b c d e f g h B get set static run ab abc x self T".split()


def by_pattern(text, name, method):
    """The rule for one name."""
    n = re.escape(name)
    if method:
        return bool(re.search(rf"(?m)^\s*((public|private|protected|static|async|readonly|override|get|set|def)\s+)*{n}\s*[(=:<]", text))
    declared = rf"^\s*(export\s+)?(default\s+)?(declare\s+)?(async\s+)?(const|let|var|function\*?|class|def|interface|type|enum|namespace)\s+{n}\b"
    return bool(re.search(rf"(?m){declared}|^\s*{n}\s*(:[^=]*)?=(?!=)|export\s*\{{[^}}]*\b{n}\b", text))


def test_names_equal_a_pattern_for_each(spark):
    files = [*TEXTS, "absent", "null"]
    gone = [(p, n, o) for p in files for n in NAMES for o in (None, 7)]
    texts = spark.createDataFrame([*TEXTS.items(), ("null", None)], "path string, content string")
    left = dangling.without_definition(spark.createDataFrame(gone, "path string, name string, owner long"), texts)
    assert {tuple(r) for r in left.collect()} == {(p, n, o) for p, n, o in gone if not by_pattern(TEXTS.get(p, ""), n, o is not None)}


def test_a_long_text_of_keys(spark):
    """A key looks for its next = over all keys after it, unless pieces are looked at once."""
    text = "\n".join(f"k{i}: v" for i in range(100_000)) + "\nlast: t = 1"
    gone = spark.createDataFrame([("a", "k5", None), ("a", "last", None), ("a", "v", None)], "path string, name string, owner long")
    began = time.monotonic()
    left = dangling.without_definition(gone, spark.createDataFrame([("a", text)], "path string, content string")).collect()
    assert [r.name for r in left] == ["v"] and time.monotonic() - began < 60
