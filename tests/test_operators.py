"""Operators against naive versions and on small cases."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from facetline.functions import globs, paths, text
from facetline.operators import calls, changes, dangling, edges, intervals, planning, resolve, serving, traversal
from facetline.sources import diff, git, jsonc, python_facts, script_facts, tables
from facetline.streaming import incremental


def test_merge_edges_is_a_fold(spark):
    rng, kinds = random.Random(1), ["calls", "renders", "inherits", "references"]
    rows = [(rng.randrange(4), rng.randrange(4), rng.choice(kinds), rng.random() < 0.7, rng.randrange(60), i) for i in range(900)]
    want = {}
    for src, dst, kind, fuzzy, line, _ in rows:
        if src != dst:
            e = want.setdefault((src, dst), [kind, True, []])
            if edges.STRENGTH[kind] > edges.STRENGTH[e[0]]:
                e[0] = kind
            e[1] = e[1] and fuzzy
            if line not in e[2] and len(e[2]) < edges.LINE_CAP:
                e[2].append(line)
    got = edges.merge_edges(spark.createDataFrame(rows, "src int, dst int, kind string, fuzzy boolean, line int, ord int")).collect()
    assert {(r.src, r.dst): [r.kind, r.fuzzy, r.lines] for r in got} == want


def test_owner_counts_equal_line_scan(spark):
    rng = random.Random(7)
    spans, ranges, want = [], [], {}
    for trial in range(60):
        path, own = f"f{trial}", []
        for i in range(rng.randint(0, 12)):
            start = rng.randint(1, 80)
            own.append((path, start, start + rng.randint(-2, 30), "<module>" if rng.random() < 0.1 else f"s{i}", i))
        at, lines = 1, set()
        for _ in range(rng.randint(0, 6)):
            at += rng.randint(-3, 15)
            count = rng.randint(0, 10)
            ranges.append((path, max(1, at), count))
            lines |= set(range(max(1, at), max(1, at) + count))
            at += count
        spans += own
        for line in lines:
            inside = [(e - s, o, q) for _, s, e, q, o in own if s <= line <= e and q != "<module>"]
            owner = min(inside)[2] if inside else "<module>"
            want[path, owner] = want.get((path, owner), 0) + 1
    got = intervals.owner_counts(spark.createDataFrame(ranges, "path string, first int, count int"), spark.createDataFrame(spans, "path string, start int, end int, qual string, ord int"))
    assert {(r.path, r.owner): r.lines for r in got.collect()} == want


def test_reconcile_statuses(spark):
    files = spark.createDataFrame([("a", None, "modified", True), ("b", "old", "renamed", True), ("c", None, "added", False)], "path string, old_path string, status string, base_known boolean")
    head = spark.createDataFrame([("a", "keep", 1, 5), ("a", "new", 6, 9), ("b", "moved", 1, 3), ("c", "x", 1, 2)], "path string, qual string, start int, end int")
    base = spark.createDataFrame([("a", "keep", 1, 5), ("a", "gone", 6, 9), ("old", "moved", 1, 3)], "path string, qual string, start int, end int")
    added = spark.createDataFrame([("a", "keep", 2), ("a", "new", 4), ("b", "moved", 1), ("c", "x", 2), ("a", "<module>", 1)], "path string, owner string, lines int")
    deleted = spark.createDataFrame([("old", "moved", 2)], "path string, owner string, lines int")
    got = {(r.path, r.qual): (r.status, r.additions, r.deletions) for r in changes.reconcile(files, head, base, added, deleted).collect()}
    assert got == {("a", "keep"): ("modified", 2, 0), ("a", "new"): ("added", 4, 0), ("a", "gone"): ("deleted", 0, 4), ("b", "moved"): ("modified", 1, 2), ("c", "x"): ("added", 2, 0), ("a", "<module>"): ("modified", 1, 0)}


def _walk(adjacent_out, adjacent_in, focus, depth_in, depth_out, cap):
    depth, fronts = dict.fromkeys(focus, 0), {1: list(focus), -1: list(focus)}
    for level in range(1, max(depth_in, depth_out) + 1):
        for way, near, limit in ((1, adjacent_out, depth_out), (-1, adjacent_in, depth_in)):
            if level > limit:
                continue
            fresh = []
            for node in fronts[way]:
                for other in sorted(near.get(node, ())):
                    if other not in depth:
                        if len(depth) >= cap:
                            return depth, True
                        depth[other] = level * way
                        fresh.append(other)
            fronts[way] = fresh
    return depth, False


@pytest.mark.parametrize("cap", [1000, 25])
def test_neighborhood_equals_naive_walk(spark, cap):
    rng = random.Random(cap)
    links = {(rng.randrange(80), rng.randrange(80)) for _ in range(150)}
    links = {(a, b) for a, b in links if a != b}
    out, inn = {}, {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
        inn.setdefault(b, set()).add(a)
    symbols = spark.createDataFrame([(i, "class" if i == 3 else "function", 3 if i in (70, 71) else None) for i in range(80)], "id int, kind string, parent int")
    table = spark.createDataFrame([(a, b, "calls", False) for a, b in links], "src int, dst int, kind string, fuzzy boolean")
    got, cut = traversal.neighborhood(symbols, table, [5, 3], 2, 3, max_nodes=cap)
    want = _walk(out, inn, [5, 3, 70, 71], 2, 3, cap)
    assert ({r.id: r.depth for r in got.collect()}, cut) == want


def test_components_and_communities(spark):
    rng = random.Random(3)
    links = [(a, b) for g in range(3) for a in range(g * 20, g * 20 + 20) for b in range(a + 1, g * 20 + 20) if rng.random() < 0.5]
    bridges = [(0, 20), (20, 40)]
    nodes = spark.createDataFrame([(i,) for i in range(62)], "id int")
    weights = spark.createDataFrame([(a, b, 3.0) for a, b in links] + [(a, b, 1.0) for a, b in bridges], "src int, dst int, weight double")
    roots = {r.id: r.root for r in traversal.components(nodes, weights).collect()}
    assert roots == {**dict.fromkeys(range(60), 0), 60: 60, 61: 61}
    parts = {r.id: r.cluster for r in planning.core_clusters(nodes, weights).collect()}
    assert all(parts[i] == i // 20 * 20 for i in range(60)) and parts[60] == 60


def test_clusters_are_split_alike_in_a_task_and_by_joins(spark, monkeypatch):
    monkeypatch.setattr(planning, "SPLITS", 1)
    rng = random.Random(5)
    near = lambda a: a // 12 * 12 + rng.randrange(12)
    links = {(min(a, b), max(a, b)) for a in range(96) for b in [near(a), near(a), near(a), rng.randrange(96) if a % 5 == 0 else near(a)] if a != b}
    nodes = spark.range(97)
    weights = spark.createDataFrame([(a, b, float(1 + (a * b) % 3)) for a, b in sorted(links)], "src long, dst long, weight double")
    split = lambda most: {r.id: r.cluster for r in planning.core_clusters(nodes, weights, split_above=60, in_task=most).collect()}
    found = split(10**6)
    assert found == split(0) and found.keys() == set(range(97)) and 1 < len(set(found.values())) < 97
    assert all(found[c] == c <= i for i, c in found.items())


def test_categories_and_globs(spark):
    cases = {"src/test_a.py": "test", "vendor/tests/x.py": "generated", "db/migrate/1.rb": "migration", "a/templates/x.txt": "template", "requirements-dev.txt": "config", "notes.txt": "docs", "x.scss": "style", ".eslintrc.js": "config", "go.sum": "generated", "UserTest.java": "source", "LICENSE": "docs", "bin/tool": "other", "a.lock": "config", "logo.SVG": "asset"}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", paths.builtin_category(F.col("path")).alias("c"), paths.extension(F.col("path")).alias("e"))
    found = {r.path: r for r in rows.collect()}
    assert {p: r.c for p, r in found.items()} == cases and found[".eslintrc.js"].e == ".js" and found["LICENSE"].e == ""
    files = spark.createDataFrame([(p,) for p in ("src/a.py", "src/sub/b.ts", "b.py", "build/x", "a[1].py")], "path string")
    names = lambda condition: {r.path for r in files.where(condition).collect()}
    assert names(globs.ignored(F.col("path"), ["build/", "*.py", "!b.py"])) == {"src/a.py", "build/x", "a[1].py"}
    assert names(globs.ignored(F.col("path"), ["/src/*.py"])) == {"src/a.py"}
    assert names(globs.pattern_filter(F.col("path"), "*.py, SUB")) == {"b.py", "a[1].py"}
    assert names(globs.pattern_filter(F.col("path"), "**/*.py !a.py")) == {"b.py", "a[1].py"}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.normalize_remote(F.lit("git@github.com:Me/Repo.git"))) == "me/repo"
    assert one(text.request_number(F.lit("https://h/o/r/pull/12"))) == 12 and one(text.request_number(F.lit("x"))) is None
    assert one(text.normalize_remote(F.lit("git@example.org:Me/Repo.git"))) is None
    names = {"Optional[pkg.Order]": "pkg.Order", "List[Order]": "List", "Annotated[Order, x]": "Order", "Promise<Order>": None, "Map<A, B>": None, "str | None": None, "None | Order": "Order"}
    assert {raw: one(text.normalize_type(F.lit(raw))) for raw in names} == names
    ago = lambda s: one(text.relative_time(F.timestamp_seconds(F.lit(0)), F.timestamp_millis(F.lit(int(1000 * s)))))
    assert [ago(s) for s in (-5, 1.9, 2, 45, 60, 7200, 31104000)] == ["just now", "just now", "2 seconds ago", "45 seconds ago", "1 minute ago", "2 hours ago", "1 year ago"]
    assert one(paths.normalize(F.lit("a/./b/../../c/x"))) == "c/x" and one(paths.normalize(F.lit("../a/../../b"))) == "../../b"
    parsed = jsonc.parse_jsonc(F.lit('{// c\n "a": "x // y, }", /* z */ "b": 2,}'), "a string, b int")
    assert one(parsed["a"]) == "x // y, }" and one(parsed["b"]) == 2 and one(jsonc.parse_jsonc(F.lit("[1]"), "a string")["a"]) is None


def test_unified_diff(spark):
    body = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -3,3 +3,3 @@ def f\n same\n-old\n+new\n+++ plus\n\\ No newline at end of file\n@@ -10 +11,0 @@\n-gone"
    rows = diff.diff_lines(diff.text_lines(spark.createDataFrame([("f", body)], "path string, text string"))).orderBy("pos").collect()
    assert [(r.hunk, r.type, r.old_no, r.new_no) for r in rows] == [(0, "ctx", 3, 3), (0, "del", 4, None), (0, "add", None, 4), (0, "add", None, 5), (1, "del", 10, None)]
    many = body + "\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- a/fake\n-x"
    lines = diff.text_lines(spark.createDataFrame([("s", many)], "path string, text string")).withColumnRenamed("path", "source")
    assert {(r.path, r.side, r["first"], r["count"]) for r in diff.file_ranges(lines).collect()} == {("f", "base", 3, 3), ("f", "head", 3, 3), ("f", "base", 10, 1), ("gone", "base", 1, 2)}


SOURCE = '''import a.b.c
from .m import x as y, z
from n import *

class Shop(Base, Generic[T]):
    total: Money = None

    def __init__(self, repo: Repo):
        self.repo = Repo()

    @property
    def size(self):
        def inner(q):
            return helper(q)
        return self.repo.count() + super().size()

    @size.setter
    def size(self, v): ...

def run(*args):
    shop = Shop(args[0])
    return [s for s in shop.items()]
'''


def test_python_facts(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    rows = python_facts.python_facts(files).collect()
    have = lambda fact: {(r.scope, r.name, r.kind, r.receiver) for r in rows if r.fact == fact and r.path == "a.py"}
    assert {(r.name, r.kind, r.line, r.end) for r in rows if r.fact == "symbol" and r.path == "a.py"} == {("<module>", "module", 1, 22), ("Shop", "class", 5, 18), ("Shop.__init__", "method", 8, 9), ("Shop.size", "method", 11, 15), ("run", "function", 20, 22)}
    assert have("import") >= {("<module>", "a", None, "a"), ("<module>", "a.b.c", None, "a.b.c"), ("<module>", "y", "x", ".m"), ("<module>", "*", "*", "n")}
    assert have("call") >= {("Shop.size", "helper", "name", None), ("Shop.size", "count", "attr", "self.repo"), ("Shop.size", "size", "super", None), ("run", "items", "attr", "shop")}
    assert ("Shop", "self.repo", "Repo", None) in have("type") and ("run", "shop", "Shop", None) in have("type") and have("base") == {("Shop", "Base", None, None)}
    assert [(r.fact, r.path) for r in rows if r.path == "bad.py"] == [("failed", "bad.py")] and sum(r.path == "none.py" for r in rows) == 1


SCRIPT = """import React, { useState as use, memo } from 'react';
import * as api from './api';
const fs = require('fs');
export * from './more';
export { a as b, c } from './d';
export default class Panel extends Base {
  render() { return <Card>{api.load(this.x)}</Card>; } // skip(1)
}
export const go = async (x) => {
  return new Map(x);
};
module.exports.old = go;
"""


def test_script_facts(spark):
    lines = script_facts.parse(spark.createDataFrame([("p.tsx", SCRIPT)], "path string, content string"))
    assert {(r.name, r.kind, r.start, r.end) for r in script_facts.symbols(lines).collect()} == {("Panel", "class", 6, 8), ("Panel.render", "method", 7, 7), ("go", "function", 9, 11)}
    assert {(r.local, r.module, r.name) for r in script_facts.imports(lines).collect()} == {("React", "react", "default"), ("use", "react", "useState"), ("memo", "react", "memo"), ("api", "./api", "*"), ("fs", "fs", "*")}
    assert {(r.exported, r.local, r.module) for r in script_facts.exports(lines).collect()} == {("*", "*", "./more"), ("b", "a", "./d"), ("c", "c", "./d"), ("Panel", "Panel", None), ("default", "Panel", None), ("go", "go", None), ("old", "go", None)}
    found = {(r.name, r.kind, r.receiver) for r in script_facts.calls(lines).collect()}
    assert {("load", "attr", "api"), ("Card", "jsx", None), ("Map", "new", None)} <= found and not any(n == "skip" for n, _, _ in found)


def test_bindings_skip_circles(spark):
    imports = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "c", "z"), ("p", "q", "r", "q"), ("r", "q", "p", "q")], "path string, local string, module string, name string")
    defined = spark.createDataFrame([("c", "z", "target")], "path string, local string, target string")
    assert {(r.path, r.local) for r in resolve.bindings(imports, defined).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}


def test_toggle(spark):
    every = F.array(*[F.lit(x) for x in "abc"])
    one = lambda selected, value, **k: spark.range(1).select(serving.toggle(selected, F.lit(value), every, **k).alias("x")).first().x
    ab = F.array(F.lit("a"), F.lit("b"))
    assert one(F.lit(None).cast("array<string>"), "a") == ["a"] and one(ab, "a") == ["b"] and one(ab, "c") is None and one(F.array(F.lit("a")), "a") is None and one(ab, "a", exclusive=True) == ["b", "c"]


def test_git_sources(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (repo / "keep.py").write_text("one\ntwo\nthree\n")
    (repo / "old name é.py").write_text("".join(f"line {i}\n" for i in range(30)))
    (repo / "empty.txt").write_text("")
    run("add", "-A"), run("commit", "-qm", "one")
    (repo / "keep.py").write_text("one\n2\nthree\nfour\n")
    (repo / "old name é.py").rename(repo / "new.py")
    with (repo / "new.py").open("a") as f:
        f.write("more\n")
    (repo / "data.bin").write_bytes(bytes(range(256)))
    run("add", "-A"), run("commit", "-qm", "two")
    at = str(repo)
    assert {r.path for r in tables.tree(git.tree(spark, at, "HEAD")).collect()} == {"keep.py", "new.py", "empty.txt", "data.bin"}
    assert bytes(git.file_at(spark, at, "HEAD", "empty.txt").first().content) == b"" and git.file_at(spark, at, "HEAD", "no.txt").count() == 0
    files = {r.path: (r.status, r.old_path, r.additions, r.deletions, r.binary) for r in changes.changed_files(*git.changed(spark, at, "HEAD~1", "HEAD")).collect()}
    assert files == {"keep.py": ("modified", None, 2, 1, False), "new.py": ("renamed", "old name é.py", 1, 0, False), "data.bin": ("added", None, 0, 0, True)}
    found = {(r.path, r.side, r["first"], r["count"]) for r in diff.file_ranges(git.diff_text(spark, at, "HEAD~1", "HEAD")).collect()}
    assert found == {("keep.py", "base", 2, 1), ("keep.py", "head", 2, 1), ("keep.py", "head", 4, 1), ("new.py", "head", 31, 1)}


def test_snapshots_and_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    assert tables.write_snapshot(files, str(tmp_path)) == tables.write_snapshot(files.orderBy(F.desc("path")), str(tmp_path)) != tables.snapshot_id(files.limit(1)).first()["id"]
    cache = spark.createDataFrame([("k1", "v", "old")], "key string, version string, data string")
    parsed = spark.createDataFrame([("k1", "v", "new", False, 2), ("k2", "v", "bad", True, 1), ("k3", "v", "x", False, 1)], "key string, version string, data string, failed boolean, at int")
    assert {(r.key, r.data) for r in tables.put_cache(cache, parsed).collect()} == {("k1", "new"), ("k3", "x")}


def test_incremental_parse_skips_what_was_seen(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    parse = lambda rows: rows.select("key", F.length("key").alias("n"))
    for keys in (["a", "bb", "a"], ["bb", "ccc"]):
        spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string").parquet(source)
        incremental.parse_new(stream, cache, parse, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.key, r.n) for r in spark.read.parquet(cache).collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]


def test_members_are_inherited_over_seven_levels(spark):
    bases = spark.createDataFrame([(i, o, i + 1) for i in range(10) for o in (0, 1)], "class long, ord int, base long")
    members = spark.createDataFrame([(7, "m", 70), (8, "n", 80)], "class long, name string, target long")
    requests = spark.createDataFrame([(1, 0, "m"), (2, 1, "n"), (3, 0, "n")], "id long, class long, name string")
    assert {r.id: r.target for r in resolve.inherited_member(requests, bases, members).collect()} == {1: 70, 2: 80}


def test_quoted_paths(spark):
    cases = {'"a/\\303\\251\\t\\"q"': 'a/é\t"q', "plain": "plain", '"': '"', '""': "", '"\\377"': "\ufffd", '"x\\\\101"': "x\\101", '"\\z\\n"': "z\n", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", text.unquote(F.col("p")).alias("u")).collect()
    assert {r.p: r.u for r in rows} == cases
    heads = {"a/x y b/x y": ("x y", "x y"), 'a/x b/z': None, '"a/\\"x" b/z': ('"x', "z"), '"c/x" b/z': None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in heads], "p string").select("p", text.header_paths(F.col("p")).alias("u")).collect()
    assert {r.p: r.u and tuple(r.u) for r in rows} == heads


def test_import_lines(spark):
    rows = spark.createDataFrame([(1, "x\nuse foo\nfrom m import foo"), (2, "use foo"), (3, "none"), (4, None)], "id int, content string")
    assert {r.id: r.n for r in rows.select("id", text.import_line(F.col("content"), F.lit("foo")).alias("n")).collect()} == {1: 3, 2: 1, 3: 1, 4: 1}


def test_settings(tmp_path):
    assert jsonc.load_settings(str(tmp_path / "none.toml")).max_bytes == 512 * 1024
    (tmp_path / "s.toml").write_text('[categories]\ntest = ["spec/**"]\nsource = "x"\n[index]\nexclude = ["gen/"]\nmax_file_kb = 3\n')
    found = jsonc.load_settings(str(tmp_path / "s.toml"))
    assert found.overrides == {"test": ["spec/**"]} and found.exclude[-1] == "gen/" and len(found.exclude) == 14 and found.max_bytes == 3072


def test_super_and_members(spark):
    bases = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (3, 0, 4)], "class long, ord int, base long")
    members = spark.createDataFrame([(4, "m", 40), (3, "constructor", 30), (1, "own", 10)], "class long, name string, target long")
    on_super = spark.createDataFrame([(1, 1, "m"), (2, 1, "constructor"), (3, 1, "own"), (4, 4, "constructor")], "id long, class long, name string")
    on_class = spark.createDataFrame([(5, 1, "own"), (6, 1, "m"), (7, 2, "m")], "id long, class long, name string")
    assert {r.id: r.target for r in calls.member_calls(on_class, on_super, bases, members).collect()} == {1: 40, 2: 2, 5: 10, 6: 40}


def test_names_over_stars(spark):
    imports = spark.createDataFrame([("a", "x", "b", "y", 0), ("a", "x", "c", "y", 1), ("b", "y", "b", "y", 0)], "path string, local string, module string, name string, ord int")
    defined = spark.createDataFrame([("c", "y", 1), ("e", "x", 2), ("f", "y", 3)], "path string, local string, target long")
    stars = spark.createDataFrame([("b", 0, "d"), ("d", 0, "f"), ("g", 0, "c"), ("g", 1, "e"), ("h", 0, "g")], "path string, ord int, module string")
    asked = spark.createDataFrame([("a", "x"), ("b", "y"), ("g", "x"), ("g", "y"), ("h", "y")], "path string, local string")
    follow = lambda deep: {(r.path, r.local): r.target for r in calls.followed_names(asked, imports, defined, stars, deep=deep).collect()}
    assert follow(True) == {("g", "x"): 2, ("g", "y"): 1, ("h", "y"): 1} and follow(False) == {("g", "x"): 2, ("g", "y"): 1}
    none = spark.createDataFrame([], asked.schema)
    assert calls.followed_names(none, imports, defined, stars, deep=True).count() == 0


def test_configurations_that_extend(spark):
    rows = [("p/q/tsconfig.json", "../base", None, {"@/*": ["src/*", "gen/*.x"]}), ("p/base.json", "./tsconfig.root.json", None, None), ("p/tsconfig.root.json", "./base", "lib", {"@/*": ["no/*"], "one": ["o"]}), ("tsconfig.json", "pkg/base", None, None)]
    merged = resolve.merged_configs(spark.createDataFrame(rows, "path string, extends string, base_url string, aliases map<string,array<string>>"))
    asked = spark.createDataFrame([(1, "p/q/a.ts", "@/k"), (2, "p/b.ts", "one"), (3, "z.ts", "one")], "id int, from_path string, spec string")
    got = [(r.id, r.base) for r in resolve.alias_candidates(asked, merged).orderBy("id", "k").collect()]
    # two configurations of p: the one that only extends inherits base and aliases
    assert got == [(1, "p/lib/src/k"), (1, "p/lib/gen/k.x"), (1, "p/lib/@/k"), (1, "p/lib/no/k"), (1, "p/lib/@/k"), (1, "p/lib/no/k"), (1, "p/lib/@/k"), (2, "p/lib/o"), (2, "p/lib/one"), (2, "p/lib/o"), (2, "p/lib/one")]


def test_references_as_uses(spark):
    refs = spark.createDataFrame([(1, "a", "py", "f", "x", 1), (2, "a", "py", "f", "m.x", 2), (3, "a", "py", "f", "a.b.c", 3)], "use int, path string, family string, scope string, ref string, line int")
    assert {(r.use, r.name, r.receiver) for r in dangling.reference_uses(refs).collect()} == {(1, "x", None), (2, "x", "m")}
