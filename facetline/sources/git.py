"""Repositories as data sources: tree listings, contents, diffs. Executors need the repository at the same path."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Parts into which contents are dealt by the first digits of their hash.
PARTS = 16


def _git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True, check=True).stdout


class Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


def _listing(repo: str, ref: str) -> Iterator[tuple]:
    for entry in _git(repo, "ls-tree", "-r", "-l", "-z", ref).split(b"\0")[:-1]:
        head, path = entry.split(b"\t", 1)
        mode, kind, sha, size = head.split()
        yield mode.decode(), kind.decode(), sha.decode(), None if size == b"-" else int(size), path.decode(errors="replace")


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.ref, self.contents = options["path"], options["ref"], options.get("contents", "false") == "true"

    def partitions(self):
        return [Part(i) for i in range(PARTS if self.contents else 1)]

    def read(self, part):
        rows = _listing(self.repo, self.ref)
        if not self.contents:
            yield from rows
            return
        for mode, kind, sha, size, path in rows:
            if kind == "blob" and int(sha[:4], 16) % PARTS == part.number:
                yield mode, kind, sha, size, path, _git(self.repo, "cat-file", "blob", sha)


class GitTree(DataSource):
    """Files of a commit: ``spark.read.format("git_tree").option("path", repo).option("ref", commit)``; contents on request."""

    @classmethod
    def name(cls):
        return "git_tree"

    def schema(self):
        more = ", content binary" if self.options.get("contents", "false") == "true" else ""
        return f"mode string, type string, sha string, size long, path string{more}"

    def reader(self, schema):
        return TreeReader(self.options)


def tree(spark: SparkSession, repo: str, ref: str, contents: bool = False) -> DataFrame:
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").option("path", repo).option("ref", ref).option("contents", str(contents).lower()).load()


def diff_text(spark: SparkSession, repo: str, base: str, head: str, context: int = 0, paths: list[str] | None = None) -> DataFrame:
    """source, pos, text: the lines of one diff, for ``diff.file_ranges`` and, per path, ``diff.diff_lines``."""
    literal = ["--", *[f":(literal){p}" for p in paths]] if paths else []
    lines = _git(repo, "-c", "core.quotePath=false", "diff", f"-U{context}", "-M", base, head, *literal).decode(errors="replace").split("\n")
    return spark.createDataFrame([(f"{base}..{head}", i, x) for i, x in enumerate(lines)], "source string, pos int, text string")


def changed(spark: SparkSession, repo: str, base: str, head: str) -> tuple[DataFrame, DataFrame]:
    """The raw list (path, old_path, letter) and the counts (path, adds, dels) of a diff: the two sides of ``changes.changed_files``."""
    raw, stats = [], []
    fields = _git(repo, "diff", "--raw", "-z", "-M", "--no-abbrev", base, head).decode(errors="replace").split("\0")
    i = 0
    while i < len(fields) and fields[i]:
        letter = fields[i].split()[-1]
        moved = letter[0] in "RC"
        raw.append((fields[i + 1 + moved], fields[i + 1] if moved else None, letter))
        i += 2 + moved
    fields = _git(repo, "diff", "--numstat", "-z", "-M", base, head).decode(errors="replace").split("\0")
    i = 0
    while i < len(fields) and fields[i]:
        adds, dels, path = fields[i].split("\t", 2)
        stats.append((path or fields[i + 2], adds, dels))
        i += 1 if path else 3
    return spark.createDataFrame(raw, "path string, old_path string, letter string"), spark.createDataFrame(stats, "path string, adds string, dels string")


def file_at(spark: SparkSession, repo: str, ref: str, path: str) -> DataFrame:
    """One row (path, content) if the file exists at the commit, an empty file with empty content; no row otherwise."""
    from pyspark.sql import functions as F

    return tree(spark, repo, ref, contents=True).where(F.col("path") == path).select("path", "content")
