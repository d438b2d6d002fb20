"""Vector codes by product quantisation, with a trie over the distinct parts of the vectors.

Components become integers, vectors are cut into parts, and each part position has a codebook of a bounded number of
entries that some rounds of assignment and averaging refine. The distinct parts of a position are counted once and laid
out in lexicographic order over all tasks. A task that walks a stretch of that order walks a trie depth first: a node is
a prefix of components and holds its squared distances to all entries over these components, so a part begins where it
branches off the path to its predecessor, and shared prefixes are summed up once. At a leaf the least distance decides,
lower entries first, and the part's components count with its number of copies. Rounds exchange sums per entry; only the
codebooks, whose size the parameters bound, reach the driver. Finally the rows are coded in place, each batch by the trie
of its own distinct parts, so that rows are never dealt out by their parts.

Cases: rows whose vector is null, empty, holds a null or non-finite component, or has another length than most, are
dropped (of lengths that occur equally often the smallest is taken); integers are held within +-2**26, so that sums of
squares are exact; where a length is no multiple of the number of parts, the first parts are longer by one, and a part
that is left without a component has code 0; a null id is coded but is an entry of the first codebook only if there are
too few others; rows that share an id seed in order of their components; fewer kept rows than entries give as many
entries as rows; an empty table gives empty codebooks and no rows. Only the named columns are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import in_batches, materialise, small_side

#: A component x becomes floor(SCALE * x), within +-MOST.
SCALE, MOST = 1024, 1 << 26
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Leaves of the trie that are walked together, one level after the other: so few that their distances stay in a core's cache.
BLOCK = 128


@dataclass(frozen=True)
class Codebooks:
    """For each part position: its first component, and its entries as a matrix of int64."""

    starts: tuple[int, ...]
    entries: tuple[np.ndarray, ...]

    def numbers(self) -> list[int]:
        """All components by part, entry and position within the part."""
        return [int(x) for e in self.entries for x in e.ravel()]


class TrieWalk:
    """Nearest entries of the parts of one position, given in lexicographic order.

    ``path[d]`` holds the distances of the last part over its first d components, of which the next part takes over
    those that it shares.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.last: np.ndarray | None = None
        self.path = [np.zeros((1, len(entries)), np.int64) for _ in range(entries.shape[1] + 1)]
        #: Nodes whose distances were summed up, of all components that were met.
        self.nodes = self.components = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row of ``parts``."""
        found = [self._block(parts[i : i + BLOCK]) for i in range(0, len(parts), BLOCK)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = parts.shape
        above = np.empty((n, width), parts.dtype)
        above[1:] = parts[:-1]
        above[:1] = parts[:1] if self.last is None else self.last
        # a row opens a node at each depth from the first component in which it differs from the row above it
        opens = np.logical_or.accumulate(parts != above, axis=1)
        if self.last is None:
            opens[0] = True
        node = np.zeros(n, np.int64)  # of each row at the depth before; 0 is the one on the path so far
        sums = self.path[0]
        for d in range(width):
            new = np.flatnonzero(opens[:, d])
            step = parts[new, d][:, None] - self.entries[:, d]
            step *= step
            grown = np.empty((len(new) + 1, len(self.entries)), np.int64)
            grown[:1] = self.path[d + 1]
            np.add(sums[node[new]], step, out=grown[1:])
            self.nodes += len(new)
            sums = grown
            node = np.cumsum(opens[:, d])
            self.path[d + 1] = sums[-1:].copy()
        self.components += n * width
        best = sums.argmin(axis=1)
        self.last = parts[-1]
        return best[node], sums[np.arange(len(sums)), best][node]


def cut(length: int, parts: int) -> tuple[int, ...]:
    """First components of the parts, and the length at the end."""
    size, longer = divmod(length, parts)
    return tuple(i * size + min(i, longer) for i in range(parts + 1))


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v array<int>: the rows whose vectors are whole, finite and of the usual length."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    whole = read.where((F.size("x") > 0) & F.forall("x", finite))
    held = whole.select("id", "label", F.transform("x", lambda x: F.floor(F.greatest(F.least(x, F.lit(1.0 * MOST / SCALE)), F.lit(-1.0 * MOST / SCALE)) * SCALE).cast("int")).alias("v"))
    held = materialise(held, "integer-vectors")
    lengths = held.groupBy(F.size("v").alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), "n").limit(1).collect()
    return held.where(F.size("v") == (usual[0].n if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), len(column[0]) if len(column) else 0)


def sums_of_entries(parts: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, n, sums array<long>: what the distinct parts (part, v, n), in order, add to their nearest entries."""

    def run(batches):
        walks = [TrieWalk(e) for e in books.entries]
        totals = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in books.entries]
        for batch in batches:
            position, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for p in np.unique(position):
                rows = np.flatnonzero(position == p)
                part = _matrix(batch.column(1).take(pa.array(rows)))
                entry, _ = walks[p].nearest(part)
                n = copies[rows]
                np.add.at(totals[p], entry, np.concatenate([n[:, None], part * n[:, None]], axis=1))
        for p, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(total[used, 0]), pa.array(total[used, 1:].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    each = in_batches(parts.select("part", "v", "n"), run, "part int, entry int, n long, sums array<long>")
    summed = each.select("part", "entry", "n", F.posexplode("sums").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return summed.groupBy("part", "entry").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sums"))


def distinct_parts(rows: DataFrame, starts: tuple[int, ...]) -> DataFrame:
    """part, v, n: the distinct parts of each position with their number of rows, in lexicographic order within and over files."""
    cuts = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", a + 1, b - a).alias("v")) for p, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if b > a])
    counted = rows.select(F.inline(cuts)).groupBy("part", "v").agg(F.count("*").alias("n"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(materialise(counted, "counted-parts").repartitionByRange(tasks, "part", "v").sortWithinPartitions("part", "v"), "distinct-parts")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows`` (id, v): the first ids' parts, then ``rounds`` times the means of what is nearest."""
    first = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    seeds = np.array(first or np.zeros((0, 0)), np.int64)
    starts = cut(seeds.shape[1], parts)
    books = Codebooks(starts[:-1], tuple(seeds[:, a:b].copy() for a, b in zip(starts, starts[1:], strict=False)))
    if not first:
        return books
    distinct = distinct_parts(rows, starts)
    for _ in range(rounds):
        refined = [e.copy() for e in books.entries]
        for r in sums_of_entries(distinct, books).collect():  # one row per entry at most
            refined[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
        books = Codebooks(books.starts, tuple(refined))
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, codes array<int>, errors array<long> of ``rows`` (id, label, v): the nearest entry of each part and its squared distance."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            codes, errors = np.zeros((n, len(books.entries)), np.int64), np.zeros((n, len(books.entries)), np.int64)
            v = _matrix(batch.column(2))
            for p, (start, entries) in enumerate(zip(books.starts, books.entries, strict=True)):
                if entries.shape[1] and n:
                    # rows of a set of distinct rows come in lexicographic order
                    distinct, of = np.unique(v[:, start : start + entries.shape[1]], axis=0, return_inverse=True)
                    entry, error = TrieWalk(entries).nearest(distinct)
                    codes[:, p], errors[:, p] = entry[of.ravel()], error[of.ravel()]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), k), len(books.entries)).cast(pa.list_(k)) for x, k in ((codes, pa.int32()), (errors, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "label", "codes", "errors"])

    label = rows.schema["label"].dataType.simpleString()
    return in_batches(rows.select("id", "label", "v"), run, f"id long, label {label}, codes array<int>, errors array<long>")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The codes of all kept rows of ``vectors`` (id, label, codes, errors), a table in the shared folder, and the codebooks."""
    rows = integers(vectors, id_col, vector_col, label_col)
    books = train(rows, parts, entries, rounds)
    return materialise(encode(rows, books), "vector-codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with error (sum over the parts) and label_error (sum of error over rows of the same label, nulls together)."""
    total = coded.withColumn("error", F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x))
    # exact where a sum of longs could run over, and null there
    sums = total.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long").alias("label_error"))
    sums = small_side(materialise(sums, "label-errors"))
    return total.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
