"""Byte-balanced sharding by histogram sort.

Rows are ordered by (hash of the text, id). Splitters for equal bytes are found by counting, exactly and on all
partitions, the bytes and rows below candidate boundaries; each round narrows the probes to the one bin that
still holds an unmet target, until every splitter is within tolerance. Then the rows move once, to the range
they belong to, and take their slots there. Only DataFrame functions run on the data; the driver sees sums per
probe, whose number depends on the number of splitters alone.

Equal texts are one group and stay in one shard as long as that meets the tolerance. A group that is larger than
the tolerance allows is split by id, so a hot group spreads over shards instead of swelling one.

Cases: a null text has 0 bytes, so size 8, and counts as the empty text; a null id sorts first; repeated rows
take slots of their own, and rows with one text and id are ordered by their other columns; an empty table gives an empty table; one row that is larger than the tolerance leaves
its splitter at the nearer of its two sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.llm.staging import materialise

KEY_BITS = 60
#: Share of a shard's mean bytes that a splitter may be off its target.
TOLERANCE = 0.01
#: Rows of one sub-range, sorted by one task; a shard has as many sub-ranges as that takes, all ranges 1,024 at most.
RANGE_ROWS = 1_000_000
MAX_RANGES = 1024


@dataclass
class Probe:
    """An unmet target and the bin that holds it: a prefix of the key, then of the id within one key."""

    j: int
    target: float
    key: int | None = None  # whole key, once the id is being refined
    bits: int = 0
    prefix: int = 0
    bytes_below: int = 0
    rows_below: int = 0

    @property
    def at(self):
        return (self.key, self.bits, self.prefix)


def text_key(text: Column) -> Column:
    """A hash of the text, 0 to 2**60 - 1, evenly spread."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 4)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def find_splitters(rows: DataFrame, cuts: list[tuple[float, float]]) -> list[tuple[int, int, int, int]]:
    """For each (target bytes, tolerance), ascending: (key, ord, rows below, bytes below) of the row to split before.

    ``rows`` has size, key (0 to 2**60 - 1) and ord (long, not null).
    """
    lo, hi = rows.agg(F.min("ord"), F.max("ord")).first()
    if lo is None:
        return [(0, 0, 0, 0)] * len(cuts)
    ord_bits = max(1, (hi - lo).bit_length())
    done: dict[int, tuple[int, int, int, int]] = {}
    active = [Probe(j, t) for j, (t, _) in enumerate(cuts)]
    first = min(20, 10 + len(cuts).bit_length())
    while active:
        by_key, by_ord = [p for p in active if p.key is None], [p for p in active if p.key is not None]
        parts = []
        if by_key:
            bits = by_key[0].bits
            step = min(first if not bits else 8, KEY_BITS - bits)
            found = rows if not bits else rows.where(F.shiftright("key", KEY_BITS - bits).isin(sorted({p.prefix for p in by_key})))
            parts.append(found.select(F.lit(None).cast("long").alias("k"), F.shiftright("key", KEY_BITS - bits - step).alias("bin"), "size"))
            grown = {None: (bits + step, step)}
        else:
            grown = {}
        if by_ord:
            bits = by_ord[0].bits
            step = min(8, ord_bits - bits)
            at = F.shiftright(F.col("ord") - F.lit(lo), ord_bits - bits) if bits else F.lit(0)
            held = F.lit(False)
            for key in sorted({p.key for p in by_ord}):
                held = held | ((F.col("key") == key) & at.isin(sorted({p.prefix for p in by_ord if p.key == key})))
            parts.append(rows.where(held).select(F.col("key").alias("k"), F.shiftright(F.col("ord") - F.lit(lo), ord_bits - bits - step).alias("bin"), "size"))
            grown |= {p.key: (bits + step, step) for p in by_ord}
        both = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
        sums: dict[tuple, list] = {}
        widths = {(p.key, p.prefix): p for p in active}
        for k, b, nbytes, n in both.groupBy("k", "bin").agg(F.sum("size"), F.count("*")).collect():
            owner = (k, b >> grown[k][1])
            if owner in widths:
                sums.setdefault(owner, []).append((b, nbytes, n))
        following = []
        for p in active:
            bits, _ = grown[p.key]
            tolerance, below, n_below = cuts[p.j][1], p.bytes_below, p.rows_below
            whole = bits == (KEY_BITS if p.key is None else ord_bits)
            width = KEY_BITS if p.key is None else ord_bits
            bins = sorted(sums.get((p.key, p.prefix), []))
            for i, (b, nbytes, n) in enumerate(bins):
                if p.target < below + nbytes or i == len(bins) - 1:
                    start = (b << (width - bits), lo) if p.key is None else (p.key, lo + (b << (width - bits)))
                    end = ((b + 1) << (width - bits), lo) if p.key is None else (p.key, lo + ((b + 1) << (width - bits)))
                    before, after = abs(p.target - below), abs(below + nbytes - p.target)
                    if min(before, after) <= tolerance or (whole and (p.key is not None or n == 1)):
                        done[p.j] = (*start, n_below, below) if before <= after else (*end, n_below + n, below + nbytes)
                    elif whole:
                        following.append(Probe(p.j, p.target, b, 0, 0, below, n_below))
                    else:
                        following.append(Probe(p.j, p.target, p.key, bits, b, below, n_below))
                    break
                below, n_below = below + nbytes, n_below + n
        active = following
    return [done[j] for j in range(len(cuts))]


def _range_of(splitters: list[tuple[int, int, int, int]], key: Column, order: Column, lo: int = 0) -> Column:
    """Number of splitters at or before (key, order), as a balanced decision tree."""
    if not splitters:
        return F.lit(lo)
    mid = len(splitters) // 2
    at_key, at_order = splitters[mid][:2]
    below = (key < at_key) | ((key == at_key) & (order < at_order))
    return F.when(below, _range_of(splitters[:mid], key, order, lo)).otherwise(_range_of(splitters[mid + 1 :], key, order, lo + mid + 1))


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All columns of ``docs`` and shard (int), slot (long, gapless from 0 in each shard).

    A column of ``docs`` that is named shard or slot is replaced. Columns that the caller drops afterwards do not
    move; the others do.
    """
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    size, key, order, at, tie = (f"{own}{x}" for x in ("size", "key", "ord", "range", "tie"))
    keyed = docs.withColumns({size: text_size(F.col(text_col)), key: text_key(F.col(text_col)), order: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62))), tie: F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])))})
    counted = materialise(keyed.select(F.col(size).alias("size"), F.col(key).alias("key"), F.col(order).alias("ord")), "shard-keys")
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, min(MAX_RANGES // n_shards, -(-n // (n_shards * range_rows))))
    mean = total / n_shards
    cuts = [(total * j / (n_shards * parts), mean * (tolerance if j % parts == 0 else 0.25 / parts)) for j in range(1, n_shards * parts)]
    splitters = find_splitters(counted, cuts)
    starts = [0, *(s[2] for s in splitters)]
    offsets = F.array(*[F.lit(starts[i] - starts[i - i % parts]).cast("long") for i in range(len(starts))])
    in_range = F.row_number().over(W.partitionBy(at).orderBy(key, order, tie)).cast("long") - 1
    placed = keyed.withColumn(at, _range_of(splitters, F.col(key), F.col(order)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.floor(F.col(at) / parts).cast("int").alias("shard"), (in_range + F.element_at(offsets, F.col(at) + 1)).alias("slot"))
