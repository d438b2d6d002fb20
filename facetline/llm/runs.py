"""Periodic runs of words: seeds from repeated k-grams, extended along diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no neighbour extends.
On the diagonal of lag q (each word beside the word q further on) it is a stretch of equal words of at least
max(5, 3 q) places: the overlap that it guarantees. Periods are taken in classes from s to 3 s / 2, whose grams have
the length that the least period of the class guarantees, 3 s (5 for period 1). As that is twice the largest period of
the class or more, a gram that lies in a run occurs next at one period's distance and not before, so each occurrence is
paired with the next one of the same gram in the same document only, and never with all of them. A table of the furthest
place covered on each lag skips the pairs of a stretch that was extended before.

Grams are named exactly: words have numbers of their own per document, and a gram of twice the length is a pair of names,
so names of one gram length are made from the last by sorting. Only places whose gram occurs again in the document are
carried on, which leaves little of a text without repetition. A task works on some documents at once, bounded by bytes.

Cases: a null or empty text, or one of blanks only, has no words and no runs; a null id is a document like others, and so
is each of repeated rows; texts of any length are whole, one row being the least that a task takes; an empty table gives no
rows. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import in_batches

#: Least words of a run, and least number of its periods.
LEAST, TIMES = 6, 4
#: Words that a task works on at once; one document at least.
GROUP_WORDS = 400_000

RUNS = "array<struct<start: long, length: long, period: long>>"


def words_of(text: Column) -> Column:
    """Words between blanks, tabs and line breaks of ASCII."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def classes(largest: int) -> Iterator[tuple[int, int, int]]:
    """(least period, largest period, gram length) of each class up to the period ``largest``."""
    if largest >= 1:
        yield 1, 1, LEAST - 1
    s = 2
    while s <= largest:
        yield s, s * 3 // 2, max(LEAST, TIMES * s) - s
        s = s * 3 // 2 + 1


def _names(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _again(names: np.ndarray) -> np.ndarray:
    """Which places have a name that occurs more than once."""
    return np.bincount(names)[names] > 1


class Diagonals:
    """Words as numbers, and for each lag how far its diagonal was extended."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.covered: dict[int, int] = {}

    def stretch(self, at: int, lag: int, size: int) -> tuple[int, int]:
        """First and last + 1 of the equal places around [at, at + size) on a diagonal; words of two documents never are equal."""
        w, n = self.words, len(self.words)
        lo, step = at, 16
        while lo > 0:
            a = max(0, lo - step)
            unequal = np.flatnonzero(w[a:lo] != w[a + lag : lo + lag])
            if len(unequal):
                lo = a + unequal[-1] + 1
                break
            lo, step = a, step * 2
        hi, step = at + size, 16
        while hi + lag < n:
            b = min(n - lag, hi + step)
            unequal = np.flatnonzero(w[hi:b] != w[hi + lag : b + lag])
            if len(unequal):
                hi += unequal[0]
                break
            hi, step = b, step * 2
        return int(lo), int(hi)

    def runs(self, pairs: np.ndarray, lags: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, period) from seeds: places in ascending order, each with the lag to its next occurrence."""
        for at, lag in zip(pairs.tolist(), lags.tolist(), strict=True):
            if at < self.covered.get(lag, 0):
                continue
            lo, hi = self.stretch(at, lag, size)
            self.covered[lag] = hi
            if hi - lo + lag >= max(LEAST, TIMES * lag):
                yield lo, hi - lo + lag, lag


def find_runs(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs. ``words``: a number per word, no number in two documents; ``ends``: of each word, the end of its document."""
    places = np.flatnonzero(_again(words))
    if len(places) < LEAST:
        return []
    diagonals, found = Diagonals(words), []
    width = 1
    # names of the grams of ``width`` words, -1 where the gram occurs once or goes over the document's end
    names = np.full(len(words), -1, np.int64)
    names[places] = _names(words[places])
    longest = int((ends - np.arange(len(words))).max())
    for least, largest, size in classes(longest // TIMES):
        while width * 2 <= size:
            places = places[places + width < len(words)]
            second = names[places + width]
            places, second = places[second >= 0], second[second >= 0]
            gram = _names(names[places] * len(words) + second)
            keep = _again(gram) if len(gram) else np.zeros(0, bool)
            places, gram = places[keep], gram[keep]
            names = np.full(len(words), -1, np.int64)
            names[places] = gram
            width *= 2
        if len(places) < 2:
            break
        rest = size - width
        at = places[places + size <= len(words)]
        second = names[at + rest]
        at, second = at[second >= 0], second[second >= 0]
        key = names[at] * len(words) + second
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        first, lag = at[order[same]], at[order[same + 1]] - at[order[same]]
        near = (lag >= least) & (lag <= largest)
        first, lag = first[near], lag[near]
        ascending = np.argsort(first, kind="stable")
        found += diagonals.runs(first[ascending], lag[ascending], size)
    return found


def _documents(texts: list[list[bytes]]) -> Iterator[tuple[list, list]]:
    """Runs, and the words that no run repeats, of each document."""
    flat, starts = [], [0]
    base = 0
    for words in texts:
        number: dict[bytes, int] = {}
        flat.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + base)
        base += len(number)
        starts.append(starts[-1] + len(words))
    starts = np.array(starts)
    words = np.concatenate(flat)
    found = sorted(find_runs(words, np.repeat(starts[1:], np.diff(starts)))) if len(words) else []
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change)[:-1] > 0
    owner = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    at = 0
    for d, words in enumerate(texts):
        own = []
        while at < len(found) and owner[at] == d:
            start, length, period = found[at]
            own.append({"start": int(start - starts[d]), "length": length, "period": period})
            at += 1
        gone = dropped[starts[d] : starts[d + 1]]
        yield own, [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_words, runs by start and then period, collapsed (the text's words without those
    that some run has after its first period, joined by one blank)."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, held, size = 0, [], 0
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                held.append(words)
                size += len(words)
                if size >= GROUP_WORDS or i == batch.num_rows - 1:
                    runs, collapsed = zip(*_documents(held), strict=True)
                    sizes = pa.array([len(x) for x in held], pa.int64())
                    texts_out = pa.array([b" ".join(x) for x in collapsed], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), sizes, pa.array(runs, kind), texts_out], ["id", "n_words", "runs", "collapsed"])
                    start, held, size = i + 1, [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_batches(read, run, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
