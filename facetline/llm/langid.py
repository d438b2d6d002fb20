"""Language identification of spans and documents.

Training counts letter trigrams per language, and the scripts in which each language is written, over a bounded
sample of labelled documents. Each word of a text is scored for every language by the log probabilities of its
trigrams; languages that are not written in the word's script are ruled out first. A Viterbi pass over the words
with a penalty for each switch labels spans, so a text in several languages falls into spans of one language
each. A document's language is that of most letters; its score is the share of letters so labelled, times the
mean posterior of those words.

Cases: a null text, and one without a letter, has language ``und``, score 0 and no spans; a word whose script no
language was seen in is open to all; texts are taken whole, however long; repeated rows give repeated rows; ties
go to the language that sorts first; an empty table gives an empty table; without any labelled row everything is
``und``. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.llm.staging import in_batches, materialise

#: Labelled documents per language that training reads at most, those with the smallest hash of their id.
SAMPLE_DOCS, SAMPLE_PARTS = 800, 64
#: Hashed trigram slots.
SLOTS = 1 << 15  # the top bits of the hash
#: Cost of a switch, in nats; scale of a word's score difference, as trigrams of one word are not independent.
SWITCH, TEMPER = 6.0, 0.7
#: Share of a language's letters from which a script is one of its own.
SCRIPT_SHARE = 0.01
UND = "und"

# First and last code points of common scripts (Unicode).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = "other"
SCRIPT_NAMES = [*SCRIPTS, OTHER]

_WORD = re.compile(r"[^\W\d_]+")


def only_letters(text: str) -> str:
    """The text with blanks for numerals that the word pattern takes for letters, such as fractions and Roman ones."""
    return "".join(" " if c.isnumeric() and not c.isalpha() else c for c in text)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text."""
    found = _WORD.findall(text)
    return found if all(map(str.isalpha, found)) else _WORD.findall(only_letters(text))


_EDGES = sorted((first, last, i) for i, ranges in enumerate(SCRIPTS.values()) for first, last in ranges)
_FIRST, _LAST, _SCRIPT = (np.array(x) for x in zip(*_EDGES, strict=True))


def scripts_of(words: list[str]) -> np.ndarray:
    """Index of the script of each word's first letter."""
    first = np.array([ord(w[0]) for w in words])
    at = np.maximum(0, np.searchsorted(_FIRST, first, side="right") - 1)
    return np.where((_FIRST[at] <= first) & (first <= _LAST[at]), _SCRIPT[at], len(SCRIPT_NAMES) - 1)


def slots(words: list[str]) -> np.ndarray:
    """Hashed trigrams of lower-cased words between blanks, one after the other: as many for each word as it has letters."""
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)[points[1:-1] != 32]


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (SLOTS, languages)
    open_to: np.ndarray  # (scripts, languages): a script's candidates


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Counts over at most ``sample_docs`` documents for each language, of the rows where ``may_learn`` holds.

    The sample is a top-k by hash of id for each language, all rows of the last id included; the driver gets one row
    per language and slot.
    """
    labelled = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # first within parts of a language, so that no task gets more rows of one than the parts leave
    hashed = labelled.where(F.col(lang_col) != UND).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.pmod(F.spark_partition_id(), F.lit(SAMPLE_PARTS)).alias("part"))
    firsts = hashed.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy("h"))).where(F.col("rank") <= sample_docs)
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    bounds = materialise(ranked.where(F.col("rank") <= sample_docs).groupBy("lang").agg(F.max("h").alias("bound")), "language-samples")
    languages = sorted(r.lang for r in bounds.select("lang").collect())
    if not languages:
        return Model([], np.zeros((SLOTS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    chosen = labelled.join(F.broadcast(bounds), labelled[lang_col] == bounds["lang"]).where(F.xxhash64(id_col) <= F.col("bound")).select(bounds["lang"], F.col(text_col).alias("text"))

    def count(batches):
        counts, scripts = {}, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
                letters = scripts.setdefault(lang, np.zeros(len(SCRIPT_NAMES), np.int64))
                if words := words_of(text.lower()):
                    held += np.bincount(slots(words), minlength=SLOTS)
                    letters += np.bincount(scripts_of(words), [len(w) for w in words], len(SCRIPT_NAMES)).astype(np.int64)
        for lang, held in counts.items():
            both = np.concatenate((held, scripts[lang]))
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(both[at])], ["lang", "slot", "n"])

    sums = in_batches(chosen, count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((SLOTS + len(SCRIPT_NAMES), len(languages)))
    table[sums["slot"].to_numpy(), sums["lang"].map(languages.index).to_numpy(int)] = sums["n"]
    grams, scripts = table[:SLOTS] + 0.5, table[SLOTS:]
    open_to = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    open_to[~open_to.any(axis=1)] = True
    return Model(languages, np.log(grams / grams.sum(axis=0)), open_to)


class WordScores:
    """Rows of scores of distinct words, kept for a task; starts anew when full."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self):
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words, languages) and lengths."""
        if len(self.row) > self.limit:
            self._clear()
        new = set(words).difference(self.row)
        if new:
            have, need = len(self.row), len(self.row) + len(new)
            if need > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((max(need, len(self.rows)), self.rows.shape[1]), np.float32)))
                self.letters = np.concatenate((self.letters, np.zeros(len(self.rows) - len(self.letters), np.int64)))
            fresh = list(new)
            lowered = [w.lower() for w in fresh]
            ends = np.cumsum([len(w) for w in lowered])
            sums = np.add.reduceat(self.model.log_prob[slots(lowered)], np.concatenate(([0], ends[:-1])), axis=0)
            ruled_out = ~self.model.open_to[scripts_of(lowered)]
            sums -= sums.max(axis=1, keepdims=True)
            self.rows[have:need] = np.where(ruled_out, -50.0, np.maximum(sums * TEMPER, -50.0))
            self.letters[have:need] = [len(w) for w in fresh]
            self.row.update(zip(fresh, range(have, need), strict=True))
        at = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        return self.rows[at], self.letters[at]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of the words of many texts at once: ``scores`` holds the texts one after the other.

    Texts advance together by position, longest first, so that those still running are a prefix.
    """
    total, n_lang = scores.shape
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    back = np.zeros((total, n_lang), np.int16)
    best = np.zeros((len(lengths), n_lang), np.float32)
    own = np.arange(n_lang, dtype=np.int16)
    for t, n in enumerate(running):
        v, at = best[:n], starts[:n] + t
        if t:
            top = v.argmax(axis=1)
            moved = v[np.arange(n), top][:, None] - switch
            stays = v >= moved
            back[at] = np.where(stays, own, top[:, None].astype(np.int16))
            v = np.where(stays, v, moved)
        best[:n] = v + scores[at]
    labels = np.zeros(total, np.int16)
    now = best.argmax(axis=1).astype(np.int16) if len(lengths) else np.zeros(0, np.int16)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return labels


def _spans(words: list, labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words with one label: first character, end, language."""
    if not words:
        return []
    cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(words)]
    return [{"first": words[a].start(), "end": words[b - 1].end(), "lang": languages[labels[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans (first and end character, language) of every text."""

    def run(batches):
        table = WordScores(model)
        for batch in batches:
            start, held, chars = 0, [], 0
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                held.append(text or "")
                chars += len(held[-1])
                if chars >= 4_000_000 or i == len(texts) - 1:
                    yield _label(batch.column(0).slice(start, len(held)), held, model, table, spans)
                    start, held, chars = i + 1, [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double" + ", spans array<struct<first: int, end: int, lang: string>>" * spans
    return in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def _label(ids: pa.Array, texts: list[str], model: Model, table: WordScores, spans: bool) -> pa.RecordBatch:
    words = [words_of(t) if model.languages else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    n_lang = max(1, len(model.languages))
    share, sure = np.zeros((len(texts), n_lang)), np.zeros((len(texts), n_lang))
    labels = np.zeros(0, np.int16)
    if flat:
        scores, letters = table.of(flat)
        filled = np.flatnonzero(lengths)
        labels = viterbi(scores, lengths[filled])
        posterior = np.exp(scores[np.arange(len(flat)), labels]) / np.exp(scores).sum(axis=1)
        doc = np.repeat(np.arange(len(texts)), lengths)
        np.add.at(share, (doc, labels), letters)
        np.add.at(sure, (doc, labels), letters * posterior)
    best, total = share.argmax(axis=1), share.sum(axis=1)
    names = [model.languages[b] if t else UND for b, t in zip(best, total, strict=True)]
    score = np.minimum(1.0, sure[np.arange(len(texts)), best] / np.maximum(1, total))
    columns = {"id": ids, "lang_pred": pa.array(names, pa.string()), "score": pa.array(score)}
    if spans:
        ends = np.cumsum(lengths)
        found = [_spans(list(_WORD.finditer(only_letters(t))) if n else [], labels[e - n : e], model.languages) for t, n, e in zip(texts, lengths, ends, strict=True)]
        columns["spans"] = pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
    return pa.RecordBatch.from_pydict(columns)
