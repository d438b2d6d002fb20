"""Token counts that follow edits.

A document's state is a segment tree over its pre-tokens: every leaf holds the characters and the tokens of one
pre-token, every node their sums. An edit finds the leaf at its position by descending the tree, re-encodes from
there (some characters earlier, as far as the pattern can look ahead) until a new pre-token ends where an old one
ended behind the edit, replaces these leaves, and updates the sums above them. The rest of the text is not read
by the tokenizer again. Rows carry the leaves as two packed arrays, from which the tree is summed up in linear
time, so the state is a table like any other and takes further edits.

Cases: a null text counts as empty; positions and lengths outside the text are clipped, and null ones are 0; null
insertions are empty; a null list of edits, and null edits, change nothing; texts are taken whole; repeated rows
give repeated rows; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import in_batches

#: Characters behind its end, or its start, that can decide a pre-token of the pattern ('ll, and blanks before a word).
LOOK_AHEAD = 3
STATE = "text string, leaf_chars binary, leaf_tokens binary, n_tokens long"


class Tokenizer:
    """Pre-tokens of a text and the number of tokens of each, remembered per distinct pre-token."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts: dict[str, int] = {}

    def count(self, piece: str) -> int:
        found = self.counts.get(piece)
        if found is None:
            if len(self.counts) > 400_000:
                self.counts.clear()
            found = self.counts[piece] = len(self.encoding.encode_ordinary(piece))
        return found

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.pattern.findall(text)
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.int64, n), np.fromiter(map(self.count, pieces), np.int64, n)


class Tree:
    """Sums of characters and tokens over slots; a slot holds one leaf, several after an edit, or none."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        self.sums[0, self.size : self.size + len(chars)], self.sums[1, self.size : self.size + len(tokens)] = chars, tokens
        level = self.size
        while level > 1:
            self.sums[:, level // 2 : level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level //= 2
        self.inner: dict[int, list[tuple[int, int]]] = {}

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, position: int) -> tuple[int, int]:
        """The slot that holds a character, and the position at which it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.sums[0, node]:
                start += int(self.sums[0, node])
                node += 1
        return node - self.size, start

    def replace(self, first: int, end: int, leaves: list[tuple[int, int]]) -> None:
        """Put ``leaves`` in the place of the slots from ``first`` to before ``end``, and update the sums above."""
        for slot in range(first, end):
            self.inner.pop(slot, None)
            self.sums[:, self.size + slot] = 0
        if leaves:
            self.inner[first] = leaves
            self.sums[:, self.size + first] = np.sum(leaves, axis=0)
        touched = {(self.size + slot) // 2 for slot in range(first, end)}
        while touched and max(touched) >= 1:
            for node in touched:
                self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]
            touched = {node // 2 for node in touched if node > 1}

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        flat = self.sums[:, self.size :]
        if self.inner:
            parts, at = [], 0
            for slot in sorted(self.inner):
                parts += [flat[:, at:slot], np.array(self.inner[slot], np.int64).T]
                at = slot + 1
            flat = np.concatenate([*parts, flat[:, at:]], axis=1)
        flat = flat[:, flat[0] > 0]
        return flat[0], flat[1]


def edit(text: str, tree: Tree, tokenizer: Tokenizer, at: int, delete: int, insert: str) -> tuple[str, int]:
    """Apply one edit to the text and its tree; returns the new text and the number of pre-tokens that were encoded."""
    at = min(max(at, 0), len(text))
    after = min(at + max(delete, 0), len(text))
    changed = text[:at] + insert + text[after:]
    if not tree.chars:
        chars, tokens = tokenizer.leaves(changed)
        tree.__init__(chars, tokens)
        return changed, len(chars)
    first, start = tree.find(min(max(at - LOOK_AHEAD, 0), tree.chars - 1))
    leaves, end = [], None
    shift = after - at - len(insert)
    for match in tokenizer.pattern.finditer(changed, start):
        leaves.append((len(match[0]), tokenizer.count(match[0])))
        old = match.end() + shift
        if old >= after and old < tree.chars:
            slot, begins = tree.find(old)
            if begins == old and slot > first:  # there is a slot to put the leaves into
                end = slot
                break
    tree.replace(first, tree.find(tree.chars - 1)[0] + 1 if end is None else end, leaves)
    return changed, len(leaves)


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.astype("<u4").tobytes() for a in arrays], pa.binary())


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id, the columns to ``keep``, and the state of every document: text, leaf_chars, leaf_tokens, n_tokens."""
    ranks, keep = Path(ranks_path).read_bytes(), keep or []

    def run(batches):
        tokenizer = Tokenizer(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                found = [tokenizer.leaves(t) for t in texts]
                own = [pa.array(texts, pa.string()), _packed([c for c, _ in found]), _packed([t for _, t in found]), pa.array([int(t.sum()) for _, t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], names)

    narrow = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    names = [id_col, *keep, "text", "leaf_chars", "leaf_tokens", "n_tokens"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return in_batches(narrow, run, f"{schema}, {STATE}")


def apply_edits(trees: DataFrame, edits_col: str, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The id, the state after the edits, ``before`` (tokens before them) and ``encoded`` (pre-tokens encoded for them).

    ``edits_col``: array<struct<at int, delete int, insert string>>, in characters, each on the text that the one before leaves.
    """
    ranks = Path(ranks_path).read_bytes()

    def run(batches):
        tokenizer = Tokenizer(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, texts, chars, tokens, before, edits = part.columns
                states, encoded = [], []
                for text, c, t, wanted in zip(texts.to_pylist(), chars, tokens, edits.to_pylist(), strict=True):
                    tree, n = Tree(np.frombuffer(c.as_buffer(), "<u4"), np.frombuffer(t.as_buffer(), "<u4")), 0
                    for e in wanted or []:
                        if e:
                            text, more = edit(text, tree, tokenizer, e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                            n += more
                    states.append((text, *tree.leaves(), tree.tokens))
                    encoded.append(n)
                held = [pa.array([s[0] for s in states], pa.string()), _packed([s[1] for s in states]), _packed([s[2] for s in states]), pa.array([s[3] for s in states], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *held, before, pa.array(encoded, pa.int64())], names)

    names = [id_col, "text", "leaf_chars", "leaf_tokens", "n_tokens", "before", "encoded"]
    kind = trees.schema[id_col].dataType.simpleString()
    return in_batches(trees.select(id_col, "text", "leaf_chars", "leaf_tokens", "n_tokens", edits_col), run, f"`{id_col}` {kind}, {STATE}, before long, encoded long")
