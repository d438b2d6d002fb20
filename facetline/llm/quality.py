"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (shares of character classes, lengths, repetition) are standardised and mapped to
random Fourier features, which approximate a Gaussian kernel. Each task sums its part of the normal equations;
Spark adds the parts row by row of the matrix, and the driver solves one system of fixed size. Training rows
are split by hash: most fit the ridge scores, the rest calibrate them to probabilities by isotonic regression on
score bins. All labelled rows are used, no sample.

Cases: a null text counts as empty; an empty text has statistics of 0 and is scored like any other; texts are
taken whole; repeated rows give repeated rows, and repeated labels count as often as they stand; a null or other
label than 0 and 1 is not used; without labels of both kinds every score is the share of label 1 (0.5 without
any); an empty table gives an empty table. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import in_batches, materialise

#: Random features, inverse width of the kernel on standardised statistics, ridge weight per training row.
FEATURES, GAMMA, RIDGE, SEED = 256, 0.04, 1e-4, 11
#: Bins of the raw score for calibration, and the share of training rows that calibrate (one in so many).
BINS, CALIBRATE = 1024, 4
#: Parts of the normal equations that are added at a time.
PARTS, NORMAL = 256, "row long, task long, n long, part array<double>"

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_length", "words_per_line", "upper", "lower", "digit", "space", "high",
    "pipe", "bang", "hash", "dollar", "percent", "ampersand", "star", "stop", "comma", "other_mark",
    "marked_words", "upper_words", "distinct_words", "top_word", "distinct_lines", "top_line", "long_words", "short_words",
]

_CLASSES = np.zeros(256, np.uint8)  # 0: other marks
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256), b"|", b"!", b"#", b"$", b"%", b"&", b"*", b".", b","), 1):
    _CLASSES[list(_bytes)] = _i


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text, in the order of STATISTICS."""
    data = (text or "").encode()
    out = np.zeros(len(STATISTICS))
    if not data:
        return out
    counts = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=15)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, n_words, n_lines = len(data), max(1, len(words)), max(1, len(lines))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    rows: dict[bytes, int] = {}
    for x in lines:
        rows[x] = rows.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    marked = sum(c for w, c in tally.items() if w[-1:] in b"!#$%&*|" or w in (b"|",))
    upper = sum(c for w, c in tally.items() if w.isupper() and len(w) > 1)
    out[:5] = np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean() if len(words) else 0, np.log1p(len(words) / n_lines)
    out[5:20] = counts[[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 0]] / n
    out[20:24] = marked / n_words, upper / n_words, len(tally) / n_words, max(tally.values(), default=0) / n_words
    out[24:26] = len(rows) / n_lines, max(rows.values(), default=0) / n_lines
    out[26:28] = (lengths > 15).sum() / n_words, (lengths <= 2).sum() / n_words
    return out


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, stats (array<double>) of every row."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                stats = np.concatenate([statistics(t) for t in part.column(1).to_pylist()])
                held = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(STATISTICS)), pa.array(stats))
                yield pa.RecordBatch.from_arrays([part.column(0), held], ["id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the random features, the last is the intercept; empty without both labels
    base: float
    edges: np.ndarray  # raw scores at which calibrated values stand
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, np.sqrt(2 * GAMMA), (stats.shape[1], FEATURES))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(z), 1))), axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.base)
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: positions and values of the increasing fit to ones / n, ascending in x."""
    blocks: list[list[float]] = []
    for at, weight, hits in zip(x, n, ones, strict=True):
        blocks.append([at * weight, weight, hits])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _stacked(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)


def train(stats: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on the rows of ``stats`` (id, stats) that ``labels`` marks 0 or 1; ``may_learn`` is a condition on ``id``."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0))
    rows = materialise(stats.where(may_learn).join(marked, "id").select("id", "stats", "y", (F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(CALIBRATE)) == 0).alias("calibrates")), "labelled")
    d = len(STATISTICS)
    sums = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0)), *[F.avg(F.get("stats", F.lit(i))) for i in range(d)], *[F.stddev_pop(F.get("stats", F.lit(i))) for i in range(d)]).first()
    n, ones = sums[0], sums[1]
    base = ones / n if n else 0.5
    if not n or ones in (0, n):
        return Model(np.zeros(d), np.ones(d), np.zeros(0), base, np.zeros(1), np.zeros(1))
    mean, scale = np.array(sums[2 : 2 + d]), np.array(sums[2 + d :])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), base, np.zeros(1), np.zeros(1))

    def normal(batches):
        """The task's part of the normal equations, one row for each row of the matrix."""
        from pyspark import TaskContext

        total, count = np.zeros((FEATURES + 1, FEATURES + 2)), 0
        for batch in batches:
            if batch.num_rows:
                x, y = model.features(_stacked(batch, 0)), batch.column(1).to_numpy()
                total += np.concatenate((x.T @ x, (x.T @ y)[:, None]), axis=1)
                count += len(y)
        if count:
            flat = pa.array(total.reshape(-1))
            held = pa.ListArray.from_arrays(pa.array(np.arange(FEATURES + 2, dtype=np.int32) * (FEATURES + 2)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array([TaskContext.get().partitionId()] * (FEATURES + 1), pa.int64()), pa.array([count] * (FEATURES + 1), pa.int64()), held], ["row", "task", "n", "part"])

    def added(key, table):
        parts = sorted((tuple(p), n) for p, n in zip(table.column("part").to_pylist(), table.column("n").to_pylist(), strict=True))
        return pa.table({"row": pa.array([key[0].as_py()]), "task": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([sum(n for _, n in parts)]), "part": pa.array([np.sum([p for p, _ in parts], axis=0)], pa.list_(pa.float64()))})

    fit = in_batches(rows.where("NOT calibrates").select("stats", "y"), normal, NORMAL)
    # a tree: the parts of neighbouring tasks first, so no group grows with the number of tasks
    for width in (PARTS, PARTS, None):
        fit = fit.withColumn("task", F.lit(0).cast("long") if width is None else F.floor(F.col("task") / width)).groupBy("row", "task").applyInArrow(added, NORMAL)
    solved = fit.orderBy("row").collect()
    if not solved:
        return Model(mean, model.scale, np.zeros(0), base, np.zeros(1), np.zeros(1))
    matrix = np.array([r["part"] for r in solved])
    penalty = RIDGE * solved[0]["n"] * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(matrix[:, :-1] + penalty, matrix[:, -1])

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(model.raw(_stacked(batch, 0)), -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.round((raw + 0.5) / 2 * BINS).astype(np.int64)), batch.column(1)], ["bin", "y"])

    held = in_batches(rows.where("calibrates").select("stats", "y"), binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").toPandas()
    if len(held):
        model.edges, model.values = isotonic(held["bin"].to_numpy() / BINS * 2 - 0.5, held["n"].to_numpy(float), held["ones"].to_numpy(float))
    else:
        model.edges, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """id, score (0 to 1) of every row of ``stats``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stacked(batch, 1)))], ["id", "score"])

    return in_batches(stats, run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
