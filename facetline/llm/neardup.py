"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each text becomes its set of hashed word shingles; equal sets form one class, and classes go on by one
   representative, so exact copies are never paired.
2. A class retains its K smallest hash values. Inverted lists of the first KEYS of them give candidates: within a
   list of at most LIST members, all pairs, counted over the lists they share. Longer lists are split by the
   values that follow in each member's sketch, up to DEPTH values; a list that is still long after that (a large
   group of near copies, or a template or long passage in very many documents) pairs its members with one leader.
3. The union sketch of a pair estimates its similarity; estimates well below the threshold go.
4. Exact similarity on the full sets, first for the two best candidates of each member, then for all candidates
   whose ends are still in different components.
5. Lists that stayed long and hold several components: members are compared by what they have other than the
   shingles that most of the list has. That finds every further link of the list (see ``_around_consensus``) without
   pairing all with all: no candidate is lost to the length of a list.

Sets hold 63-bit hashes of shingles; "exact" means on these whole sets.

Cases: a null text, an empty one and one of blanks only have the empty set, and link with nothing; a text with
fewer words than a shingle is one shingle; texts are taken whole; repeated rows with one id are one node, with
one output row for each (if their texts differ, the one with the smallest set digest stands for the id); null ids stay alone and have a null component; an empty table gives an empty table.
Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.llm.components import components, merged
from facetline.llm.staging import in_batches, materialise, small_side

#: Retained values of a sketch, and how many of them open inverted lists.
K, KEYS = 32, 24
#: Members of a list up to which all its pairs are candidates, and values that a list's key may take.
LIST, DEPTH = 48, 4
#: Share of the keys that a pair from short lists must have in common, and how far the estimate may fall short.
SHARED, SLACK = 0.2, 0.3

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each distinct word, kept for a task; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (int64, not negative) of the shingles of a text."""
    split = (text or "").encode().translate(_LOWER).split()
    if not split:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    width = min(words, len(split))
    rolled = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        rolled = rolled * _MULTIPLIER + h[j : len(h) - width + 1 + j]
    return np.unique(_mix(rolled + np.uint64(width))).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (size of the set), class (digest of the set), sketch (its K smallest values, ascending)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t, words, hashes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), _lists([s[:K] for s in sets])], ["doc_id", "n", "class", "sketch"])

    return in_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, n long, class binary, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """rep, class, set for the rows whose id is in ``wanted`` (rep)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t, words, hashes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(s) for s in sets], pa.binary()), _lists(sets)], ["rep", "class", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(small_side(wanted), "rep", "left_semi")
    return in_batches(texts, run, "rep long, class binary, set array<long>")


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the similarity est of their union sketch, without those that fall short of the threshold."""

    def run(batches):
        top = np.iinfo(np.int64).max
        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.full((batch.num_rows, 2 * K), top, np.int64)
            for c, column in enumerate((batch.column(2), batch.column(3))):
                lengths = column.value_lengths().to_numpy()
                values, at = column.flatten().to_numpy(), np.arange(K)[None, :] < lengths[:, None]
                both[:, c * K : (c + 1) * K][at] = values
            both.sort(axis=1)
            again = np.zeros(both.shape, bool)
            again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
            distinct = np.cumsum(~again & (both != top), axis=1)
            est = (again & (distinct <= K)).sum(axis=1) / np.maximum(1, np.minimum(K, distinct[:, -1]))
            keep = est >= percent / 100 - SLACK
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[keep]), pa.array(batch.column(1).to_numpy()[keep]), pa.array(est[keep])], ["a", "b", "est"])

    first, second = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    return in_batches(pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "sa", "sb"), run, "a long, b long, est double")


def _own_sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """rep, set of the wanted representatives, one row each."""
    known = materialise(reps.select("rep", "class").join(wanted, "rep"), "known")
    return full_sets(docs, wanted, words, id_col, text_col).join(small_side(known), ["rep", "class"], "left_semi").select("rep", "set").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets. ``pairs`` must be materialised."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            va, vb = a.values.to_numpy(), b.values.to_numpy()
            keep = []
            for i, (sa, na, sb, nb) in enumerate(zip(a.offsets.to_numpy(), a.value_lengths().to_numpy(), b.offsets.to_numpy(), b.value_lengths().to_numpy(), strict=False)):
                merged = np.concatenate((va[sa : sa + na], vb[sb : sb + nb]))
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                if 100 * common >= percent * (na + nb - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    sets = materialise(_own_sets(docs, wanted, reps, words, id_col, text_col), "sets")
    first, second = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    return in_batches(pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def _split_lists(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, rep, n) of the lists that are short enough at some depth, and (key, rep, n) of those that never are."""
    slots = reps.select("rep", "n", "sketch", F.posexplode(F.slice("sketch", 1, KEYS)).alias("i", "k1"))
    keyed = slots.select("rep", "n", "k1", *[F.xxhash64(F.lit(d), F.slice("sketch", F.col("i") + 1, d)).alias(f"k{d}") for d in range(2, DEPTH + 1)])
    long, short = keyed, []
    for d in range(1, DEPTH + 1):
        counts = materialise(long.groupBy(f"k{d}").agg(F.count("*").alias("members")).where("members > 1"), "lists")
        held = materialise(long.join(small_side(counts), f"k{d}"), "members")
        short.append(held.where(F.col("members") <= LIST).select(F.xxhash64(F.lit(d), f"k{d}").alias("key"), "rep", "n"))
        long = held.where(F.col("members") > LIST).drop("members")
    joined = short[0]
    for more in short[1:]:
        joined = joined.unionAll(more)
    return joined, long.select(F.col(f"k{DEPTH}").alias("key"), "rep", "n")


def _pairs_within(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of each list, by how many lists they share."""
    a, b = lists.toDF("key", "a", "na"), lists.toDF("key", "b", "nb")
    near = a.join(b, "key").where((F.col("a") < F.col("b")) & _near_size(F.col("na"), F.col("nb"), percent))
    return near.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("na", "nb")).alias("least"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    A link: 100 * |A and B| >= percent * |A or B| of the sets of ``words``-word shingles.
    """
    found = materialise(sketches(docs, words, id_col, text_col), "sketches")
    own = found.groupBy("doc_id").agg(F.min("class").alias("own"), F.max("class").alias("last")).where("own <> last").select("doc_id", "own")
    found = found.join(small_side(materialise(own, "clashes")), "doc_id", "left")
    classes = found.where("n > 0 AND doc_id IS NOT NULL AND coalesce(own, class) = class").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialise(classes, "classes")

    short, long = _split_lists(reps)
    long = materialise(long, "long-lists")
    enough = F.col("shared") >= F.ceil(SHARED * F.least(F.lit(KEYS), F.col("least")))
    leaders = long.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "rep"), F.col("rep").alias("a"), F.col("n").alias("na"))).alias("x")).select("key", "x.a", "x.na")
    led = long.join(leaders, "key").where((F.col("a") != F.col("rep")) & _near_size(F.col("na"), F.col("n"), percent)).select("a", F.col("rep").alias("b"))
    first = _pairs_within(short, percent).where(enough).select("a", "b").unionAll(led.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    candidates = materialise(estimated(first, reps, percent), "candidates")

    best = candidates.withColumn("rank", F.row_number().over(W.partitionBy("b").orderBy(F.desc("est"), "a"))).where("rank <= 2").select("a", "b")
    best = materialise(best, "best")
    labels = components(confirmed(best, docs, reps, percent, words, id_col, text_col))

    rest = candidates.select("a", "b").join(best, ["a", "b"], "left_anti")
    apart = materialise(_apart(rest, labels), "apart")
    labels = merged(labels, confirmed(apart, docs, reps, percent, words, id_col, text_col))

    groups = materialise(_groups(long, labels), "groups")
    if not groups.isEmpty():
        stars, pairs = _around_consensus(groups, docs, reps, percent, words, id_col, text_col)
        labels = merged(labels, stars)
        apart = materialise(_apart(pairs, labels), "apart")
        labels = merged(labels, confirmed(apart, docs, reps, percent, words, id_col, text_col))

    of_class = reps.select("class", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("label", "rep").alias("root"))
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own", "class").alias("class")).join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    ends = pairs.join(la, "a", "left").join(lb, "b", "left")
    return ends.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _groups(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, rep, n, label): members of the lists (key, rep, n) that hold several components, by the largest component of their list.

    Two members of one list are in one group, and lists of one family fall into one group, so a text is in few.
    """
    placed = long.join(labels, long.rep == labels.id, "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label"))
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("members", -F.col("label"), F.col("label").alias("main"))).alias("m")).where("labels > 1")
    return placed.join(mixed.select("key", F.col("m.main").alias("grp")), "key").select("grp", "rep", "n", "label").distinct()


def _around_consensus(groups: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to the most central member of each group, and pairs (a, b) that hold every other link within it.

    The consensus M of a group has the shingles of more than half of its members. With D(x) the shingles in which x
    and M differ and S(x) = (100 - percent) * |x| - (100 + percent) * |D(x)|, texts x and y are linked exactly if
    S(x) + S(y) + 2 * (100 + percent) * |D(x) and D(y)| >= 0. So whoever has S(x) >= -S(c) is linked with the member c of
    the largest S, and all those are one component. Anyone else (a straggler) must share differences with whatever it
    is linked with, at least so many as the sizes leave open: enough to share one of its rarest differences, all but
    that many. These are few and rare, so a group is never paired with itself.
    """
    less, more = 100 - percent, 100 + percent
    wanted = materialise(groups.select("rep").distinct(), "wanted")
    sets = materialise(_own_sets(docs, wanted, reps, words, id_col, text_col), "sets")
    held = groups.join(sets, "rep")
    totals = groups.groupBy("grp").agg(F.count("*").alias("members"))
    tally = held.select("grp", F.explode("set").alias("e")).groupBy("grp", "e").agg(F.count("*").alias("df"))
    tally = materialise(tally.where("df > 1").join(totals, "grp").select("grp", "e", "df", (F.col("df") * 2 > F.col("members")).alias("common"), F.least("df", F.col("members") - F.col("df")).alias("rarity")), "tally")
    consensus = materialise(tally.where("common").groupBy("grp").agg(F.collect_list("e").alias("m")), "consensus")

    differs = held.join(consensus, "grp", "left").withColumn("m", F.coalesce("m", F.array().cast("array<long>")))
    differs = differs.select("grp", "rep", "n", "label", F.size("m").alias("size"), F.concat(F.array_except("set", "m"), F.array_except("m", "set")).alias("d"))
    differs = materialise(differs.withColumn("s", less * F.col("n") - more * F.size("d")), "differences")
    centre = materialise(differs.groupBy("grp").agg(F.max(F.struct("s", -F.col("rep"), F.col("rep").alias("c"), F.col("label").alias("of_c"))).alias("x")).select("grp", F.col("x.s").alias("top"), "x.c", "x.of_c"), "centres")
    rated = differs.join(small_side(centre), "grp")
    core = F.col("s") + F.col("top") >= 0
    stars = materialise(rated.where(core & (F.col("label") != F.col("of_c"))).select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct(), "stars")

    # no text of a fitting size has a greater S than this, and no straggler that a member of the core could meet
    low, high = F.ceil(F.col("n") * percent / 100), F.floor(F.col("n") * 100 / percent)
    nearest = F.greatest(low, F.least(high, F.col("size")))
    cap = F.least(F.col("top"), less * nearest - more * F.abs(nearest - F.col("size")))
    partner = F.when(core, F.least(cap, -F.col("top") - 1)).otherwise(cap)
    need = F.greatest(F.lit(1), F.ceil(-(F.col("s") + partner) / (2 * more)))
    held = ["grp", "rep", "n", "label", "core", "s", "need"]
    open_ = rated.select("grp", "rep", "n", "label", core.alias("core"), "s", need.alias("need"), F.size("d").alias("size"), "d").where("need <= size")
    each = open_.select(*held, "size", F.explode("d").alias("e")).join(tally.select("grp", "e", "rarity"), ["grp", "e"], "left")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("grp", "rep").orderBy(F.coalesce("rarity", F.lit(1)), "e")))
    prefixes = materialise(ranked.where("rank <= size - need + 1 AND rarity > 1").select("e", "size", "rank", *held), "prefixes")
    x, y = (prefixes.select("grp", "e", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "label", "core", "s", "size", "rank")]) for side in "xy")
    once = F.col("core_y") | (F.col("rep_x") < F.col("rep_y"))
    # what this pair must share besides its first common difference comes after that on both sides
    behind = F.least(F.col("size_x") - F.col("rank_x"), F.col("size_y") - F.col("rank_y"))
    shareable = F.col("s_x") + F.col("s_y") + 2 * more * (1 + behind) >= 0
    met = x.where("NOT core_x").join(y, ["grp", "e"]).where(once & (F.col("label_x") != F.col("label_y")) & shareable & _near_size(F.col("n_x"), F.col("n_y"), percent))
    return stars, materialise(met.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct(), "pairs")
