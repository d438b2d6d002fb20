"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal if their bytes are. Each task first merges equal texts that it reads, so a hot text is shuffled a few
times per task and not once per row. The hash space is cut into contiguous key ranges; one owner task gets all texts of
a range and puts them into an extendible hash of its own: a directory of two to the power of its global depth slots, and
buckets of bounded bytes. A bucket that is overfull is split by the next bit of the hash, and the directory doubles where
the bucket was as deep as it. Texts of one hash share a bucket however full it is: they form a chain, and a text joins a
link of the chain only if all its bytes are the same. The index is a table in the shared folder: the buckets of all
owners, each with the ids of its texts. Owners hold one range in memory, and ranges are as many as their bytes ask for.

Cases: a null text is the empty text; a null id is smaller than every id, so it stays only in a group without ids, and
then ``keep_id`` is null; repeated rows of one id and text are rows of their group, of which one stays; texts of any
length are whole, and one that is longer than a bucket has one of its own; an empty table gives an empty index and no
rows. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import in_batches, materialise, small_side

#: Bytes of texts in a bucket, in a key range on average, and held by a task that merges what it reads.
BUCKET_BYTES, RANGE_BYTES, HELD_BYTES = 1_000_000, 24_000_000, 8_000_000
#: Ids in one row of the index; a text with more has several rows.
ROW_IDS = 65_536
#: Bits of the hash below those that choose the owner, which the directories use.
HASH_BITS, OWNER_BITS = 64, 24
NO_ID = -(2**63)

ENTRIES = "hash long, text string, ids array<long>"
INDEX = "owner int, slot long, depth int, hash long, link int, part int, text string, sha256 string, ids array<long>, n long, top long"


class Bucket:
    """The slots of a directory whose lowest ``depth`` bits are ``slot``."""

    def __init__(self, slot: int, depth: int):
        self.slot, self.depth, self.size = slot, depth, 0
        self.chains: dict[int, list[Link]] = {}


class Link:
    """One text of a chain, and the ids that have it and are in no row of the index yet."""

    def __init__(self, text: bytes):
        self.text, self.ids, self.n, self.top, self.parts = text, [], 0, NO_ID, 0

    def add(self, ids: list[int]) -> None:
        self.ids += ids
        self.n += len(ids)
        self.top = max(self.top, max(ids))


class ExtendibleHash:
    """Directory and buckets of one key range."""

    def __init__(self, capacity: int = BUCKET_BYTES, bits: int = HASH_BITS - OWNER_BITS):
        self.capacity, self.bits, self.depth = capacity, bits, 0
        self.directory = [Bucket(0, 0)]

    def bucket(self, key: int) -> Bucket:
        return self.directory[key & ((1 << self.depth) - 1)]

    def link(self, key: int, text: bytes) -> Link:
        """The link of a text, which is added if no link of its chain has the same bytes."""
        bucket = self.bucket(key)
        chain = bucket.chains.setdefault(key, [])
        for found in chain:
            if found.text == text:
                return found
        chain.append(added := Link(text))
        bucket.size += len(text)
        while bucket.size > self.capacity and len(bucket.chains) > 1 and bucket.depth < self.bits:
            self.split(bucket)
            bucket = self.bucket(key)
        return added

    def split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = 1 << bucket.depth
        halves = Bucket(bucket.slot, bucket.depth + 1), Bucket(bucket.slot | bit, bucket.depth + 1)
        for key, chain in bucket.chains.items():
            half = halves[bool(key & bit)]
            half.chains[key] = chain
            half.size += sum(len(x.text) for x in chain)
        for slot in range(bucket.slot, len(self.directory), bit):
            self.directory[slot] = halves[bool(slot & bit)]

    def buckets(self) -> Iterator[Bucket]:
        """Each bucket once, from the first slot that leads to it."""
        return (b for slot, b in enumerate(self.directory) if slot == b.slot)


def merged_texts(docs: DataFrame, id_col: str, text_col: str, hash_bits: int, held_bytes: int) -> DataFrame:
    """hash, text, ids: rows of one text that a task reads, merged as far as ``held_bytes`` reach.

    Beyond that, texts met once since the last time go first, and those met often stay.
    """

    def rows(found: list[tuple[int, bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(found):
            end, size = at, 0
            while end < len(found) and (size < 2_000_000 or end == at):
                size += len(found[end][1]) + 8 * len(found[end][2])
                end += 1
            part = found[at:end]
            texts = pa.array([x[1] for x in part], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), texts, pa.array([x[2] for x in part], pa.list_(pa.int64()))], ["hash", "text", "ids"])
            at = end

    def run(batches):
        held: dict[tuple[int, bytes], list[int]] = {}
        size = 0
        for batch in batches:
            ids, texts, hashes = (batch.column(i).to_pylist() for i in range(3))
            for own, text, key in zip(ids, texts, hashes, strict=True):
                at = (key, text.encode())
                known = held.get(at)
                if known is None:
                    held[at] = known = []
                    size += len(at[1]) + 100
                known.append(NO_ID if own is None else own)
                size += 8
            if size > held_bytes:
                often, kept, size = sorted((k for k, v in held.items() if 1 < len(v) < ROW_IDS), key=lambda k: -len(held[k])), {}, 0
                for k in often:
                    cost = len(k[1]) + 100 + 8 * len(held[k])
                    if size + cost <= held_bytes // 2:
                        kept[k] = held.pop(k)
                        size += cost
                yield from rows([(k, t, v) for (k, t), v in held.items()])
                held = kept
        yield from rows([(k, t, v) for (k, t), v in held.items()])

    text = F.coalesce(F.col(text_col), F.lit(""))
    # the shift of the signed hash keeps its sign, so few bits give few hashes
    read = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.shiftright(F.xxhash64(text), HASH_BITS - hash_bits).alias("hash"))
    return in_batches(read, run, ENTRIES)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, range_bytes: int = RANGE_BYTES, held_bytes: int = HELD_BYTES, row_ids: int = ROW_IDS, hash_bits: int = HASH_BITS) -> DataFrame:
    """The index, a table in the shared folder.

    owner: number of the key range. slot, depth: the bucket, which serves the directory's slots that end in these
    ``depth`` bits. hash, link: the chain and the place in it, which together name a text. part: number of the row among
    those of the text, of which the first holds text and sha256, and the last n (number of all its ids) and top
    (largest of them). ids: in descending order, the last ones null.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    owners = min(1 << (OWNER_BITS - 1), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes)))
    # contiguous ranges of the hash's upper bits, all of one width but for rounding
    top = F.shiftrightunsigned(F.shiftleft("hash", HASH_BITS - hash_bits), HASH_BITS - OWNER_BITS)
    owner = F.floor(top * owners / (1 << OWNER_BITS)).cast("int")
    entries = merged_texts(docs, id_col, text_col, hash_bits, held_bytes).withColumn("owner", owner)
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in INDEX.split(", ")]

    def run(batches):
        indexes: dict[int, ExtendibleHash] = {}
        held, size = [], 0

        def out():
            nonlocal held, size
            columns = list(zip(*held, strict=True))
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def row(own: int, bucket: Bucket, key: int, at: int, link: Link, last: bool):
            nonlocal size
            first = link.parts == 0
            ids = [None if x == NO_ID else x for x in sorted(link.ids, reverse=True)]
            held.append((own, bucket.slot, bucket.depth, key, at, link.parts, link.text.decode() if first else None, hashlib.sha256(link.text).hexdigest() if first else None, ids, link.n if last else None, link.top if last and link.top != NO_ID else None))
            size += 8 * len(ids) + (len(link.text) if first else 0)
            link.ids, link.parts = [], link.parts + 1

        for batch in batches:
            keys, texts, ids, owned = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                own, key = owned[i].as_py(), keys[i].as_py()
                index = indexes.setdefault(own, ExtendibleHash(bucket_bytes))
                link = index.link(key, texts[i].as_py().encode())
                link.add(ids[i].as_py())
                if len(link.ids) >= row_ids:
                    bucket = index.bucket(key)
                    row(own, bucket, key, bucket.chains[key].index(link), link, False)
                    if size > 2_000_000:
                        yield out()
        for own in sorted(indexes):
            index = indexes.pop(own)
            for bucket in index.buckets():
                for key, chain in bucket.chains.items():
                    for at, link in enumerate(chain):
                        row(own, bucket, key, at, link, True)
                        if size > 2_000_000:
                            yield out()
        if held:
            yield out()

    return materialise(in_batches(entries.repartitionById(owners, "owner"), run, INDEX), "text-index")


def members(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of the indexed table: the id, keep_id, group_size, kept, text_sha256.

    Texts in one row of the index, nearly all, need no join; those in several take their totals from a table of such texts.
    """
    many = index.where("part > 0 OR n IS NULL")
    name = ["owner", "hash", "link"]
    totals = many.groupBy(*name).agg(F.max("n").alias("all"), F.max("top").alias("most"), F.max("sha256").alias("sha"), F.max(F.when(F.size("ids") > 0, F.struct(F.get("ids", 0).alias("id"), "part"))).alias("first"))
    totals = small_side(materialise(totals, "large-texts"))
    one = index.where("part = 0 AND n IS NOT NULL").select("ids", F.col("n").alias("all"), F.col("top").alias("most"), F.col("sha256").alias("sha"), F.lit(True).alias("holds"))
    rest = many.select(*name, "part", "ids").join(totals, name).select("ids", "all", "most", "sha", (F.col("part") == F.col("first.part")).alias("holds"))
    each = one.unionAll(rest).select("all", "most", "sha", "holds", F.posexplode("ids").alias("pos", "id"))
    return each.select(F.col("id").alias(id_col), F.col("most").alias("keep_id"), F.col("all").alias("group_size"), (F.col("holds") & (F.col("pos") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """One row per row of ``docs``: its id, the id that stays of its text, how many rows have the text, whether it stays."""
    return members(build_index(docs, id_col, text_col, **settings), id_col)
