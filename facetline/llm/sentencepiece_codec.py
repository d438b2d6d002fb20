"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the model has a whitespace marker behind another character, so BPE merges never cross from a
character to a following marker: a marked text falls into chunks (a run of markers and the word after it)
that are segmented independently. Each task keeps a table from chunk to ids, segments every distinct chunk
once, and joins the ids back by position, in place: no word of the corpus is shuffled. The table is bounded in
characters and starts anew beyond that, which repeats work and changes no result.

Cases: a null or empty text has no ids and decodes to the empty text; a null id array decodes to the empty
text; texts of any length are taken whole; repeated rows give repeated rows; an empty table gives an empty
table. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import in_batches

MARK = "▁"
#: Characters of chunks (keys) that one task's table may hold.
TABLE_CHARS = 8_000_000

_RUN = re.compile(" +[^ ]*")


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> None:
    """Raise unless chunks are independent under the model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    spec, crossing = proto.normalizer_spec, re.compile(f"[^{MARK}]{MARK}")
    if (
        proto.trainer_spec.model_type != pb.TrainerSpec.BPE
        or proto.trainer_spec.treat_whitespace_as_suffix
        or spec.precompiled_charsmap
        or spec.remove_extra_whitespaces
        or not (spec.add_dummy_prefix and spec.escape_whitespaces)
        or any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED or crossing.search(p.piece) for p in proto.pieces)
    ):
        raise ValueError("pieces of this model can cross whitespace markers, or it normalises texts")


def chunks(text: str) -> list[str]:
    """The chunks of a text without the marker that each begins with."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    return [run[1:] for run in _RUN.findall(" " + text.replace(MARK, " "))]


class ChunkTable:
    """Chunk to little-endian int32 ids."""

    def __init__(self, processor, limit: int = TABLE_CHARS):
        self.processor, self.limit, self.chars = processor, limit, 0
        self.ids: dict[str, bytes] = {}

    def add(self, wanted: set[str]) -> None:
        new = [c for c in wanted if c not in self.ids]
        if self.chars > self.limit:
            self.ids, self.chars, new = {}, 0, list(wanted)
        for chunk, ids in zip(new, self.processor.encode(new), strict=True):
            # the processor drops the marker of an empty text; a chunk that is one marker keeps it
            found = ids if chunk else [self.processor.piece_to_id(MARK)]
            self.ids[chunk] = b"".join(i.to_bytes(4, "little") for i in found)
            self.chars += len(chunk) + 16

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [chunks(t) if t else [] for t in texts]
        self.add(set().union(*split))
        get = self.ids.__getitem__
        return [b"".join(map(get, s)) for s in split]


def _groups(texts: list, chars: int = 4_000_000) -> Iterator[list]:
    """Runs of texts of about so many characters, so that memory does not follow the batch size."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column and ``ids`` array<int>, as the library encodes the whole text."""
    model = Path(model_path).read_bytes()
    check_model(model)

    def run(batches):
        table = ChunkTable(load(model))
        for batch in batches:
            start = 0
            for texts in _groups(batch.column(1).to_pylist()):
                packed = table.encode(texts)
                offsets = [0]
                for p in packed:
                    offsets.append(offsets[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids], ["id", "ids"])
                start += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column, ``ids`` and ``decoded``: the text that the library decodes from the ids."""
    model = Path(model_path).read_bytes()

    def run(batches):
        processor = load(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                offsets, values = part.column(1).offsets.to_numpy(), part.column(1).values.to_numpy(zero_copy_only=False)
                lengths = part.column(1).value_lengths().fill_null(0).to_numpy()
                ids = [values[o : o + n].tolist() for o, n in zip(offsets, lengths, strict=False)]
                texts = pa.array(processor.decode(ids), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return in_batches(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``ids`` and ``decoded`` of every row, as ``decode(encode(docs))`` in one pass and one worker per task."""
    model = Path(model_path).read_bytes()
    check_model(model)

    def run(batches):
        processor = load(model)
        table = ChunkTable(processor)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                packed = [np.frombuffer(p, "<i4") for p in table.encode(part.column(1).to_pylist())]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) for p in packed], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(packed)))
                texts = pa.array([processor.decode(p.tolist()) if len(p) else "" for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
