"""WARC archives with dictionary compression.

Each archive volume is one .warc.zst file: a skippable frame that holds a Zstandard dictionary, then one frame
for each record, compressed with that dictionary. The dictionary is built from records of the same volume,
taken at even distances through it (all of them are archived). A record is a response with the whole payload,
or, where another record has the same payload and a larger id, a revisit that refers to it and carries no
payload. Volumes are rows of a table in the shared folder (archive id, file bytes), so a lost executor rewrites
only its own volumes; ``save_volumes`` puts them into a folder as files.

Cases: a null payload is empty, and empty payloads are equal payloads; a null url is an empty target; repeated
rows with one id are each written, as responses or revisits like their id; payloads of any length are whole;
a row with a null id has a record whose id names no page, and is a response only if no row with its payload has an
id; an empty table gives no volume and no
rows. Only the three named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import in_batches, materialise, small_side

DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of the dictionary, of the records that it is built from, and of the records of one volume.
DICTIONARY_BYTES, SAMPLE_BYTES, VOLUME_BYTES = 32_768, 2_000_000, 16_000_000
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def format_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, with its two blank lines at the end."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", target),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[3:3] = [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return fields, http, payload


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from the records; where there is too little to train one, their beginnings as they are."""
    import zstandard

    step, samples, size = max(1, sum(map(len, records)) // SAMPLE_BYTES), [], 0
    for r in records[::step]:
        samples.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:2048] for r in samples)[:DICTIONARY_BYTES]


def write_volume(records: list[bytes]) -> bytes:
    import zstandard

    dictionary = build_dictionary(records)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(dictionary)), dictionary, *map(compressor.compress, records)])


def read_volume(data: bytes) -> Iterator[bytes]:
    """The records of a volume, one after the other."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the volume has no dictionary frame")
    view, at = memoryview(data), 8 + size
    dictionary = zstandard.ZstdCompressionDict(bytes(view[8:at]))
    while at < len(view):
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, end = [], at
        while not decoder.eof:
            step = view[end : end + 65_536]
            if not len(step):
                raise ValueError("the volume ends within a record")
            parts.append(decoder.decompress(step))
            end += len(step)
        at = end - len(decoder.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """archive (name), content (the .warc.zst file): the volumes with a record for each row of ``pages``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("first"), F.min("id").alias("last"), F.count("*").alias("rows"), F.count("id").alias("known")).where("first <> last OR known < rows AND known > 0")
    repeated = materialise(groups.drop("last", "rows", "known"), "payload-groups")
    linked = keyed.join(small_side(repeated), ["digest", "size"], "left").select("id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))

    def run(batches):
        held, size = [], 0

        def volume():
            name = hashlib.sha1(b"".join(held[0:1] + held[-1:])).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{len(held)}.warc.zst"]), pa.array([write_volume(held)], pa.binary())], ["archive", "content"])

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in columns)
                held.append(format_record(page_id, url, payload.encode(), refers_to))
                size += len(held[-1])
                if size >= VOLUME_BYTES:
                    yield volume()
                    held, size = [], 0
        if held:
            yield volume()

    return materialise(in_batches(linked, run, "archive string, content binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest (as the record states it), payload_bytes (of the full payload), payload (null for a revisit)."""

    def run(batches):
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        page = lambda x: int(own) if (own := x.removeprefix("<urn:page:").removesuffix(">")) else None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(1):
                rows, size = [], 0
                for data in read_volume(content.as_py()):
                    fields, http, payload = parse_record(data)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page(refers) if refers else None, digest, length, payload if kind == "response" else None))
                    size += len(data)
                    if size > 4_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return in_batches(archives, run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def save_volumes(archives: DataFrame, folder: str) -> DataFrame:
    """Write each volume as a file below ``folder``, a path that all executors share; returns archive and bytes of each."""

    def run(batches):
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = Path(folder) / name
                partial = target.with_suffix(".partial")
                sizes.append(partial.write_bytes(content.as_py()))
                partial.replace(target)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["archive", "bytes"])

    return in_batches(archives, run, "archive string, bytes long")
