"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are written by Spark's own text writer, so they reach any store that Spark reaches: every row is one
frame's raw bytes, and the line separator is an empty skippable frame, which readers of the format pass over.
They are read back as whole files by Spark's binary reader; an archive is as large as the session makes its partitions.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone
from uuid import UUID

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trolley.llm.words import groups_of
from trolley.sources.scratch import scratch_path

#: Fixed values of the Zstandard format: magic numbers of a data frame, of the dictionary's skippable frame,
#: of the frame that separates records, and of a dictionary.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
RAW_DICTIONARY = 0xEC30A437

SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
TEXT_AT_ONCE = 1 << 23
VERSION = b"WARC/1.1"
WRITTEN = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A response holds an HTTP head and the payload; a revisit the same head alone, which still
    gives the payload's length and digest."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    target = "".join((url or "about:blank").split()) or "about:blank"
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": WRITTEN,
        "WARC-Target-URI": target,
        "WARC-Page-ID": str(page_id),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        lines["WARC-Refers-To"] = record_id(refers_to)
        lines["WARC-Refers-To-Page-ID"] = str(refers_to)
        lines["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields = "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode()
    return VERSION + b"\r\n" + fields + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of one record, after checking both."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError("not a WARC 1.1 record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"broken header line {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"header fields missing: {sorted(missing)}")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    return fields, rest[:size]


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; too few or too small ones serve as the dictionary's content themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or VERSION


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def opened(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    full = dictionary[:4] == struct.pack("<I", RAW_DICTIONARY)
    kind = zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(dictionary, dict_type=kind)


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded frame by frame with the dictionary of its first frame."""
    view, at = memoryview(archive), 0
    reader = None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise ValueError("the archive ends inside a skippable frame")
            if at == 0:
                if magic != DICTIONARY_MAGIC:
                    raise ValueError("the first frame holds no dictionary")
                content = bytes(view[8 : 8 + size])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the format also allows a compressed dictionary
                    content = zstandard.ZstdDecompressor().decompress(content)
                reader = zstandard.ZstdDecompressor(dict_data=opened(content))
            at += 8 + size
            continue
        if reader is None:
            raise ValueError("a record comes before the dictionary")
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one = reader.decompressobj()
        data, start = b"", at
        while not one.eof:
            if at >= len(view):
                raise ValueError(f"the frame at byte {start} is cut off")
            data += one.decompress(view[at : at + (1 << 20)])
            at = min(at + (1 << 20), len(view))
        at -= len(one.unused_data)
        yield data


def revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload (bytes), digest and refers_to: the smallest page_id with the same payload, else null.

    The pages' digests are grouped with map-side minima, so thousands of equal payloads shuffle as one row a
    task. Rows that repeat the smallest id as well as the payload revisit the first of them.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    light = rows.select("sha", "page_id")
    first = light.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    repeated = light.groupBy("page_id").count().filter("count > 1").select(F.col("page_id").alias("again"))
    linked = first.filter("copies > 1").select("sha", "first")
    out = rows.join(linked, "sha", "left").join(repeated, F.col("page_id") == F.col("again"), "left")
    head = F.col("first").isNull() | (F.col("first") == F.col("page_id"))
    out = out.withColumn("nth", F.lit(1))
    if repeated.take(1):  # only rows whose page_id occurs again are numbered, and those by page
        nth = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url"))
        out = out.filter("again IS NULL").union(out.filter("again IS NOT NULL").withColumn("nth", nth))
    return out.select(
        "page_id", "url", "payload", F.when(~head | (F.col("nth") > 1), F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str) -> None:
    """Write `pages` (page_id, url, html) as .warc.zst archives, one a partition of the pages joined with
    what they revisit, each with its own dictionary, trained on the first SAMPLE_BYTES of its records. Payloads are
    shuffled for that join at most, not again for the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for piece in groups_of(iter([batch]), "payload", TEXT_AT_ONCE):
                    for row in piece.to_pylist():
                        payload = row["payload"]
                        yield record(row["page_id"], row["url"], payload, digest_of(payload), row["refers_to"])

        source, sample, held = records(), [], 0
        for data in source:
            sample.append(data)
            held += len(data)
            if held >= SAMPLE_BYTES:
                break
        if not sample:
            return
        dictionary = trained(sample)
        packer = zstandard.ZstdCompressor(level=3, dict_data=opened(dictionary), write_checksum=True)
        out, size = [dictionary_frame(dictionary)], 0
        for part in (sample, source):
            for data in part:
                out.append(packer.compress(data))
                size += len(out[-1])
                if size > TEXT_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    framed = revisits(pages).mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    framed.write.option("lineSep", EMPTY_FRAME).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record in the archives.

    Each record's header, length, frame checksum and, for a response, payload digest are validated; a broken
    archive is an error. A revisit has no payload of its own; its length is that of its HTTP head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for data in frames(batch.column("content")[i].as_buffer().to_pybytes()):
                    rows.append(_row(*parsed(data)))
                    size += len(data)
                    if size > TEXT_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema=columns)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=columns)

    columns = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(
        run,
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary",
    )


def _row(fields: dict[str, str], block: bytes) -> dict:
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    size = int(lines[b"Content-Length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not gap or (not revisit and (len(payload) != size or digest_of(payload) != digest)):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its headers say")
    refers = fields.get("warc-refers-to-page-id")
    page = fields["warc-page-id"]
    return {
        "page_id": None if page == "None" else int(page),
        "url": fields["warc-target-uri"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": None if refers in (None, "None") else int(refers),
        "payload": None if revisit else payload,
    }


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages, from archives written and read back.

    Null html is an empty payload, empty payloads are equal to each other like any others. A page without an id
    is a response of its own unless an equal payload has an id. An empty table gives no rows; further columns
    are ignored.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
