"""Zstandard-compressed WARC archives with a dictionary: writing, and reading with checks.

An archive starts with a skippable frame that holds the dictionary; then each record is
a frame of its own. The reader loads the dictionary (itself compressed or not), decodes
frame by frame, and holds every record against its headers, lengths and digest.

Pages with equal payloads of at least ``REVISIT_BYTES`` bytes are stored once: the one
with the largest id is a response, the others are revisits that refer to it and carry
its HTTP header alone. A null payload is an empty one, a null URL is left out. Pages
without an id are responses unless others with ids have their payload; rows that share
the largest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B
from runlens.llm.files import read_file, write_file
from runlens.session import new_folder

REVISIT_BYTES = 1000
#: Payload that goes into one archive, and of which its dictionary is trained.
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
#: Repeated payloads sent to every executor (about 70 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
DATE = "1970-01-01T00:00:00Z"

# fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive that breaks the format."""


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for records like the samples; None where there are too few to learn from."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def _record(page: dict, date: str) -> bytes:
    payload = page["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = page["refers_to"] is not None
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(page["digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page['page_id'])}", f"WARC-Date: {date}"]
    if page["url"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(page['url'])}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(page['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]*)>", urn)
    if not found:
        raise WarcError(f"no page id in {urn!r}")
    return int(found[1]) if found[1] else None


def _one_line(text: str) -> str:
    """A header value: control characters, spaces and the escape itself as percent codes."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _text(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive: dictionary frame, then a frame for each record."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    trained = dictionary(records[::step])
    data = trained.as_bytes() if trained else b""
    writer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data + b"".join(map(writer.compress, records))


def frames(data) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every frame of an archive, decoded with its dictionary."""
    data = memoryview(data)
    if len(data) < 8:
        raise WarcError("archive is cut off before its dictionary")
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise WarcError("archive has no whole dictionary frame")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + size
    while at < len(data):
        frame, parts, fed = reader.decompressobj(), [], at
        try:
            while not frame.eof:
                if fed >= len(data):
                    raise WarcError(f"frame at {at} is cut off")
                parts.append(frame.decompress(data[fed : fed + 65536]))
                fed = min(fed + 65536, len(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from e
        yield at, b"".join(parts)
        at = fed - len(frame.unused_data)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch("[0-9]+", value):
        raise WarcError(f"bad Content-Length {value!r}")
    return int(value)


def parse(record: bytes) -> dict:
    """One record's fields; raises where version, headers, lengths or digest are wrong."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC record: {record[:40]!r}")
    headers = _headers(lines[1:])
    for name in NEEDED:
        if name.lower() not in headers:
            raise WarcError(f"record without {name}")
    size = _length(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"record of {len(rest) - 4} bytes says it has {size}")
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise WarcError("record without an HTTP header")
    n_payload = _length(_headers(http.split(b"\r\n")[1:]))
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1":
        raise WarcError("record without a SHA-1 payload digest")
    digest = base64.b32decode(digest).hex()
    kind = headers["warc-type"]
    if kind == "response":
        if len(payload) != n_payload or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("payload differs from its length or digest")
        refers_to = None
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise WarcError("revisit with a payload, or without a record it refers to")
        refers_to, payload = _page(headers["warc-refers-to"]), None
    else:
        raise WarcError(f"record of type {kind!r}")
    url = headers.get("warc-target-uri")
    return {
        "page_id": _page(headers["warc-record-id"]),
        "url": None if url is None else _text(url),
        "payload_bytes": n_payload,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to,
        "payload": payload,
    }


def _write(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def close(records: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            data = archive(records)
            path = write_file(folder, f"part-{part:05d}-{number:05d}.warc.zst", data)
            number += 1
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": len(records), "n_bytes": len(data)}])

        held, size = [], 0
        for batch in B.blocks(batches, "payload"):
            for page in batch.to_pylist():
                held.append(_record(page, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return run


def write_archives(
    pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE
) -> DataFrame:
    """Store pages (page_id, url, html) as archives; returns their list (path, n_records, n_bytes)."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    same = pages.where(large).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    same = B.kept(same.where("n > 1 and keep is not null").select(F.col("digest").alias("same"), "keep"), "repeated-payloads")
    if same.count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    found = pages.join(same, large & (pages["digest"] == same["same"]), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull()
    found = found.select("page_id", "url", "payload", "digest", F.when(other, F.col("keep")).alias("refers_to"))
    folder = new_folder(pages.sparkSession, "warc")
    files = found.mapInArrow(_write(folder, archive_bytes, date), "path string, n_records long, n_bytes long")
    return B.kept(files, "warc-files")


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(payload: bool):
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        + [("payload", pa.binary())] * payload
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                rows, size, n = [], 0, 0
                for at, record in frames(read_file(file["path"])):
                    try:
                        row = parse(record)
                    except ValueError as e:
                        raise WarcError(f"{file['path']}, frame at {at}: {e}") from e
                    n += 1
                    size += len(record) * payload
                    rows.append(row if payload else {k: v for k, v in row.items() if k != "payload"})
                    if size >= B.BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if n != file["n_records"]:
                    raise WarcError(f"{file['path']} has {n} records, not {file['n_records']}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the listed archives, checked; with its payload (null for revisits) if asked for."""
    files = files.select("path", "n_records").repartition(B.shares(files, "n_bytes", 4 << 20))
    return files.mapInArrow(_read(payload), FIELDS + ", payload binary" * payload)
