"""WARC archives in Zstandard form: writer, reader, and deduplication by payload digest.

Archive layout: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
frame for every record, each compressed with that dictionary. The writer trains the
dictionary on the first records of an archive, a sample of bounded size; the reader loads
it from the leading frame and decodes record by record, so neither holds an archive.

A record is checked on reading: version line, header syntax, Content-Length against the
block, the closing blank lines, exactly one record in the frame, the HTTP length, and the
payload digest.

Of records with equal payloads of at least `least_bytes` bytes, the one with the smallest
page_id is a response; the others are revisits that refer to it and carry no payload.

Tasks write archives to the shared folder under names of their own and return a manifest;
only archives in the written manifest are read, so what a lost or repeated task leaves
behind is never seen. Folders are reached through pyarrow.fs, by URI.

Defined results: null html is an empty payload; null urls and ids are left out of the
record and come back as null; rows that repeat the smallest page_id are all responses;
payloads whose ids are all null are responses; payloads of any length are one record; an
empty table gives no archive; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscreen.llm.staging import small, written
from mailscreen.session import work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values of the formats
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"

# Digests of at most so many groups of copies are broadcast: about 20 MB.
SMALL_GROUPS = 200_000
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload string"
)


@dataclass(frozen=True)
class ArchiveParams:
    least_bytes: int = 0
    archive_bytes: int = 256 << 20
    sample_bytes: int = 2 << 20
    dictionary_bytes: int = 32 << 10
    level: int = 3
    # the tables hold no fetch times; records need a date
    date: str = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_text(value: str) -> str:
    """A value fit for one header line; control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _plain_text(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(page_id, url, payload: bytes, refers_to, is_revisit: bool, params) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {params.date}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], params: ArchiveParams) -> bytes:
    """A dictionary from sample records; where they are too few, the records themselves."""
    try:
        return zstandard.train_dictionary(params.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: params.dictionary_bytes]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    if content[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if len(content) < 8:
        return None
    kind = (
        zstandard.DICT_TYPE_FULLDICT if content[:4] == DICTIONARY_MAGIC
        else zstandard.DICT_TYPE_RAWCONTENT
    )
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


class Archive:
    """One archive being written; the first records wait until the dictionary is trained."""

    def __init__(self, folder: str, params: ArchiveParams):
        self.params = params
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.waiting, self.held = [], 0
        self.out = self.frames = None
        self.n_records = self.n_bytes = 0

    def add(self, data: bytes) -> None:
        self.n_records += 1
        if self.frames is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= self.params.sample_bytes:
                self._start()
            return
        self._put(self.frames.compress(data))

    def _put(self, data: bytes) -> None:
        self.n_bytes += len(data)
        self.out.write(data)

    def _start(self) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        content = train(self.waiting, self.params)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.frames = zstandard.ZstdCompressor(
            level=self.params.level, dict_data=_dictionary(content), write_content_size=True
        )
        for data in self.waiting:
            self._put(self.frames.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.frames is None:
            self._start()
        self.out.close()
        return self.path, self.n_records, self.n_bytes


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path)


def frames(stream) -> Iterator[bytes]:
    """Every record of an archive, one decoded frame at a time."""
    data = stream.read(8)
    magic, size = struct.unpack("<II", data) if len(data) == 8 else (0, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("archive doesn't start with a dictionary frame")
    content = stream.read(size)
    if len(content) != size:
        raise ValueError("dictionary frame is cut off")
    decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
    rest = b""
    while True:
        while len(rest) < 8 and (more := stream.read(1 << 18)):
            rest += more
        if not rest:
            return
        if len(rest) >= 8 and struct.unpack("<I", rest[:4])[0] in SKIPPABLE:
            skip = 8 + struct.unpack("<I", rest[4:8])[0]
            while len(rest) < skip and (more := stream.read(1 << 18)):
                rest += more
            if len(rest) < skip:
                raise ValueError("skippable frame is cut off")
            rest = rest[skip:]
            continue
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(1 << 18)
            if not rest:
                raise ValueError("frame is cut off")
        yield b"".join(parts)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line isn't a field: {line!r}")
        out[name.lower()] = value.strip()
    return out


def _page(value: str | None) -> int | None:
    return int(value[1:-1].removeprefix(RECORD_ID)) if value and value[-2] != ":" else None


def parsed(data: bytes) -> tuple:
    """The fields of RECORDS from one record's bytes, or ValueError."""
    head, gap, tail = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("frame doesn't hold a WARC record")
    fields = _fields(lines)
    n = int(fields["content-length"])
    if tail[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't match the frame")
    http, gap, payload = tail[:n].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("block isn't an HTTP response")
    length = int(_fields(lines)["content-length"])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != length or base32_sha1(payload) != digest:
            raise ValueError("payload doesn't match its length or digest")
    elif kind != "revisit" or payload:
        raise ValueError(f"record of unexpected type or form: {kind}")
    url = fields.get("warc-target-uri")
    return (
        _page(fields["warc-record-id"]), None if url is None else _plain_text(url), length,
        digest, kind, _page(fields.get("warc-refers-to")),
        payload.decode("utf-8") if kind == "response" else None,
    )


def with_types(pages: DataFrame, params: ArchiveParams) -> DataFrame:
    """page_id, url, html, refers_to; refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha1(payload.cast("binary"))
    narrow = pages.filter(F.octet_length(payload) >= params.least_bytes)
    groups = written(
        narrow.select("page_id", digest.alias("digest"))
        .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n"),
        "warc-copies",
    )
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    rows = rows.join(small(groups, SMALL_GROUPS), "digest", "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, params: ArchiveParams = ArchiveParams()
) -> DataFrame:
    """Write the pages as archives below the folder; returns the written manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for page_id, url, html, refers_to in zip(*columns):
                first = refers_to.as_py()
                archive = archive or Archive(folder, params)
                archive.add(record(
                    page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), first,
                    first is not None, params,
                ))
                if archive.n_bytes >= params.archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "n_records", "n_bytes"), x)) for x in done],
            pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]),
        )

    return written(with_types(pages, params).mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives in the manifest, as RECORDS, one archive to a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("payload", pa.string()),
        ])
        for batch in batches:
            for path, n in zip(batch.column("path"), batch.column("n_records")):
                fs, place = filesystem(path.as_py())
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(dict(zip(schema.names, parsed(data))))
                        held, seen = held + len(data), seen + 1
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if seen != n.as_py():
                    raise ValueError(f"{place} has {seen} records, its manifest {n}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.repartition(max(1, manifest.count()))
    return files.select("path", "n_records").mapInArrow(read, RECORDS)


def archived(pages: DataFrame, params: ArchiveParams = ArchiveParams()) -> DataFrame:
    """Write the pages to archives in the shared folder and read the records back."""
    folder = work_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, params))
