"""WARC archives in Zstandard: one frame per record, dictionary in the leading skippable frame.

``write_archives`` writes a response record for each page, or a revisit record where a page with a
smaller id has the same payload, to ``.warc.zst`` files below a shared folder.  ``read_archives`` loads
each file's dictionary from its first frame, decodes the frames one by one, and validates the record
headers, every length, and the digests.  Any violation is an error that names file and position.

Files are cut at ARCHIVE_BYTES of compressed data.  The dictionary is trained on a sample of at most
DICTIONARY_PAGES pages of at most 64 KiB each; it affects sizes only, never what is read back.

Rows: null html counts as empty and a null url as ``about:blank``; rows that repeat a page id and its
payload are all responses (they are that page); rows without an id are responses only if no page with
an id has their payload; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_size, materialize, open_store, shared_dir

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
DICTIONARY_PAGES, DICTIONARY_BYTES = 300, 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALL = 200_000  # digests that may be broadcast, with an id each: 28 bytes
#: Forms of header values.
FORMS = {
    "warc-record-id": r"<urn:uuid:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}>", "warc-date": r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,9})?Z", "warc-target-uri": r"\S+",
    "warc-payload-digest": r"sha1:[A-Z2-7]{32}", "warc-block-digest": r"sha1:[A-Z2-7]{32}", "x-payload-length": r"\d+",
}
RECORD_BYTES = 1 << 30  # most that a frame may inflate to
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record whose block is an HTTP response; a revisit's block has no payload."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page id, payload length, payload digest, type and referred page of a valid record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise ValueError(f"bad or repeated header {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "x-payload-length", "content-length"):
        if not fields.get(name):
            raise ValueError(f"no {name}")
    for name, pattern in FORMS.items():
        if not re.fullmatch(pattern, fields.get(name, "")):
            raise ValueError(f"bad {name} {fields.get(name, '')[:60]!r}")
    datetime.datetime.fromisoformat(fields["warc-date"])  # a day that is one
    kind, size = fields["warc-type"], fields["content-length"]
    if kind not in ("response", "revisit") or not size.isdecimal():
        raise ValueError("bad type or length")
    block = rest[: int(size)]
    if len(block) != int(size) or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("the block doesn't have the length of its header")
    if fields.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block doesn't have its digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/1."):
        raise ValueError("the block is no HTTP response")
    said, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    inner = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if inner != [said]:
        raise ValueError("HTTP and WARC headers differ in the payload's length")
    refers = None
    if kind == "response":
        if len(payload) != said or base32_sha1(payload) != digest:
            raise ValueError("the payload doesn't have its length or digest")
    else:
        if not re.fullmatch(r"-?\d+", fields.get("x-refers-to-page-id", "")):
            raise ValueError("a revisit must say what it refers to")
        refers = int(fields["x-refers-to-page-id"])
        if payload or fields.get("warc-profile") != PROFILE or fields.get("warc-refers-to") != record_id(refers):
            raise ValueError("bad revisit record")
    page = fields.get("x-page-id")
    if page is not None and (not re.fullmatch(r"-?\d+", page) or fields["warc-record-id"] != record_id(int(page))):
        raise ValueError("the record's id isn't that of its page")
    return None if page is None else int(page), said, digest, kind, refers


def inflated(reader: zstandard.ZstdDecompressor, frame: bytes, most: int | None = None) -> bytes:
    """A frame's content, ``most`` bytes at most (RECORD_BYTES): more is an error before it is in memory."""
    most = RECORD_BYTES if most is None else most
    out = reader.stream_reader(frame).read(most + 1)
    if len(out) > most:
        raise ValueError(f"a frame inflates to more than {most} bytes")
    return out


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at a position, from its header and block headers."""
    head = bytes(data[at : at + 18])
    n = zstandard.frame_header_size(head)
    checksum = zstandard.get_frame_parameters(head).has_checksum
    while True:
        b = bytes(data[at + n : at + n + 3])
        if len(b) < 3:
            raise ValueError("a frame is cut off")
        word = int.from_bytes(b, "little")
        kind, size = word >> 1 & 3, word >> 3
        if kind == 3:
            raise ValueError("bad block")
        n += 3 + (1 if kind == 1 else size)
        if word & 1:
            n += 4 * checksum
            if at + n > len(data):
                raise ValueError("a frame is cut off")
            return n


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        n = struct.unpack("<I", data[4:8])[0]
        body = data[8 : 8 + n]
        if len(body) != n:
            raise ValueError("the dictionary is cut off")
        if body[:4] == b"\x28\xb5\x2f\xfd":
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, at = zstandard.ZstdCompressionDict(body), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if struct.unpack("<I", data[at : at + 4])[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]  # other skippable frames carry no record
            continue
        n = frame_length(view, at)
        yield inflated(reader, bytes(view[at : at + n]))
        at += n


class ArchiveWriter:
    """Writes records to archives of bounded size; ``done`` lists the finished files."""

    def __init__(self, folder: str, part: int, dictionary: bytes):
        self.fs, self.path = open_store(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.stem, self.out, self.done = f"{part:06d}-{uuid.uuid4().hex[:12]}", None, []
        self.dictionary = dictionary
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)

    def add(self, record: bytes):
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name, self.at, self.n = f"{self.stem}-{len(self.done):04d}.warc.zst", 0, 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
            if self.dictionary:
                self._write(struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary)
        self._write(self.zstd.compress(record))
        self.n += 1

    def _write(self, data: bytes):
        self.out.write(data)
        self.at += len(data)

    def close(self):
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.n, self.at))
            self.out = None


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample; empty where the sample is too small to train one."""
    few = pages.select(html).filter((F.length(html) > 0) & (F.length(html) <= 65536)).limit(DICTIONARY_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[0].encode("utf-8", "replace") for r in few]).as_bytes() if few else b""
    except zstandard.ZstdError:
        return b""


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages plus ``original``: the smallest page id with the same payload, where others share it.

    Payloads of under ``min_bytes`` bytes are never shared.  Ids and digests alone are aggregated and, up to
    SMALL digests that repeat, alone are moved: these are broadcast, beyond that pages are joined on digests.
    """
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    shared = known.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").select("digest", "original")
    shared = materialize(shared, "warc-shared")
    return known.join(F.broadcast(shared) if shared.count() <= SMALL else shared, "digest", "left")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives now; one row per file: name, records, bytes."""
    dictionary = train_dictionary(pages)  # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        writer = ArchiveWriter(folder, TaskContext.get().partitionId(), dictionary)
        for batch in by_size(batches, "html"):
            for page, url, html, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "original")), strict=True):
                writer.add(build_record(page, url, html.encode("utf-8", "surrogatepass"), original, original is not None and original != page))
        writer.close()
        names, records, sizes = zip(*writer.done, strict=True) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    rows = with_originals(pages, min_bytes).select("page_id", "url", "html", "original")
    return materialize(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-files")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives listed, each file read by one task."""
    n = max(1, files.count())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]):
        fs, path = open_store(folder)
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}") as f:
                    data = f.read()
                rows = []
                for k, record in enumerate(read_archive(data)):
                    try:
                        rows.append(parse_record(record))
                    except (ValueError, KeyError) as e:
                        raise ValueError(f"{name}, record {k}: {e}") from e
                if len(rows) != expected:
                    raise ValueError(f"{name} has {len(rows)} records, not {expected}")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)
