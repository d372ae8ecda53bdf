"""Media columns: content-addressed payloads in tar shards.

``write_media`` stores each text losslessly as an 8-bit grey image of 64 samples a line in tar shards
below the shared folder and returns rows with the payload's digest and the place of the stored form
(shard, offset, length).  ``read_media`` fills metadata columns from the first bytes of each stored
image only, and, where asked to, reads, verifies and describes the payload itself.

A payload is the text's UTF-8 bytes plus zero bytes up to a positive multiple of 64.  Tar members are
named by the payload's SHA-256, and equal texts are stored once in all: digests are counted first, texts
whose digest is alone are stored where they are read, and of the others one each, after an aggregation
that leaves a task one copy of each.  Texts that differ in trailing zero characters share a payload and
its digest, but not a stored form, which knows the unpadded length.  Every attempt of a task writes
shards of its own name, and rows name the shards of the attempt that was committed: a lost executor
costs a rerun and no wrong reference.

Rows: a null text counts as empty and is stored as 64 zero samples; repeated rows give repeated rows;
an empty table gives an empty table; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_size, discard, materialize, open_store, shared_dir

WIDTH = 64
SHARD_BYTES = 256 << 20
SMALL = 200_000  # digests that may be broadcast: 40 bytes each
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = 8 + 25 + 20  # signature, image header, chunk with the unpadded length


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(text: str) -> tuple[bytes, int]:
    """Payload of a text and its length without padding."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def encode_image(payload: bytes, n_bytes: int, level: int = 3) -> bytes:
    """The payload as an 8-bit grey PNG; the same payload always gives the same bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return b"".join((SIGNATURE, _chunk(b"IHDR", header), _chunk(b"quLn", struct.pack(">Q", n_bytes)), _chunk(b"IDAT", zlib.compress(lines, level)), _chunk(b"IEND", b"")))


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and unpadded length from the first HEAD bytes of a stored image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"quLn":
        raise ValueError("not a stored payload")
    if zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0] or zlib.crc32(head[37:49]) != struct.unpack(">I", head[49:53])[0]:
        raise ValueError("a stored header is damaged")
    width, height = struct.unpack(">II", head[16:24])
    return width, height, struct.unpack(">Q", head[41:49])[0]


def decode_image(media: bytes) -> bytes:
    """The payload of a stored image; damaged data are an error."""
    width, height, _ = image_header(media[:HEAD])
    at, data = HEAD, []
    while media[at + 4 : at + 8] != b"IEND":
        n = struct.unpack(">I", media[at : at + 4])[0]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a stored chunk is damaged")
        data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("lines with a filter are not written here")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar shards of bounded size and tells where each member's data lie."""

    def __init__(self, folder: str, part: int):
        self.fs, self.path = open_store(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.stem, self.no, self.out = f"{part:06d}-{uuid.uuid4().hex[:12]}", 0, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.shard = f"{self.stem}-{self.no:04d}.tar"
            self.out, self.at, self.no = self.fs.open_output_stream(f"{self.path}/{self.shard}"), 0, self.no + 1
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        begin = self.at + len(head)
        self.at = begin + len(data) + -len(data) % 512
        return self.shard, begin

    def close(self):
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


PLACE = "digest binary, n long, media_sha256 string, shard string, offset long, length long"


def payload_digest(text: Column) -> tuple[Column, Column]:
    """SHA-256 of a text's payload and its length without padding."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    zeros = F.substr(F.lit(bytearray(WIDTH)), F.lit(1), F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int"))
    return F.unhex(F.sha2(F.concat(raw, zeros), 256)), n.cast("long")


def store(payloads: DataFrame, folder: str) -> DataFrame:
    """Stores each row (digest, n, text) in shards below ``folder`` when run; its place instead of its text."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        writer = ShardWriter(folder, TaskContext.get().partitionId())
        for batch in by_size(batches, "text"):
            rows = []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                payload, n = pad(text or "")
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError("a text doesn't have the digest it was counted under")
                media = encode_image(payload, n)
                shard, at = writer.add(digest.hex(), media)
                rows.append((hashlib.sha256(media).hexdigest(), shard, at, len(media)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=["digest", "n", "media_sha256", "shard", "offset", "length"])
        writer.close()

    return payloads.mapInArrow(run, PLACE)


def write_once(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores the different texts now: (key, digest, n) of every row, and the place of every (digest, n)."""
    digest, n = payload_digest(F.col(text))
    named = df.select(F.col(key), digest.alias("digest"), n.alias("n"), F.col(text).alias("text"))
    keys = materialize(named.drop("text"), "media-keys")
    copies = materialize(keys.groupBy("digest", "n").agg(F.count("*").alias("times")).filter("times > 1").select("digest", "n"), "media-copies")
    copies_now = F.broadcast(copies) if copies.count() <= SMALL else copies
    payloads = named.select("digest", "n", F.coalesce("text", F.lit("")).alias("text"))
    alone = payloads.join(copies_now, ["digest", "n"], "left_anti")
    once = payloads.join(copies_now, ["digest", "n"], "left_semi").distinct()
    places = materialize(store(alone.unionByName(once), folder), "media-places")
    discard(copies)
    return keys, places


def write_media(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the texts in shards below ``folder`` now; one row per input row with its place."""
    keys, places = write_once(df, folder, key, text)
    return keys.join(places, ["digest", "n"]).select(key, "digest", "media_sha256", "shard", "offset", "length")


HEADER = "width long, height long, n_bytes long"
CONTENT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def feature(payload: bytes) -> str:
    """Counts of samples by their three high bits."""
    return ",".join(map(str, np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)))


def read_media(places: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Adds metadata columns read from headers alone; with ``payload`` also what the samples say."""
    kinds = T._parse_datatype_string(HEADER + (", " + CONTENT if payload else "")).fields

    def run(batches: Iterator[pa.RecordBatch]):
        fs, path = open_store(folder)
        name, f = None, None
        for batch in batches:
            rows, last, known = [], None, None
            for digest, sha, shard, at, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "media_sha256", "shard", "offset", "length")), strict=True):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f = shard, fs.open_input_file(f"{path}/{shard}")
                if (shard, at) != last:
                    head = f.read_at(HEAD, at)
                    known = image_header(head)
                    if payload:
                        media = head + f.read_at(n - HEAD, at + HEAD)
                        data = decode_image(media)
                        found = hashlib.sha256(data).hexdigest()
                        if hashlib.sha256(media).hexdigest() != sha or found != digest.hex() or len(media) != n:
                            raise ValueError(f"{shard} at {at} doesn't hold {digest.hex()}")
                        known += len(data), found, zlib.crc32(data[-WIDTH:]), n, feature(data)
                    last = shard, at
                rows.append(known)
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string() if isinstance(k.dataType, T.StringType) else pa.int64()) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *(k.name for k in kinds)])
        if f is not None:
            f.close()

    return places.mapInArrow(run, T.StructType([*places.schema.fields, *kinds]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "media")
    keys, places = write_once(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    stored = read_media(places, folder, payload=True)  # each stored form is read once
    found = keys.join(stored, ["digest", "n"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


