"""Media columns over content-addressed payloads in tar shards.

A text's bytes, padded with zeros to a positive multiple of 64, are stored as an 8-bit grey PNG of 64
samples a row. Tasks append images to tar shards in the shared folder, a digest once a shard, and
write a manifest of digest, shard, offset and length; the manifest is a Parquet table, so that its
rows name only shards of tasks that committed. Equal digests of different shards are then given one
address. Metadata columns come from the 33 header bytes of each image by a range read; the payload
is read by its range and unpacked without loss.

Shards are written by pyarrow.fs, which knows the folder by its URI: file, hdfs, viewfs, s3 (s3a and s3n are the same to it; an endpoint
set for Spark, fs.s3a.endpoint, is handed over, keys come from the machine's own credentials), gs and abfs. Other schemes are refused.

Defined results: null and empty texts are 64 zero bytes; equal texts have equal values; an empty
table gives an empty result; a repeated doc_id is described each time."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import ensure_workers, materialize, new_path, with_row_text
from sieveline.llm._text import rows_of

WIDTH = 64
MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER = 33
SHARD_BYTES = 1 << 30
IDAT_BYTES = 1 << 26


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(text: bytes) -> bytes:
    """The PNG of a text."""
    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row has its filter byte, 0
    raw[:, 1:] = rows
    packed = zlib.compress(raw.tobytes(), 6)
    body = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first HEADER bytes."""
    if first[:8] != MAGIC or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", first[16:25])
    return width, height, bits


def decode(png: bytes) -> bytes:
    """The payload of an image that encode() made."""
    at, packed = 8, []
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        if png[at + 4 : at + 8] == b"IDAT":
            packed.append(png[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)
    return raw[:, 1:].tobytes()


def _member(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def arrow_uri(folder: str, endpoint: str | None = None) -> str:
    """A folder as Spark names it, as pyarrow.fs knows it."""
    if folder.startswith("/"):
        folder = f"file://{folder}"
    scheme, _, rest = folder.partition(":")
    if scheme not in SCHEMES:
        raise ValueError(f"media shards cannot be written to {folder}: schemes that work are {', '.join(SCHEMES)}")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    uri = f"{SCHEMES[scheme]}:{rest}"
    if SCHEMES[scheme] == "s3" and endpoint:
        bare = endpoint.partition("://")
        uri += f"?endpoint_override={bare[2] or bare[0]}" + (f"&scheme={bare[0]}" if bare[2] else "")
    return uri


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length), lazily: running it writes the shards."""
    ensure_workers(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, name, at, held = None, "", 0, {}
        try:
            for b in rows_of(batches, 500):
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    png = encode(text)
                    digest = hashlib.sha256(png).hexdigest()
                    if digest not in held:
                        if out is not None and at >= shard_bytes:
                            out.write(bytes(1024))
                            out.close()
                            out, held = None, {}
                        if out is None:
                            name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                            out = files.open_output_stream(f"{base}/{name}")
                        start = at + 512
                        held[digest] = (name, start)
                        data = _member(f"{digest}.png", len(png)) + png + bytes(-len(png) % 512)
                        out.write(data)
                        at += len(data)
                    rows.append((doc, len(text), digest, *held[digest], len(png)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()

    return with_row_text(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(store, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def describe(addresses: DataFrame, folder: str) -> DataFrame:
    """Columns read back from (digest, shard, offset, length): metadata from header ranges, values from the whole."""
    ensure_workers(addresses.sparkSession)
    fields = "digest string, shard string, offset long, length long, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        name, source = "", None
        for b in rows_of(batches, 1000):
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, files.open_input_file(f"{base}/{shard}")
                width, height, bits = header(source.read_at(HEADER, offset))
                png = source.read_at(length, offset)
                got = hashlib.sha256(png).hexdigest()
                payload = decode(png)
                if got != digest or len(payload) != width * height:
                    raise ValueError(f"{shard} at {offset} does not hold {digest}")
                samples = np.frombuffer(payload, np.uint8)
                feature = f"png:{width}x{height}x{bits}:mean={samples.mean():.6f}:max={samples.max()}:zeros={int((samples == 0).sum())}"
                rows.append((digest, shard, offset, length, width, height, bits, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), got, feature))
            if rows:
                cols = list(zip(*rows, strict=True))
                i32, i64, s = pa.int32(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (s, s, i64, i64, i32, i32, i32, i64, s, i64, i64, s, s), strict=True)], names=[x.split()[0] for x in fields.split(", ")])
        if source is not None:
            source.close()

    return addresses.select("digest", "shard", "offset", "length").mapInArrow(load, fields)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs as stored media: doc_id, n_bytes, the address (digest, shard, offset, length) and all columns of describe()."""
    hadoop = docs.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folder = arrow_uri(new_path(docs.sparkSession, "media"), hadoop.get("fs.s3a.endpoint"))
    rows = materialize(write_shards(docs, folder), "manifest")
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.*")
    one = materialize(describe(first.sortWithinPartitions("shard", "offset"), folder), "described")
    return rows.select("doc_id", "n_bytes", "digest").join(one, "digest")
