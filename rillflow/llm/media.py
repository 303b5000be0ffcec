"""Content-addressed payloads in tar shards, with metadata columns filled by header-only range reads.

Payloads are losslessly compressed 8-bit grey images (PNG) in tar shards, each payload once overall: digests alone decide
which task stores a text that several have, and texts are never exchanged. Rows carry digest, shard, offset and length. A
second pass reads a fixed number of header bytes at each place to fill the metadata columns, a third reads the payloads
back; both read a place once, however many rows have it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import drop_path, drop_table, lean, new_path, shuffle_partitions, write_table

WIDTH = 64
SHARD_BYTES = 128 << 20
#: Signature, header chunk, and the chunk of our own with the unpadded length: what a header-only read fetches.
HEADER_BYTES = 8 + 25 + 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """The payload, with bytes 0 up to a positive multiple of 64, as a grey PNG of that width."""
    padded = payload + bytes(-len(payload) % WIDTH if payload else WIDTH)
    rows = len(padded) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # a filter byte (0: none) before each line
    lines[:, 1:] = np.frombuffer(padded, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"nbYt", struct.pack(">Q", len(payload))) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def parse_header(head: bytes) -> dict[str, int]:
    """width, height, bit_depth and n_bytes from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"nbYt":
        raise ValueError("not a stored payload")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return {"width": width, "height": height, "bit_depth": depth, "n_bytes": struct.unpack(">Q", head[41:49])[0]}


def decode(media: bytes) -> bytes:
    """The padded payload; checksums of all chunks are verified."""
    at, body, size = 8, b"", parse_header(media[:HEADER_BYTES])
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("bad checksum")
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size["height"], size["width"] + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """16 shares of the byte values' range in 1/255, and the mean of each eighth of the columns, as hex digits."""
    grey = np.frombuffer(payload, np.uint8)
    shares = np.bincount(grey >> 4, minlength=16) * 255 // len(grey)
    columns = grey.reshape(-1, 8, WIDTH // 8).astype(np.int64).sum(axis=(0, 2)) // (len(grey) // 8)
    return bytes([*shares.astype(np.uint8), *columns.astype(np.uint8)]).hex()


class _Shards:
    """Writes tar shards to the shared folder; a name is unique to an attempt, so a retry never meets old bytes."""

    def __init__(self, folder: str, shard_bytes: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.limit, self.out, self.size = shard_bytes, None, 0

    def put(self, media: bytes) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length) of a new member."""
        digest = hashlib.sha256(media).hexdigest()
        if self.out is None:
            self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
            self.out, self.size = self.files.open_output_stream(f"{self.root}/{self.name}"), 0
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.PAX_FORMAT)
        place = digest, self.name, self.size + len(head), len(media)
        block = head + media + bytes(-len(media) % 512)
        self.out.write(block)
        self.size += len(block)
        if self.size >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


PLACE = "key binary, digest string, shard string, offset long, length long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (the digest of the text) and text; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))


def _elsewhere(files: fs.FileSystem, root: str) -> set[bytes]:
    """The keys that another task stores."""
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return set()
    found = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
    return {k for f in found for k in pq.read_table(files.open_input_file(f), columns=["key"])["key"].to_pylist()}


def _store(texts: DataFrame, folder: str, shard_bytes: int, elsewhere: str | None) -> DataFrame:
    """Store each task's different texts (key, text), but those that ``elsewhere`` names for the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder, shard_bytes), set()
        if elsewhere:
            files, root = fs.FileSystem.from_uri(elsewhere)
            seen = _elsewhere(files, f"{root}/pid={TaskContext.get().partitionId()}")
        types = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    rows.append((key, *shards.put(encode(text.as_py().encode()))))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "digest", "shard", "offset", "length"])
        shards.close()

    return texts.mapInArrow(lean(run), PLACE)


def store_payloads(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, digest, shard, offset, length), a row for each different text of ``docs``, as a table in the shared folder.

    A first pass notes which texts several tasks have, and the first of these stores them. Should the second pass deal
    rows to tasks in another way (a table that isn't read from files), texts that no task stored are found by their keys
    and stored then; of a text that two stored one place counts. Shards of attempts that failed, and such second copies,
    stay in the folder without a row.
    """
    spark, texts = docs.sparkSession, keyed(docs).select("key", "text")
    parts = shuffle_partitions(spark)
    claims = texts.select("key", F.spark_partition_id().alias("pid")).distinct()
    others = claims.withColumn("first", F.min("pid").over(W.partitionBy("key"))).where("pid != first").select("key", "pid")
    elsewhere = new_path(spark, "elsewhere")
    others.repartition(parts, "pid").sortWithinPartitions("pid").write.partitionBy("pid").parquet(elsewhere)
    first = write_table(_store(texts, folder, shard_bytes, elsewhere), "places")
    missing = write_table(texts.select("key").distinct().join(first, "key", "left_anti"), "missing")
    places = first
    if not missing.isEmpty():
        rest = _store(texts.join(missing, "key", "left_semi").repartition(parts, "key"), folder, shard_bytes, None)
        places = first.unionByName(rest)
    places = write_table(places.groupBy("key").agg(F.min(F.struct("shard", "offset", "length", "digest")).alias("p")).select("key", "p.digest", "p.shard", "p.offset", "p.length"), "places")
    for used in (first, missing):
        drop_table(used)
    drop_path(spark, elsewhere)
    return places


def _ranged(rows: DataFrame, folder: str, schema: str, whole: bool, read) -> DataFrame:
    """``rows`` (sorted by shard and offset within tasks) with what ``read`` makes of the bytes at each place."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name, source, last, value = None, None, None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, files.open_input_file(f"{root}/{shard}")
                if (shard, offset) != last:
                    last, value = (shard, offset), read(source.read_at(length if whole else HEADER_BYTES, offset))
                out.append(value)
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]
            yield pa.record_batch([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*batch.schema.names, *names])
        if source is not None:
            source.close()

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(run), f"{before}, {schema}")


def read_headers(rows: DataFrame, folder: str) -> DataFrame:
    """Adds width, height, bit_depth and n_bytes; HEADER_BYTES bytes of each payload are read."""
    return _ranged(rows, folder, "width long, height long, bit_depth int, n_bytes long", False, lambda head: tuple(parse_header(head).values()))


def _whole(media: bytes) -> tuple:
    payload = decode(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)


def read_payloads(rows: DataFrame, folder: str) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature from the stored bytes."""
    return _ranged(rows, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", True, _whole)


#: Columns that go through joins as bytes.
HEX = ("digest", "payload_sha256", "feature")


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest, shard, offset, length, the metadata and the digests.

    A null or empty text is 64 bytes 0. Rows of equal texts get the same place and values. Null ids and repeated rows are
    stored like any other; a text of any length is one member; other columns are left aside; an empty table gives no rows.
    ``folder`` (a URI) defaults to a new one in the shared folder; it holds the payloads and stays.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    if "://" not in folder:
        folder = f"file://{folder}"
    places = store_payloads(docs, folder, shard_bytes)
    sorted_rows = places.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "offset")
    stored = read_payloads(read_headers(sorted_rows, folder), folder).drop("media_sha256").withColumns({c: F.unhex(c) for c in HEX})
    stored = write_table(stored, "stored")
    drop_table(places)
    rows = keyed(docs).select("doc_id", "key")
    # A text of more than a thousandth of all rows is looked up without moving its rows; there are fewer than 1000 such.
    heavy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, docs.count() / 1000)).select("key")
    heavy = write_table(heavy, "heavy")
    of_heavy = F.broadcast(stored.join(F.broadcast(heavy), "key", "left_semi"))
    out = rows.join(of_heavy, "key").unionByName(rows.join(F.broadcast(heavy), "key", "left_anti").join(stored, "key"))
    return out.drop("key").withColumns({c: F.lower(F.hex(c)) for c in HEX}).withColumn("media_sha256", F.col("digest"))
