"""Token ids as files of length-delimited binary records with a separate offset index.

Data file (``part-NNNNN-*.rec``): a header of 8 bytes (``TIDS``, version 1, bytes per id, two zero bytes), then
records. A record is its payload length (unsigned 64 bit), the masked CRC-32 of these 8 bytes, the payload and
the masked CRC-32 of the payload; all numbers are little-endian. The payload is 1 byte (1: the id is null), the
signed 64-bit document id and the token ids. Index file (``.idx``): per record 25 bytes: null flag, document id,
byte offset of the record and number of ids, and at the end the masked CRC-32 of all that. ``_manifest.json``
names the committed files in order, with a mark every 16 MB from which a reader can start. Files of attempts that
failed are in no manifest. Ids take 2 bytes where the vocabulary allows, else 4.

The format is a Python data source of Spark: executors write straight to the shared path (any file system that
``pyarrow.fs`` opens), the driver writes the manifest when all tasks are done. With ``shuffle_seed`` a reader takes
the marked blocks in random order, and the records of a group of blocks in random order through the index.

Cases: a null text is empty and has the end id alone; an empty table gives a manifest without files and no rows;
null ids come first; rows with equal ids are ordered by a hash of their text and kept; other columns are not used. A
second write to a path comes after the first one. The data source takes ids as bytes of the width it writes.
"""

from __future__ import annotations

import json
import random
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage)

from codesieve.llm.lineage import slices
from codesieve.llm.tokens import encoder, release

MAGIC, VERSION = b"TIDS", 1
BLOCK_BYTES = 16 << 20
INDEX = np.dtype([("absent", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that checksums of data that hold checksums stay apart."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview | bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place after it; raises on a damaged record."""
    head = bytes(data[at:at + 8])
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged record length at byte {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12:end])
    if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, end + 4


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    blocks: list[list[int]]  # byte offset, first record, ids before, for each block; then the end


@dataclass
class Blocks(InputPartition):
    blocks: list[tuple]  # name, byte range, record range, ids before


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, id_bytes: int):
        self.path, self.id_bytes = path, id_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        partition = TaskContext.get().partitionId()
        name = f"part-{partition:05d}-{uuid.uuid4().hex}"
        at, records, ids_before = 8, 0, 0
        blocks, block_start, index_crc = [[8, 0, 0]], 8, 0
        with store.open_output_stream(f"{folder}/{name}.rec") as data, \
                store.open_output_stream(f"{folder}/{name}.idx") as index:
            data.write(MAGIC + bytes([VERSION, self.id_bytes, 0, 0]))
            for batch in iterator:
                entries = []
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if at - block_start >= BLOCK_BYTES:
                        blocks.append([at, records, ids_before])
                        block_start = at
                    n = len(ids) // self.id_bytes
                    record = frame(struct.pack("<Bq", doc is None, doc or 0) + ids)
                    data.write(record)
                    entries.append((doc is None, doc or 0, at, n))
                    at += len(record)
                    records += 1
                    ids_before += n
                rows = np.array(entries, INDEX).tobytes()
                index_crc = zlib.crc32(rows, index_crc)
                index.write(rows)
            index.write(struct.pack("<I", ((index_crc >> 15 | index_crc << 17) + 0xA282EAD8) & 0xFFFFFFFF))
        return Written(partition, name, [*blocks, [at, records, ids_before]])

    def commit(self, messages: list[Written]) -> None:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        files = [{"name": m.name, "blocks": m.blocks} for m in sorted(
            (m for m in messages if m and m.blocks[-1][1]), key=lambda m: m.partition)]
        path = f"{folder}/_manifest.json"
        if store.get_file_info(path).is_file:  # a later write comes after what is there
            with store.open_input_stream(path) as f:
                before = json.loads(f.read())
            if before["id_bytes"] != self.id_bytes:
                raise ValueError(f"{self.path} holds ids of {before['id_bytes']} bytes")
            files = before["files"] + files
        with store.open_output_stream(path) as out:
            out.write(json.dumps({"version": VERSION, "id_bytes": self.id_bytes, "files": files}).encode())

    def abort(self, messages: list) -> None:
        """Files of a failed write are in no manifest, so nothing reads them."""


class _Reader(DataSourceReader):
    def __init__(self, path: str, seed: int | None):
        self.path, self.seed = path, seed

    def partitions(self) -> list[Blocks]:
        store, folder = file_system(self.path)
        with store.open_input_stream(f"{folder}/_manifest.json") as f:
            manifest = json.loads(f.read())
        base, blocks = 0, []
        for file in manifest["files"]:
            for (low, first, ids), (high, last, _) in zip(file["blocks"], file["blocks"][1:]):
                blocks.append((file["name"], manifest["id_bytes"], low, high, first, last, base + ids))
            base += file["blocks"][-1][2]
        if self.seed is None:
            return [Blocks([b]) for b in blocks] or [Blocks([])]
        random.Random(self.seed).shuffle(blocks)
        return [Blocks(blocks[i:i + 4]) for i in range(0, len(blocks), 4)] or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        release()  # a worker that has encoded holds a large memo
        store, folder = file_system(self.path)
        rows: list[list] = [[], [], [], []]
        held = 0

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "start", "n_tokens", "ids"])
            for c in rows:
                c.clear()
            return batch

        for payload, start, width in (self._shuffled if self.seed is not None else self._ordered)(
                store, folder, partition):
            absent, doc = struct.unpack_from("<Bq", payload)
            ids = payload[9:] if width == 4 else np.frombuffer(payload, "<u2", offset=9).astype("<u4").tobytes()
            for column, value in zip(rows, (None if absent else doc, start, len(ids) // 4, ids)):
                column.append(value)
            held += len(ids) + 64
            if held > 4 << 20:
                held = 0
                yield flushed()
        if rows[0]:
            yield flushed()

    def _ordered(self, store, folder: str, partition: Blocks):
        for name, width, low, high, _, _, ids in partition.blocks:
            with store.open_input_file(f"{folder}/{name}.rec") as f:
                if f.read_at(6, 0) != MAGIC + bytes([VERSION, width]):
                    raise ValueError(f"{name} is no file of token records")
                data = memoryview(f.read_at(high - low, low))
            at = 0
            while at < len(data):
                payload, at = unframe(data, at)
                yield payload, ids, width
                ids += (len(payload) - 9) // width

    def _shuffled(self, store, folder: str, partition: Blocks):
        wanted = []
        for k, (name, width, low, high, first, last, ids) in enumerate(partition.blocks):
            with store.open_input_file(f"{folder}/{name}.idx") as f:
                rows = np.frombuffer(f.read_at((last - first) * INDEX.itemsize, first * INDEX.itemsize), INDEX)
            before = ids + np.concatenate(([0], np.cumsum(rows["n"])[:-1])) if len(rows) else []
            wanted += [(k, int(o), int(n), int(b)) for o, n, b in zip(rows["offset"], rows["n"], before)]
        random.Random(f"{self.seed}/{partition.blocks[:1]}").shuffle(wanted)
        files = {}
        for k, offset, n, ids in wanted:
            name, width = partition.blocks[k][:2]
            if name not in files:
                files[name] = store.open_input_file(f"{folder}/{name}.rec")
            payload, _ = unframe(files[name].read_at(25 + n * width, offset), 0)
            yield payload, ids, width


class TokenRecords(DataSource):
    """``spark.read.format("token_records").load(path)``; options: id_bytes (write), shuffle_seed (read)."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> _Reader:
        seed = self.options.get("shuffle_seed")
        return _Reader(self.options["path"], None if seed is None else int(seed))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("id_bytes", "4")))


def write_token_records(docs: DataFrame, path: str, tokenizer: str, spaces: str | None, end_id: int,
                        id_bytes: int = 4, id_column: str = "doc_id", text_column: str = "text", memo_bytes: int = 192 << 20) -> None:
    """Encode all texts, add the end id and write the records in ascending document id order."""

    if id_bytes not in (2, 4):
        raise ValueError("ids take 2 or 4 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer, spaces, memo_bytes), np.array([end_id], dtype="<u4").tobytes()
        for part in slices(batches, 256):
            ids = [narrowed(x + end, id_bytes) for x in coder.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    docs.sparkSession.dataSource.register(TokenRecords)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")) \
        .repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInArrow(run, "doc_id long, ids binary") \
        .write.format("token_records").option("id_bytes", str(id_bytes)).mode("append").save(path)


def narrowed(ids: bytes, id_bytes: int) -> bytes:
    """Unsigned 32-bit ids in ``id_bytes`` bytes each; ids that do not fit are an error."""
    if id_bytes == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"id {wide.max()} does not fit into 2 bytes")
    return wide.astype("<u2").tobytes()


def read_token_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records")
    return (reader if shuffle_seed is None else reader.option("shuffle_seed", str(shuffle_seed))).load(path)
