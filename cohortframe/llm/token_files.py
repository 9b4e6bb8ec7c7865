"""Token ids in binary shard files whose blocks are stored as compressed byte or bit planes.

A shard file holds, one after the other:

* blocks of ``BLOCK`` ids (the last may be shorter). The ids of a block are written as ``width`` bytes,
  little-endian, then transposed: all first bytes, all second bytes and so on (``planes="bytes"``), or
  all lowest bits, all second bits and so on (``planes="bits"``). Each plane is a zstandard frame.
* the document table: ids and token counts as int64 arrays, one zstandard frame
* the chunk index: for each block the number of ids and, for each plane, place and size; JSON
* the trailer: places and sizes of the table and the index, and the magic bytes

so one block, or one document, can be read without the others. A shard holds a range of doc_id, shards
follow each other in that order, and a document's first id has a place in the whole corpus.

Null and empty texts give the end id alone. Rows with equal doc_id stay separate, in the order of their
texts; null ids come first. An empty table gives no shard and no rows. Files are written under a
temporary name and renamed, so a repeated task leaves the same files.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .buffers import byte_slices
from .shared import file_system, shared_folder
from .tokens import SLICE, PieceEncoder

BLOCK = 65_536
MAGIC = b"IDPLANE1"
_TRAILER = "<QQQQ8s"


def to_planes(ids: np.ndarray, width: int, planes: str) -> list[bytes]:
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if planes == "bytes":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(width)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(raw: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    rows = np.zeros((n, 4), np.uint8)
    if planes == "bytes":
        for k, plane in enumerate(raw):
            rows[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in raw], 1)
        rows[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4").astype(np.uint32)


class ShardWriter:
    def __init__(self, sink, planes: str = "bytes", level: int = 3):
        import zstandard

        self.sink, self.planes = sink, planes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.blocks: list[dict] = []
        self.doc_ids: list = []
        self.counts: list[int] = []

    def _put(self, raw: bytes) -> tuple[int, int]:
        place = (self.at, len(raw))
        self.sink.write(raw)
        self.at += len(raw)
        return place

    def _block(self, ids: np.ndarray) -> None:
        width = max(1, (int(ids.max()).bit_length() + 7) // 8)
        frames = [self._put(self.pack(p)) for p in to_planes(ids, width, self.planes)]
        self.blocks.append({"n": len(ids), "width": width, "planes": frames})

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.counts += counts.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            run = np.concatenate(self.waiting)
            whole = len(run) - len(run) % BLOCK
            for k in range(0, whole, BLOCK):
                self._block(run[k : k + BLOCK])
            self.waiting, self.n_waiting = [run[whole:]], len(run) - whole

    def close(self) -> int:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        null = np.array([d is None for d in self.doc_ids], np.int64)
        known = np.array([0 if d is None else d for d in self.doc_ids], np.int64)
        table = self._put(self.pack(np.concatenate([known, null, np.array(self.counts, np.int64)]).tobytes()))
        index = self._put(json.dumps({"planes": self.planes, "block": BLOCK, "blocks": self.blocks}).encode())
        self._put(struct.pack(_TRAILER, *table, *index, MAGIC))
        return self.at


class ShardReader:
    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        table_at, table_size, index_at, index_size, magic = struct.unpack(
            _TRAILER, self._get(size - struct.calcsize(_TRAILER), struct.calcsize(_TRAILER))
        )
        if magic != MAGIC:
            raise ValueError("not a plane file")
        self.index = json.loads(self._get(index_at, index_size))
        table = np.frombuffer(self.unpack.decompress(self._get(table_at, table_size)), np.int64).reshape(3, -1)
        self.doc_ids = [None if n else d for d, n in zip(table[0].tolist(), table[1].tolist())]
        self.counts = table[2]

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def block(self, k: int) -> np.ndarray:
        b = self.index["blocks"][k]
        raw = [self.unpack.decompress(self._get(*place)) for place in b["planes"]]
        return from_planes(raw, b["n"], b["width"], self.index["planes"])

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number in the shard, ids) one after the other, with a block or a document in memory."""
        k, run = 0, np.zeros(0, np.uint32)
        for i, n in enumerate(self.counts.tolist()):
            parts, have = [run], len(run)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            run = np.concatenate(parts) if len(parts) > 1 else run
            yield i, run[:n]
            run = run[n:]


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, planes: str = "bytes") -> DataFrame:
    """Encode, write one shard for each range of doc_id, and return the shards: shard, path, n_docs, n_ids, bytes.

    Lazy like any plan: the files exist once the result has been computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        store, base = file_system(folder)
        final = f"{base}/shard-{shard:08d}.idp"
        trial = f"{final}.{context.taskAttemptId()}"
        writer = sink = None
        n_ids = 0
        encoder = None
        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(1), SLICE):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(trial)
                    writer = ShardWriter(sink, planes)
                    encoder = PieceEncoder(vocabulary)
                n = len(offsets) - 1
                ids, row, _, _, sizes = encoder.encode(data, offsets)
                counts = (np.bincount(row, sizes, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)) + 1
                ends = np.cumsum(counts)
                out = np.full(int(ends[-1]), end_id, np.uint32)
                hold = np.ones(len(out), bool)
                hold[ends - 1] = False
                out[hold] = ids
                writer.add(batch.column(0).slice(first, n).to_pylist(), counts, out)
                n_ids += len(out)
        if writer is not None:
            size = writer.close()
            sink.close()
            store.move(trial, final)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [f"{folder}/shard-{shard:08d}.idp"], "n_docs": [len(writer.counts)],
                 "n_ids": [n_ids], "bytes": [size]}
            )

    placed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return placed.mapInArrow(run, "shard long, path string, n_docs long, n_ids long, bytes long")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens and the crc32 of its ids.

    ``shards`` has path and first_id, the number of ids in all earlier shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, local = file_system(path)
                with store.open_input_file(local) as source:
                    reader = ShardReader(source)
                    crc = np.zeros(len(reader.counts), np.int64)
                    for i, ids in reader.documents():
                        crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                    begin = start + np.cumsum(reader.counts) - reader.counts
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, pa.int64()), pa.array(begin), pa.array(reader.counts), pa.array(crc)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.select("path", "first_id").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 1, planes: str = "bytes", folder: str | None = None) -> DataFrame:
    """Write the shards now, then describe every document from the files.

    The driver sees one short row per shard, to add up where each begins.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    shards = sorted((r.shard, r.path, r.n_ids) for r in write_shards(docs, vocabulary, folder, end_id, planes).collect())
    rows, before = [], 0
    for _, path, n in shards:
        rows.append((path, before))
        before += n
    listed = spark.createDataFrame(rows, "path string, first_id long")
    return read_shards(listed.repartition(max(len(rows), 1), "path") if rows else listed)
