"""Token ids in files of shuffled planes.

A file holds the ids of documents in ascending doc_id order, cut into blocks of ``BLOCK`` ids
whatever the documents' bounds. A block is transposed into planes (bytes of the same
significance, or bits), and each plane is compressed with zstandard. Behind the blocks stand a
chunk index (place and size of every plane, ids per block) and the documents (doc_id, number
of ids); the last bytes say where these begin.

    "TPL1" | planes of block 0 | planes of block 1 | ... | index | place of index, "TPL1"

``write`` deals documents over files by ranges of doc_id, one file per task, and returns the
manifest, a row per file. A task writes under a name of its own attempt and renames it at the
end, so a repeated task replaces its file by the same one. ``read`` streams each file in a
task of its own and gives one row per document. Neither holds more than a block, and the
documents' numbers of one file.

Defined results: a null or empty text has the end id only. Rows without doc_id come first.
Rows that repeat a doc_id stand in the order of their texts. An empty table has no files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe_words import encoder
from tidemark.llm.common import ship, stored
from tidemark.sources.shared import scratch_path

BLOCK, LEVEL, MAGIC = 1 << 16, 3, b"TPL1"
MANIFEST = "file_no int, path string, n_docs long, n_tokens long, n_blocks long, n_bytes long"


def planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """One row per plane of unsigned 32-bit ids."""
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return np.packbits(np.unpackbits(columns, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(columns.T)


def unplanes(rows: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Writer:
    """Appends ids to one file; the index is written by ``close``."""

    def __init__(self, sink, bits: bool, block: int = BLOCK, level: int = LEVEL):
        self.sink, self.bits, self.block = sink, bits, block
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.place = len(MAGIC)
        self.blocks: list[dict] = []
        self.docs: list[tuple[int | None, int]] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= self.block or (rest and at < len(ids)):
            part = ids[at : at + self.block]
            packed = [self.packer.compress(p.tobytes()) for p in planes(part, self.bits)]
            self.blocks.append({"n": len(part), "at": self.place, "sizes": [len(p) for p in packed]})
            for p in packed:
                self.sink.write(p)
                self.place += len(p)
            at += len(part)
        self.waiting, self.held = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        names = np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes()
        known = np.array([d is not None for d, _ in self.docs], np.uint8).tobytes()
        counts = np.array([n for _, n in self.docs], "<i8").tobytes()
        head = json.dumps({"bits": self.bits, "blocks": self.blocks, "docs": len(self.docs)}).encode()
        packed = self.packer.compress(struct.pack("<q", len(head)) + head + names + known + counts)
        self.sink.write(packed)
        self.sink.write(struct.pack("<q", self.place) + MAGIC)
        self.place += len(packed) + 8 + len(MAGIC)


class Reader:
    """Reads the index of a file, and ids block by block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a file of planes")
        (place,) = struct.unpack("<q", tail[:8])
        source.seek(place)
        self.unpacker = zstandard.ZstdDecompressor()
        raw = self.unpacker.decompress(source.read(size - 8 - len(MAGIC) - place))
        (n,) = struct.unpack("<q", raw[:8])
        head = json.loads(raw[8 : 8 + n])
        self.bits, self.blocks, docs = head["bits"], head["blocks"], head["docs"]
        at = 8 + n
        self.names = np.frombuffer(raw, "<i8", docs, at)
        self.known = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)

    def block(self, i: int) -> np.ndarray:
        """The ids of block ``i``, wherever it stands."""
        b = self.blocks[i]
        self.source.seek(b["at"])
        raw = self.source.read(sum(b["sizes"]))
        at, rows = 0, []
        for size in b["sizes"]:
            rows.append(np.frombuffer(self.unpacker.decompress(raw[at : at + size]), np.uint8))
            at += size
        return unplanes(np.stack(rows), b["n"], self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, first place in the file, parts of its ids) in order."""
        block, used, ids, start = -1, 0, np.zeros(0, np.uint32), 0
        for name, known, count in zip(self.names.tolist(), self.known.tolist(), self.counts.tolist(), strict=True):
            parts, left = [], count
            while left:
                if used == len(ids):
                    block += 1
                    ids, used = self.block(block), 0
                part = ids[used : used + left]
                parts.append(part)
                used += len(part)
                left -= len(part)
            yield (name if known else None), start, parts
            start += count


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, bits: bool = False, block: int = BLOCK) -> DataFrame:
    """Encode every text, append ``end_id``, write the files; the manifest, stored."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId()
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        part, final = f"{base}/.{number}-{context.taskAttemptId()}", f"{base}/{number:06d}.tpl"
        writer, sink, own = None, None, encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                names = batch.column(0).slice(at, 2000).to_pylist()
                found = own.encode(batch.column(1).slice(at, 2000).to_pylist())
                if writer is None and names:
                    sink = where.open_output_stream(part)
                    writer = Writer(sink, bits, block)
                for name, ids in zip(names, found, strict=True):
                    writer.add(name, np.concatenate([np.frombuffer(ids, own.kind).astype(np.uint32), end]))
        if writer is None:
            return
        writer.close()
        sink.close()
        where.move(part, final)
        values = [[number], [f"{folder}/{number:06d}.tpl"], [len(writer.docs)], [writer.total], [len(writer.blocks)], [writer.place]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["file_no", "path", "n_docs", "n_tokens", "n_blocks", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return stored(dealt.mapInArrow(run, MANIFEST), "plane-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``start`` counts the ids of all documents before it; the sum over files before is over one
    small row per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, base = filesystem(path)
                with where.open_input_file(base) as source:
                    rows: list[tuple] = []
                    for name, start, parts in Reader(source).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.astype("<u4", copy=False).tobytes(), crc)
                        rows.append((name, before + start, sum(map(len, parts)), crc))
                        if len(rows) == 10_000:
                            yield packed(rows)
                            rows = []
                    if rows:
                        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    every = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file_no", "path", F.coalesce(F.sum("n_tokens").over(every), F.lit(0).cast("bigint")).alias("before"))
    files = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(files, "file_no").select("path", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, bits: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) to a new folder of the shared one and read it back."""
    return read(write(docs, tokenizer, end_id, scratch_path(docs.sparkSession, "planes"), bits))
