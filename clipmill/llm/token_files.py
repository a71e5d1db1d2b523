"""Token ids as files of independent zstandard frames with a trailing seek table.

A file holds, one after the other: a frame for each document (a document of more than 2^22 ids has several), every frame with
its own content checksum; a skippable frame with the documents' ids and first frames; and the seek table of the public
zstd seekable format (compressed size, size and checksum of each frame), so a reader fetches and unpacks only the frames of the
documents it wants, and any zstd tool unpacks the file.

Documents are range-partitioned and sorted by id, then encoded where they are written. Every attempt of a task writes files of
its own name, and the manifest is a Spark table of what the attempts that count have written: files of lost attempts are
never listed. The start of a document follows from the ids per part and file.

Null and empty texts hold the end id alone. Rows with equal ids follow each other by text; rows with a null id come first.
An empty table gives no files. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmill.llm.bpe import tokenizer
from clipmill.llm.byte_words import cut
from clipmill.llm.words import buffers, pieces, span_hashes
from clipmill.session import new_path, stored

FRAME_IDS, FILE_BYTES, CACHE_WORDS, READ_BYTES, PIECE = 1 << 22, 64 << 20, 1 << 20, 4 << 20, 2 << 20
# Fixed values of the public seekable format, and the index frame's own mark.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE, WITH_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
# Fixed value of the tokenizer file: its special token.
SPECIAL = b"<|endoftext|>"


class Encoder:
    """Ids of a batch of texts: words are cut at byte level, every distinct word of the batch is looked up once.

    Words are known by a 64-bit hash of their bytes, in arrays sorted by it; new ones come from the library. When there are too many,
    words that were not looked up since the last time are forgotten.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _keep(self, hashes, first, size, ids) -> None:
        self.hashes, self.first, self.size, self.ids, self.used = hashes, first, size, ids, np.zeros(len(hashes), bool)

    def _forget(self) -> None:
        stay = self.used if self.used.sum() <= CACHE_WORDS // 2 else np.zeros(len(self.used), bool)
        size, first = self.size[stay], self.first[stay]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(first - upto + size, size) + np.arange(size.sum())]
        self._keep(self.hashes[stay], upto - size, size, ids)

    def _places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the (sorted, distinct) words stand in the arrays; words not known yet are added."""
        at = np.searchsorted(self.hashes, hashes)
        has = at < len(self.hashes)
        has[has] = self.hashes[at[has]] == hashes[has]
        new = np.flatnonzero(~has)
        if len(new):
            text = data.tobytes()
            words = [text[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            size = np.array([len(x) for x in got], np.int64)
            ids = np.fromiter(chain.from_iterable(got), "<u4", int(size.sum()))
            place, used = at[new], self.used
            self._keep(np.insert(self.hashes, place, hashes[new]), np.insert(self.first, place, len(self.ids) + np.cumsum(size) - size), np.insert(self.size, place, size), np.concatenate([self.ids, ids]))
            self.used = np.insert(used, place, True)
            at = np.searchsorted(self.hashes, hashes)
        self.used[at] = True
        return at

    def batch(self, column) -> list[bytes]:
        """Ids of every text as little-endian bytes; a null text has none."""
        data, offsets = buffers(column)
        starts, odd = cut(data, offsets)
        text = data.tobytes()
        special = text.find(SPECIAL)
        while special >= 0:
            odd[np.searchsorted(offsets, special, "right") - 1] = True
            special = text.find(SPECIAL, special + 1)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes, where, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self._forget()
        at = self._places(hashes, data, starts[where], ends[where])[word]
        count = self.size[at]
        upto = np.concatenate([[0], np.cumsum(count)])
        every = self.ids[np.repeat(self.first[at] - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[np.searchsorted(starts, offsets)]).tolist()
        out = [every[a:b] for a, b in zip(cuts, cuts[1:])]
        for d in np.flatnonzero(odd).tolist():
            whole = text[offsets[d]:offsets[d + 1]].decode()
            out[d] = np.array(self.tok.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One memory per Python worker, whatever the number of its tasks."""
    return Encoder(path)


class FileWriter:
    """Writes one file; ``close`` gives its manifest row."""

    def __init__(self, folder: str, part: int, number: int):
        name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.zst"
        self.path = f"{folder}/{name}"
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        self.out = system.open_output_stream(f"{at}/{name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.seek, self.docs, self.bytes, self.ids = [], [], 0, 0

    def _put(self, frame: bytes, size: int, checksum: int) -> None:
        self.out.write(frame)
        self.seek.append((len(frame), size, checksum))
        self.bytes += len(frame)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(self.seek)))
        self.ids += len(ids) // 4
        for at in range(0, len(ids), 4 * FRAME_IDS):
            part = ids[at:at + 4 * FRAME_IDS]
            self._put(self.pack.compress(part), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)

    def close(self) -> tuple:
        index = b"".join(struct.pack("<Bqq", d is not None, d or 0, k) for d, k in self.docs)
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index, 0, 0)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), WITH_CHECKSUM, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        return self.path, len(self.docs), self.ids


class FileReader:
    """Reads documents of a file by their place in it."""

    def __init__(self, path: str):
        system, at = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3)
        self.sizes, self.checks = table[:-1, 0].astype(np.int64), table[:-1, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self.file.read_at(int(table[-1, 0]) - 8, int(self.starts[-1]) + 8)
        rows = np.frombuffer(index, [("has", "u1"), ("id", "<i8"), ("frame", "<i8")])
        self.doc_ids = [int(i) if h else None for h, i in zip(rows["has"], rows["id"])]
        self.frames = np.append(rows["frame"], len(self.sizes))
        self.unpack = zstandard.ZstdDecompressor()

    def read(self, wanted=None):
        """(doc_id, ids as bytes) of the documents at the places ``wanted`` (default all), in order; damage raises."""
        places = range(len(self.doc_ids)) if wanted is None else sorted(wanted)
        held, low, high = b"", 0, 0
        for k in places:
            first, last = int(self.frames[k]), int(self.frames[k + 1])
            a, b = int(self.starts[first]), int(self.starts[last])
            if a < low or b > high:
                more = READ_BYTES if wanted is None else 0
                low, high = a, min(max(b, a + more), int(self.starts[-1]))
                held = self.file.read_at(high - low, low)
            parts = []
            for f in range(first, last):
                x, y = int(self.starts[f]) - low, int(self.starts[f + 1]) - low
                data = self.unpack.decompress(held[x:y])
                if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.checks[f]):
                    raise ValueError(f"frame {f} is damaged")
                parts.append(data)
            yield self.doc_ids[k], b"".join(parts)


def write_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending id order; the manifest: part, number, path, docs, ids."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    end = struct.pack("<I", end_id)

    def run(batches):
        encode, part, number, writer, rows = encoder(path), TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for some in pieces(batch, "text", PIECE):
                for doc_id, ids in zip(some.column(0).to_pylist(), encode.batch(some.column(1))):
                    if writer is None:
                        writer = FileWriter(folder, part, number)
                    writer.add(doc_id, ids + end)
                    if writer.bytes >= FILE_BYTES:
                        rows.append((part, number, *writer.close()))
                        writer, number = None, number + 1
        if writer is not None:
            rows.append((part, number, *writer.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "path", "docs", "ids"), r)) for r in rows], schema=manifest)

    manifest = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(placed.mapInArrow(run, "part int, number int, path string, docs long, ids long"), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all files before."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    inner = F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids")
    return manifest.withColumn("inner", inner).join(before, "part").withColumn("start", F.col("before") + F.col("inner")).drop("inner", "before")


def read_back(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids if asked for)."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for doc_id, data in FileReader(path).read():
                    row = {"doc_id": doc_id, "start": start, "n_tokens": len(data) // 4, "ids_crc32": zlib.crc32(data)}
                    if with_ids:
                        row["ids"] = np.frombuffer(data, "<u4").astype(np.int64).tolist()
                        held += len(data)
                    rows.append(row)
                    start += row["n_tokens"]
                    if len(rows) == 10_000 or held > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    out = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    files = with_starts(manifest).select("path", "start")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(run, schema)  # a file a task: the rows are few, their files are not small


def read_documents(manifest: DataFrame, wanted: set[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: only their frames are fetched and unpacked."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = FileReader(path)
                places = [k for k, d in enumerate(reader.doc_ids) if d in wanted]
                for doc_id, data in reader.read(places):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "ids": np.frombuffer(data, "<u4").astype(np.int64).tolist()}], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<long>")
