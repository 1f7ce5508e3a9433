"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of all ids that
have one, a bitmap that says which of them go on, and a directory of ranks in that bitmap. The id at
any place is read by walking down the levels, without decoding what stands before it.

File: magic, counts, document table (ids, null flags, starts), per level its size, chunks, bitmap and
ranks, then a checksum. All numbers are little-endian. One file holds documents in ascending order;
the files of a table follow each other in the order of their manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.common import new_folder, row_blocks, written
from grantlens.llm.tokens import default_path, encoded

MAGIC = b"DACIDS01"
CHUNK_BITS = 8
#: Bits of a bitmap that one entry of the rank directory covers.
RANK_BITS = 512
#: Ids after which a task begins another file; a document is never split.
FILE_IDS = 4_000_000


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of RANK_BITS bits, and at last all of them."""
    blocks = np.add.reduceat(bits, np.arange(0, len(bits), RANK_BITS), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(blocks, dtype=np.uint64)])


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """One file. `starts` has one entry more than `doc_ids`, the last one is the number of ids."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        goes_on = left >> CHUNK_BITS > 0
        bits = np.packbits(goes_on, bitorder="little")
        levels += [np.uint64(len(left)).tobytes(), (left & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), _ranks(goes_on).tobytes()]
        left = left[goes_on] >> CHUNK_BITS
        if not len(left):
            break
    head = np.array([len(ids), len(doc_ids), len(levels) // 4], np.uint64)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = b"".join([MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], np.int64).tobytes(), known.tobytes(), np.asarray(starts, np.uint64).tobytes(), *levels])
    return body + np.uint32(zlib.crc32(body)).tobytes()


class Codes:
    """A file's content. `ids(a, b)` gives any range of ids, `ids(i, i + 1)` one of them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a whole file of directly addressable codes")
        at = 8

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.size, self.docs, depth = map(int, take(np.uint64, 3))
        self.doc_ids, self.known, self.starts = take(np.int64, self.docs), take(np.uint8, self.docs), take(np.uint64, self.docs + 1)
        self.levels = []
        for _ in range(depth):
            n = int(take(np.uint64, 1)[0])
            self.levels.append((take(np.uint8, n), take(np.uint8, -(-n // 8)), take(np.uint64, -(-n // RANK_BITS) + 1)))

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        bits = np.unpackbits(self.levels[level][1][a // 8:-(-b // 8)], bitorder="little")
        return bits[a % 8:a % 8 + b - a]

    def rank(self, level: int, i: int) -> int:
        """Ones in a level's bitmap before place i."""
        block = i // RANK_BITS
        return int(self.levels[level][2][block]) + int(self._bits(level, block * RANK_BITS, i).sum())

    def ids(self, a: int, b: int, level: int = 0) -> np.ndarray:
        out = self.levels[level][0][a:b].astype(np.uint32)
        more = np.flatnonzero(self._bits(level, a, b))
        if len(more):
            at = self.rank(level, a)  # what goes on from a range stands side by side on the next level
            out[more] |= self.ids(at, at + len(more), level + 1) << np.uint32(CHUNK_BITS)
        return out


def save(folder: str, data: bytes) -> str:
    """Write a file of its own in a folder that driver and executors share; returns its name. Only names in a manifest are read."""
    system, path = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def load(folder: str, name: str) -> bytes:
    system, path = pa.fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}") as file:
        return file.read()


_MANIFEST = "part int, place int, file string, n_ids long"


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id (null first), and give the manifest of the files: part, place, file, n_ids, base.

    Texts are dealt by ranges of doc_id and encoded in their order. The manifest has a row per file and
    is itself written before it is used, so a task that runs twice leaves files that nothing names.
    """
    path = path or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def flush():
            nonlocal place
            data = to_bytes(np.concatenate(ids), names, np.cumsum([0, *sizes]))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "file": [save(folder, data)], "n_ids": [sum(sizes)]})
            place += 1
            ids.clear(), names.clear(), sizes.clear()
            return row

        held = 0
        for batch in batches:
            for a, b, flat, at in encoded(batch.column(1), path):
                ids.append(flat)
                names += batch.column(0).slice(a, b - a).to_pylist()
                sizes += np.diff(at).tolist()
                held += len(flat)
                if held >= FILE_IDS:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(rows.mapInArrow(write, _MANIFEST), "codes-manifest")
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = Codes(load(folder, name))
                starts = codes.starts.astype(np.int64)
                crcs = np.zeros(codes.docs, np.int64)
                for a, b in row_blocks(np.diff(starts)):
                    ids = codes.ids(int(starts[a]), int(starts[b])).astype("<u4")
                    at = (starts[a:b + 1] - starts[a]).tolist()
                    crcs[a:b] = [zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes.doc_ids, mask=codes.known == 0), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A file is a task's work: a few megabytes, whatever the number of documents.
    files = written(manifest.select("file", "base"), "codes-files")
    return files.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back.

    Null text is empty and has the end id alone; an empty table writes nothing and gives no rows;
    rows of one id stand side by side, in order of their texts.
    """
    folder = new_folder(docs.sparkSession, "codes")
    return read_ids(write_ids(docs, folder, path), folder)
