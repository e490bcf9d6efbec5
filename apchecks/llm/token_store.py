"""Token-id files of independent zstandard frames with a seek table at the end.

A shard file is, in order: one zstandard frame per document (its ids as little-endian unsigned 32-bit
integers), one skippable frame with the documents' ids (zstandard-compressed 64-bit integers, a null
id as the smallest), and the seek table of the public seekable format: for each frame its compressed
and decompressed size and the low 32 bits of the XXH64 of its content. Any zstandard reader
decompresses a shard whole; a reader that wants a few documents reads the tail and those frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from .tokens import GROUP_TEXTS, encoder

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Magic of the skippable frame with the document ids.
IDS_MAGIC = 0x184D2A50

_NULL_ID = -(2**63)
_ENTRY = np.dtype([("compressed", "<u4"), ("content", "<u4"), ("checksum", "<u4")])


class ShardWriter:
    """Writes one shard to a binary file object; frames are compressed as they come."""

    def __init__(self, sink, level: int = 3):
        self.sink = sink
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.compressor.compress(content)
        self.sink.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(_NULL_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        packed = self.compressor.compress(np.array(self.ids, dtype="<i8").tobytes())
        self.sink.write(struct.pack("<II", IDS_MAGIC, len(packed) + 4) + packed + struct.pack("<I", len(packed)))
        table = np.array(self.entries, dtype=_ENTRY).tobytes()
        footer = struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)


class ShardReader:
    """Reads documents of one shard by position; only the tail and the wanted frames are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - 9 - 12 * count
        source.seek(table_at - 8 - 4)
        (packed,) = struct.unpack("<I", source.read(4))
        skippable, length = struct.unpack("<II", source.read(8))
        if skippable != SKIPPABLE_MAGIC or length != 12 * count + 9:
            raise ValueError("the seek table's frame is damaged")
        self.entries = np.frombuffer(source.read(12 * count), dtype=_ENTRY)
        source.seek(table_at - 8 - 4 - packed)
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(packed)), dtype="<i8")
        self.doc_ids = [None if i == _NULL_ID else int(i) for i in ids]
        self.starts = np.concatenate(([0], np.cumsum(self.entries["compressed"].astype(np.int64))))
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def read(self, i: int) -> bytes:
        """The content of frame ``i``, held against its checksum."""
        self.source.seek(int(self.starts[i]))
        content = self.decompressor.decompress(self.source.read(int(self.entries["compressed"][i])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.entries["checksum"][i]):
            raise ValueError(f"frame {i} does not match its checksum")
        return content


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_shards(
    documents: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, level: int = 1
) -> DataFrame:
    """Encode ``documents`` (doc_id, text) and write them as shards in ascending doc_id order.

    The range partitions of doc_id are the shards, so their order is that of the ids (null first;
    repeated ids stay in one shard, ordered by text). A null text has the end id alone. A task writes
    under a name of its own attempt and renames at the end, so a lost executor's half file is never
    read. Returns the manifest (shard, path, n_docs, n_tokens); an empty table has no shards.
    """
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        shard = context.partitionId()
        name = f"{base}/shard-{shard:06d}.zst"
        draft = f"{base}/.draft-{shard:06d}-{context.taskAttemptId()}"
        enc = encoder(tokenizer_path)
        n_docs = n_tokens = 0
        sink = None
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP_TEXTS):
                part = batch.slice(lo, GROUP_TEXTS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if sink is None and texts:
                    sink = fs.open_output_stream(draft)
                    writer = ShardWriter(sink, level)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                    writer.add(doc_id, ids + end)
                    n_docs += 1
                    n_tokens += len(ids) // 4 + 1
        if sink is not None:
            writer.finish()
            sink.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.zst"], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            )

    manifest = ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema("shard long, path string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """All documents of the shards in a manifest: shard, position, doc_id, start, ids (binary).

    ``start`` counts the ids of all documents before; it comes from a running sum over the manifest,
    which has one row per shard.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "path", before.alias("start"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    reader = ShardReader(source)
                    start = row["start"]
                    for lo in range(0, len(reader), 256):
                        some = range(lo, min(lo + 256, len(reader)))
                        content = [reader.read(i) for i in some]
                        lengths = np.array([len(c) // 4 for c in content], dtype=np.int64)
                        starts = start + np.concatenate(([0], np.cumsum(lengths)[:-1]))
                        start += int(lengths.sum())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["shard"]] * len(content), pa.int64()),
                                pa.array(list(some), pa.int64()),
                                pa.array([reader.doc_ids[i] for i in some], pa.int64()),
                                pa.array(starts),
                                pa.array(content, pa.binary()),
                            ],
                            names=["shard", "position", "doc_id", "start", "ids"],
                        )

    parts = shards.repartition(max(1, manifest.count()), "shard")  # a task for each shard, as near as hashing deals them
    return parts.mapInArrow(run, "shard long, position long, doc_id long, start long, ids binary")


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """Only the requested documents: doc_id and ids; other frames are not decompressed."""
    wanted = set(doc_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    reader = ShardReader(source)
                    hit = [i for i, d in enumerate(reader.doc_ids) if d in wanted]
                    if hit:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([reader.doc_ids[i] for i in hit], pa.int64()), pa.array([reader.read(i) for i in hit], pa.binary())],
                            names=["doc_id", "ids"],
                        )

    return manifest.select("path").repartition(F.col("path")).mapInArrow(run, "doc_id long, ids binary")
