"""Sum-of-squares online packing of token sequences into fixed windows.

Each task packs its own documents. Whole windows are cut from a document's front; the rest is an item
for the online rule: among the fill levels that have an open window with room, and level 0 for a new
one, the item goes where the sum of the squared counts of partially filled windows grows least. The
counts stand in an array indexed by level. What is still open when the task's documents end is cut
anew end to end, so that a task leaves at most one window that is not full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import CACHE_CUTS, GROUP_TEXTS, encoder, give_back

#: Rows of a batch that a task gives out: at most 2 MB of ids where a sequence has 2048, which Python and the JVM each hold.
BATCH_ROWS = 256
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Places items into windows of ``size`` by the sum-of-squares rule."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.windows = 0

    def new_window(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, length: int) -> tuple[int, int]:
        """The window and the offset there of an item of 1 to ``size`` ids."""
        top = self.size - length
        # Moving a window from level h to h + length changes the sum by 2 * (count[h + length] - count[h]) + 2.
        change = -2 * self.count[: top + 1] + 1
        change[:top] += 2 * self.count[length : self.size] + 1
        change[0] = 2 * self.count[length] + 1 if length < self.size else 0
        allowed = self.count[: top + 1] > 0
        allowed[0] = True
        change[~allowed] = np.iinfo(np.int64).max
        best = top - int(np.argmin(change[::-1]))  # ties: the fullest window
        if best == 0:
            window = self.new_window()
        else:
            window = self.open[best].pop()
            self.count[best] -= 1
        level = best + length
        if level < self.size:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1
        return window, best


def pack_documents(documents: Iterable[tuple[object, bytes]], size: int) -> Iterator[tuple]:
    """Pieces (document, start, ids, doc_tokens, window, offset) of documents given as 4-byte ids.

    Pieces of full windows are given out at once, so only open windows are held.
    """
    packer = LevelPacker(size)
    held: dict[int, list[tuple]] = {}
    fill: dict[int, int] = {}
    for doc, ids in documents:
        n = len(ids) // 4
        at = 0
        while n - at >= size:
            yield doc, at, ids[4 * at : 4 * (at + size)], n, packer.new_window(), 0
            at += size
        if at == n:
            continue
        window, offset = packer.place(n - at)
        held.setdefault(window, []).append((doc, at, ids[4 * at :], n))
        fill[window] = offset + n - at
        if fill[window] == size:
            offset = 0
            for doc_, start, piece, total in held.pop(window):
                yield doc_, start, piece, total, window, offset
                offset += len(piece) // 4
            del fill[window]
    # The windows still open: fullest first, cut end to end into the same windows.
    names = sorted(held)
    slot = used = 0
    for window in sorted(held, key=lambda w: (-fill[w], w)):
        for doc, start, piece, total in held[window]:
            while piece:
                take = min(size - used, len(piece) // 4)
                yield doc, start, piece[: 4 * take], total, names[slot], used
                start, piece, used = start + take, piece[4 * take :], used + take
                if used == size:
                    slot, used = slot + 1, 0


def pack(documents: DataFrame, tokenizer_path: str, end_id: int, size: int = 2048, cache_cuts: int = CACHE_CUTS) -> DataFrame:
    """Pack ``documents`` (doc_id, text) into sequences of at most ``size`` ids.

    Returns a row per piece: doc_id, start (its document's ids before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Every id lies in exactly one
    piece; a sequence's offsets have no gaps. A null text has the end id alone; null ids and repeated
    rows are packed like others; an empty table gives no rows; other columns are ignored. Tasks pack
    their own input, so a lost task is packed again to the same result from the same split. A worker remembers the ids
    of up to two times ``cache_cuts`` cuts of texts, which changes its memory and time, not the result.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        give_back()
        enc = encoder(tokenizer_path, cache_cuts)

        def documents_of_task() -> Iterator[tuple[object, bytes]]:
            for batch in batches:
                for lo in range(0, batch.num_rows, GROUP_TEXTS):
                    part = batch.slice(lo, GROUP_TEXTS)
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                        yield doc_id, ids + end

        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, window, offset = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(total, pa.int64()),
                    pa.array([first + w for w in window], pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for piece in pack_documents(documents_of_task(), size):
            out.append(piece)
            if len(out) == BATCH_ROWS:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return docs.mapInArrow(run, _SCHEMA)
