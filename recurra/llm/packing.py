"""Sum-of-squares online packing of documents into fixed windows.

A document longer than a window fills windows of its own; what is over is
placed online into the fill level that makes the sum of the squared numbers of
partially filled windows per level smallest.  The state is one array of counts
by level and the open windows themselves.  Each input partition packs its own
stream, so nothing is shuffled; when a partition ends, its few open windows are
topped up by cutting the least filled ones, which leaves at most one short.

Edge cases: null or empty text is the end id alone; repeated rows are packed
as often as they occur; an empty table gives no pieces; ids may be null; strings
of the tokenizer's added tokens have their ids; texts are encoded whole, however
long, one at a time; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table
from .textarrays import release


class Packer:
    """Places pieces of at most `window` ids; yields windows as they fill."""

    def __init__(self, window: int, first_id: int):
        self.window = window
        self.next_id = first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level -> windows; a window is a list of pieces

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def level_for(self, size: int) -> int:
        """The level whose choice adds least to the sum of squared counts; the fullest of equals."""
        levels = np.flatnonzero(self.counts[1 : self.window - size + 1]) + 1
        after = np.where(levels + size < self.window, 2 * self.counts[levels + size] + 1, 0)
        change = after - (2 * self.counts[levels] - 1)
        fresh = 2 * self.counts[size] + 1
        if len(levels) == 0:
            return 0
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= fresh else 0

    def place(self, piece: tuple) -> list | None:
        """piece: (document, start, ids); returns the pieces of a window that is now full."""
        size = len(piece[2])
        if size == self.window:
            return [piece]
        level = self.level_for(size)
        held = [] if level == 0 else self.open[level].pop()
        if level:
            self.counts[level] -= 1
        held.append(piece)
        if level + size == self.window:
            return held
        self.open.setdefault(level + size, []).append(held)
        self.counts[level + size] += 1
        return None

    def drain(self) -> Iterator[list]:
        """The open windows, the fullest topped up from the least filled."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        pieces: list[tuple] = []
        while left:
            held = left.pop(0)
            room = self.window - sum(len(p[2]) for p in held)
            while room and (pieces or left):
                if not pieces:
                    pieces = left.pop()
                doc, start, ids = pieces.pop()
                held.append((doc, start, ids[:room]))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            yield held
        while pieces:
            yield [pieces.pop()]


PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def pack_documents(
    docs: DataFrame, window: int = 1024, tokenizer: str | None = None, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    A document is the ids of its text and then id 0.  With keep_ids the ids
    themselves are returned too, else null.
    """
    if window < 1:
        raise ValueError("a window holds at least one id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def emit(held: list) -> None:
            number, offset = packer.new_id(), 0
            for (doc, tokens), start, ids in held:
                crc = zlib.crc32(ids.tobytes())
                rows.append((doc, start, len(ids), crc, tokens, number, offset, ids if keep_ids else None))
                offset += len(ids)

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                few = batch.slice(i, 64)
                for doc, words in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    ids = np.array([*encode(words or ""), 0], "<u4")
                    for start in range(0, len(ids), window):
                        full = packer.place(((doc, len(ids)), start, ids[start : start + window].copy()))
                        if full:
                            emit(full)
                if len(rows) >= 2048:
                    yield piece_batch(rows)
                    rows.clear()
            release()
        for held in packer.drain():
            emit(held)
        if rows:
            yield piece_batch(rows)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECE)


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, [*names, "ids"])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
