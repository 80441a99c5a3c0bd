"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import settle
from eventlens.llm.tokens import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Online best-fit with at most ``most`` open bins of ``capacity``.

    Bit f of ``free`` is set while an open bin has f places left. An item goes to the bin with the
    least places that still hold it; without one a new bin opens, and if that makes too many, the
    fullest closes. A full bin closes at once."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.free, self.bins, self.open = 0, [[] for _ in range(capacity + 1)], 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin of the next item, and its place there."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            free, number, self.next = self.capacity, self.next, self.next + 1
        if free > length:
            self.bins[free - length].append(number)
            self.free |= 1 << (free - length)
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return number

    def left(self) -> set[int]:
        return {number for same in self.bins for number in same}


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, open_bins: int = 256, end_id: int = 1,
    block: int = 8192,
) -> DataFrame:
    """Packs the tokens of all documents, each with ``end_id`` behind, into sequences of ``capacity``.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents
    longer than ``capacity`` are cut. Null and empty texts are the end token alone; null and repeated
    ids are kept as they are; an empty table gives no row.

    Every task packs the rows it reads, so texts are never shuffled. The bins that are still open at
    its end go as a whole, fullest first, into a second round of blocks of some ``block`` bins,
    so partly filled sequences are as many as that round's open bins.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bins = OpenBins(capacity, open_bins, (task.partitionId() if task else 0) << 32)
        encode, end = word_ids(vocabulary), end_id.to_bytes(4, "little")
        waiting: list[tuple] = []
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + end
                for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo:lo + 4 * capacity]
                    rows.append((piece, lo // 4, len(part) // 4, zlib.crc32(part), *bins.put(len(part) // 4)))
                    at.append(i)
            if rows:
                waiting.append((batch.column("doc_id").take(pa.array(at, pa.int32())), rows))
        still = bins.left()  # known only now: the rows kept so far are some numbers for each document
        for ids, rows in waiting:
            columns = list(zip(*rows))
            types = [pa.int32(), *[pa.int64()] * 5]
            arrays = [ids, *[pa.array(c, t) for c, t in zip(columns, types)]]
            arrays.append(pa.array([number in still for number in columns[4]]))
            yield pa.RecordBatch.from_arrays(
                arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "is_open"]
            )

    first = settle(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, PIECES + ", is_open boolean")
    )
    rest = first.where("is_open").groupBy("sequence_id").agg(F.sum("length").alias("used"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bins = OpenBins(capacity, block, 0)
        base = -1 - ((task.partitionId() if task else 0) << 32)
        for batch in batches:
            put = [bins.put(used) for used in batch.column("used").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array([base - number for number, _ in put], pa.int64()),
                 pa.array([place for _, place in put], pa.int64())], ["old", "new", "shift"],
            )

    tasks = max(1, round(rest.count() / block))
    moved = settle(
        rest.repartition(tasks, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("used"), "sequence_id")
        .mapInArrow(merged, "old long, new long, shift long")
    )
    again = first.where("is_open").join(moved, F.col("sequence_id") == F.col("old")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("new").alias("sequence_id"),
        (F.col("offset") + F.col("shift")).alias("offset"),
    )
    return first.where("not is_open").drop("is_open").unionAll(again)
