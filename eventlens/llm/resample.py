"""Target-distribution importance resampling: weights from an array of gains, ranks by a radix sort."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.llm.common import settle

#: Bits of a digit of the sort, and of the number of places in a block. A block is counted and moved as one.
DIGIT, BLOCK = 11, 16
#: Words whose bucket a worker remembers; beyond, and for long words, it is computed each time.
REMEMBERED, LONG = 1_000_000, 64

#: A-Z in lower case; what is neither a letter, a digit nor beyond ASCII parts words.
_PARTED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Buckets(dict):
    """The bucket of each word met so far: its crc32 modulo ``n``."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word) % self.n
        if len(word) <= LONG and len(self) < REMEMBERED:
            self[word] = bucket
        return bucket

    def of(self, text: bytes | None, longest: int) -> tuple[int, np.ndarray]:
        """How many words a text has, and the bucket of each run of 1 to ``longest`` of them."""
        words = text.translate(_PARTED).split() if text else []
        found = list(map(self.__getitem__, words))
        for k in range(2, longest + 1):
            found += [zlib.crc32(b" ".join(words[i:i + k])) % self.n for i in range(len(words) - k + 1)]
        return len(words), np.array(found, np.int64)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``bucket`` and ``n``, the features of the column ``text`` in it. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(known.of(text.as_py(), longest)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: the log of how much likelier the target is to have it."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Gumbel noise of a document, in thousandths."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8]
    return math.floor(-1000 * math.log(-math.log((int(digits, 16) + 0.5) / 4294967296)))


def weighed(docs: DataFrame, of_bucket: np.ndarray, longest: int, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(of_bucket))
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("text")):
                n_words, features = known.of(text.as_py(), longest)
                weight = int(of_bucket[features].sum())
                rows.append((n_words, len(features), weight, weight + noise(doc_id, seed)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """Settled ``rows`` whose ``pos`` is that of a stable sort by ``digit``: behind all rows of smaller digits,
    those of the same digit in earlier blocks, and those in its own block before it.

    A block counts its digits; sums of the counts over digits, and for each digit over blocks, are where the rows of
    a block and a digit start. No task gets more than a block of rows of one digit, or one count of each block."""
    keyed = rows.select("*", F.shiftrightunsigned("pos", BLOCK).alias("block"), digit.alias("digit"))
    counts = keyed.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each digit, 2 ** DIGIT at most
    of_digit = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        F.broadcast(of_digit), "digit").select("block", "digit", (F.col("first") + F.col("before")).alias("start"))
    own = Window.partitionBy("block", "digit").orderBy("pos")
    placed = keyed.withColumn("place", F.row_number().over(own) - 1).join(starts, ["block", "digit"])
    return settle(placed.select(
        *[c for c in rows.columns if c != "pos"], (F.col("start") + F.col("place")).cast("long").alias("pos")))


def digits_of(key: Column, bits: int) -> list[Column]:
    """The digits of the low ``bits`` of a key, least first."""
    mask = F.lit((1 << DIGIT) - 1).cast("long")
    return [F.shiftrightunsigned(key, s).bitwiseAND(mask).cast("int") for s in range(0, bits, DIGIT)]


def radix_sorted(rows: DataFrame) -> DataFrame:
    """Settled ``rows`` with their place ``pos``, from 0, by falling ``score``, then by doc_id, null last.

    A radix sort from the least digit of the composite key (score, doc_id) on. Only bits in which keys
    differ make digits. Rows equal in both are next to each other in any order."""
    rows = settle(rows.withColumn("pos", F.monotonically_increasing_id()))
    seen = rows.agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls"),
        F.bit_and("doc_id").alias("all"), F.bit_or("doc_id").alias("any"),
    ).first()
    if seen["high"] is None:
        return rows
    passes = []
    if seen["all"] is not None:
        bits = ((seen["all"] ^ seen["any"]) & (2**64 - 1)).bit_length()
        # with the sign turned, ids are in order as unsigned numbers
        passes += digits_of(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(-(2**63))), bits)
    if seen["nulls"]:
        passes.append(F.col("doc_id").isNull().cast("int"))
    passes += digits_of(F.lit(seen["high"]) - F.col("score"), (seen["high"] - seen["low"]).bit_length())
    for digit in passes or [F.lit(0)]:
        rows = counting_pass(rows, digit)
    return rows


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least_words: int = 20,
    percent: int = 10, seed: str = "2024",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``.

    Features are runs of 1 to ``longest`` words, counted in ``buckets`` by their crc32, over all of ``docs`` and all
    ``text`` of ``target``. A bucket's gain goes by both counts, and a document weighs the gains of its features:
    one look-up in an array, which is as large as ``buckets`` says. Of the rows with ``least_words`` words, the
    ``percent`` of highest score (weight and Gumbel noise of the id) have a rank: they are a draw without
    replacement in proportion to exp(weight / 1000).

    Null and empty texts have no feature and weigh 0. A null doc_id has the noise of an empty text and comes behind
    all ids in ties; rows equal in score and id take the next ranks in any order. Other columns are not
    looked at. An empty table gives no row; with an empty target all weigh by their rarity alone."""
    counts = []
    for texts in (docs, target):
        total = np.zeros(buckets, np.int64)
        # one row for each bucket at most
        for row in bucket_counts(texts, buckets, longest).collect():
            total[row["bucket"]] = row["n"]
        counts.append(total)
    rows = settle(weighed(docs, gains(*counts), longest, seed))
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    ranked = radix_sorted(rows.where(enough))
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionAll(
        rows.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
