"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import with_fields

#: Hash of an n-gram or word of bytes: a polynomial in this odd number, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are hashed in runs of this many bytes or up to twice as many, cut at white space; a word that has more bytes than
#: this may be cut too, and counts as several.
RUN = 1 << 20

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS


def _mixed(x: np.ndarray, buckets: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32)


def _runs(data: bytes) -> Iterator[bytes]:
    start = 0
    while len(data) - start > 2 * RUN:
        first, last = start + RUN, start + 2 * RUN
        spaces = [data.find(c, first, last) for c in (b" ", b"\n", b"\t")]
        cut = min((s for s in spaces if s >= 0), default=last)
        yield data[start:cut]
        start = cut
    yield data[start:]


def buckets_by_run(text: str | bytes | None, buckets: int) -> Iterator[np.ndarray]:
    """The bucket of each word, of each 3 and 4 bytes within a word and the space at its ends, and of two
    marks of each word: whether it repeats the word one or two before, and the length class (power of
    two of the words) of its text. In any order, repeats counted, a run of the text at a time. Null and empty texts
    have none."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    n = 0
    for run in _runs(data):
        words, found = _run_buckets(run, buckets)
        n += words
        yield found
    size = _mixed(np.array([n.bit_length() * 1024 + 9], np.uint64) * BASE, buckets)
    for done in range(0, n, RUN):
        yield np.repeat(size, min(RUN, n - done))


def buckets_of(text: str | bytes | None, buckets: int) -> np.ndarray:
    """All of ``buckets_by_run`` at once."""
    return np.concatenate([np.empty(0, np.int32), *buckets_by_run(text, buckets)])


def shares_of(text: str | bytes | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and the share of each in all of them."""
    counts = np.zeros(buckets, np.int64)
    for found in buckets_by_run(text, buckets):
        distinct, times = np.unique(found, return_counts=True)
        counts[distinct] += times
    distinct = np.flatnonzero(counts)
    return distinct.astype(np.int32), (counts[distinct] / max(counts.sum(), 1)).astype(np.float32)


def _run_buckets(data: bytes, buckets: int) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0, np.empty(0, np.int32)
    values = np.where(space, np.uint8(32), raw).astype(np.uint64)
    powers, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * powers[:len(raw)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * inverse[starts]
    parts = [_mixed(words * BASE + np.uint64(1), buckets)]
    same = np.zeros(len(words), np.uint64)
    same[1:] += words[1:] == words[:-1]
    same[2:] += (words[2:] == words[:-2]) * np.uint64(2)
    parts.append(_mixed((same + np.uint64(5)) * BASE, buckets))
    inner = ~space
    for n in (3, 4):
        if len(raw) < n:
            continue
        gram = np.zeros(len(raw) - n + 1, np.uint64)
        within = np.ones(len(raw) - n + 1, bool)
        for k in range(n):
            gram = gram * BASE + values[k:len(raw) - n + 1 + k] + np.uint64(1)
            if 0 < k < n - 1:
                within &= inner[k:len(raw) - n + 1 + k]
        parts.append(_mixed(gram[within] * BASE + np.uint64(n), buckets))
    return len(words), np.concatenate(parts)


def train(
    data: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, width: int = 16, epochs: int = 8, rate: float = 0.5,
    seed: int = 1,
) -> tuple[np.ndarray, float]:
    """Embeddings and softmax weights by stochastic gradient descent on one document at a time: its distinct
    buckets, their shares and its label.

    Before the softmax everything is linear: a document's log-odds are the mean, over its buckets, of
    (embedding times difference of the two output vectors). That one number for each bucket, and the
    difference of the output biases, is all that scoring needs, and is what is returned."""
    random = np.random.default_rng(seed)
    vectors = ((random.random((buckets, width)) - 0.5) / width).astype(np.float32)
    output = (random.random((2, width)) - 0.5).astype(np.float32) / width
    bias = np.zeros(2, np.float32)
    steps, done = max(epochs * len(data), 1), 0
    for _ in range(epochs):
        for k in random.permutation(len(data)):
            distinct, share, label = data[k]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            own = vectors[distinct]
            hidden = share @ own
            odds = output @ hidden + bias
            odds = np.exp(odds - odds.max())
            error = (odds / odds.sum()).astype(np.float32)
            error[label] -= 1
            gradient = error @ output
            # the mean's gradient is shared by all buckets; scaled up by the number of words of a usual
            # document, or single words would hardly move
            vectors[distinct] = own - (step * 30 * share)[:, None] * gradient
            output -= step * np.outer(error, hidden)
            bias -= step * np.float32(0.1) * error
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def sample(labels: DataFrame, learn: Column, most: int) -> DataFrame:
    """``most`` labelled ids at the most, the same ones whatever the order of the table."""
    usable = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)


def examples(docs: DataFrame, labels: DataFrame, learn: Column, most: int) -> DataFrame:
    """text and quality, one row for each sampled label: of several texts with a sampled id the one of the least
    hash, null last. Texts are reduced before the shuffle, so an id that very many rows have is no load."""
    chosen = sample(labels, learn, most).withColumnRenamed("doc_id", "_id")
    wanted = F.broadcast(chosen.select("_id").distinct())
    texts = (
        docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").groupBy("doc_id")
        .agg(F.min(F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("_least"))
        .select("doc_id", "_least.text")
    )
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "quality")


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, most: int = 6000, buckets: int = 1 << 17,
) -> tuple[np.ndarray, float]:
    """Learns from ``most`` labelled documents, which is the bound of the one task that trains; one whole text
    of each. ``learn`` says which rows of ``labels`` may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("quality").to_pylist()):
                rows.append((*shares_of(text.as_py(), buckets), int(label)))
        logits, bias = train(rows, buckets) if rows else (np.zeros(buckets), 0.0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([logits.astype("<f4").tobytes()]), pa.array([bias])], ["logits", "bias"]
        )

    rows = examples(docs, labels, learn, most).repartition(1).sortWithinPartitions(F.xxhash64("text"), "quality")
    model = rows.mapInArrow(run, "logits binary, bias double").first()
    if model is None:
        return np.zeros(buckets, np.float32), 0.0
    return np.frombuffer(model["logits"], "<f4"), model["bias"]


def scored(
    docs: DataFrame, model: tuple[np.ndarray, float], *keep: str, threshold: float = 0.3,
) -> DataFrame:
    """``keep``, score (0 to 1, the softmax output of label 1) and predicted for every row, from ``text``
    alone. Null and empty texts have the score of the biases; repeated rows score equally; an empty table gives no
    row; columns of ``docs`` other than these may have any names. A long text is scored a run at a time."""
    schema = with_fields(docs, keep, "score double, predicted int")
    logits, bias = model[0].astype(np.float64), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = []
            for text in batch.column("text"):
                total, n = 0.0, 0
                for found in buckets_by_run(text.as_py(), len(logits)):
                    total, n = total + logits[found].sum(), n + len(found)
                odds.append(bias + total / max(n, 1))
            scores = 1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32))], [*keep, "score", "predicted"],
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)


def quality_of(docs: DataFrame, labels: DataFrame, most: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from labels not held out. A null doc_id is
    not held out, and no label belongs to it. Without labels to learn from all scores are 0.5; an empty table
    gives no row; columns other than doc_id, text and quality are not looked at."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs, labels, ~held_out, most)
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out)
    return scored(rows, model, "doc_id", "held_out")
