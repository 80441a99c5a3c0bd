"""Near-duplicates: MinHash signatures joined within a Hamming distance by a multi-index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from eventlens.llm.clusters import Forest, Sets, links_in_clusters
from eventlens.llm.common import WORD, components, settle, small, with_fields

#: Words in a shingle.
WIDTH = 5
#: Signatures have ``CHUNKS`` chunks of ``CHUNK`` values of 16 bits.
CHUNKS, CHUNK = 16, 4
SIZE = CHUNKS * CHUNK

_RANDOM = np.random.Generator(np.random.PCG64(20_011))
FACTORS = _RANDOM.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, SIZE, dtype=np.uint64)
PLACES = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance(percent: int) -> int:
    """Pairs whose signatures differ in up to so many values are confirmed on their sets: two documents of the
    similarity asked for differ in more with a chance of less than 2 in 10 million."""
    same, beyond = percent / 100, 1.0
    for most in range(SIZE + 1):
        beyond -= math.comb(SIZE, most) * (1 - same) ** most * same ** (SIZE - most)
        if beyond < 2e-7:
            return most
    return SIZE


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; a bytes' own lower() and split() touch ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WIDTH))))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each distinct shingle of a text of ``WIDTH`` words or more."""
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        total += hashes[k:k + n] * PLACES[k]
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the minimum under each of ``SIZE`` random permutations."""
    least = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo:lo + 4096]
        least = np.minimum(least, mixed(part[None, :] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1))
    return (least & np.uint64(0xFFFF)).astype("<u2")


def signed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep``, digest of the words in order (null without words), n_shingles and signature (null for
    texts shorter than a shingle) of every row."""

    names = ["doc_id", *keep]
    rows_of = docs.select(F.col("doc_id").cast("long"), *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                if not words:
                    rows.append((None, 0, None))
                    continue
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                if len(words) < WIDTH:
                    rows.append((digest, 1, None))
                    continue
                hashes = shingle_hashes(words)
                rows.append((digest, len(hashes), signature(hashes).tobytes()))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(columns[0], pa.binary()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                [*names, "digest", "n_shingles", "signature"],
            )

    return rows_of.mapInArrow(run, with_fields(rows_of, names, "digest binary, n_shingles long, signature binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SIZE)


def chunk_keys(signatures: np.ndarray, chunk: int) -> np.ndarray:
    """Keys of one chunk with each one of its values left out: two chunks that differ in one value
    at most have a key in common. Rows by ``CHUNK`` keys."""
    values = signatures[:, chunk * CHUNK:(chunk + 1) * CHUNK].astype(np.uint64)
    keys = np.empty(values.shape, np.uint64)
    for left_out in range(CHUNK):
        packed = np.zeros(len(values), np.uint64)
        for k in range(CHUNK):
            if k != left_out:
                packed = packed << np.uint64(16) | values[:, k]
        keys[:, left_out] = mixed(mixed(packed) + np.uint64(chunk * CHUNK + left_out))
    return keys


def keyed(classes: DataFrame) -> DataFrame:
    """uid and key for every key of every signature.

    The pigeonhole: if two signatures differ in fewer than 2 * CHUNKS values, some chunk differs in one at
    most, and they have a key in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures, uids = _matrix(batch.column("signature")), batch.column("uid").to_numpy()
            for chunk in range(CHUNKS):
                keys = chunk_keys(signatures, chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(uids, CHUNK)), pa.array(keys.ravel().view(np.int64))], ["uid", "key"]
                )

    return classes.select("uid", "signature").mapInArrow(run, "uid long, key long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid, n and sorted shingle hashes of each text in ``wanted`` (uid, _digest; settled). Texts are read anew, and
    one for each task and text in ``wanted`` is shuffled."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes for each text of the task's split
        for batch in batches:
            digests, found = [], []
            for text in batch.column("text"):
                form = b" ".join(words_of(text.as_py()))
                digest = xxhash.xxh3_128_digest(form)
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    found.append(form)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(found, pa.binary())], ["digest", "form"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(x.as_py().split()) for x in batch.column("form")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([x.tobytes() for x in found], pa.binary())], ["uid", "n", "tokens"])

    texts = (
        docs.select("text").where("text is not null").mapInArrow(forms, "digest binary, form binary")
        .join(small(wanted, 200_000), F.col("digest") == F.col("_digest"))
        .groupBy("uid").agg(F.first("form").alias("form"))
    )
    return texts.mapInArrow(sets, "uid long, n long, tokens binary")


def decide(percent: int) -> Callable[[pa.Table, np.ndarray, np.ndarray], list[tuple[int, int]]]:
    """Joins the rows of a part that link: those with a key in common whose signatures are near, by their whole sets.

    Each row first meets the first row of each of its keys, which joins most of what links. Keys all of whose rows
    are joined by then are done; of the others, each row that is not joined to the key's largest group meets
    all rows that it is not joined to."""
    most = distance(percent)

    def run(table: pa.Table, roots: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
        k = len(table)
        signatures = _matrix(table["signature"])
        sets = Sets(table["tokens"], table["n"].to_numpy(), percent)
        forest = Forest(k, roots)

        def meet(i: int, others: np.ndarray) -> None:
            others = others[forest.roots(others) != forest.root(i)]
            if side[i]:
                others = others[side[others] == 0]
            others = others[(signatures[others] != signatures[i]).sum(axis=1) <= most]
            for some in sets.batches(others):
                some = some[forest.roots(some) != forest.root(i)]
                for j in some[sets.similar(i, some)]:
                    forest.join(i, int(j))

        # the rows of each key that two have, those of side 0 first
        of_row = np.concatenate([chunk_keys(signatures, c) for c in range(CHUNKS)], axis=1)
        _, key = np.unique(of_row, return_inverse=True)
        key, row = key.ravel(), np.repeat(np.arange(k), SIZE)
        shared = np.bincount(key)[key] > 1
        key, row = key[shared], row[shared]
        order = np.lexsort((row, side[row], key))
        key, row = key[order], row[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        bounds = np.append(new, len(key))
        at = np.repeat(np.arange(len(new)), np.diff(bounds))  # the key of each entry, from 0
        firsts = np.unique(row * k + row[new[at]]) if len(key) else np.empty(0, np.int64)
        asker, first = firsts // max(k, 1), firsts % max(k, 1)
        cuts = np.searchsorted(asker, np.arange(k + 1))
        for i in range(k):
            if cuts[i] < cuts[i + 1]:
                meet(i, first[cuts[i]:cuts[i + 1]])
        # what is still apart
        root = forest.roots(np.arange(k))[row]
        group, size = np.unique(at * k + root, return_counts=True)
        order = np.lexsort((size, group // max(k, 1)))
        main = np.empty(len(new), np.int64)
        main[(group // max(k, 1))[order]] = (group % max(k, 1))[order]  # the last, the largest, stays
        asks = root != main[at]
        asker, of_key = row[asks], at[asks]
        order = np.argsort(asker, kind="stable")
        asker, of_key = asker[order], of_key[order]
        level = np.add.reduceat(side[row] == 0, new, dtype=np.int64) if len(new) else new
        cuts = np.searchsorted(asker, np.arange(k + 1))
        for i in np.unique(asker):
            ends = bounds[:-1] + level if side[i] else bounds[1:]
            lists = [row[bounds[t]:ends[t]] for t in of_key[cuts[i]:cuts[i + 1]]]
            meet(int(i), np.unique(np.concatenate(lists)))
        return forest.links

    return run


def linked(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The smallest uid reachable from each uid that has a link: ``id``, ``root``.

    Signatures that have a key in common, directly or by way of others, are brought together with their whole
    sets of shingles, and decided there: what leaves a task is as many links as join what is joined.
    One rule holds for groups of all sizes."""
    signed_only = classes.where("signature is not null")
    keys = keyed(signed_only)
    buckets = settle(
        keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    shared = settle(keys.join(small(buckets, 200_000), F.col("key") == F.col("_key"), "left_semi"))
    wanted = settle(
        shared.select(F.col("uid").alias("_u")).distinct()
        .join(signed_only.select("uid", F.col("digest").alias("_digest"), "signature"), F.col("_u") == F.col("uid"))
        .select("uid", "_digest", "signature"))
    signatures = wanted.select(F.col("uid").alias("_u"), "signature")
    rows = settle(
        _sets(docs, wanted.select("uid", "_digest")).join(signatures, F.col("uid") == F.col("_u"))
        .select("uid", "n", "tokens", "signature", (8 * F.col("n") + 16 * SIZE).alias("bytes")))
    return components(links_in_clusters(rows, shared, "bytes", decide(percent)))


def _grouped(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Settled rows of ``signed`` that have words, with the ``group`` of their component, a digest."""
    if 2 * CHUNKS <= distance(percent):
        raise ValueError(f"signatures of {CHUNKS} chunks guarantee no similarity as low as {percent} %")
    classes = settle(
        rows.where("digest is not null").groupBy("digest").agg(F.max("signature").alias("signature"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    named = classes.select("uid", "digest")
    firsts = named.select(F.col("uid").alias("_r"), F.col("digest").alias("group"))
    groups = settle(
        linked(classes, docs, percent).join(named, F.col("id") == F.col("uid")).join(firsts, F.col("root") == F.col("_r"))
        .select(F.col("digest").alias("_d"), "group"))
    return settle(
        rows.where("digest is not null").join(small(groups, 200_000), F.col("digest") == F.col("_d"), "left")
        .withColumn("group", F.coalesce("group", "digest")).drop("_d", "digest", "signature"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows with the same words in order are one class from the start. Null and empty texts, and those of white
    space, have no shingle and are a component each; texts shorter than a shingle link with equal
    ones only. A null doc_id never names a component unless all of its ids are null; it is kept
    only then. Rows with equal ids are kept or not together. Other columns are not looked at. An empty table gives
    no row. Shingles are compared by 64-bit hashes; a similarity below 80 per cent is refused."""
    rows = settle(signed(docs))
    grouped = _grouped(rows, docs, percent)
    least = settle(grouped.groupBy(F.col("group").alias("_g")).agg(F.min("doc_id").alias("component_id")))
    empty = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        grouped.join(least, F.col("group") == F.col("_g")).select("doc_id", "n_shingles", "component_id").unionAll(empty)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the one of the smallest id, of several of
    that id the one of the smallest hash of its text, of equal ones any. Rows without a word all stay."""
    named = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_id"))
    rows = settle(signed(named, "text_id"))
    first = _grouped(rows, docs, percent).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("x")
    )
    kept = first.select(F.col("x.doc_id").alias("_id"), F.col("x.text_id").alias("_text_id"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                        F.md5(F.coalesce("text", F.lit(""))).alias("text_id"))
    has_words = F.col("row.text").rlike(WORD)
    same = Window.partitionBy("id", "text_id").orderBy(F.lit(1))
    chosen = (
        whole.where(has_words)
        .join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text_id")), "left_semi")
        .withColumn("n", F.row_number().over(same)).where("n = 1").select("row")
    )
    return chosen.unionAll(whole.where(~F.coalesce(has_words, F.lit(False))).select("row")).select("row.*")
