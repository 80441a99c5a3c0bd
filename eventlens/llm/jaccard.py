"""N-gram Jaccard join with adaptive prefixes, of which pairs share as many tokens as the prefixes are longer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from eventlens.llm.clusters import Forest, Sets, links_in_clusters
from eventlens.llm.common import components, settle, small

#: Words in a shingle.
WIDTH = 5
#: Prefixes are lengthened by up to so many tokens less one.
MOST = 16
#: Tokens that are counted in one task, and tokens of a chunk, which gives each of its tokens to that task once.
SHARD, CHUNK = 2_000_000, 1_000_000

_PLACES = np.random.Generator(np.random.PCG64(77_003)).integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; a bytes' own lower() and split() touch ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Tokens:
    """The tokens of texts: sorted 64-bit hashes of their distinct shingles."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < WIDTH:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.known
        try:
            hashes = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = list(map(known.__getitem__, words))
        of_word = np.array(hashes, np.uint64)
        n = len(words) - WIDTH + 1
        total = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            total += of_word[k:k + n] * _PLACES[k]
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(total ^ (total >> np.uint64(32)))


# -- which texts may link at all ----------------------------------------------------


def _sent(docs: DataFrame, percent: int, shards: int) -> DataFrame:
    """Rows for ``repeated``: of every document one (shard, chunk, place, doc_id, digest, n_shingles, known), and for each
    chunk and shard one with the chunk's tokens that fall there. A token that several texts of a chunk have is
    sent once and counts for them at once (``known``), so a very common token is one number of each chunk."""
    form = ("shard int, chunk long, place int, doc_id long, digest binary, n_shingles long, known long, "
            "tokens binary, places binary")
    names = [f.split()[0] for f in form.split(", ")]
    empty = {"place": -1, "n_shingles": 0, "known": 0}

    def chunk_rows(chunk: int, ids: list, digests: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        first: dict[bytes | None, int] = {}
        firsts = [first.setdefault(d, k) for k, d in enumerate(digests)]
        own = [k for k, f in enumerate(firsts) if f == k and len(sets[k])]
        tokens = np.concatenate([sets[k] for k in own]) if own else np.empty(0, np.uint64)
        places = np.repeat(np.array(own, np.int64), [len(sets[k]) for k in own])
        distinct, at, inverse, count = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        known = np.bincount(places[count[inverse] > 1], minlength=len(ids))
        shard = (distinct % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        low = (distinct // np.uint64(shards) & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
        place = np.where(count > 1, -1, places[at] if len(at) else 0).astype("<i4")[order]
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [
            {"shard": int((chunk + k) % shards), "chunk": chunk, "place": k, "doc_id": ids[k], "digest": digests[k],
             "n_shingles": len(sets[firsts[k]]), "known": int(known[firsts[k]])} for k in range(len(ids))
        ]
        rows += [
            {**empty, "shard": s, "chunk": chunk, "tokens": low[bounds[s]:bounds[s + 1]].tobytes(),
             "places": place[bounds[s]:bounds[s + 1]].tobytes()} for s in range(shards) if bounds[s] < bounds[s + 1]
        ]
        return pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, form.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, chunk = Tokens(), TaskContext.get().partitionId() << 32
        ids, digests, sets, total = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                ids.append(doc_id)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sets.append(of(words))
                total += len(sets[-1]) + 20
                if total >= CHUNK:
                    yield chunk_rows(chunk, ids, digests, sets)
                    ids, digests, sets, total, chunk = [], [], [], 0, chunk + 1
        if ids:
            yield chunk_rows(chunk, ids, digests, sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, form)


def repeated(docs: DataFrame, percent: int) -> DataFrame:
    """Settled doc_id, digest (null without words), n_shingles and ``may_link`` of every row.

    Chunks of documents send their tokens to shards, packed, and shards answer chunks, packed too.
    A token that no other text has is shared with none; a text of which fewer tokens than needed are found in others
    links with none. Tokens are matched here by 32 bits within ``shards``, which may find too many, and copies
    of a text in other chunks count as others: both only leave more texts to look at."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(chars // (5 * SHARD)) + 1
    sent = _sent(docs, percent, shards)

    def count(table: pa.Table) -> pa.Table:
        is_doc = np.array(table["place"].to_numpy() >= 0)
        docs_here = table.filter(pa.array(is_doc)).select(["chunk", "place", "doc_id", "digest", "n_shingles", "known"])
        rows = table.filter(pa.array(~is_doc))
        tokens = np.frombuffer(b"".join(rows["tokens"].to_pylist()), "<u4")
        places = np.frombuffer(b"".join(rows["places"].to_pylist()), "<i4")
        each = np.array([len(t) // 4 for t in rows["tokens"].to_pylist()], np.int64)
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        again = np.zeros(len(tokens), bool)
        same = ordered[1:] == ordered[:-1]
        again[1:] |= same
        again[:-1] |= same
        hit = order[again]
        hit = hit[places[hit] >= 0]
        # a chunk has one row of tokens in a shard, and gets one with its documents' numbers of repeated ones
        row = np.repeat(np.arange(len(each)), each)[hit]
        found, n = np.unique(row << 32 | places[hit].astype(np.int64), return_counts=True)
        bounds = np.searchsorted(found >> 32, np.arange(len(each) + 1))
        told = [k for k in range(len(each)) if bounds[k] < bounds[k + 1]]
        at, n = (found & 0xFFFFFFFF).astype("<i4"), n.astype("<i4")
        replies = pa.table({
            **{c: pa.nulls(len(told), docs_here.schema.field(c).type) for c in docs_here.column_names},
            "chunk": rows["chunk"].take(pa.array(told, pa.int64())),
            "places": pa.array([at[bounds[k]:bounds[k + 1]].tobytes() for k in told], pa.binary()),
            "counts": pa.array([n[bounds[k]:bounds[k + 1]].tobytes() for k in told], pa.binary()),
        })
        docs_here = docs_here.append_column("places", pa.nulls(len(docs_here), pa.binary())).append_column(
            "counts", pa.nulls(len(docs_here), pa.binary()))
        return pa.concat_tables([docs_here, replies.select(docs_here.column_names)])

    def add(table: pa.Table) -> pa.Table:
        is_doc = np.array([p is not None for p in table["place"].to_pylist()])
        docs_here, replies = table.filter(pa.array(is_doc)), table.filter(pa.array(~is_doc))
        place, size = docs_here["place"].to_numpy(), docs_here["n_shingles"].to_numpy()
        shared = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        shared[place] = docs_here["known"].to_numpy()
        at, n = (np.frombuffer(b"".join(replies[c].to_pylist()), "<i4") for c in ("places", "counts"))
        np.add.at(shared, at, n)
        shared = shared[place]
        return docs_here.select(["doc_id", "digest", "n_shingles"]).append_column(
            "may_link", pa.array((shared > 0) & (100 * shared >= percent * size)))

    form = ("chunk long, place int, doc_id long, digest binary, n_shingles long, known long, "
            "places binary, counts binary")
    counted = sent.groupBy("shard").applyInArrow(count, form)
    return settle(counted.groupBy("chunk").applyInArrow(
        add, "doc_id long, digest binary, n_shingles long, may_link boolean"))


def _classes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Settled uid, digest, n and tokens of each text in ``wanted`` (_digest; settled). Texts are read again, and only
    these shuffled."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b" ".join(words_of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())],
                ["digest", "form"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokens()
        for batch in batches:
            found = [of(x.as_py().split()) for x in batch.column("form")]
            yield pa.RecordBatch.from_arrays([
                batch.column("digest"), pa.array([len(x) for x in found], pa.int64()),
                pa.array([x.tobytes() for x in found], pa.binary())], ["digest", "n", "tokens"])

    texts = (
        docs.select("text").where("text is not null").mapInArrow(forms, "digest binary, form binary")
        .join(small(wanted, 200_000), F.col("digest") == F.col("_digest"), "left_semi")
        .groupBy("digest").agg(F.first("form").alias("form"))
    )
    return settle(
        texts.mapInArrow(sets, "digest binary, n long, tokens binary").withColumn("uid", F.monotonically_increasing_id()))


# -- prefixes -----------------------------------------------------------------------


def prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """Settled uid, key, ``place`` and ``more``: the tokens of each text's prefix that others have as well.

    Tokens are ordered by how many texts have them, rare ones first. A set of n that has to share o tokens meets
    every partner among its first n - o + 1, and at least ``more`` times among its first n - o + ``more``. The longer
    prefix costs its tokens' lists, and their share by ``more`` bounds the candidates left to compare, of n tokens
    each: each text takes the length of least cost, up to ``MOST``."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("tokens").to_pylist()
            each = [len(b) // 8 for b in blobs]
            at = pa.array(np.repeat(np.arange(len(blobs)), each))
            yield pa.RecordBatch.from_arrays([
                batch.column("uid").take(at), batch.column("n").take(at),
                pa.array(np.frombuffer(b"".join(blobs), np.int64))], ["uid", "n", "key"])

    tokens = classes.select("uid", "n", "tokens").mapInArrow(exploded, "uid long, n long, key long")
    counts = settle(tokens.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = tokens.join(counts, F.col("key") == F.col("_key")).select("uid", "n", "key", "df")
    own = Window.partitionBy("uid")
    up_to = own.orderBy("df", "key").rowsBetween(Window.unboundedPreceding, 0)
    least = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    # tokens that no other text has come first
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "key"))
    ranked = shared.select(
        "uid", "key", "n", place.alias("place"), (place - (F.col("n") - least)).alias("level"),
        F.sum(F.col("df") - 1).over(up_to).alias("lists"),
    )
    # up to the first level all tokens are in any prefix, and the last of them has their sum
    cost = F.when(
        F.col("level").between(1, F.least(F.lit(MOST), least)),
        F.struct((F.col("lists") * (1 + F.col("n") / F.col("level"))).alias("cost"), F.col("level").alias("level")))
    best = ranked.withColumn("more", F.min(cost).over(own)["level"])
    return settle(best.where("level <= more").select("uid", "key", "place", F.col("more").cast("int").alias("more")))


# -- comparing -----------------------------------------------------------------------


def decide(percent: int):
    """Joins the rows of a part that link: those with enough prefix tokens in common, by their whole sets."""

    def run(table: pa.Table, roots: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
        k = len(table)
        n, more = table["n"].to_numpy(), table["more"].to_numpy()
        sets = Sets(table["tokens"], n, percent)
        prefix = [np.array(p, np.int64) for p in table["prefix"].to_pylist()]
        keys, inverse = np.unique(np.concatenate(prefix), return_inverse=True)
        cuts = np.cumsum([0] + [len(p) for p in prefix])
        forest = Forest(k, roots)
        # a token's list: rows in order, of which only those before the one that asks are looked at
        order = np.argsort(inverse, kind="stable")
        rows_of = np.repeat(np.arange(k), np.diff(cuts))[order]
        first = np.searchsorted(inverse[order], np.arange(len(keys) + 1))
        for i in range(k):
            lists = [rows_of[first[t]:first[t + 1]] for t in inverse[cuts[i]:cuts[i + 1]]]
            lists = [x[:np.searchsorted(x, i)] for x in lists]
            total = sum(map(len, lists))
            if not total:
                continue
            if total > k // 4:
                times = np.bincount(np.concatenate(lists), minlength=i)
                others = np.flatnonzero(times)
                times = times[others]
            else:
                others, times = np.unique(np.concatenate(lists), return_counts=True)
            fits = times >= np.minimum(more[others], more[i])
            fits &= 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
            if side[i]:
                fits &= side[others] == 0
            others = others[fits]
            if not len(others):
                continue
            others = others[forest.roots(others) != forest.root(i)]
            for some in sets.batches(others):
                for j in some[sets.similar(i, some)]:
                    forest.join(i, int(j))
        return forest.links

    return run


def linked(classes: DataFrame, percent: int) -> DataFrame:
    """The smallest uid reachable from each uid that has a link: ``id`` and ``root``."""
    keys = prefixes(classes, percent)
    of_uid = keys.groupBy(F.col("uid").alias("_u")).agg(F.first("more").alias("more"), F.collect_list("key").alias("prefix"))
    rows = settle(classes.join(of_uid, F.col("uid") == F.col("_u")).select(
        "uid", "n", "tokens", "more", "prefix", (8 * (F.col("n") + F.size("prefix")) + 64).alias("bytes")))
    return components(links_in_clusters(rows, keys.select("uid", "key"), "bytes", decide(percent)))


def joined(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: two rows link if their sets of shingles are as similar as
    ``percent`` says, and a component is named after its smallest doc_id.

    Rows with the same words in order are one text from the start. Null and empty texts, and those of white space, have
    no shingle and are a component each. Texts shorter than a shingle are one shingle, and link with equal ones
    only. Rows with equal ids are rows of their own, in the component that has the id's name if any of them is
    linked; a null doc_id names a component only if all of its ids are null. Other columns are not looked at. An empty
    table gives no row. Shingles are compared by 64-bit hashes."""
    rows = repeated(docs, percent)
    wanted = settle(rows.where("may_link").select(F.col("digest").alias("_digest")).distinct())
    classes = _classes(docs, wanted)
    named = classes.select("uid", "digest")
    roots = linked(classes, percent)
    firsts = named.select(F.col("uid").alias("_r"), F.col("digest").alias("group"))
    groups = settle(
        roots.join(named, F.col("id") == F.col("uid")).join(firsts, F.col("root") == F.col("_r"))
        .select(F.col("digest").alias("_d"), "group"))
    grouped = settle(
        rows.where("digest is not null").join(small(groups, 200_000), F.col("digest") == F.col("_d"), "left")
        .select("doc_id", "n_shingles", F.coalesce("group", "digest").alias("group")))
    least = settle(grouped.groupBy(F.col("group").alias("_g")).agg(F.min("doc_id").alias("component_id")))
    return grouped.join(least, F.col("group") == F.col("_g")).select("doc_id", "n_shingles", "component_id").unionAll(
        rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
