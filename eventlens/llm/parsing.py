"""Removal of repeated passages: prefix-free parsing and suffix arrays of what it finds repeated."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import bounded, settle, small, with_fields

#: Bytes that the rolling hash looks at.
ROLL = 16
#: Contexts of one stem that go to one suffix array.
SHARD = 2048
#: Keys of texts, of 16 bytes each, that are broadcast at most; more of them are joined by a shuffle.
KEYS = 500_000
SPANS = "array<struct<first:int,last:int,repeated:array<int>>>"
#: Bytes of contexts in one suffix array, some.
ARRAY = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(77_041))
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ROLL`` bytes from each place on; by doubling, so whole arrays are worked at once."""
    hashes, width = BYTE[data], 1
    while width < ROLL:
        factor = np.uint64(pow(STEP, width, 1 << 64))
        hashes, width = hashes[:-width] * factor + hashes[width:], 2 * width
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes >> np.uint64(32)


def reach(length: int) -> int:
    """Places of which one is a trigger for certain, so that ``length`` bytes hold two."""
    if length < 2 * ROLL + 2:
        raise ValueError(f"repeats of less than {2 * ROLL + 2} bytes cannot be parsed")
    return (length - ROLL + 1) // 2


def lowest(data: np.ndarray, span: int) -> np.ndarray:
    """For each ``span`` places in a row, the place of the least hash, of equal ones the last."""
    hashes = rolling(data)
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    width = 1
    while 2 * width <= span:
        keys, width = np.minimum(keys[:-width], keys[width:]), 2 * width
    if width < span:
        keys = np.minimum(keys[:width - span], keys[span - width:])
    return (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)


def triggers(low: np.ndarray) -> np.ndarray:
    """Places that are the lowest of some span, in order. A phrase goes from a trigger to the end of the
    next one's ``ROLL`` bytes, so no phrase is the beginning of another one."""
    return low[np.concatenate(([True], low[1:] != low[:-1]))]


def phrases(data: bytes, length: int) -> tuple[np.ndarray, list[int]]:
    """Where the phrases of a text of ``length`` bytes or more begin, and their hashes."""
    marks = triggers(lowest(np.frombuffer(data, np.uint8), reach(length)))
    ends = marks[1:] + ROLL
    return marks[:-1], [
        xxhash.xxh3_64_intdigest(data[lo:hi]) - (1 << 63) for lo, hi in zip(marks.tolist(), ends.tolist())
    ]


def contexts(data: bytes, length: int, repeated: set[int]) -> list[tuple[int, int, int]]:
    """The windows of ``length`` bytes that hold repeated phrases only, by their first sure trigger: place
    of the trigger, first and last window.

    A window's first sure trigger is the lowest place of its first span, its last one that of its last
    span. These two, and all triggers between them, depend on the window's bytes alone. So equal windows
    have equal phrases there, at equal distance from their start, and each of these phrases occurs as
    often as the window does, at least."""
    span, n = reach(length), len(data) - length + 1
    low = lowest(np.frombuffer(data, np.uint8), span)
    marks = triggers(low)
    skip = length - ROLL + 1 - span
    first, last = low[:n], low[skip:skip + n]
    at, to = np.searchsorted(marks, first), np.searchsorted(marks, last)
    known = np.isin(marks, np.fromiter(repeated, np.int64, len(repeated)))
    unknown = np.concatenate(([0], np.cumsum(~known)))
    windows = np.flatnonzero(unknown[to] == unknown[at])
    if not len(windows):
        return []
    owner = first[windows]
    cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    stops = np.concatenate((cuts[1:], [len(windows)])) - 1
    return list(zip(owner[cuts].tolist(), windows[cuts].tolist(), windows[stops].tolist()))


def named(data: bytes, place: int, first: int, last: int, length: int) -> tuple[int, int]:
    """A context's name: 128 bits of its bytes and of where its trigger lies."""
    digest = xxhash.xxh3_128_digest(struct.pack("<q", place - first) + data[first:last + length])
    return struct.unpack("<qq", digest)


def ranked(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of keys below 2**(63 - bits), from 0, equal ones equal; ``bits`` are enough for their number.
    Keys are sorted with their places in the low bits, which is much faster than to sort places."""
    both = np.sort(keys << np.int64(bits) | np.arange(len(keys), dtype=np.int64))
    order, keys = both & np.int64((1 << bits) - 1), both >> np.int64(bits)
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
    return ranks


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of each place among all in the order of their next ``length`` bytes, by prefix doubling: the
    inverse of a suffix array that looks ``length`` bytes far; equal ranks are equal bytes."""
    bits = len(data).bit_length()
    if bits > 21:
        raise ValueError("a suffix array holds 2 MB at most")
    # four bytes are a number; their rank fits beside another one in a key
    wide = data.astype(np.int64)
    ranks = ranked(wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:], bits)
    width = 4
    while width < length:
        step = min(width, length - width)
        ranks = ranked(ranks[:-step] << np.int64(bits) | ranks[step:], bits)
        width += step
    return ranks


FOUND = "c1 long, c2 long, repeated array<int>, w1 long, w2 long, n long, at int"


def _ordered(rows: list[dict], length: int) -> Iterator[tuple]:
    """The windows of some contexts in the order of a suffix array. A context's repeated windows are those whose
    rank another window has, or whose context occurs more than once. For stems in several shards, a row
    for each window (of those with equal ranks one, with their number) goes on to be matched there."""
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    ranks = suffix_ranks(data, length)
    sizes = np.array([len(r["bytes"]) for r in rows])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    places = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts)])
    owners = np.repeat(np.arange(len(rows)), counts)
    ranks = np.unique(ranks[places], return_inverse=True)[1]
    times = np.array([r["n"] for r in rows], np.int64)
    total = np.bincount(ranks, weights=times[owners]).astype(np.int64)[ranks]
    cut = np.cumsum(counts)[:-1]
    for k, (row, sums) in enumerate(zip(rows, np.split(total, cut))):
        if row["n"] == 1 and (sums > 1).any():
            yield row["c1"], row["c2"], np.flatnonzero(sums > 1).tolist(), None, None, None, None
    split = np.array([r["shards"] > 1 for r in rows])
    if split.any():
        _, one = np.unique(ranks, return_index=True)
        for k in one[split[owners[one]]].tolist():
            row, place = rows[owners[k]], int(places[k])
            digest = xxhash.xxh3_128_digest(data[place:place + length].tobytes())
            w1, w2 = struct.unpack("<qq", digest)
            at = place - int(starts[owners[k]])
            yield row["c1"], row["c2"], None, w1, w2, int(total[k]), at


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """For each distinct text (k1, k2: two hashes of it) with repeats, ``spans``: an array of the contexts in which
    they lie (place of the first window, of the last one, whether all are repeated, and which, if not all).
    ``docs`` has k1, k2 and text."""
    texts = docs.where(F.octet_length("text") >= length).select("k1", "k2", F.col("text").cast("binary").alias("data"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k1").to_numpy()
            texts_of = ((k, d.as_py()) for k, d in zip(keys, batch.column("data")))
            for group in bounded(texts_of, lambda x: len(x[1]), 1 << 22):
                found = [(k, *phrases(data, length)) for k, data in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([k for k, _, _ in found], [len(p) for _, p, _ in found])),
                     pa.array(np.concatenate([p for _, p, _ in found]).astype(np.int32)),
                     pa.array([h for _, _, hashes in found for h in hashes], pa.int64())],
                    ["k1", "place", "phrase"],
                )

    parsed = texts.select("k1", "data").mapInArrow(parse, "k1 long, place int, phrase long")
    # settled, the dictionary is a table of its own, so that the join can split a phrase that is very common
    dictionary = settle(parsed.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase"))
    # a text's key of 64 bits may stand for two texts here: that adds places to look at, no more
    places = settle(
        parsed.join(dictionary, "phrase", "left_semi").groupBy("k1").agg(F.collect_set("place").alias("places"))
    )

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c) for c in ("k1", "k2", "data", "places"))
            for k1, k2, data, marks in zip(*columns):
                data = data.as_py()
                for place, first, last in contexts(data, length, set(marks.as_py())):
                    # what all windows share that have their trigger here
                    stem = xxhash.xxh3_64_intdigest(data[place:place + length - reach(length) + 1]) - (1 << 63)
                    rows.append((k1.as_py(), k2.as_py(), first, last, stem,
                                 *named(data, place, first, last, length)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["k1", "k2", "first", "last", "stem", "c1", "c2"],
            )

    located = settle(
        texts.join(small(places.select("k1"), KEYS), "k1", "left_semi").join(places, "k1")
        .select("k1", "k2", "data", "places")
        .mapInArrow(locate, "k1 long, k2 long, first int, last int, stem long, c1 long, c2 long")
    )
    distinct = settle(
        located.groupBy("c1", "c2").agg(
            F.count("*").alias("n"), F.min("stem").alias("stem"),
            F.min(F.struct("k1", "k2", "first", "last")).alias("one"),
        )
    )
    # a context whose stem no other context has is settled by its own number
    open_stems = (
        distinct.groupBy("stem").agg(F.count("*").alias("m"), F.min("n").alias("least"))
        .where("m > 1 and least = 1")
        .select("stem", F.ceil(F.col("m") / max(1, min(SHARD, ARRAY // 2 // (length + reach(length))))).cast("int")
                .alias("shards"))
    )
    asked = settle(
        distinct.join(open_stems, "stem")
        .select("stem", "c1", "c2", "n", "shards", "one.*",
                F.pmod(F.xxhash64("c1", "c2"), F.col("shards")).alias("shard"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = zip(batch.column("data"), batch.column("first").to_pylist(), batch.column("last").to_pylist())
            parts = [data.as_py()[first:last + length] for data, first, last in bounds]
            kept = batch.select(["stem", "shard", "shards", "c1", "c2", "n"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(parts, pa.binary())], [*kept.schema.names, "bytes"])

    schema = "stem long, shard long, shards int, c1 long, c2 long, n long, bytes binary"
    # copies of a text are one row here, whichever
    sources = (
        texts.join(small(settle(asked.select("k1", "k2").distinct()), KEYS), ["k1", "k2"], "left_semi")
        .groupBy("k1", "k2").agg(F.first("data").alias("data"))
    )
    pieces = sources.join(asked, ["k1", "k2"]).select(
        "data", "first", "last", "stem", "shard", "shards", "c1", "c2", "n"
    ).mapInArrow(cut, schema)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> Iterator[list[dict]]:
            group: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if group and (row["stem"], row["shard"]) != (group[0]["stem"], group[0]["shard"]):
                        yield group
                        group = []
                    group.append(row)
            if group:
                yield group

        whole = bounded(grouped(), lambda g: sum(len(r["bytes"]) for r in g), ARRAY)
        for groups in whole:
            columns = list(zip(*_ordered([r for g in groups for r in g], length))) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["c1", "c2", "repeated", "w1", "w2", "n", "at"],
            )

    ordered = settle(
        pieces.repartition("stem", "shard").sortWithinPartitions("stem", "shard").mapInArrow(order, FOUND)
    )
    windows = ordered.where("at is not null")
    shared = windows.groupBy("w1", "w2").agg(F.sum("n").alias("m")).where("m > 1").select("w1", "w2")
    across = (
        windows.where("n = 1").join(shared, ["w1", "w2"], "left_semi")
        .groupBy("c1", "c2").agg(F.collect_set("at").alias("repeated"))
    )
    some = (
        ordered.where("repeated is not null").select("c1", "c2", "repeated").unionAll(across)
        .groupBy("c1", "c2").agg(F.array_distinct(F.flatten(F.collect_list("repeated"))).alias("repeated"))
    )
    decided = distinct.where("n > 1").select("c1", "c2", F.lit(None).cast("array<int>").alias("repeated")).unionAll(some)
    return settle(
        located.join(decided, ["c1", "c2"])
        .groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last", "repeated")).alias("spans"))
    )


def covered(size: int, spans: list[dict] | None, length: int) -> np.ndarray:
    """Starts and ends, alternating, of the maximal runs of removed bytes."""
    edges = np.zeros(size + 1, np.int64)
    for span in spans or ():
        if span["repeated"] is None:
            edges[span["first"]] += 1
            edges[span["last"] + length] -= 1
        else:
            at = span["first"] + np.array(span["repeated"], np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + length, -1)
    removed = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
    return np.flatnonzero(removed[1:] != removed[:-1])


def without_repeats(docs: DataFrame, *keep: str, length: int = 200, with_text: bool = False) -> DataFrame:
    """``keep`` of every row, and of its whole text as UTF-8: n_bytes, n_removed, n_spans and kept_sha256 (of the
    remaining bytes); ``with_text`` also gives kept, the remaining text without characters that were cut.

    Removed is every byte of a string of ``length`` bytes that also starts anywhere else, in another row or
    the same; strings are judged on the input, overlaps count, nothing crosses rows. Null texts are
    empty; a repeated row makes its whole text repeated, if it is long enough; an empty table gives no
    row. Keys of any type, null too, are passed on.

    Method: a rolling hash picks triggers, which cut texts into prefix-free phrases. The dictionary of phrases
    is counted, and only occurrences of repeated ones are followed. Windows are grouped into contexts by
    the trigger they surely hold; equal contexts are one row from there on, so highly repetitive text
    gets small. Where contexts with the same bytes behind the trigger (its stem) differ, suffix arrays
    over them bring their windows into order, equal ones side by side. A stem with very many contexts
    is dealt over several arrays, whose classes are then matched by content.
    """
    more = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    schema = with_fields(docs, keep, more)
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(
        F.struct(*keep).alias("row"), text.alias("text"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(length), text).alias("k2"),
    )
    spans = repeated_spans(hashed, length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, found in zip(batch.column("data"), batch.column("spans")):
                data = data.as_py()
                edges = covered(len(data), found.as_py(), length)
                lows, highs = edges[::2].tolist(), edges[1::2].tolist()
                rest = b"".join(data[lo:hi] for lo, hi in zip([0, *highs], [*lows, len(data)])) if lows else data
                own = (len(data), len(data) - len(rest), len(lows), hashlib.sha256(rest).hexdigest())
                rows.append((*own, rest.decode("utf-8", "ignore")) if with_text else own)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
            columns = list(zip(*rows)) or [()] * len(types)
            own = batch.column("row")
            yield pa.RecordBatch.from_arrays(
                [*[own.field(i) for i in range(len(keep))], *[pa.array(c, t) for c, t in zip(columns, types)]],
                [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text],
            )

    keys = small(spans.select("k1", "k2"), KEYS)  # keeps texts without repeats out of the shuffle, if it can
    data = F.col("text").cast("binary").alias("data")
    whole = hashed.join(keys, ["k1", "k2"], "left_anti").select("row", data, F.lit(None).cast(SPANS).alias("spans"))
    cut = hashed.join(keys, ["k1", "k2"], "left_semi").join(spans, ["k1", "k2"]).select("row", data, "spans")
    return whole.unionAll(cut).mapInArrow(remove, schema)


def stripped(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with all columns and without the repeated strings in ``text``; ``n_chars``, if there is such a
    column, follows the text. Null texts stay null, texts that are removed as a whole are empty."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(F.struct(*others).alias("row"), F.col("text").isNull().alias("no_text")).alias("own"), "text"
    )
    found = without_repeats(rows, "own", length=length, with_text=True)
    text = F.when(~F.col("own.no_text"), F.col("kept"))
    count = {"text": text, "n_chars": F.length(text)} if "n_chars" in others else {"text": text}
    return found.select(*[
        count[c].cast(docs.schema[c].dataType).alias(c) if c in count else F.col("own.row")[c].alias(c)
        for c in docs.columns
    ])
