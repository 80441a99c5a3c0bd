"""Pieces against the vocabulary's encoder, and places in sequences."""

import math
import random
import struct
import zlib

import pytest
from conftest import ODD

from eventlens.llm import packing, tokens


def pieces(rows, encode, capacity):
    found = []
    for doc_id, text in rows:
        ids = encode(text) + struct.pack("<I", 1)
        n = len(ids) // 4
        for k, lo in enumerate(range(0, n, capacity)):
            part = ids[4 * lo:4 * (lo + capacity)]
            found.append((str(doc_id), k, lo, len(part) // 4, zlib.crc32(part)))
    return sorted(found)


def check(df, rows, vocabulary, capacity, **options):
    packed = packing.pack(df, vocabulary, capacity, **options).collect()
    encode = tokens.word_ids(vocabulary)
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces(
        rows, encode, capacity)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in packed)


def test_whole_table(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    n, total = check(docs, rows, vocabulary, 4096)
    assert n <= 1.03 * math.ceil(total / 4096)
    # several tasks, few open bins, and small blocks in the second round
    n, total = check(docs.repartition(7), rows, vocabulary, 4096, open_bins=16, block=20)
    assert n <= 1.15 * math.ceil(total / 4096)


def test_odd_rows(spark, odd, nothing, vocabulary):
    rows = [(r[0], r[1]) for r in ODD]
    check(odd, rows, vocabulary, 64)
    check(odd.repartition(5), rows, vocabulary, 4096)
    assert packing.pack(nothing, vocabulary).count() == 0


@pytest.mark.parametrize("most", [1, 3, 50])
def test_open_bins_are_best_fit(most):
    random.seed(most)
    bins = packing.OpenBins(100, most, 0)
    free, used = {}, 0  # open bins by number
    for _ in range(500):
        length = random.randint(1, 100)
        fitting = {k: f for k, f in free.items() if f >= length}
        number, place = bins.put(length)
        if fitting:
            assert free[number] == min(fitting.values())
        else:
            assert number == used
            used += 1
            if len(free) >= most:
                gone = [k for k in free if k not in bins.left() and k != number]
                assert len(gone) == 1 and free[gone[0]] == min(free.values())
                del free[gone[0]]
            free[number] = 100
        assert place == 100 - free[number]
        free[number] -= length
        if not free[number]:
            del free[number]
        assert bins.left() == set(free) and len(free) <= most
