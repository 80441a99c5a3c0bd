"""Held-out quality of the classifier, and its hashed features."""

import numpy as np
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from eventlens.llm import subword

SF = "/root/testdata/sf0.1"


def area(rows):
    order = sorted(rows, key=lambda r: r["score"])
    ranks = [i + 1 for i, r in enumerate(order) if r["quality"] == 1]
    n = len(ranks)
    return (sum(ranks) - n * (n + 1) / 2) / n / (len(rows) - n)


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = subword.quality_of(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert area(found) > 0.97
    assert sum(r["predicted"] == r["quality"] for r in found) > 0.95 * len(found)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)


def test_held_out_labels_are_not_learned(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chosen = subword.sample(labels, ~held_out, 1000)
    assert chosen.where(held_out).count() == 0 and chosen.count() == labels.where(~held_out).count()
    assert subword.sample(labels, ~held_out, 7).count() == 7


def test_a_repeated_document_is_learned_once(spark):
    rows = [(1, f"text {i}") for i in range(200)] + [(1, None), (2, "two"), (3, None), (4, "four"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    hashes = docs.where("doc_id = 1 and text is not null").select(F.xxhash64("text").alias("h"), "text").collect()
    found = subword.examples(docs.repartition(5), labels, F.lit(True), 50).collect()
    wanted = [(min(hashes)["text"], 1), ("two", 0), ("two", 1), (None, 0)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    model = subword.fit(docs, labels, F.lit(True))
    once = subword.fit(spark.createDataFrame([(1, wanted[0][0]), *rows[201:]], docs.schema), labels, F.lit(True))
    assert (model[0] == once[0]).all() and model[1] == once[1]


def test_features():
    assert len(subword.buckets_of(None, 1000)) == len(subword.buckets_of(" \n", 1000)) == 0
    one = sorted(subword.buckets_of("ab cab", 1 << 17))
    assert one == sorted(subword.buckets_of("\nab \t cab ", 1 << 17))
    # words, marks and length class once each; of " ab " and " cab " the n-grams of 3 and 4 within a word
    assert len(one) == 3 * 2 + (2 + 1) + (3 + 2)
    # ten words of one letter: 10 buckets of the word, 10 length marks, 10 marks of repeats (three kinds), 10 of " x "
    kinds, times = np.unique(subword.buckets_of("x " * 10, 1 << 17), return_counts=True)
    assert sorted(times) == [1, 1, 8, 10, 10, 10] and len(kinds) == 6


def test_long_texts_are_hashed_in_runs(monkeypatch):
    text = "some words of a text that is rather long " * 50
    whole = np.sort(subword.buckets_of(text, 1 << 17))
    monkeypatch.setattr(subword, "RUN", 100)
    runs = np.sort(subword.buckets_of(text, 1 << 17))
    assert len(runs) == pytest.approx(len(whole), rel=0.01)


def test_a_word_of_any_length_is_hashed_in_runs(monkeypatch):
    monkeypatch.setattr(subword, "RUN", 100)
    text = "ab" * 5000 + " tail"
    assert b"".join(subword._runs(text.encode())) == text.encode()
    assert max(map(len, subword._runs(text.encode()))) <= 200
    assert max(map(len, subword.buckets_by_run(text, 1 << 17))) < 3 * 200
    found = subword.buckets_of(text, 1 << 17)
    distinct, share = subword.shares_of(text, 1 << 17)
    kinds, times = np.unique(found, return_counts=True)
    assert (distinct == kinds).all() and share == pytest.approx(times / len(found))


def test_scores_by_plain_python(spark):
    texts = [None, "", "one two two three", "ß words \n of\tmore " * 40, "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    logits = np.random.default_rng(3).normal(size=512).astype(np.float32)
    rows = subword.scored(docs, (logits, 0.25), "doc_id").collect()
    for row in rows:
        values = [float(logits[b]) for b in subword.buckets_of(texts[row["doc_id"]], 512)]
        odds = 0.25 + sum(values) / max(len(values), 1)
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-odds)))
        assert row["predicted"] == int(row["score"] >= 0.3)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0), (6, None, 0), (7, 0, 1), (99, 1, 0)],
        "doc_id long, quality int, toxic int")
    rows = subword.quality_of(odd, labels, most=50).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = labels.where("false")
    assert {r["score"] for r in subword.quality_of(odd, empty).collect()} == {0.5}
    assert subword.quality_of(nothing, labels).count() == 0
