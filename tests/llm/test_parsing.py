"""Removed passages against a look-up of every window."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import DOCUMENTS, ODD

from eventlens.llm import parsing


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    windows = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    found = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if windows[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        rest = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found.append((len(d), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return found


def check(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = parsing.without_repeats(docs, "doc_id", length=length).collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert found == dict(enumerate(brute(texts, length)))


def corpora():
    random.seed(5)
    letters = lambda n, of="abcdefgh": "".join(random.choice(of) for _ in range(n))
    passage = letters(400)
    yield "passages", [
        letters(random.randrange(300)) + passage[(a := random.randrange(300)):a + random.randrange(20, 200)]
        + letters(random.randrange(200)) for _ in range(60)
    ] + [passage, passage[50:], letters(90) + passage[:130]]
    yield "runs", ["a" * 500, "ab" * 200, "a" * 39, "a" * 40, "a" * 41, "b" * 700 + "a" * 45, letters(300, "a") + "c"]
    yield "few letters", [letters(random.randrange(400), "ab") for _ in range(40)]
    yield "wide letters", ["é" * 60, "日本" * 50, "xé" * 80, letters(50) + "é" * 30 + letters(50)] * 2
    base = letters(1500)
    yield "near copies", [base[:c] + "X" + base[c + 1:] for c in range(0, 1500, 61)]


@pytest.mark.parametrize("shard", [256, 2])
@pytest.mark.parametrize("name, texts", list(corpora()))
def test_against_brute_force(spark, monkeypatch, name, texts, shard):
    monkeypatch.setattr(parsing, "SHARD", shard)  # 2: almost all stems are dealt over several arrays
    check(spark, texts, 40)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
             for r in parsing.without_repeats(docs, "doc_id").collect()}
    assert found == dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], 200)))


def test_odd_rows(spark, odd, nothing):
    found = parsing.without_repeats(odd, "doc_id").collect()
    wanted = [(i, *x) for i, x in zip([r[0] for r in ODD], brute([r[1] for r in ODD], 200))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    assert parsing.without_repeats(nothing, "doc_id").count() == 0
    assert parsing.stripped(nothing).count() == 0


def test_stripped_rows(spark, odd):
    out = parsing.stripped(odd)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = {(r["doc_id"], r["source"]): r for r in out.collect()}
    assert rows[(2, None)]["text"] is None and rows[(6, "b")]["text"] == ""
    assert (rows[(7, "c")]["text"], rows[(7, "c")]["n_chars"]) == ("12345 67890 !!! ???", 19)
    assert rows[(9, "a")]["n_chars"] == len(rows[(9, "a")]["text"])
    wide = spark.createDataFrame([(1, "日" * 100, "", "", 100), (2, "x" + "日" * 100, "", "", 101)], DOCUMENTS)
    assert sorted(r["text"] for r in parsing.stripped(wide).collect()) == ["", "x"]


def test_short_lengths_are_refused():
    with pytest.raises(ValueError):
        parsing.reach(30)
