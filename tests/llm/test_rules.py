"""Base counts against plain Python, and the votes' estimate."""

import random
import re

import numpy as np
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlens.llm import rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)]


@settings(max_examples=200, deadline=None)
@given(st.none() | st.text("ab \n#|é\x0b\x85", max_size=200) | st.text(max_size=50))
def test_base_counts(text):
    assert rules.measure(text)[0] == plain(text)


def test_repeated_windows_overlap():
    random.seed(1)
    words = [random.choice("ab") for _ in range(200)] + list("abcdefghij") * 3
    assert rules.measure(" ".join(words))[0] == plain(" ".join(words))


def test_votes_go_there_and_back():
    random.seed(2)
    codes = np.array([rules.votes([random.choice([0.0, 0.3, 1.0, 5.0, 100.0]) for _ in rules.RULES]) for _ in range(50)])
    back = rules.ballots(codes)
    digits = {0: 0, 1: 1, -1: 2}
    assert [sum(digits[v] * 3 ** (len(rules.RULES) - 1 - i) for i, v in enumerate(row)) for row in back] == codes.tolist()


def test_accuracies_are_found_from_agreement():
    random.seed(3)
    truth, rows = [], []
    for _ in range(4000):
        good = random.random() < 0.8
        truth.append(good)
        rows.append(tuple(
            random.choices((1, 0, -1), (0.85, 0.13, 0.02) if good else (0.4, 0.2, 0.4))[0] for _ in rules.RULES))
    digits = {0: 0, 1: 1, -1: 2}
    codes = np.array([sum(digits[v] * 3 ** (len(rules.RULES) - 1 - i) for i, v in enumerate(r)) for r in rows])
    distinct, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    said = rules.estimate(distinct, counts)[inverse] >= 0.5
    assert (said == np.array(truth)).mean() > 0.95


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = rules.weak_quality(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").collect()
    good = [r for r in found if r["label"] == 1 and not r["base_failed"]]
    bad = [r for r in found if r["label"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.05 * len(bad)
    assert not any(r["kept"] for r in found if r["base_failed"])


def test_odd_rows(spark, odd, nothing):
    rows = rules.weak_quality(odd).collect()
    assert sorted(str([r["doc_id"], *(r[c] for c in rules.BASE)]) for r in rows) == sorted(
        str([x[0], *plain(x[1])]) for x in ODD)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    kept = rules.kept_rows(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert rules.weak_quality(nothing).count() == rules.kept_rows(nothing).count() == 0
