"""Components against all pairs of shingle sets."""

import random

import numpy as np
import pytest
from conftest import ODD

from eventlens.llm import minhash


def brute(rows, percent):
    """doc_id -> (size of the set, smallest reachable id) for rows of distinct ids."""
    sets = {i: minhash.shingles(minhash.words_of(t)) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, percent=85):
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def copies(seed, groups, size, edits):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8)))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(groups):
        base = [word() for _ in range(random.randint(40, 150))]
        for _ in range(size):
            text = list(base)
            for _ in range(random.randint(0, edits)):
                text[random.randrange(len(text))] = word()
            if random.random() < 0.3:
                text += passage
            rows.append(" ".join(text))
    random.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(params=[None, 20_000])
def part(request, monkeypatch):
    """Clusters decided whole, and in blocks that hardly hold ten texts."""
    if request.param:
        real = minhash.links_in_clusters
        monkeypatch.setattr(minhash, "links_in_clusters", lambda *a: real(*a, part=request.param))


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_of_copies(spark, part, percent):
    check(spark, copies(8, 12, 14, 6), percent)


def test_one_large_group(spark, part):
    check(spark, copies(9, 1, 150, 12))


def test_a_large_group_of_almost_similar_texts(spark, part):
    random.seed(5)
    words = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    base, rows = words(100), []
    for _ in range(120):  # pairs are about 0.8 alike: some link, most do not
        text, at = list(base), random.randrange(90)
        text[at:at + random.randint(5, 9)] = words(5)
        rows.append(" ".join(text))
    check(spark, list(enumerate(rows)), 85)


def test_pairs_of_any_distance_up_to_the_bound_share_a_key():
    assert all(2 * minhash.CHUNKS > minhash.distance(p) for p in (80, 85, 90, 100))
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(200):
        one = rng.integers(0, 1 << 16, (1, minhash.SIZE)).astype("<u2")
        other = one.copy()
        other[0, rng.permutation(minhash.SIZE)[:minhash.distance(80)]] ^= np.uint16(1)
        assert any(np.isin(minhash.chunk_keys(one, c), minhash.chunk_keys(other, c)).any() for c in range(minhash.CHUNKS))


def test_lower_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), 70)


def test_a_shared_passage_links_nothing(spark, part):
    random.seed(4)
    words = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    passage = words(70)
    check(spark, [(i, words(25) + " " + passage + " " + words(25)) for i in range(120)])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == brute(rows, 85)


def test_short_and_odd_texts(spark):
    check(spark, [(1, "a b c"), (2, "A  b\tC"), (3, "a b c d"), (4, ""), (5, None), (6, " \n"), (7, "a b c d e"),
                  (8, "É x y z w v"), (9, "é x y z w v"), (10, "a b c d e a b c d e a b c d e"), (11, "a\u0085b c")])


def test_odd_rows(spark, odd, nothing):
    found = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect())
    assert len(found) == len(ODD)
    assert ("1", 1, True) in found and found.count(("1", 1, True)) == 2
    assert ("None", None, True) in found and found.count(("None", None, True)) == 2
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(i) for k, (i, *_) in enumerate(ODD) if k != 1)  # of the repeated row one stays
    assert minhash.near_duplicates(nothing).count() == minhash.one_of_each(nothing).count() == 0


def test_keys_are_shared_by_chunks_that_differ_in_one_value():
    one = np.arange(minhash.SIZE, dtype="<u2")[None, :]
    for place in range(minhash.SIZE):
        other = one.copy()
        other[0, place] = 999
        chunk = place // minhash.CHUNK
        assert set(minhash.chunk_keys(one, chunk)[0]) & set(minhash.chunk_keys(other, chunk)[0])
        other[0, chunk * minhash.CHUNK + (place + 1) % minhash.CHUNK] = 998
        if place % minhash.CHUNK != minhash.CHUNK - 1:
            assert not set(minhash.chunk_keys(one, chunk)[0]) & set(minhash.chunk_keys(other, chunk)[0])


def test_signatures_agree_as_the_sets_do():
    random.seed(6)
    agree = []
    for _ in range(40):
        words = [str(random.randrange(10**6)).encode() for _ in range(400)]
        other = words[:340] + [str(random.randrange(10**6)).encode() for _ in range(60)]
        a, b = (minhash.signature(minhash.shingle_hashes(w)) for w in (words, other))
        x, y = minhash.shingles(words), minhash.shingles(other)
        agree.append((a == b).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(agree)) < 0.03
