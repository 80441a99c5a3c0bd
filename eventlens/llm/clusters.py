"""Deciding pairs where they may meet: clusters of rows that share a key, dealt into tasks of bounded size.

Rows with a key in common are brought together, with all that a decision needs, and compared inside a task. What
leaves the task is no list of pairs but a forest: as many links as join what is joined."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import components, settle, small

#: Bytes of a task's rows: clusters up to this size are decided whole, larger ones in blocks of half of it.
PART = 16 << 20


class Forest:
    """Which of ``n`` rows are joined so far, from ``roots`` that are known before."""

    def __init__(self, n: int, roots: np.ndarray | None = None):
        self.parent = np.arange(n)
        if roots is not None and n:
            _, first, inverse = np.unique(roots, return_index=True, return_inverse=True)
            self.parent = first[inverse].astype(np.int64)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def roots(self, rows: np.ndarray) -> np.ndarray:
        """The root of each of some rows."""
        found = self.parent[rows]
        while True:
            up = self.parent[found]
            if (up == found).all():
                self.parent[rows] = found
                return found
            found = up

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


class Sets:
    """Whole sets of 64-bit tokens of a part's rows, ``sizes`` of them in each."""

    #: Tokens that one row's tokens are looked up in at once.
    BATCH = 1 << 20

    def __init__(self, tokens: pa.ChunkedArray, sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        _, self.number = np.unique(np.frombuffer(b"".join(tokens.to_pylist()), np.uint64), return_inverse=True)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.mark = np.zeros(int(self.number.max(initial=-1)) + 1, bool)

    def batches(self, rows: np.ndarray) -> list[np.ndarray]:
        """Some rows in lists that ``similar`` has room for."""
        return np.array_split(rows, max(1, int(self.sizes[rows].sum()) // self.BATCH))

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` have a set as similar to that of ``i`` as asked."""
        if not len(others):
            return np.empty(0, bool)
        own = self.number[self.start[i]:self.start[i + 1]]
        self.mark[own] = True
        n = self.sizes[others]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n - self.start[others], n)
        both = np.add.reduceat(self.mark[self.number[at]], ends - n, dtype=np.int64)
        self.mark[own] = False
        return 100 * both >= self.percent * (n + len(own) - both)


def clustered(keys: DataFrame) -> DataFrame:
    """Settled ``uid`` and ``cluster`` of the rows that share a ``key`` with others, directly or by way of others.
    ``keys`` (uid, key) is settled; a key's rows all link to the smallest of them, so a key that
    is very common makes as many links as it has rows."""
    hubs = settle(
        keys.groupBy("key").agg(F.min("uid").alias("hub"), F.max("uid").alias("_last")).where("hub < _last")
        .select(F.col("key").alias("_key"), "hub")
    )
    edges = keys.join(small(hubs, 200_000), F.col("key") == F.col("_key")).where("uid <> hub")
    found = components(edges.select(F.col("uid").alias("a"), F.col("hub").alias("b")))
    return settle(found.select(F.col("id").alias("uid"), F.col("root").alias("cluster")))


Decide = Callable[[pa.Table, np.ndarray, np.ndarray], list[tuple[int, int]]]


def _decided(rows: DataFrame, decide: Decide) -> DataFrame:
    """``a``, ``b``: what ``decide`` joins in each ``part`` of ``rows``. It gets the part's rows, the root that each has
    so far, and its side: rows of side 1 have met each other elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        uids = table["uid"].to_numpy()
        order = np.argsort(uids, kind="stable")  # the same result however rows arrive
        table, uids = table.take(pa.array(order)), uids[order]
        links = decide(table, table["root"].to_numpy(), table["side"].to_numpy())
        a, b = (np.array([uids[x[k]] for x in links], np.int64) for k in (0, 1))
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.groupBy("part").applyInArrow(run, "a long, b long")


def links_in_clusters(rows: DataFrame, keys: DataFrame, size: str, decide: Decide, part: int = PART) -> DataFrame:
    """Settled links (a, b) among ``rows`` (uid and what ``decide`` needs; settled) that share a key of ``keys``.

    Clusters of up to ``part`` bytes by the column ``size`` are decided in one task, many to a task. The rows of
    a larger one are first held against the one with most keys, in blocks: near copies of one text are all
    joined by that. Then blocks of the rows that are not joined to the largest group of the cluster meet
    all its blocks, and each other; only rows with different roots are still compared."""
    members = rows.join(clustered(keys), "uid")
    members = settle(members)
    sizes = settle(members.groupBy(F.col("cluster").alias("_c")).agg(F.sum(size).alias("_bytes")))
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(1, -(-total // part))
    crowded = sizes.where(F.col("_bytes") > part)
    plain = members.join(small(settle(crowded.select("_c")), 200_000), F.col("cluster") == F.col("_c"), "left_anti")
    own = [F.col("uid").alias("root"), F.lit(0).alias("side")]
    links = _decided(plain.select(
        "*", *own, F.pmod(F.xxhash64("cluster"), F.lit(parts)).alias("part")), decide)
    if not crowded.limit(1).count():
        return settle(links)
    # the larger ones: first all of a cluster against its centre
    half = part // 2
    large = settle(members.join(small(crowded, 200_000), F.col("cluster") == F.col("_c")).drop("_c"))
    degrees = keys.join(large.select(F.col("uid").alias("_u"), "cluster"), F.col("uid") == F.col("_u")).groupBy(
        "cluster", "uid").agg(F.count(F.lit(1)).alias("n"))
    centres = settle(degrees.groupBy(F.col("cluster").alias("_k")).agg(F.max(F.struct("n", "uid")).alias("x")).select(
        "_k", F.col("x.uid").alias("centre")))
    blocks = F.ceil(F.col("_bytes") / half).cast("int")
    block = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    centred = large.join(small(centres, 200_000), F.col("cluster") == F.col("_k"))
    is_centre = F.col("uid") == F.col("centre")
    with_centre = centred.select(
        *rows.columns, F.col("uid").alias("root"), F.when(is_centre, 0).otherwise(1).alias("side"), "cluster",
        F.explode(F.when(is_centre, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))).alias("_b"),
    )
    star = settle(_decided(with_centre.withColumn("part", F.xxhash64("cluster", "_b")).drop("cluster", "_b"), decide))
    roots = settle(components(star).select(F.col("id").alias("_id"), "root"))
    known = settle(large.join(roots, F.col("uid") == F.col("_id"), "left").select(
        *rows.columns, "cluster", F.coalesce("root", "uid").alias("root")))
    of_root = known.groupBy("cluster", "root").agg(F.sum(size).alias("n"))
    mains = settle(of_root.groupBy(F.col("cluster").alias("_k")).agg(
        F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n")
    ).select("_k", F.col("x.root").alias("main"), F.col("x.n").alias("_main"), (F.col("n") - F.col("x.n")).alias("_rest")))
    placed = known.join(small(mains, 200_000), F.col("cluster") == F.col("_k")).withColumn(
        "side", (F.col("root") == F.col("main")).cast("int"))
    m, r = (F.greatest(F.lit(1), F.ceil(F.col(c) / half)).cast("int") for c in ("_main", "_rest"))
    place = F.pmod(F.xxhash64("uid", F.lit(3)), F.when(F.col("side") == 1, m).otherwise(r)).cast("int")
    pair = lambda kind, x, y: F.struct(F.lit(kind).alias("k"), x.alias("x"), y.alias("y"))
    meets = F.when(
        F.col("side") == 1, F.transform(F.sequence(F.lit(0), r - 1), lambda j: pair(0, F.col("_p"), j))
    ).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), m - 1), lambda i: pair(0, i, F.col("_p"))),
        F.transform(F.sequence(F.lit(0), r - 1), lambda j: pair(1, F.least(j, F.col("_p")), F.greatest(j, F.col("_p")))),
    ))
    dealt = placed.where("_rest > 0").withColumn("_p", place).withColumn("_m", F.explode(meets)).select(
        *rows.columns, "root", "side", F.xxhash64("cluster", "_m.k", "_m.x", "_m.y").alias("part"))
    return settle(links.unionAll(star).unionAll(_decided(dealt, decide)))
