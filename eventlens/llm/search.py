"""Exact top-k search by inner product: cells by median splits, with a KD-tree in every shard of a cell."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.llm.common import settle

FOUND = "query_uid long, query_id long, vec_id long, score long"
#: At home a shard also tells its box: a row without a query.
HOME = FOUND + ", cell int, low array<double>, high array<double>"
#: Cells, and entries of the sample that they are fitted on and of all their boxes, at most.
MOST_CELLS, MOST_ENTRIES = 4096, 4_000_000
#: Sums of whole numbers up to here are exact in floating point; beyond, Python's own integers are used.
EXACT = 2.0**53
LARGEST = 2**63 - 1


class KdTree:
    """Median splits on the widest side, down to leaves of ``leaf`` rows, each node with its tight box."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(points))
        self.points, self.ids = points, ids
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.least: list[int] = []
        waiting = [(0, len(points), -1, 0)]
        while waiting:
            lo, hi, parent, side = waiting.pop()
            rows = self.order[lo:hi]
            inside = points[rows]
            node = len(self.span)
            self.low.append(inside.min(axis=0))
            self.high.append(inside.max(axis=0))
            self.span.append((lo, hi))
            self.children.append(None)
            self.least.append(int(ids[rows].min()))
            if parent >= 0:
                own = self.children[parent] or (-1, -1)
                self.children[parent] = (node, own[1]) if side == 0 else (own[0], node)
            if hi - lo > leaf:
                widths = self.high[node] - self.low[node]
                axis = int(widths.argmax()) if len(widths) else 0
                middle = (hi - lo) // 2
                if len(widths):
                    self.order[lo:hi] = rows[np.argpartition(inside[:, axis], middle)]
                waiting.append((lo + middle, hi, node, 1))
                waiting.append((lo, lo + middle, node, 0))
        self.points, self.ids = points[self.order], ids[self.order]
        self.low_of, self.high_of = np.array(self.low), np.array(self.high)


def floored(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """floor(64 * x) of each vector, as whole numbers in floating point."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.floor(64.0 * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = np.array([len(v) for v in values], np.int64)
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def by_length(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    lengths = np.array([len(v) for v in vectors], np.int64)
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


class Cells:
    """Median splits of a sample into about ``cells`` parts of equal size, a tree for each length of vectors. A cell
    is named by its leaf; vectors of a length that the sample lacks are all in cell -1."""

    def __init__(self, sample: list[np.ndarray], cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # side (-1 in a leaf), first value on the right, children
        self.roots = {}
        for length, at in by_length(sample).items():
            share = max(1, round(cells * len(at) / len(sample)))
            self.roots[length] = self._grow(np.array([sample[i] for i in at]), share)
        columns = list(zip(*self.nodes)) or [()] * 4
        self.side, self.left, self.right = (np.array(columns[i], np.int64) for i in (0, 2, 3))
        self.first = np.array(columns[1], np.float64)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        node = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1))
        widths = np.ptp(points, axis=0)
        if cells < 2 or widths.max(initial=0) == 0:
            return node
        side = int(widths.argmax())
        column = points[:, side]
        middle = len(column) * (cells // 2) // cells
        first = np.partition(column, middle)[middle]
        if first == column.min():
            first = column[column > first].min()
        left = self._grow(points[column < first], cells // 2)
        right = self._grow(points[column >= first], cells - cells // 2)
        self.nodes[node] = (side, float(first), left, right)
        return node

    def of(self, vectors: list[np.ndarray]) -> np.ndarray:
        found = np.full(len(vectors), -1, np.int64)
        for length, at in by_length(vectors).items():
            if length not in self.roots:
                continue
            points = np.array([vectors[i] for i in at])
            node = np.full(len(at), self.roots[length], np.int64)
            while (inner := np.flatnonzero(self.side[node] >= 0)).size:
                now = node[inner]
                below = points[inner, self.side[now]] < self.first[now]
                node[inner] = np.where(below, self.left[now], self.right[now])
            found[at] = node
        return found


def reaching(
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], vectors: list[np.ndarray], kth: np.ndarray,
) -> list[np.ndarray]:
    """For each query the cells whose box allows an inner product of at least ``kth`` (nan: all of its length).
    ``boxes`` has the cells of each length with their lower and upper corners. Bounds are rounded up by far more
    than the error of their sums, and one that overflows keeps its cell."""
    found = [np.array([-1])] * len(vectors)
    for length, at in by_length(vectors).items():
        if length not in boxes:
            continue
        names, low, high = boxes[length]
        queries = np.array([vectors[i] for i in at])
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
            bound += 1e-12 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)
            reached = ~(bound < kth[at, None])
        for i, row in zip(at, reached):
            found[i] = names[row]
    return found


def nearest(
    tree: KdTree, uids: np.ndarray, queries: np.ndarray, own: np.ndarray, worst: list[tuple | None], k: int,
) -> Iterator[list[tuple[int, int, int]]]:
    """For each query the best of the tree's rows as (-score, id, uid), best first, without its own row and
    without rows behind ``worst``, the k-th that the query has found elsewhere.

    Best first: a heap of nodes by the greatest inner product that their box allows. It ends when that is
    below the k-th score found so far, or equal with larger ids only."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = plus @ tree.high_of.T + minus @ tree.low_of.T
    if bounds.dtype == object:
        bounds = np.minimum(np.maximum(bounds, -LARGEST - 1), LARGEST)
    for q in range(len(queries)):
        bound, query = bounds[q], queries[q]
        best: list[tuple[int, int, int]] = []
        limit = worst[q]  # (-score, id)
        heap = [(-bound[0], 0)]
        while heap:
            above, node = heapq.heappop(heap)
            if limit is not None and (above > limit[0] or (above == limit[0] and tree.least[node] > limit[1])):
                if above > limit[0]:
                    break
                continue
            children = tree.children[node]
            if children is not None:
                for child in children:
                    if limit is None or -bound[child] <= limit[0]:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            lo, hi = tree.span[node]
            scores = tree.points[lo:hi] @ query
            if scores.dtype == object:
                scores = np.minimum(np.maximum(scores, -LARGEST - 1), LARGEST)
            keep = uids[lo:hi] != own[q]
            if limit is not None:
                keep &= -scores <= limit[0]
            rows = np.flatnonzero(keep)
            if not len(rows):
                continue
            if len(rows) > k:
                order = np.lexsort((uids[lo:hi][rows], tree.ids[lo:hi][rows], -scores[rows]))[:k]
                rows = rows[order]
            best += [(-int(scores[r]), int(tree.ids[lo + r]), int(uids[lo + r])) for r in rows]
            best.sort()
            del best[k:]
            if len(best) == k and (limit is None or best[-1][:2] < limit):
                limit = best[-1][:2]
        yield best


def found_in(vectors: pa.Table, queries: pa.Table, k: int, leaf: int) -> pa.Table:
    """The rows that one shard adds for some queries; vectors of different lengths never meet."""
    rows: list[tuple] = []
    ints, asked = floored(vectors["embedding"]), floored(queries["embedding"])
    ids = np.array([LARGEST if v is None else v for v in vectors["vec_id"].to_pylist()], np.int64)
    uids = np.array(vectors["uid"].to_pylist(), np.int64)
    query_ids, own = queries["vec_id"].to_pylist(), np.array(queries["uid"].to_pylist(), np.int64)
    worst = [
        None if s is None else (-s, i) for s, i in zip(queries["kth_score"].to_pylist(), queries["kth_id"].to_pylist())
    ]
    unknown = set(uids[[v is None for v in vectors["vec_id"].to_pylist()]].tolist())
    shards = by_length(ints)
    for length, at in by_length(asked).items():
        if length not in shards:
            continue
        here = shards[length]
        points, wanted = np.array([ints[i] for i in here]), np.array([asked[i] for i in at])
        most = [np.abs(x).max(initial=0) for x in (points, wanted)]
        if max(length, 1) * most[0] * most[1] >= EXACT:
            points, wanted = (np.array([[int(x) for x in row] for row in y], object) for y in (points, wanted))
        tree = KdTree(points, ids[here], leaf)
        ordered = uids[here][tree.order]
        for q, best in zip(at, nearest(tree, ordered, wanted, own[at], [worst[i] for i in at], k)):
            for score, vec_id, uid in best:
                rows.append((int(own[q]), query_ids[q], None if uid in unknown else vec_id, -score))
    columns = list(zip(*rows)) or [()] * 4
    return pa.table(
        [pa.array(c, pa.int64()) for c in columns], ["query_uid", "query_id", "vec_id", "score"]
    )


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 8192, query_rows: int = 4096,
    leaf: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest inner products of each query with all other
    rows (all, if fewer), ties to the smaller vec_id. Components are floor(64 * x).

    Median splits of a sample (at most ``MOST_ENTRIES`` components; it decides where rows lie, not what is found)
    make at most ``MOST_CELLS`` cells. Every row is assigned to its cell, and cells of more than ``shard_rows`` rows,
    those of a very common vector among them, are dealt into shards by a hash. A query first searches its own
    shard. The shards tell their tight boxes, so a cell's box is that of all of its rows; with its k-th score the query
    then goes to the shards of those cells only whose box allows as much, where whole trees fall away by the same
    bound. Queries meet a shard in blocks of about ``query_rows``, each one task's work. Broadcast are the splits, the
    boxes and the sizes of the cells.

    Null vectors and those with null or non-finite components take no part; vectors of other lengths than the
    query's are no candidates; a null vec_id is no query, and as a candidate loses ties; rows with
    equal ids or vectors are rows of their own, of which only the query's own is left out. An empty
    table gives no row; other columns are not looked at. Scores beyond 64 bits count as the nearest 64-bit value.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = (
        embeddings.select("vec_id", "embedding", is_query.alias("is_query"))
        .where(F.col("embedding").isNotNull() & finite)
        .select(
            F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.coalesce("is_query", F.lit(False)).alias("is_query"),
        )
    )
    n, longest = usable.agg(F.count("*"), F.max(F.size("embedding"))).first()
    entries = max(1, MOST_ENTRIES // max(longest or 1, 1))
    wanted = max(1, min(math.ceil(n / shard_rows), MOST_CELLS, entries // 2))
    sample = []
    if wanted > 1:
        size = min(64 * wanted, entries)
        drawn = usable.select("embedding").sample(fraction=min(1.0, size / n), seed=7).limit(2 * size)
        sample = floored(drawn.toArrow()["embedding"])
    cells = Cells(sample, wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(cells.of(floored(batch.column("embedding"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "cell"])

    placed = settle(usable.mapInArrow(deal, "uid long, vec_id long, embedding array<double>, is_query boolean, cell int"))
    sizes = settle(placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn(
        "shard", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    )

    def renewed(*names: str) -> list[Column]:
        return [F.col(c).alias(c) for c in names]  # a cogroup tells its sides apart by their columns

    first = dealt.where("is_query").select(
        *renewed("uid", "vec_id", "embedding", "cell", "shard"), F.lit(None).cast("long").alias("kth_score"),
        F.lit(None).cast("long").alias("kth_id"),
    )

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        return found_in(vectors, queries, k, leaf)

    def meet_at_home(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found, cell = meet(vectors, queries), vectors["cell"][0].as_py()
        ints = floored(vectors["embedding"]) if cell >= 0 else []
        box = [np.array(ints).min(axis=0), np.array(ints).max(axis=0)] if ints else None
        empty = [pa.nulls(len(found), t) for t in (pa.int32(), *[pa.list_(pa.float64())] * 2)]
        for name, column in zip(("cell", "low", "high"), empty):
            found = found.append_column(name, column)
        if box is None:
            return found
        told = dict.fromkeys(found.schema.names, [None]) | {
            "cell": [cell], "low": [box[0].tolist()], "high": [box[1].tolist()],
        }
        return pa.concat_tables([found, pa.table(told, schema=found.schema)])

    home = settle(
        dealt.groupBy("cell", "shard").cogroup(first.groupBy("cell", "shard")).applyInArrow(meet_at_home, HOME)
    )
    found = home.where("query_uid IS NOT NULL").select("query_uid", "query_id", "vec_id", "score")
    if n > shard_rows:
        reached = _reached(dealt, home, found, cells, k)
        blocks = settle(
            reached.select(F.explode("cells").alias("cell")).groupBy("cell")
            .agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        )
        block = F.pmod(F.xxhash64("uid", F.lit(7)), F.col("blocks")).cast("int").alias("block")
        asked = (
            reached.withColumn("cell", F.explode("cells")).join(F.broadcast(sizes.join(blocks, "cell")), "cell")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .where("cell <> home_cell OR shard <> home_shard")
            .select(*renewed("cell", "shard", "uid", "vec_id", "embedding", "kth_score", "kth_id"), block)
        )
        copied = dealt.join(F.broadcast(blocks), "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        )
        keys = "cell", "shard", "block"
        found = found.unionAll(copied.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, FOUND))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _reached(dealt: DataFrame, home: DataFrame, found: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Each query with its k-th score at home and the ``cells`` that it has to go to."""
    corners = (
        home.where("low IS NOT NULL").select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side"))
        .groupBy("cell", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
        .groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box"))
        .select("cell", "box.low", "box.high").toArrow()
    )
    named = dict(zip(corners["cell"].to_pylist(), zip(corners["low"].to_pylist(), corners["high"].to_pylist())))
    boxes = {}
    for length in {len(low) for low, _ in named.values()}:
        names = sorted(c for c, (low, _) in named.items() if len(low) == length)
        boxes[length] = (np.array(names), *(np.array([named[c][side] for c in names]) for side in (0, 1)))
    if 0 in cells.roots:  # a box without sides has no row above
        boxes[0] = (np.array([cells.roots[0]]), np.zeros((1, 0)), np.zeros((1, 0)))
    kth = found.groupBy("query_uid").agg(
        F.count("*").alias("_n"), F.max(F.struct((-F.col("score")).alias("s"), F.coalesce("vec_id", F.lit(LARGEST))
                                                 .alias("i"))).alias("_last")
    ).select(
        "query_uid", F.when(F.col("_n") >= k, -F.col("_last.s")).alias("kth_score"),
        F.when(F.col("_n") >= k, F.col("_last.i")).alias("kth_id"),
    )
    queries = dealt.where("is_query").join(kth, F.col("uid") == F.col("query_uid"), "left").select(
        "uid", "vec_id", "embedding", "kth_score", "kth_id", F.col("cell").alias("home_cell"),
        F.col("shard").alias("home_shard"),
    )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the least 64-bit score stands for all below it too, so no bound excludes it
            scores = [s if s is not None and s > -LARGEST - 1 else math.nan for s in batch.column("kth_score").to_pylist()]
            names = reaching(boxes, floored(batch.column("embedding")), np.array(scores, np.float64))
            column = pa.array([x.tolist() for x in names], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "cells"])

    return settle(queries.mapInArrow(
        go, "uid long, vec_id long, embedding array<double>, kth_score long, kth_id long, home_cell int, home_shard int, "
            "cells array<int>",
    ))
