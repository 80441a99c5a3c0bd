"""What the operators share: reading, settling intermediate tables, connected components."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A word is a maximal run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch, instead of Spark's 10,000: texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Lets Python workers on machines that share this folder import the package from it. On others
    it has to be installed, or sent with the job. Batches of rows to Python are made small, unless
    the session says how large they are to be."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """The same rows, kept in the folder of ``spark.checkpoint.dir``: a lost executor costs no
    recomputation, and what a later step reads twice is the same both times. Only where that
    setting is empty and Spark runs in this process, a temporary folder is taken."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(shared)
    kept = df.checkpoint()
    del df
    # the shuffle files behind what is settled go when its plan is collected, in Python (where it is
    # part of a cycle) and in the JVM: now rather than some day
    gc.collect()
    context._jvm.System.gc()
    return kept


def with_fields(df: DataFrame, names: Sequence[str], more: str) -> T.StructType:
    """The schema of some columns of ``df``, whatever their names and types, and of ``more``, a DDL text."""
    return T.StructType([df.schema[c] for c in names] + T.StructType.fromDDL(more).fields)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, which should be settled, to be broadcast if it has ``most`` rows or fewer, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def bounded(rows: Iterable, size, most: int):
    """Lists of rows of at most ``most`` together by ``size``, one row at least."""
    group, total = [], 0
    for row in rows:
        n = size(row)
        if group and total + n > most:
            yield group
            group, total = [], 0
        group.append(row)
        total += n
    if group:
        yield group


def components(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """The smallest id reachable from each id of ``edges`` (columns ``a``, ``b``): ``id``, ``root``.

    Large-star and small-star steps: every id hooks what it neighbours to the smallest id it knows.
    All steps are a minimum by id and a join with it. The minima are broadcast while there are up to ``most`` links;
    beyond, they are settled first: a join in the stage of its own aggregate cannot be split, this one can, so
    an id with very many neighbours is many tasks. Nothing is collected. Ids without an edge are absent.
    """

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    links = settle(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .where("u < v").distinct()
    )
    before = state(links)
    while True:
        beside = F.broadcast if before[0] <= most else settle
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(links.select("u", "v"))
        smallest = both.groupBy(F.col("x").alias("_x")).agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = (
            both.join(beside(smallest), F.col("x") == F.col("_x")).where("y > x")
            .select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        )
        large = large if before[0] <= most else settle(large)
        lowest = large.groupBy(F.col("v").alias("_v")).agg(F.min("u").alias("m"))
        hooked = (
            large.join(beside(lowest), F.col("v") == F.col("_v"))
            .select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                                      F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.*").where("u < v").distinct()
        )
        links = settle(hooked)
        after = state(links)
        if before == after:
            roots = links.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "id")
            return roots.unionAll(links.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        before = after
