"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.llm.common import WORD, settle, small

#: Steps of the random order; a step holds a two-thousandth of a source or so.
STEPS = 2048


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column, seed: str) -> Column:
    """A number above 0 and below 1 that depends on the values alone."""
    texts = [F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *texts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def with_sums(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Settled rows with each of ``sums`` over the rows before them in ``order``. Rows are dealt to ranges of the
    order; one window runs over the ranges, which are as many as a shuffle has partitions, and one
    within each range, so no task gets all rows."""
    dealt = settle(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = F.broadcast(
        dealt.groupBy(F.col("_range").alias("_at")).agg(*[F.sum(x).alias(f"_all{n}") for n, x in sums.items()])
        .select("_at", *[F.coalesce(F.sum(f"_all{n}").over(earlier), F.lit(0)).alias(f"_all{n}") for n in sums])
    )
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = {n: F.coalesce(F.sum(x).over(own), F.lit(0)) for n, x in sums.items()}
    kept = [c for c in dealt.columns if c != "_range"]
    return (
        dealt.select("*", *[x.alias(n) for n, x in within.items()]).join(ranges, F.col("_range") == F.col("_at"))
        .select(*kept, *[(F.col(n) + F.col(f"_all{n}")).alias(n) for n in sums])
    )


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From ``source``, ``source_size``: adds ``target``, the words each source gives to a mix that is
    as large as all sources together. Weights go round the sources by code point, null last; no target
    passes ``most`` times its source, and what is above goes to the others by weight.

    With c = most * size / weight, sources of the smallest c are capped; the level at which the rest
    share is found by running sums over ranges of the sources, and is one number."""
    by_name = [F.col("source").isNull(), F.col("source")]
    place = F.pmod(F.col("_place"), F.lit(len(weights)))
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    weighed = settle(
        with_sums(sources, by_name, {"_place": F.lit(1)})
        .withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
        .withColumn("_c", F.col("_cap") / F.col("_w")).drop("_place")
    )
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("_capped")).cast("double") / (F.lit(whole["weight"]) - F.col("_passed"))
    # the level holds from the first source on whose cap is above it
    free = (
        with_sums(weighed, [F.col("_c"), *by_name], {"_capped": F.col("_cap"), "_passed": F.col("_w")})
        .withColumn("_level", level).where("_level <= _c").agg(F.min(F.struct("_c", -F.col("_level"))).alias("x")).first()
    )
    share = F.lit(-free["x"][1] if free["x"] else None).cast("double")
    # without a level, least() leaves the caps
    return weighed.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w") * share)).select(
        "source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "mix",
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies and taken (size * copies).

    A document is expected ``e = target / source_size`` times. It is taken floor(e) times for certain.
    The rest of the target is a sample of fixed size: documents rank by the odds of a uniform number
    over the odds of their inclusion, e - floor(e), and are taken in that order while the words taken,
    half the document included, stay within the rest; so a source misses its target by half
    a document at most. Random numbers come from the rows alone, so reruns agree; equal rows rank
    in any order, which leaves the result the same.

    No source is ordered in one task: ranks fall into ``STEPS`` steps, whose words are summed
    before the shuffle, and only the documents of the step where a source's rest ends are ordered.

    Null and empty texts have size 0 and are never taken; null sources are a source; an empty table
    gives no row. Columns other than doc_id, text and source are not looked at.
    """
    sized = settle(_sized(docs, seed))
    return _mixed(sized, sized, weights, most).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "mix",
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken. Texts are counted once
    for the statistics of the sources, which are settled without them, and once for the decision."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")
    return (
        _mixed(settle(_sized(rows, seed)), _sized(rows, seed, "_row"), weights, most).where("copies > 0")
        .select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
    )


def _sized(docs: DataFrame, seed: str, *more: str) -> DataFrame:
    # both texts with equal ids and sizes are told apart by their content
    return docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"),
        uniform(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))), seed=seed).alias("_u"), *more,
    )


def _mixed(sized: DataFrame, rows: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """Adds source_size, target and copies to ``rows``; ``sized`` are the same rows, settled."""
    sources = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most
    ).withColumn("_e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    sources = small(settle(
        sources.withColumn("_whole", F.floor("_e"))
        .withColumn("_part", F.col("_e") - F.col("_whole"))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumnRenamed("source", "_source")
    ))

    def ranked(of: DataFrame) -> DataFrame:
        odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_part") / (1 - F.col("_part")))
        return (
            of.join(sources, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("_rank", F.when(F.col("_part") > 0, odds))
            # odds to a number from 0 to 1 in the same order
            .withColumn("_step", F.floor(F.col("_rank") / (1 + F.col("_rank")) * STEPS))
        )

    up_to = Window.partitionBy("_source").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        ranked(sized).where("_step is not null").groupBy("_source", "_step")
        .agg(F.sum("size").alias("_words"), F.max("_rest").alias("_rest"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(up_to), F.lit(0)))
    )
    last = small(settle(
        steps.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest")))
        .groupBy("_source").agg(F.min(F.struct("_step", "_before")).alias("_x"))
        .select(F.col("_source").alias("_s"), F.col("_x._step").alias("_last"), F.col("_x._before").alias("_done"))
    ))
    ended = ranked(rows).join(last, F.col("_source").eqNullSafe(F.col("_s")), "left")
    running = (
        Window.partitionBy("_source").orderBy("_rank", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edge = (
        ended.where("_step = _last")
        .withColumn("_sum", F.col("_done") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumn("_more", (F.col("_sum") + F.col("size") / 2 <= F.col("_rest")).cast("int")).drop("_sum")
    )
    clear = ended.where("_step is null or _last is null or _step <> _last").withColumn(
        "_more", F.when(F.col("_step") < F.col("_last"), 1).otherwise(0)
    )
    return clear.unionByName(edge).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("_whole") + F.col("_more")).otherwise(0)
    )
