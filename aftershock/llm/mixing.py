"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight. Taking the documents of a source in ascending order
of their keys is weighted sampling without replacement. A source's target is met by complete epochs first; the rest
is a prefix of that order whose sizes add up to what is left. Documents are range-placed in that order, sums over the ranges tell in
which one a source's prefix ends, and only that range is put in order; it ends at one document per source, by which
every document knows whether it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged

#: Weights of the sources in ascending order of their names, repeating.
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)
#: Size of the mix relative to all documents, and how often a source may be repeated.
SHARE = 1.5
EPOCHS = 2
SEED = 17
#: Documents in one range, on average at most.
RANGE_ROWS = 500_000
#: Sources in one broadcast; beyond that the join is left to Spark.
BROADCAST_ROWS = 100_000


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Weight in (0, 1]: highest for texts whose words are on average as long as those of prose."""
    mean = F.length(text) / F.greatest(word_count(text), F.lit(1))
    return F.coalesce(1.0 / (1.0 + F.abs(mean - 6.0)), F.lit(1.0))


def sampling_key(weight: Column, seed: int = SEED) -> Column:
    """Exponential key of the document over its weight; the same in every run."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def _about(seed: int) -> list[Column]:
    """Source, size and place in the order of the source: key and hash of the text."""
    return [
        F.col("source").alias("__source"),
        word_count().alias("__size"),
        sampling_key(quality_weight(), seed).alias("__key"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__tie"),
    ]


def _sized(documents: DataFrame, seed: int, *keep: Column) -> DataFrame:
    """``keep``, source, size and place of each document, and a number that tells equal ones apart.

    Written once, so that the numbers stay.
    """
    return staged(documents.select(*keep, *_about(seed), F.monotonically_increasing_id().alias("__nth")), "sized")


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Targets of the sources: ``__source, source_size, rows`` -> the same with ``target``.

    Shares are by weight; a target stops at ``epochs`` times its source's size and what is above is shared again among the
    others. In ascending order of (limit / weight) the stopped sources come first, and the level of all others is
    the highest level that any split into stopped and other sources gives.
    """
    name = Window.orderBy(F.col("__source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("__rank", F.row_number().over(name)).withColumn(
        "__w", F.element_at(cycle, ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("__limit", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("__limit") / F.col("__w"), "__rank")
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every) * float(share)
        - F.coalesce(F.sum("__limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        weighed.withColumn("__level", level)
        .withColumn("__level", F.max("__level").over(every))
        .withColumn("target", F.least("__limit", F.col("__level") * F.col("__w")))
        .drop("__rank", "__w", "__limit", "__level")
    )


def _cuts(sized: DataFrame, **options) -> DataFrame:
    """Per source: ``__name, source_size, target, epochs`` and ``__cut``, the last document that comes once more."""
    spark = sized.sparkSession
    sizes = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    targets = source_targets(sizes, **options)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = staged(
        targets.withColumn("epochs", full.cast("long")).withColumn(
            "__rest", F.col("target") - F.col("epochs") * F.col("source_size")
        ),
        "targets",
    )
    state = targets.agg(F.count(F.lit(1)).alias("sources"), F.sum("__rows").alias("rows")).first()
    few = state.sources <= BROADCAST_ROWS
    named = targets.select(F.col("__source").alias("__name"), "__rest")
    named = F.broadcast(named) if few else named
    same = F.col("__source").eqNullSafe(F.col("__name"))
    # ranges follow the keys as they are distributed; a range has one source, or all of it that is there
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(state.rows or 0) // RANGE_ROWS))
    place = ["__key", "__tie", "__nth"]
    placed = staged(
        sized.select("__source", *place, "__size")
        .repartitionByRange(ranges, "__source", *place)
        .withColumn("__range", F.spark_partition_id()),
        "ranges",
    )
    sums = placed.groupBy("__source", "__range").agg(F.sum("__size").alias("__in"), F.max(F.struct(*place)).alias("__last"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0))).join(named, same).drop("__name")
    sums = staged(sums, "sums")
    whole = sums.where("__before + __in <= __rest").select("__source", "__last")
    # the range in which the rest is used up; only its documents are put in order
    split = sums.where("__before <= __rest and __before + __in > __rest").select(
        F.col("__source").alias("__name"), F.col("__range").alias("__at"), "__before", "__rest"
    )
    split = F.broadcast(split) if few else split
    ordered = Window.partitionBy("__source").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    part = (
        placed.join(split, same & (F.col("__range") == F.col("__at")))
        .withColumn("__middle", F.col("__before") + F.coalesce(F.sum("__size").over(ordered), F.lit(0)) + F.col("__size") / 2)
        .where("__middle <= __rest")
        .select("__source", F.struct(*place).alias("__last"))
    )
    last = whole.unionByName(part).groupBy("__source").agg(F.max("__last").alias("__cut"))
    last = last.withColumnRenamed("__source", "__name")
    return staged(
        targets.join(last, same, "left").select(F.col("__source").alias("__name"), "source_size", "target", "epochs", "__cut"),
        "cuts",
    )


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    small = F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts
    return rows.join(small, F.col("__source").eqNullSafe(F.col("__name")))


def _with_times(rows: DataFrame, cuts: DataFrame, *place: str) -> DataFrame:
    inside = F.struct(*place) <= F.struct(*[F.col(f"__cut.{c}").alias(c) for c in place])
    return _with_cuts(rows, cuts).withColumn("__times", F.col("epochs") + F.when(inside, 1).otherwise(0))


def mix(documents: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """How much the mix takes of each document: doc_id, size, source_size, target, taken.

    A row for each row of ``documents``. A null text has size 0 and is taken 0 times its size; a null source is a source
    of its own, the last; sources of size 0 have target 0. Rows that share a doc_id, or have none, go by the hashes of
    their texts; equal rows are each taken on their own, and which of them does not matter. The part of a source beyond complete
    epochs ends with the document whose middle is the last before the target, so it is off by half a document at most.
    Other columns are ignored, no rows give no rows.
    """
    prepare(documents.sparkSession)
    sized = _sized(documents, seed, F.col("doc_id").alias("__doc"))
    return _with_times(sized, _cuts(sized, **options), "__key", "__tie", "__nth").select(
        F.col("__doc").alias("doc_id"),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("__times")).cast("long").alias("taken"),
    )


def mixed_documents(documents: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``documents``. Rows of no words go.

    Only sizes and keys are moved for it. Where a source's part ends among equal documents, their numbers have to be the same
    each time they are read, and the documents are then written once with them.
    """
    prepare(documents.sparkSession)
    sized, row = _sized(documents, seed), F.struct("*").alias("__row")
    cuts = _cuts(sized, **options)
    alike = "__key = __cut.__key and __tie = __cut.__tie and __nth <> __cut.__nth"
    if _with_cuts(sized, cuts).where(alike).isEmpty():
        taken = _with_times(documents.select(row, *_about(seed)), cuts, "__key", "__tie")
    else:
        sized = _sized(documents, seed, row)
        taken = _with_times(sized, _cuts(sized, **options), "__key", "__tie", "__nth")
    taken = taken.where("__times > 0 and __size > 0")
    return taken.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int")))).select("__row.*")
