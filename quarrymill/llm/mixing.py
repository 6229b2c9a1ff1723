"""Operator 8: mix sources to target weights (``plan_mix``, ``mix``).

Sizes are aggregated per source, targets are filled up under a cap, and every document gets ``floor(rate)`` copies plus
one more with probability ``rate - floor(rate)``. Whether it does is decided by a hash of its id and the source's seed: a
seed names one of four 32-bit parts of the hash and one of sixteen turns that are added to it. Every source takes the
seed whose draws bring its words nearest to the target (ties: the smallest seed). One aggregation has all seeds' totals.

Defined results: a null text has size 0; very long texts are counted whole; a null source is a source of its own and
comes last; a null id is hashed like the empty string; rows with equal ids make the same draw; a source without words
has no copies; an empty table gives an empty plan. ``plan_mix`` gives only its own columns; ``mix`` gives back the input's
columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, written

#: Seeds that a source chooses from: parts of the hash times turns.
PARTS, TURNS = 4, 16
SEEDS = PARTS * TURNS
_STEP = 2**32 // TURNS
#: The table of sources is broadcast up to so many rows (each a name and a few numbers), else joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``(source, size)`` rows to ``(source, source_size, target)``: one row per source.

    Sorted by ``cap * size / weight``, the first sources are at their cap and the rest share what is left by weight.
    The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight.cast("long"))
    per = per.withColumn("most", F.col("source_size") * cap)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", F.col("left_size") * F.col("weight") <= F.col("most") * F.col("left_weight"))
        .withColumn("level", F.when(F.col("open"), F.col("left_size").cast("double") / F.col("left_weight")))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("most").cast("double"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _draws(doc_id: Column, seed: str) -> Column:
    """The hash of an id as an array of 32-bit numbers."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(PARTS)])


def _share(rate: Column) -> Column:
    """How many of the 2^32 draws give one more copy."""
    return F.ceil((rate - F.floor(rate)) * F.lit(2.0**32)).cast("long")


def _copies() -> Column:
    turned = F.pmod(F.get("draws", F.floor(F.col("seed") / TURNS).cast("int")) + F.col("seed") % TURNS * _STEP, F.lit(2**32))
    return (F.floor("rate") + (turned < _share(F.col("rate"))).cast("long")).cast("long")


def _seeds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the rate and the seed whose draws come nearest to the target.

    With draw d a document has its extra copy for the turns from -d / step on, as many as its share of draws allows: its
    size is added where that range of turns starts and taken away where it ends, and running sums give the totals.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = targets.withColumn("rate", rate)
    each = sized.filter("size > 0").join(_bounded(rated.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))

    def step(part: Column, turn: Column, n: Column) -> Column:
        return F.struct(part.cast("long").alias("part"), turn.cast("long").alias("turn"), n.cast("long").alias("n"))

    def steps(draw: Column, part: Column) -> Column:
        first = F.pmod(F.lit(TURNS) - F.floor(draw / _STEP), F.lit(TURNS))
        last = first + F.greatest(F.lit(0), F.ceil((_share(F.col("rate")) - draw % _STEP) / _STEP))
        always, again = step(part, F.lit(0), F.col("size") * F.floor("rate")), step(part, F.lit(0), F.col("size"))
        start, end = step(part, first, F.col("size")), step(part, last % TURNS, -F.col("size"))
        return F.when(last == first, F.array(always)).when(last < TURNS, F.array(always, start, end)).when(last == TURNS, F.array(always, start)).otherwise(F.array(always, start, again, end))

    added = each.select("of", "target", F.inline(F.flatten(F.transform("draws", steps)))).groupBy("of", "part", "turn").agg(F.sum("n").alias("n"), F.max("target").alias("target"))
    # At most SEEDS rows a source; between them the total stays as it is.
    total = F.sum("n").over(Window.partitionBy("of", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seed = F.col("part") * TURNS + F.col("turn")
    nearest = added.withColumn("off", F.abs(total - F.col("target"))).groupBy("of").agg(F.min(F.struct("off", seed.alias("seed")))["seed"].alias("seed"))
    return rated.join(nearest, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("seed", F.coalesce("seed", F.lit(0).cast("long")))


def _bounded(sources: DataFrame) -> DataFrame:
    """The table of sources, broadcast if it is small."""
    if len(rows := sources.take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        return F.broadcast(sources.sparkSession.createDataFrame(rows, sources.schema))
    return sources


def _source_plan(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """``sized`` (source, size, draws) to a row per source: of, source_size, target, rate and seed."""
    targets = written(source_targets(sized.select("source", "size"), weights, cap), "targets")
    return _bounded(written(_seeds(sized, targets), "sources").withColumnRenamed("source", "of"))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draws(F.col("doc_id"), seed).alias("draws")), "sized")


def plan_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, ...) to doc_id, source, size, source_size, target, rate and copies; a text is read once."""
    sized = _sized(docs, seed)
    plan = sized.join(_source_plan(sized, weights, cap), F.col("source").eqNullSafe(F.col("of")))
    return plan.select("doc_id", "source", "size", "source_size", "target", "rate", _copies().alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed rows: every row of ``docs`` as often as the plan says, with its own columns."""
    sources = _source_plan(_sized(docs, seed), weights, cap)
    rows = docs.select(F.struct("*").alias("row"), _draws(docs["doc_id"], seed).alias("draws"))
    copied = rows.join(sources, F.col("row.source").eqNullSafe(F.col("of"))).select("row", _copies().alias("copies")).filter("copies > 0")
    return copied.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
