"""Mixing of sources to target weights by capped water-filling, with built-in column functions only.

A source's target is its weight's share of the mix, clamped at the largest number of epochs; what clamped sources
leave is shared by weight among the others until nothing is above its clamp. A document then is taken a whole
number of times, and once more if it lies in the seeded fraction that makes up the rest of its source's target.

That fraction is a prefix of the source's documents in the order of a seeded hash of id and text. Its end is found without
ordering a source in one task: hash buckets of a few thousand documents are summed, and only the bucket in which the
prefix ends is ordered, after rows equal in id and text have been counted as one. The end is one key for each source, so taking it
to the documents moves no text. Where the prefix ends among equal rows, so many of these are taken that the target is met: they alone
are written out, dealt into lots and numbered there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ordering import BEFORE, WHOLE, cumulate, positions
from ..session import freeze
from .common import WORD, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Documents in a hash bucket, about.
BUCKET = 4000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _source_key() -> Column:
    """Orders sources by code point and null last; never null."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def _place(seed: str) -> Column:
    """A document's place in its source, by a seeded hash of id and text. Rows of one place are equal in both."""
    parts = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text_of().cast("binary"))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(x_source, n_docs, source_size, target) from ``sizes`` (x_source, n_docs, source_size), one row for each source.

    Weights repeat along the order of x_source. Of sources in the order of clamp by weight, one is clamped if the level that the others
    would have, with all before it clamped, lies above its clamp: one pass of running sums finds them all.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = positions(sizes.withColumn("all_of_it", F.lit(1)), ["all_of_it"], [F.col("x_source")])
    ranked = ranked.select("all_of_it", "x_source", "n_docs", "source_size", cycle.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    summed = cumulate(ranked, ["all_of_it"], [F.col("cap") / F.col("weight"), F.col("x_source")], ["cap", "weight", "source_size"])
    whole = F.lit(float(share)) * F.col(WHOLE + "source_size")
    level = (whole - F.col(BEFORE + "cap").cast("double")) / (F.col(WHOLE + "weight") - F.col(BEFORE + "weight"))
    clamped = F.col("cap") <= level * F.col("weight")
    ranked = freeze(summed.select("x_source", "n_docs", "source_size", "weight", "cap", clamped.alias("clamped"), whole.alias("mix_size")), "mix-sources")
    held = ranked.agg(F.max("mix_size").alias("mix_size"), F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).alias("cap"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("free")).first()
    level = (held.mix_size - held.cap) / held.free if held.free else 0.0
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return ranked.select("x_source", "n_docs", "source_size", target.alias("target"))


def _ends(placed: DataFrame, goal: DataFrame) -> DataFrame:
    """(x_source, x_last, x_first, x_split): rows up to x_last are in the prefix, or those before x_first if there is none; x_split has the place
    of equal rows among which it ends, how many of them belong to it, and how many there are."""
    n_buckets = F.ceil(F.col("n_docs") / BUCKET)
    bucket = F.floor(F.conv(F.substring("x_place", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(2.0**32)).alias("bucket")
    placed = placed.join(goal, "x_source").select("x_source", "x_place", "x_size", "x_rest", bucket)
    sums = placed.groupBy("x_source", "bucket").agg(F.sum("x_size").alias("bucket_size"))
    earlier = W.partitionBy("x_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("begins", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    # The prefix ends in the last bucket that begins before the rest is reached.
    last = sums.join(goal, "x_source").where(F.col("begins") <= F.col("x_rest")).groupBy("x_source").agg(
        F.max(F.struct("bucket", "begins")).alias("last")).select("x_source", "last.bucket", "last.begins")
    # Equal rows are counted before the shuffle, so a bucket holds different places only.
    places = placed.join(last, ["x_source", "bucket"]).groupBy("x_source", "bucket", "x_place", "x_size", "x_rest", "begins").agg(F.count(F.lit(1)).alias("n"))
    in_bucket = W.partitionBy("x_source", "bucket").orderBy("x_place").rowsBetween(W.unboundedPreceding, -1)
    places = places.withColumn("begins", F.col("begins") + F.coalesce(F.sum(F.col("x_size") * F.col("n")).over(in_bucket), F.lit(0)))
    # A row belongs to the prefix if half of it at least does.
    reached = F.floor((2 * (F.col("x_rest") - F.col("begins")) - F.col("x_size")) / (2 * F.col("x_size"))) + 1
    fits = F.when(F.col("x_size") == 0, F.when(F.col("begins") <= F.col("x_rest"), F.col("n")).otherwise(0)).otherwise(
        F.greatest(F.least(reached, F.col("n")), F.lit(0)))
    places = places.withColumn("m", fits.cast("long"))
    split = F.struct("x_place", "m", "n")
    return places.groupBy("x_source").agg(
        F.max(F.when(F.col("m") == F.col("n"), F.col("x_place"))).alias("x_last"), F.min("x_place").alias("x_first"),
        F.max(F.when((F.col("m") > 0) & (F.col("m") < F.col("n")), split)).alias("x_split"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``x_more`` for rows of places among which a prefix ends: as many of the equal rows as belong to it.

    The rows are written out with the lot they fall into, lots are counted, and each lot gives its part of what its
    place gives; so a lot is all that has to be in one task.
    """
    lots = F.greatest(F.ceil(F.col("x_split.n") / BUCKET), F.lit(1))
    rows = freeze(rows.withColumn("x_lot", F.monotonically_increasing_id() % lots), "mix-equal-rows")
    sizes = rows.groupBy("x_source", "x_lot").agg(F.count(F.lit(1)).alias("x_in_lot"))
    earlier = W.partitionBy("x_source").orderBy("x_lot").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("x_before", F.coalesce(F.sum("x_in_lot").over(earlier), F.lit(0))).drop("x_in_lot")
    number = F.row_number().over(W.partitionBy("x_source", "x_lot").orderBy("x_lot"))
    numbered = rows.join(sizes, ["x_source", "x_lot"]).withColumn("x_number", number)
    return numbered.withColumn("x_more", F.col("x_before") + F.col("x_number") <= F.col("x_split.m"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, source, text, any others) with size, source_size, target, copies and taken (size * copies).

    Sizes are numbers of words; a null or empty text has size 0. Sources in code point order, null last as a source
    of its own, weigh ``weights`` in turn and share ``share`` times all words; no source is taken more than ``max_epochs``
    times. The words taken of a source miss its target by half a document at most. Of rows equal in id and text as many are taken once more
    than the others as the target asks for; which of them is left open. Texts of any length count whole. Columns of
    ``docs`` that bear one of the new names are replaced, all others come through as they are. An empty table gives an empty result.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    kept = docs.drop(*names)
    keys = {"x_source": _source_key(), "x_size": size_of(text_of()), "x_place": _place(seed)}
    sized = freeze(docs.select(*[c.alias(k) for k, c in keys.items()]), "mix-sizes")
    per_source = sized.groupBy("x_source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("x_size").alias("source_size"))
    goal = targets(per_source, weights, share, max_epochs)
    goal = goal.withColumn("x_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = freeze(goal.withColumn("x_rest", F.col("target") - F.col("x_whole") * F.col("source_size")), "mix-goals")
    goal = freeze(goal.join(_ends(sized, goal), "x_source", "left"), "mix-ends")

    # The row of a document is kept in a column of its own: its columns may bear any names.
    rows = kept.select(F.struct("*").alias("x_row"), *[c.alias(k) for k, c in keys.items()])
    joined = rows.join(goal.drop("n_docs"), "x_source")
    more = (F.col("x_rest") > 0) & F.coalesce(F.col("x_place") <= F.col("x_last"), F.col("x_place") < F.col("x_first"), F.lit(False))
    if goal.where("x_rest > 0 AND x_split IS NOT NULL").isEmpty():
        joined = joined.withColumn("x_more", more)
    else:
        split = F.coalesce((F.col("x_rest") > 0) & (F.col("x_place") == F.col("x_split.x_place")), F.lit(False))
        joined = joined.where(~split).withColumn("x_more", more).unionByName(_numbered(joined.where(split)).select(*joined.columns, "x_more"))
    copies = F.col("x_whole") + F.col("x_more").cast("int")
    return joined.select("x_row.*", F.col("x_size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("x_size") * copies).alias("taken"))
