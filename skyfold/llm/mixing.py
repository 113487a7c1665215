"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source wants a share of the word budget in proportion to its weight and
may be repeated ``max_epochs`` times at most.  The excess of a source at its cap
goes to the others by weight until none is above its cap.  That fixed point is
the water level L at which sum(min(cap, weight * L)) is the budget; it follows
from running sums in the order in which sources fill up, without iteration.

A source's target then makes whole repetitions of all its documents and a rest.
The rest is a seeded sample: documents in the order of a hash of their id until
the rest is used up; the last one gives its first words only.  So the words
taken equal the rounded target, however long the documents are.  A sum for each
(source, 1/4096 of the hashes) locates the cut, and only documents in the one
slice that holds it are ever sorted, so a source with a third of all rows costs
one map-side sum and a slice of 1/4096 of it.

Defined results: a null or blank text has size 0 and is taken 0 times; a null
source is a source of its own, the last; rows that repeat count as documents of
their own; an empty table gives an empty table; of columns named like the added
ones, the added ones remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "whole", "extra", "taken")
#: A table of sources up to this many rows is broadcast (about 60 bytes a row).
BROADCAST_SOURCES = 20_000
#: Beyond that, each source's row is repeated for so many parts of its documents.
SALTS = 64
SLICES_LOG2 = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_order(doc_id: Column, seed: str) -> Column:
    """60 bits of MD5 of seed and id: the order of the sample."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_levels(sources: DataFrame, pattern=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) -> plus ``target``, in words.

    Weights repeat ``pattern`` over the sources by code point, null last.  The
    windows have one partition: there is a row for each source of the mix.
    """
    whole = Window.partitionBy()
    s = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), ((F.col("rank") - 1) % len(pattern) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("weights", F.sum("weight").over(whole))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0.0))
    s = s.withColumn("full", (F.col("budget") - before("cap")) * F.col("weight") >= F.col("cap") * (F.col("weights") - before("weight")))
    of_full = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(whole)
    s = s.withColumn("cap_full", of_full("cap")).withColumn("weight_full", of_full("weight"))
    level = F.col("weight") * (F.col("budget") - F.col("cap_full")) / (F.col("weights") - F.col("weight_full"))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level).alias("target"))


def mix_sources(docs: DataFrame, pattern=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix:") -> DataFrame:
    """``docs`` with size, source_size, target, whole (repetitions), extra (words of the fractional one) and taken."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    # Other columns travel under numbers, so that none has a name of a step here.
    own = {c: c if c in ("doc_id", "text", "source") else f"__own_{k}" for k, c in enumerate(docs.columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    d = docs.withColumn("size", word_count(F.col("text"))).withColumn("__h", hash_order(F.col("doc_id"), seed))
    d = d.withColumn("__slice", F.shiftright("__h", 60 - SLICES_LOG2).cast("int"))
    slices = materialise(d.groupBy("source", "__slice").agg(F.sum("size").alias("words")))
    targets = water_levels(slices.groupBy("source").agg(F.sum("words").alias("source_size")), pattern, share, max_epochs)
    goal = F.round("target").cast("long")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("__rest", goal - F.col("whole") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    s = slices.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).withColumnRenamed("source", "__s")
    s = s.join(targets.select(F.col("source").alias("__t"), "__rest"), F.col("__s").eqNullSafe(F.col("__t")))
    cut = s.groupBy("__s").agg(F.min(F.when(F.col("before") + F.col("words") > F.col("__rest"), F.struct("__slice", (F.col("__rest") - F.col("before")).alias("left")))).alias("cut"))
    plan = cut.join(targets, F.col("__s").eqNullSafe(F.col("source"))).select("__s", "source_size", "target", "whole", F.coalesce(F.col("cut.__slice"), F.lit(-1)).alias("__cut"), F.coalesce(F.col("cut.left"), F.lit(0)).alias("__left"))
    plan = materialise(plan)
    if plan.count() <= BROADCAST_SOURCES:
        d = d.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__s")), "left")
    else:
        salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("__salt", "__part")
        d = d.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int"))
        d = d.join(salted, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__salt") == F.col("__part")), "left")
    at_cut = F.col("__slice") == F.col("__cut")
    order = Window.partitionBy("source").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_slice = d.filter(at_cut).withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    sorted_slice = sorted_slice.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - F.col("__before"))).cast("long"))
    others = d.filter(~at_cut).withColumn("extra", F.when(F.col("__slice") < F.col("__cut"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    out = others.select(*docs.columns, *ADDED[:5]).unionByName(sorted_slice.select(*docs.columns, *ADDED[:5]))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], *ADDED[:5], (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixture(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each repetition (``repeat`` from 1); a last partial one has the text's first ``extra`` words."""
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    times = F.when(F.col("taken") > 0, F.col("whole") + (F.col("extra") > 0).cast("long")).otherwise(F.lit(0)).cast("int")
    rows = mixed.drop("repeat").withColumn("repeat", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(F.col("extra"), F.lit(1)).cast("int")), " ")
    return rows.withColumn("text", F.when(partial & (F.col("repeat") > F.col("whole")), first).otherwise(F.col("text")))
