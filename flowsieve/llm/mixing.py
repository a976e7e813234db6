"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size enters floor(r) times as a whole; these copies are certain.
The rest of the target is a sample of fixed size, measured in words: every document has inclusion odds
(the source's residual odds times the document's own `odds`), and documents are ranked by the odds of
a uniform draw divided by their inclusion odds (Rosen's Pareto order). The documents of lowest rank
are taken up to the residual target. One more document, the one whose size is nearest to the gap that is left,
closes the sample, so that a source's words end next to its target.

The cut of the order is found by digits: three histograms of 256 bins narrow it to a 2^-24 part of the
order, and only the ranks inside that part are sorted. No source is ever sorted or collected whole,
and texts aren't shuffled: a document's decision is a comparison with its source's row.

Cases with a defined result: a null source is a source of its own and comes last; a null text or one
without words has size 0 and takes nothing; rows equal in id and text share their draw and are chosen
together; an empty table gives an empty result. Columns of the input with the names of the added ones
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import held_small, uniform, word_count
from flowsieve.session import settle

#: One row per source passes through one task when targets are shared out; more sources are refused.
MAX_SOURCES = 200_000
DIGITS, BINS = 3, 256


def targets(sizes: DataFrame, source: str, size: str, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight, none above `cap` times its source.

    Sources take the weights in code point order, null last. A source is full when the common level
    times its weight passes its cap; the level is found over the sources in the order in which they fill.
    """
    per = settle(sizes.groupBy(source).agg(F.sum(size).alias("source_size")))
    if per.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = Window.orderBy(F.col(source).asc_nulls_last())
    at = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("double"))
    per = per.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    filling = Window.orderBy((F.col("_cap") / F.col("_w")), F.col(source).asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (per.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
           .withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
           .withColumn("_level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("_full")) / F.col("_open")))
    # the first source in filling order that the level doesn't fill gives the level of all later ones
    per = per.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.min(F.when(F.col("_fits"), F.struct((F.col("_cap") / F.col("_w")).alias("k"), F.col("_level").alias("level"))))
    per = per.withColumn("_level", level.over(whole)["level"])
    target = F.coalesce(F.least(F.col("_level") * F.col("_w"), F.col("_cap")), F.col("_cap"))
    return per.select(source, "source_size", target.alias("target"))


def pareto_rank(draw: Column, odds: Column) -> Column:
    """Odds of the draw over the inclusion odds, mapped to [0, 1) in the same order."""
    ratio = draw / (F.lit(1.0) - draw) / odds
    return ratio / (F.lit(1.0) + ratio)


def _cuts(ranked: DataFrame, per_source: DataFrame) -> DataFrame:
    """(_source, cut, closing): ranks up to `cut` are in the sample, and so is the rank `closing`.

    `ranked` has (_source, rank, size), `per_source` has (_source, residual), both null-safe keys.
    """
    state = per_source.select("_source", "residual", F.lit(0).cast("long").alias("prefix"),
                              F.lit(0).cast("long").alias("below"))
    by_source = Window.partitionBy("_source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    position = F.floor(F.col("rank") * F.lit(float(BINS ** DIGITS))).cast("long")
    for level in range(1, DIGITS + 1):
        width = BINS ** (DIGITS - level)
        inside = (ranked.join(F.broadcast(state), "_source")
                  .withColumn("_at", F.floor(position / F.lit(width)).cast("long"))
                  .filter(F.floor(F.col("_at") / F.lit(BINS)) == F.col("prefix")))
        bins = (inside.groupBy("_source", "residual", "below", F.col("_at").alias("digit"))
                .agg(F.sum("size").alias("words"))
                .withColumn("start", F.col("below") + F.coalesce(F.sum("words").over(by_source), F.lit(0))))
        # the last bin that starts at or below the residual holds the cut
        state = settle(bins.filter("start <= residual").groupBy("_source", "residual")
                       .agg(F.max(F.struct("digit", "start")).alias("m"))
                       .select("_source", "residual", F.col("m.digit").alias("prefix"), F.col("m.start").alias("below")))
        state = F.broadcast(state)
    last = (ranked.join(state, "_source").filter(position == F.col("prefix"))
            .groupBy("_source", "residual", "below", "rank").agg(F.sum("size").alias("words")))
    run = Window.partitionBy("_source").orderBy("rank")
    last = last.withColumn("upto", F.col("below") + F.sum("words").over(run))
    inner = last.filter("upto <= residual").groupBy("_source").agg(
        F.max("rank").alias("_in"), F.max("upto").alias("_upto"))
    edge = F.col("prefix").cast("double") / F.lit(float(BINS ** DIGITS))
    cuts = settle(state.join(F.broadcast(inner), "_source", "left").select(
        "_source", "residual", F.coalesce("_in", edge).alias("cut"),
        F.col("_in").isNotNull().alias("closed"), F.coalesce("_upto", "below").alias("words")))
    # rank `cut` itself belongs to the sample only when it was reached inside the last bin
    out = F.when(F.col("closed"), F.col("rank") > F.col("cut")).otherwise(F.col("rank") >= F.col("cut"))
    gap = F.abs(F.col("residual") - F.col("words") - F.col("more"))
    closing = (ranked.join(F.broadcast(cuts), "_source").filter(out)
               .groupBy("_source", "residual", "words", "rank").agg(F.sum("size").alias("more"))
               .filter(gap < F.abs(F.col("residual") - F.col("words")))
               .groupBy("_source").agg(F.min_by("rank", F.struct(gap, F.col("rank"))).alias("closing")))
    return cuts.join(F.broadcast(closing), "_source", "left").select("_source", "cut", "closed", "closing")


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, *, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", odds: Column | None = None, seed: int = 7) -> DataFrame:
    """The documents with size, source_size, target, copies and taken (size times copies).

    `odds` are a document's own inclusion odds relative to its source's, any positive expression over
    the columns and `size`; by default they grow with the logarithm of the size, so that fragments come last.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    odds = F.log(F.lit(2.0) + F.col("size")) if odds is None else odds
    # a struct is never null, so it is a join key that keeps a null source apart
    rank = pareto_rank(uniform(doc_id, text, seed=seed), odds)
    sized = docs.withColumn("size", word_count(text)).withColumn("_rank", rank).withColumn("_source", F.struct(F.col(source)))
    ranked = settle(sized.select(F.col(source).alias("_name"), "_source", F.col("_rank").alias("rank"), "size"))
    goal = targets(ranked, "_name", "size", weights, share, cap).withColumn("_source", F.struct(F.col("_name").alias(source)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = settle(goal.drop("_name").withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("int"))
                  .withColumn("residual", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    cuts = _cuts(ranked.drop("_name").filter("size > 0"), goal.filter("residual > 0"))
    plan = held_small(goal.join(F.broadcast(cuts), "_source", "left"))
    chosen = F.coalesce((F.col("_rank") < F.col("cut")) | (F.col("closed") & (F.col("_rank") == F.col("cut"))), F.lit(False))
    chosen = (chosen | F.coalesce(F.col("_rank") == F.col("closing"), F.lit(False))) & (F.col("size") > 0)
    return (sized.join(plan, "_source")
            .withColumn("copies", F.col("whole") + chosen.cast("int"))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .drop("_source", "_rank", "whole", "residual", "cut", "closed", "closing"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was taken."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter("copies > 0").withColumn("_copy", copies).drop("_copy")
