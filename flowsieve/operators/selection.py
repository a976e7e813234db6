"""Exact ranks, caps and quantiles without ordering a whole group in one task.

A histogram with map-side combine shows which small slice of the order holds the wanted rank; only
the rows of that slice are then ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import settle, small_side

DRAWS = 2_147_483_647  # draws are integers in [0, DRAWS)
BUCKETS = 4096


def draw(seed: int, *keys: str) -> Column:
    """Reproducible draw from the row's own key, so that retried tasks repeat it."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(DRAWS))


def _bucket() -> Column:
    return F.floor(F.col("draw") * F.lit(BUCKETS) / F.lit(DRAWS)).cast("int")


def _slices(rows: DataFrame, group: list[str], ranks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The asked ranks beside every bucket of the histogram, and per rank its bucket and place there."""
    counts = settle(rows.groupBy(*group, _bucket().alias("bucket")).agg(F.count("*").alias("in_bucket")))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.withColumns({
        "below": F.coalesce(F.sum("in_bucket").over(before), F.lit(0)), "n": F.sum("in_bucket").over(whole)})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
                       for name, rank in ranks.items()])
    asked = sized.select(*group, "bucket", "below", "in_bucket", "n", F.inline(wanted))
    hit = asked.filter("rank > below AND rank <= below + in_bucket")
    return asked, small_side(hit.select(*group, "bucket", "name", (F.col("rank") - F.col("below")).alias("place")))


def _cuts(rows: DataFrame, group: list[str], asked: DataFrame, slices: DataFrame) -> DataFrame:
    """The order keys at the places of the slices; `rows` needs to hold all rows of those slices only."""
    near = rows.select(*group, "draw", "row_id", _bucket().alias("bucket")).join(slices, group + ["bucket"])
    order = Window.partitionBy(*group, "name").orderBy("draw", "row_id")
    cut = (near.withColumn("rn", F.row_number().over(order)).filter("rn = place")
           .select(*group, "name", F.col("draw").alias("cut_draw"), F.col("row_id").alias("cut_id")))
    every = asked.select(*group, "name", "rank", "n").distinct()
    return every.join(cut, group + ["name"], "left")


def cut_points(rows: DataFrame, group: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Order key (cut_draw, cut_id) of the row with the given rank in (draw, row_id) order per group.

    `ranks` maps a name to an expression over the group size `n`. A rank above n gives a null key.
    Result: (group..., name, rank, n, cut_draw, cut_id).
    """
    return _cuts(rows, group, *_slices(rows, group, ranks))


def not_after(draw_cut: str, id_cut: str) -> Column:
    return (F.col("draw") < F.col(draw_cut)) | ((F.col("draw") == F.col(draw_cut)) & (F.col("row_id") <= F.col(id_cut)))


def cap_per_group(rows: DataFrame, group: list[str], cap: int) -> DataFrame:
    """At most `cap` rows of each group, those with the lowest draws; smaller groups are kept whole.

    The rows are passed twice: for the histogram, and to write those up to the slice of the cap. All else, and what
    follows, reads the written ones.
    """
    asked, slices = _slices(rows, group, {"cap": F.lit(cap)})
    ends = small_side(asked.select(*group).distinct().join(slices.select(*group, F.col("bucket").alias("last_bucket")), group, "left"))
    upto = settle(rows.join(ends, group).filter(F.col("last_bucket").isNull() | (_bucket() <= F.col("last_bucket")))
                  .drop("last_bucket"))
    cuts = small_side(_cuts(upto, group, asked, slices).select(*group, "cut_draw", "cut_id"))
    return (upto.join(cuts, group).filter(F.col("cut_draw").isNull() | not_after("cut_draw", "cut_id"))
            .drop("cut_draw", "cut_id"))


def stratified_split(rows: DataFrame, label: str) -> DataFrame:
    """Adds `split`: per label, the 30 % with the lowest draws are held out, half valid, half test.

    Per label of n rows: ceil(0.30 n) held out, of which ceil(half) go to test.
    """
    held = F.ceil(F.col("n") * F.lit(30) / F.lit(100))
    cuts = cut_points(rows, [label], {"valid": held - F.ceil(held / 2), "held": held})
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c))).alias(f"{name}_{c}")
    wide = small_side(cuts.groupBy(label).agg(*[pick(n, c) for n in ("valid", "held") for c in ("cut_draw", "cut_id")]))
    in_valid = F.coalesce(not_after("valid_cut_draw", "valid_cut_id"), F.lit(False))
    in_held = F.coalesce(not_after("held_cut_draw", "held_cut_id"), F.lit(False))
    split = F.when(in_valid, F.lit("valid")).when(in_held, F.lit("test")).otherwise(F.lit("train"))
    return rows.join(wide, label).withColumn("split", split).select(*rows.columns, "split")


def quantiles(rows: DataFrame, columns: list[str], p: float, small_rows: int = 2_000_000) -> dict[str, float | None]:
    """Exact, linearly interpolated quantile of each column; nulls and NaN are ignored.

    Up to `small_rows` rows Spark's exact aggregate is used. Beyond that its buffer would grow with
    the distinct values, so the value range is narrowed by sketches until few values remain.
    """
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    numbers = rows.select(*[x[c].alias(c) for c in columns])
    sizes = numbers.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns]).first()
    if sizes["_rows"] <= small_rows:
        found = numbers.agg(*[F.percentile(c, F.lit(p)).alias(c) for c in columns]).first()
        return {c: found[c] for c in columns}
    return _narrowed(numbers, {c: sizes[c] for c in columns if sizes[c]}, p, small_rows) | {
        c: None for c in columns if not sizes[c]}


def _narrowed(numbers: DataFrame, sizes: dict[str, int], p: float, small_rows: int) -> dict[str, float]:
    columns = list(sizes)
    place = {c: (sizes[c] - 1) * p for c in columns}
    low: dict[str, float | None] = {c: None for c in columns}   # values below `low` are already counted
    high: dict[str, float | None] = {c: None for c in columns}

    def inside(c: str) -> Column:
        keep = [F.col(c).isNotNull()]
        keep += [F.col(c) >= low[c]] if low[c] is not None else []
        keep += [F.col(c) <= high[c]] if high[c] is not None else []
        return reduce(lambda a, b: a & b, keep)

    below = {c: 0 for c in columns}
    within = dict(sizes)
    active = set(columns)
    while active:
        asked = {c: [max(0.0, (place[c] - below[c]) / within[c] - 0.001),
                     min(1.0, (place[c] - below[c] + 1) / within[c] + 0.001)] for c in active}
        marks = numbers.agg(*[F.percentile_approx(F.when(inside(c), F.col(c)), asked[c], 10_000).alias(c)
                              for c in sorted(active)]).first()
        span = {c: F.col(c).between(marks[c][0], marks[c][1]) for c in active}
        counted = numbers.agg(*[f for c in sorted(active) for f in (
            F.count_if(F.col(c) < marks[c][0]).alias(f"{c}__below"), F.count_if(span[c]).alias(f"{c}__within"),
            F.approx_count_distinct(F.when(span[c], F.col(c))).alias(f"{c}__values"))]).first()
        for c in sorted(active):
            first, count = counted[f"{c}__below"], counted[f"{c}__within"]
            holds = first <= int(place[c]) and min(int(place[c]) + 2, sizes[c]) <= first + count
            narrower = holds and count < within[c]
            if narrower:
                low[c], high[c], below[c], within[c] = marks[c][0], marks[c][1], first, count
            if not narrower or counted[f"{c}__values"] <= small_rows:
                active.remove(c)
    kept = F.array(*[F.struct(F.lit(c).alias("column"), F.when(inside(c), F.col(c)).alias("x")) for c in columns])
    values = (numbers.select(F.inline(kept)).filter("x IS NOT NULL").groupBy("column", "x").agg(F.count("*").alias("m")))
    upto = Window.partitionBy("column").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("last", F.sum("m").over(upto)).withColumn("first", F.col("last") - F.col("m"))
    wanted = reduce(lambda a, b: a | b, [
        (F.col("column") == c) & (F.col("first") <= int(place[c]) + 1 - below[c]) & (F.col("last") > int(place[c]) - below[c])
        for c in columns])
    near: dict[str, list] = {c: [] for c in columns}
    for row in ranked.filter(wanted).collect():   # at most a few values around each rank
        near[row["column"]].append((row["first"], row["last"], row["x"]))
    result = {}
    for c in columns:
        at = lambda k: next(x for first, last, x in near[c] if first <= k - below[c] < last)
        floor = int(place[c])
        a = at(floor)
        b = at(min(floor + 1, sizes[c] - 1))
        result[c] = a + (b - a) * (place[c] - floor)
    return result
