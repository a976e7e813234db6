"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Pivots, a bounded sample of the
vectors, cut the space into cells: a vector's home is its nearest pivot's cell. By the triangle inequality a
vector x within r of some vector of cell j satisfies d(x, p_j) <= d(x, p_home) + 2r, and as distances are Euclidean also
d(x, p_j)^2 - d(x, p_home)^2 <= 2 r d(p_home, p_j); only vectors that satisfy both are copied to the cell, and only to cells
before their own, so a pair is met once. Cells are then joined independently. Inside a cell the
distances to the pivot bound which vectors a block has to be compared with, and cosines are recomputed in double
precision in numpy blocks.

Equal vectors are first counted as one (under a 64-bit hash of label and vector), so a vector that makes up a third of all rows is compared once. A
cell with more than BLOCK vectors is cut into blocks along the distance to its pivot; pairs of blocks are tasks of
their own, and only pairs whose distance ranges come within r are made. Tasks return how many links every vector has and a
spanning forest of their links, never all pairs. The number of pivots grows with the vectors up to MAX_PIVOTS.

Cases with a defined result: vectors that are null, empty, zero or have null or non-finite components, and rows with a null
label link with nothing and are their own component; vectors of different lengths never link; rows with equal
ids are separate vectors with that id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.graph import components
from flowsieve.session import settle

MAX_PIVOTS = 256
VECTORS_PER_PIVOT = 2000
BLOCK = 2000
#: distances near 0 are computed with an error of about 2e-8
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    return np.array(column.to_list(), dtype=float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _homes(vectors: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """(label, rep, copies, vec, cell, home, away): the vector at home and copied over boundaries.

    `away` is the distance to the cell's pivot.
    """
    between = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))

    def each(batches):
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start:start + 1000]
                unit = _unit(_matrix(part["vec"]))
                away = np.sqrt(np.maximum(0.0, 2 - 2 * unit @ pivots.T))
                home = away.argmin(axis=1)
                own = away[np.arange(len(part)), home]
                near = away <= own[:, None] + 2 * radius + SLACK
                near &= away ** 2 - own[:, None] ** 2 <= 2 * radius * between[home] + SLACK
                near &= np.arange(len(pivots)) <= home[:, None]
                row, cell = np.nonzero(near)
                yield pd.DataFrame({"label": part["label"].to_numpy()[row], "rep": part["rep"].to_numpy()[row],
                                    "copies": part["copies"].to_numpy()[row], "vec": part["vec"].to_numpy()[row], "cell": cell,
                                    "home": cell == home[row], "away": away[row, cell]})

    label, vec = (vectors.schema[c].dataType.simpleString() for c in ("label", "vec"))
    return vectors.select("label", "rep", "copies", "vec").mapInPandas(
        each, f"label {label}, rep bigint, copies bigint, vec {vec}, cell int, home boolean, away double")


def _forest(rep: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, one fewer than nodes per component."""
    parent = list(range(len(rep)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a, b in pairs.tolist():
        i, j = root(a), root(b)
        if i != j:
            parent[j] = i
            out.append((int(rep[a]), int(rep[b])))
    return out


def _links(rows: pd.DataFrame, cosine: float, radius: float) -> pd.DataFrame:
    """Counts and forest of one cell or of two of its blocks: rows (rep, n_links, null) and (a, null, b)."""
    rows = rows.sort_values("away", kind="stable")
    unit, away = _unit(_matrix(rows["vec"])), rows["away"].to_numpy()
    home, side = rows["home"].to_numpy(bool), rows["side"].to_numpy()
    rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
    two = bool(rows["pair"].iloc[0])
    counts = np.zeros(len(rows), np.int64)
    forest: list[tuple[int, int]] = []
    for low in range(0, len(rows), 256):
        high = min(low + 256, len(rows))
        stop = int(np.searchsorted(away, away[high - 1] + radius + SLACK, "right"))
        close = unit[low:high] @ unit[low:stop].T >= cosine
        i, j = np.nonzero(close)
        i, j = i + low, j + low
        keep = (j > i) & (home[i] | home[j])
        if two:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        if len(i):
            forest += _forest(rep, np.stack([i, j], axis=1))
    hit = counts > 0
    return pd.DataFrame({"a": np.concatenate([rep[hit], [a for a, _ in forest]]).astype("int64"),
                         "n": np.concatenate([counts[hit], np.zeros(len(forest), np.int64)]).astype("int64"),
                         "b": pd.array([None] * int(hit.sum()) + [b for _, b in forest], "Int64")})


def _joined(cells: DataFrame, cosine: float, radius: float) -> DataFrame:
    """(a, n, b) of all cells. Large cells are cut along the distance to the pivot into blocks of about BLOCK rows."""
    group = ["label", "dim", "cell"]
    cells = cells.withColumn("dim", F.size("vec"))
    # a block is a range of distances: cell sizes are counted first, then ranges are read off a histogram
    sizes = (cells.groupBy(*group, F.floor(F.col("away") * 256).cast("int").alias("ring"))
             .agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")))
    upto = Window.partitionBy(*group).orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = sizes.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # a ring denser than a block is split by the vector's number as well
    rings = settle(rings.withColumn("band", F.floor(F.col("_before") / F.lit(BLOCK)).cast("int"))
                   .withColumn("parts", F.ceil(F.col("n") / F.lit(2 * BLOCK)).cast("int")))
    placed = cells.withColumn("ring", F.floor(F.col("away") * 256).cast("int")).join(
        rings.select(*group, "ring", "band", "parts"), group + ["ring"])
    placed = settle(placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts", "ring"))
    blocks = (placed.groupBy(*group, "band", "part").agg(F.min("away").alias("low"), F.max("away").alias("high"),
                                                         F.max("home").alias("homes")))
    left = blocks.select(*group, F.struct("band", "part").alias("x"), F.col("high").alias("x_high"), F.col("low").alias("x_low"),
                         F.col("homes").alias("x_homes"))
    right = blocks.select(*group, F.struct("band", "part").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"),
                          F.col("homes").alias("y_homes"))
    reach = (F.col("y_low") <= F.col("x_high") + radius + SLACK) & (F.col("x_low") <= F.col("y_high") + radius + SLACK)
    pairs = (left.join(right, group).filter((F.col("x") <= F.col("y")) & reach & (F.col("x_homes") | F.col("y_homes")))
             .select(*group, "x", "y"))
    sides = F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side")))
    one = F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))
    tasks = pairs.select(*group, "x", "y", (F.col("x") != F.col("y")).alias("pair"),
                         F.explode(F.when(F.col("x") == F.col("y"), one).otherwise(sides)).alias("s"))
    tasks = tasks.select(*group, F.col("s.block.band").alias("band"), F.col("s.block.part").alias("part"),
                         F.col("s.side").alias("side"), "pair", "x", "y")
    work = (placed.join(tasks, group + ["band", "part"])
            .select(*group, "x", "y", "pair", "side", "rep", "copies", "vec", "home", "away"))
    return (work.groupBy(*group, "x", "y").applyInPandas(
        lambda rows: _links(rows, cosine, radius), "a bigint, n bigint, b bigint"))


def near_duplicates(table: DataFrame, cosine: float = 0.98, *, vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    kind = table.schema[vector].dataType.simpleString()
    wire = kind if kind == "array<float>" else "array<double>"      # floats are exact in double precision
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast(wire).alias("vec"), F.col(label).alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    # minus zero equals zero, also where equal vectors are grouped
    rows = settle(rows.withColumn("usable", usable).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)).cast(wire))
                  .withColumn("key", F.xxhash64("label", "vec")))
    groups = settle(rows.filter("usable").groupBy("label", "vec").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("key").alias("rep")))
    n = groups.count()
    edges, counts = None, None
    lengths = [r["d"] for r in groups.select(F.size("vec").alias("d")).distinct().collect()] if n else []
    found = []
    for length in lengths:
        own = groups.filter(F.size("vec") == length)
        wanted = max(1, min(MAX_PIVOTS, own.count() // VECTORS_PER_PIVOT))
        sample = own.select("vec").orderBy(F.xxhash64("vec", F.lit(17)), "vec").limit(wanted).collect()
        pivots = _unit(np.array([r["vec"] for r in sample], dtype=float))
        found.append(_joined(_homes(own, pivots, radius), cosine, radius))
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.unionByName(more)
        links = settle(links)
        counts = links.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
        edges = links.filter("b IS NOT NULL").select("a", "b")
        parts = components(edges).join(groups.select(F.col("rep").alias("node"), "least"), "node")
        smallest = parts.groupBy("component").agg(F.min("least").alias("component_id"))
        reached = parts.join(smallest, "component").select(F.col("node").alias("rep"), "component_id")
        info = (groups.select("rep", "copies", "least").join(counts.withColumnRenamed("a", "rep"), "rep", "left")
                .join(reached, "rep", "left")
                .select(F.col("rep").alias("key"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                        F.coalesce("component_id", "least").alias("component_id"), F.lit(True).alias("usable")))
        out = rows.drop("vec", "label").join(info, ["key", "usable"], "left")
    else:
        out = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))
