"""Importance resampling towards a target: documents whose hashed word runs are likelier in the target than in the corpus.

Features of a text are its runs of `least` to `most` words, hashed into buckets. A bucket's gain is the log ratio of its smoothed shares
in target and corpus; a document's weight is the sum of its features' gains. Gumbel noise from a hash of the id turns the
highest scores into a sample without replacement, so that reruns agree.

Texts go through Arrow kernels slice by slice: ascii_lower, split_pattern_regex, list_flatten, dictionary_encode. Runs of words come from
dictionary indices shifted against each other; the CRC of a run continues that of its first words, once for every distinct pair of (run,
next word). Buckets of all features are taken by index, gains summed by document as differences of a running sum. A task adds its buckets up
before the shuffle, so counts move at most `buckets` numbers a task.

Ranks need no global sort: an approximate quantile gives a bound below the cut, the rows from it on are dealt by range, and offsets of the
ranges make the places inside them ranks. Rows equal in id and text are dealt once with their number.

Cases with a defined result: a null text, and one without a word, has no features and weight 0; a null id is hashed as an empty one and
ranked first among ties; equal rows get ranks of their own, and the cut may fall between them; an empty table gives an
empty result; with an empty target the gains follow the corpus alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import settle

#: Fixed value: what separates words after A-Z became a-z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 4_000_000
SEED = 2024


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES bytes; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and held + size > SLICE_BYTES:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index of every word in the distinct words, its text's number, the distinct words)."""
    cut = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATOR)
    parents = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.list_flatten(cut))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [w.encode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
    if b"" in names:      # before a leading separator and after a trailing one
        some = index != names.index(b"")
        index, parents = index[some], parents[some]
    return index, parents, names


def features(texts: pa.Array, least: int, most: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of every text, for each run length the text numbers in order and the buckets of its runs)."""
    index, parents, names = words(texts)
    run, crc, out = index, np.array([zlib.crc32(w) for w in names], np.int64), []
    after_space = [b" " + w for w in names]
    for n in range(1, most + 1):
        if n > 1:
            # runs of n - 1 words and the word after them, where both are of one text
            first, last = run[:max(0, len(index) - n + 1)], index[n - 1:]
            distinct, run = np.unique(first * len(names) + last, return_inverse=True)
            crc = np.array([zlib.crc32(after_space[p % len(names)], int(crc[p // len(names)])) for p in distinct.tolist()], np.int64)
        if n >= least:
            own = parents[:len(run)]
            whole = own == parents[n - 1:]
            out.append((own[whole], (crc % buckets)[run][whole] if len(run) else np.empty(0, np.int64)))
    return np.bincount(parents, minlength=len(texts)), out


def bucket_counts(docs: DataFrame, least: int, most: int, buckets: int, *, text: str = "text") -> np.ndarray:
    """Number of features of the whole table in every bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for start, stop in slices(texts):
                for _, found in features(texts.slice(start, stop - start), least, most, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(add, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():    # at most `buckets` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares in target and corpus, rounded down."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: str | Column) -> Column:
    """Thousandths of a Gumbel draw from the id, rounded down."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, least: int, most: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, words, n_features, weight) of every row; `mark` is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            texts = batch.column(2)
            for start, stop in slices(texts):
                count, found = features(texts.slice(start, stop - start), least, most, len(gain))
                sizes, sums = np.zeros(stop - start, np.int64), np.zeros(stop - start, np.int64)
                for owner, bucket in found:
                    edges = np.searchsorted(owner, np.arange(stop - start + 1))
                    run = np.concatenate(([0], np.cumsum(gain.take(bucket))))
                    sizes += np.diff(edges)
                    sums += np.diff(run[edges])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start),
                     pa.array(count.astype(np.int64)), pa.array(sizes), pa.array(sums)], ["doc_id", "mark", "words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kind}, mark bigint, words bigint, n_features bigint, weight bigint")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds `rank`, 1 for the highest score, to the drawn rows; others have null. `scored` has a settled table's rows."""
    enough = F.col("words") >= least_words
    wide = scored.filter(enough).agg(F.count("*").alias("n"), F.percentile_approx(
        "score", F.lit(max(0.0, 1 - percent / 100 - 0.01)), 10_000).alias("bound")).first()
    take, bound = percent * wide["n"] // 100, wide["bound"]
    if take and scored.filter(enough & (F.col("score") >= bound)).count() < take:
        bound = scored.filter(enough).agg(F.min("score")).first()[0]     # the sketch was off: order all of them
    nothing = F.lit(None).cast("long")
    if not take:
        return scored.withColumn("rank", nothing)
    near = enough & (F.col("score") >= bound)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("mark")]
    once = scored.filter(near).groupBy(*scored.columns).agg(F.count("*").alias("_n"))
    dealt = settle(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    starts, below = {}, 0
    for row in dealt.groupBy(part.alias("part")).agg(F.sum("_n").alias("n")).sort("part").collect():    # a row per range
        starts[row["part"]], below = below, below + row["n"]
    inside = Window.partitionBy("_part").orderBy("_at")
    table = scored.sparkSession.createDataFrame(list(starts.items()), "_part bigint, _start bigint")
    numbered = (dealt.withColumn("_part", part).withColumn("_upto", F.sum("_n").over(inside)).join(F.broadcast(table), "_part")
                .withColumn("_last", F.col("_start") + F.col("_upto")))
    every = numbered.select(*scored.columns, F.explode(F.sequence(F.col("_last") - F.col("_n") + 1, F.col("_last"))).alias("_place"))
    drawn = every.select(*scored.columns, F.when(F.col("_place") <= take, F.col("_place")).alias("rank"))
    return drawn.unionByName(scored.filter(~near).withColumn("rank", nothing))


def resample(docs: DataFrame, target: DataFrame, *, least: int = 1, most: int = 1, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, mark, words, n_features, weight, score, rank): of the rows with enough words, `percent` % are drawn."""
    gain = gains(bucket_counts(docs, least, most, buckets, text=text), bucket_counts(target, least, most, buckets, text=target_text))
    found = weighted(docs, gain, least, most, doc_id=doc_id, text=text)
    return ranked(settle(found.withColumn("score", F.col("weight") + noise("doc_id"))), percent, least_words)


def drawn(docs: DataFrame, resampled: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows with all columns of `docs`; of equal rows as many as were drawn."""
    wanted = resampled.filter("rank IS NOT NULL").groupBy("doc_id", "mark").agg(F.count("*").alias("_wanted")).select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_wanted")
    met = docs.join(wanted, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_mark")))
    # drawn rows that are equal in all columns are counted together, so that copies need no order among themselves
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = met.groupBy("_id", "_mark", "_wanted", *columns).agg(F.count("*").alias("_copies"))
    upto = F.sum("_copies").over(Window.partitionBy("_id", "_mark").orderBy(F.xxhash64(*columns)))
    take = F.least(F.col("_copies"), F.col("_wanted") - F.col("_upto") + F.col("_copies")).cast("int")
    kept = once.withColumn("_upto", upto).withColumn("_take", take).filter("_take > 0")
    return kept.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_take")))).select(*columns)
