"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Rates of every text (symbols, repeated words, doubled words, repeated lines, word length) go into
relative-error sketches, one for each language, source and rate: a bin holds the values between two powers of
(1 + a) / (1 - a), so its middle is within a = 0.1 % of each, and sketches merge by adding counts. Spark
builds them with map-side combine, so a hot source costs no more than the others. A source with
few texts takes the sketch of its language, and a rare language that of the whole table: both are
sums of the sketches below them.

A text is rejected when a rate passes a high quantile of its group by more than a multiple of the group's upper spread (that quantile
minus the median), or when its word length lies as far below the low quantile. The quantile is 75 %, so junk moves neither figure until it
makes up a quarter of a group; repeats and repeated lines are rare in good texts and take 95 %. A stated small spread stands in only where the group
has none, as where three quarters of the texts hold no symbol. Shares of words or lines get ALLOWANCE standard deviations of a count on
top, because one repeated line is a large share of a short text.

Cases with a defined result: a null or empty text has no words and fails the base rule; null languages and sources
are groups of their own; repeated rows are judged alike; a text alone in its group is judged by the merged sketches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowsieve.llm.common import give_back, held_small, packed, text_slices
from flowsieve.llm.words import Words, encoded
from flowsieve.session import settle

ACCURACY = 0.001
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
ZERO_BIN = -1_000_000
ALLOWANCE = 2.0
LEAST_ROWS = 50
SYMBOLS = b"#*$%&|<>"
#: rate: (numerator, denominator, least spread, high quantile, spreads above it)
RATES = {
    "symbols": ("n_symbols", "n_words", 0.002, "high", 8.0),
    "repeats": ("n_repeat_words", "n_words", 0.01, "top", 3.0),
    "doubles": ("n_doubled_words", "n_words", 0.001, "high", 8.0),
    "lines": ("n_dup_lines", "n_lines", 0.02, "top", 3.0),
    "length": ("word_chars", "n_words", 0.02, "high", 8.0),
}
SHARES = {"low": 0.25, "mid": 0.5, "high": 0.75, "top": 0.95}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_doubled_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def text_counts(texts) -> pd.DataFrame:
    """The counts of every text; see COUNTS. Repeats are words inside five-word windows found twice or more."""
    raw = encoded(texts)
    words = Words(raw)
    n = len(raw)
    window, at = words.shingles(5)
    covered = np.zeros(len(words.hash) + 1, np.int64)
    if len(at):
        # the same window in two texts is no repeat, so the text number is part of the key
        order = np.lexsort((window, words.doc[at]))
        h, d = window[order], words.doc[at][order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        begin = at[order[twice]]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + 5, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    doubled = np.zeros(len(words.hash), bool)
    doubled[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(raw):
        with_word = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0b\x0c\x0d")]
        lines[i], dup[i] = len(with_word), len(with_word) - len(set(with_word))
    first_byte = (words.raw & 0xC0) != 0x80
    return pd.DataFrame({
        "n_words": words.count.astype(np.int64),
        "word_chars": words.per_text(first_byte & ~words.space),
        "n_symbols": words.per_text(_SYMBOL[words.raw]),
        "n_dup_lines": dup,
        "n_repeat_words": words.per_text_words(repeated),
        "n_lines": lines,
        "n_doubled_words": words.per_text_words(doubled),
    })


def counted(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """(doc_id, lang, source, counts): one pass over the texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
                       F.col(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    schema = kinds + "".join(f", {c} bigint" for c in COUNTS)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        counts = text_counts(part["text"])
        return pd.concat([part.drop(columns="text").reset_index(drop=True), counts], axis=1)

    def parts(batches):
        for batch in batches:
            yield from (each(batch.iloc[part]) for part in text_slices(batch["text"]))
        give_back()

    return rows.mapInPandas(parts, schema)


def sketch_bin(value: Column) -> Column:
    at = F.ceil(F.log(value) / F.lit(math.log(GAMMA))).cast("long")
    return F.when(value > 0, at).otherwise(F.lit(ZERO_BIN).cast("long"))


def bin_value(at: Column) -> Column:
    middle = F.lit(2.0 / (GAMMA + 1.0)) * F.pow(F.lit(GAMMA), at.cast("double"))
    return F.when(at == ZERO_BIN, F.lit(0.0)).otherwise(middle)


def rate(name: str) -> Column:
    above, below, *_ = RATES[name]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rate, bin, n): one mergeable sketch per group and rate."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), sketch_bin(rate(n)).alias("bin")) for n in RATES]))
    return rows.select(*by, each.alias("s")).groupBy(*by, "s.rate", "s.bin").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., rate, rows, a column per share): the value at rank ceil(share * rows) of every sketch."""
    group = Window.partitionBy(*by, "rate")
    run = sketch.withColumn("rows", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bin")))
    at = {name: F.min(F.when(F.col("upto") >= F.ceil(F.lit(share) * F.col("rows")), F.col("bin"))) for name, share in shares.items()}
    found = run.groupBy(*by, "rate", "rows").agg(*[c.alias(name) for name, c in at.items()])
    return found.select(*by, "rate", "rows", *[bin_value(F.col(name)).alias(name) for name in at])


def thresholds(rows: DataFrame, by: tuple[str, str]) -> DataFrame:
    """(lang, source, limits): a map from rate to its upper and lower limit, from the narrowest sketch with enough rows."""
    lang, source = by
    finest = settle(sketches(rows, [lang, source]))

    def limits(found: DataFrame, keys: list[str], name: str) -> DataFrame:
        def stated(at: int) -> Column:
            return F.create_map(*[F.lit(x) for n, values in RATES.items() for x in (n, values[at])])[F.col("rate")]

        high = F.when(stated(3) == "top", F.col("top")).otherwise(F.col("high"))
        upper = high + stated(4) * F.greatest(high - F.col("mid"), stated(2))
        lower = F.col("low") - stated(4) * F.greatest(F.col("mid") - F.col("low"), stated(2))
        limit = F.struct(upper.alias("upper"), lower.alias("lower"))
        entry = F.when(F.col("rows") >= LEAST_ROWS, limit) if keys else limit
        return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rate", entry))).alias(name))

    own = limits(quantiles(finest, [lang, source], SHARES), [lang, source], "own")
    wider = limits(quantiles(merged(finest, [lang]), [lang], SHARES), [lang], "wider")
    widest = limits(quantiles(merged(finest, []), [], SHARES), [], "widest")
    joined = own.join(wider.withColumnRenamed(lang, "_lang"), F.col(lang).eqNullSafe(F.col("_lang")), "left").join(
        F.broadcast(widest), F.lit(True), "left")
    chosen = F.map_from_arrays(F.array(*map(F.lit, RATES)), F.array(*[
        F.coalesce(F.col("own")[n], F.col("wider")[n], F.col("widest")[n]) for n in RATES]))
    return joined.select(lang, source, chosen.alias("limits"))


@F.pandas_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def counts_of(texts: pd.Series) -> pd.DataFrame:
    parts = [text_counts(texts.iloc[part]) for part in text_slices(texts)]
    give_back()
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in COUNTS}, dtype="int64")


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _limits(rows: DataFrame) -> DataFrame:
    """(_key, limits): limits per language and source, as a small table where it is one."""
    return held_small(thresholds(rows.filter(~_base_failed()), ("lang", "source")).select(
        F.struct("lang", "source").alias("_key"), "limits"))


def _over() -> Column:
    found = []
    for n, (_, below, *_) in RATES.items():
        upper = F.col("limits")[n]["upper"]
        noise = F.lit(0.0) if n == "length" else ALLOWANCE * F.sqrt(upper / F.greatest(F.col(below), F.lit(1)))
        found.append(F.when(rate(n) > upper + noise, F.lit(n)))
    over = F.array(*found, F.when(rate("length") < F.col("limits")["length"]["lower"], F.lit("short")))
    return F.coalesce(F.filter(over, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def kept_rows(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that the rules keep, with all their columns. Texts are read twice and never shuffled."""
    no_id = docs.select(F.lit(0).alias("doc_id"), *[F.col(c) for c in dict.fromkeys((text, lang, source))])
    limits = _limits(settle(counted(no_id, "doc_id", text, lang, source)))
    rows = packed(docs).withColumn("_counts", counts_of(F.col("_row")[text])).select("_row", "_counts.*", F.struct(
        F.col("_row")[lang].alias("lang"), F.col("_row")[source].alias("source")).alias("_key"))
    return rows.join(limits, "_key", "left").filter(~_base_failed() & (F.size(_over()) == 0)).select("_row.*")


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, kept, reasons) for every row."""
    rows = settle(counted(docs, doc_id, text, lang, source))
    rows = rows.withColumn("base_failed", _base_failed()).withColumn("_key", F.struct("lang", "source"))
    return (rows.join(_limits(rows), "_key", "left").withColumn("reasons", _over())
            .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("limits", "_key"))
