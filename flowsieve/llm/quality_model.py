"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Every text gives a vector of statistics (no label, language, source or id). They are standardised with
sums over the training rows and mapped to cosines with random frequencies, whose inner products approximate
a Gaussian kernel. Each partition adds up its part of the normal equations (one row per feature, so the size of
the parts depends on the number of features only), Spark sums the parts row by row, and the driver
solves the one small system. Scores of a share of the training rows that the fit hasn't seen are counted
in bins, and pool-adjacent-violators over the bins turns scores into probabilities.

Cases with a defined result: a null or empty text has all statistics 0 and gets a score; a null id
is never held out and never labelled; several labels of one id count as their mean, rounded half up; without any
training label, or with one class only, every score is the share of good labels (0.5 without any);
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import per_text
from flowsieve.session import settle

STATISTICS = ["log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "doubled_words",
              "repeated_pairs", "log_lines", "distinct_lines", "line_words", "capitals", "digits", "symbols", "marks",
              "stops", "spaces", "byte_entropy", "long_words", "repeated_marks"]
FEATURES = 256
RIDGE = 1e-3
CLIP = 5.0
BINS = 1000
#: raw scores lie around 0 (bad) and 1 (good)
LOW, HIGH = -0.5, 1.5
_REPEATED_MARK = re.compile(r"([^\w\s])\1+")
_CLASS = np.zeros((6, 256))
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?;:()[]{}\"'=/\\@^~_+-", b".,",
                               b" \t\n\r\x0b\x0c")):
    _CLASS[_row, list(_bytes)] = 1


def statistics(text: str | None) -> np.ndarray:
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = int(raw.sum())
    share = raw[raw > 0] / size
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out[:12] = (np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), len(set(words)) / n,
                sum(map(eq, words, words[1:])) / n, 1 - len(set(zip(words, words[1:]))) / max(1, n - 1), np.log1p(len(lines)),
                len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), 0, 0)
    kinds = _CLASS @ raw / size
    out[10:16] = kinds
    out[16] = -(share * np.log2(share)).sum()
    out[17] = (lengths > 20).mean()
    out[18] = len(_REPEATED_MARK.findall(text)) / n
    return out


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats): the statistics of every whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def each(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": part["doc_id"], "stats": [statistics(t if isinstance(t, str) else None) for t in part["text"]]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(lambda batches: per_text(batches, each), f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        z = np.cos(x @ self.frequency + self.phase) * np.sqrt(2.0 / self.frequency.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        if self.weights is None:
            return np.full(len(raw), self.values[0])
        steady = np.interp(raw, self.knots, self.values)
        # a trace of the raw score keeps the order within a step
        return np.clip(0.998 * steady + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def isotonic(counts: np.ndarray, good: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: (place, share of good) of every pool."""
    pools: list[list[float]] = []
    for n, g, x in zip(counts, good, at):
        pools.append([n, g, x * n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 2] / table[:, 0], table[:, 1] / table[:, 0]


def _stack(column) -> np.ndarray:
    return np.array(column.to_list(), dtype=float).reshape(len(column), -1)


def fit(train: DataFrame, calibrate: DataFrame, *, features: int = FEATURES, ridge: float = RIDGE, seed: int = 11) -> Model:
    """Fits on (stats, label) rows; `calibrate` has rows of the same form that the fit doesn't use."""
    size = len(STATISTICS)
    moments = train.select("label", F.posexplode("stats").alias("k", "x")).groupBy("k").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.avg("label").alias("good")).collect()
    rng = np.random.default_rng(seed)
    frequency = rng.normal(0.0, np.sqrt(1.0 / size), (size, features))
    phase = rng.uniform(0.0, 2 * np.pi, features)
    mean, scale = np.zeros(size), np.ones(size)
    for row in moments:
        mean[row["k"]], scale[row["k"]] = row["mean"], max(row["sd"] or 0.0, 1e-6)
    prior = moments[0]["good"] if moments else 0.5
    model = Model(mean, scale, frequency, phase, None, np.array([0.0]), np.array([prior]))
    if prior in (0.0, 1.0) or not moments:
        return model

    def partial(batches):
        total, target = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.iloc[start:start + 2000]
                z = model.features(_stack(part["stats"]))
                total += z.T @ z
                target += z.T @ part["label"].to_numpy(float)
        yield pd.DataFrame({"k": np.arange(features + 1), "part": list(np.hstack([total, target[:, None]]))})

    def summed(key, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "part": [np.sum(_stack(parts["part"]), axis=0)]})

    schema = "k int, part array<double>"
    rows = (train.select("stats", "label").mapInPandas(partial, schema).groupBy("k").applyInPandas(summed, schema).collect())
    system = np.zeros((features + 1, features + 2))
    for row in rows:
        system[row["k"]] = row["part"]
    n = moments[0]["n"]
    model.weights = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(features + 1) / features, system[:, -1])

    def raws(batches):
        for batch in batches:
            raw = np.clip(model.raw(_stack(batch["stats"])), LOW, HIGH) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"bin": np.floor((raw - LOW) / (HIGH - LOW) * BINS).astype(int), "label": batch["label"]})

    bins = (calibrate.select("stats", "label").mapInPandas(raws, "bin int, label double").groupBy("bin")
            .agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect())
    if bins:
        at = np.array([LOW + (b["bin"] + 0.5) * (HIGH - LOW) / BINS for b in bins])
        model.knots, model.values = isotonic(np.array([b["n"] for b in bins], float), np.array([b["good"] for b in bins]), at)
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """All columns of `stats` with a score."""
    def each(batches):
        for batch in batches:
            scores = model.score(_stack(batch["stats"])) if len(batch) else np.zeros(0)
            yield batch.assign(score=scores).drop(columns="stats")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.drop("stats").schema.fields)
    return stats.mapInPandas(each, f"{fields}, score double")


def fold(doc_id: str | Column) -> Column:
    return (F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3).cast("int")


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted on the labelled rows that aren't held out."""
    stats = settle(described(docs, doc_id, text).withColumn("held_out", F.coalesce(fold("doc_id") == 1, F.lit(False))))
    marks = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
             .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label")))
    rows = settle(stats.filter(~F.col("held_out")).join(marks, "doc_id"))
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = fit(rows.filter(~apart), rows.filter(apart))
    return scored(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
