"""Boosting with patience: losses by round, the best round, and the model of the first rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import corpus, training
from flowsieve.schemas import FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(FEATURES)))
    target = (x[:, 0] + x[:, 3] * x[:, 5] + rng.normal(scale=0.8, size=600) > 0).astype(float)
    return spark.createDataFrame([(*map(float, r), float(t), 1.0, ["train", "train", "valid"][n % 3]) for n, (r, t) in enumerate(zip(x, target))],
                                 [*FEATURES, "target", "positive_weight", "split"]).cache()


def test_best_round():
    losses = [5.0, 4.0, 3.0, 3.5, 3.2, 2.9, 3.0, 3.0, 3.0, 1.0]
    assert [training.best_round(losses, p) for p in (1, 2, 3, 4, 9)] == [3, 3, 6, 10, 10]
    assert training.best_round([1.0], 20) == 1


def test_model_of_the_first_rounds(rows):
    stats = corpus.standard_fit(rows.filter("split = 'train'"))
    settings = training.Settings(trees=12, patience=3)
    kept = training.fit_boosted(rows, stats, settings).stages[-1]
    whole = training.fit_boosted(rows, stats, training.Settings(trees=12, patience=100))
    valid = rows.filter("split = 'valid'")

    def loss(model):
        found = training.score(model, valid).select("target", F.col("probability")[0].alias("p")).collect()
        # Spark's logistic loss has a margin of twice the log-odds
        return float(np.mean([2 * math.log1p(math.exp(-(2 * r["target"] - 1) * math.log(r["p"] / (1 - r["p"])))) for r in found]))

    full = training.Settings(trees=12, patience=100)
    boosted = whole.stages[-1]
    every = training.PipelineModel([*whole.stages[:-1], boosted])
    rounds = boosted.getNumTrees
    losses = training.round_losses(every, valid)
    assert len(losses) == rounds and full.patience == 100
    for n in (1, rounds // 2 or 1, rounds):
        part = training.PipelineModel([*whole.stages[:-1], training.first_rounds(boosted, n)])
        assert part.stages[-1].getNumTrees == n and part.stages[-1].getFeaturesCol() == "inputs"
        assert loss(part) == pytest.approx(losses[n - 1], rel=1e-9)
    assert losses.index(min(losses)) == rounds - 1          # the whole one was cut at its best round
    assert kept.getNumTrees <= rounds
