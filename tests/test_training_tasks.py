"""Training tasks come from the rows, not from their files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import corpus, training
from flowsieve.schemas import FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, len(FEATURES)))
    target = (x[:, 0] + x[:, 3] * x[:, 5] + rng.normal(scale=0.8, size=900) > 0).astype(float)
    return spark.createDataFrame(
        [(f"r{n}", *map(float, r), float(t), "ANOMALY" if t else "BENIGN", 1.0, 1.0, ["train", "train", "valid"][n % 3])
         for n, (r, t) in enumerate(zip(x, target))],
        ["row_id", *FEATURES, "target", "label", "balanced_weight", "positive_weight", "split"]).cache()


def test_rows_of_one_file_are_dealt_to_tasks(rows, monkeypatch):
    monkeypatch.setattr(training, "TASK_ROWS", 100)
    monkeypatch.setattr(training, "WHOLE_ROWS", 200)
    sizes = [r["n"] for r in training.dealt(rows.coalesce(1)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 9 and sum(sizes) == 900 and max(sizes) < 200
    monkeypatch.setattr(training, "WHOLE_ROWS", 900)
    assert training.dealt(rows.coalesce(1)).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("fit", [training.fit_forest, training.fit_boosted])
def test_model_does_not_depend_on_files(rows, monkeypatch, fit):
    monkeypatch.setattr(training, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(training, "WHOLE_ROWS", 200, raising=False)
    stats = corpus.standard_fit(rows.filter("split = 'train'"))
    settings = training.Settings(trees=4, max_depth=6)
    one, other = [fit(r, stats, settings).stages[-1].toDebugString.split("\n", 1)[1]
                  for r in (rows.coalesce(1), rows.orderBy(F.desc("row_id")).repartition(5))]
    assert one == other
