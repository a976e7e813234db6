"""Queries that train, compare, score and explain models on the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixtures as fx
from flowsieve.catalog.corpus import clean_rows
from flowsieve.catalog.network import OPTS, feature_rows, six
from flowsieve.catalog.registry import query, shared_per_input
from flowsieve.operators import contributions, corpus, policy, training
from flowsieve.plans import compare, detection
from flowsieve.schemas import FEATURES
from flowsieve.session import scratch_path, settle
from flowsieve.sources import events, reports

# the quick mode: 100 trees; the other settings are the library's own
SETTINGS = training.Settings(quick=True)


@shared_per_input
def _rows(spark, d: str):
    return training.prepare(clean_rows(spark, d), SETTINGS)


@shared_per_input
def _stats(spark, d: str):
    return settle(corpus.standard_fit(_rows(spark, d).filter("split = 'train'")))


@shared_per_input
def _forest(spark, d: str):
    return training.fit_forest(_rows(spark, d), _stats(spark, d), SETTINGS)


@shared_per_input
def _isolation(spark, d: str):
    return training.fit_isolation(_rows(spark, d), SETTINGS)


@shared_per_input
def _comparison(spark, d: str):
    path = scratch_path(spark, "models")
    result = compare.run(clean_rows(spark, d), SETTINGS, path)
    return path, result


def _detector(spark, d: str) -> training.Detector:
    return training.Detector("RandomForest", _forest(spark, d), _isolation(spark, d), {})


def _test(spark, d: str):
    return _rows(spark, d).filter("split = 'test'")


def _predicted(model, rows):
    scored = policy.classify(training.score(model, rows.withColumnRenamed("label", "actual")))
    return scored.select("row_id", "actual", F.col("label").alias("predicted"), six("confidence"))


@query("train_forest")
def train_forest(spark, d):
    return _predicted(_forest(spark, d), _test(spark, d))


@query("train_boosted")
def train_boosted(spark, d):
    return _predicted(training.fit_boosted(_rows(spark, d), _stats(spark, d), SETTINGS), _test(spark, d))


@query("boosted_patience")
def boosted_patience(spark, d):
    """Boosting of 40 rounds at most, cut at the best validation round once 20 rounds have brought none better."""
    settings = training.Settings(trees=40, patience=20)
    fitted = training.fit_boosted(_rows(spark, d), _stats(spark, d), settings)
    return _predicted(fitted, _test(spark, d)).withColumn("rounds", F.lit(fitted.stages[-1].getNumTrees))


@query("train_isolation")
def train_isolation(spark, d):
    return _isolation(spark, d).forest.groupBy("tree").agg(
        F.count("*").alias("nodes"), F.first("sampled").alias("sampled"), six_max("path"))


def six_max(name: str):
    return F.round(F.max(name), 6).alias(name)


@query("score_isolation")
def score_isolation(spark, d):
    found = _isolation(spark, d)
    return policy.flag_novelty(found.score(clean_rows(spark, d)), found.threshold).select("row_id", "label", six("anomaly_score"), "novelty")


@query("train_oneclass")
def train_oneclass(spark, d):
    found = training.fit_oneclass(_rows(spark, d), SETTINGS)
    return policy.flag_novelty(found.score(_test(spark, d)), found.threshold).select("row_id", "label", "anomaly_score", "novelty")


@query("compare_models")
def compare_models(spark, d):
    return _comparison(spark, d)[1][1]


@query("train_report")
def train_report(spark, d):
    return _comparison(spark, d)[1][0].select("seed", "train", "valid", "test", "classes", F.map_keys("results").alias("models"))


@query("report_rows")
def report_rows(spark, d):
    return reports.scan(spark, f"{_comparison(spark, d)[0]}/report")


@query("model_roundtrip")
def model_roundtrip(spark, d):
    """The saved winner, loaded again, on the whole corpus."""
    loaded = training.Detector.load(f"{_comparison(spark, d)[0]}/detector")
    scored = loaded.score(clean_rows(spark, d).withColumnRenamed("label", "actual"))
    return policy.verdicts(scored, OPTS, loaded.novelty.threshold).select(
        "row_id", "actual", "label", six("confidence"), six("anomaly_score"), "novelty", "alert")


@query("score_jsonl")
def score_jsonl(spark, d):
    """Feature rows of the flows as JSON lines, scanned and scored."""
    path = scratch_path(spark, "features")
    feature_rows(spark, d).select(*FEATURES).write.json(path)
    scored = detection.score_flows(events.scan_feature_rows(spark, path), _detector(spark, d), OPTS)
    return policy.verdict_lines(scored).select("line", "note", "label", six("confidence"), "alert")


def _explained(spark, d, everything):
    detector = _detector(spark, d)
    nodes = settle(contributions.node_table(detector.classifier.stages[-1]))
    verdicts = detection.score_flows(feature_rows(spark, d), detector, OPTS)
    return detection.explain_rows(verdicts, detector, nodes, everything), contributions.base_value(nodes)


@query("explain_shap")
def explain_shap(spark, d):
    """Contributions of every flow; base plus contributions is the probability of ANOMALY."""
    rows, base = _explained(spark, d, True)
    total = F.aggregate("phi", F.lit(base), lambda a, b: a + b)
    return rows.select("flow_id", F.round(F.col("probability")[0], 6).alias("p_anomaly"), F.round(total, 6).alias("explained"),
                       F.posexplode("phi").alias("position", "phi")).select(
        "flow_id", "p_anomaly", "explained", F.array(*[F.lit(f) for f in FEATURES])[F.col("position")].alias("feature"), six("phi"))


@query("explain_alerts")
def explain_alerts(spark, d):
    return _explained(spark, d, False)[0].select("flow_id", "label", "alert", "explanation")


@query("detect_actions")
def detect_actions(spark, d):
    """The whole batch job with the trained detector: event records per type and action."""
    outcome = detection.run(fx.packets(spark, d), _detector(spark, d), OPTS)
    return outcome.events.groupBy("type", "action", "source").agg(F.count("*").alias("records"))
