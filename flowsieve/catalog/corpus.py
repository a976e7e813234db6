"""Queries on the labelled corpus and on metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve import fixtures as fx
from flowsieve.catalog import sql
from flowsieve.catalog.network import six, sql_six
from flowsieve.catalog.registry import query
from flowsieve.catalog.sql import NAMES, with_
from flowsieve.functions.labels import binary_label
from flowsieve.operators import corpus, metrics
from flowsieve.operators.selection import stratified_split as split_rows
from flowsieve.schemas import ANOMALY, BENIGN, FEATURES
from flowsieve.session import scratch_path
from flowsieve.sources import corpus as csv_files


def clean_rows(spark, d: str) -> DataFrame:
    return corpus.clean(fx.corpus(spark, d), "row_id", "draw", "source_file")


def _csv_folder(spark, d: str) -> str:
    path = scratch_path(spark, "corpus")
    name = F.regexp_replace("source_file", r"\.csv$", "_cleaned.csv")
    csv_files.write_csv(fx.corpus(spark, d).withColumn("source_file", name).drop("row_id", "draw"), path)
    return path


@query("corpus_scan", with_(sql.CORPUS, select="""
SELECT replace(source_file, '.csv', '_cleaned.csv') AS source_file, CASE WHEN upper(trim(Label)) = 'BENIGN' THEN 'BENIGN' ELSE 'ANOMALY' END AS label,
  count(*) AS n, count(flow_duration) AS durations, CAST(sum(forward_bytes) AS BIGINT) AS forward_bytes, CAST(sum(syn_count) AS BIGINT) AS syn_count
FROM corpus GROUP BY ALL"""))
def corpus_scan(spark, d):
    """The corpus written as one CSV folder per file and read back by the labelled CSV scan."""
    rows = csv_files.scan_csv(spark, _csv_folder(spark, d)).withColumn("label", binary_label(F.col("Label")))
    return rows.groupBy("source_file", "label").agg(
        F.count("*").alias("n"), F.count("flow_duration").alias("durations"),
        F.sum(F.col("forward_bytes").cast("bigint")).alias("forward_bytes"), F.sum(F.col("syn_count").cast("bigint")).alias("syn_count"))


@query("corpus_csv_split", with_(sql.CORPUS, select="""
SELECT label, CAST(n AS BIGINT) AS n, CAST(n - ceil(n * 30 / 100) AS BIGINT) AS train, CAST(ceil(n * 30 / 100) - ceil(ceil(n * 30 / 100) / 2) AS BIGINT) AS valid,
  CAST(ceil(ceil(n * 30 / 100) / 2) AS BIGINT) AS test
FROM (SELECT label, sum(least(n, 400)) AS n FROM (
  SELECT source_file, CASE WHEN upper(trim(Label)) = 'BENIGN' THEN 'BENIGN' ELSE 'ANOMALY' END AS label, count(*) AS n FROM corpus GROUP BY ALL) GROUP BY label)"""))
def corpus_csv_split(spark, d):
    """From CSV files to capped and split training rows: how many of each class go where."""
    rows = corpus.clean(csv_files.training_rows(spark, _csv_folder(spark, d)), "row_id", "draw", "source_file")
    split = split_rows(corpus.capped(rows, 400), "label")
    return split.groupBy("label").agg(F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")])


@query("corpus_project", with_(sql.CORPUS, select="SELECT row_id, " + ", ".join(
    f"{'round(' + c + ', 6)' if c in ('flow_duration', 'packets_per_second') else c} AS {f}" for f, c in sql._MAP) + ", Label AS raw_label FROM corpus"))
def corpus_project(spark, d):
    rows = corpus.projected(fx.corpus(spark, d), "row_id").withColumnRenamed("Label", "raw_label")
    return rows.withColumns({"flow_duration": F.round("flow_duration", 6), "packets_per_second": F.when(
        F.col("packets_per_second") == float("inf"), F.col("packets_per_second")).otherwise(F.round("packets_per_second", 6))})


@query("binary_label", with_(sql.CORPUS, select="SELECT Label AS raw_label, CASE WHEN upper(trim(Label)) = 'BENIGN' THEN 'BENIGN' ELSE 'ANOMALY' END AS label, count(*) AS n FROM corpus GROUP BY ALL"))
def binary_labels(spark, d):
    return fx.corpus(spark, d).groupBy(F.col("Label").alias("raw_label")).agg(F.count("*").alias("n")).withColumn(
        "label", binary_label(F.col("raw_label")))


@query("corpus_clean", with_(*sql.CORPUS_PARTS, select=f"SELECT row_id, label, {sql_six(*NAMES)} FROM clean"))
def corpus_clean(spark, d):
    return clean_rows(spark, d).select("row_id", "label", *[six(n) for n in FEATURES])


@query("cap_per_class", with_(*sql.CORPUS_PARTS, select="""
SELECT source_file, label, row_id FROM clean QUALIFY row_number() OVER (PARTITION BY source_file, label ORDER BY draw, row_id) <= 400"""))
def cap_per_class(spark, d):
    return corpus.capped(clean_rows(spark, d), 400).select("source_file", "label", "row_id")


@query("stratified_split", with_(*sql.CORPUS_PARTS, select="""
SELECT row_id, label, CASE WHEN rn <= ceil(n * 30 / 100) - ceil(ceil(n * 30 / 100) / 2) THEN 'valid' WHEN rn <= ceil(n * 30 / 100) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw, row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM clean)"""))
def stratified_split(spark, d):
    return split_rows(clean_rows(spark, d), "label").select("row_id", "label", "split")


_MEDIANS = "medians AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS feature, coalesce(median({n}), 0) AS median FROM clean" for i, n in enumerate(NAMES)) + ")"
_STANDARD = "standard AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS feature, max(m.median) AS median, avg(coalesce({n}, m.median)) AS mean, stddev_pop(coalesce({n}, m.median)) AS deviation "
    f"FROM clean, medians m WHERE m.feature = '{n}'" for i, n in enumerate(NAMES)) + ")"


@query("median_fit", with_(*sql.CORPUS_PARTS, _MEDIANS, select="SELECT feature, round(median, 6) AS median FROM medians"))
def median_fit(spark, d):
    found = corpus.median_fit(clean_rows(spark, d))
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for p in found.items() for x in p])).alias("feature", "median")).select("feature", six("median"))


@query("median_fit_narrowing", with_(*sql.CORPUS_PARTS, _MEDIANS, select="SELECT feature, round(median, 6) AS median FROM medians"))
def median_fit_narrowing(spark, d):
    """Same medians, with the corpus treated as too large for Spark's exact aggregate."""
    found = corpus.median_fit(clean_rows(spark, d), small_rows=100)
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for p in found.items() for x in p])).alias("feature", "median")).select("feature", six("median"))


@query("standard_fit", with_(*sql.CORPUS_PARTS, _MEDIANS, _STANDARD, select="SELECT position, feature, round(median, 6) AS median, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM standard"))
def standard_fit(spark, d):
    return corpus.standard_fit(clean_rows(spark, d)).select("position", "feature", six("median"), six("mean"), six("deviation"))


@query("standard_apply", with_(*sql.CORPUS_PARTS, _MEDIANS, _STANDARD, "wide AS (SELECT " + ", ".join(
    f"max(median) FILTER (feature = '{n}') AS md_{n}, max(mean) FILTER (feature = '{n}') AS mn_{n}, max(deviation) FILTER (feature = '{n}') AS dv_{n}" for n in NAMES) + " FROM standard)",
    select="SELECT row_id, " + ", ".join(f"round((coalesce({n}, md_{n}) - mn_{n}) / CASE WHEN dv_{n} = 0 THEN 1 ELSE dv_{n} END, 6) AS {n}" for n in NAMES) + " FROM clean, wide"))
def standard_apply(spark, d):
    rows = clean_rows(spark, d)
    return corpus.standard_apply(rows, corpus.standard_fit(rows)).select("row_id", *[six(n) for n in FEATURES])


@query("dataset_summary", with_(*sql.CORPUS_PARTS, select="""
SELECT source_file, count(*) AS rows, count(*) FILTER (label = 'BENIGN') AS benign, count(*) FILTER (label <> 'BENIGN') AS anomaly
FROM clean GROUP BY ROLLUP (source_file)"""))
def dataset_summary(spark, d):
    return corpus.summary(fx.corpus(spark, d))


@query("dataset_sample", with_(*sql.CORPUS_PARTS, select=f"""
SELECT source_file, label, row_id, {sql_six(*NAMES)} FROM clean QUALIFY row_number() OVER (PARTITION BY source_file, label ORDER BY draw, row_id) <= 4"""))
def dataset_sample(spark, d):
    return corpus.sample(clean_rows(spark, d)).select("source_file", "label", "row_id", *[six(n) for n in FEATURES])


@query("class_weights", with_(*sql.CORPUS_PARTS, select="""
SELECT benign, anomaly, round(benign / greatest(anomaly, 1), 6) AS positive_weight,
  round((benign + anomaly) / (2 * greatest(benign, 1)), 6) AS benign_weight, round((benign + anomaly) / (2 * greatest(anomaly, 1)), 6) AS anomaly_weight
FROM (SELECT count(*) FILTER (label = 'BENIGN') AS benign, count(*) FILTER (label <> 'BENIGN') AS anomaly FROM clean)"""))
def class_weights(spark, d):
    return corpus.class_weights(clean_rows(spark, d)).select("benign", "anomaly", six("positive_weight"), six("benign_weight"), six("anomaly_weight"))


# ---- metrics of three deterministic stand-ins for trained models

def predictions(spark, d: str) -> DataFrame:
    rows = clean_rows(spark, d)
    flag = lambda c: F.when(c, F.lit(ANOMALY)).otherwise(F.lit(BENIGN))
    sure = lambda c: F.lit(0.5) + (F.col(c).cast("bigint") % 50).cast("double") / 100
    one = lambda name, kind, predicted, confidence, threshold: F.struct(
        F.lit(name).alias("model"), F.lit(kind).alias("kind"), predicted.alias("predicted"),
        confidence.alias("confidence"), F.lit(threshold).alias("threshold"))
    models = F.array(one("syn_rule", "supervised", flag(F.col("syn_count") >= 50), sure("total_fwd_bytes"), 0.5),
                     one("port_rule", "supervised", flag(F.col("dst_port") % 3 == 0), sure("total_bwd_bytes"), 0.7),
                     one("never", "novelty", F.lit(BENIGN), F.lit(1.0), 0.0))
    return rows.select("label", F.inline(models))


@query("confusion", with_(*sql.METRIC_PARTS, select="SELECT * FROM counts"))
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


@query("class_metrics", with_(*sql.METRIC_PARTS, sql.CLASS_METRICS, select='SELECT model, class, CAST(support AS BIGINT) AS support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM class_metrics'))
def class_metrics(spark, d):
    return metrics.class_metrics(metrics.confusion(predictions(spark, d))).select("model", "class", "support", six("precision"), six("recall"), six("f1"))


_MODEL_METRICS = """model_metrics AS (SELECT model, sum(hit) / sum(support) AS accuracy, avg(f1) FILTER (support > 0 OR called > 0) AS macro_f1,
  sum(f1 * support) / sum(support) AS weighted_f1 FROM class_metrics GROUP BY model)"""


@query("model_metrics", with_(*sql.METRIC_PARTS, sql.CLASS_METRICS, _MODEL_METRICS, select="SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM model_metrics"))
def model_metrics(spark, d):
    return metrics.model_metrics(metrics.confusion(predictions(spark, d))).select("model", six("accuracy"), six("macro_f1"), six("weighted_f1"))


@query("leaderboard", with_(*sql.METRIC_PARTS, sql.CLASS_METRICS, _MODEL_METRICS, select="SELECT model, round(macro_f1, 6) AS macro_f1 FROM model_metrics WHERE model <> 'never' ORDER BY macro_f1 DESC, model LIMIT 1"))
def leaderboard(spark, d):
    rows = predictions(spark, d)
    scores = metrics.model_metrics(metrics.confusion(rows))
    kind = F.when(F.col("model") == "never", F.lit("novelty")).otherwise(F.lit("supervised"))
    return metrics.leaderboard(scores.withColumn("kind", kind)).select("model", six("macro_f1"))


@query("alert_rates", with_(*sql.METRIC_PARTS, select="""
SELECT model, round(avg(a::INT) FILTER (b), 6) AS benign_false_alert_rate, round(avg(a::INT) FILTER (NOT b), 6) AS attack_alert_recall,
  round(avg((NOT a)::INT) FILTER (b), 6) AS safe_flow_rate, round(count(*) FILTER (a AND NOT b) / greatest(count(*) FILTER (a), 1), 6) AS attack_alert_precision
FROM (SELECT *, predicted = 'ANOMALY' AND confidence >= threshold AS a, label = 'BENIGN' AS b FROM predictions) GROUP BY model"""))
def alert_rates(spark, d):
    names = ["benign_false_alert_rate", "attack_alert_recall", "safe_flow_rate", "attack_alert_precision"]
    return metrics.alert_rates(predictions(spark, d)).select("model", *[six(n) for n in names])


@query("novelty_confidence", with_(*sql.CORPUS_PARTS, select="""
SELECT row_id, CASE WHEN score < -0.25::DOUBLE THEN 'ANOMALY' ELSE 'BENIGN' END AS predicted,
  round(CASE WHEN score < -0.25::DOUBLE THEN least(greatest((-0.25::DOUBLE - score) / 0.25, 0), 1) ELSE 1.0 END, 6) AS confidence
FROM (SELECT row_id, CAST((7 * CAST(total_fwd_bytes AS BIGINT) + CAST(total_bwd_bytes AS BIGINT)) % 1000 AS DOUBLE) / 1000 - 0.6::DOUBLE AS score FROM clean)"""))
def novelty_confidence(spark, d):
    score = F.expr("CAST((7 * CAST(total_fwd_bytes AS BIGINT) + CAST(total_bwd_bytes AS BIGINT)) % 1000 AS DOUBLE) / 1000 - 0.6D")
    rows = clean_rows(spark, d).select("row_id", score.alias("score"))
    return metrics.novelty_predictions(rows, "score", -0.25).select("row_id", "predicted", six("confidence"))
