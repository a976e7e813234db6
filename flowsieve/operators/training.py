"""Supervised models on the labelled corpus, and the fitted unit that scores flows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators import corpus, novelty, votes
from flowsieve.operators.selection import quantiles, stratified_split
from flowsieve.schemas import ANOMALY, BENIGN, FEATURES
from flowsieve.session import settle

# Training settings.
TREES, QUICK_TREES = 400, 100
CAP_PER_FILE_CLASS = 40_000
ISOLATION_TREES, ISOLATION_ROWS = 300, 256
NU, NOVELTY_QUANTILE = 0.05, 0.01
ALERT_THRESHOLD = 0.50
# Rows of one training task; tables of up to WHOLE_ROWS rows stay in the tasks their files give.
TASK_ROWS, WHOLE_ROWS = 32_768, 65_536


@dataclass
class Settings:
    cap: int = CAP_PER_FILE_CLASS
    seed: int = 42
    quick: bool = False
    max_depth: int = 16
    trees: int | None = None
    #: rounds without a better validation loss after which boosting stops; None leaves stopping to Spark's tolerance rule
    patience: int | None = None

    @property
    def tree_count(self) -> int:
        return self.trees or (QUICK_TREES if self.quick else TREES)


def prepare(clean: DataFrame, settings: Settings) -> DataFrame:
    """Capped, split and weighted rows, written once; every model reads this table."""
    split = settle(stratified_split(corpus.capped(clean, settings.cap), "label"))
    weights = corpus.class_weights(split.filter("split = 'train'")).first()
    attack = F.col("label") == ANOMALY
    return split.withColumns({
        "target": attack.cast("double"),
        "balanced_weight": F.when(attack, F.lit(weights["anomaly_weight"])).otherwise(F.lit(weights["benign_weight"])),
        "positive_weight": F.when(attack, F.lit(weights["positive_weight"])).otherwise(F.lit(1.0))})


def preprocessing(stats: DataFrame) -> list:
    """Impute, standardise, assemble: plain stages that are saved with the model."""
    parts = [f"(coalesce(nanvl(CAST({r['feature']} AS DOUBLE), NULL), CAST({r['median']!r} AS DOUBLE)) - CAST({r['mean']!r} AS DOUBLE))"
             f" / CAST({(r['deviation'] or 1.0)!r} AS DOUBLE) AS {r['feature']}_std" for r in stats.collect()]
    scale = SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")
    return [scale, VectorAssembler(inputCols=[f"{f}_std" for f in FEATURES], outputCol="inputs", handleInvalid="keep")]


def dealt(rows: DataFrame) -> DataFrame:
    """Training rows in tasks of about TASK_ROWS rows, even if they were all written to one file.

    Trees draw their samples task by task, so a row's task and place come from the row alone.
    """
    n = rows.count()
    if n <= WHOLE_ROWS:
        return rows
    keys = ["row_id", *FEATURES]
    return rows.repartition(-(-n // TASK_ROWS), *keys).sortWithinPartitions(*keys, "label")


def fit_forest(rows: DataFrame, stats: DataFrame, settings: Settings) -> PipelineModel:
    forest = RandomForestClassifier(
        featuresCol="inputs", labelCol="target", weightCol="balanced_weight", numTrees=settings.tree_count,
        minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=settings.max_depth, maxBins=128,
        maxMemoryInMB=1024, cacheNodeIds=True, seed=settings.seed)
    return Pipeline(stages=[*preprocessing(stats), forest]).fit(dealt(rows.filter("split = 'train'")))


def fit_boosted(rows: DataFrame, stats: DataFrame, settings: Settings) -> PipelineModel:
    own = {} if settings.patience else {"validationIndicatorCol": "is_valid", "validationTol": 0.001}
    boosted = GBTClassifier(
        featuresCol="inputs", labelCol="target", weightCol="positive_weight", maxIter=settings.tree_count, maxDepth=6,
        stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=128, maxMemoryInMB=1024, seed=settings.seed, **own)
    if settings.patience:
        fitted = Pipeline(stages=[*preprocessing(stats), boosted]).fit(dealt(rows.filter("split = 'train'")))
        losses = round_losses(fitted, rows.filter("split = 'valid'"))
        return PipelineModel([*fitted.stages[:-1], first_rounds(fitted.stages[-1], best_round(losses, settings.patience))])
    seen = rows.filter("split IN ('train', 'valid')").withColumn("is_valid", F.col("split") == "valid")
    return Pipeline(stages=[*preprocessing(stats), boosted]).fit(dealt(seen))


def round_losses(fitted: PipelineModel, rows: DataFrame) -> list[float]:
    """The mean logistic loss of the first 1, 2, ... rounds of a boosted model on the rows."""
    return fitted.stages[-1].evaluateEachIteration(_staged(fitted, rows))


def best_round(losses: list[float], patience: int) -> int:
    """The round of the least loss among those before `patience` rounds in a row have brought no better one."""
    best = 0
    for n, loss in enumerate(losses):
        if loss < losses[best]:
            best = n
        elif n - best >= patience:
            break
    return best + 1


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model of the first rounds alone, with the settings of the whole one."""
    context, whole = SparkSession.active().sparkContext, model._java_obj
    jvm, array = context._jvm, context._gateway.new_array
    trees, weights = array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds), array(jvm.double, rounds)
    for n, (tree, weight) in enumerate(zip(list(whole.trees())[:rounds], list(whole.treeWeights())[:rounds])):
        trees[n], weights[n] = tree, weight
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid(), trees, weights, whole.numFeatures(), 2)
    out = GBTClassificationModel(whole.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap()))
    out._transfer_params_from_java()
    return out


def _staged(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with what all stages before the classifier add."""
    staged = rows
    for stage in model.stages[:-1]:
        staged = stage.transform(staged)
    return staged


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `probability` as an array in class order: anomaly, benign."""
    stale = [c for c in ("probability",) if c in rows.columns]
    classifier, rows = model.stages[-1], rows.drop(*stale)
    if isinstance(classifier, RandomForestClassificationModel) and classifier.numClasses == 2:
        found = votes.probabilities(_staged(model, rows), classifier, "inputs")
    else:
        p = vector_to_array("probability")
        found = (model.transform(rows).withColumn("probability", F.array(p[1], p[0]))
                 .drop("rawPrediction", "prediction"))
    return found.drop(*[f"{f}_std" for f in FEATURES])


def model_inputs(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `model_inputs`: the standardised feature array the trees see."""
    return (_staged(model, rows).withColumn("model_inputs", vector_to_array("inputs"))
            .drop("inputs", *[f"{f}_std" for f in FEATURES]))


@dataclass
class Novelty:
    """A fitted detector: preprocessing statistics, the model and its threshold."""
    stats: DataFrame
    threshold: float
    forest: DataFrame | None = None
    weights: list[float] | None = None
    rho: float = 0.0

    def score(self, rows: DataFrame, name: str = "anomaly_score") -> DataFrame:
        raw = {f"_raw_{f}": F.col(f) for f in FEATURES}
        scaled = corpus.standard_apply(rows.withColumns(raw), self.stats)
        scored = (novelty.isolation_score(scaled, self.forest, name) if self.forest is not None
                  else novelty.oneclass_score(scaled, self.weights, self.rho, name))
        return scored.withColumns({f: F.col(f"_raw_{f}") for f in FEATURES}).drop(*raw)


def _threshold(detector: Novelty, rows: DataFrame) -> Novelty:
    scored = detector.score(rows.filter((F.col("split") == "valid") & (F.col("label") == BENIGN)))
    found = quantiles(settle(scored.select("anomaly_score")), ["anomaly_score"], NOVELTY_QUANTILE)["anomaly_score"]
    detector.threshold = 0.0 if found is None else found
    return detector


def benign_train(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("split") == "train") & (F.col("label") == BENIGN))


def fit_isolation(rows: DataFrame, settings: Settings, trees: int = ISOLATION_TREES) -> Novelty:
    stats = settle(corpus.standard_fit(benign_train(rows)))
    scaled = corpus.standard_apply(benign_train(rows), stats)
    forest = novelty.fit_isolation(scaled, trees, ISOLATION_ROWS, settings.seed)
    return _threshold(Novelty(stats, 0.0, forest=forest), rows)


def fit_oneclass(rows: DataFrame, settings: Settings, epochs: int = 1000) -> Novelty:
    stats = settle(corpus.standard_fit(benign_train(rows)))
    weights, rho = novelty.fit_oneclass(corpus.standard_apply(benign_train(rows), stats), NU, epochs)
    return _threshold(Novelty(stats, 0.0, weights=weights, rho=rho), rows)


@dataclass
class Detector:
    """The unit that is saved and loaded: classifier, features, metrics and novelty detector."""
    name: str
    classifier: PipelineModel
    novelty: Novelty
    metrics: dict

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.classifier.write().overwrite().save(f"{path}/classifier")
        self.novelty.stats.write.mode("overwrite").parquet(f"{path}/novelty_stats")
        self.novelty.forest.write.mode("overwrite").parquet(f"{path}/novelty_forest")
        note = json.dumps({"model": self.name, "features": FEATURES, "threshold": self.novelty.threshold,
                           "metrics": self.metrics})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")

    @classmethod
    def load(cls, path: str) -> "Detector":
        spark = SparkSession.active()
        note = json.loads(spark.read.text(f"{path}/note").first()["value"])
        if note["features"] != FEATURES:
            raise ValueError(f"saved features {note['features']} differ from {FEATURES}")
        classifier = PipelineModel.load(f"{path}/classifier")
        if classifier.stages[-1].numClasses != 2:
            raise ValueError("the classifier must have the two classes BENIGN and ANOMALY")
        found = Novelty(spark.read.parquet(f"{path}/novelty_stats"), note["threshold"],
                        forest=spark.read.parquet(f"{path}/novelty_forest"))
        return cls(note["model"], classifier, found, note["metrics"])

    def score(self, rows: DataFrame) -> DataFrame:
        return self.novelty.score(score(self.classifier, rows))
