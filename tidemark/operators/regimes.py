"""Market regimes: labels from volatility and momentum, splits by time, and classifiers of pyspark.ml."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import so_far, trailing
from tidemark.functions.medians import with_expanding_median
from tidemark.operators import boosting
from tidemark.sources.files import write_text

#: Labels of regimes, and the columns that the models see.
LABELS = {0: "Low Vol / Bull (Calm Expansion)", 1: "Low Vol / Stagnant (Grinding Drift)", 2: "High Vol / Bear (Crisis / Selloff)", 3: "High Vol / Dynamic Rally (Volatile Rebound)"}
COLUMNS = [
    "daily_return", "return_5d", "return_20d", "return_60d", "volatility_20d", "volatility_60d", "sma_20_ratio", "sma_50_ratio", "sma_200_ratio", "volume_ratio", "drawdown", "momentum_3m", "momentum_6m",
]


def labelled(gold: DataFrame, benchmark: str) -> DataFrame:
    """The benchmark's rows with regime_target and regime_label; rows with a missing model column go.

    Volatility is low if it is at or below the trailing median of the 60-day one (252 rows, 60 of them needed; else of all rows so far, 30 needed).
    """
    own = gold.filter(F.col("symbol") == benchmark)
    w = trailing(252)
    n = lambda over: F.count("volatility_60d").over(over)
    rolling = F.when(n(w) >= 60, F.percentile("volatility_60d", F.lit(0.5)).over(w))
    rows = with_expanding_median(own, "volatility_60d", "_expanding")
    rows = rows.withColumn("_median", F.coalesce(rolling, F.when(n(so_far()) >= 30, F.col("_expanding"))))
    low, up = F.coalesce(F.col("volatility_20d") <= F.col("_median"), F.lit(False)), F.coalesce(F.col("momentum_3m") > 0, F.lit(False))
    target = F.when(low & up, 0).when(low, 1).when(~up, 2).otherwise(3)
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return rows.withColumn("regime_target", target).withColumn("regime_label", label[F.col("regime_target")]).drop("_median", "_expanding").na.drop(subset=COLUMNS)


def split(rows: DataFrame, train_end: str, val_end: str, test_end: str) -> dict[str, DataFrame]:
    d = F.col("date").cast("string")
    return {"train": rows.filter(d <= train_end), "val": rows.filter((d > train_end) & (d <= val_end)), "test": rows.filter((d > val_end) & (d <= test_end))}


def split_is_ordered(parts: dict[str, DataFrame]) -> bool:
    """Whether no part reaches into the next."""
    ends = {k: v.agg(F.min("date").alias("a"), F.max("date").alias("b")).first() for k, v in parts.items()}
    order = [ends[k] for k in ("train", "val", "test") if ends[k].a is not None]
    return all(x.b < y.a for x, y in zip(order[:-1], order[1:], strict=True))


def majority(rows: DataFrame) -> DataFrame:
    """The most frequent class; ties go to the least."""
    return rows.groupBy("regime_target").count().orderBy(F.desc("count"), "regime_target").limit(1)


def estimators(n: int) -> dict[str, object]:
    shared = {"featuresCol": "features", "labelCol": "regime_target"}
    return {
        "logistic": LogisticRegression(family="multinomial", maxIter=1000, regParam=1 / max(1, n), weightCol="_weight", **shared),
        "random_forest": RandomForestClassifier(numTrees=100, maxDepth=4, minInstancesPerNode=5, seed=42, **shared),
        "boosted": "softmax",
    }


def weighted(train: DataFrame) -> DataFrame:
    """Adds balanced class weights: rows / (classes * rows of the class). One row for each class is broadcast."""
    counts = train.groupBy("regime_target").count()
    total = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    return train.join(F.broadcast(counts.join(F.broadcast(total)).select("regime_target", (F.col("n") / (F.col("k") * F.col("count"))).alias("_weight"))), "regime_target")


def fit(train: DataFrame, estimator) -> PipelineModel | boosting.Boosted:
    """A fitted model with transform(); boosted trees see the features as they are, since cuts don't depend on their scale."""
    if estimator == "softmax":
        return boosting.fit(train, COLUMNS, "regime_target")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="raw"), scaler, estimator]).fit(train)


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("regime_target", F.col("prediction").cast("int").alias("prediction")).count()


def macro_scores(confusion: DataFrame) -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over labels that occur or are predicted; 0 for what is undefined."""
    c = F.col("count")
    by_true = confusion.groupBy(F.col("regime_target").alias("label")).agg(F.sum(c).alias("n_true"), F.sum(F.when(F.col("regime_target") == F.col("prediction"), c).otherwise(0)).alias("hit"))
    by_pred = confusion.groupBy(F.col("prediction").alias("label")).agg(F.sum(c).alias("n_pred"))
    rows = by_true.join(by_pred, "label", "full").na.fill(0)
    p, r = F.coalesce(F.col("hit") / F.nullif("n_pred", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("hit") / F.nullif("n_true", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return rows.agg((F.sum("hit") / F.nullif(F.sum("n_true"), F.lit(0))).alias("accuracy"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f1).alias("macro_f1"))


def train(parts: dict[str, DataFrame], names: tuple[str, ...] = ("logistic", "random_forest", "boosted")) -> tuple[str, PipelineModel | boosting.Boosted, dict[str, dict]]:
    """Fits the models and picks the champion by macro F1 on the validation part: (name, model, scores by name)."""
    rows = weighted(parts["train"]).persist()
    models, scores = {}, {}
    for name, estimator in estimators(rows.count()).items():
        if name in names:
            models[name] = fit(rows, estimator)
            scores[name] = macro_scores(confusion(models[name].transform(parts["val"]))).first().asDict()
    rows.unpersist()
    best = max(scores, key=lambda x: (scores[x]["macro_f1"] or 0, x))
    return best, models[best], scores


def latest(model: PipelineModel | boosting.Boosted, rows: DataFrame) -> dict:
    """The last row's regime, with a probability for each class id where the model gives one."""
    row = model.transform(rows.orderBy(F.desc("date")).limit(1)).first()
    values = [float(x) for x in row["probability"]]
    total = sum(values) or 1.0
    return {"date": str(row["date"]), "regime": int(row["prediction"]), "label": LABELS[int(row["prediction"])], "probabilities": {LABELS[i]: v / total for i, v in enumerate(values) if i in LABELS}}


def save(folder: str, name: str, model: PipelineModel | boosting.Boosted, scores: dict[str, dict], spark: SparkSession) -> None:
    """The champion (a model of pyspark.ml, or boosted trees as JSON), and its name and the scores of all models as JSON beside it."""
    if isinstance(model, boosting.Boosted):
        write_text(spark, model.to_json(), f"{folder}/model")
    else:
        model.write().overwrite().save(f"{folder}/model")
    write_text(spark, json.dumps({"champion": name, "scores": scores}, sort_keys=True), f"{folder}/metrics")


def load(spark: SparkSession, folder: str) -> tuple[PipelineModel | boosting.Boosted, dict]:
    """A stored champion and its metrics; `latest` infers from it in another session."""
    text = lambda name: spark.read.text(f"{folder}/{name}", wholetext=True).first().value
    metrics = json.loads(text("metrics"))
    return boosting.Boosted.from_json(text("model")) if metrics["champion"] == "boosted" else PipelineModel.load(f"{folder}/model"), metrics
