"""Training, checking, comparing and monitoring models on tables."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import saved
from . import arima
from .neighbours import FourierFeatures, Neighbours

REGRESSION, CLASSIFICATION = "regression", "classification"
#: Families that stand in for what is not available; results name them.
STAND_INS = {"lightgbm": "gradient_boosting", "xgboost": "gradient_boosting", "svm": "kernel_svm", "prophet": "seasonal", "sarimax": "arima"}
LOWER_IS_BETTER = ("rmse", "mae", "mape")


def slug(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def resolve(df: DataFrame, target: str, features: list[str]) -> tuple[DataFrame, str, list[str]]:
    """Columns by names that ignore case, accents and signs; ValueError without a target or any feature."""
    names = {slug(c): c for c in df.columns}
    if slug(target) not in names:
        raise ValueError(f"no target {target}")
    found = [f for f in features if slug(f) in names]
    if not found:
        raise ValueError("none of the features is there")
    return df.select(F.col(f"`{names[slug(target)]}`").alias(slug(target)), *[F.col(f"`{names[slug(f)]}`").alias(slug(f)) for f in found]), slug(target), [slug(f) for f in found]


def family_for(family: str, task: str) -> str:
    """The family that is trained for the one asked for."""
    family = STAND_INS.get(family, family)
    if task == REGRESSION:
        return {"logistic": "linear", "linear_svm": "linear", "kernel_svm": "kernel_ridge", "mlp": "gradient_boosting"}.get(family, family)
    return {"linear": "logistic", "elasticnet": "logistic"}.get(family, family)


def estimator(family: str, task: str, target: str, n_features: int = 1, seed: int = 42, **params):
    cols = {"labelCol": target, "featuresCol": "features"}
    if task == REGRESSION:
        return {
            "linear": lambda: LinearRegression(**cols, **params), "elasticnet": lambda: LinearRegression(**cols, **({"regParam": 0.1, "elasticNetParam": 0.5} | params)),
            "random_forest": lambda: RandomForestRegressor(**cols, seed=seed, **params), "gradient_boosting": lambda: GBTRegressor(**cols, seed=seed, **({"maxIter": 20} | params)),
            "knn": lambda: Neighbours(**cols, **params),
            "kernel_ridge": lambda: Pipeline(stages=[FourierFeatures(seed=seed), LinearRegression(labelCol=target, featuresCol="fourier", **({"regParam": 0.01} | params))]),
        }[family]()
    return {
        "logistic": lambda: LogisticRegression(**cols, weightCol="_weight", **params), "random_forest": lambda: RandomForestClassifier(**cols, seed=seed, weightCol="_weight", **params),
        "gradient_boosting": lambda: GBTClassifier(**cols, seed=seed, **({"maxIter": 20} | params)), "linear_svm": lambda: LinearSVC(**cols, weightCol="_weight", **params),
        "knn": lambda: Neighbours(**cols, classes=True, **params),
        "kernel_svm": lambda: Pipeline(stages=[FourierFeatures(seed=seed), LinearSVC(labelCol=target, featuresCol="fourier", weightCol="_weight", **params)]),
        "mlp": lambda: MultilayerPerceptronClassifier(**cols, seed=seed, **({"layers": [n_features, 16, 2]} | params)),
    }[family]()


def preprocessing(df: DataFrame, features: list[str]) -> tuple[list, list[str]]:
    """Median and scale for numbers; the most frequent value for texts without one, then one-hot; unseen values get a place of their own."""
    numeric = [f for f, t in df.dtypes if f in features and t not in ("string", "boolean")]
    texts = [f for f in features if f not in numeric]
    stages: list = []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=numeric, outputCols=[f"_i_{f}" for f in numeric]), VectorAssembler(inputCols=[f"_i_{f}" for f in numeric], outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
    if texts:
        modes = df.agg(*[F.mode(F.col(f).cast("string"), True).alias(f) for f in texts]).first()
        filled = ", ".join(f"coalesce(cast(`{f}` as string), '{_quoted(modes[f])}') AS `_m_{f}`" for f in texts if modes[f] is not None)
        stages += [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")] if filled else []
    for f in texts:
        source = f"_m_{f}" if modes[f] is not None else f
        stages += [StringIndexer(inputCol=source, outputCol=f"_x_{f}", handleInvalid="keep"), OneHotEncoder(inputCol=f"_x_{f}", outputCol=f"_h_{f}")]
    return [*stages, VectorAssembler(inputCols=(["_scaled"] if numeric else []) + [f"_h_{f}" for f in texts], outputCol="features")], numeric


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def holdout(df: DataFrame, order: str | None, key: str, share: float = 0.2, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test: the last rows by time, or a stable hash of the key, within each class if asked."""
    if order:
        cut = df.select(F.percentile(F.col(order).cast("timestamp").cast("double") if dict(df.dtypes)[order] in ("date", "timestamp") else F.col(order).cast("double"), 1 - share)).first()[0]
        value = F.col(order).cast("timestamp").cast("double") if dict(df.dtypes)[order] in ("date", "timestamp") else F.col(order).cast("double")
        return df.filter(value <= cut), df.filter(value > cut)
    if stratify:  # an even part of each class
        dealt = folds(df, "stratified", max(2, round(1 / share)), key, stratify)
        return dealt.filter("fold > 0").drop("fold"), dealt.filter("fold = 0").drop("fold")
    test = F.pmod(F.xxhash64(key), F.lit(1000)) < int(1000 * share)
    return df.filter(~test), df.filter(test)


def regression_metrics(df: DataFrame, actual: str, predicted: str, group: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2 and mape (which leaves out values near zero), in one aggregation."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*(group or [])).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.when(total > 0, total)).alias("r2"),
        F.avg(F.when(F.abs(y) > 1e-9, F.abs(e / y))).alias("mape"),
    )


def classification_metrics(df: DataFrame, actual: str, score: str, threshold: float = 0.5) -> DataFrame:
    """accuracy, f1, area under ROC (by average ranks), average precision and share of positives of a 0/1 target."""
    y, hit = F.col(actual).cast("int"), (F.col(score) >= threshold).cast("int")
    by_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    sums = _running(by_score, F.col("s"), ["n", "pos"])  # below each score
    total = sums.agg(F.sum("n").alias("all"), F.sum("pos").alias("p"))
    sums = sums.crossJoin(F.broadcast(total))  # one row
    precision = (F.col("p") - F.col("pos_before")) / (F.col("all") - F.col("n_before"))
    ranks = sums.agg(F.first("all").alias("all"), F.first("p").alias("p"), F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum(F.col("pos") * precision).alias("ap"))
    mixed = (F.col("p") > 0) & (F.col("all") > F.col("p"))
    auc = ranks.select(
        ((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / F.when(mixed, F.col("p") * (F.col("all") - F.col("p")))).alias("roc_auc"),
        (F.col("ap") / F.when(F.col("p") > 0, F.col("p"))).alias("average_precision"),
    )
    tp, fp, fn = F.count_if((y == 1) & (hit == 1)), F.count_if((y == 0) & (hit == 1)), F.count_if((y == 1) & (hit == 0))
    return df.agg(F.count("*").alias("n"), F.avg((y == hit).cast("int")).alias("accuracy"), (2 * tp / F.when(2 * tp + fp + fn > 0, 2 * tp + fp + fn)).alias("f1"), F.avg(y).alias("positive_share")).crossJoin(auc)  # one row each


#: The metric that a run is tuned by.
SCORERS = {REGRESSION: {"rmse": "rmse", "mae": "mae", "r2": "r2"}, CLASSIFICATION: {"accuracy": "accuracy", "average_precision": "average_precision", "roc_auc": "roc_auc"}}


def scorer(metric: str | None, task: str, n_classes: int = 2) -> tuple[str, bool]:
    """The metric to tune by and whether larger is better; the task's own (rmse, area under ROC) for unknown ones.

    Average precision is for two classes only.
    """
    name = SCORERS[CLASSIFICATION if task == CLASSIFICATION else REGRESSION].get((metric or "").strip().lower())
    if task == CLASSIFICATION:
        name = "roc_auc" if name is None or (name == "average_precision" and n_classes > 2) else name
    name = name or "rmse"
    return name, name not in LOWER_IS_BETTER


def positive_class(values: list[str], wanted: str | None = None) -> str | None:
    """The class that counts as positive: the wanted one (in any case), else the first in order that is a word for an event, else the last."""
    known = sorted({str(v) for v in values})
    plain = lambda v: v.strip().lower()
    asked = [v for v in known if wanted and plain(v) == plain(wanted)]
    events = [v for v in known if plain(v).removesuffix(".0") in POSITIVE]
    return next(iter(asked + events + known[-1:]), None)


#: Words for an event, in English and French.
POSITIVE = frozenset((
    "1", "true", "vrai", "oui", "yes", "positive", "positif", "pos", "event", "événement", "evenement", "case", "cas", "death", "décès", "deces", "deceased", "dead",
    "mort", "mortality", "mortalité", "malade", "disease", "present", "présent", "abnormal", "anormal",
))


def prepared(df: DataFrame, target: str, features: list[str], task: str, key: str, order: str | None, positive: str | None = None) -> tuple[DataFrame, str, list[str], str | None]:
    """Rows with a target, its name, the features' names and the positive class; classes become 0 and 1 with weights."""
    keep = [F.col(c) for c in {key, *([order] if order else [])} if c in df.columns]
    data, y, xs = resolve(df, target, features)
    data = df.select(*keep, F.col(f"`{_column(df, target)}`").alias(y), *[F.col(f"`{_column(df, f)}`").alias(slug(f)) for f in features if slug(f) in {slug(c) for c in df.columns} and slug(f) not in (key, order)]).dropna(subset=[y])
    xs = [x for x in xs if x in data.columns]
    if task == CLASSIFICATION:
        counts = {str(r[0]): r[1] for r in data.groupBy(y).count().limit(1001).collect()}
        if len(counts) < 2 or len(counts) > 1000 or min(counts.values()) < 2:
            raise ValueError("a class target has two to a thousand classes with two rows each")
        positive = positive_class(list(counts), positive)
        data = data.withColumn(y, (F.col(y).cast("string") == positive).cast("double"))
        share = data.agg(F.avg(y)).first()[0] or 0.0
        data = data.withColumn("_weight", F.when(F.col(y) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    return data, y, xs, positive


def train(df: DataFrame, target: str, features: list[str], task: str = REGRESSION, family: str = "linear", key: str = "id", order: str | None = None, positive: str | None = None, least: int = 20, **params) -> dict:
    """A fitted pipeline with its held-out metrics and warnings; ValueError below the least number of rows."""
    data, y, xs, positive = prepared(df, target, features, task, key, order, positive)
    rows = data.count()
    if rows < least:
        raise ValueError(f"{rows} rows; {least} are needed")
    used = family_for(family, task)
    stages, numeric = preprocessing(data, xs)
    fit, test = holdout(data, order, key if key in data.columns else xs[0], stratify=y if task == CLASSIFICATION else None)
    model = Pipeline(stages=[*stages, estimator(used, task, y, len(xs), **params)]).fit(fit)
    scored = score(model, test, task)
    metrics = (regression_metrics(scored, y, "score") if task == REGRESSION else classification_metrics(scored, y, "score")).first().asDict()
    top, by_variable = importances(model, xs, numeric)
    return {"model": model, "family": family, "method": used, "metrics": metrics, "importances": top, "importances_by_variable": by_variable, "n": rows, "target": y, "features": xs, "positive": positive, "warnings": guardrails(data, y, xs, task)}


def _column(df: DataFrame, name: str) -> str:
    return {slug(c): c for c in df.columns}[slug(name)]


def score(model: PipelineModel, df: DataFrame, task: str) -> DataFrame:
    """``df`` with score: the prediction, or the positive class's probability (the logistic function of the margin where a family gives no other)."""
    out = model.transform(df)
    if task == REGRESSION:
        return out.withColumn("score", F.col("prediction"))
    if "probability" in out.columns:
        return out.withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("score", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each class, and whether it is rare (below a tenth)."""
    by = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("all")
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("all")))).select("class", "n", share.alias("share"), (share < 0.1).alias("rare"))  # one row


def guardrails(df: DataFrame, target: str, features: list[str], task: str, leak: float = 0.999) -> list[str]:
    """Features that give the target away (by correlation, or by their own area under ROC), and rare classes."""
    numeric = [c for c, t in df.dtypes if c in features and t in ("int", "bigint", "double", "float")]
    row = df.agg(F.lit(1), *[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(c) for c in numeric]).first()
    found = {c: row[c] for c in numeric if row[c] is not None and row[c] >= leak}
    if task == CLASSIFICATION:
        for c in numeric:
            auc = classification_metrics(df.filter(F.col(c).isNotNull()), target, c).first()["roc_auc"]
            if c not in found and auc is not None and max(auc, 1 - auc) >= leak:
                found[c] = max(auc, 1 - auc)
    out = [f"leak: {c}" for c in numeric if c in found]
    if task == CLASSIFICATION:
        share = df.agg(F.avg(target)).first()[0] or 0.0
        out += [f"rare class: {min(share, 1 - share):.3f}"] if min(share, 1 - share) < 0.1 else []
    return out


def leaderboard(runs: DataFrame, metric: str) -> DataFrame:
    """Rank of each run; smaller is better for errors, failed runs come last without a rank."""
    value = F.col(metric).cast("double") * (1 if metric in LOWER_IS_BETTER else -1)
    known = runs.filter(F.col(metric).isNotNull())
    placed = _ranked(known, [], _bucket(known, value), [value, "family"]).withColumn("rank", (F.col("_rank") + 1).cast("int")).drop("_rank")
    return placed.unionByName(runs.filter(F.col(metric).isNull()).withColumn("rank", F.lit(None).cast("int")))


def compare(df: DataFrame, target: str, features: list[str], families: list[str], task: str = REGRESSION, metric: str = "rmse", **given) -> DataFrame:
    """A leaderboard of families; one that can't be trained on these rows is listed with the reason."""
    rows = []
    for f in families:
        try:
            got = train(df, target, features, task, f, **given)
            rows.append((f, got["method"], got["metrics"].get(metric), None))
        except (ValueError, AnalysisException, IllegalArgumentException) as e:
            rows.append((f, family_for(f, task), None, str(e)[:200]))
    return leaderboard(df.sparkSession.createDataFrame(rows, f"family string, method string, {metric} double, error string"), metric)


def _vectors(model: PipelineModel, features: list[str], numeric: list[str]) -> list[tuple[str, str]]:
    """(variable, name) of each place of the feature vector: numbers first, then a place for each level of a text."""
    out = [(f, f) for f in features if f in numeric]
    indexers = {m.getOutputCol().removeprefix("_x_"): m for m in model.stages if isinstance(m, StringIndexerModel)}
    encoders = {m.getInputCol(): m for m in model.stages if isinstance(m, OneHotEncoderModel)}
    for f in features:
        if f in indexers:
            places = encoders[f"_x_{f}"].categorySizes[0] - 1
            levels = [*indexers[f].labels, "other"][:places]
            out += [(f, f"{f}={level}") for level in levels]
    return out


def importances(model: PipelineModel, features: list[str], numeric: list[str], top: int = 20) -> tuple[list[tuple[str, float]], dict[str, float]]:
    """The places of the feature vector that weigh most, and the share of each variable (they sum to 1; all zero without any weight).

    Weights are a tree family's importances or the size of a linear one's coefficients; other families have none.
    """
    last = model.stages[-1]
    weights = getattr(last, "featureImportances", None)
    weights = weights if weights is not None else getattr(last, "coefficients", None)
    if weights is None:
        return [], {}
    named = [(v, name, abs(float(w))) for (v, name), w in zip(_vectors(model, features, numeric), weights.toArray())]
    total = sum(w for *_, w in named) or 1.0
    by = {f: sum(w for v, _, w in named if v == f) / total for f in features}
    return sorted(((name, w) for _, name, w in named), key=lambda x: (-x[1], x[0]))[:top], by


#: By family, range (and scale) of each tuned parameter.
SPACES: dict[str, dict[str, tuple]] = {
    "gradient_boosting": {"maxIter": (50, 300, "int"), "stepSize": (0.01, 0.3, "log"), "maxDepth": (2, 5, "int")},
    "lightgbm": {"maxIter": (100, 600, "int"), "stepSize": (0.01, 0.3, "log"), "maxDepth": (2, 8, "int"), "subsamplingRate": (0.6, 1.0, "linear"), "featureSubsetStrategy": (0.6, 1.0, "text")},
    "random_forest": {"numTrees": (100, 400, "int"), "maxDepth": (3, 20, "int"), "minInstancesPerNode": (2, 10, "int")},
    "logistic": {"regParam": (1e-2, 1e3, "log")},
    "elasticnet": {"regParam": (1e-3, 10.0, "log"), "elasticNetParam": (0.0, 1.0, "linear")},
    "svm": {"regParam": (1e-2, 1e2, "log")},
    "linear": {},
}
SPACES |= {"xgboost": SPACES["lightgbm"], "knn": {"n_neighbors": (3, 25, "int"), "weights": ("uniform", "distance", "choice")}}
#: Hidden layers that a perceptron may have.
HIDDEN = ((64,), (128,), (64, 32))


def search_space(family: str, trials: int, n_features: int = 1, seed: int = 42) -> list[dict]:
    """Parameters of each trial, drawn from the family's ranges; one empty set where nothing can be tuned."""
    rng = random.Random(seed)
    if family == "mlp":
        return [{"layers": [n_features, *rng.choice(HIDDEN), 2]} for _ in range(trials)]
    space = SPACES.get(family, {})

    def draw(low, high, scale: str) -> int | float | str:
        if scale == "choice":
            return rng.choice((low, high))
        if scale == "int":
            return rng.randint(int(low), int(high))
        x = math.exp(rng.uniform(math.log(low), math.log(high))) if scale == "log" else rng.uniform(low, high)
        return str(round(x, 3)) if scale == "text" else x

    return [{name: draw(*given) for name, given in space.items()} for _ in range(trials)] if space else [{}]


def _ranked(df: DataFrame, by: list[str], bucket: Column, order: list[Column | str]) -> DataFrame:
    """``df`` with _rank, from 0 within ``by``: a rank in each bucket plus the rows of the buckets before it, so no class is ordered in one task."""
    rows = df.withColumn("_bucket", bucket)
    before = F.sum("count").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("count")
    before = rows.groupBy(*by, "_bucket").count().select(*by, "_bucket", before.alias("_before"))
    within = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_rank", within).join(before, [*by, "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")


def _bucket(df: DataFrame, value: Column, buckets: int = 256) -> Column:
    """About equal stretches of a value's range, as numbers in its order; nulls are in the first."""
    cuts = df.select(value.alias("v")).approxQuantile("v", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    cuts = np.array(sorted(set(cuts)))

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy(float)))

    return F.when(value.isNotNull(), place(value.cast("double"))).otherwise(0) if len(cuts) else F.lit(0)


def _running(df: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """``df`` with, for each column c, c_before: its sum over the rows before, in two levels so that no task has all rows."""
    rows = df.withColumn("_bucket", _bucket(df, order))
    within = W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in columns])  # a few hundred rows
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("_bucket"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    rows = rows.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).join(totals, "_bucket")
    return rows.select(*df.columns, *[(F.col(f"_{c}") + F.col(f"_in_{c}")).alias(f"{c}_before") for c in columns])


def folds(df: DataFrame, strategy: str, k: int, key: str, label: str | None = None, order: str | None = None, buckets: int = 256) -> DataFrame:
    """``df`` with fold, an int from 0: by a hash of the key (kfold), evenly within each class (stratified), or by time (timeseries).

    By time, the last k of k + 1 equal stretches are the folds, rows before them have fold -1, and a fold is
    tested on a model of all earlier rows.  Rows without a class or time are left out.
    """
    h = F.xxhash64(key)
    if strategy == "kfold":
        return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
    if strategy == "stratified":
        rows = _ranked(df.filter(F.col(label).isNotNull()), [label], F.pmod(h, F.lit(buckets)), [h, key])
        return rows.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")
    rows = df.filter(F.col(order).isNotNull())
    time = F.unix_micros(F.col(order).cast("timestamp")).cast("double") if dict(df.dtypes)[order].startswith(("date", "timestamp")) else F.col(order).cast("double")
    n = rows.count()  # before the ranks, whose join keeps all rows
    size = max(1, n // (k + 1))
    rows, start = _ranked(rows, [], _bucket(rows, time, buckets), [order, key]), F.lit(n - k * size)
    return rows.withColumn("fold", F.greatest(F.floor((F.col("_rank") - start) / size), F.lit(-1)).cast("int")).drop("_rank")


def cross_validate(df: DataFrame, target: str, features: list[str], task: str = REGRESSION, family: str = "linear", key: str = "id", order: str | None = None, k: int = 5, strategy: str | None = None, positive: str | None = None, **params) -> dict[str, float]:
    """Metrics as means over the folds, and their population deviations as ``<metric>_std``; classes are stratified unless asked otherwise."""
    data, y, xs, _ = prepared(df, target, features, task, key, order, positive)
    strategy = strategy or ("stratified" if task == CLASSIFICATION else "kfold")
    data = folds(data, strategy, k, key, y, order)
    got = []
    for i in range(k):
        fit = data.filter(F.col("fold") < i if strategy == "timeseries" else F.col("fold") != i)
        stages, _ = preprocessing(data, xs)
        model = Pipeline(stages=[*stages, estimator(family_for(family, task), task, y, len(xs), **params)]).fit(fit)
        scored = score(model, data.filter(F.col("fold") == i), task)
        got.append((regression_metrics(scored, y, "score") if task == REGRESSION else classification_metrics(scored, y, "score")).first().asDict())
    known = {m: [g[m] for g in got if g[m] is not None] for m in got[0] if m != "n"}
    mean = {m: sum(v) / len(v) for m, v in known.items() if v}
    return mean | {f"{m}_std": math.sqrt(sum((x - mean[m]) ** 2 for x in v) / len(v)) for m, v in known.items() if v}


def unstable(cv: dict[str, float], metric: str, most: float = 0.25) -> str | None:
    """A warning if a metric's deviation over the folds is more than ``most`` of its mean."""
    mean, sd = cv.get(metric), cv.get(f"{metric}_std")
    if mean is None or sd is None or abs(mean) < 1e-12 or sd / abs(mean) <= most:
        return None
    return f"unstable {metric}: {sd / abs(mean):.2f}"


def tune(df: DataFrame, target: str, features: list[str], task: str = REGRESSION, family: str = "gradient_boosting", trials: int = 25, metric: str = "rmse", seed: int = 42, **given) -> dict:
    """The best of some trials by cross-validation: its parameters, metrics and place."""
    best: dict = {}
    for n, params in enumerate(search_space(family, trials, len(features), seed)):
        metrics = cross_validate(df, target, features, task, family, **given, **params)
        value = metrics.get(metric)
        if value is not None and (not best or (value < best["value"] if metric in LOWER_IS_BETTER else value > best["value"])):
            best = {"trial": n, "value": value, "params": params, "metrics": metrics}
    return best


def bootstrap_ci(df: DataFrame, actual: str, predicted: str, key: str, rounds: int = 300, metric: str = "rmse", least: int = 20, least_rounds: int = 30) -> DataFrame:
    """95 % interval of a metric over Poisson-weighted resamples of the rows (weights follow a hash of key and round).

    Null below the least number of rows or of resamples with a value.
    """
    u = lambda r: (F.pmod(F.xxhash64(key, r), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(6):
        total += term
        cuts.append(total)
        term /= k + 1
    rows = df.select(key, F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    weight = reduce(lambda a, c: a + (F.col("u") > c).cast("int"), cuts, F.lit(0))
    rows = rows.withColumn("u", u(F.col("round"))).withColumn("w", weight)
    error = F.col("y") - F.col("p")
    value = F.sqrt(F.sum(F.col("w") * error * error) / F.sum("w")) if metric == "rmse" else F.sum(F.col("w") * F.abs(error)) / F.sum("w")
    got = rows.groupBy("round").agg(value.alias("value"), F.count("*").alias("n")).agg(F.count("value").alias("rounds"), F.max("n").alias("n"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    enough = (F.col("n") >= least) & (F.col("rounds") >= least_rounds)
    return got.select("rounds", *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high")])


def explain(model: PipelineModel, df: DataFrame, features: list[str], task: str, key: str) -> DataFrame:
    """By row and feature: how the score changes when the feature takes its median or most frequent value."""
    base = score(model, df, task).select(key, F.col("score").alias("base"))
    kinds = dict(df.dtypes)
    row = df.agg(*[(F.mode(f, True) if kinds[f] == "string" else F.median(f)).alias(f) for f in features]).first()
    parts = [score(model, df.withColumn(f, F.lit(row[f]).cast(kinds[f])), task).select(key, F.lit(f).alias("feature"), "score") for f in features]
    return reduce(DataFrame.unionByName, parts).join(base, key).select(key, "feature", (F.col("base") - F.col("score")).alias("effect"))


def level(value: Column, orange: Column, red: Column) -> Column:
    """green, orange or red; unavailable without a value or bands."""
    known = value.isNotNull() & ~F.isnan(value) & orange.isNotNull() & red.isNotNull()
    return F.when(~known, "unavailable").when(value >= red, "red").when(value >= orange, "orange").otherwise("green")


def monitor(scored: DataFrame, target: DataFrame | None, value: str = "score", column: str | None = None, bands: tuple[float, float] | None = None) -> DataFrame:
    """The mean of recent scores against bands: given ones, thirds of the target (five values or more), or 0.33 and 0.66."""
    mean = scored.agg(F.avg(value).alias("value"), F.count("*").alias("n_scored"))
    if bands is not None:
        out = mean.withColumns({"orange": F.lit(float(bands[0])), "red": F.lit(float(bands[1])), "bands_source": F.lit("literature")})
    elif target is not None and column is not None:
        q = target.agg(F.percentile(column, 0.33).alias("o"), F.percentile(column, 0.66).alias("r"), F.count(column).alias("k"))
        out = mean.crossJoin(q).select("value", "n_scored", F.when(F.col("k") >= 5, F.col("o")).alias("orange"), F.when(F.col("k") >= 5, F.col("r")).alias("red"), F.lit("data_quantiles").alias("bands_source"))  # one row each
    else:
        out = mean.withColumns({"orange": F.lit(0.33), "red": F.lit(0.66), "bands_source": F.lit("default_probability")})
    return out.withColumn("level", level(F.col("value"), F.col("orange"), F.col("red")))


def seasonal_forecast(df: DataFrame, day: str, value: str, period: int, horizon: int | None = None, group: str | None = None) -> DataFrame:
    """Forecasts with an 80 % band by a regression on trend, season and the last value; needs 16 points.

    It stands in for SARIMAX and Prophet, which are not available; ``method`` says so.
    """
    import numpy as np
    import pandas as pd

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        s = part.groupby("day")["value"].mean().sort_index()
        n = len(s)
        columns = ["grp", "step", "forecast", "lower", "upper", "method"]
        if n < 16:
            return pd.DataFrame(columns=columns)
        h = horizon or max(2, min(max(3, min(24, round(n * 0.2))), n // 3))
        t = np.arange(n + h)
        x = [np.ones(n + h), t / n]
        if period > 1 and n >= 2 * period:
            x += [f(2 * np.pi * t / period) for f in (np.sin, np.cos)]
        x = np.column_stack(x)
        w = np.linalg.lstsq(x[:n], s.to_numpy(float), rcond=None)[0]
        rest = s.to_numpy(float) - x[:n] @ w
        phi = float(np.clip((rest[1:] @ rest[:-1]) / max(rest[:-1] @ rest[:-1], 1e-12), -0.98, 0.98))
        noise = float(np.std(rest[1:] - phi * rest[:-1]))
        step = np.arange(1, h + 1)
        mid = x[n:] @ w + rest[-1] * phi**step
        sd = noise * np.sqrt(np.cumsum(phi ** (2 * (step - 1))))
        return pd.DataFrame({"grp": part["grp"].iloc[0], "step": step, "forecast": mid, "lower": mid - 1.2815515655 * sd, "upper": mid + 1.2815515655 * sd, "method": "seasonal_regression"})

    rows = df.select((F.col(group).cast("string") if group else F.lit("all")).alias("grp"), F.to_date(day).alias("day"), F.col(value).cast("double").alias("value")).dropna()
    rows = rows.groupBy("grp", "day").agg(F.avg("value").alias("value"))
    return rows.groupBy("grp").applyInPandas(fit, "grp string, step int, forecast double, lower double, upper double, method string")


def forecast(df: DataFrame, day: str, value: str, period: int, family: str = "prophet", horizon: int | None = None, group: str | None = None) -> DataFrame:
    """Forecasts of every series by a family: sarimax (``arima.forecast``), or the regression that stands in for prophet."""
    if family == "sarimax":
        return arima.forecast(df, day, value, period, horizon, group).select("grp", "step", "forecast", "lower", "upper", "method")
    return seasonal_forecast(df, day, value, period, horizon, group)


def train_series(df: DataFrame, day: str, value: str, period: int, family: str = "prophet", horizon: int | None = None, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Forecasts of every series, and (grp, n, rmse, mae, r2, mape) of its last days, forecast from those before them.

    Orders are chosen on the days before, so the metrics are of days that no choice has seen.
    """
    days = saved(arima.days_of(df, day, value, group).withColumn("held", arima.horizon_of(F.col("days"), horizon)).filter(F.col("days") >= arima.LEAST))
    past = days.filter(F.col("n") <= F.col("days") - F.col("held"))
    guess = forecast(past.select("grp", "day", "value"), "day", "value", period, family, horizon or 24, "grp")
    real = days.filter(F.col("n") > F.col("days") - F.col("held")).select("grp", "value", (F.col("n") - F.col("days") + F.col("held")).alias("step"))
    return forecast(days.select("grp", "day", "value"), "day", "value", period, family, horizon, "grp"), regression_metrics(real.join(guess, ["grp", "step"]), "value", "forecast", ["grp"])
