"""Learning on feature tables: heads from Spark ML, rank ensembles, explanations, injected anomalies."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import pair_forest
from chronolake.operators.layouts import whole_series
from chronolake.operators.matrix import anchored_pairs

HEADS = {
    "logit": lambda: LogisticRegression(regParam=0.01),
    "dt": lambda: DecisionTreeClassifier(seed=1),
    "rf": lambda: RandomForestClassifier(numTrees=30, seed=1),
    "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "dtreg": lambda: DecisionTreeRegressor(seed=1),
    "rfreg": lambda: RandomForestRegressor(numTrees=30, seed=1),
    "gbtreg": lambda: GBTRegressor(maxIter=20, seed=1),
}
CLASSIFIERS = {"logit", "dt", "rf"}


def build(columns: list[str], head: str, components: int | None = None) -> Pipeline:
    """features -> scaling -> (principal components) -> head, on a column ``target``."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    last = "scaled"
    if components:
        stages.append(PCA(k=components, inputCol=last, outputCol="reduced"))
        last = "reduced"
    model = HEADS[head]().setFeaturesCol(last)
    if head in CLASSIFIERS:
        stages.append(StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"))
        model = model.setLabelCol("label")
    else:
        model = model.setLabelCol("target")
    return Pipeline(stages=[*stages, model])


def held_out(key: str, folds: int = 5) -> Column:
    """A repeatable split that doesn't depend on partitions."""
    return F.pmod(F.xxhash64(key), F.lit(folds)) == 0


def fit_predict(rows: DataFrame, key: str, columns: list[str], head: str, components: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """The fitted pipeline, and key, target, prediction of the held-out rows."""
    model = build(columns, head, components).fit(rows.where(~held_out(key)))
    return model, model.transform(rows.where(held_out(key))).select(key, "target", "prediction")


def rank_ensemble(scores: DataFrame, how: str = "mean") -> DataFrame:
    """sample_id, label: the class of highest aggregate score over models; ties to the smaller class.

    ``scores``: sample_id, model, class, score."""
    of = {"mean": F.avg("score"), "median": F.percentile("score", F.lit(0.5)), "min": F.min("score"), "max": F.max("score"), "product": F.exp(F.sum(F.ln(F.greatest("score", F.lit(1e-12)))))}[how]
    both = scores.groupBy("sample_id", "class").agg(of.alias("s"))
    return both.groupBy("sample_id").agg(F.max_by("class", F.struct(F.round("s", 9), -F.col("class"))).alias("label"))


def class_anchors(panel: DataFrame, each: int = 8) -> DataFrame:
    """``each`` rows of every class, by a hash of their id: the rows that all others are compared with."""
    w = Window.partitionBy("target").orderBy(F.xxhash64("sample_id"), "sample_id")
    return panel.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")


def pair_features(pairs: DataFrame, mode: str = "concat_absdiff") -> DataFrame:
    """``pairs`` (i, j, a, b) with features: both vectors and their differences (``concat_diff``, ``concat_absdiff``),
    or these alone (``diff_only``)."""
    diff = F.zip_with("b", "a", lambda x, y: F.abs(x - y) if mode == "concat_absdiff" else x - y)
    return pairs.withColumn("features", diff if mode == "diff_only" else F.concat("b", "a", diff))


def pairwise_classes(train: DataFrame, rows: DataFrame, each: int = 8, mode: str = "concat_absdiff", trees: int = 30) -> DataFrame:
    """sample_id, class, probability of ``rows`` (sample_id, values) by pairwise difference learning: a forest learns from
    the pairs of ``train`` with its anchors whether two samples differ in class; a class' probability is the mean
    similarity to its anchors, normalised, and equal for all classes where there is none."""
    anchors = class_anchors(train, each)
    labels = anchors.select(F.col("sample_id").alias("i"), F.col("target").alias("class"))
    own = train.select(F.col("sample_id").alias("j"), F.col("target").alias("tj"))
    pairs = pair_features(anchored_pairs(train, anchors), mode).join(F.broadcast(labels), "i").join(own, "j")
    table = pairs.select(array_to_vector("features").alias("features"), (F.col("class") != F.col("tj")).cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, seed=1).fit(table)
    asked = pair_features(anchored_pairs(rows, anchors), mode).join(F.broadcast(labels), "i").withColumn("features", array_to_vector("features"))
    same = model.transform(asked).select(F.col("j").alias("sample_id"), "class", F.get(vector_to_array("probability"), F.lit(0)).alias("same"))
    means = same.groupBy("sample_id", "class").agg(F.avg("same").alias("s"))
    w = Window.partitionBy("sample_id")
    total = F.sum("s").over(w)
    return means.select("sample_id", "class", F.when(total <= 1e-12, 1 / F.count("*").over(w)).otherwise(F.col("s") / total).alias("probability"))


def pairwise_values(train: DataFrame, rows: DataFrame, anchors: DataFrame, mode: str = "concat_diff", trees: int = 30) -> DataFrame:
    """sample_id, y: regression by pairwise differences: a forest learns how far a sample's target lies above an
    anchor's, from all pairs (``pair_forest``); a prediction is the mean over anchors of their target and that difference."""
    return pair_forest.predict(pair_forest.fit(train, anchors, mode, trees), rows, anchors)


def calibrated(scores: DataFrame, key: str) -> DataFrame:
    """``scores`` (key, y_true of 0 and 1, score) with probability: a sigmoid of the score, fitted on a fifth of the keys."""
    table = VectorAssembler(inputCols=["score"], outputCol="_x").transform(scores)
    model = LogisticRegression(featuresCol="_x", labelCol="y_true", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(table.where(held_out(key)))
    return model.transform(table).withColumn("probability", F.get(vector_to_array("_p"), F.lit(1))).drop("_x", "_p", "_r", "_c")


def split_conformal(residuals: DataFrame, forecasts: DataFrame, level: float = 0.9) -> DataFrame:
    """``forecasts`` (series_id, h, y) with low, high: the quantile of the absolute residuals (series_id, e)."""
    q = residuals.groupBy("series_id").agg(F.percentile(F.abs("e"), F.lit(level)).alias("q"))
    return forecasts.join(q, "series_id").select("series_id", "h", "y", (F.col("y") - F.col("q")).alias("low"), (F.col("y") + F.col("q")).alias("high"))


def inject(long: DataFrame, kind: str, start: int, end: int, size: float) -> DataFrame:
    """``long`` with an anomaly on start <= t <= end: shift, shift_down, dispersion and squeeze (about the
    mean), peak and dip (triangles), trend, noise (by a hash); and is_anomaly."""
    inside = F.col("t").between(start, end)
    share = (F.col("t") - start) / max(1, end - start)
    changed = {
        "shift": F.col("value") + size,
        "shift_down": F.col("value") - size,
        "dispersion": F.lit(None),
        "squeeze": F.lit(None),
        "dip": F.col("value") - size * (1 - F.abs(2 * share - 1)),
        "peak": F.col("value") + size * (1 - F.abs(2 * share - 1)),
        "trend": F.col("value") + size * share,
        "noise": F.col("value") + size * (F.pmod(F.xxhash64("series_id", "t"), F.lit(2001)) / 1000 - 1),
    }[kind]
    if kind in ("dispersion", "squeeze"):
        mean = F.avg(F.when(inside, F.col("value"))).over(whole_series())
        changed = mean + (F.col("value") - mean) * (size if kind == "dispersion" else 1 / size)
    return long.withColumn("value", F.when(inside, changed).otherwise(F.col("value"))).withColumn("is_anomaly", inside.cast("long"))


def occlusion(long: DataFrame, score: str, width: int) -> DataFrame:
    """series_id, block, importance: how much ``score`` (mean, sum, count or energy, the mean square) of a series changes
    without each block. What is left is the series' sums less the block's, so a series is aggregated once; a series of
    one block has no row."""
    x = F.col("value")
    blocks = long.groupBy("series_id", F.floor(F.col("t") / width).alias("block")).agg(F.count("value").alias("n"), F.coalesce(F.sum(x * x if score == "energy" else x), F.lit(0.0)).alias("s"))
    w = whole_series()
    rows = blocks.select("series_id", "block", "n", "s", F.sum("n").over(w).alias("wn"), F.sum("s").over(w).alias("ws"), F.count("*").over(w).alias("blocks"))

    def of(s: Column, n: Column) -> Column:
        return {"sum": s, "count": n.cast("double")}[score] if score in ("sum", "count") else F.try_divide(s, n)

    if score not in ("mean", "sum", "count", "energy"):
        raise ValueError(f"unknown score {score}")
    apart = F.abs(of(F.col("ws"), F.col("wn")) - of(F.col("ws") - F.col("s"), F.col("wn") - F.col("n")))
    return rows.where("blocks > 1").select("series_id", "block", apart.alias("importance"))


def greedy_ensemble(scores: DataFrame, targets: DataFrame, strategies: tuple[str, ...] = ("mean", "median", "min", "max", "product"), most: int = 16) -> DataFrame:
    """step, models, strategy, accuracy: models (sample_id, model, class, score) join by their own accuracy, best first (ties
    to the smaller name), ``most`` at most; at each size the best strategy is tried, and a row tells where it beats all
    before it. Step 1 is the best model alone. Every size and strategy is one aggregate over the scores."""

    def accuracy(labels: DataFrame) -> float:
        both = labels.join(targets.select("sample_id", "target"), "sample_id")
        return float(both.agg(F.avg((F.col("label") == F.col("target")).cast("double"))).first()[0] or 0.0)

    names = [r["model"] for r in scores.select("model").distinct().orderBy("model").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} models")
    own = {n: accuracy(rank_ensemble(scores.where(F.col("model") == n))) for n in names}
    order = sorted(names, key=lambda n: (-own[n], n))
    out = [(1, [str(order[0])], "single", own[order[0]])] if order else []
    for size in range(2, len(order) + 1):
        part = scores.where(F.col("model").isin(order[:size]))
        found = {s: accuracy(rank_ensemble(part, s)) for s in strategies}
        best = max(found, key=lambda s: found[s])
        if found[best] > out[-1][3]:
            out.append((size, [str(n) for n in order[:size]], best, found[best]))
    return scores.sparkSession.createDataFrame(out, "step long, models array<string>, strategy string, accuracy double")
