"""Tables over benchmark records: leaderboards, ranks, deltas, coverage.

Records: dataset, model, metric, value (and status). ``higher`` says whether higher is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(value: str, higher: bool) -> Column:
    return F.desc(value) if higher else F.asc(value)


def successful(records: DataFrame) -> DataFrame:
    """Records that succeeded and have a number."""
    return records.where("status = 'success'").withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL")


def leaderboard(records: DataFrame, higher: bool) -> DataFrame:
    """model, mean, n, place (dense)."""
    means = records.groupBy("model").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return means.withColumn("place", F.dense_rank().over(Window.orderBy(_order("mean", higher))).cast("long"))


def ranked(records: DataFrame, higher: bool) -> DataFrame:
    """Records with low_rank (ties share the lowest) and rank (ties share the average) within their dataset."""
    w = Window.partitionBy("dataset").orderBy(_order("value", higher))
    ties = F.count("*").over(Window.partitionBy("dataset", "value"))
    low = F.rank().over(w).cast("long")
    return records.withColumn("low_rank", low).withColumn("rank", F.col("low_rank") + (ties - 1) / 2)


def mean_ranks(records: DataFrame, higher: bool) -> DataFrame:
    return ranked(records, higher).groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def top_k(records: DataFrame, higher: bool) -> DataFrame:
    """model, top1, top3, top5, top_half: on how many datasets a model is there."""
    r = ranked(records, higher).withColumn("k", F.count("*").over(Window.partitionBy("dataset")))
    half = F.greatest(F.lit(1).cast("long"), F.floor(F.col("k") / 2))
    tops = [F.count_if(F.col("low_rank") <= i).alias(f"top{i}") for i in (1, 3, 5)]
    return r.groupBy("model").agg(*tops, F.count_if(F.col("low_rank") <= half).alias("top_half"))


def best_by_dataset(records: DataFrame, higher: bool) -> DataFrame:
    """dataset, model, value of the best; ties to the first model by name."""
    w = Window.partitionBy("dataset").orderBy(_order("value", higher), "model")
    return records.withColumn("n", F.row_number().over(w)).where("n = 1").select("dataset", "model", "value")


def delta(records: DataFrame, target: str, higher: bool) -> DataFrame:
    """dataset, target, reference (the best other), delta, percent (of the reference, of 1 where that is 0)."""
    own = records.where(F.col("model") == target).groupBy("dataset").agg(F.avg("value").alias("target"))
    best = F.max("value") if higher else F.min("value")
    other = records.where(F.col("model") != target).groupBy("dataset").agg(best.alias("reference"))
    d = F.col("target") - F.col("reference")
    base = F.when(F.col("reference") == 0, 1.0).otherwise(F.abs("reference"))
    return own.join(other, "dataset").select("dataset", "target", "reference", d.alias("delta"), (100 * d / base).alias("percent"))


def coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: expected, observed, percent, missing (sorted, comma-separated names)."""
    gone = expected.select("dataset").distinct().join(observed.select("dataset").distinct(), "dataset", "left_anti")
    lost = gone.agg(F.count("*").alias("m"), F.array_join(F.sort_array(F.collect_set("dataset")), ",").alias("missing"))
    n = expected.agg(F.count_distinct("dataset").alias("expected"))
    both = n.crossJoin(lost)
    got = F.col("expected") - F.col("m")
    return both.select("expected", got.alias("observed"), (100.0 * got / F.greatest("expected", F.lit(1))).alias("percent"), "missing")


def status_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("dataset").alias("datasets"), F.count_distinct("model").alias("models"))


def difficulty(records: DataFrame, higher: bool) -> DataFrame:
    """dataset, score (of the best; 1 / (1 + x) where lower is better), level."""
    best = records.groupBy("dataset").agg((F.max("value") if higher else F.min("value")).alias("best"))
    score = F.col("best") if higher else 1 / (1 + F.greatest(F.col("best"), F.lit(0.0)))
    level = F.when(F.col("score") >= 0.9, "easy").when(F.col("score") >= 0.75, "normal").when(F.col("score") >= 0.5, "hard").otherwise("extra_hard")
    return best.select("dataset", score.alias("score")).withColumn("level", level)


def compare(records: DataFrame, models: list[str]) -> DataFrame:
    """Wide: a column of mean values for each of ``models``."""
    return records.groupBy("dataset").pivot("model", models).agg(F.avg("value"))


def melt(wide: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Long: key, model, value; text numbers may have a decimal comma."""
    long = wide.unpivot([key], values, "model", "value")
    text = F.regexp_replace(F.col("value").cast("string"), ",", ".")
    return long.withColumn("value", text.try_cast("double"))


#: Metrics of which more is better.
HIGHER = ("accuracy", "balanced_accuracy", "f1", "f1_macro", "precision", "recall", "r2", "roc_auc")


def direction(metric: Column, default: str = "higher") -> Column:
    """``higher`` or ``lower``: which values of a metric are better, by its name; ``default`` without a name."""
    name = F.lower(F.trim(F.coalesce(metric, F.lit(""))))
    return F.when(name == "", default).when(name.isin(*HIGHER), "higher").otherwise("lower")


def numbered(records: DataFrame, higher: bool) -> DataFrame:
    """model, mean, place: as ``leaderboard``, but each model has a place of its own, ties by name."""
    means = records.groupBy("model").agg(F.avg("value").alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(_order("mean", higher), "model")).cast("long"))


def wins(records: DataFrame, own: str, higher: bool = False) -> DataFrame:
    """dataset, difference (the best of the others against ``own``, positive where that is better), outcome."""
    best = F.max if higher else F.min
    both = records.groupBy("dataset").agg(best(F.when(F.col("model") != own, F.col("value"))).alias("o"), best(F.when(F.col("model") == own, F.col("value"))).alias("s"))
    difference = F.col("s") - F.col("o") if higher else F.col("o") - F.col("s")
    return both.where("o IS NOT NULL AND s IS NOT NULL").select("dataset", difference.alias("difference"), F.when(difference > 0, "win").otherwise("loss").alias("outcome"))


def with_diagnostics(records: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Records with the diagnostics of their dataset and model, where there are any; one row of these each."""
    return records.join(diagnostics.dropDuplicates(["dataset", "model"]), ["dataset", "model"], "left")


def exploded(rows: DataFrame, key: str, cell: str, separator: str = ",") -> DataFrame:
    """key, item: a row for each part of a cell that lists them; blanks around parts and empty parts go."""
    parts = F.filter(F.transform(F.split(cell, separator), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(key, F.explode(parts).alias("item"))


def sampled(records: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` of the keys, the same on every run: those of least hash, with all their rows."""
    keys = records.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return records.join(F.broadcast(keys), key, "left_semi")


def notable(individuals: DataFrame, n: int, higher: bool = True) -> DataFrame:
    """The ``n`` best individuals of each generation with their place; ties by name."""
    w = Window.partitionBy("generation").orderBy(_order("fitness", higher), "individual")
    return individuals.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def dynamics(individuals: DataFrame) -> DataFrame:
    """generation, n, best, mean, worst fitness, mean complexity (nodes of a pipeline)."""
    return individuals.groupBy("generation").agg(
        F.count("*").alias("n"), F.max("fitness").alias("best"), F.avg("fitness").alias("mean"), F.min("fitness").alias("worst"), F.avg(F.size(F.split("operations", ","))).alias("complexity")
    )


def operation_frequency(individuals: DataFrame) -> DataFrame:
    """operation, n, share: how often operations occur in the pipelines."""
    each = individuals.select(F.explode(F.split("operations", ",")).alias("operation")).groupBy("operation").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("all"))
    return each.crossJoin(F.broadcast(total)).select("operation", "n", (F.col("n") / F.col("all")).alias("share"))


def family_stages(records: DataFrame, stage: str) -> DataFrame:
    """Means and counts by a stage column and model."""
    return records.groupBy(stage, "model").agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
