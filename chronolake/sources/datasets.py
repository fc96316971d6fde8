"""Named data sets in folders: which reader fits, train and test parts, records with a fallback, saved results."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.sources.readers import exists, read_arff, read_long_csv, read_ts, read_tsv, read_txt, read_wide_csv, write_table

#: Formats in the order in which they are looked for.
READERS = {
    "tsv": read_tsv,
    "txt": read_txt,
    "ts": read_ts,
    "arff": read_arff,
    "csv": lambda spark, path: read_tsv(spark, path, ","),
}


def probe(spark: SparkSession, folder: str, name: str) -> str:
    """The first format in which both parts of a data set are there."""
    for form in READERS:
        if all(exists(spark, f"{folder}/{name}_{part}.{form}") for part in ("TRAIN", "TEST")):
            return form
    raise FileNotFoundError(f"no parts {name}_TRAIN and {name}_TEST in {folder}")


def cast_labels(rows: DataFrame) -> DataFrame:
    """label as a double if every one is a number, else as text."""
    texts = rows.where(F.col("label").isNotNull() & F.col("label").try_cast("double").isNull())
    return rows.withColumn("label", F.col("label").cast("double")) if texts.isEmpty() else rows


def load(spark: SparkSession, folder: str, name: str, shuffle: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a data set, by the first format found; ``folder/name/`` or ``folder/``. ``shuffle``: train
    rows in the order of a hash with this seed."""
    at = f"{folder}/{name}" if exists(spark, f"{folder}/{name}") else folder
    form = probe(spark, at, name)
    train, test = (cast_labels(READERS[form](spark, f"{at}/{name}_{part}.{form}")) for part in ("TRAIN", "TEST"))
    return (train.orderBy(F.xxhash64("sample_id", F.lit(shuffle))) if shuffle is not None else train), test


#: Seasons by the first letter of a family's frequency.
SEASONS = {"D": 1, "W": 1, "M": 12, "Q": 4, "Y": 1}


def load_forecasts(spark: SparkSession, folder: str, family: str) -> tuple[DataFrame, DataFrame]:
    """Train and test series of a forecast family: wide tables (``Monthly-train.csv``) of the series that are in both, or a
    long table (``family.csv``), whose test part is empty."""
    parts = [f"{folder}/{family}-{part}.csv" for part in ("train", "test")]
    if all(exists(spark, p) for p in parts):
        train, test = (read_wide_csv(spark, p) for p in parts)
        ids = train.select("series_id").distinct().join(test.select("series_id").distinct(), "series_id", "left_semi")
        return train.join(ids, "series_id", "left_semi"), test.join(ids, "series_id", "left_semi")
    rows = read_long_csv(spark, f"{folder}/{family}.csv")
    return rows, rows.limit(0)


def records_or_aggregate(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """``records/name.jsonl``, else ``aggregate/name.csv``, else an empty table."""
    if exists(spark, path := f"{folder}/records/{name}.jsonl"):
        return spark.read.schema(schema).json(path)
    if exists(spark, path := f"{folder}/aggregate/{name}.csv"):
        return spark.read.schema(schema).csv(path, header=True)
    return spark.createDataFrame([], schema)


def metric_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All ``metrics.jsonl`` files below ``folder``: records that succeeded and have a number."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "metrics.jsonl").json(folder)
    return rows.where("status = 'success'").withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL")


def composition_history(spark: SparkSession, folder: str) -> DataFrame:
    """generation, individual, fitness, operations (comma-separated) of the JSON files, one an individual, in
    ``folder/<generation>/``."""
    schema = "uid string, fitness double, operations array<string>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder)
    generation = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/[^/]*$", 1).cast("int")
    return rows.select(generation.alias("generation"), F.col("uid").alias("individual"), "fitness", F.array_join("operations", ",").alias("operations"))


def save_results(folder: str, tables: dict[str, DataFrame], form: str = "parquet") -> DataFrame:
    """Writes predictions, labels, metrics and the like, and returns the manifest: name, form, path, columns."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", form)
        rows.append((name, form, f"{folder}/{name}", json.dumps(df.columns)))
    manifest = spark.createDataFrame(rows, "name string, form string, path string, columns string")
    write_table(manifest, f"{folder}/manifest", "json")
    return manifest


def markdown(df: DataFrame, most: int = 100) -> str:
    """A report of at most ``most`` rows as a Markdown table."""
    rows = [[str(v) for v in r] for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows])


def latex(df: DataFrame, most: int = 100) -> str:
    """The same as a LaTeX tabular."""
    rows = [[str(v).replace("_", r"\_") for v in r] for r in [df.columns, *df.limit(most).collect()]]
    lines = " \\\\\n".join(" & ".join(r) for r in rows)
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + lines + " \\\\\n\\end{tabular}"


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
