"""Readers of series files into layouts, and sinks of result tables. All are lazy and split by file or line.

sample_id is a hash of a line's file and its place among the lines that are read: equal lines keep ids of their own,
and ids stay the same as long as the files and the split size do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, skip: str) -> DataFrame:
    """value, sample_id of the lines that don't match ``skip``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    return lines.where(~F.col("value").rlike(skip)).select("value", F.xxhash64("file", "place").alias("sample_id"))


def _labelled(lines: DataFrame, separator: str) -> DataFrame:
    """sample_id, label, values from lines of a label and numbers; '?' and blanks are null."""
    parts = F.filter(F.split(F.trim("value"), separator), lambda x: x != "")
    rows = lines.select("sample_id", parts.alias("p"))
    return rows.select("sample_id", F.get("p", F.lit(0)).alias("label"), F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("values"))


def read_tsv(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Label first, no header."""
    return _labelled(_lines(spark, path, r"^\s*$"), separator)


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Label first, separated by white space."""
    return _labelled(_lines(spark, path, r"^\s*$"), r"\s+")


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF data rows: values, then the label."""
    lines = _lines(spark, path, r"^\s*([%@].*)?$")
    parts = F.split(F.trim("value"), r"\s*,\s*")
    rows = lines.select("sample_id", parts.alias("p"))
    return rows.select("sample_id", F.element_at("p", -1).alias("label"), F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: x.try_cast("double")).alias("values"))


def read_ts(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """sample_id, channel, label, values from .ts files: dimensions and the label between colons; (time, value)
    tuples give their values; '?' is null."""
    lines = _lines(spark, path, r"^\s*([#@].*)?$")
    parts = F.split(F.trim("value"), ":")
    label = F.element_at("p", -1) if labelled else F.lit(None).cast("string")
    rows = lines.select("sample_id", parts.alias("p"))
    rows = rows.select("sample_id", label.alias("label"), F.posexplode(F.slice("p", 1, F.size("p") - int(labelled))).alias("channel", "text"))
    plain = F.regexp_replace("text", r"\([^,()]*,([^()]*)\)", "$1")
    return rows.select("sample_id", "channel", "label", F.transform(F.split(plain, ","), lambda x: F.trim(x).try_cast("double")).alias("values"))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """series_id, t, value from a CSV whose first column names the series and whose others (V2, V3, ...) are its values."""
    wide = spark.read.csv(path, header=True)
    key, *rest = wide.columns
    long = wide.unpivot([key], rest, "name", "value")
    t = F.regexp_extract("name", r"(\d+)", 1).cast("long") - 2
    return long.select(F.col(key).alias("series_id"), t.alias("t"), F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")


def read_long_csv(spark: SparkSession, path: str) -> DataFrame:
    """series_id, ts, value from a CSV of datetime, value, label."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("label").alias("series_id"), F.col("datetime").try_cast("timestamp").alias("ts"), F.col("value").try_cast("double").alias("value"))


def read_sensor_csv(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """ts, channel, value, anomaly, changepoint from a CSV of a datetime, sensors, and two label columns."""
    wide = spark.read.csv(path, header=True, sep=separator)
    ts, *sensors = [c for c in wide.columns if c not in ("anomaly", "changepoint")]
    long = wide.unpivot([ts, *[c for c in ("anomaly", "changepoint") if c in wide.columns]], sensors, "channel", "value")
    labels = [F.col(c).try_cast("double").cast("int").alias(c) if c in wide.columns else F.lit(0).alias(c) for c in ("anomaly", "changepoint")]
    return long.select(F.col(ts).try_cast("timestamp").alias("ts"), "channel", F.col("value").try_cast("double").alias("value"), *labels)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records, one a line; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_results(spark: SparkSession, sources: dict[str, str], schema: str) -> DataFrame:
    """Union of CSV or JSON result tables by suffix, with source_label; columns by name, missing ones null."""
    out = None
    for label, path in sources.items():
        if path.endswith((".json", ".jsonl")):
            rows = spark.read.schema(schema).json(path)
        else:
            head = spark.read.text(path).first()
            sep = ";" if head and head[0].count(";") > head[0].count(",") else ","
            text = spark.read.csv(path, header=True, sep=sep)
            empty = spark.createDataFrame([], schema)
            cells = [F.regexp_replace(F.col(f.name), ",", ".").try_cast(f.dataType) if f.dataType.typeName() == "double" else F.col(f.name).try_cast(f.dataType) for f in empty.schema if f.name in text.columns]
            rows = text.select(*[c.alias(f) for c, f in zip(cells, [f.name for f in empty.schema if f.name in text.columns], strict=True)])
            rows = empty.unionByName(rows, allowMissingColumns=True)
        rows = rows.withColumn("source_label", F.lit(label))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at ``path``, in the file system that it names?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_new(results: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at ``path`` doesn't have yet: a run that is resumed repeats nothing."""
    spark = results.sparkSession
    fresh = results
    if exists(spark, path):
        fresh = results.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result table as Parquet, CSV or JSON."""
    if form == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif form in ("json", "parquet"):
        df.write.mode("overwrite").format(form).save(path)
    else:
        raise ValueError(f"unknown format {form}")
