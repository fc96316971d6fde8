"""Inputs that the catalogue derives from the tables, each with the SQL that says the same.

``query`` registers a query with its SQL; both sides round doubles to six places. They do so about a point off the
grid of short decimals, as the engines break ties apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators.layouts import to_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LONG = "L AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, ts, value FROM events)"
HOLED = f"{LONG}, H AS (SELECT series_id, t, ts, CASE WHEN t % 7 <> 3 THEN value END AS value FROM L)"
PANEL = "P AS (SELECT vec_id AS sample_id, label AS target, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
RECORDS = "R AS (SELECT o_orderpriority AS dataset, c_mktsegment AS model, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
LABELLED = "M AS (SELECT l.quality AS y_true, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS y_pred, d.n_chars % 100 AS score, (d.n_chars % 97 + 1) / 99.0 AS prob, d.lang FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def long(spark: SparkSession, folder: str) -> DataFrame:
    """Events as one series for each user."""
    return to_long(read(spark, folder, "events"), "user_id", ["ts", "event_id"], "value")


def holed(spark: SparkSession, folder: str) -> DataFrame:
    """``long`` with every seventh value missing."""
    return long(spark, folder).withColumn("value", F.when(F.col("t") % 7 != 3, F.col("value")))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as samples."""
    e = read(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("target"), F.col("embedding").cast("array<double>").alias("values"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order prices as benchmark records: priorities are datasets, segments are models."""
    o, c = read(spark, folder, "orders"), read(spark, folder, "customer")
    both = o.join(c, o.o_custkey == c.c_custkey)
    return both.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("c_mktsegment").alias("model")).agg(F.avg("o_totalprice").alias("value"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with a prediction from the length of the text."""
    both = read(spark, folder, "labels").where("quality IS NOT NULL").join(read(spark, folder, "documents"), "doc_id")
    n = F.col("n_chars")
    return both.select(F.col("quality").alias("y_true"), F.when(n > 1500, 1).otherwise(0).alias("y_pred"), (n % 100).alias("score"), ((n % 97 + 1) / 99.0).alias("prob"), "lang")


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 6) -> None:
    """Registers ``run``; ``doubles``: the columns to round on both sides."""
    columns, off = doubles.split(), 0.1372 * 10.0**-digits

    def rounded(spark: SparkSession, folder: str) -> DataFrame:
        df = run(spark, folder)
        return df.withColumns({c: F.round(F.col(c).cast("double") + off, digits) + 0.0 for c in columns}) if columns else df

    QUERIES[name] = rounded
    if sql is not None:
        kept = ", ".join(f"round(CAST({c} AS DOUBLE) + {off!r}, {digits}) + 0.0 AS {c}" for c in columns)
        head, body = ("WITH " + sql.split("|||")[0], sql.split("|||")[1]) if "|||" in sql else ("", sql)
        ORACLE[name] = f"{head} SELECT * REPLACE ({kept}) FROM ({body})" if columns else f"{head} {body}"
