"""Structured Streaming over event tables: windows, sessions, de-duplication, online detection.

These are extensions beyond batch: watermarks bound all state; every query runs on any streaming source with
the columns of ``events``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolake.operators.filters import OnlineAutoregression


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; ts as a timestamp."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of each window."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of the sessions between gaps."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_only(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def online_z(stream: DataFrame, limit: float = 3.0, late: str = "1 hour", idle_hours: int = 24 * 30) -> DataFrame:
    """user_id, ts, value, z, is_anomaly: each value against the running mean and deviation of those before it
    (Welford); state is three numbers a user, and goes ``idle_hours`` after a user's last value.

    A user's rows of one trigger are put in order in one task; how many files a trigger reads bounds them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        z = []
        for x in rows["value"]:
            deviation = (m2 / n) ** 0.5 if n > 1 else 0.0
            z.append((x - mean) / deviation if deviation > 1e-9 else 0.0)
            n += 1
            step = x - mean
            mean += step / n
            m2 += step * (x - mean)
        state.update((n, mean, m2))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_hours * 3_600_000)
        yield pd.DataFrame({"user_id": key[0], "ts": rows["ts"], "value": rows["value"], "z": z, "is_anomaly": [abs(x) > limit for x in z]})

    rows = stream.withWatermark("ts", late).select("user_id", "ts", "event_id", "value").groupBy("user_id")
    return rows.applyInPandasWithState(run, "user_id long, ts timestamp, value double, z double, is_anomaly boolean", "n long, mean double, m2 double", "append", GroupStateTimeout.EventTimeTimeout)


def online_weights(stream: DataFrame, model: OnlineAutoregression | None = None, late: str = "1 hour", idle_hours: int = 24 * 30) -> DataFrame:
    """user_id, ts, event_id, expected (null for the first values), move, as ``filters.online_autoregression`` gives them,
    for values that arrive in order; state is the model's weights and last values, and goes ``idle_hours`` after a
    user's last value."""
    model = model or OnlineAutoregression()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        known, found = model.step(list(state.get[0]) if state.exists else model.begin(), rows["value"].to_numpy("float64"))
        state.update((known,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_hours * 3_600_000)
        expected = [None if np.isnan(x) else float(x) for x in found["expected"]]
        yield pd.DataFrame({"user_id": key[0], "ts": rows["ts"], "event_id": rows["event_id"], "expected": expected, "move": found["move"]})

    rows = stream.withWatermark("ts", late).select("user_id", "ts", "event_id", "value").groupBy("user_id")
    return rows.applyInPandasWithState(run, "user_id long, ts timestamp, event_id long, expected double, move double", "known array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, exactly once into Parquet files, and reads them."""
    q = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)
