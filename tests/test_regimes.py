"""Regimes of many short series with steps that are equal but for the last bit, against the SQL."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from chronolake.operators import detect
from chronolake.plans.catalogue import ORACLE, QUERIES


def told_apart(values):
    """Whether one rounding and two give quantiles of the steps that label a point apart."""
    steps = [abs(y - x) for x, y in zip(values[:1] + values, values, strict=False)]
    at = (len(steps) - 1) * 0.85
    low, high, d = sorted(steps)[math.floor(at)], sorted(steps)[math.ceil(at)], at - math.floor(at)
    one, two = math.fma(low, 1 - d, high * d), low if low == high else low * (1 - d) + high * d
    return any((x >= one) != (x >= two) for x in steps)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, series = random.Random(3), []
    while len(series) < 40:
        values = [rng.randrange(12) / 100 + rng.randrange(3) * 7.31 for _ in range(rng.randrange(8, 40))]
        if told_apart(values):
            series.append(values)
    rows = [(1000 * user + t, datetime(2024, 1, 1) + timedelta(seconds=t), user, v) for user, values in enumerate(series) for t, v in enumerate(values)]
    path = tmp_path_factory.mktemp("regimes")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    true = con.sql(ORACLE[name]).to_arrow_table()
    got = QUERIES[name](spark, folder).toArrow().select(true.column_names)
    rows = [sorted(tuple(r.values()) for r in table.to_pylist()) for table in (got, true)]
    return rows[0] == rows[1]


def test_quantiles_of_odd_series(spark):
    nan, inf = math.nan, math.inf
    cases = {1: [None], 2: [5.0, None], 3: [2.0, 1.0, None], 4: [-inf, 1.0, 2.0], 5: [1.0, 2.0, inf], 6: [1.7e308, 1.6e308], 7: [nan, 1.0, 2.0, 3.0, 4.0], 8: [0.1] * 7}
    rows = spark.createDataFrame([(k, v) for k, values in cases.items() for v in values], "series_id int, value double")
    got = {r.series_id: (r.a, r.b) for r in detect.quantiles(rows, {"a": ("value", 0.25), "b": ("value", 0.85)}).collect()}
    con = duckdb.connect()
    for k, values in cases.items():
        true = con.execute("SELECT quantile_cont(x, 0.25), quantile_cont(x, 0.85) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()[0]
        assert repr(got[k]) == repr(true)


def test_labels_of_near_ties(spark, folder):
    assert same_as_sql(spark, folder, "regime_labels")


def test_segments_of_near_ties(spark, folder):
    assert same_as_sql(spark, folder, "regime_segments")


def test_threshold_outside_transitions_of_near_ties(spark, folder):
    assert same_as_sql(spark, folder, "threshold_regime")
