"""Queries over benchmark records beyond leaderboards: directions, wins, diagnostics, lists, histories, samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronolake.operators import leaderboard, matrix, quality, synthetic
from chronolake.plans.inputs import LONG, RECORDS, long, query, read, records

query("leaderboard_numbered", lambda s, d: leaderboard.numbered(records(s, d), True), f"{RECORDS} ||| SELECT model, avg(value) AS mean, row_number() OVER (ORDER BY avg(value) DESC, model) AS place FROM R GROUP BY model", "mean")
query(
    "metric_direction",
    lambda s, d: read(s, d, "part").select(F.explode(F.array(F.lit(" Accuracy"), F.lit("rmse"), F.lit(""), F.lit("r2"), F.lit("f1_macro"))).alias("metric"), "p_brand").groupBy("metric").agg(F.count("*").alias("n")).withColumn("direction", leaderboard.direction(F.col("metric"))),
    "SELECT metric, count(*) AS n, CASE WHEN trim(lower(metric)) IN ('accuracy', 'balanced_accuracy', 'f1', 'f1_macro', 'precision', 'recall', 'r2', 'roc_auc', '') THEN 'higher' ELSE 'lower' END AS direction FROM part, (SELECT unnest([' Accuracy', 'rmse', '', 'r2', 'f1_macro']) AS metric) GROUP BY 1",
)
query(
    "win_loss",
    lambda s, d: leaderboard.wins(records(s, d), "BUILDING"),
    f"{RECORDS}, O AS (SELECT dataset, min(value) FILTER (model <> 'BUILDING') - min(value) FILTER (model = 'BUILDING') AS difference FROM R GROUP BY 1) ||| SELECT dataset, difference, CASE WHEN difference > 0 THEN 'win' ELSE 'loss' END AS outcome FROM O WHERE difference IS NOT NULL",
    "difference",
)


def _diagnostics(s, d):
    o = read(s, d, "orders").where("o_orderstatus = 'O'").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("c_mktsegment").alias("model")).agg(F.max("o_orderkey").alias("last_run")).where("last_run % 2 = 0")


query(
    "diagnostics_merge",
    lambda s, d: leaderboard.with_diagnostics(records(s, d), _diagnostics(s, d)),
    f"{RECORDS}, D AS (SELECT o_orderpriority AS dataset, c_mktsegment AS model, max(o_orderkey) AS last_run FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY ALL HAVING max(o_orderkey) % 2 = 0) ||| SELECT dataset, model, value, last_run FROM R LEFT JOIN D USING (dataset, model)",
    "value",
)
query(
    "list_items",
    lambda s, d: leaderboard.exploded(read(s, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", " , ").alias("items")), "p_partkey", "items"),
    "SELECT p_partkey, trim(item) AS item FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ' , '), ',')) AS item FROM part) WHERE trim(item) <> ''",
)
query("sampled_records", lambda s, d: leaderboard.sampled(records(s, d), "dataset", 3))


# a history of pipelines: months are generations, orders individuals, their fitness the price
def _history(s, d):
    o = read(s, d, "orders")
    steps = F.concat_ws(",", F.lit("scale"), F.when(F.col("o_orderstatus") == "O", F.lit("lag")), F.lower(F.substring("o_orderpriority", 1, 1)))
    return o.select(F.month("o_orderdate").alias("generation"), F.col("o_orderkey").alias("individual"), F.col("o_totalprice").alias("fitness"), steps.alias("operations"))


HISTORY = "HI AS (SELECT CAST(month(o_orderdate) AS INT) AS generation, o_orderkey AS individual, o_totalprice AS fitness, concat_ws(',', 'scale', CASE WHEN o_orderstatus = 'O' THEN 'lag' END, lower(substr(o_orderpriority, 1, 1))) AS operations FROM orders)"
query("evolution_dynamics", lambda s, d: leaderboard.dynamics(_history(s, d)), f"{HISTORY} ||| SELECT generation, count(*) AS n, max(fitness) AS best, avg(fitness) AS mean, min(fitness) AS worst, avg(len(string_split(operations, ','))) AS complexity FROM HI GROUP BY 1", "best mean worst complexity", 3)
query("evolution_operations", lambda s, d: leaderboard.operation_frequency(_history(s, d)), f"{HISTORY}, OP AS (SELECT unnest(string_split(operations, ',')) AS operation FROM HI) ||| SELECT operation, count(*) AS n, count(*) / (SELECT count(*) FROM OP) AS share FROM OP GROUP BY 1", "share")
query("notable_pipelines", lambda s, d: leaderboard.notable(_history(s, d), 3), f"{HISTORY} ||| SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY fitness DESC, individual) AS place FROM HI) WHERE place <= 3", "fitness", 3)
query("stage_summary", lambda s, d: leaderboard.family_stages(records(s, d), "dataset"), f"{RECORDS} ||| SELECT dataset, model, avg(value) AS mean, count(*) AS n, min(value) AS least, max(value) AS most FROM R GROUP BY 1, 2", "mean least most", 3)
GAF = (
    f"{LONG}, X0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM L), PA AS (SELECT series_id, CAST(t * 6 // n AS BIGINT) AS p, avg(value) AS v FROM X0 GROUP BY 1, 2), "
    "XS AS (SELECT series_id, p, CASE WHEN max(v) OVER w - min(v) OVER w < 1e-12 THEN 0 ELSE 2 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) - 1 END AS x FROM PA WINDOW w AS (PARTITION BY series_id)), "
    "XY AS (SELECT *, sqrt(greatest(1 - x * x, 0)) AS y FROM XS), GF AS (SELECT x.series_id, x.p AS i, y.p AS j, x.x * y.x - x.y * y.y AS v FROM XY x JOIN XY y ON x.series_id = y.series_id)"
)
query(
    "field_bytes",
    lambda s, d: matrix.to_bytes(matrix.angular_field(long(s, d), 6), "value", "series_id"),
    f"{GAF} ||| SELECT series_id, i, j, CAST(CASE WHEN max(v) OVER w - min(v) OVER w < 1e-12 THEN 0 ELSE floor(255 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)) END AS INT) AS value FROM GF WINDOW w AS (PARTITION BY series_id)",
)


# ---- made series, at the places of the events: their standardised values are the noise, their key gives the phase
def _places(s, d):
    return quality.z_normalise(long(s, d)).select("series_id", "t", F.col("z").alias("noise"), (2 * math.pi / 24 * F.pmod("series_id", F.lit(24))).alias("phase"))


PLACES = f"{LONG}, SN AS (SELECT series_id, t, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6) AS z, {2 * math.pi / 24!r} * (series_id % 24) AS phase FROM L WINDOW w AS (PARTITION BY series_id))"
WAVE = f"sin({2 * math.pi!r} * t / 24.0 + phase)"
PARABOLA = "(-3 * coalesce(lag(z, 2) OVER w, z) + 12 * coalesce(lag(z) OVER w, z) + 17 * z + 12 * coalesce(lead(z) OVER w, z) - 3 * coalesce(lead(z, 2) OVER w, z)) / 35"
MADE = {
    "sin": f"{PLACES} ||| SELECT series_id, t, {WAVE} AS value FROM SN",
    "random_walk": f"{PLACES} ||| SELECT series_id, t, sum(z) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS value FROM SN",
    "auto_regression": f"{PLACES} ||| SELECT a.series_id, a.t, sum(power(0.7, a.t - b.t) * b.z) AS value FROM SN a JOIN SN b ON a.series_id = b.series_id AND b.t <= a.t GROUP BY 1, 2",
    "smooth_normal": f"{PLACES} ||| SELECT series_id, t, avg(z) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM SN",
    "quadratic": f"{PLACES} ||| SELECT series_id, t, {PARABOLA} AS value FROM SN WINDOW w AS (PARTITION BY series_id ORDER BY t)",
}
for kind, sql in MADE.items():
    query(f"synthetic_{kind}", lambda s, d, k=kind: synthetic.at(_places(s, d), k), sql, "value")
query(
    "synthetic_labelled",
    lambda s, d: synthetic.labelled_at(_places(s, d), ["sin", "random_walk"]).select("sample_id", "target", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("values").alias("most")),
    f"{PLACES}, SM AS (SELECT series_id, t, {WAVE} AS w, sum(z) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM SN) "
    "||| SELECT series_id AS sample_id, CAST(series_id % 2 AS INT) AS target, CAST(count(*) AS INT) AS n, sum(CASE WHEN series_id % 2 = 0 THEN w ELSE r END) AS total, max(CASE WHEN series_id % 2 = 0 THEN w ELSE r END) AS most FROM SM GROUP BY series_id",
    "total most",
)
