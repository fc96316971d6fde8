from pyspark.sql import functions as F

from chronolake.sources import readers


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_labelled_text(spark, tmp_path):
    tsv = readers.read_tsv(spark, write(tmp_path, "a.tsv", "1\t0.5\t-2\n2\t?\t3e1\n\n")).orderBy("label").collect()
    assert [(r.label, r["values"]) for r in tsv] == [("1", [0.5, -2.0]), ("2", [None, 30.0])]
    txt = readers.read_txt(spark, write(tmp_path, "a.txt", "  1.0e+00  -7.0e-01 2\n")).collect()
    assert [(r.label, r["values"]) for r in txt] == [("1.0e+00", [-0.7, 2.0])]
    arff = readers.read_arff(spark, write(tmp_path, "a.arff", "% c\n@relation r\n@data\n1.5,2,a\n?, 3 ,b\n")).orderBy("label").collect()
    assert [(r.label, r["values"]) for r in arff] == [("a", [1.5, 2.0]), ("b", [None, 3.0])]


def test_ts_files(spark, tmp_path):
    text = "#x\n@problemName p\n@data\n1,2,?:4,5,6:A\n7,8,9:1,1,1:B\n"
    out = readers.read_ts(spark, write(tmp_path, "a.ts", text)).orderBy("label", "channel").collect()
    assert [(r.label, r.channel, r["values"]) for r in out] == [("A", 0, [1, 2, None]), ("A", 1, [4, 5, 6]), ("B", 0, [7, 8, 9]), ("B", 1, [1, 1, 1])]
    tuples = readers.read_ts(spark, write(tmp_path, "b.ts", "@data\n(0,1.5),(1,2.5):3.5\n")).collect()
    assert tuples[0]["values"] == [1.5, 2.5] and tuples[0].label == "3.5"


def test_wide_long_and_sensor_csv(spark, tmp_path):
    wide = readers.read_wide_csv(spark, write(tmp_path, "w.csv", "V1,V2,V3\nD1,1,2\nD2,3,\n")).orderBy("series_id", "t").collect()
    assert [tuple(r) for r in wide] == [("D1", 0, 1.0), ("D1", 1, 2.0), ("D2", 0, 3.0)]
    long = readers.read_long_csv(spark, write(tmp_path, "l.csv", "datetime,value,label\n2020-01-01,100,price\nbad,x,price\n")).collect()
    assert long[0].value == 100 and long[1].ts is None and long[1].value is None
    sensor = readers.read_sensor_csv(spark, write(tmp_path, "s.csv", "datetime;A;B;anomaly;changepoint\n2020-01-01 00:00:00;1;2;0.0;1.0\n")).orderBy("channel").collect()
    assert [(r.channel, r.value, r.anomaly, r.changepoint) for r in sensor] == [("A", 1, 0, 1), ("B", 2, 0, 1)]


def test_results_resume_and_sinks(spark, tmp_path):
    schema = "dataset string, model string, value double"
    a = write(tmp_path, "a.csv", "dataset;model;value;x\nd1;m;0,5;9\n")
    b = write(tmp_path, "b.jsonl", '{"dataset": "d2", "value": 1.5}\n\n')
    out = readers.read_results(spark, {"first": a, "second": b}, schema)
    assert sorted((r.dataset, r.model, r.value, r.source_label) for r in out.collect()) == [("d1", "m", 0.5, "first"), ("d2", None, 1.5, "second")]
    path = str(tmp_path / "done")
    readers.append_new(out, path, ["dataset"])
    readers.append_new(out.withColumn("value", F.lit(0.0)), path, ["dataset"])
    assert sorted(r.value for r in spark.read.parquet(path).collect()) == [0.5, 1.5]
    for form in ("csv", "json", "parquet"):
        readers.write_table(out, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() >= 2
