import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import fresh_folder
from millrace.sinks import tables as out
from millrace.sources import tables as src

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
ROWS = [(1, 'a "quoted", text\nwith lines\r\n', {"k": "v"}, "train"), (2, "", None, "test"), (3, " édge \\ ", {}, "validation")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, text string, meta map<string,string>, split string")


@pytest.mark.parametrize("write", [out.write_json_splits, out.write_parquet_splits])
def test_splits_round_trip(spark, table, write):
    folder = fresh_folder(spark, "t")
    write(table, folder)
    back = src.read_splits(spark, folder, SCHEMA)
    assert sorted((r["id"], r["text"], r["meta"], r["split"]) for r in back.collect()) == sorted(ROWS, key=lambda r: r[0])


def test_csv_round_trip(spark, table):
    folder = fresh_folder(spark, "csv")
    out.write_csv(table, folder)
    flat = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("text", "meta", "split")])
    got = {r["id"]: r for r in src.read_csv(spark, folder, flat).collect()}
    assert got[1]["text"] == ROWS[0][1] and got[1]["meta"] == '{"k":"v"}'
    assert got[2]["text"] == "" and got[3]["text"] == " édge \\ "


def test_named_json_files(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"id": 1, "text": "a"}\n\n{"id": 2, "text": "b"}\nnot json\n')
    (tmp_path / "test.jsonl").write_text("")
    got = src.read_json_splits(spark, str(tmp_path), SCHEMA).collect()
    good = [r for r in got if r["_corrupt_record"] is None]
    assert sorted((r["id"], r["split"]) for r in good) == [(1, "train"), (2, "train")]
    assert [r["_corrupt_record"] for r in got if r["id"] is None] == ["not json"]


def test_missing_files_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        src.read_splits(spark, str(tmp_path), SCHEMA)


@pytest.mark.parametrize("write", [out.write_json_splits, out.write_parquet_splits])
def test_splits_of_any_name(spark, tmp_path, write):
    df = spark.createDataFrame([(i, "t", {"k": "v"}, ["dev", "held out"][i % 2]) for i in range(10)], "id long, text string, meta map<string,string>, split string")
    write(df, str(tmp_path / "s"))
    got = src.read_splits(spark, str(tmp_path / "s"), SCHEMA).collect()
    assert sorted((r["id"], r["split"]) for r in got) == [(i, ["dev", "held out"][i % 2]) for i in range(10)]


def test_flat_parquet_and_bad_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, "t", {"k": "v"}) for i in range(10)], "id long, text string, meta map<string,string>")
    df.write.parquet(str(tmp_path / "flat"))
    got = src.read_splits(spark, str(tmp_path / "flat"), SCHEMA).collect()
    assert len(got) == 10 and {r["split"] for r in got} == {None}
    (tmp_path / "dev.jsonl").write_text('{"id": 1, "text": "a"}\nnot json\n')
    with pytest.raises(Exception, match="no JSON"):
        src.read_splits(spark, str(tmp_path), SCHEMA).collect()


def test_empty_records_keep_the_schema(spark):
    assert src.from_records(spark, [], "a long, b array<string>").schema.simpleString() == "struct<a:bigint,b:array<string>>"


def test_results_by_model(spark):
    folder = fresh_folder(spark, "m")
    df = spark.createDataFrame([("Base (x y)", 1.0)], "model string, v double")
    out.write_by_model(df, folder)
    assert spark.read.schema("model string, v double, model_key string").json(folder).first()["model_key"] == "Base_x_y"


def test_manifest(spark):
    one = spark.range(1).select(F.lit(3).alias("n"))
    r = out.manifest({"size": 10}, one, one.withColumnRenamed("n", "m"), "now").first()
    assert (r["settings"], r["usage"]["n"], r["quality"]["m"], r["timestamp"]) == ({"size": "10"}, 3, 3, "now")


def test_report_file_keeps_order(spark):
    folder = fresh_folder(spark, "r")
    df = spark.createDataFrame([(1, "a", 2, "third"), (0, "", 0, "first"), (0, "", 1, "second")], "section int, group string, line_no long, line string")
    out.write_report(df, folder)
    assert sorted(r["value"] for r in spark.read.text(folder).collect()) == ["first", "second", "third"]


def test_first_rows(spark):
    df = spark.range(50).withColumn("x", -F.col("id"))
    assert [r["id"] for r in src.first_rows(df, "x", 3).collect()] == [49, 48, 47]


def test_large_csv_files_are_read_by_several_tasks(spark):
    texts = ["\n", "\r", "\\", "\\n", "\\\\n\n", "a\\\r\nb", '"', '",\n"', "\\N", "", None, "x" * 3000, "\\\n\\"]
    df = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(6000)], "id long, `a.b` string")
    folder = fresh_folder(spark, "csv")
    out.write_csv(df.coalesce(1), folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back = src.read_csv(spark, folder, df.schema)
        assert len(back.inputFiles()) == 1 and back.rdd.getNumPartitions() > 1
        assert sorted((r[0], r[1]) for r in back.collect()) == [(i, texts[i % len(texts)]) for i in range(6000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    out.write_csv(df.coalesce(1), f"{folder}-cut", file_rows=1000)
    assert len(src.read_csv(spark, f"{folder}-cut", df.schema).inputFiles()) == 6
