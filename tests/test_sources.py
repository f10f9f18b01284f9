import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.names import numeric_columns
from meterloom.session import cut_lineage, shared_folder
from meterloom.sources import manifest, tables


def test_yearly_files_may_lack_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Settlement Date,ND\n01-JAN-2019,5\n")
    (tmp_path / "b.csv").write_text("SETTLEMENT_DATE,ND,NSL_FLOW\n01-JAN-2020,6,7\n")
    frames = {2020: tables.read_raw(spark, str(tmp_path / "b.csv")), 2019: tables.read_raw(spark, str(tmp_path / "a.csv"))}
    got = sorted((r.source_year, r.nd, r.nsl_flow) for r in tables.union_yearly(frames).collect())
    assert got == [(2019, 5, None), (2020, 6, 7)]
    with pytest.raises(ValueError):
        tables.union_yearly({})


def test_daily_scan_fails_on_bad_dates(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    tables.write_table(spark.createDataFrame([("2020-01-01", 1), ("nonsense", 2)], "date string, y int"), path, fmt="csv")
    schema = T.StructType().add("date", "string").add("y", "integer")
    with pytest.raises(Exception, match="unparseable"):
        tables.read_daily(spark, path, schema).collect()
    with pytest.raises(KeyError):
        tables.validated_dates(spark.createDataFrame([(1,)], "y int"))


def test_absent_table_is_empty(spark, tmp_path):
    schema = T.StructType().add("model", "string").add("mae", "double")
    got = tables.read_optional(spark, str(tmp_path / "none"), schema)
    assert got.schema == schema and got.isEmpty()
    tables.write_table(spark.createDataFrame([("m", 1.0)], schema), str(tmp_path / "some"))
    assert tables.read_optional(spark, str(tmp_path / "some"), schema).count() == 1


def test_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 2):
        tables.write_table(spark.range(n).selectExpr("id as year", "id as v"), path, ["year"])
    assert spark.read.parquet(path).count() == 2
    assert numeric_columns(spark.read.parquet(path)) == ["v", "year"]


def test_manifest(spark, tmp_path):
    resources = [
        {"id": "1", "name": "Historic Demand Data 2019", "format": "CSV", "url": "https://x/a"},
        {"id": "2", "title": "second of 2019", "mimetype": "text/csv", "url": "https://x/DemandData_2019.csv"},
        {"id": "3", "name": "notes", "format": "PDF", "path": "https://x/demanddata_2020.csv?v=2"},
        {"id": "4", "name": "historic_demand_data_2021", "format": "xlsx", "url": "https://x/a.xlsx"},
        {"id": "5", "name": "historic demand data 2022", "format": "csv", "url": ""},
        {"id": "6", "name": "historic demand data 2024", "format": "csv", "url": "u"},
        {"id": "7", "name": "other", "format": "csv", "url": "u"},
    ]
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"resources": resources}, indent=1))
    inventory = manifest.manifest_inventory(manifest.read_manifest(spark, str(path)))
    years = [r.extracted_year for r in inventory.orderBy("position").collect()]
    assert years == [2019, 2019, 2020, 2021, 2022, 2024, None]
    pick = lambda **k: sorted((r.year, r.position) for r in manifest.select_years(inventory, 2019, current_year=2024, **k).collect())
    assert pick() == [(2019, 0), (2020, 2)]
    assert pick(include_current=True) == [(2019, 0), (2020, 2), (2024, 5)]
    assert pick(end=2019) == [(2019, 0)]
    chosen = manifest.select_years(inventory, 2019, current_year=2024)
    flagged = manifest.manifest_inventory(manifest.read_manifest(spark, str(path)), chosen)
    assert flagged.where("selected_for_download").count() == 3


def test_cut_lineage_reads_back_the_same_rows(spark):
    df = spark.range(10).selectExpr("id", "id * 2 as b")
    assert cut_lineage(df).orderBy("id").collect() == df.collect()
    assert shared_folder(spark) == shared_folder(spark)


def test_resources_from_texts_of_any_make(spark):
    texts = [
        ("a", '{"resources": [{"id": 7, "name": "n"}, {"title": "t", "datastore_active": true, "more": {"deep": [1]}}, 5]}'),
        ("b", '{"resources": []}'), ("c", '{"other": 1}'), ("d", "broken {"), ("e", None), ("f", "[1, 2]"), ("g", '{"resources": "no list"}'),
    ]
    df = spark.createDataFrame(texts, "doc string, text string")
    rows = manifest.resources_from_text(df, "text", {"name": ("name", "title")}, ("doc",)).orderBy("position").collect()
    assert [(r.doc, r.position, r.id, r.name, r.datastore_active) for r in rows] == [
        ("a", 0, "7", "n", None), ("a", 1, None, "t", True), ("a", 2, None, None, None)]
    single = manifest.resources_from_text(df, "text", {"id": ("id", "other")}, ("doc",), None).orderBy("doc").collect()
    assert [r.id for r in single] == [None, None, "1", None, None, None, None]


def test_partitions_are_replaced_and_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    df = spark.createDataFrame([(y, f"{y}-0{m}-01", y * 10 + m) for y in (2020, 2021, 2022) for m in (1, 2)], "year int, date string, v int")
    tables.write_table(df, path, ["year"])
    for _ in range(2):
        tables.replace_partitions(df.where("year = 2021").limit(1).withColumn("v", F.lit(-1)), path, ["year"])
    stored = tables.read_daily(spark, path, df.schema)
    assert sorted((r.year, r.v) for r in stored.collect()) == [(2020, 20201), (2020, 20202), (2021, -1), (2022, 20221), (2022, 20222)]
    pruned = stored.where("year between 2021 and 2022").select("v")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<v:int>" in plan
    assert pruned.count() == 3
    tables.replace_partitions(df.where("false"), path, ["year"])
    assert stored.count() == 5
