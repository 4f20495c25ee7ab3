"""Readers, writers, reports and micro-batches."""

import json

from pyspark.sql import functions as F

from blockloom.operators import profile, stats
from blockloom.session import table
from blockloom.sources import datasets, layers
from blockloom.streaming import incremental

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3.5], [0, 3], [0, 0]]]}


def test_geojson(spark, tmp_path):
    docs = {
        "collection": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": SQUARE, "properties": {"zone": "a", "n": 3}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 9]}, "properties": {}}]},
        "feature": {"type": "Feature", "geometry": SQUARE, "properties": {"zone": "b"}},
        "bare": {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], SQUARE["coordinates"]]},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc))
    read = lambda n: layers.read_layer(spark, str(tmp_path / f"{n}.geojson")).collect()
    square = "POLYGON ((0 0,4 0,4 3.5,0 3,0 0))"
    got = read("collection")
    assert [r.geometry for r in got] == [square, "POINT (1 2)"] and got[0].properties["n"] == "3"
    assert read("feature")[0].properties["zone"] == "b"
    assert read("bare")[0].geometry == "MULTIPOLYGON (((0 0,4 0,4 3.5,0 3,0 0)),((0 0,4 0,4 3.5,0 3,0 0)))"
    df = spark.createDataFrame([("a", square), ("b", "SRID=3857;point (1 2)"), ("c", None)], "k string, geometry string")
    layers.write_geojson(df, str(tmp_path / "out"))
    back = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    by = {f["properties"]["k"]: f["geometry"] for f in back["features"]}
    assert by == {"a": SQUARE, "b": {"type": "Point", "coordinates": [1, 2]}, "c": None}


def test_trees_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "3", 1), ("b", "x", 2), ("b", None, 3)], "block_id string, floors_num string, n int")
    datasets.write_tree(rows, str(tmp_path / "tree"))
    merged = datasets.merge_tree(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    assert sorted((r.block_id, r.floors_num, r.n) for r in merged.collect()) == [("a", 3, 1), ("b", None, 2), ("b", None, 3)] or merged.count() == 3
    assert set(datasets.column_names(spark, str(tmp_path / "out"))) == {"block_id", "floors_num", "n"}
    assert datasets.read_columns(spark, str(tmp_path / "out"), ["n", "none"]).columns == ["n"]
    blocks = spark.createDataFrame([("a",), ("z",)], "block_id string")
    free, unused = datasets.orphan_reports(rows.withColumn("block_id", F.when(F.col("n") == 1, "a")), blocks)
    assert free.count() == 2 and [r.block_id for r in unused.collect()] == ["z"]
    packets = spark.createDataFrame([("a", "z1", "g", [("b1", 2.0), ("b2", 3.0)])], "block_id string, zone string, geometry string, buildings array<struct<building_id:string,living_area:double>>")
    report = datasets.timeout_report(packets)
    assert datasets.kind_counts(report).first() == (1, 2) and "living_area" in report.columns
    states = spark.createDataFrame([("ok", 1, 2, 3, 0.5), ("timeout", 0, 0, 0, 1.5), ("odd", 0, 0, 0, None)], "status string, n_buildings int, n_nodes int, n_edges int, seconds double")
    assert tuple(datasets.progress(states).first()) == (1, 0, 1, 1, 1, 2, 3, 1.0)


def test_documents(spark, folder, tmp_path):
    schema = datasets.schema_of(table(spark, folder, "nodes_fixed"))
    datasets.write_schema([*schema, {"name": "x"}], str(tmp_path / "s.json"))
    assert datasets.load_schema(str(tmp_path / "s.json")) == schema and len(schema) == 3
    assert datasets.json_or_path('{"a": 1}') == {"a": 1} and datasets.json_or_path("{") is None and datasets.json_or_path(str(tmp_path / "s.json"))["version"] == 1
    assert datasets.merged_config({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}


def test_micro_batches(spark, folder, tmp_path):
    nodes = table(spark, folder, "nodes_fixed")
    nodes.repartition(4).write.parquet(str(tmp_path / "in"))
    arriving = incremental.arriving(spark, str(tmp_path / "in"), nodes.schema, files=1)
    incremental.running_service_totals(arriving, str(tmp_path / "c1"), "totals").awaitTermination()
    got = sorted((r.service, r.n) for r in spark.table("totals").collect())
    assert got == sorted((r.service, r.n) for r in stats.service_totals(nodes).collect())
    state = lambda df: profile.histogram(df, "t", {"e_i": F.col("e_i").isin(0, 1)})
    incremental.partial_states(arriving, state, str(tmp_path / "states"), str(tmp_path / "c2")).awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "states"))
    assert parts.select("batch").distinct().count() == 4
    assert profile.merge(parts.drop("batch")).exceptAll(state(nodes)).count() == 0
