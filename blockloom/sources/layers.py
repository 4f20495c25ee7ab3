"""Vector layers: Parquet and GeoJSON in, GeoJSON out; geometry is WKT text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "struct<type:string,geometry:string,properties:map<string,string>>"
COLLECTION = f"struct<type:string,features:array<{FEATURE}>,geometry:string,properties:map<string,string>,coordinates:string>"


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A layer by its suffix: .parquet, or GeoJSON (one document per file)."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.lower().endswith((".geojson", ".json")):
        return read_geojson(spark, path)
    raise ValueError(f"no reader for {path}")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(geometry, properties): a feature collection, a single feature, or a bare geometry, as features."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", COLLECTION).alias("d"), "value")
    bare = F.struct(F.lit("Feature").alias("type"), F.col("value").alias("geometry"), F.create_map().cast("map<string,string>").alias("properties"))
    one = F.struct(F.col("d.type").alias("type"), F.col("d.geometry").alias("geometry"), F.col("d.properties").alias("properties"))
    features = F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).when(F.col("d.type") == "Feature", F.array(one)).otherwise(F.array(bare))
    rows = doc.select(F.explode(features).alias("f"))
    return rows.select(wkt_of(F.col("f.geometry")).alias("geometry"), F.col("f.properties").alias("properties"))


def wkt_of(geojson: Column) -> Column:
    """WKT of a GeoJSON point, line, polygon or multi-geometry text: brackets become parentheses, pairs lose their comma."""
    kind = F.upper(F.get_json_object(geojson, "$.type"))
    body = F.regexp_replace(F.get_json_object(geojson, "$.coordinates"), r"\s+", "")
    pairs = F.regexp_replace(body, r"\[(-?[\d.eE+-]+),(-?[\d.eE+-]+)(?:,-?[\d.eE+-]+)?\]", "$1 $2")
    text = F.translate(pairs, "[]", "()")
    return F.when(kind == "POINT", F.concat(kind, F.lit(" ("), text, F.lit(")"))).otherwise(F.concat(kind, F.lit(" "), text))


def geojson_of(wkt: Column) -> Column:
    """GeoJSON text of a WKT polygon, multipolygon, line or point."""
    bare = F.trim(F.regexp_replace(wkt, r"(?i)^\s*SRID=\d+;", ""))
    kind = F.upper(F.regexp_extract(bare, r"^([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_extract(bare, r"(?s)(\(.*\))", 1), r"\s*,\s*", ",")
    pairs = F.regexp_replace(body, r"(-?[\d.]+(?:[eE][+-]?\d+)?)\s+(-?[\d.]+(?:[eE][+-]?\d+)?)", "[$1,$2]")
    text = F.regexp_replace(F.translate(pairs, "()", "[]"), r"\s+", "")
    name = F.element_at(F.create_map(*[F.lit(x) for k in ("Point", "LineString", "Polygon", "MultiPolygon", "MultiLineString") for x in (k.upper(), k)]), kind)
    single = F.regexp_replace(text, r"^\[(\[[^\[\]]*\])\]$", "$1")
    return F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), F.when(kind == "POINT", single).otherwise(text), F.lit("}"))


def features(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(value): a GeoJSON feature text per row, other columns as properties."""
    props = F.to_json(F.struct(*[c for c in df.columns if c != geometry]))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geojson_of(F.col(geometry)), F.lit("null")), F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_features(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """Newline-delimited GeoJSON features, written by all executors."""
    features(df, geometry).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, geometry: str = "geometry", srid: int | None = 3857, most: int = 100_000) -> None:
    """One feature collection in one file, for layers of at most ``most`` features; larger ones raise."""
    rows = features(df, geometry)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} features: use write_features")
    crs = f'"crs":{{"type":"name","properties":{{"name":"EPSG:{srid}"}}}},' if srid else ""
    whole = rows.agg(F.concat(F.lit(f'{{"type":"FeatureCollection",{crs}"features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)
