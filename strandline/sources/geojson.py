"""GeoJSON feature collections to and from frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import numbered

_FEATURES = "array<struct<type: string, id: string, bbox: array<double>, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
_COLLECTION = f"struct<type: string, name: string, features: {_FEATURES}>"


def parse_collections(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of type Feature in the collections' order: ``(pos, type, id, bbox, geometry, properties)``; ids become strings, a null list of features is empty."""
    parsed = texts.select(F.from_json(column, _COLLECTION).alias("c"))
    rows = parsed.select(F.posexplode(F.coalesce(F.col("c.features"), F.expr(f"cast(array() as {_FEATURES})"))).alias("pos", "f"))
    return rows.select("pos", "f.*").filter(F.col("type") == "Feature")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of the files at a path that Spark can read, one collection a file."""
    return parse_collections(spark.read.text(path, wholetext=True))


def coordinate(c: Column) -> Column:
    """(x, y, z) of a position: two numbers have a NaN height, other lengths are an error."""
    z = F.when(F.size(c) == 3, F.get(c, F.lit(2))).when(F.size(c) == 2, F.lit(float("nan"))).otherwise(F.raise_error(F.concat(F.lit("unsupported number of coordinates: "), F.size(c).cast("string"))).cast("double"))
    return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"), z.alias("z"))


def pipes_of(features: DataFrame) -> DataFrame:
    """``(pos, x0 .. z1)``: the first edge of every LineString that is no chain and has two vertices."""
    lines = features.filter((F.col("geometry.type") == "LineString") & ~F.coalesce(F.contains("id", F.lit("chain_")), F.lit(False)))
    vertices = F.coalesce(F.from_json("geometry.coordinates", "array<array<double>>"), F.expr("cast(array() as array<array<double>>)"))
    rows = lines.select("pos", vertices.alias("v")).filter(F.size("v") >= 2)
    rows = rows.select("pos", coordinate(F.get("v", F.lit(0))).alias("a"), coordinate(F.get("v", F.lit(1))).alias("b"))
    return rows.select("pos", *(F.col(f"{e}.{c}").alias(f"{c}{i}") for i, e in enumerate("ab") for c in "xyz"))


def edges_of(features: DataFrame) -> DataFrame:
    """``(pos, edge, x0 .. z1)``: every edge of those LineStrings."""
    lines = features.filter((F.col("geometry.type") == "LineString") & ~F.coalesce(F.contains("id", F.lit("chain_")), F.lit(False)))
    rows = lines.select("pos", F.from_json("geometry.coordinates", "array<array<double>>").alias("v")).filter(F.size("v") >= 2)
    rows = rows.select("pos", F.posexplode(F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda a, b: F.struct(coordinate(a).alias("a"), coordinate(b).alias("b")))).alias("edge", "e"))
    return rows.select("pos", "edge", *(F.col(f"e.{e}.{c}").alias(f"{c}{i}") for i, e in enumerate("ab") for c in "xyz"))


def components_of(features: DataFrame) -> DataFrame:
    """``(pos, min_x .. max_z, cx, cy, cz)`` of every Point; without a box of six numbers the point is its own box."""
    rows = features.filter(F.col("geometry.type") == "Point").select("pos", "bbox", F.slice(F.coalesce(F.from_json("geometry.coordinates", "array<double>"), F.expr("cast(array() as array<double>)")), 1, 3).alias("c"))
    rows = rows.withColumn("p", coordinate(F.col("c"))).withColumn("whole", F.coalesce(F.size("bbox") == 6, F.lit(False)))
    side = lambda i, a: F.when(F.col("whole"), F.get("bbox", F.lit(i))).otherwise(F.col(f"p.{a}"))
    boxes = [side(3 * k + i, a).alias(f"{name}_{a}") for k, name in enumerate(("min", "max")) for i, a in enumerate("xyz")]
    return rows.select("pos", *boxes, *(F.col(f"p.{a}").alias(f"c{a}") for a in "xyz"))


def _feature(part: int, order: Column, name: Column, kind: str, geometry: Column, epsg: int | None, bbox: Column | None = None) -> Column:
    properties = [F.lit(kind).alias("feature_type"), *([F.lit(epsg).alias("proj:epsg")] if epsg else [])]
    fields = [F.lit("Feature").alias("type"), name.alias("id"), *([bbox.alias("bbox")] if bbox is not None else []), geometry.alias("geometry"), F.struct(*properties).alias("properties")]
    return F.struct(F.lit(part).alias("part"), order.alias("at"), F.to_json(F.struct(*fields)).alias("json"))


def feature_rows(pipes: DataFrame | None, chains: DataFrame | None, components: DataFrame | None, epsg: int | None = None) -> DataFrame:
    """``(part, at, json)``: pipes (pipe_id, x0 .. z1), chains (chain_id, points) and components as feature texts, in that order."""
    point = lambda *c: F.array(*c)
    geometry = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("coordinates"))
    parts = []
    if pipes is not None:
        line = F.array(point("x0", "y0", "z0"), point("x1", "y1", "z1"))
        parts.append(numbered(pipes, "pipe_id", into="at").select(_feature(0, F.col("at"), F.concat(F.lit("pipe_"), F.col("at")), "pipe", geometry("LineString", line), epsg).alias("f")))
    if chains is not None:
        line = F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"]))
        parts.append(numbered(chains, "chain_id", into="at").select(_feature(1, F.col("at"), F.concat(F.lit("chain_"), F.col("at")), "snapped_chain", geometry("LineString", line), epsg).alias("f")))
    if components is not None:
        box = F.array(*(f"{m}_{a}" for m in ("min", "max") for a in "xyz"))
        parts.append(numbered(components, "comp_id", into="at").select(_feature(2, F.col("at"), F.concat(F.lit("comp_"), F.col("at")), "component", geometry("Point", point("cx", "cy", "cz")), epsg, box).alias("f")))
    if not parts:
        raise ValueError("nothing to export")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("f.*")


def collection(rows: DataFrame, name: str) -> DataFrame:
    """One row ``(value)`` with the whole collection as text."""
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("part", "at", "json"))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: x["json"]), ",\n")
    return whole.select(F.concat(F.lit('{"type":"FeatureCollection","name":'), F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.char_length(F.to_json(F.array(F.lit(name)))) - 2), F.lit(',"features":[\n'), body, F.lit("\n]}")).alias("value"))


def write_geojson(pipes: DataFrame | None, chains: DataFrame | None, components: DataFrame | None, name: str, path: str, epsg: int | None = None) -> bool:
    """Write one collection under ``path``; without pipes and components nothing is written, and False comes back."""
    if pipes is None and components is None:
        return False
    collection(feature_rows(pipes, chains, components, epsg), name).coalesce(1).write.mode("overwrite").text(path)
    return True
