"""GeoJSON as canonical feature rows, read without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spatial.geometry import wound_column

_POINT = "array<double>"


def read(spark: SparkSession, path: str, wind: bool = False, on_error: str = "fail") -> DataFrame:
    """A row for each feature of the documents under a path."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    return features(docs, wind, on_error)


def features(docs: DataFrame, wind: bool = False, on_error: str = "fail") -> DataFrame:
    """docs (doc: GeoJSON text) as rows source_index, feature_index, id, geom_type, geom (parts, rings, points), props.

    A document is a FeatureCollection, a Feature or a bare geometry. Multi geometries fold into their kind; ids that
    are null count as absent, properties may be null. A null geometry, a GeometryCollection or a malformed one is an
    error: on_error "fail" raises it, "drop" leaves the feature out, "keep" keeps it with a column error. wind nests
    polygon rings and winds them anew."""
    d = docs.select(F.monotonically_increasing_id().alias("source_index"), F.try_parse_json("doc").alias("v"))
    kind = _text(F.col("v"), "$.type")
    one = F.array(F.when(kind == "Feature", F.col("v")).otherwise(_wrapped(F.col("v"))))
    many = F.coalesce(F.when(kind == "FeatureCollection", F.try_variant_get("v", "$.features", "array<variant>")), F.when(kind != "FeatureCollection", one))
    # what is carried past the unfolding is made before it, else each feature's row holds its whole document
    d = d.select("source_index", "v", many.alias("many"))
    d = d.select("source_index", F.col("many").isNull().alias("bad"), F.coalesce("many", F.array("v")).alias("many"))
    f = d.select("source_index", "bad", F.posexplode("many").alias("feature_index", "f"))
    g = F.try_variant_get("f", "$.geometry", "variant")
    gtype = _text(g, "$.type")
    coordinates = lambda depth: F.try_variant_get(g, "$.coordinates", "array<" * depth + _POINT + ">" * depth)
    point = lambda p: F.struct(F.try_element_at(p, F.lit(1)).alias("x"), F.try_element_at(p, F.lit(2)).alias("y"))
    line = lambda ps: F.transform(ps, point)
    lines = lambda ls: F.transform(ls, line)
    geom = (
        F.when(gtype == "Point", F.array(F.array(F.array(point(coordinates(0))))))
        .when(gtype == "MultiPoint", F.array(F.array(line(coordinates(1)))))
        .when(gtype == "LineString", F.array(F.array(line(coordinates(1)))))
        .when(gtype == "MultiLineString", F.array(lines(coordinates(2))))
        .when(gtype == "Polygon", F.array(lines(coordinates(2))))
        .when(gtype == "MultiPolygon", F.transform(coordinates(3), lines))
    )
    folded = F.regexp_replace(gtype, "^Multi", "")
    error = (
        F.when(F.col("bad"), F.lit("not GeoJSON"))
        .when(gtype.isNull(), F.lit("the geometry is null"))
        .when(geom.isNull() & ~gtype.isin("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"), F.concat(F.lit("unsupported geometry "), gtype))
        .when(F.coalesce(F.exists(F.flatten(F.flatten(geom)), lambda p: p["x"].isNull() | p["y"].isNull()), F.lit(True)), F.lit("malformed coordinates"))
    )
    fid = F.try_variant_get("f", "$.id", "variant")
    props = F.try_variant_get("f", "$.properties", "variant")
    rows = f.select(
        "source_index",
        F.col("feature_index").cast("long").alias("feature_index"),
        F.when(~F.is_variant_null(fid), fid).alias("id"),
        folded.alias("geom_type"),
        geom.alias("geom"),
        F.coalesce(F.when(~F.is_variant_null(props), props), F.parse_json(F.lit("{}"))).alias("props"),
        error.alias("error"),
    )
    if on_error == "fail":
        rows = rows.withColumn("geom", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("geom")))
    if on_error == "drop":
        rows = rows.where("error is null")
    if on_error != "keep":
        rows = rows.drop("error")
    if wind:
        rows = rows.withColumn("geom", F.when(F.col("geom_type") == "Polygon", F.array(wound_column(F.flatten("geom")))).otherwise(F.col("geom")))
    return rows


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _wrapped(v: Column) -> Column:
    """A bare geometry as a feature."""
    return F.try_parse_json(F.concat(F.lit('{"type":"Feature","properties":null,"geometry":'), F.to_json(v), F.lit("}")))


def feature_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (place, id and property columns) as GeoJSON features with null geometries: place, feature."""
    f = F.struct(F.lit("Feature").alias("type"), F.col("id"), F.lit(None).cast("string").alias("geometry"), F.struct(*columns).alias("properties"))
    return rows.select("place", F.to_json(f, {"ignoreNullFields": "false"}).alias("feature"))


def collection(features: list[str]) -> str:
    """A FeatureCollection of feature texts in order, for an answer that the caller has fetched."""
    return '{"type":"FeatureCollection","features":[' + ",".join(features) + "]}"
