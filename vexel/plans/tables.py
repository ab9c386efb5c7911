"""The driver's tables and the places made of them, as all modules of queries read them.

Python workers import a module of queries by its name, any of them first, so those modules import this one and none
imports queries, which imports them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spatial import projection


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key to some tasks a core: a table of few row groups is read by few tasks, which then would do all that
    Python does with each row."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with made-up positions."""
    lon = ((F.col("c_custkey") * 37) % 360 - 180).cast("double")
    lat = ((F.col("c_custkey") * 53) % 170 - 85).cast("double")
    return table(spark, sf, "customer").withColumns({"lon": lon, "lat": lat})


_PLACES = "(SELECT *, ((c_custkey * 37) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 53) % 170 - 85)::DOUBLE AS lat FROM customer)"


def _tile_sql(z: int) -> tuple[str, str]:
    n = float(1 << z)
    lat = f"greatest(-{projection.LATITUDE_MAX!r}, least({projection.LATITUDE_MAX!r}, lat))"
    x = f"(180 + lon) * ({n} / 360)"
    y = f"(180 - ln(tan(pi() / 4 + {lat} * pi() / 360)) * 180 / pi()) * ({n} / 360)"
    inside = lambda c: f"greatest(0, least({int(n) - 1}, floor({c})))::INT"
    return inside(x), inside(y)


def tile_assign(spark, sf):
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 9)
    return places(spark, sf).select("c_custkey", x.alias("x"), y.alias("y"))
