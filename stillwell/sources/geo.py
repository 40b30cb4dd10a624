"""Place, outline and point files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import MIN_TOWN_POPULATION
from ..functions.strings import other_names

# Positions of the fields used in a GeoNames dump line.
GEONAMES = {"name": 1, "ascii_name": 2, "alternates": 3, "lat": 4, "lon": 5, "country": 8, "population": 14}


def read_towns(spark: SparkSession, path: str, country: str, at_least: int = MIN_TOWN_POPULATION) -> DataFrame:
    """Towns of a tab-separated GeoNames dump with their other Latin-script names."""
    lines = spark.read.csv(path, sep="\t", header=False, quote="")
    rows = lines.select(*[F.col(f"_c{i}").alias(n) for n, i in GEONAMES.items()])
    rows = rows.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double"),
                             "population": F.coalesce(F.expr("try_cast(population as long)"), F.lit(0))})
    kept = rows.where((F.col("country") == country) & (F.col("population") >= at_least))
    return kept.select("name", other_names(F.col("name"), F.col("ascii_name"), F.col("alternates")).alias("others"),
                       "lat", "lon", "population")


def read_outlines(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Outer ring of each polygon of a GeoJSON file, with the properties ``{property: column}``.

    A multi-polygon gives one row per part.
    """
    properties = ", ".join(f"`{p}`: string" for p in names)
    schema = (f"features array<struct<properties: struct<{properties}>, "
              "geometry: struct<type: string, coordinates: string>>>")
    feature = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    nested = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("f.geometry.type") == "Polygon", single).otherwise(nested)
    return feature.select(*[F.col(f"f.properties.`{p}`").alias(n) for p, n in names.items()],
                          F.explode(parts).alias("part")).select(
        *names.values(), F.transform(F.col("part")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        .alias("ring"))


def read_dams(spark: SparkSession, path: str) -> DataFrame:
    """Dam points; a storage or register number that is not positive is unknown."""
    rows = spark.read.csv(path, header=True)
    number = {c: F.expr(f"try_cast({c} as double)") for c in ("lat", "lon", "rv_mcm_v11")}
    rows = rows.withColumns(number)
    register = F.expr("try_cast(id_grd_v13 as int)")
    return rows.select(
        F.col("id_v11").cast("int").alias("id"), "lat", "lon",
        F.when(F.col("rv_mcm_v11") > 0, F.round("rv_mcm_v11", 1)).alias("storage_mcm"),
        F.when(register > 0, register).alias("grand_id"), F.col("qa_rank").alias("qa"))
