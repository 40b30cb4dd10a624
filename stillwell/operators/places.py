"""Finding entities and places by what a person typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import fold
from .spatial import within_km


def select_entities(entities: DataFrame, entity: str | None = None, district: str | None = None,
                    state: str | None = None, lat: float | None = None, lon: float | None = None,
                    radius_km: float = 50.0) -> DataFrame:
    """Entities of one place: an id, a circle, a district (exact, else by prefix), a state, or all of them.

    ``entities`` has ``id, index, district, state, lat, lon``. An id that is no known id may be an index. The
    fallbacks are decided inside the plan, so nothing is collected.
    """
    def with_fallback(first: Column, second: Column) -> DataFrame:
        found = entities.where(first)
        return found.unionByName(entities.where(second & ~found.exists()))

    if entity is not None:
        if not entity.isdigit():
            return entities.where(F.col("id") == entity)
        return with_fallback(F.col("id") == entity, F.col("index") == int(entity))
    if lat is not None and lon is not None:
        return entities.where(within_km(F.col("lat"), F.col("lon"), lat, lon, radius_km))
    in_state = F.lit(True) if state is None else F.lower("state") == state.lower()
    if district is not None:
        want = district.strip().lower()
        return with_fallback((F.lower("district") == want) & in_state,
                             F.startswith(F.lower("district"), F.lit(want)) & in_state)
    return entities.where(in_state)


def search_places(places: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Best matches of a typed name: exact, then prefix, then start of a later word.

    ``places`` has ``kind`` (state, district or town), ``kind_order``, ``name``, ``others`` (array), ``district``,
    ``state`` and ``population``. A town is dropped when its district of the same name ranks before it. ``via`` is the spelling
    that matched best (0 is the name itself).
    """
    wanted = F.lit(text).alias("_q")
    folded = fold(wanted)
    keys = F.concat(F.array(fold(F.col("name"))), F.transform(F.coalesce("others", F.array().cast("array<string>")),
                                                              fold))

    def score(k: Column) -> Column:
        return (F.when(k == folded, 3).when(F.startswith(k, folded), 2)
                .when(F.contains(k, F.concat(F.lit(" "), folded)), 1).otherwise(-1))

    ranked = F.array_max(F.transform(keys, lambda k, i: F.struct(score(k).alias("score"), (-i).alias("place"))))
    hits = places.withColumn("_b", ranked).where((F.col("_b.score") > 0) & (F.length(folded) >= 2))
    same = F.when(F.col("kind") == "state", F.col("name")).otherwise(F.concat_ws(
        "|", fold(F.when(F.col("kind") == "town", F.col("district")).otherwise(F.col("name"))), "state",
        fold(F.col("name"))))
    order = F.struct((-F.col("_b.score")).alias("a"), F.col("kind_order").alias("b"),
                     (-F.coalesce("population", F.lit(0)).cast("long")).alias("c"), F.col("name").alias("d"),
                     F.col("state").alias("e"), F.col("district").alias("f"))
    shown = F.struct("kind", "name", "district", "state", F.col("_b.score").alias("score"),
                     (-F.col("_b.place")).alias("via"), order.alias("_o"))
    kept = hits.groupBy(same.alias("_same")).agg(F.min_by(shown, order).alias("p")).select("p.*")
    return kept.orderBy("_o").limit(limit).drop("_o")
