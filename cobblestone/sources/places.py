"""Place strings, gazetteer lookups, area requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.functions import planar

# Kinds in lookup order, letters and their plain spelling.
KINDS = ("city", "town", "village")
ACCENTED = "ąćęłńóśźżáàâäãåéèêëíìîïòôöõúùûüýÿñçĄĆĘŁŃÓŚŹŻÁÀÂÄÃÅÉÈÊËÍÌÎÏÒÔÖÕÚÙÛÜÝÑÇčďěňřšťůžČĎĚŇŘŠŤŮŽőűŐŰ"
PLAIN = "acelnoszzaaaaaaeeeeiiiioooouuuuyyncACELNOSZZAAAAAAEEEEIIIIOOOOUUUUYNCcdenrstuzCDENRSTUZouOU"
FILE_SUFFIX = ".grid_city"

RING_JSON = "struct<type:string,coordinates:array<array<array<double>>>>"


def split_place(text: Column) -> Column:
    """``"City, Country"`` or ``"City-Country"`` (last hyphen) to STRUCT<name, country>."""
    by_comma = F.split(text, ",")
    has_comma = text.contains(",")
    has_hyphen = text.contains("-")
    head = F.regexp_extract(text, r"^(.*)-[^-]*$", 1)
    tail = F.regexp_extract(text, r"-([^-]*)$", 1)
    name = F.when(has_comma, F.get(by_comma, F.lit(0))).when(has_hyphen, head).otherwise(text)
    country = F.when(has_comma, F.get(by_comma, F.lit(1))).when(has_hyphen, tail)
    return F.struct(F.trim(name).alias("name"), F.trim(country).alias("country"))


def grid_file_name(place: Column) -> Column:
    """Plain lower-case file name of a place."""
    plain = F.translate(place, ACCENTED, PLAIN)
    return F.concat(F.replace(F.lower(plain), F.lit(" "), F.lit("_")), F.lit(FILE_SUFFIX))


def dashed_name(place: Column) -> Column:
    return F.replace(place, F.lit(", "), F.lit("-"))


def resolve_places(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Requested places (request_id, place) matched as city, else town, else village.

    One join on (name, country) and one combinable aggregate instead of three joins.
    """
    asked = requests.select("request_id", "place", split_place(F.col("place")).alias("p")).select(
        "request_id", "place", "p.*"
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    known = gazetteer.where(F.col("kind").isin(*KINDS)).select("place_id", "name", "country", "kind", rank.alias("rank"))
    found = asked.join(known, ["name", "country"], "left")
    best = F.min_by(F.struct("place_id", "kind"), F.struct("rank", "place_id"))
    return found.groupBy("request_id", "place", "name", "country").agg(best.alias("m")).select(
        "request_id", "place", "name", "country", "m.*"
    )


def place_coordinates(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Place name to the centre of its area (left join: unknown names stay null)."""
    centres = gazetteer.select(
        "name", ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y")
    )
    return names.select(F.trim(F.get(F.split("place", ","), F.lit(0))).alias("name")).join(centres, "name", "left")


def parse_areas(requests: DataFrame, body: str = "body") -> DataFrame:
    """Area requests in GeoJSON to closed rings (S15): adds ``ring``."""
    outer = F.get(F.from_json(F.col(body), RING_JSON)["coordinates"], F.lit(0))
    ring = F.transform(outer, lambda p: planar.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    first, last = F.get("ring", F.lit(0)), F.get("ring", F.size("ring") - 1)
    return requests.withColumn("ring", ring).withColumn(
        "ring", F.when(first == last, F.col("ring")).otherwise(F.concat("ring", F.array(first)))
    )


def centroid(ring: Column) -> Column:
    """Area centroid of a closed ring."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc, s):
        a, b = s["a"], s["b"]
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct(
            (acc["a"] + cross).alias("a"), (acc["x"] + (a["x"] + b["x"]) * cross).alias("x"),
            (acc["y"] + (a["y"] + b["y"]) * cross).alias("y"),
        )

    total = F.aggregate(planar.ring_sides(ring), start, add)
    three = F.nullif(3 * total["a"], F.lit(0.0))
    return F.struct((total["x"] / three).alias("x"), (total["y"] / three).alias("y"))


def area_places(areas: DataFrame, gazetteer: DataFrame, bucket: float) -> DataFrame:
    """The city whose area contains each request's centroid; null when none does."""
    from cobblestone.operators.spatial import points_in_boxes

    centres = areas.select("area_id", centroid(F.col("ring")).alias("c")).select("area_id", "c.x", "c.y")
    cities = gazetteer.where(F.col("kind") == KINDS[0])
    hits = points_in_boxes(centres, cities, bucket).groupBy("area_id").agg(F.min("name").alias("city"))
    return centres.join(hits, "area_id", "left")
