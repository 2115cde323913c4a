"""GeoJSON and Parquet sinks of a street graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def features(edges: DataFrame) -> DataFrame:
    """One GeoJSON Feature per edge: (u, v, k, feature)."""
    line = F.struct(
        F.lit("LineString").alias("type"),
        F.transform("geometry", lambda p: F.array(p["x"], p["y"])).alias("coordinates"),
    )
    properties = F.struct(
        "u", "v", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("width", F.lit(0.0)).alias("width")
    )
    feature = F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), properties.alias("properties"))
    return edges.select("u", "v", "k", F.to_json(feature).alias("feature"))


def write_features(edges: DataFrame, path: str) -> None:
    """A folder of text files, one Feature per line (newline-delimited GeoJSON).

    A city's features never have to fit in one row or one task; wrapping the lines
    in a FeatureCollection is a matter of a prefix, commas and a suffix.
    """
    features(edges).select("feature").write.mode("overwrite").text(path)


def feature_collections(edges: DataFrame, size: int = 10_000) -> DataFrame:
    """FeatureCollections of about ``size`` edges each: (part, collection)."""
    listed = features(edges)
    parts = F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("int")
    total = listed.agg(F.count("*").alias("n"))  # one row
    keyed = listed.join(F.broadcast(total)).select("feature", F.pmod(F.xxhash64("u", "v", "k"), parts).alias("part"))
    body = F.array_join(F.sort_array(F.collect_list("feature")), ",")
    return keyed.groupBy("part").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("collection")
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graph as two Parquet tables under ``path``."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark, path: str):
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
