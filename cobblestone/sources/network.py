"""Road-network source: node and edge tables with list-or-scalar tags made uniform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cobblestone.functions import planar

TAGS = ("name", "highway", "width", "lanes")


def uniform_tags(edges: DataFrame) -> DataFrame:
    """Every tag as ARRAY<STRING> with an ``<tag>_is_list`` flag; missing columns become null."""
    types = dict(edges.dtypes)
    out = edges
    for tag in TAGS:
        kind = types.get(tag)
        if kind is None:
            value, listed = F.lit(None).cast("array<string>"), F.lit(False)
        elif kind.startswith("array"):
            value = F.col(tag).cast("array<string>")
            listed = F.col(f"{tag}_is_list") if f"{tag}_is_list" in types else F.lit(True)
        else:
            text = F.col(tag).cast("string")
            value, listed = F.when(text.isNotNull(), F.array(text)), F.lit(False)
        out = out.withColumn(tag, value).withColumn(f"{tag}_is_list", listed)
    for name, kind in (("osmid", "bigint"), ("length", "double"), ("junction", "string")):
        if name not in types:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def read_network(spark: SparkSession, nodes_path: str, edges_path: str, fmt: str = "parquet", **options):
    """Nodes and edges as two DataFrames, edges with uniform tags."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load(nodes_path), uniform_tags(reader.load(edges_path))


def edge_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a two-vertex line from their end nodes."""
    ends = nodes.select("node_id", planar.point(F.col("x"), F.col("y")).alias("p"))
    a = ends.select(F.col("node_id").alias("u"), F.col("p").alias("pu"))
    b = ends.select(F.col("node_id").alias("v"), F.col("p").alias("pv"))
    joined = edges.join(a, "u").join(b, "v")
    return joined.withColumn("geometry", F.array("pu", "pv")).drop("pu", "pv")


def nodes_in_area(nodes: DataFrame, ring) -> DataFrame:
    """Nodes inside a polygon given as [(x, y), ...]: box test first, then ray casting (F2)."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    vertices = F.array(*[planar.point(F.lit(float(x)), F.lit(float(y))) for x, y in ring])
    boxed = nodes.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    return boxed.where(planar.contains(vertices, F.col("x"), F.col("y")))


def area_network(nodes: DataFrame, edges: DataFrame, ring):
    """The part of a network inside a polygon: nodes inside, edges with both ends inside."""
    kept = nodes_in_area(nodes, ring)
    ids = kept.select("node_id")
    both = edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(
        ids.withColumnRenamed("node_id", "v"), "v", "left_semi"
    )
    return kept, both
