"""Widths, names, degrees, turns and adjacency of a road network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cobblestone.functions import geodesy, planar, tags
from cobblestone.operators.ordered import number_rows
from cobblestone.session import cut_lineage

STRAIGHT = float("inf")


# --- highway classes and widths -------------------------------------------------

def highway_types(edges: DataFrame) -> DataFrame:
    """Distinct highway classes, list values opened (A2)."""
    return edges.select(F.explode("highway").alias("highway")).distinct()


def class_widths(edges: DataFrame) -> DataFrame:
    """Average width per highway class (A3): one partial aggregate, then one row per class."""
    share = tags.class_width_share(F.col("width"), F.col("width_is_list"), F.col("lanes"), F.col("lanes_is_list"))
    exploded = edges.select(F.explode(F.array_distinct("highway")).alias("class"), share.alias("share"))
    return exploded.groupBy("class").agg(F.avg("share").alias("class_width"))


def with_width(edges: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """Adds ``width_m`` by the tag ladder.

    The class table is written first: its size is then known when the join is planned,
    so Spark broadcasts it if it is small (a common class is no hot key then) and
    shuffles otherwise.
    """
    widths = cut_lineage(class_widths(edges), "class-widths") if widths is None else widths
    keyed = edges.withColumn("class", F.get("highway", F.lit(0)))
    joined = keyed.join(widths, "class", "left")
    width = tags.resolve_width(
        F.col("width"), F.col("width_is_list"), F.col("lanes"), F.col("lanes_is_list"), F.col("highway"),
        F.col("class_width"),
    )
    return joined.withColumn("width_m", width).drop("class", "class_width")


def tag_coverage(edges: DataFrame) -> DataFrame:
    """How many edges get their width from a tag, from their class, from the default (A4)."""
    kind = tags.tag_coverage(
        F.col("width"), F.col("width_is_list"), F.col("lanes"), F.col("lanes_is_list"), F.col("highway")
    )
    return edges.groupBy(kind.alias("decided_by")).count()


def street_subgraph(edges: DataFrame, name: str) -> DataFrame:
    """Edges of a street, by name or membership of a name list (F1)."""
    return edges.where(F.array_contains("name", name))


def measurements(edges: DataFrame, max_radius: float = 30.0) -> DataFrame:
    """Edge table with length, width, residential flag, name, radius (G7); needs geometry and radius."""
    wide = with_width(edges)
    return wide.select(
        F.col("osmid").alias("id"), "u", "v", "k",
        geodesy.edge_length(F.col("length"), F.col("geometry")).alias("length_m"), "width_m", "geometry",
        tags.is_residential(F.col("highway"), F.col("highway_is_list"), F.col("radius"), max_radius).alias(
            "is_residential"
        ),
        "name", "radius",
    )


# --- degrees, adjacency, occupancy ------------------------------------------------

def degrees(edges: DataFrame) -> DataFrame:
    """in, out and total degree of every node, parallel edges counted."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("v").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("node_id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree")
    )


def adjacency_list(edges: DataFrame) -> DataFrame:
    """Neighbour lists (A8) as rows (u, v, place), ``place`` counting a node's neighbours from 0 in order.

    Rows are range-partitioned by (u, v), so the list of a hub goes over as many partitions as it needs; a node's list is a
    run of consecutive rows, and no row or task holds an unbounded array.
    """
    ranged = _ranged(edges.select("u", "v"), "u", "v")
    within = Window.partitionBy("_part", "u").orderBy("v")
    numbered = ranged.withColumn("_i", F.row_number().over(within) - 1)
    # what earlier partitions hold of a node: a row per partition and node at its edge
    sizes = ranged.groupBy("u", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("u").orderBy("_part")) - F.col("_n")).where("_before > 0")
    joined = numbered.join(before.drop("_n"), ["u", "_part"], "left")
    return joined.select("u", "v", (F.col("_i") + F.coalesce("_before", F.lit(0))).alias("place"))


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows cut into ranges of ``order`` of about equal size, numbered ``_part``; written, so that the cuts are made once."""
    return cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def dense_index(nodes: DataFrame) -> DataFrame:
    """node_id to 0..n-1 in id order, without one global window.

    Ids are cut into ranges of similar size; each is numbered on its own and shifted by the sizes of the ranges before it
    (a table with a row per range).
    """
    return number_rows(_ranged(nodes.select("node_id"), "node_id"), "_part", "node_id", "node_index")


def adjacency_matrix(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Sparse 0/1 adjacency matrix: distinct (i, j) with dense node indices."""
    a = index.select(F.col("node_id").alias("u"), F.col("node_index").alias("i"))
    b = index.select(F.col("node_id").alias("v"), F.col("node_index").alias("j"))
    return edges.select("u", "v").distinct().join(a, "u").join(b, "v").select("i", "j", F.lit(1).alias("value"))


def occupancy(nodes: DataFrame, rows: int = 150) -> DataFrame:
    """Occupied bins of a node grid ``rows`` high, columns by aspect ratio."""
    box = nodes.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).withColumn("columns", F.floor(rows * ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))).cast("int"))
    joined = nodes.select("x", "y").join(F.broadcast(box))  # one row
    bx = F.floor((F.col("x") - F.col("x0")) / ((F.col("x1") - F.col("x0")) / F.col("columns"))).cast("int")
    by = F.floor((F.col("y") - F.col("y0")) / ((F.col("y1") - F.col("y0")) / rows)).cast("int")
    return joined.select(
        F.least(by, F.lit(rows - 1)).alias("bin_row"), F.least(bx, F.col("columns") - 1).alias("bin_col"), "columns"
    ).distinct()


def occupancy_histogram(occupied: DataFrame, rows: int = 150) -> DataFrame:
    """How many bins hold 0 and how many 1."""
    total = occupied.agg(F.count("*").alias("ones"), F.max("columns").alias("columns"))
    return total.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("value"), (F.col("columns").cast("bigint") * rows - F.col("ones")).alias("bins")),
                F.struct(F.lit(1).alias("value"), F.col("ones").alias("bins")),
            )
        ).alias("h")
    ).select("h.*")


# --- turns ------------------------------------------------------------------------

def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs of undirected neighbours of every node (J10): (node, n1, n2), n1 < n2.

    The pairs themselves are the result. The equi-join on the node is left to
    Spark's skew handling, which splits a hub's rows over tasks.
    """
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("n")).union(edges.select("v", "u")).distinct()
    ends = ends.where(F.col("node") != F.col("n"))
    left, right = ends.withColumnRenamed("n", "n1"), ends.withColumnRenamed("n", "n2")
    return left.join(right, "node").where(F.col("n1") < F.col("n2"))


def scalar_name() -> Column:
    """The name of an edge unless it is list-valued or empty."""
    first = F.get("name", F.lit(0))
    return F.when(~F.col("name_is_list") & (first != ""), first)


def street_pairs(edges: DataFrame) -> DataFrame:
    """One row per (u, v): its first scalar name over parallel edges (null if there is none)."""
    order = F.when(scalar_name().isNotNull(), F.col("k"))
    return edges.groupBy("u", "v").agg(F.min_by(scalar_name(), order).alias("street"))


def turn_pairs(edges: DataFrame) -> DataFrame:
    """Predecessor and successor edges of the same street at a node (J11): (u, v, w, street)."""
    links = street_pairs(edges).where(F.col("street").isNotNull())
    into = links.select("u", "v", "street")
    out = links.select(F.col("u").alias("v"), F.col("v").alias("w"), "street")
    return into.join(out, ["v", "street"]).where(F.col("u") != F.col("w")).select("u", "v", "w", "street")


def best_turn(turns: DataFrame) -> DataFrame:
    """The straightest successor of every (u, v), the lower id on ties."""
    best = F.struct("deviation", "w")
    return turns.groupBy("u", "v").agg(F.min_by(F.struct(*turns.columns), best).alias("t")).select("t.*")


def edge_min_radius(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Smallest turn radius per edge, Infinity without a turn; junction edges keep Infinity."""
    smallest = turns.groupBy("u", "v").agg(F.min("radius").alias("turn_radius"))
    joined = edges.join(smallest, ["u", "v"], "left")
    open_road = F.coalesce(F.col("junction"), F.lit("")) == ""
    radius = F.when(open_road, F.coalesce("turn_radius", F.lit(STRAIGHT))).otherwise(F.lit(STRAIGHT))
    return joined.withColumn("radius", radius).drop("turn_radius")


def street_min_radius(edges: DataFrame) -> DataFrame:
    """Smallest finite radius per street, keyed by the first name (A5)."""
    named = edges.where(F.get("name", F.lit(0)).isNotNull())
    return (
        named.groupBy(F.get("name", F.lit(0)).alias("street")).agg(F.min("radius").alias("street_radius"))
        .where(F.col("street_radius") < STRAIGHT)
    )


def unify_radius(edges: DataFrame) -> DataFrame:
    """Every edge takes its street's smallest radius; unnamed and straight streets keep theirs."""
    keyed = edges.withColumn("street", F.get("name", F.lit(0)))
    smallest = cut_lineage(street_min_radius(edges), "street-radius")  # written, so that its size is known
    joined = keyed.join(smallest, "street", "left")
    return joined.withColumn("radius", F.coalesce("street_radius", "radius")).drop("street", "street_radius")
