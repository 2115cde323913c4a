"""Spatial joins as bucketed equi-joins: boxes, polygons, radius, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cobblestone.functions import planar


def _bucket(value, size: float) -> Column:
    return F.floor(value / size)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column behind a one-row generator, so that filters on it do not compute it again."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _covering_buckets(df: DataFrame, size: float) -> DataFrame:
    """Rows with min_x.. max_y once per square bucket their box touches (bx, by)."""
    return df.withColumn(
        "bx", F.explode_outer(F.sequence(_bucket(F.col("min_x"), size), _bucket(F.col("max_x"), size)))
    ).withColumn("by", F.explode_outer(F.sequence(_bucket(F.col("min_y"), size), _bucket(F.col("max_y"), size))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, bucket: float) -> DataFrame:
    """Points joined to the half-open boxes that hold them."""
    keyed = points.withColumn("bx", _bucket(F.col("x"), bucket)).withColumn("by", _bucket(F.col("y"), bucket))
    within = (
        (F.col("x") >= F.col("min_x")) & (F.col("x") < F.col("max_x"))
        & (F.col("y") >= F.col("min_y")) & (F.col("y") < F.col("max_y"))
    )
    return keyed.join(_covering_buckets(boxes, bucket), ["bx", "by"]).where(within).drop("bx", "by")


def points_in_polygons(points: DataFrame, polygons: DataFrame, bucket: float) -> DataFrame:
    """Points (x, y) joined to the polygons (ring) that cover them; a bucket holds a pair at most once."""
    boxed = computed_once(polygons, "b", planar.bounds(F.col("ring"))).select("*", "b.*").drop("b")
    keyed = points.withColumn("bx", _bucket(F.col("x"), bucket)).withColumn("by", _bucket(F.col("y"), bucket))
    near = keyed.join(_covering_buckets(boxed, bucket), ["bx", "by"]).where(
        F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    )
    return near.where(planar.covers(F.col("ring"), F.col("x"), F.col("y"))).drop(
        "bx", "by", "min_x", "min_y", "max_x", "max_y"
    )


def residential_points(points: DataFrame, polygons: DataFrame, bucket: float = 100.0) -> DataFrame:
    """Whether any residential polygon covers each point (J5): (point_id, is_residential)."""
    hits = points_in_polygons(points.select("point_id", "x", "y"), polygons.select("ring", "is_residential"), bucket)
    any_hit = hits.groupBy("point_id").agg(F.bool_or("is_residential").alias("hit"))
    return points.join(any_hit, "point_id", "left").withColumn(
        "is_residential", F.coalesce("hit", F.lit(False))
    ).drop("hit")


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """All pairs of points at most ``radius`` apart (J8): (id_a, id_b, distance), id_a < id_b.

    Square buckets of side ``radius``: one side is looked up in its own bucket, the
    other is copied to the nine around it, so each pair meets exactly once.
    """
    left = points.select(
        F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"),
        _bucket(F.col("x"), radius).alias("bx"), _bucket(F.col("y"), radius).alias("by"),
    )
    shifts = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    right = (
        points.select(F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        .withColumn("bx", F.explode(F.transform(shifts, lambda s: _bucket(F.col("xb"), radius) + s)))
        .withColumn("by", F.explode(F.transform(shifts, lambda s: _bucket(F.col("yb"), radius) + s)))
    )
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    joined = left.join(right, ["bx", "by"]).where(F.col("id_a") < F.col("id_b"))
    return joined.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= radius).select(
        "id_a", "id_b", "distance"
    )


def closeness_links(points: DataFrame, radius: float) -> DataFrame:
    """Links (id_a, id_b) whose connected components are those of ``pairs_within``.

    Any two points in one square of diagonal ``radius`` are close, so each links to
    the square's smallest id only; across squares, links are looked for between
    distinct positions. A crowded spot costs as many rows as points, not their square.
    """
    side = radius / 1.4142135623730951 * 0.999999
    placed = points.select(
        "id", "x", "y", _bucket(F.col("x"), side).alias("bx"), _bucket(F.col("y"), side).alias("by")
    )
    heads = placed.groupBy("bx", "by").agg(F.min("id").alias("head"))
    inner = placed.join(heads, ["bx", "by"]).where(F.col("id") != F.col("head")).select(
        F.col("head").alias("id_a"), F.col("id").alias("id_b")
    )
    spots = placed.groupBy("bx", "by", "x", "y").agg(F.min("id").alias("id"))
    reach = F.array(*[F.lit(i) for i in (-2, -1, 0, 1, 2)])
    right = (
        spots.select(F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "bx", "by")
        .withColumn("cx", F.explode(F.transform(reach, lambda s: F.col("bx") + s)))
        .withColumn("cy", F.explode(F.transform(reach, lambda s: F.col("by") + s)))
        .where((F.col("cx") > F.col("bx")) | ((F.col("cx") == F.col("bx")) & (F.col("cy") > F.col("by"))))
        .select("id_b", "xb", "yb", F.col("cx").alias("bx"), F.col("cy").alias("by"))
    )
    left = spots.select(F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "bx", "by")
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    across = left.join(right, ["bx", "by"]).where(F.sqrt(dx * dx + dy * dy) <= radius).select("id_a", "id_b")
    return inner.union(across)


def clip_to_segments(
    polygons: DataFrame, segment_w: float, segment_h: float, bounds: DataFrame
) -> DataFrame:
    """Convex polygons cut by the segment lattice (J4): one row per polygon and segment it overlaps.

    ``bounds`` is the one-row table of total bounds; segments count from its upper
    left corner and end at its edges. Adds seg_row, seg_col, the clipped ``ring`` and its ``area``.
    """
    boxed = computed_once(polygons, "b", planar.bounds(F.col("ring"))).join(F.broadcast(bounds))  # one row

    def span(low, high, size):
        return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))

    tiles = boxed.withColumn(
        "seg_col", F.explode_outer(span(F.col("b.min_x") - F.col("min_x"), F.col("b.max_x") - F.col("min_x"), segment_w))
    ).withColumn(
        "seg_row", F.explode_outer(span(F.col("max_y") - F.col("b.max_y"), F.col("max_y") - F.col("b.min_y"), segment_h))
    )
    box = segment_box(F.col("seg_row"), F.col("seg_col"), segment_w, segment_h)
    clipped = planar.clip_to_box(F.col("ring"), box["min_x"], box["min_y"], box["max_x"], box["max_y"])
    part = planar.let(clipped, lambda r: F.struct(r.alias("ring"), planar.ring_area(r).alias("area")))
    out = computed_once(tiles, "part", part).where(F.col("part.area") > 0)
    return out.withColumns({"ring": F.col("part.ring"), "area": F.col("part.area")}).drop(
        "b", "part", "min_x", "min_y", "max_x", "max_y"
    )


def segment_box(seg_row: Column, seg_col: Column, segment_w: float, segment_h: float) -> Column:
    """Box of a segment, clamped to the bounds columns min_x .. max_y of the row."""
    left = F.col("min_x") + seg_col * segment_w
    top = F.col("max_y") - seg_row * segment_h
    return F.struct(
        left.alias("min_x"), F.greatest(top - segment_h, F.col("min_y")).alias("min_y"),
        F.least(left + segment_w, F.col("max_x")).alias("max_x"), top.alias("max_y"),
    )


def total_bounds(polygons: DataFrame) -> DataFrame:
    """Bounds of all polygons (A1), one row."""
    b = polygons.select(planar.bounds(F.col("ring")).alias("b"))
    return b.agg(
        F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"),
        F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y"),
    )


def grid_dimensions(bounds: DataFrame, density: float, segment_h: int, segment_w: int) -> DataFrame:
    """Rows, columns and segment counts of the grid over given bounds."""
    rows = F.ceil((F.col("max_y") - F.col("min_y")) / density).cast("int")
    cols = F.ceil((F.col("max_x") - F.col("min_x")) / density).cast("int")
    return bounds.withColumn("rows", rows).withColumn("cols", cols).withColumn(
        "seg_rows", F.ceil(F.col("rows") / segment_h).cast("int")
    ).withColumn("seg_cols", F.ceil(F.col("cols") / segment_w).cast("int"))
