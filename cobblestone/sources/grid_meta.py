"""Headers of segmented grid files as a table: parsing, segment catalogue, shape and compatibility checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cobblestone.sources.growing_logs import open_store

# Fixed values of the v1 grid file: header separator, field count, bytes per cell value.
SEPARATOR = ";"
HEADER_FIELDS = 10
VALUE_BYTES = 4


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """First line of every grid file under ``path``: (path, header). Only that line is read."""
    listing = spark.read.format("binaryFile").load(path).select("path")

    def first_lines(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for name in batch["path"]:
                store, place = open_store(name)
                with store.open_input_file(place) as handle:
                    head = b""
                    while b"\n" not in head and (more := handle.read(256)):
                        head += more
                out.append(head.split(b"\n", 1)[0].decode("latin1"))
            yield pd.DataFrame({"path": batch["path"], "header": out})

    return listing.mapInPandas(first_lines, "path string, header string")


def parse_headers(headers: DataFrame, strict: bool = True) -> DataFrame:
    """Header text to typed metadata (S3). ``strict`` fails on a wrong field count, else the fields are null."""
    fields = F.split("header", SEPARATOR)
    count_ok = F.size(fields) == HEADER_FIELDS

    def field(i: int, kind: str) -> Column:
        return F.when(count_ok, F.get(fields, F.lit(i)).try_cast(kind))

    out = headers.select(
        *[c for c in headers.columns if c != "header"],
        field(0, "int").alias("version"), field(1, "int").alias("rows"), field(2, "int").alias("cols"),
        field(3, "double").alias("origin_x"), field(4, "double").alias("origin_y"),
        field(5, "double").alias("density"), field(6, "int").alias("segment_h"), field(7, "int").alias("segment_w"),
        field(8, "string").alias("byteorder"), field(9, "int").alias("channels"),
        (F.length("header") + 1).alias("header_bytes"), count_ok.alias("_ok"),
    )
    if strict:
        message = F.lit(f"a grid header needs {HEADER_FIELDS} fields")
        out = out.where(F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return out.drop("_ok")


def _remainder(total: Column, size: Column) -> Column:
    """Length of the last segment: the remainder, or a full segment when it divides evenly."""
    return F.coalesce(F.nullif(total % size, F.lit(0)), size)


def with_expected_shape(segments: DataFrame) -> DataFrame:
    """Adds seg_rows, seg_cols, expected_h, expected_w to rows with metadata and (seg_row, seg_col)."""
    seg_rows = F.ceil(F.col("rows") / F.col("segment_h")).cast("int")
    seg_cols = F.ceil(F.col("cols") / F.col("segment_w")).cast("int")
    last_h, last_w = _remainder(F.col("rows"), F.col("segment_h")), _remainder(F.col("cols"), F.col("segment_w"))
    return segments.withColumns({"seg_rows": seg_rows, "seg_cols": seg_cols}).withColumns({
        "expected_h": F.when(F.col("seg_row") == F.col("seg_rows") - 1, last_h).otherwise(F.col("segment_h")),
        "expected_w": F.when(F.col("seg_col") == F.col("seg_cols") - 1, last_w).otherwise(F.col("segment_w")),
    })


def segment_catalogue(meta: DataFrame) -> DataFrame:
    """Every segment of every grid with shape and byte range."""
    grid = meta.withColumn(
        "seg_row", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / F.col("segment_h")).cast("int") - 1))
    ).withColumn(
        "seg_col", F.explode(F.sequence(F.lit(0), F.ceil(F.col("cols") / F.col("segment_w")).cast("int") - 1))
    )
    value = F.col("channels").cast("bigint") * VALUE_BYTES
    above = F.col("seg_row").cast("bigint") * F.col("segment_h") * F.col("cols") * value
    left = F.col("seg_col").cast("bigint") * F.col("expected_h") * F.col("segment_w") * value
    return with_expected_shape(grid).withColumns({
        "byte_start": F.col("header_bytes") + above + left,
        "byte_length": F.col("expected_h").cast("bigint") * F.col("expected_w") * value,
    })


def tile_violations(tiles: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Tiles (key, seg_row, seg_col, h, w) whose place or shape does not fit their grid."""
    checked = with_expected_shape(tiles.join(meta, key))
    outside = (F.col("seg_row") >= F.col("seg_rows")) | (F.col("seg_col") >= F.col("seg_cols"))
    reason = (
        F.when(outside, F.lit("out of bounds"))
        .when(F.col("h") != F.col("expected_h"), F.lit("wrong height"))
        .when(F.col("w") != F.col("expected_w"), F.lit("wrong width"))
    )
    return checked.select(key, "seg_row", "seg_col", "h", "w", "expected_h", "expected_w", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def assert_tiles_fit(tiles: DataFrame, meta: DataFrame, key: str) -> None:
    bad = tile_violations(tiles, meta, key).limit(5).collect()
    if bad:
        raise ValueError(f"tiles do not fit their grid: {bad}")


def open_or_create(requested: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """What opening each requested grid means (S6): create, open, conflict or missing.

    Only the row and column counts are compared, and only those that are given.
    """
    old = stored.select(key, F.col("rows").alias("old_rows"), F.col("cols").alias("old_cols"))
    differs = F.coalesce(F.col("rows") != F.col("old_rows"), F.lit(False)) | F.coalesce(
        F.col("cols") != F.col("old_cols"), F.lit(False)
    )
    complete = F.col("rows").isNotNull() & F.col("cols").isNotNull()
    action = (
        F.when(F.col("old_rows").isNull(), F.when(complete, F.lit("create")).otherwise(F.lit("missing")))
        .when(differs, F.lit("conflict"))
        .otherwise(F.lit("open"))
    )
    return requested.join(old, key, "left").select(key, "rows", "cols", "old_rows", "old_cols", action.alias("action"))
