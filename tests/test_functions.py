import math

import pytest
from pyspark.sql import functions as F

from cobblestone.functions import geodesy, planar, tags
from cobblestone.operators import network, raster
from cobblestone.sources.network import uniform_tags
from cobblestone.sources.places import grid_file_name, split_place


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def xy(x, y):
    return planar.point(F.lit(float(x)), F.lit(float(y)))


@pytest.mark.parametrize("text, metres", [
    ("5'6\"", 1.6764), ("5'", None), ("10 ft", 3.048), ("10ft", 3.048), ("7.5 m", 7.5), (" 12 ", 12.0), ("None", None),
    ("wide", None), ("3.5d", None), ("1_0", 10.0), ("", None), ("1e2", 100.0), (".5", 0.5), ("5'6'7", None), (None, None),
])
def test_parse_measure(spark, text, metres):
    got = one(spark, tags.parse_measure(F.lit(text).cast("string")))
    assert got == (pytest.approx(metres) if metres is not None else None)


def test_whole_measures_truncate_toward_zero(spark):
    assert one(spark, tags.parse_measure(F.lit("2.9"), whole=True)) == 2
    assert one(spark, tags.parse_measure(F.lit("-2.9"), whole=True)) == -2
    assert one(spark, tags.parse_measure(F.lit("inf"), whole=True)) is None


def test_width_ladder_does_not_fall_through(spark):
    rows = [(1, ["wide"], False, ["2"], False, ["a"]), (2, None, False, ["2"], False, ["a"]), (3, None, False, ["0"], False, ["a"]),
            (4, None, False, None, False, ["a"]), (5, None, False, None, False, None), (6, ["4", "6"], True, None, False, ["a"]),
            (7, ["4", "x"], True, None, False, ["a"]), (8, [""], False, ["1"], False, ["a"])]
    df = spark.createDataFrame(rows, "id int, w array<string>, wl boolean, l array<string>, ll boolean, h array<string>")
    got = {r[0]: r[1] for r in df.select("id", tags.resolve_width(*[F.col(c) for c in ("w", "wl", "l", "ll", "h")], F.lit(9.0))).collect()}
    assert got == {1: None, 2: 6.0, 3: None, 4: 9.0, 5: 6.0, 6: 5.0, 7: None, 8: 3.0}


def test_class_width_counts_untagged_edges_as_zero(spark):
    df = spark.createDataFrame([(0, 1, "a", "6", None), (1, 2, "a", None, None), (2, 3, "a", "bad", None), (3, 4, "a", None, "x")],
                               "u long, v long, highway string, width string, lanes string")
    assert network.class_widths(uniform_tags(df)).first()["class_width"] == pytest.approx(2.0)


def test_turn_geometry(spark):
    bend = [xy(0, 0), xy(1, 1), xy(2, 0)]
    assert one(spark, planar.circumradius(*bend, planar.NETWORK_GUARD)) == pytest.approx(1.0)
    assert one(spark, planar.deviation(*bend)) == pytest.approx(math.pi / 2)
    straight = [xy(0, 0), xy(1, 0), xy(2, 0)]
    assert one(spark, planar.circumradius(*straight, planar.NETWORK_GUARD)) == math.inf
    assert one(spark, planar.deviation(*straight)) == 0


def test_utm_zone_and_projection_round_trip(spark):
    assert one(spark, geodesy.utm_epsg(F.lit(19.94), F.lit(50.06))) == 32634
    for epsg in (32634, 2180, 32733):
        lat = -33.9 if epsg == 32733 else 50.06
        lon = 15.5 if epsg == 32733 else 19.94
        p = one(spark, geodesy.to_projected(F.lit(lon), F.lit(lat), F.lit(epsg)))
        back = one(spark, geodesy.to_geographic(F.lit(p["x"]), F.lit(p["y"]), F.lit(epsg)))
        assert (back["x"], back["y"]) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))


def test_central_meridian_has_false_easting(spark):
    p = one(spark, geodesy.to_projected(F.lit(21.0), F.lit(0.0), F.lit(32634)))
    assert (p["x"], p["y"]) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))


def test_ribbon_of_a_straight_street(spark):
    ring = one(spark, planar.ribbon(F.array(xy(0, 0), xy(10, 0)), F.lit(4.0)))
    assert {(p["x"], p["y"]) for p in ring} == {(0, -2), (10, -2), (10, 2), (0, 2)}
    assert one(spark, planar.ribbon(F.array(xy(1, 1), xy(1, 1)), F.lit(4.0))) is None


def test_point_along_a_polyline(spark):
    line = F.array(xy(0, 0), xy(3, 0), xy(3, 4))
    for d, want in ((1, (1, 0)), (3, (3, 0)), (5, (3, 2)), (99, (3, 4))):
        p = one(spark, planar.point_along(line, F.lit(float(d))))
        assert (p["x"], p["y"]) == want


def test_clip_to_box_area(spark):
    square = F.array(xy(0, 0), xy(4, 0), xy(4, 4), xy(0, 4))
    clipped = planar.clip_to_box(square, *[F.lit(float(v)) for v in (1, -5, 9, 2)])
    assert one(spark, planar.ring_area(clipped)) == pytest.approx(6.0)


def test_cut_start_formula(spark):
    got = one(spark, raster.cut_start(*[F.lit(v) for v in (2, 2, 40, 40, 16, 100)], clip_index=True))
    assert got == 60  # surplus falls to 2, 2 * 38 - 1 = 75, then the end is kept inside
    assert one(spark, raster.cut_start(*[F.lit(v) for v in (20, 30, 40, 40, 16, 100)], clip_index=False)) == 12


def test_places(spark):
    for text, want in (("Bielsko-Biala-Poland", ("Bielsko-Biala", "Poland")), ("Nice, France", ("Nice", "France")), ("Oslo", ("Oslo", None))):
        got = one(spark, split_place(F.lit(text)))
        assert (got["name"], got["country"]) == want
    assert one(spark, grid_file_name(F.lit("Zielona Góra"))) == "zielona_gora.grid_city"
