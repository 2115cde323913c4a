"""Free-text street tags to numbers: widths, lanes, residential class."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit factors, lane width, default width and residential class.
METRES_PER_FOOT = 0.3048
METRES_PER_INCH = 0.0254
METRES_PER_LANE = 3
DEFAULT_WIDTH_M = 6.0
NULL_WORDS = ("nan", "none", "null", "")
RESIDENTIAL_CLASS = "residential"

_BLANKS = " \t\n\r\f\v"
_NUMBER = (
    r"^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))$"
)


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def lenient_double(text: Column) -> Column:
    """Plain decimal text to DOUBLE; suffixes such as ``3.5d`` are not numbers."""
    text = _strip(text)
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def parse_measure(tag: Column, whole: bool = False) -> Column:
    """Metres (or a lane count) written in a tag; null when it cannot be read.

    The first rule that applies decides: null words, feet and inches, feet,
    metres, bare number. ``whole`` truncates toward zero.
    """
    text = _strip(tag)
    quoted = text.contains("'")
    parts = F.split(F.replace(text, F.lit('"'), F.lit("")), "'")
    amount = (
        F.when(quoted, F.when(F.size(parts) == 2, F.get(parts, F.lit(0))))
        .when(text.endswith("ft"), F.replace(text, F.lit("ft"), F.lit("")))
        .when(text.endswith("m"), F.replace(text, F.lit("m"), F.lit("")))
        .when(~F.lower(text).isin(*NULL_WORDS), text)
    )
    unit = F.when(quoted | text.endswith("ft"), F.lit(METRES_PER_FOOT)).otherwise(F.lit(1.0))
    inches = F.when(quoted, lenient_double(F.get(parts, F.lit(1))) * METRES_PER_INCH).otherwise(F.lit(0.0))
    value = lenient_double(amount) * unit + inches
    return value.try_cast("bigint") if whole else value


def mean_measure(tags: Column, whole: bool = False) -> Column:
    """Mean over a list-valued tag; one unreadable element makes it null."""
    total = F.aggregate(
        F.transform(tags, lambda t: parse_measure(t, whole).cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return total / F.nullif(F.size(tags), F.lit(0))


def _present(tags: Column, is_list: Column) -> Column:
    """A tag that is set and not empty (an empty string or list counts as missing)."""
    return F.coalesce(F.when(is_list, F.size(tags) > 0).otherwise(F.get(tags, F.lit(0)) != ""), F.lit(False))


def _measure(tags: Column, is_list: Column, whole: bool = False) -> Column:
    scalar = parse_measure(F.get(tags, F.lit(0)), whole).cast("double")
    return F.when(is_list, mean_measure(tags, whole)).otherwise(scalar)


def _lanes_width(lanes: Column, lanes_is_list: Column, no_lanes: Column) -> Column:
    count = _measure(lanes, lanes_is_list, whole=True)
    listed = count * METRES_PER_LANE
    scalar = F.when(count != 0, count * METRES_PER_LANE).otherwise(no_lanes)
    return F.when(lanes_is_list, listed).otherwise(scalar)


def resolve_width(
    width: Column, width_is_list: Column, lanes: Column, lanes_is_list: Column, highway: Column, class_width: Column
) -> Column:
    """Edge width: width tag, else lanes, else the class average, else 6 m.

    A tag that is present but unreadable yields null; it does not fall through.
    """
    return (
        F.when(_present(width, width_is_list), _measure(width, width_is_list))
        .when(_present(lanes, lanes_is_list), _lanes_width(lanes, lanes_is_list, F.lit(None).cast("double")))
        .when(F.coalesce(F.get(highway, F.lit(0)) != "", F.lit(False)), class_width)
        .otherwise(F.lit(DEFAULT_WIDTH_M))
    )


def class_width_share(width: Column, width_is_list: Column, lanes: Column, lanes_is_list: Column) -> Column:
    """What one edge adds to the average width of its class (null = not counted)."""
    return (
        F.when(width.isNotNull(), _measure(width, width_is_list))
        .when(_present(lanes, lanes_is_list), _lanes_width(lanes, lanes_is_list, F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )


def tag_coverage(width: Column, width_is_list: Column, lanes: Column, lanes_is_list: Column, highway: Column) -> Column:
    """Which tag decides an edge's width: ``measured``, ``class`` or ``default``."""
    return (
        F.when(_present(width, width_is_list) | _present(lanes, lanes_is_list), F.lit("measured"))
        .when(F.coalesce(F.get(highway, F.lit(0)) != "", F.lit(False)), F.lit("class"))
        .otherwise(F.lit("default"))
    )


def is_residential(highway: Column, highway_is_list: Column, radius: Column, max_radius: float = 30.0) -> Column:
    scalar = ~highway_is_list & (F.get(highway, F.lit(0)) == RESIDENTIAL_CLASS)
    return F.coalesce(scalar & (radius < max_radius), F.lit(False))
