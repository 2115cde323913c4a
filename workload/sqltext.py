"""SQL fragments shared by several oracles."""

# tag text to metres, spelled for the grammar of the fixtures (plain, ft, feet-inches, m, words)
def measure(tag: str, whole: bool = False) -> str:
    t = f"trim({tag})"
    num = "TRY_CAST({} AS DOUBLE)"
    value = f"""CASE WHEN {tag} IS NULL OR lower({t}) IN ('nan', 'none', 'null', '') THEN NULL
      WHEN contains({t}, '''') THEN {num.format(f"nullif(split_part(replace({t}, '\"', ''), '''', 1), '')")} * CAST(0.3048 AS DOUBLE)
        + {num.format(f"nullif(split_part(replace({t}, '\"', ''), '''', 2), '')")} * CAST(0.0254 AS DOUBLE)
      WHEN {t} LIKE '%ft' THEN {num.format(f"trim(replace({t}, 'ft', ''))")} * CAST(0.3048 AS DOUBLE)
      WHEN {t} LIKE '%m' THEN {num.format(f"trim(replace({t}, 'm', ''))")}
      ELSE {num.format(t)} END"""
    return f"CAST(trunc({value}) AS BIGINT)" if whole else f"({value})"


CLASS_WIDTHS = f"""class_widths AS (
  SELECT highway AS class, avg(share) AS class_width FROM (
    SELECT highway, CASE WHEN width IS NOT NULL THEN {measure('width')}
      WHEN lanes IS NOT NULL AND lanes <> '' THEN coalesce(nullif({measure('lanes', True)}, 0) * 3, 0)
      ELSE 0 END AS share FROM fx_edges) s GROUP BY highway)"""

WIDTHS = CLASS_WIDTHS + f""",
widths AS (
  SELECT e.*, CASE WHEN width IS NOT NULL AND width <> '' THEN {measure('width')}
      WHEN lanes IS NOT NULL AND lanes <> '' THEN CAST(nullif({measure('lanes', True)}, 0) * 3 AS DOUBLE)
      WHEN highway IS NOT NULL THEN class_width ELSE 6 END AS width_m
  FROM fx_edges e LEFT JOIN class_widths c ON c.class = e.highway)"""

GEOMETRY = """geometry AS (
  SELECT w.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM widths w JOIN fx_nodes a ON a.node_id = w.u JOIN fx_nodes b ON b.node_id = w.v)"""


def dist(ax, ay, bx, by):
    return f"sqrt(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"


def angle_gap(a, b):
    return f"(CASE WHEN abs({a} - {b}) > pi() THEN 2 * pi() - abs({a} - {b}) ELSE abs({a} - {b}) END)"


def radius(a, b, c, side, area):
    s = f"(({a} + {b} + {c}) / 2)"
    sq = f"({s} * ({s} - {a}) * ({s} - {b}) * ({s} - {c}))"
    return (
        f"(CASE WHEN least({a}, {b}, {c}) < {side} OR {sq} <= {area} THEN CAST('Infinity' AS DOUBLE) "
        f"ELSE ({a} * {b} * {c}) / (4 * sqrt({sq})) END)"
    )
