"""The street graph of a raster in SQL: ordered lines by keyed recursion, marches, clipping, snapping, contraction, radii."""

from cobblestone.functions import geodesy
from workload.q_morphology import AROUND8, CROSS5, CROSSROADS_SQL, KEY, PASSES, thinning_sql

TILE_H, TILE_W = 150, 200


def tiled_labels_sql(source: str, name: str) -> str:
    return f"""{name}_cells AS MATERIALIZED (SELECT tile_row, tile_col, row, col FROM (SELECT *, unnest(generate_series(CAST(floor((col - 10) / {TILE_W}e0) AS INT), CAST(floor((col + 10) / {TILE_W}e0) AS INT))) AS tile_col FROM (
  SELECT *, unnest(generate_series(CAST(floor((row - 10) / {TILE_H}e0) AS INT), CAST(floor((row + 10) / {TILE_H}e0) AS INT))) AS tile_row FROM {source}) q) p, size
  WHERE tile_row BETWEEN 0 AND (h - 1) // {TILE_H} AND tile_col BETWEEN 0 AND (w - 1) // {TILE_W}),
{name}(tile_row, tile_col, row, col, label) USING KEY (tile_row, tile_col, row, col) AS (
  SELECT tile_row, tile_col, row, col, {KEY} FROM {name}_cells
  UNION
  SELECT r.tile_row, r.tile_col, r.row, r.col, min(l.label) FROM {name} l, {AROUND8}, recurring.{name} r
  WHERE r.tile_row = l.tile_row AND r.tile_col = l.tile_col AND r.row = l.row + o.di AND r.col = l.col + o.dj AND r.label > l.label GROUP BY ALL),
{name}_marked AS MATERIALIZED (SELECT l.*, bool_or(row IN (greatest(tile_row * {TILE_H} - 10, 0), least((tile_row + 1) * {TILE_H} + 10, h) - 1)
  OR col IN (greatest(tile_col * {TILE_W} - 10, 0), least((tile_col + 1) * {TILE_W} + 10, w) - 1)) OVER (PARTITION BY tile_row, tile_col, label) AS conflict FROM {name} l, size)"""


FOUND = f"{CROSSROADS_SQL}, {tiled_labels_sql('xroads', 'crossing')}, {tiled_labels_sql('separated', 'street')}"
DISCOVERY = f"{thinning_sql(PASSES)}, {FOUND}"
JUNCTIONS = f"""junction AS MATERIALIZED (SELECT tile_row, tile_col, crossroad, street, conflict, row, col FROM (
  SELECT c.tile_row, c.tile_col, c.label AS crossroad, c.conflict, s.label AS street, s.row, s.col,
    row_number() OVER (PARTITION BY c.tile_row, c.tile_col, c.label, s.label ORDER BY c.row, c.col, di, dj) AS rn
  FROM crossing_marked c, {AROUND8}, street_marked s WHERE s.tile_row = c.tile_row AND s.tile_col = c.tile_col AND s.row = c.row + di AND s.col = c.col + dj) q WHERE rn = 1)"""

T = "tile_row, tile_col, street"


def walk_sql(name: str, starts: str) -> str:
    """Breadth-first walks of streets from the cells of ``starts`` (tile_row, tile_col, street, key).

    ``path`` leads from the start to a cell by the parents of the walk; (depth, path) orders cells as they are visited.
    ``origin`` is where the cell's branch split off: a parent's first child goes on with its branch, others begin one.
    """
    return f"""{name}(tile_row, tile_col, street, key, depth, path, origin) USING KEY (tile_row, tile_col, street, key) AS (
  SELECT {T}, key, CAST(0 AS BIGINT), [key], CAST([] AS BIGINT[]) FROM {starts}
  UNION
  SELECT {T}, key, depth, list_append(up, key), CASE WHEN key = min(key) OVER (PARTITION BY {T}, up) THEN branch ELSE list_concat([depth], list_append(up, key)) END
  FROM (SELECT s.tile_row, s.tile_col, s.street, s.other AS key, l.depth + 1 AS depth, min(l.path) AS up, arg_min(l.origin, l.path) AS branch
    FROM {name} l JOIN step s ON s.tile_row = l.tile_row AND s.tile_col = l.tile_col AND s.street = l.street AND s.key = l.key
    LEFT JOIN recurring.{name} r ON r.tile_row = s.tile_row AND r.tile_col = s.tile_col AND r.street = s.street AND r.key = s.other
    WHERE r.key IS NULL GROUP BY s.tile_row, s.tile_col, s.street, s.other, l.depth) q)"""


#: ``ordered``: every cell of every street with its place in the line
LINES = f"""{JUNCTIONS},
ends AS MATERIALIZED (SELECT {T}, first({KEY} ORDER BY NOT conflict, crossroad) AS s, CASE WHEN count(*) > 1 THEN last({KEY} ORDER BY NOT conflict, crossroad) END AS e FROM junction GROUP BY {T}),
cell AS MATERIALIZED (SELECT tile_row, tile_col, label AS street, row, col, {KEY} AS key FROM street_marked),
step AS MATERIALIZED (SELECT a.tile_row, a.tile_col, a.street, a.key, b.key AS other FROM cell a, {AROUND8}, cell b
  WHERE b.tile_row = a.tile_row AND b.tile_col = a.tile_col AND b.street = a.street AND b.row = a.row + di AND b.col = a.col + dj),
begins AS MATERIALIZED (SELECT c.tile_row, c.tile_col, c.street, coalesce(any_value(s), min(key)) AS key, any_value(s) AS s, any_value(e) AS e
  FROM cell c LEFT JOIN ends USING ({T}) GROUP BY c.tile_row, c.tile_col, c.street),
{walk_sql('first_walk', 'begins')},
parents AS (SELECT DISTINCT {T}, path[-2] AS key FROM first_walk WHERE depth > 0),
tips AS MATERIALIZED (SELECT w.* FROM first_walk w LEFT JOIN parents p USING (tile_row, tile_col, street, key) WHERE p.key IS NULL),
tip1 AS MATERIALIZED (SELECT {T}, key AS far, path[2] AS way FROM (SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY depth DESC, origin) AS rn FROM tips) q WHERE rn = 1),
tip2 AS MATERIALIZED (SELECT {T}, key AS back FROM (SELECT t.*, row_number() OVER (PARTITION BY t.tile_row, t.tile_col, t.street ORDER BY depth DESC, origin) AS rn
  FROM tips t JOIN tip1 USING ({T}) WHERE depth > 0 AND path[2] <> way) q WHERE rn = 1),
spans AS MATERIALIZED (SELECT b.tile_row, b.tile_col, b.street, coalesce(s, far) AS key, CASE WHEN e IS NOT NULL THEN e WHEN s IS NOT NULL THEN coalesce(back, s) ELSE coalesce(back, b.key) END AS stop, s IS NULL AS alone
  FROM begins b JOIN tip1 USING ({T}) LEFT JOIN tip2 USING ({T})),
lone AS (SELECT {T}, key FROM spans WHERE alone),
{walk_sql('second_walk', 'lone')},
walked AS (SELECT w.tile_row, w.tile_col, w.street, w.key, w.depth, w.path FROM first_walk w JOIN spans USING ({T}) WHERE NOT alone UNION ALL SELECT {T}, key, depth, path FROM second_walk),
ordered AS MATERIALIZED (SELECT w.tile_row, w.tile_col, w.street, CAST(row_number() OVER (PARTITION BY w.tile_row, w.tile_col, w.street ORDER BY w.key = stop, depth, path) - 1 AS INT) AS position,
  CAST(w.key >> 32 AS INT) AS row, CAST(w.key & 4294967295 AS INT) AS col, CAST(count(*) OVER (PARTITION BY w.tile_row, w.tile_col, w.street) AS INT) AS n
  FROM walked w JOIN spans USING ({T}))"""

#: the raster without specks and pinholes
CLEAN = (
    # runs of a row; nine steps from run to run show at least ten cells of any object that has as many
    """run AS MATERIALIZED (SELECT row_number() OVER () AS id, row, min(col) AS c0, max(col) AS c1, count(*) AS cells FROM (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM fx_streets) q GROUP BY row, g),
touching AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM run a JOIN run b ON abs(a.row - b.row) = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1)""",
    """around(root, id, step) USING KEY (root, id) AS (SELECT id, id, 0 FROM run WHERE cells < 10
  UNION SELECT n.root, t.b, n.step + 1 FROM around n JOIN touching t ON t.a = n.id LEFT JOIN recurring.around r ON r.root = n.root AND r.id = t.b WHERE n.step < 9 AND r.id IS NULL GROUP BY n.root, t.b, n.step)""",
    """large AS MATERIALIZED (SELECT row, unnest(generate_series(c0, c1)) AS col FROM run JOIN (SELECT root AS id FROM around JOIN run USING (id) GROUP BY root HAVING sum(cells) >= 10 UNION ALL SELECT id FROM run WHERE cells >= 10) k USING (id))""",
    f"grown AS MATERIALIZED (SELECT DISTINCT row + di AS row, col + dj AS col FROM large, {CROSS5}, size WHERE row + di BETWEEN 0 AND h - 1 AND col + dj BETWEEN 0 AND w - 1)",
    f"""mask AS MATERIALIZED (SELECT q.row, q.col, coalesce(any_value(f.altitude), 0e0) AS altitude FROM (
  SELECT row, col FROM (SELECT g.row + di AS row, g.col + dj AS col FROM grown g, {CROSS5}) v, size WHERE row BETWEEN 0 AND h - 1 AND col BETWEEN 0 AND w - 1 GROUP BY row, col
  HAVING count(*) = 5 - (CASE WHEN row = 0 THEN 1 ELSE 0 END + CASE WHEN row = any_value(h) - 1 THEN 1 ELSE 0 END + CASE WHEN col = 0 THEN 1 ELSE 0 END + CASE WHEN col = any_value(w) - 1 THEN 1 ELSE 0 END)) q
  LEFT JOIN fx_streets f USING (row, col) GROUP BY q.row, q.col)""",
)

#: ``measured``: width and slope along of every line
METRICS = f"""sample AS (SELECT a.tile_row, a.tile_col, a.street, a.position, a.row AS pr, a.col AS pc, b.row - a.row AS dr, b.col - a.col AS dc, sqrt((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) AS len, g.altitude AS pa, f.altitude AS qa
  FROM ordered a JOIN ordered b ON b.tile_row = a.tile_row AND b.tile_col = a.tile_col AND b.street = a.street AND b.position = least(a.position + 3, a.n - 1)
  JOIN mask g ON g.row = a.row AND g.col = a.col JOIN mask f ON f.row = b.row AND f.col = b.col WHERE a.position % 3 = 0 AND a.position < a.n - 1),
moved AS MATERIALIZED (SELECT * FROM sample WHERE len > 0),
ray AS (SELECT {T}, position, side, t, CAST(round_even(pr - side * dc / len * t, 0) AS INT) AS row, CAST(round_even(pc + side * dr / len * t, 0) AS INT) AS col
  FROM moved, (VALUES (1), (-1)) d(side), (SELECT unnest(generate_series(1, 101)) AS t) k),
reach AS (SELECT r.tile_row, r.tile_col, r.street, r.position, r.side, coalesce(min(t) FILTER (m.row IS NULL), 102) - 1 AS steps FROM ray r LEFT JOIN mask m USING (row, col) GROUP BY 1, 2, 3, 4, 5),
across AS (SELECT {T}, position, sum(steps) AS width FROM reach GROUP BY ALL),
measured AS MATERIALIZED (SELECT {T}, coalesce(median(width) FILTER (width > 0), 0) AS width, max(abs(qa - pa) / len) AS slope FROM moved JOIN across USING (tile_row, tile_col, street, position) GROUP BY ALL)"""


def _bound(low: str, high: str, start: str, delta: str, kind: str) -> str:
    """Where a segment enters or leaves the strip low .. high, as a share of it."""
    a, b = f"({low} - {start}) / {delta}", f"({high} - {start}) / {delta}"
    if kind == "enter":
        return f"CASE WHEN {delta} = 0 THEN 0 ELSE least({a}, {b}) END"
    return f"CASE WHEN {delta} = 0 THEN CASE WHEN {start} < {low} OR {start} > {high} THEN -1 ELSE 1 END ELSE greatest({a}, {b}) END"


#: ``raw_edges`` and ``raw_nodes``: the graph before snapping
GRAPH = f"""seg AS (SELECT a.tile_row, a.tile_col, a.street, a.position, CAST(a.row AS DOUBLE) AS r, CAST(a.col AS DOUBLE) AS c, CAST(b.row - a.row AS DOUBLE) AS dr, CAST(b.col - a.col AS DOUBLE) AS dc,
    a.tile_row * {TILE_H} - 0.1e0 AS y0, least((a.tile_row + 1) * {TILE_H}, h) + 0.1e0 AS y1, a.tile_col * {TILE_W} - 0.1e0 AS x0, least((a.tile_col + 1) * {TILE_W}, w) + 0.1e0 AS x1
  FROM ordered a JOIN ordered b ON b.tile_row = a.tile_row AND b.tile_col = a.tile_col AND b.street = a.street AND b.position = a.position + 1, size),
cut AS (SELECT *, greatest(0, {_bound('x0', 'x1', 'c', 'dc', 'enter')}, {_bound('y0', 'y1', 'r', 'dr', 'enter')}) AS enter, least(1, {_bound('x0', 'x1', 'c', 'dc', 'leave')}, {_bound('y0', 'y1', 'r', 'dr', 'leave')}) AS leave FROM seg),
hits AS (SELECT *, CASE WHEN lag(position) OVER s = position - 1 AND lag(leave) OVER s = 1 AND enter = 0 THEN 0 ELSE 1 END AS fresh FROM cut WHERE enter < leave WINDOW s AS (PARTITION BY {T} ORDER BY position)),
pieced AS (SELECT *, sum(fresh) OVER (PARTITION BY {T} ORDER BY position) - 1 AS piece FROM hits),
pieces AS MATERIALIZED (SELECT {T}, piece, count(*) + 1 AS vertices, first(r + enter * dr ORDER BY position) AS py, first(c + enter * dc ORDER BY position) AS px, last(r + leave * dr ORDER BY position) AS qy, last(c + leave * dc ORDER BY position) AS qx FROM pieced GROUP BY ALL),
centres_of AS (SELECT tile_row, tile_col, label, avg(row) AS y, avg(col) AS x FROM crossing_marked GROUP BY ALL),
owned AS MATERIALIZED (SELECT *, printf('%.1f_%.1f', round_even(y, 1), round_even(x, 1)) AS node_id FROM centres_of WHERE y >= tile_row * {TILE_H} AND y < (tile_row + 1) * {TILE_H} AND x >= tile_col * {TILE_W} AND x < (tile_col + 1) * {TILE_W}),
node_cell AS MATERIALIZED (SELECT c.tile_row, c.tile_col, c.row, c.col, o.node_id FROM crossing_marked c JOIN owned o USING (tile_row, tile_col, label)),
ended AS MATERIALIZED (SELECT p.*, a.node_id AS pn, b.node_id AS qn, coalesce(a.node_id, printf('%.1f_%.1f', round_even(py, 1), round_even(px, 1))) AS u, coalesce(b.node_id, printf('%.1f_%.1f', round_even(qy, 1), round_even(qx, 1))) AS v FROM pieces p
  LEFT JOIN node_cell a ON a.tile_row = p.tile_row AND a.tile_col = p.tile_col AND a.row = CAST(round_even(py, 0) AS INT) AND a.col = CAST(round_even(px, 0) AS INT)
  LEFT JOIN node_cell b ON b.tile_row = p.tile_row AND b.tile_col = p.tile_col AND b.row = CAST(round_even(qy, 0) AS INT) AND b.col = CAST(round_even(qx, 0) AS INT)),
raw_nodes AS MATERIALIZED (SELECT node_id, y, x, type FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY type <> 'crossroad', y, x) AS rn FROM (
  SELECT node_id, y, x, 'crossroad' AS type FROM owned UNION ALL SELECT u, py, px, 'connector' FROM ended WHERE pn IS NULL UNION ALL SELECT v, qy, qx, 'connector' FROM ended WHERE qn IS NULL) a) b WHERE rn = 1),
raw_edges AS MATERIALIZED (SELECT u, v, row_number() OVER (PARTITION BY u, v ORDER BY tile_row, tile_col, street, piece) - 1 AS k, vertices, py, px, qy, qx, slope, width, {T}, piece
  FROM ended JOIN measured USING ({T}) WHERE u <> v)"""

#: ``edge`` and ``node``: nodes at most 5 cells apart merged
SNAPPED = """near AS MATERIALIZED (SELECT a.node_id AS a, b.node_id AS b FROM raw_nodes a JOIN raw_nodes b ON a.node_id <> b.node_id AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5 AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 5),
cluster(n, label) USING KEY (n) AS (SELECT DISTINCT a, a FROM near UNION SELECT r.n, min(l.label) FROM cluster l JOIN near ON near.a = l.n JOIN recurring.cluster r ON r.n = near.b WHERE r.label > l.label GROUP BY r.n),
winner AS MATERIALIZED (SELECT n AS node_id, first_value(n) OVER (PARTITION BY label ORDER BY type <> 'crossroad', n) AS winner FROM cluster JOIN raw_nodes ON node_id = n),
bent AS MATERIALIZED (SELECT coalesce(a.winner, u) AS u, coalesce(b.winner, v) AS v, e.u AS ou, e.v AS ov, k AS ok, vertices, slope, width, street, piece, tile_row, tile_col FROM raw_edges e LEFT JOIN winner a ON a.node_id = e.u LEFT JOIN winner b ON b.node_id = e.v),
edge AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY ou, ov, ok) - 1 AS k FROM bent WHERE u <> v),
node AS MATERIALIZED (SELECT * FROM raw_nodes WHERE node_id IN (SELECT winner FROM winner UNION SELECT u FROM bent UNION SELECT v FROM bent) OR (SELECT count(*) FROM winner) = 0)"""

LAT0, LON0 = 50.0, 19.0


def degrees_sql(y: str, x: str) -> tuple[str, str]:
    """Latitude and longitude of a raster position."""
    return f"({LAT0} - {y} * 1e0 / 111132e0)", f"({LON0} + {x} * 1e0 / (111412e0 * cos(radians({LAT0}))))"


def metres_sql(source: str, keep: str) -> str:
    """Positions (``keep``, y, x) of a raster in metres of UTM zone 34: (``keep``, mx, my)."""
    lat, lon = degrees_sql("y", "x")
    scale, e = repr(geodesy.UTM_SCALE * geodesy.RECTIFYING_RADIUS), repr(geodesy.ECCENTRICITY_LIKE)
    xs = " + ".join(f"CAST({a!r} AS DOUBLE) * cos({2 * (j + 1)} * xi) * sinh({2 * (j + 1)} * eta)" for j, a in enumerate(geodesy.ALPHA))
    ys = " + ".join(f"CAST({a!r} AS DOUBLE) * sin({2 * (j + 1)} * xi) * cosh({2 * (j + 1)} * eta)" for j, a in enumerate(geodesy.ALPHA))
    return f"""SELECT {keep}, 500000 + {scale} * (eta + {xs}) AS mx, {scale} * (xi + {ys}) AS my
  FROM (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM (SELECT *, radians(lon) - radians(21e0) AS dl, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t
    FROM (SELECT *, {lat} AS lat, {lon} AS lon FROM {source}) g) h) i"""


def _gap(a: str, b: str) -> str:
    return f"sqrt(({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y))"


#: ``radii``: the radius between every two neighbours of a node, 10 m along their edges
RADII = f"""corners AS (SELECT {T}, piece, position - min(position) OVER s AS i, r + enter * dr AS y, c + enter * dc AS x FROM pieced WINDOW s AS (PARTITION BY {T}, piece)
  UNION ALL SELECT {T}, piece, vertices - 1, qy, qx FROM pieces),
placed AS (SELECT e.u, e.v, e.k, c.i, CASE WHEN c.i = 0 THEN a.y WHEN c.i = e.vertices - 1 THEN b.y ELSE c.y END AS y, CASE WHEN c.i = 0 THEN a.x WHEN c.i = e.vertices - 1 THEN b.x ELSE c.x END AS x
  FROM edge e JOIN corners c USING ({T}, piece) JOIN raw_nodes a ON a.node_id = e.u JOIN raw_nodes b ON b.node_id = e.v),
metric AS MATERIALIZED ({metres_sql('placed', 'u, v, k, i')}),
spot AS MATERIALIZED ({metres_sql('node', 'node_id')}),
stretch AS (SELECT m.*, lead(mx) OVER w AS nx, lead(my) OVER w AS ny FROM metric m WINDOW w AS (PARTITION BY u, v, k ORDER BY i)),
bits AS (SELECT u, v, k, i, mx AS ax, my AS ay, nx AS ex, ny AS ey, {_gap('m', 'n')} AS d FROM stretch WHERE nx IS NOT NULL),
summed AS MATERIALIZED (SELECT *, sum(d) OVER (PARTITION BY u, v, k ORDER BY i) - d AS gone, sum(d) OVER (PARTITION BY u, v, k) AS total FROM bits WHERE d > 0),
way AS (SELECT node, n, u, v, k FROM (SELECT *, row_number() OVER (PARTITION BY node, n ORDER BY rank, k) AS rn FROM (
  SELECT u AS node, v AS n, 0 AS rank, u, v, k FROM edge UNION ALL SELECT v, u, 1, u, v, k FROM edge) a) b WHERE rn = 1),
aims AS (SELECT w.node, w.n, s.*, a.mx AS qx, a.my AS qy, CASE WHEN w.node = w.u THEN CASE WHEN total < 10 THEN total / 2 ELSE 10 END ELSE total - CASE WHEN total < 10 THEN total / 2 ELSE 10 END END AS aim
  FROM way w JOIN summed s USING (u, v, k) JOIN spot a ON a.node_id = w.node),
arm AS MATERIALIZED (SELECT node, n, qx, qy, ax + share * ex - share * ax AS px, ay + share * ey - share * ay AS py FROM (SELECT *, (aim - gone) / d AS share FROM aims) f WHERE gone < aim AND aim <= gone + d),
sides AS (SELECT a.node, a.n AS n1, b.n AS n2, sqrt((a.px - a.qx) ** 2 + (a.py - a.qy) ** 2) AS a, sqrt((b.px - b.qx) ** 2 + (b.py - b.qy) ** 2) AS b, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS c FROM arm a JOIN arm b ON a.node = b.node AND a.n < b.n),
halves AS (SELECT *, (a + b + c) / 2 AS s FROM sides),
areas AS (SELECT *, s * (s - a) * (s - b) * (s - c) AS sq FROM halves),
degree AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edge UNION ALL SELECT v FROM edge) d GROUP BY node),
radii AS MATERIALIZED (SELECT node, n1, n2, CASE WHEN degree <= 2 THEN 'street' ELSE 'junction' END AS kind, CASE WHEN least(a, b, c) < 1e-9 OR sq <= 1e-16 THEN CAST('Infinity' AS DOUBLE) ELSE a * b * c / (4 * sqrt(sq)) END AS radius FROM areas JOIN degree USING (node))"""

STREET_GRAPH = ",\n".join([thinning_sql(PASSES, source="mask", before=CLEAN), FOUND, LINES, METRICS, GRAPH, SNAPPED])
