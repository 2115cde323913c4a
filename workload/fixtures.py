"""Views over the driver's tables, written once as SQL for both engines.

Placeholders: ``{table}`` is a driver table, ``{explode}``/``{seq}`` the engine's
spelling of array explosion and integer ranges; ``{spread}`` has Spark deal the few rows of a select, which become many, to
all tasks (DuckDB gets nothing there). Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Raster cells between two lattice nodes.
PITCH = 16

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # customers as nodes of a jittered 100 m lattice, as wide as high
    "fx_nodes": ((), """
SELECT node_id, lc, lr, CAST(lc * 100 + (node_id * 7 % 11) AS DOUBLE) AS x, CAST(lr * 100 + (node_id * 5 % 13) AS DOUBLE) AS y, c_mktsegment
FROM (SELECT node_id, CAST(node_id % side AS INT) AS lc, CAST(floor(node_id / CAST(side AS DOUBLE)) AS INT) AS lr, c_mktsegment
      FROM (SELECT c_custkey AS node_id, c_mktsegment, (SELECT CAST(ceil(sqrt(count(*))) AS INT) FROM {customer}) AS side FROM {customer}) c) q"""),
    # one-way lattice edges with messy tags: rows R*, columns C*
    "fx_edges": (("fx_nodes",), """
SELECT q.u, q.v, 0 AS k, q.name,
  CASE q.seg WHEN 'HOUSEHOLD' THEN 'residential' WHEN 'MACHINERY' THEN 'primary' WHEN 'FURNITURE' THEN 'secondary' ELSE 'tertiary' END AS highway,
  CASE q.u % 6 WHEN 0 THEN CAST(4 + q.u % 5 AS VARCHAR(10)) WHEN 1 THEN concat(CAST(20 + q.u % 9 AS VARCHAR(10)), ' ft') ELSE NULL END AS width,
  CASE q.u % 6 WHEN 2 THEN CAST(1 + q.u % 3 AS VARCHAR(10)) WHEN 3 THEN 'x' ELSE NULL END AS lanes
FROM (SELECT a.node_id AS u, b.node_id AS v, concat('R', CAST(a.lr AS VARCHAR(10))) AS name, a.c_mktsegment AS seg
      FROM fx_nodes a JOIN fx_nodes b ON b.node_id = a.node_id + 1 AND b.lr = a.lr
      UNION ALL
      SELECT a.node_id, b.node_id, concat('C', CAST(a.lc AS VARCHAR(10))), a.c_mktsegment
      FROM fx_nodes a JOIN fx_nodes b ON b.lr = a.lr + 1 AND b.lc = a.lc) q"""),
    # long row streets; a column street starts only at BUILDING customers, so most nodes have degree 2
    "fx_ways": (("fx_nodes",), """
SELECT a.node_id AS u, b.node_id AS v, 0 AS k, concat('R', CAST(a.lr AS VARCHAR(10))) AS name
FROM fx_nodes a JOIN fx_nodes b ON b.node_id = a.node_id + 1 AND b.lr = a.lr
UNION ALL
SELECT a.node_id, b.node_id, 0, concat('C', CAST(a.lc AS VARCHAR(10)))
FROM fx_nodes a JOIN fx_nodes b ON b.lr = a.lr + 1 AND b.lc = a.lc WHERE a.c_mktsegment = 'BUILDING'"""),
    # noise raster: eight places per order in a square, so that its cells grow with lineitem in both directions
    "fx_side": ((), "SELECT CAST(ceil(sqrt(8 * (max(l_orderkey) + 1))) AS INT) AS side FROM {lineitem}"),
    "fx_cells": (("fx_side",), """
SELECT CAST(floor(place / CAST(side AS DOUBLE)) AS INT) AS row, CAST(place % side AS INT) AS col,
  CAST(max(CASE WHEN l_quantity >= 15 THEN 1 ELSE 0 END) AS DOUBLE) AS is_street, max(l_extendedprice) AS altitude,
  CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS is_residential
FROM (SELECT l_orderkey * 8 + l_linenumber AS place, (SELECT side FROM fx_side) AS side, l_quantity, l_extendedprice, l_returnflag FROM {lineitem}) q
GROUP BY 1, 2"""),
    # drawn streets that grow with customer: a bar right of and a bar below each lattice node,
    # 3 to 5 cells thick; some market segments leave a bar out (crossings, T-junctions, dead ends)
    "fx_streets": (("fx_nodes",), """
SELECT row, col, CAST(1 AS DOUBLE) AS is_street, CAST(row AS DOUBLE) / 10 + CAST(col AS DOUBLE) / 20 AS altitude,
  max(res) AS is_residential
FROM (SELECT CAST(r0 + di AS INT) AS row, CAST(c0 + dj AS INT) AS col, res
      FROM (SELECT r0, c0, w, res, di, {explode}({seq}(0, w - 1)) AS dj
            FROM (SELECT r0, c0, w, res, {explode}({seq}(0, h - 1)) AS di
                  FROM (SELECT{spread} lr * 16 AS r0, lc * 16 AS c0, CAST(3 + node_id % 3 AS INT) AS h, 16 AS w,
                          CAST(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS DOUBLE) AS res
                        FROM fx_nodes WHERE c_mktsegment <> 'MACHINERY'
                        UNION ALL
                        SELECT{spread} lr * 16, lc * 16, 16, CAST(3 + node_id % 2 AS INT), CAST(0 AS DOUBLE)
                        FROM fx_nodes WHERE c_mktsegment <> 'BUILDING') bars) p1) p2) p3
GROUP BY row, col"""),
    "fx_tags": ((), """
SELECT p_partkey AS edge_id, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS VARCHAR(10)) WHEN 1 THEN concat(CAST(p_size AS VARCHAR(10)), ' ft')
  WHEN 2 THEN concat(CAST(p_size AS VARCHAR(10)), '''6"') WHEN 3 THEN concat(CAST(p_size AS VARCHAR(10)), ' m') WHEN 4 THEN 'nan'
  WHEN 5 THEN concat(CAST(p_size AS VARCHAR(10)), '''') WHEN 6 THEN 'wide' ELSE NULL END AS width
FROM {part}"""),
    "fx_pred": ((), """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y_true, abs(l_discount) * 10 AS y_pred, l_returnflag AS run
FROM {lineitem}"""),
    "fx_log": ((), """
SELECT event_id AS line_no, CASE WHEN event_id % 10 = 0 THEN concat('performing ', CAST(CAST(floor(event_id / CAST(10 AS DOUBLE)) AS INT) AS VARCHAR(10)), '-th epoch')
  WHEN event_id % 10 = 9 THEN concat('val_is_street__dice_coef: ', CAST(event_id * 37 % 1000 AS VARCHAR(10)), ' - is_street_loss: ', CAST(event_id * 53 % 997 AS VARCHAR(10)))
  ELSE 'step' END AS value FROM {events}"""),
    "fx_fold": ((), """
SELECT epoch, metric, value FROM (SELECT CAST(floor(event_id / CAST(4 AS DOUBLE)) AS INT) AS epoch, concat('m', CAST(event_id % 4 AS VARCHAR(2))) AS metric, value FROM {events}) q"""),
    "fx_elev": ((), """
SELECT CAST(s_suppkey % 16 AS INT) AS ti, CAST(floor(s_suppkey / CAST(16 AS DOUBLE)) AS INT) AS tj, s_acctbal AS elevation FROM {supplier}"""),
    "fx_headers": ((), """
SELECT s_suppkey AS grid_id, concat('1;', CAST(100 + s_suppkey % 37 AS VARCHAR(10)), ';', CAST(90 + s_suppkey % 41 AS VARCHAR(10)), ';0.0;50.0;1.0;',
  CAST(20 + s_suppkey % 3 * 10 AS VARCHAR(10)), ';', CAST(15 + s_suppkey % 4 * 5 AS VARCHAR(10)), ';', CASE WHEN s_suppkey % 2 = 0 THEN 'little' ELSE 'big' END, ';3') AS header FROM {supplier}"""),
    "fx_places": ((), """
SELECT n_nationkey AS place_id, concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN ', Land' ELSE '-Land' END) AS place, CASE n_nationkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'town' ELSE 'village' END AS kind,
  CAST(n_nationkey % 5 * 800 AS DOUBLE) AS min_x, CAST(n_nationkey % 5 * 800 + 800 AS DOUBLE) AS max_x,
  CAST(floor(n_nationkey / CAST(5 AS DOUBLE)) * 800 AS DOUBLE) AS min_y, CAST(floor(n_nationkey / CAST(5 AS DOUBLE)) * 800 + 800 AS DOUBLE) AS max_y FROM {nation}"""),
    "fx_areas": (("fx_places",), """
SELECT place_id, concat('{{"type":"Polygon","coordinates":[[[', CAST(CAST(min_x AS INT) AS VARCHAR(10)), ',', CAST(CAST(min_y AS INT) AS VARCHAR(10)), '],[', CAST(CAST(max_x AS INT) AS VARCHAR(10)), ',', CAST(CAST(min_y AS INT) AS VARCHAR(10)),
  '],[', CAST(CAST(max_x AS INT) AS VARCHAR(10)), ',', CAST(CAST(max_y AS INT) AS VARCHAR(10)), '],[', CAST(CAST(min_x AS INT) AS VARCHAR(10)), ',', CAST(CAST(max_y AS INT) AS VARCHAR(10)), ']]]}}') AS body FROM fx_places"""),
}


def _closure(names) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for need in [*_closure(VIEWS[name][0]), name]:
            if need not in ordered:
                ordered.append(need)
    return ordered


def _with(names, names_of: dict[str, str]) -> str:
    return ",\n".join(f"{n} AS ({VIEWS[n][1].format(**names_of)})" for n in _closure(names))


def duckdb_sql(sql: str, uses: tuple[str, ...] = ()) -> str:
    """The query behind its fixture views, as one DuckDB statement."""
    if not uses:
        return sql
    views = _with(uses, {**{t: t for t in TABLES}, "explode": "unnest", "seq": "generate_series", "spread": ""})
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    if body[:4].upper() == "WITH":
        return f"WITH {views},\n{body[4:]}"
    return f"WITH {views}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    # a table of one small file is one task, which would hold every cell that its rows become
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    views = _with([name], {**files, "explode": "explode", "seq": "sequence", "spread": f" /*+ REPARTITION({tasks}) */"})
    return spark.sql(f"WITH {views} SELECT * FROM {name}")


def cells_side(spark: SparkSession, sf_dir: str) -> int:
    """Rows and columns of ``fx_cells``."""
    return view(spark, sf_dir, "fx_side").first()[0]
