"""Common table expressions shared by the SQL the queries are checked against."""

CELLS = """
cells AS (
  SELECT o_orderkey // 1500 AS region_id, o_orderkey AS cell_id,
         CAST((o_orderkey % 2147483648) * 2654435761 % 4294967296 AS DOUBLE) / 4294967296 * 1239 AS x,
         CAST((o_orderkey % 2147483648) * 1597334677 % 4294967296 AS DOUBLE) / 4294967296 * 1239 AS y,
         o_orderpriority AS cell_type,
         CAST(50 + o_totalprice % 400 AS DOUBLE) AS size_area,
         CAST(o_custkey % 314 AS DOUBLE) / 100 - CAST(1.57 AS DOUBLE) AS orientation,
         CAST(o_orderkey * 7 % 101 AS DOUBLE) / 103 AS shape_circularity,
         CAST(o_orderkey * 13 % 100 AS DOUBLE) / 101 AS shape_eccentricity,
         CAST(o_orderkey * 29 % 100 AS DOUBLE) / 107 AS shape_solidity,
         CAST(o_custkey % 9 - 1 AS INT) AS cluster
  FROM orders)"""

EXPRESSION = """
expression AS (
  SELECT l_orderkey // 1500 AS region_id, l_orderkey AS cell_id, avg(l_quantity) AS qty,
         avg(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey)"""

EXPRESSION_LONG = """
expression_long AS (
  SELECT region_id, cell_id, unnest(['qty', 'price', 'disc', 'tax']) AS biomarker,
         unnest([qty, price, disc, tax]) AS value FROM expression)"""

ENRICHED = """
enriched AS (
  SELECT c.*, e.qty, e.price, e.disc, e.tax
  FROM cells c LEFT JOIN expression e ON c.cell_id = e.cell_id)"""

ROIS = """
rois AS (
  SELECT region_id, CAST(r AS INT) AS roi_id,
         CAST(413 * (r // 3) - 20 AS DOUBLE) AS x0, CAST(413 * (r // 3) + 433 AS DOUBLE) AS x1,
         CAST(413 * (r % 3) - 20 AS DOUBLE) AS y0, CAST(413 * (r % 3) + 433 AS DOUBLE) AS y1
  FROM (SELECT DISTINCT o_orderkey // 1500 AS region_id FROM orders), range(9) t(r))"""

ROI_MEMBERS = """
roi_members AS (
  SELECT r.roi_id, c.* FROM {source} c JOIN rois r ON c.region_id = r.region_id
   AND c.x BETWEEN r.x0 AND r.x1 AND c.y BETWEEN r.y0 AND r.y1)"""

# Window corners start at (-64, -64) with stride 64 and size 128.
WINDOW_MEMBERS = """
window_all AS (
  SELECT c.*, -64 + 64 * ix AS x0, -64 + 64 * iy AS y0
  FROM {source} c, range(25) a(ix), range(25) b(iy)
  WHERE c.x BETWEEN -64 + 64 * ix AND 64 + 64 * ix AND c.y BETWEEN -64 + 64 * iy AND 64 + 64 * iy),
window_members AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY region_id, x0, y0) AS n_cells FROM (
      SELECT *, row_number() OVER (PARTITION BY region_id, x0, y0
                ORDER BY md5('123:' || x0 || ':' || y0 || ':' || cell_id), cell_id) AS draw
      FROM window_all) WHERE draw <= {n_max})
  WHERE n_cells >= {n_min})"""


def windows(source: str = "cells", n_min: int = 5, n_max: int = 50) -> str:
    return WINDOW_MEMBERS.format(source=source, n_min=n_min, n_max=n_max)


def roi_members(source: str = "cells") -> str:
    return ROI_MEMBERS.format(source=source)


def means(source: str, keys: str, columns: list[str], name: str) -> str:
    """Long table of group averages, rounded before ranking."""
    names = ", ".join(f"'{c}'" for c in columns)
    averages = ", ".join(f"round(avg({c}), 9)" for c in columns)
    return f"""
{name} AS (
  SELECT {keys}, unnest([{names}]) AS biomarker, unnest([{averages}]) AS value
  FROM {source} GROUP BY {keys})"""


def scores(reference: str, query: str, keys: str, name: str = "scores") -> str:
    """z and percentile of ``query`` rows among the ``reference`` rows of their group."""
    same = " AND ".join(f"r.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    stats = " AND ".join(f"s.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_stats AS (
  SELECT {keys}, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n
  FROM {reference} WHERE value IS NOT NULL GROUP BY {keys}),
{name}_ranks AS (
  SELECT q.{keys.replace(', ', ', q.')}, q.value, count(*) FILTER (r.value < q.value) AS below,
         count(*) FILTER (r.value <= q.value) AS upto
  FROM (SELECT DISTINCT {keys}, value FROM {query} WHERE value IS NOT NULL) q
  JOIN {reference} r ON {same} WHERE r.value IS NOT NULL GROUP BY ALL),
{name} AS (
  SELECT q.*, CASE WHEN s.sd <> 0 THEN (q.value - s.mean) / s.sd END AS z,
         (k.below + k.upto + CASE WHEN k.upto > k.below THEN 1 ELSE 0 END) * 50.0::DOUBLE / s.n
           AS percentile
  FROM {query} q
  LEFT JOIN {name}_stats s ON {stats}
  LEFT JOIN {name}_ranks k ON {same.replace('r.', 'k.')} AND k.value = q.value)"""
