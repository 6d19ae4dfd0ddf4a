"""Windows, averages, scores, composition and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import score_against
from ..operators import describe, features, spatial, windows
from ..operators.filters import cells_in_rois
from ..schema import PATCH
from ..session import cut_lineage
from . import bindings as b
from . import oracle_parts as o
from .registry import query, rounded, with_parts

B = b.BIOMARKERS
BASE = (o.CELLS, o.EXPRESSION, o.ENRICHED)
TARGETS = (*BASE, o.ROIS, o.roi_members("enriched"))


def patches(spark, sf_dir):
    """Mean expression of every reference window."""
    return windows.window_averages(windows.sliding_windows(b.enriched(spark, sf_dir), origin=b.CORNER, keep=B), B)


def targets(spark, sf_dir):
    return cells_in_rois(b.enriched(spark, sf_dir), b.rois(spark, sf_dir))


@query(with_parts(o.CELLS, o.windows(), select="""
SELECT region_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x0 + 128 AS BIGINT) AS x1,
       CAST(y0 + 128 AS BIGINT) AS y1, x0 + 64.0::DOUBLE AS center_x, y0 + 64.0::DOUBLE AS center_y,
       x0 || '-' || (x0 + 128) || '-' || y0 || '-' || (y0 + 128) AS patch_name, count(*) AS n_cells
FROM window_members GROUP BY region_id, x0, y0"""))
def sliding_windows(spark, sf_dir):
    members = windows.sliding_windows(b.cells(spark, sf_dir), origin=b.CORNER)
    return windows.describe_windows(members).drop("patch_size")


@query(with_parts(*BASE, o.windows("enriched", n_max=12), o.means("window_members", "region_id, x0, y0", B, "avgs"), select="""
SELECT region_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, biomarker,
       round(value, 6) AS value FROM avgs"""))
def capped_signal_average(spark, sf_dir):
    members = windows.sliding_windows(b.enriched(spark, sf_dir), origin=b.CORNER, keep=B)
    means = windows.window_averages(members, B, n_max=12)
    return rounded(features.means_to_long(means, ["region_id", "x0", "y0"], B), "value")


@query(with_parts(o.CELLS, o.windows(n_max=12), select="""
SELECT region_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, cell_id FROM window_members"""))
def window_cap(spark, sf_dir):
    members = windows.cap_members(windows.sliding_windows(b.cells(spark, sf_dir), origin=b.CORNER), n_max=12)
    return members.select("region_id", "x0", "y0", "cell_id")


@query(with_parts(o.CELLS, o.windows(), select="""
SELECT region_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, cell_id FROM window_members
JOIN (SELECT region_id, x0, y0, row_number() OVER (PARTITION BY region_id
             ORDER BY md5('123:128:' || x0 || ':' || y0), x0, y0) AS pick
      FROM window_members GROUP BY region_id, x0, y0) USING (region_id, x0, y0) WHERE pick <= 100"""))
def reference_patches_drawn(spark, sf_dir):
    members = windows.cap_members(windows.sliding_windows(b.cells(spark, sf_dir), origin=b.CORNER))
    drawn = windows.reference_patches(members, count=100)
    return drawn.select("region_id", "x0", "y0", "cell_id")


@query(with_parts(o.CELLS, """
multi AS (
  SELECT region_id, s AS patch_size, -64 + (s // 2) * ix AS x0, -64 + (s // 2) * iy AS y0, cell_id,
         count(*) OVER (PARTITION BY region_id, s, ix, iy) AS n
  FROM cells, (VALUES (64), (128)) t(s), range(45) a(ix), range(45) b(iy)
  WHERE x BETWEEN -64 + (s // 2) * ix AND -64 + (s // 2) * ix + s
    AND y BETWEEN -64 + (s // 2) * iy AND -64 + (s // 2) * iy + s)""", select="""
SELECT region_id, CAST(patch_size AS INT) AS patch_size, CAST(x0 AS BIGINT) AS x0,
       CAST(y0 AS BIGINT) AS y0, cell_id FROM multi WHERE n >= 5"""))
def reference_patches(spark, sf_dir):
    members = windows.cap_members(windows.sliding_windows(b.cells(spark, sf_dir), origin=b.CORNER, sizes=(64, 128)))
    return windows.reference_patches(members).select(*PATCH, "cell_id")


@query(with_parts(o.CELLS, """
moved AS (SELECT region_id, cell_id, x - 5000 AS x, y - 300.5::DOUBLE AS y FROM cells)""", """
corners AS (
  SELECT region_id, CAST(floor(min(x)) AS BIGINT) - 64 AS xs, CAST(floor(min(y)) AS BIGINT) - 64 AS ys
  FROM moved GROUP BY region_id)""", """
held AS (
  SELECT region_id, xs + 64 * i AS x0, ys + 64 * j AS y0
  FROM moved JOIN corners USING (region_id), range(23) a(i), range(23) b(j)
  WHERE x BETWEEN xs + 64 * i AND xs + 64 * i + 128 AND y BETWEEN ys + 64 * j AND ys + 64 * j + 128)""", select="""
SELECT region_id, x0, y0, count(*) AS n_cells FROM held GROUP BY ALL HAVING count(*) >= 5"""))
def sliding_windows_by_region(spark, sf_dir):
    """Windows from each region's own minimum, here at negative coordinates."""
    moved = b.cells(spark, sf_dir).withColumns({"x": F.col("x") - 5000, "y": F.col("y") - 300.5})
    return windows.describe_windows(windows.sliding_windows(moved)).select("region_id", "x0", "y0", "n_cells")


def _random_start(corner: str, low: str) -> str:
    draw = f"(('0x' || substr(md5('123:{corner}:128:' || region_id || ':' || repeat), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"
    start = f"{low} - 64 + floor({draw} * 128)"
    return f"CAST(CASE WHEN {start} < 0 THEN ceil({start}) ELSE floor({start}) END AS BIGINT)"


@query(with_parts(o.CELLS, f"""
starts AS (
  SELECT DISTINCT region_id, {_random_start('_x', 'low_x')} AS xs, {_random_start('_y', 'low_y')} AS ys
  FROM (SELECT region_id, min(x) AS low_x, min(y) AS low_y FROM cells GROUP BY region_id), range(2) t(repeat))""", """
held AS (
  SELECT DISTINCT region_id, xs + 64 * i AS x0, ys + 64 * j AS y0, cell_id
  FROM cells JOIN starts USING (region_id), range(25) a(i), range(25) b(j)
  WHERE x BETWEEN xs + 64 * i AND xs + 64 * i + 128 AND y BETWEEN ys + 64 * j AND ys + 64 * j + 128)""", select="""
SELECT region_id, CAST(128 AS INT) AS patch_size, x0, y0, count(*) AS n_cells, x0 + 128 AS x1, y0 + 128 AS y1,
       (x0 + 64)::DOUBLE AS center_x, (y0 + 64)::DOUBLE AS center_y,
       concat_ws('-', x0, x0 + 128, y0, y0 + 128) AS patch_name
FROM held GROUP BY region_id, x0, y0 HAVING count(*) >= 5"""))
def random_windows(spark, sf_dir):
    members = windows.sliding_windows(b.cells(spark, sf_dir), repeats=2)
    return windows.describe_windows(members)


@query(with_parts(*BASE, o.windows("enriched"), o.means("window_members", "region_id, x0, y0", B, "avgs"), select="""
SELECT region_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, biomarker,
       round(value, 6) AS value FROM avgs"""))
def signal_average(spark, sf_dir):
    means = features.means_to_long(patches(spark, sf_dir), ["region_id", "x0", "y0"], B)
    return rounded(means, "value")


SELF = (*BASE, o.windows("enriched"), o.means("window_members", "region_id, x0, y0", B, "avgs"),
        o.scores("avgs", "avgs", "region_id, biomarker"))


def _scored_patches(spark, sf_dir):
    means = features.means_to_long(patches(spark, sf_dir), ["region_id", "x0", "y0"], B)
    return score_against(means, None, ["region_id", "biomarker"])


@query(with_parts(*SELF, select="""
SELECT region_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, biomarker, round(z, 6) AS z FROM scores"""))
def zscore(spark, sf_dir):
    return rounded(_scored_patches(spark, sf_dir).drop("value", "percentile"), "z")


@query(with_parts(*SELF, select="""
SELECT region_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, biomarker,
       round(percentile, 6) AS percentile FROM scores"""))
def percentile_of_score(spark, sf_dir):
    return rounded(_scored_patches(spark, sf_dir).drop("value", "z"), "percentile")


SUMMARY = (*TARGETS, o.windows("enriched"), o.means("window_members", "region_id, x0, y0", B, "refs"),
           o.means("roi_members", "region_id, roi_id", B, "tgts"),
           o.scores("refs", "tgts", "region_id, biomarker"), """
bm_summary AS (
  SELECT region_id, roi_id, biomarker, round(value, 6) AS value, round(z, 6) AS z,
         round(percentile, 6) AS percentile FROM scores WHERE z IS NOT NULL)""", """
bm_categories AS (
  SELECT *, CASE WHEN z > 1.5 OR percentile > 90 OR position <= 2 THEN 'high'
                 WHEN z < -1.5 OR percentile < 10 THEN 'low' ELSE 'moderate' END AS category
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY region_id, roi_id ORDER BY z DESC, biomarker)
                       AS INT) AS position FROM bm_summary))""", """
bm_sections AS (
  SELECT region_id, roi_id,
    string_agg('- **' || biomarker || '**: z ' || format('{:.1f}', z) || ', percentile ' ||
      format('{:.0f}', percentile), chr(10) ORDER BY position) FILTER (category = 'high') AS high,
    string_agg('- **' || biomarker || '**: z ' || format('{:.1f}', z) || ', percentile ' ||
      format('{:.0f}', percentile), chr(10) ORDER BY position DESC) FILTER (category = 'low') AS low,
    string_agg('**' || biomarker || '**', ', ' ORDER BY position) FILTER (category = 'moderate') AS other
  FROM bm_categories GROUP BY ALL)""", """
bm_texts AS (
  SELECT region_id, roi_id, concat_ws(chr(10) || chr(10),
    '**High biomarkers** (above most reference patches):' || chr(10) || high,
    '**Low biomarkers** (below most reference patches):' || chr(10) || low,
    '**Moderate biomarkers** (no clear trend):' || chr(10) || other) AS bm_text FROM bm_sections)""")


def summary_of_targets(spark, sf_dir):
    found = describe.biomarker_summary(
        targets(spark, sf_dir), patches(spark, sf_dir), b.ROI, B)
    return rounded(found, "value", "z", "percentile")


def categories_of_targets(spark, sf_dir):
    return describe.biomarker_categories(
        summary_of_targets(spark, sf_dir), b.ROI, percentile_threshold=90)


@query(with_parts(*SUMMARY, select="SELECT * FROM bm_summary"))
def bm_summary(spark, sf_dir):
    return summary_of_targets(spark, sf_dir)


@query(with_parts(*SUMMARY, select="SELECT region_id, roi_id, biomarker, position, category FROM bm_categories"))
def bm_categories(spark, sf_dir):
    return categories_of_targets(spark, sf_dir).select(*b.ROI, "biomarker", "position", "category")


@query(with_parts(*SUMMARY, select="SELECT * FROM bm_texts"))
def bm_text(spark, sf_dir):
    return describe.biomarker_text(categories_of_targets(spark, sf_dir), b.ROI)


TYPES = (*TARGETS, """
roi_shares AS (
  SELECT region_id, roi_id, cell_type, n, n / sum(n) OVER (PARTITION BY region_id, roi_id) AS share
  FROM (SELECT region_id, roi_id, cell_type, count(*) AS n FROM roi_members GROUP BY ALL))""", """
region_shares AS (
  SELECT region_id, cell_type, n / sum(n) OVER (PARTITION BY region_id) AS region_share
  FROM (SELECT region_id, cell_type, count(*) AS n FROM cells GROUP BY ALL))""", """
enrich AS (
  SELECT *, share / (region_share + 1e-5::DOUBLE) AS enrichment
  FROM roi_shares JOIN region_shares USING (region_id, cell_type))""",
    o.means("enriched", "region_id, cell_type", B, "levels"), """
signatures AS (
  SELECT * FROM (
    SELECT region_id, cell_type, biomarker,
      (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS level
    FROM levels WINDOW w AS (PARTITION BY region_id, biomarker)) WHERE level > 0.8)""", """
ct_summary AS (
  SELECT region_id, roi_id, cell_type, round(share * 100, 6) AS percent,
         round(enrichment, 6) AS enrichment, coalesce(signature, '') AS signature
  FROM enrich LEFT JOIN (
    SELECT region_id, cell_type, string_agg(biomarker, ',' ORDER BY biomarker) AS signature
    FROM signatures GROUP BY ALL) USING (region_id, cell_type))""", """
key_types AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY region_id, roi_id ORDER BY
              CASE WHEN by_share <= 3 THEN by_share ELSE 3 + by_enrichment END) AS INT) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY region_id, roi_id ORDER BY percent DESC, cell_type) AS by_share,
          row_number() OVER (PARTITION BY region_id, roi_id ORDER BY enrichment DESC, cell_type) AS by_enrichment
        FROM ct_summary)
  WHERE percent > 0.05 AND (by_share <= 3 OR (by_enrichment <= 3 AND enrichment > 1.5)))""", """
ct_texts AS (
  SELECT region_id, roi_id, '**Main cell types**:' || chr(10) || string_agg(
    position || '. **' || cell_type || '**: ' || format('{:.0f}', percent) || '% of the cells, ' ||
    format('{:.1f}', enrichment) || ' times the region''s share.' ||
    CASE WHEN signature <> '' THEN ' Marked by ' || replace(signature, ',', ', ') || '.' ELSE '' END,
    chr(10) ORDER BY position) AS ct_text
  FROM key_types GROUP BY ALL)""")


def types_of_targets(spark, sf_dir):
    found = describe.cell_type_summary(
        targets(spark, sf_dir), b.enriched(spark, sf_dir), b.ROI, B)
    return rounded(found, "percent", "enrichment")


def _joined_signature(df):
    return df.withColumn("signature", F.array_join("signature", ","))


@query(with_parts(*TYPES, select="SELECT region_id, roi_id, cell_type, n, round(share, 6) AS share FROM roi_shares"))
def cell_type_composition(spark, sf_dir):
    return rounded(features.composition(targets(spark, sf_dir), b.ROI), "share")


@query(with_parts(*TYPES, select="""
SELECT region_id, roi_id, cell_type, round(share, 6) AS share, round(region_share, 6) AS region_share,
       round(enrichment, 6) AS enrichment FROM enrich"""))
def cell_type_enrichment(spark, sf_dir):
    found = features.enrichment(targets(spark, sf_dir), b.cells(spark, sf_dir), b.ROI)
    return rounded(found.drop("n"), "share", "region_share", "enrichment")


@query(with_parts(o.CELLS.replace("o_orderpriority AS cell_type",
    "CASE WHEN o_orderkey % 7 <> 3 THEN o_orderpriority END AS cell_type"), o.ROIS, o.roi_members(), """
shares AS (
  SELECT region_id, roi_id, cell_type, n / sum(n) OVER (PARTITION BY region_id, roi_id) AS share
  FROM (SELECT region_id, roi_id, cell_type, count(*) AS n FROM roi_members GROUP BY ALL))""", """
typed AS (
  SELECT region_id, cell_type, n / sum(n) OVER (PARTITION BY region_id) AS region_share
  FROM (SELECT region_id, cell_type, count(*) AS n FROM cells WHERE cell_type IS NOT NULL GROUP BY ALL))""", select="""
SELECT region_id, roi_id, cell_type, round(share, 6) AS share, round(region_share, 6) AS region_share,
       round(share / (region_share + 1e-5::DOUBLE), 6) AS enrichment
FROM shares JOIN typed USING (region_id, cell_type)"""))
def cell_type_enrichment_untyped(spark, sf_dir):
    """A seventh of the cells has no type: they count in the group, not in the region."""
    cells = b.cells(spark, sf_dir).withColumn("cell_type", F.expr("CASE WHEN cell_id % 7 <> 3 THEN cell_type END"))
    found = features.enrichment(cells_in_rois(cells, b.rois(spark, sf_dir)), cells, b.ROI)
    return rounded(found.drop("n"), "share", "region_share", "enrichment")


@query(with_parts(*TYPES, select="""
SELECT region_id, cell_type, biomarker, round(level, 6) AS level FROM signatures"""))
def signature_biomarkers(spark, sf_dir):
    return rounded(features.signature_biomarkers(b.enriched(spark, sf_dir), B), "level")


@query(with_parts(*TYPES, select="SELECT * FROM ct_summary"))
def ct_summary(spark, sf_dir):
    return _joined_signature(types_of_targets(spark, sf_dir))


@query(with_parts(*TYPES, select="""
SELECT region_id, roi_id, cell_type, percent, enrichment, signature, position FROM key_types"""))
def key_cell_types(spark, sf_dir):
    return _joined_signature(describe.key_cell_types(types_of_targets(spark, sf_dir), b.ROI))


@query(with_parts(*TYPES, select="SELECT * FROM ct_texts"))
def ct_text(spark, sf_dir):
    chosen = describe.key_cell_types(types_of_targets(spark, sf_dir), b.ROI)
    return describe.cell_type_text(chosen, b.ROI)


@query(with_parts(*TARGETS, select="""
SELECT region_id, roi_id, cell_type, round(coalesce(n, 0) / sum(n) OVER (PARTITION BY region_id, roi_id), 6) AS share
FROM (SELECT DISTINCT region_id, roi_id FROM roi_members)
JOIN (SELECT DISTINCT region_id, cell_type FROM cells) USING (region_id)
LEFT JOIN (SELECT region_id, roi_id, cell_type, count(*) AS n FROM roi_members GROUP BY ALL)
  USING (region_id, roi_id, cell_type)"""))
def roi_type_vector(spark, sf_dir):
    vectors = features.type_vector(targets(spark, sf_dir), b.cells(spark, sf_dir), b.ROI)
    pairs = vectors.select(*b.ROI, F.explode(F.arrays_zip("types", "shares")).alias("p"))
    return pairs.select(*b.ROI, F.col("p.types").alias("cell_type"),
                        F.round("p.shares", 6).alias("share"))


@query(with_parts(*TARGETS, select="""
SELECT region_id, roi_id, round(atan2(avg(sin(orientation)), avg(cos(orientation))), 6) AS mean_orientation,
       round(1 - sqrt(avg(sin(orientation)) ** 2 + avg(cos(orientation)) ** 2), 6) AS circular_variance
FROM roi_members GROUP BY ALL"""))
def orientation_circular(spark, sf_dir):
    found = features.orientation(targets(spark, sf_dir), b.ROI)
    return rounded(found, "mean_orientation", "circular_variance")


@query(with_parts(*TARGETS, select="""
SELECT region_id, roi_id, round(avg(shape_circularity), 6) AS shape_circularity,
       round(avg(shape_eccentricity), 6) AS shape_eccentricity,
       round(avg(shape_solidity), 6) AS shape_solidity FROM roi_members GROUP BY ALL"""))
def shape_means(spark, sf_dir):
    shapes = list(describe.SHAPE_FEATURES)
    means = targets(spark, sf_dir).groupBy(*b.ROI).agg(*[F.avg(c).alias(c) for c in shapes])
    return rounded(means, *shapes)


DENSITY = (o.CELLS, """
density AS (
  SELECT a.region_id, a.cell_id, count(*) - 1 AS local_density
  FROM cells a JOIN cells b ON a.region_id = b.region_id
   AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4900
  GROUP BY ALL)""", """
knn AS (
  SELECT a.region_id, a.cell_id, avg(d) AS mean_k_neighbor_distance FROM (
    SELECT a.region_id, a.cell_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d,
      row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell_id) AS rn
    FROM cells a JOIN cells b ON a.region_id = b.region_id AND a.cell_id <> b.cell_id) a
  WHERE rn <= 3 GROUP BY ALL)""")


@query(with_parts(*DENSITY, select="SELECT * FROM density"))
def radius_density(spark, sf_dir):
    return spatial.radius_counts(b.cells(spark, sf_dir))


@query(with_parts(*DENSITY, select="""
SELECT region_id, cell_id, round(mean_k_neighbor_distance, 6) AS mean_k_neighbor_distance FROM knn"""))
def knn_distance(spark, sf_dir):
    return rounded(spatial.mean_neighbor_distance(b.cells(spark, sf_dir)), "mean_k_neighbor_distance")


S = list(describe.DENSITY_FEATURES)
SEG = (*DENSITY, """
measured AS (
  SELECT c.*, d.local_density, k.mean_k_neighbor_distance FROM cells c
  JOIN density d USING (region_id, cell_id) JOIN knn k USING (region_id, cell_id))""",
    o.ROIS, o.roi_members("measured"), o.windows("measured"),
    o.means("window_members", "region_id, x0, y0", S, "refs"),
    o.means("roi_members", "region_id, roi_id", S, "tgts"),
    o.scores("refs", "tgts", "region_id, biomarker"), """
seg_scores AS (
  SELECT region_id, roi_id, """ + ", ".join(
        f"round(max(CASE WHEN biomarker = '{f}' THEN {c} END), 6) AS {f}_{n}"
        for f in S for c, n in (("value", "val"), ("z", "z"), ("percentile", "pct"))) + """
  FROM scores WHERE z IS NOT NULL GROUP BY ALL)""", """
seg_shapes AS (
  SELECT region_id, roi_id, round(avg(shape_circularity), 6) AS shape_circularity,
       round(avg(shape_eccentricity), 6) AS shape_eccentricity,
       round(avg(shape_solidity), 6) AS shape_solidity,
       round(atan2(avg(sin(orientation)), avg(cos(orientation))), 6) AS mean_orientation,
       round(1 - sqrt(avg(sin(orientation)) ** 2 + avg(cos(orientation)) ** 2), 6) AS circular_variance
  FROM roi_members GROUP BY ALL)""", """
seg_summary AS (SELECT * FROM seg_shapes LEFT JOIN seg_scores USING (region_id, roi_id))""", """
seg_flags AS (
  SELECT *,
    CASE WHEN size_area_z <= -1 THEN 'smaller' WHEN size_area_z >= 1 THEN 'larger' ELSE 'typical' END AS size_note,
    CASE WHEN mean_k_neighbor_distance_z <= -1 THEN 'shorter'
         WHEN mean_k_neighbor_distance_z >= 1 THEN 'longer' ELSE 'typical' END AS spacing_note,
    CASE WHEN local_density_z <= -1 THEN 'sparser' WHEN local_density_z >= 1 THEN 'denser'
         ELSE 'typical' END AS density_note,
    CASE WHEN shape_circularity < 0.5 THEN 'elongated or irregular' ELSE 'none' END AS circularity_note,
    CASE WHEN shape_eccentricity > 0.7 THEN 'highly elongated' WHEN shape_eccentricity > 0.5
         THEN 'elongated' ELSE 'none' END AS eccentricity_note,
    CASE WHEN shape_solidity < 0.75 THEN 'irregular or concave' ELSE 'none' END AS solidity_note,
    CASE WHEN circular_variance < 0.3 THEN 'aligned' WHEN circular_variance > 0.7 THEN 'random'
         ELSE 'none' END AS orientation_note
  FROM seg_summary)""", """
seg_texts AS (
  SELECT region_id, roi_id, concat_ws(chr(10), '**Cell arrangement**:',
    'Mean cell area **' || format('{:.0f}', size_area_val * (0.3775::DOUBLE * 0.3775::DOUBLE)) || ' µm²**, percentile ' ||
      format('{:.0f}', size_area_pct) || ', z ' || format('{:.1f}', size_area_z) || '.' ||
      CASE size_note WHEN 'smaller' THEN ' These cells are smaller than most.'
                     WHEN 'larger' THEN ' These cells are larger than most.' ELSE '' END,
    'Mean distance to the 3 nearest cells **' || format('{:.0f}', mean_k_neighbor_distance_val * 0.3775::DOUBLE) ||
      ' µm**, percentile ' || format('{:.0f}', mean_k_neighbor_distance_pct) || ', z ' ||
      format('{:.1f}', mean_k_neighbor_distance_z) || '.' ||
      CASE spacing_note WHEN 'shorter' THEN ' These cells are closer together than most.'
                        WHEN 'longer' THEN ' These cells are further apart than most.' ELSE '' END,
    'Local density: percentile ' || format('{:.0f}', local_density_pct) || ', z ' ||
      format('{:.1f}', local_density_z) || '.' ||
      CASE density_note WHEN 'sparser' THEN ' These cells are more sparsely spread than most.'
                        WHEN 'denser' THEN ' These cells are more densely packed than most.' ELSE '' END,
    '**Cell shape**:',
    'Circularity **' || format('{:.2f}', shape_circularity) || '**' ||
      CASE WHEN circularity_note <> 'none' THEN ', ' || circularity_note ELSE '' END || '.',
    'Eccentricity **' || format('{:.2f}', shape_eccentricity) || '**' ||
      CASE WHEN eccentricity_note <> 'none' THEN ', ' || eccentricity_note ELSE '' END || '.',
    'Solidity **' || format('{:.2f}', shape_solidity) || '**' ||
      CASE WHEN solidity_note <> 'none' THEN ', ' || solidity_note ELSE '' END || '.',
    'Circular variance of the orientation **' || format('{:.2f}', circular_variance) || '**' ||
      CASE WHEN orientation_note <> 'none' THEN ', ' || orientation_note ELSE '' END || '.') AS seg_text
  FROM seg_flags)""")


def measured_cells(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    # Read twice below, as targets and as reference windows.
    return cells.join(cut_lineage(spatial.cell_densities(cells)), ["region_id", "cell_id"])


def segmentation_of_targets(spark, sf_dir, strict=True, drop=()):
    measured = measured_cells(spark, sf_dir).drop(*drop)
    found = describe.segmentation_summary(
        cells_in_rois(measured, b.rois(spark, sf_dir)),
        windows.window_averages(windows.sliding_windows(measured, origin=b.CORNER, keep=S), S), b.ROI, strict)
    return rounded(found, *[c for c in found.columns if c not in b.ROI])


@query(with_parts(*SEG, select="SELECT * FROM seg_summary"))
def seg_summary(spark, sf_dir):
    return segmentation_of_targets(spark, sf_dir)


@query(with_parts(*SEG, select="""
SELECT * EXCLUDE (shape_circularity, shape_solidity, mean_orientation, circular_variance) FROM seg_summary"""))
def seg_summary_optional(spark, sf_dir):
    missing = ["shape_circularity", "shape_solidity", "orientation"]
    return segmentation_of_targets(spark, sf_dir, strict=False, drop=missing)


NOTES = [f"{n}_note" for n in ("size", "spacing", "density", "circularity", "eccentricity",
                               "solidity", "orientation")]


@query(with_parts(*SEG, select=f"SELECT region_id, roi_id, {', '.join(NOTES)} FROM seg_flags"))
def seg_flags(spark, sf_dir):
    flags = describe.segmentation_flags(segmentation_of_targets(spark, sf_dir))
    return flags.select(*b.ROI, *NOTES)


@query(with_parts(*SEG, select="SELECT * FROM seg_texts"))
def seg_text(spark, sf_dir):
    flags = describe.segmentation_flags(segmentation_of_targets(spark, sf_dir))
    return describe.segmentation_text(flags, b.ROI)


@query(with_parts(*SEG, o.EXPRESSION, o.ENRICHED,
                  *[p.replace("roi_members", "type_members") for p in (o.roi_members("enriched"),)],
                  *[p.replace("window_members", "bm_windows").replace("window_all", "bm_window_all")
                    for p in (o.windows("enriched"),)],
                  o.means("bm_windows", "region_id, x0, y0", B, "bm_refs"),
                  o.means("type_members", "region_id, roi_id", B, "bm_tgts"),
                  o.scores("bm_refs", "bm_tgts", "region_id, biomarker", "bm_scores"),
                  *[p.replace("FROM scores", "FROM bm_scores") for p in SUMMARY[-4:]],
                  *[p.replace("roi_members", "type_members") for p in TYPES[len(TARGETS):]],
                  select="""
SELECT region_id, roi_id, bm_text, ct_text, seg_text FROM bm_texts
JOIN ct_texts USING (region_id, roi_id) JOIN seg_texts USING (region_id, roi_id)"""))
def encode_rois(spark, sf_dir):
    from .workflow import encode

    measured = measured_cells(spark, sf_dir).join(b.expression(spark, sf_dir), "cell_id", "left")
    return encode(measured, cells_in_rois(measured, b.rois(spark, sf_dir)), b.ROI, B, digits=6, origin=b.CORNER)
