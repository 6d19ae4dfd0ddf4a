"""Image features, composites and shape features of masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images, morphology
from ..session import scratch_path
from ..sources import chunked_images
from . import bindings as b
from .registry import query, rounded, with_parts

PIXELS = """
pixels AS (
  SELECT vec_id AS tile_id, label AS channel, CAST(i // 8 AS INT) AS row, CAST(i % 8 AS INT) AS col,
         CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i))"""

# Ten by ten tiles make a region's image of 80 x 80 pixels, in two channels.
CANVAS = """
canvas AS (
  SELECT 'r' || (tile_id // 100) AS region_id, unnest(['dim', 'lit']) AS channel,
         CAST((tile_id % 100) // 10 * 8 + row AS INT) AS row, CAST(tile_id % 10 * 8 + col AS INT) AS col,
         unnest([value, 1.4::DOUBLE - value]) AS value FROM pixels)"""

FRAMES = """
frames AS (
  SELECT DISTINCT 'r' || (vec_id // 100) AS region_id, CAST(r AS INT) AS roi_id,
         CAST(35 * (r // 3) - 5.5::DOUBLE AS DOUBLE) AS x0, CAST(35 * (r // 3) + 40.5::DOUBLE AS DOUBLE) AS x1,
         CAST(35 * (r % 3) - 5.5::DOUBLE AS DOUBLE) AS y0, CAST(35 * (r % 3) + 40.5::DOUBLE AS DOUBLE) AS y1
  FROM embeddings, range(9) t(r))"""

BIN = "CASE WHEN {v} <= 248 THEN least(CAST({v} AS INT) // 8, 30) END"


def canvas(spark, sf_dir):
    placed = b.pixels(spark, sf_dir).select(
        F.expr("concat('r', tile_id div 100)").alias("region_id"),
        F.expr("CAST((tile_id % 100) div 10 * 8 + row AS INT)").alias("row"),
        F.expr("CAST(tile_id % 10 * 8 + col AS INT)").alias("col"),
        F.expr("explode(map('dim', value, 'lit', 1.4D - value))").alias("channel", "value"))
    return placed


def frames(spark, sf_dir):
    regions = b.table(spark, sf_dir, "embeddings").select(
        F.expr("concat('r', vec_id div 100)").alias("region_id")).distinct()
    return regions.select("region_id", F.expr("explode(sequence(0, 8))").alias("roi_id")).selectExpr(
        "region_id", "roi_id", "35 * (roi_id div 3) - 5.5D AS x0", "35 * (roi_id div 3) + 40.5D AS x1",
        "35 * (roi_id % 3) - 5.5D AS y0", "35 * (roi_id % 3) + 40.5D AS y1")


@query(with_parts(PIXELS, """
params AS (
  SELECT DISTINCT vec_id // 100 AS region_id, label AS channel,
         -0.1::DOUBLE * (1 + (label + vec_id // 100) % 3) AS low, 0.2::DOUBLE + 0.01::DOUBLE * label AS high,
         label % 4 <> 3 AS valid FROM embeddings)""", select="""
SELECT tile_id // 100 AS region_id, tile_id, channel, row, col,
       round(least(greatest((value - low) / (high - low), 0), 1), 6) AS value
FROM pixels p JOIN params USING (channel) WHERE valid AND region_id = tile_id // 100"""))
def image_normalize(spark, sf_dir):
    params = b.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 100").alias("region_id"), F.col("label").alias("channel"),
        F.expr("-0.1D * (1 + (label + vec_id div 100) % 3)").alias("low"),
        F.expr("0.2D + 0.01D * label").alias("high"), F.expr("label % 4 <> 3").alias("valid")).distinct()
    pixels = b.pixels(spark, sf_dir).withColumn("region_id", F.expr("tile_id div 100"))
    return rounded(images.normalize(pixels, params, ["tile_id", "row", "col"]), "value")


@query(with_parts(PIXELS, select="""
SELECT tile_id, channel, round(avg(value), 6) AS average FROM pixels GROUP BY ALL"""))
def img_average(spark, sf_dir):
    return rounded(images.average(b.pixels(spark, sf_dir), ["tile_id", "channel"]), "average")


@query(with_parts(PIXELS, select="""
SELECT tile_id, channel, round(quantile_cont(value, 0.5), 6) AS median FROM pixels GROUP BY ALL"""))
def img_median(spark, sf_dir):
    return rounded(images.median(b.pixels(spark, sf_dir), ["tile_id", "channel"]), "median")


@query(with_parts(PIXELS, select="""
SELECT tile_id, channel, list(round(value, 6) ORDER BY row, col) AS raw FROM pixels GROUP BY ALL"""))
def img_raw(spark, sf_dir):
    raw = images.flatten_image(b.pixels(spark, sf_dir), ["tile_id", "channel"])
    return raw.withColumn("raw", F.transform("raw", lambda v: F.round(v, 6)))


@query(with_parts(PIXELS, f"""
levels AS (SELECT *, floor(least(greatest(value, 0), 1) * 255) AS v FROM pixels)""", select=f"""
SELECT tile_id, channel, CAST(bin AS INT) AS bin, round(coalesce(n, 0) / total, 6) AS share
FROM (SELECT tile_id, channel, count(*) AS total FROM levels GROUP BY ALL) CROSS JOIN range(31) t(bin)
LEFT JOIN (SELECT tile_id, channel, {BIN.format(v='v')} AS bin, count(*) AS n FROM levels GROUP BY ALL)
  USING (tile_id, channel, bin)"""))
def img_histogram(spark, sf_dir):
    bins = images.histogram(b.pixels(spark, sf_dir), ["tile_id", "channel"])
    return bins.select("tile_id", "channel", F.posexplode("histogram").alias("bin", "share")).withColumn(
        "share", F.round("share", 6))


@query(with_parts(PIXELS, """
levels AS (SELECT *, least(greatest(CAST(trunc(value * 600) AS BIGINT) + 100, 0), 255) AS v FROM pixels)""", select=f"""
SELECT tile_id, channel, CAST(bin AS INT) AS bin, round(coalesce(n, 0) / total, 6) AS share
FROM (SELECT tile_id, channel, count(*) AS total FROM levels GROUP BY ALL) CROSS JOIN range(31) t(bin)
LEFT JOIN (SELECT tile_id, channel, {BIN.format(v='v')} AS bin, count(*) AS n FROM levels GROUP BY ALL)
  USING (tile_id, channel, bin)"""))
def img_histogram_integer(spark, sf_dir):
    whole = b.pixels(spark, sf_dir).withColumn("value", F.expr("CAST(value * 600 AS BIGINT) + 100"))
    bins = images.histogram(whole, ["tile_id", "channel"])
    return bins.select("tile_id", "channel", F.posexplode("histogram").alias("bin", "share")).withColumn(
        "share", F.round("share", 6))


@query(with_parts(PIXELS, CANVAS, FRAMES, """
framed AS (
  SELECT f.region_id, f.roi_id, c.channel, floor(least(greatest(value, 0), 1) * 255) AS v
  FROM canvas c JOIN frames f ON c.region_id = f.region_id
   AND c.col >= trunc(greatest(x0, 0)) AND c.col < trunc(x1) AND c.row >= trunc(greatest(y0, 0)) AND c.row < trunc(y1))""",
    select=f"""
SELECT region_id, roi_id, CAST(CASE channel WHEN 'dim' THEN 0 ELSE 31 END + bin AS INT) AS dim,
       round(coalesce(n, 0) / total, 9) AS value
FROM (SELECT region_id, roi_id, channel, count(*) AS total FROM framed GROUP BY ALL) CROSS JOIN range(31) t(bin)
LEFT JOIN (SELECT region_id, roi_id, channel, {BIN.format(v='v')} AS bin, count(*) AS n FROM framed GROUP BY ALL)
  USING (region_id, roi_id, channel, bin)"""))
def roi_image_feature(spark, sf_dir):
    found = images.roi_features(canvas(spark, sf_dir), frames(spark, sf_dir))
    return found.select("region_id", "roi_id", F.posexplode("features").alias("dim", "value")).withColumn(
        "value", F.round("value", 9))


@query(with_parts(PIXELS, CANVAS, """
mixed AS (
  SELECT region_id, row, col, sum(CASE channel WHEN 'dim' THEN 2 * value ELSE 0 END) AS red,
         sum(CASE channel WHEN 'lit' THEN value ELSE 0 END) AS green, 0.0::DOUBLE AS blue
  FROM canvas GROUP BY region_id, row, col)""", """
tops AS (
  SELECT region_id, quantile_cont(v, 0.95) AS top
  FROM (SELECT region_id, unnest([red, green, blue]) AS v FROM mixed) GROUP BY ALL)""", select="""
SELECT region_id, row, col, round(red / CASE WHEN top > 1 THEN top ELSE 1 END, 6) AS red,
       round(green / CASE WHEN top > 1 THEN top ELSE 1 END, 6) AS green,
       round(blue / CASE WHEN top > 1 THEN top ELSE 1 END, 6) AS blue FROM mixed JOIN tops USING (region_id)"""))
def rgb_composite(spark, sf_dir):
    mixed = images.rgb_composite(canvas(spark, sf_dir), ["dim", "lit"], [2.0, 1.0])
    return rounded(mixed, "red", "green", "blue")


@query(with_parts(PIXELS, CANVAS, select="""
SELECT region_id, channel, row::BIGINT AS row, col::BIGINT AS col, value FROM canvas WHERE channel = 'lit'"""))
def scan_image(spark, sf_dir):
    """Images written as chunk files, then one channel of every region read from these."""
    root = scratch_path(spark, "images")
    chunked_images.write_image(canvas(spark, sf_dir), root, chunk=(32, 48), fill=-1.0)
    return chunked_images.to_pixels(chunked_images.channel_tiles(chunked_images.read_tiles(spark, root, channels=["lit"])))


MASK = (PIXELS, """
mask AS (SELECT channel AS region_id, tile_id + 1 AS label, row, col FROM pixels WHERE value > 0)""")

MOMENTS = """
moments AS (
  SELECT region_id, label, count(*) AS area, avg(row) AS centroid_x, avg(col) AS centroid_y,
    count(*) / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)) AS extent,
    var_pop(row) AS rr, var_pop(col) AS cc, covar_pop(row, col) AS rc FROM mask GROUP BY ALL)"""
ELLIPSE = """
ellipse AS (
  SELECT *, (rr + cc) / 2 + sqrt(rc * rc + (rr - cc) * (rr - cc) / 4) AS l1,
    greatest((rr + cc) / 2 - sqrt(rc * rc + (rr - cc) * (rr - cc) / 4), 0) AS l2,
    CASE WHEN rr = cc THEN CASE WHEN rc > 0 THEN pi() / 4 ELSE -pi() / 4 END
         ELSE atan2(2 * rc, rr - cc) / 2 END AS orientation FROM moments)"""
PERIMETER = """
border AS (
  SELECT * FROM mask m WHERE (
    SELECT count(*) FROM mask n WHERE n.region_id = m.region_id AND n.label = m.label
     AND abs(n.row - m.row) + abs(n.col - m.col) = 1) < 4),
codes AS (
  SELECT m.region_id, m.label, m.row, m.col, sum(CASE abs(n.row - m.row) + abs(n.col - m.col)
    WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code
  FROM border m JOIN border n ON n.region_id = m.region_id AND n.label = m.label
   AND abs(n.row - m.row) <= 1 AND abs(n.col - m.col) <= 1 GROUP BY ALL),
perimeters AS (
  SELECT region_id, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1
    WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter
  FROM codes GROUP BY ALL)"""
HULL = """
corners AS (
  SELECT DISTINCT region_id, label, 2 * row + unnest([0, 0, 1, -1]) AS r, 2 * col + unnest([1, -1, 0, 0]) AS c FROM mask),
spans AS (
  SELECT t.region_id, t.label, t.r,
    min(CASE WHEN q.r = p.r THEN CAST(least(p.c, q.c) AS DOUBLE)
             ELSE p.c + (q.c - p.c) * (t.r - p.r) / (q.r - p.r) END) AS low,
    max(CASE WHEN q.r = p.r THEN CAST(greatest(p.c, q.c) AS DOUBLE)
             ELSE p.c + (q.c - p.c) * (t.r - p.r) / (q.r - p.r) END) AS high
  FROM (SELECT DISTINCT region_id, label, 2 * i AS r FROM (
          SELECT region_id, label, min(row) AS a, max(row) AS b FROM mask GROUP BY ALL), range(8) t(i)
        WHERE i BETWEEN a AND b) t
  JOIN corners p ON p.region_id = t.region_id AND p.label = t.label AND p.r <= t.r
  JOIN corners q ON q.region_id = t.region_id AND q.label = t.label AND q.r >= t.r
  GROUP BY ALL),
hulls AS (
  SELECT region_id, label, CAST(sum(floor(high / 2 + 1e-9) - ceil(low / 2 - 1e-9) + 1) AS BIGINT) AS area_convex
  FROM spans GROUP BY ALL)"""
# Background flooded from a frame around the tile, corners connect.
FILLED = """
flood(region_id, label, row, col) AS (
  SELECT DISTINCT region_id, label, CAST(-1 AS INT), CAST(-1 AS INT) FROM mask
  UNION
  SELECT f.region_id, f.label, CAST(f.row + dr AS INT), CAST(f.col + dc AS INT)
  FROM flood f, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) c(dc)
  WHERE f.row + dr BETWEEN -1 AND 8 AND f.col + dc BETWEEN -1 AND 8
    AND NOT EXISTS (SELECT 1 FROM mask m WHERE m.region_id = f.region_id AND m.label = f.label
                    AND m.row = f.row + dr AND m.col = f.col + dc)),
filled AS (SELECT region_id, label, 100 - count(*) AS area_filled FROM flood GROUP BY ALL)"""

SHAPES = """
SELECT region_id, label, area, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y,
  round(extent, 6) AS extent, round(orientation, 6) AS orientation, round(4 * sqrt(l1), 6) AS major_axis,
  round(4 * sqrt(l2), 6) AS minor_axis,
  round(CASE WHEN l1 > 0 THEN sqrt(greatest(1 - l2 / l1, 0)) ELSE 0 END, 6) AS eccentricity,
  round(CASE WHEN l1 > 0 THEN sqrt(l2) / sqrt(l1) ELSE 1 END, 6) AS axis_ratio,
  round(perimeter, 6) AS perimeter, area_convex, area_filled,
  round(CASE WHEN perimeter > 0 THEN 4 * pi() * area / perimeter ** 2 ELSE 0 END, 6) AS circularity,
  round(area / area_convex, 6) AS solidity
FROM ellipse JOIN perimeters USING (region_id, label) JOIN hulls USING (region_id, label)
JOIN filled USING (region_id, label)"""


def mask(spark, sf_dir):
    return b.pixels(spark, sf_dir).where("value > 0").select(
        F.col("channel").alias("region_id"), (F.col("tile_id") + 1).alias("label"), "row", "col")


@query(with_parts(*MASK, MOMENTS, ELLIPSE, PERIMETER, HULL, FILLED, select=SHAPES, recursive=True))
def morphology_from_mask(spark, sf_dir):
    found = morphology.shape_features(mask(spark, sf_dir))
    exact = ("region_id", "label", "area", "area_convex", "area_filled")
    return rounded(found, *[c for c in found.columns if c not in exact])


@query(with_parts(*MASK, MOMENTS, ELLIPSE, PERIMETER, HULL, FILLED, select=SHAPES, recursive=True))
def morphology_from_files(spark, sf_dir):
    """Shapes of masks written as chunk files, 32 tiles side by side; chunks cut through the objects."""
    placed = mask(spark, sf_dir).selectExpr(
        "concat('m', region_id) AS region_id", "'seg_mask' AS channel", "(label - 1) div 32 * 8 + row AS row",
        "(label - 1) % 32 * 8 + col AS col", "CAST(label AS DOUBLE) AS value")
    root = scratch_path(spark, "masks")
    chunked_images.write_image(placed, root, chunk=(60, 100), dtype="<i4", separator="/")
    tiles = chunked_images.read_tiles(spark, root, channels=[chunked_images.MASK])
    found = morphology.shape_features(chunked_images.mask_pixels(tiles)).withColumns({
        "region_id": F.expr("CAST(substr(region_id, 2) AS INT)"),
        "centroid_x": F.expr("centroid_x - (label - 1) div 32 * 8"),
        "centroid_y": F.expr("centroid_y - (label - 1) % 32 * 8")})
    exact = ("region_id", "label", "area", "area_convex", "area_filled")
    return rounded(found, *[c for c in found.columns if c not in exact])
