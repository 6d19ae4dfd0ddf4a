"""Batch run over the regions of one or more studies.

    spark-submit -m cytogrid --region_ids s1 s2 --meta_path 'data/*/metadata.yaml' \\
        --root_dir /shared/tables --mem_dir /shared/stages \\
        --backend mypackage.chat:Client --resume
"""

from __future__ import annotations

import argparse
import functools
import importlib
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.features import arcsinh_normalize
from .operators.filters import regions_of_studies
from .operators.morphology import cell_morphology
from .plans.workflow import StudyTables, Workflow
from .sources import chunked_images, metadata, tables

# Column names of the shape table in the workflow.
SHAPES = {
    "area": "size_area",
    "circularity": "shape_circularity",
    "eccentricity": "shape_eccentricity",
    "solidity": "shape_solidity",
}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cytogrid")
    parser.add_argument("--region_ids", nargs="+", required=True, help="study prefixes of region ids")
    parser.add_argument("--meta_path", required=True, help="metadata files, a path or a pattern")
    parser.add_argument("--root_dir", required=True, help="folder of the region tables and masks")
    parser.add_argument("--mem_dir", required=True, help="folder of the stage tables")
    parser.add_argument("--layout", default="measured", choices=["measured", "partitioned"])
    parser.add_argument("--backend", required=True, help="module:Class of the chat backend")
    parser.add_argument("--resume", action="store_true")
    return parser.parse_args(argv)


def load_tables(spark: SparkSession, args: argparse.Namespace) -> StudyTables:
    """Scans of the selected regions of the selected studies."""
    wanted = spark.createDataFrame([(p,) for p in args.region_ids], "study string")
    studies = metadata.read_studies(spark, args.meta_path)
    regions = regions_of_studies(metadata.regions_of(studies), wanted).select("region_id").distinct()

    def chosen(df: DataFrame) -> DataFrame:
        return df.join(regions, "region_id", "left_semi")

    # Every study has its own panel of biomarkers, and its own header.
    panels = {r["study_id"]: r["biomarkers"] for r in studies.select("study_id", "biomarkers").collect()}
    of_study: dict[str, list[str]] = {}
    for r in regions.collect():
        of_study.setdefault(r["region_id"].split("_")[0], []).append(r["region_id"])
    parts = [
        tables.read_expression(spark, args.root_dir, panels[study], args.layout, ids)
        for study, ids in sorted(of_study.items())
    ]
    expression = functools.reduce(DataFrame.unionByName, parts)
    biomarkers = sorted({m for study in of_study for m in panels[study]})
    ids = sorted(i for part in of_study.values() for i in part)
    masks = chunked_images.read_tiles(spark, args.root_dir, ids, [chunked_images.MASK])
    return StudyTables(
        cells=tables.read_cells(spark, args.root_dir, args.layout, ids),
        types=tables.read_cell_types(spark, args.root_dir, args.layout, ids),
        expression=arcsinh_normalize(expression),
        shapes=cell_morphology(chunked_images.mask_pixels(masks))
        .drop("major_axis", "minor_axis")
        .withColumnsRenamed(SHAPES),
        studies=studies,
        biomarkers=biomarkers,
    )


def load_backend(name: str):
    """The chat backend named ``module:Class``, made without arguments."""
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)()


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s",
                        stream=sys.stdout)
    args = arguments(argv)
    spark = SparkSession.builder.appName("cytogrid").getOrCreate()
    try:
        store = tables.StageStore(spark, args.mem_dir)
        Workflow(load_tables(spark, args), store, load_backend(args.backend), args.resume).run()
    except Exception:
        logging.exception("run failed")
        return 1
    logging.info("all stages finished")
    return 0


if __name__ == "__main__":
    sys.exit(main())
