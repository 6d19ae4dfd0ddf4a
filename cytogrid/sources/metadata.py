"""Study metadata: YAML files to one row per study."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = ("study_id", "root_dir", "major_phenotypes", "background")
_LISTS = ("tissue_types", "biomarkers", "functional_biomarkers", "selected_acq_ids")
_MAPS = ("diagnosis_dict", "cell_type_rename")
SCHEMA = ", ".join(
    [f"{c} string" for c in _TEXTS]
    + [f"{c} array<string>" for c in _LISTS]
    + [f"{c} map<string,string>" for c in _MAPS]
)


def _row(text: str) -> dict:
    given = yaml.safe_load(text) or {}
    row = {c: None if given.get(c) is None else str(given[c]) for c in _TEXTS}
    row |= {c: [str(v) for v in given.get(c) or []] for c in _LISTS}
    row |= {c: {str(k): str(v) for k, v in (given.get(c) or {}).items()} for c in _MAPS}
    return row


def read_studies(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per metadata file; dictionaries become maps."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_row(t) for t in batch["value"]])

    return spark.read.text(paths, wholetext=True).mapInPandas(parse, SCHEMA)


def renames_of(studies: DataFrame) -> DataFrame:
    """Cell type renames as rows."""
    return studies.select(
        F.col("study_id").alias("study"), F.explode("cell_type_rename").alias("old_type", "new_type")
    )


def diagnoses_of(studies: DataFrame) -> DataFrame:
    """Diagnosis of each region as rows."""
    return studies.select(F.explode("diagnosis_dict").alias("region_id", "diagnosis"))


def regions_of(studies: DataFrame) -> DataFrame:
    return studies.select(F.explode("selected_acq_ids").alias("region_id"))
