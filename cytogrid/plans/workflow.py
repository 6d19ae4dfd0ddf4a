"""Compositions of the operators: encoding of groups, and the staged batch run."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import transcript
from ..functions.replies import relevance_score
from ..functions.skew import attach
from ..operators import agents, community, describe, filters, graph, spatial, windows
from ..session import broadcast_by_measure, cut_lineage
from ..sources.metadata import diagnoses_of, renames_of
from ..sources.tables import StageStore

log = logging.getLogger(__name__)

SAMPLE = ["region_id", "cluster", "component", "part"]
CLUSTER = ["region_id", "cluster"]


def encode(
    cells: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    biomarkers: Sequence[str],
    um_per_pixel: float = 0.3775,
    percentile_threshold: float = 90.0,
    n_key_cell_types: int = 3,
    digits: int | None = None,
    origin: tuple[int, int] | DataFrame | None = None,
) -> DataFrame:
    """The three texts of every target group; a text is empty where nothing is known of the group.

    ``cells`` carry position, type, expression, shape and density; ``targets`` are
    their members per group. ``digits`` rounds the statistics before they are
    categorised and written out.
    """
    columns = [*biomarkers, *describe.DENSITY_FEATURES]
    references = windows.window_averages(windows.sliding_windows(cells, origin=origin, keep=columns), columns)

    def tidy(df: DataFrame, *names: str) -> DataFrame:
        return df if digits is None else df.withColumns({c: F.round(c, digits) for c in names})

    summary = tidy(
        describe.biomarker_summary(targets, references, keys, biomarkers),
        "z", "percentile")
    marks = describe.biomarker_text(
        describe.biomarker_categories(summary, keys, percentile_threshold=percentile_threshold), keys)
    types = tidy(
        describe.cell_type_summary(targets, cells, keys, biomarkers), "percent", "enrichment")
    kinds = describe.cell_type_text(describe.key_cell_types(types, keys, n_key_cell_types), keys)
    shape = describe.segmentation_summary(targets, references, keys)
    shape = tidy(shape, *[c for c in shape.columns if c not in keys])
    forms = describe.segmentation_text(describe.segmentation_flags(shape), keys, um_per_pixel)
    every = targets.select(*keys).distinct()
    for part in (marks, kinds, forms):
        every = every.join(part, list(keys), "left")
    return every.select(*keys, *[F.coalesce(t, F.lit("")).alias(t) for t in ("bm_text", "ct_text", "seg_text")])


@dataclass
class StudyTables:
    """Inputs of a run, all regions of all studies in each table.

    ``cells``: region_id, cell_id, x, y. ``types``: region_id, cell_id, cell_type.
    ``expression``: long and normalised. ``shapes``: region_id, cell_id, orientation,
    size_area, shape_circularity, shape_eccentricity, shape_solidity. ``studies``: one
    row of metadata each.
    """

    cells: DataFrame
    types: DataFrame
    expression: DataFrame
    shapes: DataFrame
    studies: DataFrame
    biomarkers: Sequence[str]


def study_of(region: str = "region_id"):
    return F.split_part(region, F.lit("_"), F.lit(1))


def widen(expression: DataFrame, biomarkers: Sequence[str]) -> DataFrame:
    """Long expression to one column per biomarker."""
    return expression.groupBy("region_id", "cell_id").agg(
        *[F.max(F.when(F.col("biomarker") == m, F.col("value"))).alias(m) for m in biomarkers]
    )


def prepare(tables: StudyTables) -> DataFrame:
    """Every cell with type, expression, shape and density, written once for all stages."""
    broadcast_by_measure(tables.cells.sparkSession)
    key = ["region_id", "cell_id"]
    renamed = filters.rename_cell_types(
        tables.types.select(*key, "cell_type").withColumn("study", study_of()),
        renames_of(tables.studies),
    ).drop("study")
    return cut_lineage(
        tables.cells.select(*key, "x", "y")
        .join(renamed, key, "left")
        .join(widen(tables.expression, tables.biomarkers), key, "left")
        .join(tables.shapes, key, "left")
        .join(spatial.cell_densities(tables.cells), key, "left")
    )


def build_graph(prepared: DataFrame, biomarkers: Sequence[str], feature_knn: int = 4) -> DataFrame:
    """Spatial and feature edges of every region."""
    quoted = [F.col(f"`{m}`").alias(f"_f{i}") for i, m in enumerate(biomarkers)]
    features = prepared.select("region_id", "cell_id", *quoted)
    alike = spatial.feature_edges(features, [f"_f{i}" for i in range(len(biomarkers))], feature_knn)
    return cut_lineage(spatial.spatial_edges(prepared).unionByName(alike))


class Workflow:
    """The staged run: context, clusters, encoding, annotation, aggregation, scoring.

    Every stage is a table in the store. With ``resume`` stored contexts, clusters and
    replies are used again; regions already encoded are skipped in any case.
    """

    def __init__(
        self, tables: StudyTables, store: StageStore,
        backend: agents.ChatBackend, resume: bool = False, portions: int = 4,
    ):
        self.tables = tables
        self.store = store
        self.backend = backend
        self.resume = resume
        self.portions = portions
        self._answered: set[str] = set()

    def _stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        stored = self.store.load(name) if self.resume else None
        if stored is None:
            self.store.save(make(), name)
            stored = self.store.load(name)
        log.info("%s ready", name)
        return stored

    def _answer(self, name: str, todo: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Ask for rows without a stored answer and add the answers to the stage.

        Answers are stored after each of some portions, so a crash loses one portion at most.
        """
        for portion in range(self.portions):
            done = self.store.load(name) if self.resume or name in self._answered else None
            part = F.pmod(F.xxhash64(*keys), F.lit(self.portions)) == portion
            answered = agents.ask(agents.not_done(todo.where(part), done, keys), self.backend)
            self.store.save(answered, name, "overwrite" if done is None else "append")
            self._answered.add(name)
        log.info("%s ready", name)
        return self.store.load(name)

    def context(self) -> DataFrame:
        def make() -> DataFrame:
            studies = self.tables.studies.select(
                F.col("study_id").alias("study"),
                F.lower(F.array_join("tissue_types", ", ")).alias("tissue_types"),
                "major_phenotypes",
                F.array_join("biomarkers", ", ").alias("biomarker_list"),
                F.coalesce("background", F.lit("")).alias("background"),
            )
            values = {c: F.col(c) for c in studies.columns if c != "study"}
            curated = agents.curate_context(studies, values, self.backend, cut_lineage)
            return curated.select(
                "study", "tissue_types", "major_phenotypes", transcript(F.col("dialogue")).alias("context")
            )

        return self._stage("context", make)

    def clusters(self, prepared: DataFrame, edges: DataFrame) -> DataFrame:
        return self._stage("clusters", lambda: community.resolution_sweep(prepared, edges))

    def subsets(self, prepared: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
        """Members and texts of the sampled groups; regions encoded before, with or without samples, are kept."""
        done = self.store.load("subset_regions")
        fresh = cut_lineage(clusters if done is None else clusters.join(done, "region_id", "left_anti"))
        if not fresh.isEmpty():
            samples = cut_lineage(graph.cluster_samples(fresh, edges.where("kind = 'spatial'")))
            targets = samples.join(prepared.drop("cluster"), ["region_id", "cell_id"])
            regions = fresh.select("region_id").distinct()
            cells = prepared.join(regions, "region_id", "left_semi")
            texts = encode(cells, targets, SAMPLE, self.tables.biomarkers)
            self.store.commit({"subset_cells": samples, "subset_texts": texts, "subset_regions": regions}, "append")
        return self.store.load("subset_texts")

    def _with_context(self, rows: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
        return attach(rows.withColumn("study", study_of()), context, ["study"], keys)

    def annotate(self, texts: DataFrame, context: DataFrame) -> DataFrame:
        rows = self._with_context(texts, context, SAMPLE)
        values = {c: F.col(c) for c in ("tissue_types", "major_phenotypes", "context")}
        values |= {"bm_summary": F.col("bm_text"), "ct_summary": F.col("ct_text"),
                   "seg_summary": F.col("seg_text")}
        todo = rows.select(*SAMPLE, agents.annotator_dialogue(values).alias("dialogue"))
        return self._answer("annotations", todo, SAMPLE)

    def aggregate(self, annotations: DataFrame, context: DataFrame) -> DataFrame:
        """One answer per cluster: answers about parts are joined and asked about again."""
        values = {c: F.col(c) for c in ("tissue_types", "major_phenotypes", "context", "n_obs", "results")}
        texts = annotations.select(
            *CLUSTER, "reply", F.xxhash64("component", "part").alias("_order"), F.lit(1).alias("_n")
        )
        level = 0
        while True:
            joined = agents.aggregate_texts(texts, CLUSTER, "reply", "_order", weight="_n")
            rows = self._with_context(joined, context, [*CLUSTER, "part"])
            todo = cut_lineage(
                rows.select(*CLUSTER, "part", "n_parts", "n_obs", agents.aggregate_dialogue(values).alias("dialogue"))
            )
            final = self._answer("aggregates", todo.where("n_parts = 1"), CLUSTER)
            partial, level = todo.where("n_parts > 1"), level + 1
            if partial.isEmpty():
                return final
            replies = self._answer(f"aggregate_parts_{level}", partial, [*CLUSTER, "part"])
            texts = replies.select(*CLUSTER, "reply", F.col("part").alias("_order"), F.col("n_obs").alias("_n"))

    def score(self, annotations: DataFrame, context: DataFrame) -> DataFrame:
        diagnoses = diagnoses_of(self.tables.studies)
        rows = attach(self._with_context(annotations, context, SAMPLE), diagnoses, ["region_id"],
                      SAMPLE[1:], "left")
        values = {
            "tissue_types": F.col("tissue_types"),
            "major_phenotypes": F.col("major_phenotypes"),
            "user_input": F.get("dialogue", F.lit(2))["content"],
            "ai_output": F.col("reply"),
            "diagnosis": F.coalesce("diagnosis", "major_phenotypes"),
            "phenotype_desc": F.col("context"),
        }
        todo = rows.select(*SAMPLE, agents.pathology_dialogue(values).alias("dialogue"))
        scored = self._answer("pathology", todo, SAMPLE)
        return scored.withColumn("score", relevance_score(F.col("reply")))

    def run(self) -> dict[str, DataFrame]:
        context = self.context()
        prepared = prepare(self.tables)
        edges = build_graph(prepared, self.tables.biomarkers)
        clusters = self.clusters(prepared, edges)
        texts = self.subsets(prepared, edges, clusters)
        annotations = self.annotate(texts, context)
        return {
            "context": context,
            "clusters": clusters,
            "texts": texts,
            "annotations": annotations,
            "aggregates": self.aggregate(annotations, context),
            "pathology": self.score(annotations, context),
        }
