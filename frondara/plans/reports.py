"""Reports of the evaluations as Markdown; they format a few rows of aggregates and read nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from frondara.plans import catalog_queries as cq, evaluation


def _cell(v: object) -> str:
    return "–" if v is None else f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


def section(title: str, df: DataFrame, order: Sequence[str] = ()) -> str:
    """A table of aggregates (a row for each stratum, never of data) under a heading."""
    rows = (df.orderBy(*order) if order else df).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(_cell, r)) + " |" for r in rows)])


def validation_report(spark: SparkSession, sf_dir: str) -> str:
    """The catalogue against its points: cohort, overlap by stratum, quarters of width, names that are synonyms."""
    return "\n\n".join([
        "# Catálogo y presencias", section("Especies con al menos diez puntos", cq.agg_cohort(spark, sf_dir)), section("Solapamiento por estrato", cq.agg_iou_strata(spark, sf_dir), ["endemic"]),
        section("Cuartos por amplitud", cq.agg_width_slices(spark, sf_dir), ["slice"]), section("Sinonimia", evaluation.agg_synonymy(spark, sf_dir)),
    ])


def retrieval_report(spark: SparkSession, sf_dir: str) -> str:
    """Parsed questions: the roll-up and each field."""
    return "\n\n".join(["# Preguntas", section("Total", evaluation.agg_retrieval_total(spark, sf_dir)), section("Campos", evaluation.agg_retrieval_fields(spark, sf_dir), ["field"])])


def grounding_report(spark: SparkSession, sf_dir: str) -> str:
    """Two sources of answers against the records, by stratum, and the largest gains."""
    return "\n\n".join(["# Respuestas", section("Por estrato", evaluation.agg_arms(spark, sf_dir), ["endemic"]), section("Mayores ganancias", evaluation.top_gains(spark, sf_dir)), section("Sustento textual", evaluation.agg_support(spark, sf_dir), ["audit"])])
