"""Catalogues and the question corpus as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grantlens.rules import corpus as Q
from grantlens.rules.metadata import checklist_rows, metadata_rows
from grantlens.rules.relations import frame
from grantlens.rules.schemes import MINORITY_COMMUNITIES, PORTAL_ROWS, STATE_ROWS, catalogue_a, catalogue_b

CATALOGUE_A_TYPES = {
    "ord": "int", "id": "string", "name": "string", "category": "string", "state": "string", "district": "string",
    "course": "string", "gender": "string", "income_limit": "bigint", "amount": "string", "last_date": "string",
    "official_portal": "string", "documents": "array<string>", "requires_govt_quota": "boolean",
    "requires_disability": "boolean", "requires_govt_school": "boolean", "requires_agri_labor": "boolean",
    "requires_first_graduate": "boolean", "requires_armed_forces": "boolean",
}
CATALOGUE_B_TYPES = {
    "ord": "int", "id": "string", "name": "string", "portal": "string", "communities": "array<string>", "max_income": "bigint",
    "courses": "array<string>", "amount_type": "string", "amount_min": "int", "amount_max": "int", "amount_ug": "int",
    "amount_pg": "int", "amount_boys": "int", "amount_girls": "int", "special_condition": "string",
    "required_documents": "array<string>",
}
METADATA_TYPES = {
    "id": "string", "portal": "string", "scope": "string", "jurisdiction": "string", "academic_year": "string",
    "level": "string", "rule_status": "string", "disability_rule": "string", "minimum_disability_percentage": "int",
    "domicile_rule": "string", "renewal_conditions": "string", "source_url": "string",
}
CHECKLIST_TYPES = {"id": "string", "item_ord": "int", "kind": "string", "label": "string", "purpose": "string"}


def scheme_catalogue(spark: SparkSession) -> DataFrame:
    """The three parts of the first catalogue in list order."""
    rows = catalogue_a()
    cuts = (0, len(STATE_ROWS), len(STATE_ROWS) + len(PORTAL_ROWS), len(rows))
    parts = [frame(spark, rows[a:b], CATALOGUE_A_TYPES) for a, b in zip(cuts, cuts[1:], strict=False)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def scheme_catalogue_b(spark: SparkSession) -> DataFrame:
    return frame(spark, catalogue_b(), CATALOGUE_B_TYPES)


def accepted_communities() -> list[dict]:
    """(scheme id, accepted community) rows of the second catalogue."""
    out = []
    for row in catalogue_b():
        accepted = list(row["communities"]) + (MINORITY_COMMUNITIES if "MIN" in row["communities"] else [])
        out += [{**row, "community": c} for c in accepted]
    return out


def scheme_metadata(spark: SparkSession) -> DataFrame:
    return frame(spark, metadata_rows(), METADATA_TYPES)


def scheme_checklists(spark: SparkSession) -> DataFrame:
    return frame(spark, checklist_rows(), CHECKLIST_TYPES)


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def generated_questions(spark: SparkSession) -> DataFrame:
    """The templated matrix. Every id is the ordinal of its (state, category, course, topic)."""
    topics, courses, categories = len(Q.TOPICS), len(Q.COURSES), len(Q.CATEGORIES)
    n = spark.range(len(Q.STATES) * categories * courses * topics)
    i = F.col("id")
    parts = n.select(
        (i + Q.FIRST_GENERATED_ID).cast("int").alias("id"),
        _pick(Q.TOPICS, i % topics).alias("topic"),
        _pick(Q.COURSES, F.floor(i / topics) % courses).alias("course"),
        _pick(Q.CATEGORIES, F.floor(i / (topics * courses)) % categories).alias("category"),
        _pick(Q.STATES, F.floor(i / (topics * courses * categories))).alias("state"),
    )
    question = F.concat_ws(" ", "topic", F.lower("state"), F.lower("category"), F.lower("course"), F.lit("scholarship"))
    return parts.select("id", question.alias("question"), "category", "state", "course")


def hand_written_questions(spark: SparkSession) -> DataFrame:
    rows = [dict(zip(("id", "question", "category", "state"), r, strict=True)) for r in Q.HAND_WRITTEN]
    return frame(spark, rows, {"id": "int", "question": "string", "category": "string", "state": "string", "course": "string"})


def question_corpus(spark: SparkSession) -> DataFrame:
    """22 hand-written and 4,536 templated questions."""
    return hand_written_questions(spark).unionByName(generated_questions(spark))


