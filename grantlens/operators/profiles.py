"""Applicant profiles from raw slots and from form input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grantlens.functions import categories as C
from grantlens.functions.text import blank_to_null


def _get(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _tri_state(text: Column) -> Column:
    word = F.lower(F.trim(text.cast("string")))
    return F.when(word.isin("yes", "true"), True).when(word.isin("no", "false"), False)


def standardize_profiles(df: DataFrame, key: str = "applicant_id") -> DataFrame:
    """Unified profile: nothing is assumed that was not given; unanswered flags stay NULL."""
    text = lambda c: blank_to_null(_get(df, c))
    flag = lambda c: _get(df, c, "boolean").cast("boolean")
    course = F.coalesce(text("course"), C.to_course(F.coalesce(text("level"), F.lit(""))))
    gender = C.to_gender(text("gender"))
    district = F.when(text("district") != "All", text("district"))
    return df.select(
        F.col(key),
        F.coalesce(text("student_name"), text("name")).alias("student_name"),
        F.coalesce(text("parent_name"), text("father_name")).alias("parent_name"),
        C.to_category(F.coalesce(text("category"), text("community"))).alias("category"),
        C.to_community(F.coalesce(text("community"), text("category"))).alias("community"),
        F.when(course != "All", course).alias("course"),
        F.coalesce(text("level"), C.to_level(text("course"))).alias("level"),
        F.when(text("gender").isNotNull() & (gender != "All"), gender).alias("gender"),
        F.when(text("state").isNotNull(), C.to_state(text("state"))).when(district.isNotNull(), "Tamil Nadu").alias("state"),
        district.alias("district"),
        _get(df, "income", "bigint").cast("bigint").alias("income"),
        flag("disabled").alias("disabled"),
        _get(df, "disability_percent", "int").cast("int").alias("disability_percent"),
        flag("govt_school").alias("govt_school"),
        flag("agri_labor").alias("agri_labor"),
        _tri_state(_get(df, "armed_forces")).alias("armed_forces"),
        _tri_state(_get(df, "first_graduate")).alias("first_graduate"),
        F.when(_get(df, "quota_type").isin("government", "management"), _get(df, "quota_type")).otherwise("unknown").alias("quota_type"),
        F.when(_get(df, "income_applicant") == "parent", "parent").otherwise("student").alias("income_applicant"),
    )


def form_defaults(df: DataFrame, key: str = "applicant_id") -> DataFrame:
    """The form's own defaulting policy, which differs from `standardize_profiles`."""
    text = lambda c: blank_to_null(_get(df, c))
    return df.select(
        F.col(key),
        F.coalesce(text("student_name"), text("name")).alias("student_name"),
        F.coalesce(text("parent_name"), text("father_name")).alias("parent_name"),
        F.coalesce(text("income_applicant"), F.lit("student")).alias("income_applicant"),
        F.when(_get(df, "quota_type").isin("government", "management"), _get(df, "quota_type")).otherwise("unknown").alias("quota_type"),
        _get(df, "first_graduate", "boolean").cast("boolean").alias("first_graduate"),
        text("community").alias("community"),
        F.coalesce(text("category"), text("community")).alias("category"),
        _get(df, "income").cast("string").try_cast("bigint").alias("income"),
        text("course").alias("course"),
        F.coalesce(text("gender"), F.lit("All")).alias("gender"),
        F.coalesce(text("state"), F.lit("Tamil Nadu")).alias("state"),
        F.coalesce(text("district"), F.lit("All")).alias("district"),
        F.coalesce(text("armed_forces"), F.lit("no")).alias("armed_forces"),
    )
