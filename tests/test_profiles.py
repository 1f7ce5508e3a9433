"""Profiles, matrices and parent checks of single cases: expected values are written out."""

import datetime

import pytest
from pyspark.sql import functions as F, types as T

from grantlens.operators import identity as I, readiness as R

TEXT = ("aadhaar_name", "tenth_name", "twelfth_name", "community_holder", "income_name", "bank_holder", "bonafide_name", "aadhaar_dob", "tenth_dob", "twelfth_dob", "community_category", "community_name",
        "category", "tenth_percentage", "twelfth_percentage", "community_father", "income_father", "twelfth_father", "tenth_father", "community_state", "income_state", "community_district", "income_district",
        "gender", "aadhaar_gender", "tenth_year", "twelfth_year", "tenth_board", "twelfth_board", "tenth_register_number", "twelfth_register_number", "doc_course", "course", "doc_institution", "institution",
        "community_issue_date", "income_year", "income_applicant", "parent_name", "father_name", "mother_name", "student_name", "income_cert_number", "income_issue_date", "ifsc", "account_type", "state", "doc_state", "district",
        "doc_district", "domicile")
NUMBERS = ("tenth_conf", "twelfth_conf", "community_conf", "income_conf", "tenth_scored", "tenth_maximum", "twelfth_scored", "twelfth_maximum", "income_value", "income", "disability_percentage")
FLAGS = ("first_graduate", "first_graduate_cert", "aadhaar_bank_linked")
SCHEMA = T.StructType([T.StructField("case_id", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in TEXT] + [T.StructField(c, T.IntegerType()) for c in NUMBERS] + [T.StructField(c, T.BooleanType()) for c in FLAGS])


def case(spark, **values):
    return spark.createDataFrame([{"case_id": 1, **values}], SCHEMA)


def profile(spark, **values):
    return {r.field: (r.value, r.source, r.confidence, r.status) for r in R.profile_from_documents(case(spark, **values)).collect()}


def test_nothing_known(spark):
    assert profile(spark) == {"course": (None, None, 0, "missing"), "current_year": (None, None, 0, "missing"), "state": ("Tamil Nadu", "default", None, None)}
    assert "state" not in {r.field for r in R.profile_from_documents(case(spark), default_state=None).collect()}


def test_sources_of_names_and_dates(spark):
    names = [("aadhaar_name", "identity", 100, "high"), ("tenth_name", "ms10", 90, "high"), ("twelfth_name", "ms12", 90, "high"), ("community_holder", "community", 90, "high"), ("income_name", "income", 90, "high"), ("bank_holder", "bank", 95, "high")]
    for i, (column, source, confidence, status) in enumerate(names):
        later = {c: "Other" for c, *_ in names[i + 1:]}
        assert profile(spark, **{column: "Divya S", **later}, **{c: " " for c, *_ in names[:i]})["name"] == ("Divya S", source, confidence, status)
    got = profile(spark, twelfth_dob="01-02-2006", twelfth_conf=65, tenth_dob="")
    assert got["dob"] == ("01-02-2006", "ms12", 65, "confirm")


def test_untrusted_values_are_left_out_but_marks_stay(spark):
    got = profile(spark, tenth_name="Divya", tenth_conf=49, tenth_scored=349, tenth_maximum=500, community_category="Scheduled Caste", community_conf=40, category="BC", income_value=72000, income_conf=50)
    assert got["name"] == (None, "ms10", 49, "untrusted") and got["community"][0] is None and got["community"][1] == "community"
    assert got["marks10"] == ("70%", "ms10", 49, "untrusted")
    assert got["income"] == ("72000", "income", 50, "confirm")


@pytest.mark.parametrize("percentage, scored, maximum, want", [
    ("69.80%", 1, 2, "69.8%"), ("81", None, None, "81%"), ("pass", 400, 500, None), ("", 400, 600, "67%"), (None, 400, 0, None), (None, 500, 500, "100%"), (None, None, 500, None)])
def test_marks(spark, percentage, scored, maximum, want):
    assert profile(spark, twelfth_percentage=percentage, twelfth_scored=scored, twelfth_maximum=maximum).get("marks12", (None,))[0] == want


def test_entered_income_and_category(spark):
    got = profile(spark, income_value=0, income=0, category="MBC", income_father="Selvam", tenth_father="Other", income_district="Theni")
    assert got["income"] == ("0", "entered", 100, "high") and got["community"] == ("MBC", "entered", 100, "high")
    assert got["parent_name"] == ("Selvam", "income", None, None) and got["district"] == ("Theni", "income", None, None)


def test_warnings(spark):
    rows = spark.createDataFrame([(1, "red", "red", "MISMATCH", "MISMATCH"), (2, "yellow", "green", "EXPIRED", "WARNING"), (3, "green", "grey", "MATCH", "MATCH"), (4, None, None, None, None)],
                                 "case_id int, name_status string, dob_status string, income_status string, community_status string")
    got = {(r.case_id, r.severity, r.field) for r in R.profile_warnings(rows).collect()}
    assert got == {(1, "danger", "name"), (1, "danger", "dob"), (1, "warning", "income"), (1, "warning", "community"), (2, "warning", "name")}


def matrix(spark, **values):
    return R.document_matrix(case(spark, **values), F.lit(datetime.date(2026, 6, 1))).first()


def test_matrix(spark):
    r = matrix(spark, gender="Female", aadhaar_gender="FEMALE", tenth_scored=349, twelfth_scored=450, tenth_board="CBSE", twelfth_board="", community_issue_date="01-01-2020", income_issue_date="01-01-2026",
               ifsc="SBIN0001234", state="Tamil Nadu", doc_district="Salem", first_graduate_cert=True)
    assert (r.gender_consistency, r.scored, r.board, r.first_graduate_source) == ("MATCH", "450", "CBSE", "certificate")
    assert (r.community_expired, r.community_months_old, r.income_expired, r.income_months_old) == (True, 77, False, 5)
    assert (r.account_type, r.ifsc_valid, r.domicile, r.district, r.income_provider) == ("Savings", True, "Tamil Nadu", "Salem", "Student")
    assert matrix(spark, gender="Male", aadhaar_gender="Female").gender_consistency == "MISMATCH"
    assert matrix(spark, gender="Male").gender_consistency == "UNCONFIRMED"
    assert matrix(spark, community_issue_date="01-07-2021").community_expired is False
    assert matrix(spark).community_expired is False


@pytest.mark.parametrize("values, want", [
    (dict(income_applicant="student", parent_name="Murugan K", income_name="Other"), ("CHECKED", False, None, False)),
    (dict(income_applicant="parent", parent_name="Murugan K", income_name="MURUGAN K"), ("SKIPPED", True, "EXACT_MATCH", True)),
    (dict(income_applicant="parent", father_name="Thiru. Murugan K", mother_name="Kamala", income_name="MURUGAN K"), ("SKIPPED", True, "EXACT_MATCH", True)),
    (dict(income_applicant="parent", parent_name="Murugan K", income_name="Divya"), ("SKIPPED", True, "MISMATCH", False)),
    (dict(income_applicant="parent", parent_name="Murugan K", income_name=" "), ("SKIPPED", True, None, False)),
    (dict(income_applicant="parent", parent_name="Murugan K", income_name="null"), ("SKIPPED", True, "MISSING", False)),
    (dict(income_name="Murugan"), ("CHECKED", False, None, False))])
def test_parent_income_check(spark, values, want):
    r = I.parent_income_check(case(spark, **values)).first()
    assert (r.student_name_match, r.parent_name_used, r.match, r.consistent) == want


def test_key_documents(spark):
    from grantlens.operators import eligibility as E

    matches = spark.createDataFrame([(1, "a"), (1, "b"), (2, "none"), (2, "c")], "applicant_id int, scheme_id string")
    catalogue = spark.createDataFrame([("a", ["x", "y", "z", "u", "v"]), ("b", ["x"]), ("c", None)], "id string, documents array<string>")
    got = {r.scheme_id: (r.documents, r.more_documents) for r in E.with_key_documents(matches, catalogue).collect()}
    assert got == {"a": ("x, y, z", 2), "b": ("x", 0), "none": ("", 0), "c": ("", 0)}
