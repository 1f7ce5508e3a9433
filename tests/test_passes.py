"""Fields of several passes: expected values are written out."""

import datetime

import pytest
from pyspark.sql import functions as F

from grantlens.operators import passes as P

COLUMNS = "doc_id int, kind string, pass_no int, field string, value string, confidence double"


def reconciled(spark, rows):
    got = P.reconcile_fields(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len({(r.doc_id, r.field) for r in got}) == len(got)
    return {(r.doc_id, r.field): (r.value, r.confidence, r.pass_no) for r in got}


def test_names_that_agree_beat_surer_ones(spark):
    got = reconciled(spark, [
        (1, "ms10", 1, "name", "Arun K", 0.90), (1, "ms10", 2, "name", "Arun Kumar", 0.72), (1, "ms10", 3, "name", "ARUN  KUMAR", 0.74),
        (2, "income", 1, "name", "Divya S", 0.90), (2, "income", 2, "name", "Divya S.", 0.60),
        (3, "ms12", 1, "name", "Arun", 0.50), (3, "ms12", 2, "name", "Divya", None),
        (4, "community", 7, "name", "Only One", 0.99)])
    assert got[1, "name"] == ("ARUN  KUMAR", 0.94, 3)
    assert got[2, "name"] == ("Divya S", 0.98, 1)
    assert got[3, "name"] == ("Divya", 0.75, 2)
    assert got[4, "name"] == ("Only One", 0.99, 7)


def test_a_name_read_twice_in_one_pass_agrees_with_nobody(spark):
    got = reconciled(spark, [(1, "ms10", 1, "name", "Arun", 0.6), (1, "ms10", 1, "name", "Arun", 0.6), (1, "ms10", 2, "name", "Divya", 0.7)])
    assert got[1, "name"] == ("Divya", 0.7, 2)


def test_marks_travel_together(spark):
    got = reconciled(spark, [
        (1, "ms10", 1, "marks", "349", 0.6), (1, "ms10", 1, "percentage", "69.80%", 0.9), (1, "ms10", 1, "max_marks", "500", 0.9),
        (1, "ms10", 2, "marks", "449", 0.8), (1, "ms10", 2, "grade", "Pass", 0.85), (1, "ms10", 2, "max_marks", "", 0.9),
        (2, "ms12", 1, "grade", "Pass", 0.85), (2, "ms12", 2, "percentage", "70%", 0.9)])
    assert got[1, "marks"] == ("449", 0.8, 2) and got[1, "grade"] == ("Pass", 0.85, 2)
    assert (1, "percentage") not in got and (1, "max_marks") not in got
    assert got[2, "grade"] == ("Pass", 0.85, 1) and (2, "percentage") not in got


def test_marks_without_confidence(spark):
    got = reconciled(spark, [
        (1, "ms10", 1, "marks", "300", None), (1, "ms10", 2, "marks", "301", 0.1),
        (2, "ms10", 1, "dob", "01-01-2006", 0.9), (2, "ms10", 2, "marks", "302", None), (2, "ms10", 3, "marks", "303", 0.85),
        (3, "ms10", 1, "school", "A", 0.5), (3, "ms10", 2, "school", "B", None),
        (4, "ms10", 1, None, None, None), (4, "ms10", 2, "school", "B", None)])
    assert got[1, "marks"] == ("301", 0.1, 2)
    assert got[2, "marks"] == ("302", 0.90, 2)
    assert got[3, "school"] == ("A", 0.5, 1)
    assert got[4, "school"] == ("B", 0.85, 2)


def test_other_fields(spark):
    got = reconciled(spark, [
        (1, "ms10", 1, "dob", " ".strip(), 0.9), (1, "ms10", 2, "dob", "02-02-2006", 0.4), (1, "ms10", 3, "dob", "03-03-2006", 0.9),
        (1, "ms10", 2, "state", "Kerala", 0.9),
        (2, "income", 1, "name", "Arun", 0.9), (2, "income", 2, "income", "72000", 0.94), (2, "income", 3, "income", "12000", 0.99), (2, "income", 2, "state", "Kerala", 0.9)])
    assert got[1, "dob"] == ("02-02-2006", 0.4, 2) and (1, "state") not in got
    assert got[2, "income"] == ("72000", 0.94, 2) and got[2, "state"] == ("Kerala", 0.9, 2)


def test_no_rows_and_no_fields(spark):
    assert reconciled(spark, []) == {}
    assert reconciled(spark, [(1, "ms10", 1, None, None, None), (2, None, 1, "name", None, 0.5)]) == {}


INCOME = """GOVERNMENT OF TAMIL NADU
INCOME CERTIFICATE
Certificate No: TN-1234567
This is to certify that {name} son of MURUGAN K residing at Salem Taluk
Annual Income: Rs. {income} per annum
Date of Issue: 01-05-2026
Tahsildar"""


@pytest.mark.parametrize("texts, fields", [
    ([INCOME.format(name="ARUN KUMAR K", income=72000)] * 2, True), (["nothing to see", INCOME.format(name="ARUN KUMAR K", income=72000)], True), ([], False), (None, False), ([None, ""], False)])
def test_reports_of_passes(spark, texts, fields):
    df = spark.createDataFrame([(1, "income", texts, 80.0)], "doc_id int, slot string, passes array<string>, engine double")
    r = P.reports_of_passes(df, F.lit(datetime.date(2026, 6, 1))).collect()
    assert len(r) == 1 and r[0].kind == "income" and r[0].n_passes == max(1, len(texts or []))
    assert (r[0].n_fields > 4) == fields
    assert ("income_missing" in r[0].issues) != fields
    if texts and texts[0] and texts[0].startswith("GOV"):
        assert (r[0].validation, r[0].is_valid) == ("valid", True)


def test_reports_make_texts_once_and_sort_once(spark):
    """No filter makes the texts where the table is read, as explode() infers one, and one sort serves all groupings of a report."""
    rows = spark.range(12).repartition(3, "id").selectExpr(
        "id div 2 as doc_id", "if(id < 6, 'income', null) as slot", "array(concat('INCOME CERTIFICATE\nAnnual Income: Rs. ', 50000 + id, ' per annum'), null) as passes",
        "case id when 0 then -0.0D when 1 then 0.0D when 2 then double('NaN') when 3 then double('NaN') when 4 then 71.3D else null end as engine")
    reports = P.reports_of_passes(rows.repartition(3, "doc_id"), F.lit("2026-07-01").cast("date"))
    plan = reports._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") == 1 and "Filter (size(" not in plan
    got = {(r.doc_id, r.confidence) for r in reports.collect()}
    # Both zeros are one number, and so are two values that are none: their rows are one document.
    assert len([d for d, _ in got if d < 2]) == 2 and len([d for d, _ in got if d == 2]) == 2 and {d for d, _ in got} == set(range(6))
