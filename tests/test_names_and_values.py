"""Names, amounts, dates and categories on hand-made values."""

import pytest
from pyspark.sql import functions as F

from grantlens.functions import categories as C, dates as D, money as M, ocr_names as N
from grantlens.functions.names import title_name
from grantlens.operators import identity as I

PAIRS = [
    ("ARUN KUMAR K", "arun kumar k", True, "EXACT_MATCH", 1.0), ("Raj Arun Kumar", "Arun Kumar Raj", True, "EXACT_MATCH", 0.98),
    ("Thiru. Arun Kumar", "ARUN KUMAR", True, "EXACT_MATCH", 1.0), ("K Arun", "Arun", False, "EXACT_MATCH", 0.95), ("K Arun", "Arun", True, "LIKELY_MATCH", 0.92),
    ("Balasubramaniam S", "Balasubramaniam Sivasankaranarayanan", True, "LIKELY_MATCH", 0.90), ("Arun Kumar", "Arun Kumar Extra", True, "NEEDS_REVIEW", 0.65),
    ("DEMO CANDIDATE", "DEMO CANDDATE", True, "MINOR_DIFFERENCE", 0.90), ("DEMO CANDIDATE", "DEMO CANDDATE", False, "LIKELY_MATCH", None),
    ("ARUN KUMAR", "DIVYA", True, "MISMATCH", None), (None, "DIVYA", True, "MISSING", 0.0), ("null", "DIVYA", True, "MISSING", 0.0),
]


@pytest.mark.parametrize("swap", [False, True])
def test_name_levels(spark, swap):
    rows = [(i, b, a, s) if swap else (i, a, b, s) for i, (a, b, s, _, _) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "i int, a string, b string, is_strict boolean")
    keyed = df.select("i", I.name_key(F.col("a")).alias("a_value"), I.name_key(F.col("b")).alias("b_value"), "is_strict")
    got = {r.i: r for r in I.compare_names(keyed).collect()}
    for i, (_, _, _, status, score) in enumerate(PAIRS):
        assert got[i].status == status, PAIRS[i]
        assert 0 <= got[i].score <= 1
        if score is not None:
            assert got[i].score == pytest.approx(score)


@pytest.mark.parametrize("raw, want", [("₹2,50,000", 250000), ("Rs. 250000/-", 250000), ("R. 180000", 180000), ("INR 2,00,000/-", 200000), ("Rs 75,000.00", 75000),
                                       ("1.80.000", 180000), ("2,5O,000", 250000), ("-500", None), ("", None), ("null", None), ("abc", None), ("999999999", None)])
def test_income(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(M.parse_income(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [("15-08-2005", "15-08-2005"), ("5/8/2005", "05-08-2005"), ("2005.08.15", "15-08-2005"), ("31-02-2005", "31-02-2005"), ("May 2005", "May 2005")])
def test_date_display(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(D.display_date(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [("Most Backward Class (MBC)", "MBC"), ("other backward class", "OBC"), ("Other Backward people", "OBC"), ("GEN", "General"), ("x (gen)", "General"), (" ", None)])
def test_community(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(C.normalize_community(F.col("x"))).first()[0] == want


def test_indian_grouping_and_title(spark):
    row = spark.createDataFrame([(1234567, "mr. ARUN kumar k.")], "n bigint, s string").select(M.inr(F.col("n")), title_name(F.col("s"))).first()
    assert tuple(row) == ("12,34,567", "Arun Kumar K")


@pytest.mark.parametrize("raw, ok", [("ARUN KUMAR K", True), ("Lakshmi Priya", True), ("Bh Lhe", False), ("TOTAL MARKS", False), ("March", False), ("N1THISH", False), ("lll aaa", False), ("K S", False)])
def test_name_plausibility(spark, raw, ok):
    assert spark.createDataFrame([(raw,)], "x string").select(N.is_name(F.col("x"))).first()[0] is ok


def test_candidate_cleaning(spark):
    raw = ["NAME OF THE CANDIDATE: ARUN KUMAR K DATE OF BIRTH: 12/03/2005", "|| Selvi. DIVYA R ==", "PRIYA S SL NO"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(N.clean_candidate(F.col("x"))).collect()]
    assert got == ["ARUN KUMAR K", "DIVYA R", "PRIYA S"]


def test_consensus_prefers_the_clean_spelling(spark):
    rows = [(1, 1, "N1THISHKUMAR"), (1, 2, "NITHISHKUMAR"), (2, 1, "ARUN KUMAR"), (2, 2, "DIVYA RAMAN"), (3, 1, "KARTHIK5"), (4, 1, "ab")]
    got = {r.case_id: r for r in I.name_consensus(spark.createDataFrame(rows, "case_id int, ord int, name string")).collect()}
    assert (got[1].consensus_name, got[1].status, got[1].confidence) == ("NITHISHKUMAR", "NEEDS_REVIEW", 93)
    assert (got[2].status, got[2].confidence, got[2].has_conflict) == ("NEEDS_REVIEW", 60, True)
    assert (got[3].status, got[3].confidence) == ("NEEDS_REVIEW", 68) and 4 not in got


def test_parent_names_join_the_case_status(spark):
    rows = [(1, 1, "identity", "ARUN K", "01-01-2005", "RAMAN S"), (1, 4, "ms10", "ARUN K", "01-01-2005", "GOPAL V"), (2, 1, "identity", "DIVYA", None, None)]
    docs = spark.createDataFrame(rows, "case_id int, ord int, doc_type string, name string, dob string, parent_name string")
    got = {r.case_id: r for r in I.cross_document_status(docs).collect()}
    assert (got[1].status, got[1].parent_status, got[1].dob_status) == ("SIGNIFICANT CONFLICT", "SIGNIFICANT CONFLICT", "CONSISTENT")
    assert got[2].status == "INSUFFICIENT DATA"


def test_months_and_examination_periods(spark):
    from grantlens.functions.dates import normalize_month
    from grantlens.operators.extraction import exam_period

    months = {"mar": "March", " MARCH ": "March", "Sep": "September", "may": "May", "sept": "Sept", "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in months], "m string").select("m", normalize_month(F.col("m")).alias("got")).collect()
    assert {r.m: r.got for r in rows} == months
    periods = {
        "SESSION AND YEAR OF ISSUE : MAR 2019": ("March", 2019), "Examination held in April2021": ("April", 2021), "YEAR OF PASSING: 2018, printed in June": ("June", 2018),
        "result OCT 2020 of May": ("October", 2020), "on 3 January, 2016": ("January", 2016), "dated 12.05.2017": (None, 2017), "2017 in august": ("August", 2017),
        "YEAR OF PASSING Sometime 1999 and July": ("July", 1999), "year 1999": (None, None), "marched 2041": (None, None), "பருவம்: MAR 2020": ("March", 2020), "": (None, None), None: (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in periods], "t string").select("t", exam_period(F.col("t")).alias("p")).collect()
    assert {r.t: (r.p.month, r.p.year) for r in rows} == periods
