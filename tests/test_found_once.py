"""Work that several results share is done once for a text, an applicant or a pair."""

from pyspark.sql import functions as F

from grantlens.functions.text import group, matches
from grantlens.operators import extraction as X
from grantlens.rules import documents as T, extraction as R

INCOME = ("GOVERNMENT OF TAMIL NADU\nINCOME CERTIFICATE\nCertificate No: TN-1000007\nThis is to certify that ARUN KUMAR K son of MURUGAN K residing at Salem Taluk\n"
          "Annual Income: Rs. 72,000 per annum\nDate of Issue: 03-02-2026\nTotal marks 400 / 500 MAR 2024\nTahsildar")
SHEET = "STATE BOARD OF SCHOOL EXAMINATIONS, TAMIL NADU\nNAME OF THE CANDIDATE: DIVYA S\nFATHER'S NAME: RAMESH KUMAR\nMOTHER'S NAME: LAKSHMI DEVI\nTOTAL MARKS 400 / 500\nSESSION: MAR 2024"


def test_fields_share_what_they_need(spark):
    rows = spark.createDataFrame([(1, "income", INCOME), (2, "ms10", SHEET), (3, "ms10", None), (4, None, INCOME)], "k int, kind string, text string")
    wide = X.with_fields(rows, "text")
    got = {r.k: r for r in wide.collect()}
    assert (got[1].name, got[1].father_name, got[1].mother_name, got[1].state, got[1].income, got[1].board, got[1].year, got[1].marks) == (
        "Arun Kumar K", "Murugan K", None, "Tamil Nadu", "72000", None, None, None)
    assert (got[2].name, got[2].father_name, got[2].mother_name, got[2].board, got[2].month, got[2].year, got[2].marks, got[2].percentage) == (
        "Divya S", "Ramesh Kumar", "Lakshmi Devi", "Tamil Nadu State Board (SSLC)", "March", "2024", "400", "80.00%")
    assert got[3].name is None and got[4].name is None and got[4].state == "Tamil Nadu"
    # Marks and periods are searched in mark sheets only.
    assert (got[1].scored, got[1].maximum, got[1].period.year) == (None, None, None)
    limit = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = wide.select("board", "state", "name", "father_name", "mother_name")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", limit)
    # The state is looked for once (its test and its count), a name is judged by its words at most four times: near a label, below it, over lines and for all other persons.
    assert plan.count("bhubaneswar, RLIKE") + plan.count("bhubaneswar)") <= 4 and 0 < plan.count("vidyalaya|academy|date") <= 4


def test_literals_leave_captures_as_they_are(spark):
    texts = [INCOME, SHEET, INCOME.lower(), SHEET.swapcase(), "", None, "வட்டம் / Taluk: Salem\nமாவட்டம்: x", "taluK: Omalur District: salem", "İSSUED ON 01/02/2024", "Kelvin K taluk"]
    patterns = [*R.INCOME, *R.FATHER, *R.MOTHER, *R.TALUK, *R.DISTRICT, *R.ISSUE_DATE, *R.CERT_NUMBER, *R.REGISTER, R.DOB, R.FATHER_OF, *R.INCOME_HOLDER, *R.COMMUNITY_HOLDER, R.SCHOOL_NAME]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    plain, tested = [group(F.col("t"), p) for p in patterns], [group(F.col("t"), p, low="low") for p in patterns]
    found = [matches(F.col("t"), p) for _, ps in T.STATES for p in ps], [matches(F.col("t"), p, low="low") for _, ps in T.STATES for p in ps]
    for a, b in ((plain, tested), found):
        assert df.select(F.array(*a)).collect() == df.select(F.array(*b)).collect()


def test_an_income_is_grouped_once_per_applicant(spark):
    from grantlens.operators.eligibility import evaluate_eligibility

    rows = spark.createDataFrame([(1, 1234567), (2, None)], "applicant_id int, income bigint")
    out = evaluate_eligibility(rows)
    assert {(r.applicant_id, r.actual) for r in out.filter("criterion = 'Annual Family Income'").collect()} == {(1, "₹12,34,567/year"), (2, "Not Provided")}
    # One grouping of the applicant's income and one of the scheme's limit; the plan had two of the income before, both per pair.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(cast(income") == 1
    assert plan.index("explode([") < plan.index("regexp_replace(cast(income")
