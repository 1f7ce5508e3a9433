"""Three-valued eligibility on hand-made applicants."""

import pytest

from grantlens.operators import eligibility as E

COLUMNS = ("applicant_id string, category string, income bigint, gender string, state string, district string, course string, disabled boolean, "
           "disability_percent int, govt_school boolean, agri_labor boolean, first_graduate boolean, quota_type string")


def person(**kw):
    base = dict.fromkeys([c.split()[0] for c in COLUMNS.split(", ")])
    return tuple({**base, "applicant_id": "x", "quota_type": "unknown", **kw}.values())


def status(spark, scheme, **kw):
    rows = E.eligibility_status(spark.createDataFrame([person(**kw)], COLUMNS)).filter(f"scheme_id = '{scheme}'").collect()
    return rows[0]


@pytest.mark.parametrize("facts, want, score", [
    ({"disabled": True, "income": 500000, "course": "Engineering"}, "CONFIRMED MATCH", 80),
    ({"disabled": True}, "POTENTIAL MATCH", 55),
    ({"disabled": True, "course": "Diploma"}, "NOT MATCHED", 0),
    ({"course": "Engineering", "income": 100000}, "NEEDS MORE INFORMATION", 0),
    ({"disabled": False, "disability_percent": 30, "course": "Engineering", "income": 1}, "NOT MATCHED", 0),
])
def test_disability_scheme(spark, facts, want, score):
    row = status(spark, "nsp-aicte-saksham", **facts)
    assert (row.status, row.score) == (want, score)


def test_under_benchmark_is_explained(spark):
    row = status(spark, "nsp-aicte-saksham", disabled=False, disability_percent=30, course="Engineering", income=1)
    assert row.failed == ["Minimum 40% benchmark disability required (provided: 30%)"]


@pytest.mark.parametrize("quota, want", [("government", "CONFIRMED MATCH"), ("management", "NOT MATCHED"), ("unknown", "NEEDS MORE INFORMATION")])
def test_quota_is_never_assumed(spark, quota, want):
    assert status(spark, "tn-post-matric-bc-mbc", category="MBC", income=200000, state="Tamil Nadu", quota_type=quota).status == want


@pytest.mark.parametrize("answer, want", [(True, "CONFIRMED MATCH"), (False, "NOT MATCHED"), (None, "NEEDS MORE INFORMATION")])
def test_first_graduate_is_three_valued(spark, answer, want):
    assert status(spark, "tn-first-graduate", category="General", state="tamil nadu", course="Engineering", first_graduate=answer).status == want


def test_income_zero_counts_as_given_but_earns_no_bonus(spark):
    zero = status(spark, "nsp-central-sector", category="General", income=0)
    low = status(spark, "nsp-central-sector", category="General", income=1000)
    assert (zero.status, zero.score, low.score) == ("CONFIRMED MATCH", 80, 85)


def test_invariants_on_all_pairs(spark, base):
    from grantlens.plans.views import applicants

    rows = E.eligibility_status(applicants(spark, base)).collect()
    assert all(not r.missing and not r.failed for r in rows if r.status == "CONFIRMED MATCH")
    assert all(r.score == 0 for r in rows if r.status in ("NOT MATCHED", "NEEDS MORE INFORMATION"))
    assert all(70 <= r.score <= 100 for r in rows if r.status == "CONFIRMED MATCH")


def test_ranking_needs_no_shuffle(spark, base):
    from grantlens.plans.views import APPLICANTS
    from grantlens.session import sql_over

    plan = E.rank_schemes(sql_over(spark, base, APPLICANTS), top_k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_large_catalogue_is_taken_whole():
    assert len(E.prepare_schemes([{"id": str(i)} for i in range(5000)])) == 5000
