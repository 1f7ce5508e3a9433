"""Every named job against its SQL on the smallest tables; jobs without SQL must run and keep their schema."""

import pytest

from grantlens.plans import all_jobs
from tests.compare import check, duck

JOBS = all_jobs()


@pytest.fixture(scope="module")
def con(base):
    return duck(base)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job(spark, con, base, name):
    ok, text = check(spark, con, base, JOBS[name])
    assert ok, text


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "applicant_id"
