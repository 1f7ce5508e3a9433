"""Literal expectations that share no table with the jobs."""

import pytest
from pyspark.sql import functions as F

from grantlens.functions.names import title_name
from grantlens.operators import identity as I
from grantlens.operators import questions as Q
from grantlens.rules import utterances as U

INTENTS = [
    ("is dbt enabled in my bank", "dbt_check"), ("i don't know whether my bank is dbt enabled", "dbt_check"), ("dbt linked or not", "dbt_check"),
    ("can i apply for two scholarships", "dual_scholarship"), ("can i get both nsp and tamil nadu scholarship", "dual_scholarship"),
    ("which scheme for me", "eligibility"), ("qualify for scholarship", "eligibility"), ("types of scholarship", "scholarship_list"),
    ("what is aadhaar seeding", "dbt_difference"), ("my aadhaar is linked to my bank. is dbt enabled", "dbt_difference"),
    ("how do i check npci mapping", "dbt_check"), ("how to enable dbt", "dbt_activate"), ("dbt common issue", "dbt_issues"),
    ("how do i link aadhaar with my bank account", "bank_link"), ("my name is different in aadhaar and 10th marksheet", "aadhaar_mismatch"),
    ("certificate list", "documents"), ("what documents are required to apply", "documents"), ("scheme closing date", "deadline"),
    ("income certificate has an old date", "income_expired"), ("family income certificate", "income_cert"),
    ("get community certificate", "community_cert"), ("can you verify whether my certificate is genuine", "verify_cert"),
    ("which scholarship to apply first", "which_scholarship_first"), ("scholarship money", "amount"), ("what should i do before applying", "readiness"),
    ("hello", "greeting"), ("what is your name", "bot_identity"), ("am i eligible for 7.5% quota", "quota_7_5"),
    ("why scholarship is important", "scholarship_purpose"), ("nothing of the kind", "unknown"),
]


def test_intents(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in INTENTS)), "q int, text string")
    got = {r.q: r.intent for r in Q.detect_intent(rows, "q").collect()}
    assert [(INTENTS[i][0], got[i]) for i in sorted(got)] == INTENTS


def test_the_table_is_whole():
    assert sum(len(p) for table in (U.PRIORITY_INTENTS, U.SCORED_INTENTS) for p in table.values()) == 277


CASES = {
    1: [("income", "ARUN KUMAR", None, None), ("income", "RAMESH BABU", None, None)],
    2: [("bonafide", "ARUN KUMAR", None, None), ("disability", "RAMESH BABU", None, None)],
    3: [("income", "ARUN KUMAR", "01-02-2005", None), ("ms10", "Arun Kumar", "01/02/2005", None)],
    4: [("income", "ARUN KUMAR", "01-02-2005", None), ("ms10", "ARUN KUMAR", "02-02-2005", None)],
    5: [("income", "ARUN KUMAR", None, "MURUGAN"), ("ms10", "ARUN KUMAR", None, "SELVAM")],
    6: [("income", "ARUN KUMAR", None, "MURUGAN"), ("ms10", "null", "01-02-2005", "null")],
    7: [("income", "ARUN KUMAR", None, "MURUGAN"), ("income", "ARUN KUMAR", None, "Murugan"), ("x", "ARUN KUMAR", None, None)],
}
CONFLICT, SAME, FEW = "SIGNIFICANT CONFLICT", "CONSISTENT", "INSUFFICIENT DATA"


def test_all_documents_of_a_case_are_compared(spark):
    rows = [(c, i, *d) for c, docs in CASES.items() for i, d in enumerate(docs)]
    docs = spark.createDataFrame(rows, "case_id int, ord int, doc_type string, name string, dob string, parent_name string")
    got = {r.case_id: (r.status, r.dob_status, r.parent_status) for r in I.cross_document_status(docs).collect()}
    assert got == {1: (CONFLICT, FEW, FEW), 2: (CONFLICT, FEW, FEW), 3: (SAME, SAME, FEW), 4: (CONFLICT, CONFLICT, FEW),
                   5: (CONFLICT, FEW, CONFLICT), 6: (FEW, FEW, FEW), 7: (SAME, FEW, SAME)}


def test_dates_without_a_reference_are_grey(spark):
    rows = [(1, 1, "income", "A", "01-02-2005"), (2, 1, "identity", "A", "01-02-2005"), (2, 2, "ms10", "A", "01-02-2005"), (2, 3, "ms12", "A", "03-02-2005")]
    docs = spark.createDataFrame(rows, "case_id int, ord int, doc_type string, name string, dob string")
    got = {(r.case_id, r.doc_type): r.status for r in I.compare_to_reference(docs).collect()}
    assert got == {(1, "income"): "grey", (2, "ms10"): "MATCH", (2, "ms12"): "MISMATCH"}


@pytest.mark.parametrize("n", [1, 2, 250])
def test_long_names_stay_whole(spark, n):
    from pyspark.sql import functions as F

    assert spark.range(1).select(title_name(F.lit("A" * n)).alias("t")).first().t == "A" + "a" * (n - 1)


def test_cross_document_status_reads_documents_once(spark, monkeypatch):
    """Names of a case and what is counted come from one reading; large tables of judged pairs give the same."""
    read = spark.sparkContext.accumulator(0)

    def count(name):
        read.add(1)
        return name

    seen = F.udf(count, "string").asNondeterministic()
    rows = [(1, 1, "Arun K", None), (1, 2, "arun. k", "Raman"), (1, 3, "Kavitha", "Raman"), (2, 1, "--", "Raman"), (2, 2, "Devi", "Selvam"), (3, None, "Devi", None), (3, None, "Mohan", None),
            (None, 1, "Devi", None), (None, 2, "Mohan", None), (4, 1, "null", None), (5, 1, None, "Raman"), (5, 2, "Priya", "Raman"), (5, 3, "Priyaa", "Ramen")]
    docs = spark.createDataFrame([(*r, "01-02-2005") for r in rows], "case_id long, ord int, name string, parent_name string, dob string")
    got = []
    for limit in (100_000, 0):
        monkeypatch.setattr(I, "BROADCAST_PAIRS", limit)
        got.append(sorted((tuple(r) for r in I.cross_document_status(docs.withColumn("name", seen("name"))).collect()), key=repr))
    assert got[0] == got[1] and read.value == 2 * len(rows)
    verdicts = {r[0]: (r[1], r[2], r[5]) for r in got[0]}
    assert verdicts == {1: (3, "SIGNIFICANT CONFLICT", "CONSISTENT"), 2: (2, "SIGNIFICANT CONFLICT", "SIGNIFICANT CONFLICT"), 3: (2, "CONSISTENT", "INSUFFICIENT DATA"),
                        None: (2, "CONSISTENT", "INSUFFICIENT DATA"), 4: (1, "INSUFFICIENT DATA", "INSUFFICIENT DATA"), 5: (3, verdicts[5][1], verdicts[5][2])}
