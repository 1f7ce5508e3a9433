"""Jobs over applicants and the scheme catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.operators import eligibility as E, profiles as P
from grantlens.plans.registry import job
from grantlens.plans.sqltext import duck_table, judged_sql, quoted, status_sql, inr_sql
from grantlens.plans.views import APPLICANTS, applicants
from grantlens.rules import criteria as R
from grantlens.rules.relations import frame
from grantlens.rules.schemes import catalogue_a


def _criteria_sql() -> str:
    required = {
        "gender": "case when s_gender = 'Girls' then 'Female Only' else 'Male Only' end",
        "income": f"'≤ ₹' || {inr_sql('s_limit')} || '/year'", "category": "s_category", "state": "s_state",
        "district": "s_district", "course": "s_course",
    }
    actual = {
        "income": f"coalesce('₹' || {inr_sql('income')} || '/year', 'Not Provided')",
        "disability": "coalesce(cast(disabled as varchar), 'Not Provided')", "quota": "quota_type",
    }
    parts = []
    for i, (name, labels) in enumerate(R.LABELS.items(), start=1):
        shown = actual.get(name, f"coalesce(cast({name} as varchar), 'Not Provided')")
        crit = labels[0]
        parts.append(f"select applicant_id, scheme_ord, scheme_id, {i} as criterion_no, '{crit}' as criterion, c_{name} as status, "
                     f"true as is_hard, {required.get(name, repr(crit))} as required, {shown} as actual from judged where c_{name} is not null")
        open_text = {"income": "No Income Limit", "state": "Pan-India / Central"}.get(name)
        if open_text:
            parts.append(f"select applicant_id, scheme_ord, scheme_id, {i}, '{crit}', 'PASSED', false, '{open_text}', {shown} "
                         f"from judged where c_{name} is null")
    return f"with {judged_sql()}\n" + "\nunion all ".join(parts)


@job("eligibility_criteria", "J1", "C6", "C10", sql=_criteria_sql())
def eligibility_criteria(spark, base):
    return E.evaluate_eligibility(applicants(spark, base))


def _lists_sql() -> str:
    def text(name: str, kind: int) -> str:
        template = R.LABELS[name][kind]
        if "{}" not in template:
            return "'" + template.replace("'", "''") + "'"
        value = {"income": inr_sql("s_limit")}.get(name, f"s_{name}")
        if name == "category" and kind == 3:
            value = "category"
        head, tail = template.split("{}")
        return f"'{head}' || {value} || '{tail}'"

    def listed(kind: int, outcome: str) -> str:
        items = []
        for name in R.LABELS:
            opened = f" when c_{name} is null then '{R.OPEN_LABELS[name]}'" if outcome == "PASSED" and name in R.OPEN_LABELS else ""
            items.append(f"case when c_{name} = '{outcome}' then {text(name, kind)}{opened} end")
        return f"list_filter([{', '.join(items)}], lambda x: x is not null)"

    return f"""with {status_sql()},
lists as (select *, {listed(3, 'PASSED')} as passed_l, {listed(2, 'FAILED')} as failed_l, {listed(1, 'NEEDS_INFO')} as missing_l from results)
select applicant_id, scheme_id, status, score, status = '{R.CONFIRMED}' as is_eligible,
 array_to_string(passed_l, ' | ') as passed, array_to_string(failed_l, ' | ') as failed, array_to_string(missing_l, ' | ') as missing,
 case status when '{R.NOT_MATCHED}' then 'Ineligible: ' || array_to_string(failed_l, '; ') || '.'
  when '{R.POTENTIAL}' then 'Potential match: Primary criteria satisfied. Confirmation requires: ' || array_to_string(missing_l, ', ') || '.'
  when '{R.NEEDS_INFORMATION}' then 'Needs more information: ' || array_to_string(missing_l, ', ') || '.'
  else 'Meets all mandatory criteria for ' || scheme_name || '. Eligibility score: ' || cast(score as varchar) || '%.' end as summary
from lists"""


@job("eligibility_status", "A1", sql=_lists_sql())
def eligibility_status(spark, base):
    out = E.eligibility_status(applicants(spark, base))
    return out.select("applicant_id", "scheme_id", "status", "score", "is_eligible", "summary",
                      *[F.array_join(c, " | ").alias(c) for c in ("passed", "failed", "missing")])


_ORDER = "order by status_rank desc, score desc, scheme_ord"


@job("ranked_schemes", "W1", sql=f"""with {status_sql()}
select applicant_id, cast(row_number() over (partition by applicant_id {_ORDER}) as integer) as position, scheme_ord, scheme_id, status, score
from results""")
def ranked_schemes(spark, base):
    return E.rank_schemes(applicants(spark, base))


@job("top3_schemes", "J1", "A1", "W1", sql=f"""with {status_sql()},
r as (select *, row_number() over (partition by applicant_id {_ORDER}) as rn from results)
select applicant_id, applicant_name, cast(rn as integer) as position, scheme_ord, scheme_id, status, score from r where rn <= 3""")
def top3_schemes(spark, base):
    """Flagship: the best three schemes of every applicant."""
    return E.rank_schemes(applicants(spark, base), top_k=3, keep=("applicant_name",))


@job("recommended_schemes", "W2", sql=f"""with {status_sql()}
select applicant_id, cast(row_number() over (partition by applicant_id {_ORDER}) as integer) as position, scheme_ord, scheme_id, status, score
from results where status = '{R.CONFIRMED}'""")
def recommended_schemes(spark, base):
    return E.rank_schemes(applicants(spark, base), only_eligible=True)


_TOP = f"""with {status_sql()},
r as (select *, row_number() over (partition by applicant_id, status order by score desc, scheme_ord) as rn,
  count(*) over (partition by applicant_id, status) as n from results where status in ('{R.CONFIRMED}', '{R.POTENTIAL}')),
k as (select *, case status when '{R.CONFIRMED}' then 4 else 3 end as k from r)
select applicant_id, status, cast(rn as integer) as position, scheme_id, score, cast(greatest(n - k, 0) as integer) as more from k where rn <= k"""
_ASKED = {"id": "string", "documents": "array<string>"}


@job("top_schemes_per_status", "W3", sql=_TOP)
def top_schemes_per_status(spark, base):
    return E.top_k_per_status(applicants(spark, base), {R.CONFIRMED: 4, R.POTENTIAL: 3})


@job("key_documents_of_matches", "W3", sql=f"""with top as ({_TOP}), d as ({duck_table([{"id": r["id"], "documents": r["documents"]} for r in catalogue_a()], _ASKED)})
select top.*, coalesce(array_to_string(documents[1:3], ', '), '') as documents, cast(greatest(coalesce(len(documents), 0) - 3, 0) as integer) as more_documents from top left join d on d.id = top.scheme_id""")
def key_documents_of_matches(spark, base):
    catalogue = frame(spark, [{"id": r["id"], "documents": r["documents"]} for r in catalogue_a()], _ASKED)
    return E.with_key_documents(top_schemes_per_status(spark, base), catalogue)
