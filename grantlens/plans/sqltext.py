"""Fragments of the comparison SQL."""

from __future__ import annotations

from grantlens.plans.views import APPLICANTS
from grantlens.rules import criteria as R
from grantlens.rules.relations import inline_table, sql_literal
from grantlens.rules.schemes import NO_LIMIT, catalogue_a

# Columns of the scheme table the SQL reads.
SCHEME_COLUMNS = {
    "ord": "int", "id": "string", "name": "string", "category": "string", "state": "string", "district": "string",
    "course": "string", "gender": "string", "income_limit": "bigint", "requires_govt_quota": "boolean",
    "requires_disability": "boolean", "requires_govt_school": "boolean", "requires_agri_labor": "boolean",
    "requires_first_graduate": "boolean", "requires_armed_forces": "boolean",
}


def quoted(values) -> str:
    return ", ".join(sql_literal(v, "duckdb") for v in values)


def duck_table(rows, types) -> str:
    return inline_table(rows, types, "duckdb")


def inr_sql(expr: str) -> str:
    s = f"cast({expr} as varchar)"
    head = f"reverse(left({s}, length({s}) - 3))"
    return (f"(case when length({s}) <= 3 then {s} else reverse(rtrim(regexp_replace({head}, '(\\d\\d)', '\\1,', 'g'), ',')) "
            f"|| ',' || right({s}, 3) end)")


def judged_sql() -> str:
    """CTE text: every (applicant, scheme, criterion) with its outcome, NULL when not tested."""
    def outcome(unknown: str, failed: str) -> str:
        return f"case when {unknown} then 'NEEDS_INFO' when coalesce({failed}, false) then 'FAILED' else 'PASSED' end"

    accepted = (
        "(upper(s.category) = upper(a.category) or (s.category = 'BC' and upper(a.category) in ('MBC', 'DNC')) "
        "or (s.category = 'OBC' and upper(a.category) in ('BC', 'MBC')))"
    )
    flag = lambda c: (f"s.requires_{c}", outcome(f"a.{_FLAG[c]} is null", f"not a.{_FLAG[c]}"))
    tests = {
        "gender": ("s.gender <> 'All'", outcome("a.gender is null or a.gender = 'All'", "a.gender <> s.gender")),
        "income": (f"s.income_limit <> {NO_LIMIT}", outcome("a.income is null", "a.income > s.income_limit")),
        "category": ("s.category <> 'All'", outcome("a.category is null", f"not {accepted}")),
        "state": (f"s.state not in ({quoted(R.NATIONWIDE)})", outcome("a.state is null", "lower(a.state) <> lower(s.state)")),
        "district": ("s.district <> 'All'", outcome("a.district is null or a.district = 'All'", "lower(a.district) <> lower(s.district)")),
        "course": ("s.course <> 'All'", outcome("a.course is null or a.course = 'All'", "lower(a.course) <> lower(s.course)")),
        "disability": flag("disability"), "govt_school": flag("govt_school"), "agri_labor": flag("agri_labor"),
        "armed_forces": flag("armed_forces"), "first_graduate": flag("first_graduate"),
        "quota": (f"s.requires_govt_quota and coalesce(a.category in ({quoted(R.RESERVED_COMMUNITIES)}), false)",
                  outcome("a.quota_type = 'unknown'", "a.quota_type = 'management'")),
    }
    columns = ",\n ".join(f"case when {applies} then {result} end as c_{name}" for name, (applies, result) in tests.items())
    return f"""applicants as ({APPLICANTS}), schemes as ({duck_table(catalogue_a(), SCHEME_COLUMNS)}),
judged as (select a.*, s.ord as scheme_ord, s.id as scheme_id, s.name as scheme_name, s.gender as s_gender, s.category as s_category,
 s.state as s_state, s.district as s_district, s.course as s_course, s.income_limit as s_limit,
 {columns}
 from applicants a cross join schemes s)"""


_FLAG = {"disability": "disabled", "govt_school": "govt_school", "agri_labor": "agri_labor", "armed_forces": "armed_forces",
         "first_graduate": "first_graduate"}
_ALL = "[" + ", ".join(f"c_{n}" for n in R.LABELS) + "]"


def status_sql() -> str:
    """CTE text ending in `results` with status and score per (applicant, scheme)."""
    potential = (f"disabled and ((scheme_id = '{R.POTENTIAL_SCHEME_WITH_COURSE}' and (course is null or course in "
                 f"({quoted(R.POTENTIAL_COURSES)}))) or scheme_id = '{R.POTENTIAL_SCHEME}')")
    return f"""{judged_sql()},
counted as (select *, len(list_filter({_ALL}, lambda x: x = 'FAILED')) as n_failed,
  len(list_filter({_ALL}, lambda x: x = 'NEEDS_INFO')) as n_missing from judged),
stated as (select *, case when n_failed > 0 then '{R.NOT_MATCHED}' when n_missing > 0 and coalesce({potential}, false) then '{R.POTENTIAL}'
  when n_missing > 0 then '{R.NEEDS_INFORMATION}' else '{R.CONFIRMED}' end as status from counted),
results as (select *, cast(case status when '{R.POTENTIAL}' then {R.POTENTIAL_SCORE} when '{R.CONFIRMED}' then least(100, 70
   + case when s_category <> 'All' and upper(s_category) = upper(category) then 10 else 0 end
   + case when s_course <> 'All' and lower(s_course) = lower(course) then 10 else 0 end
   + case when s_district <> 'All' and lower(s_district) = lower(district) then 5 else 0 end
   + case when income <> 0 and s_limit <> {NO_LIMIT} and income * 1.0 / s_limit < 0.6 then 5 else 0 end) else 0 end as integer) as score,
  case status when '{R.CONFIRMED}' then 3 when '{R.POTENTIAL}' then 2 when '{R.NEEDS_INFORMATION}' then 1 else 0 end as status_rank
  from stated)"""
