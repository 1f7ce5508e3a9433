"""Jobs over applications and their readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.functions import categories as C
from grantlens.functions.banding import PROFILE_BANDS
from grantlens.operators import readiness as R
from grantlens.operators.eligibility import FLAG_FIELDS
from grantlens.plans.catalogues import satisfies_sql
from grantlens.plans.identity import CONSISTENCY_SQL, consistency_score, expiry_sql, iso_sql
from grantlens.plans.registry import job
from grantlens.plans.sqltext import duck_table, quoted
from grantlens.plans.views import AS_OF, CASES, EVIDENCE, cases, evidence
from grantlens.rules import criteria as K, risks as X

_DIM = {c: t for c, t in {**R.DIMENSION_TYPES}.items()}


def letters_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(upper(trim({x})), '[^A-Z\\s]', '', 'g'), '\\s+', ' ', 'g')"


def sim_sql(a: str, b: str) -> str:
    ka, kb = letters_sql(a), letters_sql(b)
    longest = f"greatest(length({ka}), length({kb}))"
    return f"(case when {ka} <> '' and {kb} <> '' then ({longest} - levenshtein({ka}, {kb})) * 1.0 / {longest} else 0 end)"


def dashed_sql(x: str) -> str:
    return f"trim(translate({x}, './', '--'))"


def _tally_sql() -> str:
    part = lambda test, unknown, failed: f"case when s.{test} then case when {unknown} then 1 when coalesce({failed}, false) then 100 else 0 end else 0 end"
    accepted = ("(upper(s.category) = upper(c.category) or (s.category = 'BC' and c.category in ('MBC', 'DNC')) or (s.category = 'OBC' and c.category in ('BC', 'MBC')))")
    parts = [
        part("tests_gender", "c.gender is null", "c.gender <> s.gender"), part("tests_income", "c.income is null", "c.income > s.income_limit"),
        part("tests_category", "c.category is null", f"not {accepted}"), part("tests_state", "c.state is null", "lower(c.state) <> lower(s.state)"),
        part("tests_district", "c.district is null", "lower(c.district) <> lower(s.district)"),
        part("tests_course", "c.course is null or c.course = 'All'", "lower(c.course) <> lower(s.course)"),
        *[part(f"tests_{f}", f"c.{col} is null", f"not c.{col}") for f, col in FLAG_FIELDS.items()],
        f"case when s.tests_quota and c.category in ({quoted(K.RESERVED_COMMUNITIES)}) then case c.quota_type when 'unknown' then 1 when 'management' then 100 else 0 end else 0 end",
    ]
    return " + ".join(parts)


def _prepared_sql() -> str:
    mismatch = " + ".join(f"case when c.{n} is not null and {sim_sql('c.student_name', 'c.' + n)} < 0.75 then 1 else 0 end"
                          for n in ("aadhaar_name", "tenth_name", "twelfth_name", "bank_holder", "bonafide_name"))
    count = lambda c: f"len(list_filter(string_split(c.{c}, ','), lambda x: x <> ''))"
    dims = ", ".join(f"s.{c}" for c in R.DIMENSION_TYPES if c not in R.SCHEME_TYPES)
    return f"""c as ({CASES}), s as (select *, row_number() over (order by ord) - 1 as scheme_no from ({duck_table(R.scheme_dimension(), _DIM)}) s0),
j as (select c.*, s.id as scheme_id, {dims}, {_tally_sql()} as tally, len(s.required_labels) as n_required, {count('uploads')} as n_uploads, {count('wrong_types')} as n_wrong,
 {count('low_quality')} as n_low_quality, case when c.student_name is null then 0 else {mismatch} end as n_name_mismatch,
 {sim_sql('c.student_name', 'c.income_name')} as sim_income, {sim_sql('c.course', 'c.doc_course')} as sim_course, {sim_sql('c.institution', 'c.doc_institution')} as sim_institution,
 {sim_sql('c.student_name', 'c.bank_holder')} as sim_bank, {dashed_sql('c.dob')} as p_dob, {dashed_sql('c.tenth_dob')} as tenth_dob_d, {dashed_sql('c.aadhaar_dob')} as aadhaar_dob_d,
 regexp_matches(upper(trim(c.ifsc)), '{R.IFSC}') as ifsc_valid, {expiry_sql('c.income_issue_date', 'c.income_expiry_date', 12)} as income_validity,
 len(list_filter(s.required_labels, lambda l: len(list_filter(string_split(c.uploads, ','), lambda u: {satisfies_sql('lower(l)', 'lower(u)', False)})) = 0)) as n_missing,
 s.id = '{K.POTENTIAL_SCHEME_WITH_COURSE}' and (c.course is null or c.course in ({quoted(K.POTENTIAL_COURSES)})) or s.id = '{K.POTENTIAL_SCHEME}' as likely
 from c join s using (scheme_no)),
prepared as (select *, case when tally >= 100 then 0 when tally = 0 then 3 when coalesce(disabled and likely, false) then 2 else 1 end as match_rank from j)"""


def _risks_sql() -> str:
    parts = []
    for i, (rule, severity, dimension, field, points, unknown, check, condition) in enumerate(X.RULES):
        shown = severity if severity.startswith("case") else f"'{severity}'"
        parts.append(f"select case_id, scheme_id, {i} as ordinal, '{rule}' as rule_id, {shown} as severity, '{dimension}' as dimension, '{field}' as field, "
                     f"cast({points} as integer) as points, {str(unknown).lower()} as is_unknown, '{check}' as check_type from prepared where {condition}")
    return f"{_prepared_sql()},\nrisks as ({' union all '.join(parts)})"


@job("readiness_risks", "R1", "C12", sql=f"with {_risks_sql()} select * from risks")
def readiness_risks(spark, base):
    return R.readiness_risks(cases(spark, base), F.lit(AS_OF).cast("date"), evidence=False)


_LOST = {d: f"greatest(0, {m} - coalesce(sum(points) filter (dimension = '{d}'), 0))" for d, m in X.DIMENSIONS.items()}


@job("readiness_score", "A2", "A3", "A4", sql=f"""with {_risks_sql()},
g as (select p.case_id, p.scheme_id, {', '.join(f'cast({e} as integer) as {d}' for d, e in _LOST.items())}, coalesce(bool_or(is_unknown), false) as has_unknown,
 cast(count(*) filter (severity = '{X.HIGH}') as integer) as high_count, cast(count(*) filter (severity = '{X.MEDIUM}') as integer) as medium_count, cast(count(*) filter (severity = '{X.LOW}') as integer) as low_count
 from prepared p left join risks r using (case_id) group by 1, 2),
t as (select *, {' + '.join(X.DIMENSIONS)} as total from g)
select *, 100 - total as lost_points, case when has_unknown and total >= 75 then 'NEEDS_CONFIRMATION' when total >= 90 then 'READY_TO_SUBMIT' when total >= 75 then 'REVIEW_BEFORE_SUBMIT'
 when total >= 50 then 'CORRECTIONS_NEEDED' else 'NOT_READY' end as level from t""")
def readiness_score(spark, base):
    return R.readiness_score(cases(spark, base), F.lit(AS_OF).cast("date"))


def _order_sql(rank: str) -> str:
    return f"""with {_risks_sql()} select case_id, cast(row_number() over (partition by case_id order by {rank}, ordinal) as integer) as position, rule_id, severity from risks"""


@job("ordered_risks", "W4", sql=_order_sql(f"case severity when '{X.HIGH}' then 0 when '{X.MEDIUM}' then 1 else 2 end"))
def ordered_risks(spark, base):
    return R.order_risks(cases(spark, base), F.lit(AS_OF).cast("date"))


@job("ordered_risks_legacy", "W4", sql=_order_sql(f"case severity when '{X.MEDIUM}' then 1 else 2 end"))
def ordered_risks_legacy(spark, base):
    return R.order_risks(cases(spark, base), F.lit(AS_OF).cast("date"), legacy_order=True)


@job("application_vs_document", "J9", "N2", sql=f"""with c as ({CASES}),
d as (select *, coalesce(aadhaar_name, tenth_name, twelfth_name) as doc_name, coalesce(tenth_dob, aadhaar_dob) as doc_dob, upper(trim(category)) as ac, upper(trim(community_category)) as dc,
 case when income_applicant = 'parent' then parent_name else student_name end as provider from c),
r as (select case_id, 'Name' as field, case when doc_name is null then 'MISSING' when {sim_sql('student_name', 'doc_name')} >= 0.9 then 'MATCH' when {sim_sql('student_name', 'doc_name')} >= 0.75 then 'MINOR_DIFFERENCE' else 'MISMATCH' end as status from d
 union all select case_id, 'Date of Birth', case when doc_dob is null then 'MISSING' when {dashed_sql('dob')} = {dashed_sql('doc_dob')} then 'MATCH' else 'MISMATCH' end from d
 union all select case_id, 'Category', case when dc is null then 'MISSING' when ac = dc then 'MATCH' else 'MISMATCH' end from d
 union all select case_id, 'Family Income', case when income_value is null then 'MISSING' when income = income_value then 'MATCH' when income is not null and abs(income - income_value) * 1.0 / nullif(greatest(income, income_value), 0) <= 0.1 then 'MINOR_DIFFERENCE' else 'MISMATCH' end from d
 union all select case_id, 'Income Provider', case when income_applicant = 'parent' and (parent_name is null or income_name is null) then 'MISSING' when provider is null or income_name is null then null when {sim_sql('provider', 'income_name')} >= 0.75 then 'MATCH' else 'MISMATCH' end from d
 union all select case_id, 'Bank Account Holder', case when bank_holder is null then 'MISSING' when {sim_sql('student_name', 'bank_holder')} >= 0.75 then 'MATCH' else 'MISMATCH' end from d
 union all select case_id, 'State Domicile', case when state is not null and doc_state is not null then case when lower(state) = lower(doc_state) then 'MATCH' else 'MISMATCH' end end from d)
select * from r where status is not null""")
def application_vs_document(spark, base):
    return R.application_vs_document(cases(spark, base))


@job("missing_document_lists", "W3", sql=f"""with c as ({CASES}), s as (select *, row_number() over (order by ord) - 1 as scheme_no from ({duck_table(R.scheme_dimension(), _DIM)}) s0),
m as (select c.case_id, s.id as scheme_id, len(list_filter(string_split(c.uploads, ','), lambda x: x <> '')) as n_uploads,
 list_filter(s.required_labels, lambda l: len(list_filter(string_split(c.uploads, ','), lambda u: {satisfies_sql('lower(l)', 'lower(u)', False)})) = 0) as missing from c join s using (scheme_no))
select case_id, scheme_id, cast(len(missing) as integer) as n_missing, array_to_string(missing[1:4], ', ') as documents, cast(greatest(len(missing) - 4, 0) as integer) as more from m where n_uploads > 0 and len(missing) > 0""")
def missing_document_lists(spark, base):
    return R.missing_document_lists(cases(spark, base), F.lit(AS_OF).cast("date"))


def band_sql(x: str, bands) -> str:
    return "case " + " ".join(f"when {x} >= {b} then '{n}'" for b, n in bands if b is not None) + f" else '{bands[-1][1]}' end"


_STATED = "coalesce(nullif(trim(community_category), ''), nullif(trim(community_name), ''))"
_CATEGORY = "case " + " ".join(f"when lower({_STATED}) in ({quoted(ws)}) then '{k}'" for k, ws in C.CATEGORY_WORDS.items()) + f" else upper({_STATED}) end"


def _marks_sql(of: str) -> str:
    stated = f"try_cast(nullif(regexp_extract(trim(replace({of}_percentage, '%', '')), '^([0-9]+(?:\\.[0-9]+)?)', 1), '') as double)"
    derived = f"case when {of}_maximum > 0 then floor({of}_scored * 1.0::double / {of}_maximum * 100 + 0.5) end"
    x = f"case when {of}_percentage <> '' then {stated} else {derived} end"
    return f"regexp_replace(cast(cast(round({x}, 4) as decimal(14,4)) as varchar), '\\.?0+$', '') || '%'"


def _profile_sql() -> str:
    filled = lambda x: f"nullif(trim({x}), '')"
    conf = lambda x: f"coalesce({x}_conf, {R.DEFAULT_CONFIDENCE})"
    none = "cast(null as integer)"
    options = [
        ("name", "identity", filled("aadhaar_name"), 100), ("name", "ms10", filled("tenth_name"), conf("tenth")), ("name", "ms12", filled("twelfth_name"), conf("twelfth")),
        ("name", "community", filled("community_holder"), conf("community")), ("name", "income", filled("income_name"), conf("income")), ("name", "bank", filled("bank_holder"), 95),
        ("dob", "identity", filled("aadhaar_dob"), 100), ("dob", "ms10", filled("tenth_dob"), conf("tenth")), ("dob", "ms12", filled("twelfth_dob"), conf("twelfth")),
        ("community", "community", _CATEGORY, conf("community")), ("community", "entered", filled("category"), 100),
        ("income", "income", "case when income_value > 0 then cast(income_value as varchar) end", conf("income")), ("income", "entered", "case when income >= 0 then cast(income as varchar) end", 100),
        ("marks10", "ms10", _marks_sql("tenth"), conf("tenth")), ("marks12", "ms12", _marks_sql("twelfth"), conf("twelfth")),
        ("parent_name", "community", filled("community_father"), none), ("parent_name", "income", filled("income_father"), none), ("parent_name", "ms12", filled("twelfth_father"), none),
        ("parent_name", "ms10", filled("tenth_father"), none), ("state", "community", filled("community_state"), none), ("state", "income", filled("income_state"), none),
        ("state", "default", "'Tamil Nadu'", none), ("district", "community", filled("community_district"), none), ("district", "income", filled("income_district"), none)]
    rows = " union all ".join(f"select case_id, '{f}' as field, {i} as pr, {v} as value, '{s}' as source, {n} as confidence from c" for i, (f, s, v, n) in enumerate(options))
    return f"""with c as ({EVIDENCE}), o as ({rows}), b as (select * from o where value is not null qualify row_number() over (partition by case_id, field order by pr) = 1),
st as (select *, case when confidence is not null then {band_sql('confidence', PROFILE_BANDS)} end as status from b)
select case_id, field, case when status = 'untrusted' and field in ('name', 'dob', 'community', 'income') then null else value end as value, source, confidence, status from st
union all select case_id, unnest(['course', 'current_year']), null, null, 0, 'missing' from c"""


@job("profile_from_documents", "N9", "P9", sql=_profile_sql())
def profile_from_documents(spark, base):
    return R.profile_from_documents(evidence(spark, base))


@job("profile_warnings", "N9", sql=f"""with s as ({CONSISTENCY_SQL})
select case_id, 'danger' as severity, 'name' as field from s where name_status = 'red' union all select case_id, 'warning', 'name' from s where name_status = 'yellow'
union all select case_id, 'danger', 'dob' from s where dob_status = 'red' union all select case_id, 'warning', 'income' from s where income_status = 'MISMATCH'
union all select case_id, 'warning', 'community' from s where community_status = 'MISMATCH'""")
def profile_warnings(spark, base):
    return R.profile_warnings(consistency_score(spark, base))


def _age_sql(issue: str, months: int, name: str) -> str:
    return (f"coalesce({expiry_sql(issue, 'cast(null as varchar)', months)} = 'REQUIRES_REVIEW', false) as {name}_expired, "
            f"cast(floor(date_diff('day', {iso_sql(issue)}, date '{AS_OF}') / 30.44 + 0.5) as bigint) as {name}_months_old")


_LATER = ", ".join(f"coalesce(nullif(cast(twelfth_{f} as varchar), ''), nullif(cast(tenth_{f} as varchar), '')) as {f}" for f in ("scored", "percentage", "board", "register_number"))


@job("document_matrix", "N11", sql=f"""with c as (select *, list_filter([aadhaar_name, tenth_name, twelfth_name, bank_holder, bonafide_name], lambda x: x is not null) as names from ({EVIDENCE}) c0)
select case_id, aadhaar_name, tenth_name, twelfth_name, bank_holder, bonafide_name,
 case when len(names) > 1 and len(list_filter(names, lambda n: {sim_sql('names[1]', 'n')} < 0.75)) > 0 then 'MISMATCH' else 'MATCH' end as name_consistency, tenth_dob, aadhaar_dob,
 case when coalesce({dashed_sql('tenth_dob')} <> {dashed_sql('aadhaar_dob')}, false) then 'MISMATCH' else 'MATCH' end as dob_consistency,
 gender as profile_gender, aadhaar_gender, case when gender is null or aadhaar_gender is null then 'UNCONFIRMED' when lower(gender) = lower(aadhaar_gender) then 'MATCH' else 'MISMATCH' end as gender_consistency,
 tenth_year, twelfth_year, {_LATER},
 coalesce(doc_course, course) as course, coalesce(doc_institution, institution) as institution, community_name as community, community_category as category, disability_percentage, first_graduate,
 case when first_graduate_cert then 'certificate' else 'entered' end as first_graduate_source, {_age_sql('community_issue_date', 60, 'community')}, income_value as income_amount, income_year,
 case when income_applicant = 'parent' then coalesce(parent_name, 'Parent') else coalesce(student_name, 'Student') end as income_provider, income_applicant as income_provider_role,
 income_name as income_certificate_name, income_cert_number, income_issue_date, {_age_sql('income_issue_date', 12, 'income')},
 ifsc, regexp_matches(upper(trim(ifsc)), '{R.IFSC}') as ifsc_valid, coalesce(account_type, 'Savings') as account_type, aadhaar_bank_linked, coalesce(state, doc_state) as state,
 coalesce(district, doc_district) as district, coalesce(domicile, state) as domicile from c""")
def document_matrix(spark, base):
    return R.document_matrix(evidence(spark, base), F.lit(AS_OF).cast("date"))
