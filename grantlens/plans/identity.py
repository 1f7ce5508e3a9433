"""Jobs over the documents of a case."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.functions import categories as C, names as N

from grantlens.operators import identity as I, passes as P
from grantlens.plans.registry import job
from grantlens.plans.views import AS_OF, CASE_DOCUMENTS, CASE_FACTS, PASS_FIELDS, PASS_KIND, PASSES, PROVIDERS, case_documents, case_facts, pass_fields, passes, providers
from grantlens.plans.sqltext import quoted

_EDGE = ".,\\-_/\\\\#;:''\""


def name_key_sql(x: str) -> str:
    real = f"(case when trim({x}) not in ('', 'null') then trim({x}) end)"
    bare = f"trim(regexp_replace({real}, '(?i)^(?:(?:{N.HONORIFICS})(?:\\.|\\b)\\s*)+', ''))"
    clean = f"trim(regexp_replace(regexp_replace(regexp_replace({bare}, '^[:\\-–—.]\\s*', ''), '[^a-zA-Z0-9\\s.''\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    tokens = f"list_filter(list_transform(string_split(lower({clean}), ' '), lambda t: regexp_replace(regexp_replace(t, '^[{_EDGE}]+', ''), '[{_EDGE}]+$', '')), lambda t: t <> '')"
    return f"nullif(array_to_string({tokens}, ' '), '')"


def _align_sql(tokens: str, pool: str, fits: str) -> str:
    """Greedy alignment; `fits` is a condition over t (token) and o (candidate)."""
    near = fits.replace("{t}", "x.rest[1]").replace("{o}", "o")
    drop = lambda at, loose: (
        f"{{'rest': list_filter(acc.rest, lambda v, i: i <> {at}), 'hits': acc.hits + 1, 'loose': acc.loose + {loose}}}")
    exact_at = "coalesce(list_position(acc.rest, x.rest[1]), 0)"
    near_at = f"coalesce(list_position(list_transform(acc.rest, lambda o: {near}), true), 0)"
    return (f"list_reduce(list_transform({tokens}, lambda t: {{'rest': [t], 'hits': 0, 'loose': 0}}), "
            f"lambda acc, x: case when {exact_at} > 0 then {drop(exact_at, 0)} when {near_at} > 0 then {drop(near_at, 1)} else acc end, "
            f"{{'rest': {pool}, 'hits': 0, 'loose': 0}})")


_INITIAL = "(length({s}) = 1 and length({l}) > 1 and starts_with({l}, {s}))"
_TO = _INITIAL.replace("{s}", "{t}").replace("{l}", "{o}")
_OT = _INITIAL.replace("{s}", "{o}").replace("{l}", "{t}")


def compared_sql(pairs: str) -> str:
    """SELECT over a relation with a_value, b_value, is_strict (and any key columns), adding status and score."""
    t = f"""(select *, string_split(a_value, ' ') as ta, string_split(b_value, ' ') as tb from {pairs})"""
    t = f"""(select *, case when len(ta) <= len(tb) then ta else tb end as ts, case when len(ta) <= len(tb) then tb else ta end as tl,
 list_sort(list_filter(ta, lambda x: length(x) > 1)) as wa, list_sort(list_filter(tb, lambda x: length(x) > 1)) as wb,
 len(list_filter(ta, lambda x: length(x) = 1)) > 0 as ia, len(list_filter(tb, lambda x: length(x) = 1)) > 0 as ib from {t} t1)"""
    t = f"""(select *, {_align_sql('ta', 'tb', f'({_TO} or {_OT})')} as ex,
 {_align_sql('ts', 'tl', f'({_TO} or (length({{t}}) >= 4 and length({{o}}) >= 4 and levenshtein({{t}}, {{o}}) <= 1))')} as co from {t} t2)"""
    t = f"""(select *, case when a_value is null or b_value is null or a_value = '' or b_value = '' then null when a_value = b_value then 1 when list_sort(ta) = list_sort(tb) then 2
 when len(wa) > 0 and wa = wb and ia <> ib then 3 when len(ta) = len(tb) and ex.hits = len(ta) and ex.loose > 0 then 4
 when co.hits = len(ts) and len(ts) < len(tl) then 5 else 6 end as lvl,
 1 - levenshtein(a_value, b_value) * 1.0 / greatest(length(a_value), length(b_value), 1) as sim from {t} t3)"""
    return f"""(select *, case when lvl is null then 'MISSING' when lvl <= 2 then 'EXACT_MATCH' when lvl = 3 then case when is_strict then 'LIKELY_MATCH' else 'EXACT_MATCH' end
 when lvl = 4 then 'LIKELY_MATCH' when lvl = 5 then 'NEEDS_REVIEW' when sim >= 0.85 then case when is_strict then 'MINOR_DIFFERENCE' else 'LIKELY_MATCH' end
 else 'MISMATCH' end as status,
 cast(case when lvl is null then 0 when lvl = 1 then 1 when lvl = 2 then 0.98 when lvl = 3 then case when is_strict then 0.92 else 0.95 end when lvl = 4 then 0.9 when lvl = 5 then 0.65
 when sim >= 0.85 and is_strict then least(sim, 0.9) else greatest(sim, 0) end as double) as score from {t} t4)"""


_SLOTS = quoted(I.SLOTS)
_STRICT = quoted(I.STRICT_SLOTS)
# The first document with a name, or with a date, of every slot.
_DOCS = f"""alldocs as (select *, {name_key_sql('name')} as k, {name_key_sql('parent_name')} as pk, list_position([{_SLOTS}], doc_type) as slot from ({CASE_DOCUMENTS}) d),
docs as (select * from alldocs where doc_type in ({_SLOTS}) and k is not null qualify row_number() over (partition by case_id, doc_type order by ord) = 1),
dated as (select * from alldocs where doc_type in ({_SLOTS}) and dob is not null qualify row_number() over (partition by case_id, doc_type order by ord) = 1)"""


def _pairs(strict: str = f"a.doc_type in ({_STRICT}) or b.doc_type in ({_STRICT})") -> str:
    return f"""{_DOCS}, pairs as (select a.case_id, a.doc_type as a_doc, b.doc_type as b_doc, a.k as a_value, b.k as b_value, ({strict}) as is_strict
 from docs a join docs b on a.case_id = b.case_id and a.slot < b.slot where a.k is not null and b.k is not null),
distinct_pairs as (select distinct a_value, b_value, is_strict from pairs),
judged as (select a_value, b_value, is_strict, status, score from {compared_sql('distinct_pairs')} c),
compared as (select p.*, j.status, j.score from pairs p join judged j using (a_value, b_value, is_strict))"""


@job("pairwise_names", "J7", "N1", sql=f"with {_pairs()} select case_id, a_doc, b_doc, is_strict, status, round(score, 4) as score from compared")
def pairwise_names(spark, base):
    return I.pairwise_names(case_documents(spark, base)).withColumn("score", F.round("score", 4))


def iso_sql(x: str) -> str:
    d = f"regexp_replace(trim({x}), '[/.]', '-', 'g')"
    return (f"(case when regexp_matches({d}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') then cast(try_strptime({d}, '%d-%m-%Y') as date) "
            f"when regexp_matches({d}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') then cast(try_strptime({d}, '%Y-%m-%d') as date) end)")


def dob_sql(a: str, b: str) -> str:
    return (f"case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 'MISSING' when {iso_sql(a)} is null or {iso_sql(b)} is null then 'UNREADABLE' "
            f"when {iso_sql(a)} = {iso_sql(b)} then 'MATCH' else 'MISMATCH' end")


@job("dates_against_reference", "J8", "N3", "C3", sql=f"""with {_DOCS}
select d.case_id, d.doc_type, d.dob, case when coalesce(trim(r.dob), '') = '' then 'grey' else {dob_sql('d.dob', 'r.dob')} end as status
from dated d left join dated r on r.case_id = d.case_id and r.doc_type = 'identity'
where d.doc_type in ({quoted(I.DATED_SLOTS)})""")
def dates_against_reference(spark, base):
    return I.compare_to_reference(case_documents(spark, base))


_ROLLUP = f"""select case_id, bool_or(status = 'MISMATCH') as bad, bool_or(status in ({quoted(I.MINOR_STATUSES)})) as minor from compared group by 1"""


@job("name_consistency", "A5", sql=f"""with {_pairs()}, v as ({_ROLLUP}), n as (select a.case_id, count(distinct d.doc_type) as n_names from (select distinct case_id from alldocs) a left join docs d using (case_id) group by 1)
select n.case_id, n_names, case when n_names < 2 then 'grey' when bad then 'red' when minor then 'yellow' else 'green' end as name_status from n left join v using (case_id)""")
def name_consistency(spark, base):
    return I.name_consistency(case_documents(spark, base))


def freshness_sql(issue: str, upto: str) -> str:
    end, got, now = iso_sql(upto), iso_sql(issue), f"date '{AS_OF}'"
    return (f"case when {end} < {now} then 'expired' when date_diff('day', {now}, {end}) / 30.0 < 1 then 'warning' when {end} is not null then 'valid' "
            f"when date_diff('day', {got}, {now}) / 30.0 > 12 then 'expired' when date_diff('day', {got}, {now}) / 30.0 > 6 then 'warning' "
            f"when {got} is not null then 'valid' else 'unknown' end")


def expiry_sql(issue: str, upto: str, months: int) -> str:
    end, got, now = iso_sql(upto), iso_sql(issue), f"date '{AS_OF}'"
    return (f"case when {now} > {end} then 'EXPIRED' when {end} is not null then 'VALID' when date_diff('day', {got}, {now}) / 30.44 > {months} then 'REQUIRES_REVIEW' "
            f"when {got} is not null then 'VALID' else 'UNKNOWN' end")


@job("income_freshness", "N4", sql=f"select case_id, {freshness_sql('issue_date', 'valid_upto')} as freshness from ({CASE_FACTS}) f")
def income_freshness(spark, base):
    as_of = F.lit(AS_OF).cast("date")
    return case_facts(spark, base).select("case_id", I.income_freshness(as_of, F.col("issue_date"), F.col("valid_upto")).alias("freshness"))


@job("certificate_expiry", "N4b", sql=f"""select case_id, {expiry_sql('issue_date', 'valid_upto', 12)} as income_validity, {expiry_sql('issue_date', 'cast(null as varchar)', 60)} as community_validity
from ({CASE_FACTS}) f""")
def certificate_expiry(spark, base):
    as_of, issue = F.lit(AS_OF).cast("date"), F.col("issue_date")
    return case_facts(spark, base).select(
        "case_id", I.certificate_expiry(as_of, issue, F.col("valid_upto"), 12).alias("income_validity"),
        I.certificate_expiry(as_of, issue, F.lit(None).cast("string"), 60).alias("community_validity"))


def income_sql(x: str) -> str:
    s = f"regexp_replace(trim({x}), '(?i)(?:₹|Rs\\.?|R\\.|Re\\.?|INR|Rupees?)', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '/\\s*-\\s*$', ''), '\\.\\d{{1,2}}\\s*$', '')"
    digits = f"regexp_replace({s}, '[^\\d]', '', 'g')"
    return f"(case when {x} is null or regexp_matches(trim({x}), '^\\s*-\\s*\\d') or {digits} = '' then null when try_cast({digits} as bigint) <= 100000000 then try_cast({digits} as bigint) end)"


def community_sql(x: str) -> str:
    raw = f"lower(trim({x}))"
    inner = f"upper(trim(regexp_extract({raw}, '\\(([^)]+)\\)', 1)))"
    direct = " ".join(f"when {raw} = '{k}' then '{v}'" for k, v in C.COMMUNITY_CODES.items())
    phrases = " ".join(f"when contains({raw}, '{p}') then '{v}'" for p, v in C.COMMUNITY_PHRASES)
    return f"nullif(case {direct} when {inner} = 'GEN' then 'General' when {inner} in ({quoted(C.COMMUNITY_IN_BRACKETS)}) then {inner} {phrases} else trim({x}) end, '')"


def _two(a: str, b: str, equal: str) -> str:
    return f"case when {a} is null and {b} is null then 'MISSING' when {a} is null or {b} is null then 'WARNING' when {a} = {b} then {equal} else 'MISMATCH' end"


_FACTS = f"""facts as (select *, {income_sql('income_certificate')} as inc_c, {income_sql('income_stated')} as inc_s, {community_sql('community_certificate')} as com_c,
 {community_sql('community_stated')} as com_s, {freshness_sql('issue_date', 'valid_upto')} as freshness from ({CASE_FACTS}) f0),
checked as (select *, {_two('inc_c', 'inc_s', "case when freshness = 'expired' then 'EXPIRED' else 'MATCH' end")} as income_status, {_two('com_c', 'com_s', "'MATCH'")} as community_status from facts)"""


@job("income_and_community", "N5", "N6", "C5", "C7", sql=f"with {_FACTS} select case_id, inc_c as income_certificate, com_c as community, income_status, community_status from checked")
def income_and_community(spark, base):
    from grantlens.functions.money import parse_income

    as_of = F.lit(AS_OF).cast("date")
    f = case_facts(spark, base).withColumn("freshness", I.income_freshness(as_of, F.col("issue_date"), F.col("valid_upto")))
    return f.select(
        "case_id", parse_income(F.col("income_certificate")).alias("income_certificate"), C.normalize_community(F.col("community_certificate")).alias("community"),
        I.compare_income(F.col("income_certificate"), F.col("income_stated"), F.col("freshness")).alias("income_status"),
        I.compare_community(F.col("community_certificate"), F.col("community_stated")).alias("community_status"))


_OVERRIDE = f"""{_pairs()}, {_FACTS},
overridden as (select c.case_id, c.a_doc, c.b_doc, case when f.income_applicant = 'parent' and (a_doc = 'income' or b_doc = 'income') then 'NEEDS_REVIEW' else status end as status,
 f.income_applicant = 'parent' and (a_doc = 'income' or b_doc = 'income') as parent_name_used from compared c join facts f using (case_id))"""


@job("parent_income_override", "N7", sql=f"with {_OVERRIDE} select * from overridden")
def parent_income_override(spark, base):
    pairs = I.pairwise_names(case_documents(spark, base)).join(case_facts(spark, base).select("case_id", "income_applicant"), "case_id")
    return I.parent_income_override(pairs).select("case_id", "a_doc", "b_doc", "status", "parent_name_used")


@job("parent_income_check", "N7", sql=f"""with c as (select case_id, income_applicant = 'parent' as by_parent, coalesce(nullif(trim(parent_name), ''), nullif(trim(father_name), ''), nullif(trim(mother_name), '')) as parent,
 nullif(trim(income_name), '') as holder from ({PROVIDERS}) x),
k as (select *, {name_key_sql('parent')} as a_value, {name_key_sql('holder')} as b_value, false as is_strict from c),
apart as (select distinct a_value, b_value, is_strict from k where by_parent and parent is not null and holder is not null),
judged as (select a_value, b_value, status, score from {compared_sql('apart')} j)
select case_id, case when by_parent then 'SKIPPED' else 'CHECKED' end as student_name_match, by_parent as parent_name_used, case when ok then status end as match, case when ok then round(score, 4) end as score,
 coalesce(ok and status in ('MATCH', 'EXACT_MATCH'), false) as consistent
from (select k.*, by_parent and parent is not null and holder is not null as ok, status, score from k left join judged j on k.a_value is not distinct from j.a_value and k.b_value is not distinct from j.b_value) y""")
def parent_income_check(spark, base):
    return I.parent_income_check(providers(spark, base)).withColumn("score", F.round("score", 4))


CONSISTENCY_SQL = f"""with {_OVERRIDE},
v as (select case_id, bool_or(status = 'MISMATCH') as bad, bool_or(status in ({quoted(I.MINOR_STATUSES)})) as minor from overridden group by 1),
n as (select a.case_id, count(distinct d.doc_type) as n_names from (select distinct case_id from alldocs) a left join docs d using (case_id) group by 1),
dob as (select d.case_id, bool_or(st = 'MISMATCH') as dbad, bool_or(st = 'MATCH') as dok from (select d.case_id, {dob_sql('d.dob', 'r.dob')} as st from dated d join dated r on r.case_id = d.case_id and r.doc_type = 'identity' where d.doc_type in ({quoted(I.DATED_SLOTS)})) d group by 1),
s as (select c.*, case when coalesce(n_names, 0) < 2 then 'grey' when bad then 'red' when minor then 'yellow' else 'green' end as name_status,
 case when dbad then 'red' when dok then 'green' else 'grey' end as dob_status from checked c left join n using (case_id) left join v using (case_id) left join dob using (case_id)),
p as (select *, case name_status when 'green' then 30 when 'yellow' then 20 else 0 end + case dob_status when 'green' then 20 else 0 end
 + case when income_status = 'MATCH' and freshness in ('valid', 'unknown') then 20 when income_status = 'MATCH' and freshness = 'warning' then 15 else 0 end
 + case when community_status = 'MATCH' then 15 else 0 end + case when account_type = 'Single' then 15 else 0 end as points from s)
select case_id, name_status, dob_status, income_status, community_status, freshness, points,
 case when name_status = 'red' or dob_status = 'red' or coalesce(account_type = 'Joint', false) or income_status = 'EXPIRED' or community_status = 'MISMATCH' then 'Issues Found — Correction Required'
 when points >= 85 then 'High Consistency — Ready for Official Application' when points >= 60 then 'Moderate Consistency — Review Warnings' else 'Needs Review' end as readiness from p"""


@job("consistency_score", "A6", sql=CONSISTENCY_SQL)
def consistency_score(spark, base):
    return I.consistency_score(case_facts(spark, base), case_documents(spark, base), F.lit(AS_OF).cast("date"))


def _a7(value: str, name: str) -> str:
    """CTEs: distinct names of a case, their pairs, and the verdict per case."""
    return f"""{name}_names as (select case_id, {value} as v, min(ord) as seen from valid where {value} is not null group by all),
{name}_pairs as (select a.case_id, a.v as a_value, b.v as b_value, false as is_strict from {name}_names a join {name}_names b on a.case_id = b.case_id and (a.seen < b.seen or a.seen = b.seen and a.v < b.v)),
{name}_apart as (select distinct a_value, b_value, is_strict from {name}_pairs),
{name}_judged as (select a_value, b_value, status from {compared_sql(f'{name}_apart')} c),
{name}_v as (select case_id, bool_or(status = 'MISMATCH') as bad, bool_or(status in ({quoted(I.MINOR_STATUSES)})) as minor from {name}_pairs join {name}_judged using (a_value, b_value) group by 1)"""


def _label(bad: str, minor: str, enough: str) -> str:
    return f"case when not ({enough}) then 'INSUFFICIENT DATA' when {bad} then 'SIGNIFICANT CONFLICT' when {minor} then 'MINOR DIFFERENCE' else 'CONSISTENT' end"


_READABLE = "case when lower(trim({x})) not in ('null', 'not_detected', '') then trim({x}) end"


@job("cross_document_status", "A7", sql=f"""with base as (select case_id, ord, dob, {_READABLE.format(x='name')} as name, {_READABLE.format(x='parent_name')} as parent_name from ({CASE_DOCUMENTS}) d),
valid as (select *, case when name is not null then coalesce({name_key_sql('name')}, '') end as nk, case when parent_name is not null then coalesce({name_key_sql('parent_name')}, '') end as pk
 from base where name is not null or trim(dob) <> ''),
{_a7('nk', 'n')}, {_a7('pk', 'p')},
f as (select case_id, count(*) as n_docs, count(name) as n_names, count(dob) as n_dobs, count(parent_name) as n_parents, count(distinct {iso_sql('dob')}) > 1 as dbad from valid group by 1),
j as (select f.*, coalesce(n.bad, false) or dbad or coalesce(p.bad, false) as bad, coalesce(n.minor, false) or coalesce(p.minor, false) as minor, coalesce(p.bad, false) as pbad,
 coalesce(p.minor, false) as pminor, n_docs >= 2 and n_names >= 2 as enough from f left join n_v n using (case_id) left join p_v p using (case_id))
select case_id, n_docs as document_count, {_label('bad', 'minor', 'enough')} as status, {_label('bad', 'minor', 'enough')} as name_status,
 case when enough and dbad then 'SIGNIFICANT CONFLICT' when enough and n_dobs >= 2 then 'CONSISTENT' else 'INSUFFICIENT DATA' end as dob_status,
 case when enough and pbad then 'SIGNIFICANT CONFLICT' when enough and pminor then 'MINOR DIFFERENCE' when enough and n_parents >= 2 then 'CONSISTENT' else 'INSUFFICIENT DATA' end as parent_status from j""")
def cross_document_status(spark, base):
    return I.cross_document_status(case_documents(spark, base))


_KEYED = f"""m as (select case_id, ord, trim(name) as raw, translate(trim(name), '0158', 'OISB') as cleaned, regexp_matches(trim(name), '\\d') as digits from ({CASE_DOCUMENTS}) d where name is not null),
mk as (select *, regexp_replace(upper(cleaned), '[^A-Z]', '', 'g') as k from m where length(regexp_replace(upper(cleaned), '[^A-Z]', '', 'g')) >= 3),
keys as (select case_id, k, count(*) as n, min(ord) as first_ord, bool_or(digits) as any_digits, arg_min(raw, ord) filter (not digits) as clean_raw, arg_min(cleaned, ord) as first_cleaned, arg_min(digits, ord) as first_digits from mk group by 1, 2),
best as (select * from (select *, row_number() over (partition by case_id order by n desc, first_ord) as rn, sum(n) over (partition by case_id) as total from keys) where rn = 1)"""


@job("name_consensus", "A8", sql=f"""with {_KEYED},
c as (select b.case_id, bool_or(x.k <> b.k and levenshtein(x.k, b.k) > 2) as has_conflict from best b join keys x using (case_id) group by 1)
select b.case_id, coalesce(clean_raw, first_cleaned) as consensus_name, case when has_conflict then 'NEEDS_REVIEW' when n >= 2 then case when any_digits then 'NEEDS_REVIEW' else 'HIGH_CONFIDENCE' end
 when first_digits then 'NEEDS_REVIEW' else 'HIGH_CONFIDENCE' end as status, cast(case when has_conflict then 60 when n >= 2 then least(98, 85 + 4 * n) when first_digits then 68 else 80 end as integer) as confidence,
 n as agreements, cast(total as bigint) as total_documents, has_conflict from best b join c using (case_id)""")
def name_consensus(spark, base):
    return I.name_consensus(case_documents(spark, base))


@job("stable_mode_of_names", "W7", sql=f"""with c as (select case_id, name, count(*) as n, min(ord) as first_seen from ({CASE_DOCUMENTS}) d where name is not null group by 1, 2)
select case_id, name, n, first_seen from (select *, row_number() over (partition by case_id order by n desc, first_seen) as rn from c) where rn = 1""")
def stable_mode_of_names(spark, base):
    return I.stable_mode(case_documents(spark, base), ["case_id"], "name", "ord")


@job("reconciled_passes", "A9", sql=f"""with p as ({PASSES}),
k as (select *, count(*) over (partition by doc_id, regexp_replace(lower(name), '[^a-z]', '', 'g')) as n from p where name is not null),
t as (select *, round(name_conf + case when n >= 2 then 0.2 else 0 end, 6) as total from k),
nm as (select * from (select *, row_number() over (partition by doc_id order by total desc, pass_no) as rn from t) where rn = 1),
r as (select doc_id, count(*) as n_passes, arg_max(marks, marks_conf * 1000000 - pass_no) filter (marks is not null) as marks, arg_max(school, school_conf * 1000000 - pass_no) filter (school is not null) as school,
 arg_min(dob, pass_no) filter (dob is not null) as dob, arg_min(register_number, pass_no) filter (register_number is not null) as register_number from p group by 1)
select r.doc_id, n_passes, nm.name, round(least(0.98, nm.total), 2) as name_confidence, marks, school, dob, register_number from r left join nm using (doc_id)""".replace("r.doc_id, n_passes, nm.name", "r.doc_id, r.n_passes, nm.name").replace(", marks, school, dob, register_number from r left", ", r.marks, r.school, r.dob, r.register_number from r left"))
def reconciled_passes(spark, base):
    return I.reconcile_passes(passes(spark, base))


def _reconciled_sql() -> str:
    sheet, group = f"kind in ({quoted(P.MARKSHEETS)})", quoted(P.MARKS_GROUP)
    rows = " union all ".join(f"select doc_id, kind, pass_no, '{f}' as field, nullif({v}, '') as value, cast({c} as double) as confidence from p" for f, (v, c) in PASS_FIELDS.items())
    return f"""with p as (select *, {PASS_KIND} as kind from ({PASSES}) x),
r as (select * from ({rows}) y where value is not null), d as (select doc_id, min(pass_no) as base, max(pass_no) as last from p group by 1),
n as (select *, coalesce(confidence, {P.NAME_DEFAULT}) as c0, count(*) over (partition by doc_id, regexp_replace(lower(value), '[^a-z]', '', 'g')) as n from r where field = 'name'),
nt as (select *, round(c0 + case when n >= 2 then {P.AGREEMENT_BONUS} else 0 end, 6) as total from n),
nw as (select nt.*, base, last from nt join d using (doc_id) qualify row_number() over (partition by doc_id order by total desc, pass_no) = 1),
b as (select r.*, base, case field when 'marks' then {P.MARKS_DEFAULT} else {P.SCHOOL_DEFAULT} end as unknown, min(pass_no) over (partition by doc_id, field) as first_read
 from r join d using (doc_id) where {sheet} and field in ('marks', 'school')),
bw as (select * from b qualify row_number() over (partition by doc_id, field order by case when confidence is not null then confidence when pass_no <> first_read then -1 when pass_no = base then 0 else unknown end desc, pass_no) = 1),
source as (select d.doc_id, coalesce(w.pass_no, d.base) as pass_no from d left join (select * from bw where field = 'marks') w using (doc_id)),
f as (select * from r where field <> 'name' and (not {sheet} or field in ({quoted(P.FILLED_FIELDS)})) qualify row_number() over (partition by doc_id, field order by pass_no) = 1)
select doc_id, kind, field, value, case when last > base then least({P.MOST_NAME_CONFIDENCE}, round(total, 2)) else confidence end as confidence, pass_no from nw
union all select doc_id, kind, field, value, coalesce(confidence, case when pass_no <> base then unknown end), pass_no from bw
union all select doc_id, kind, field, value, confidence, pass_no from r join source using (doc_id, pass_no) where {sheet} and field in ({group})
union all select doc_id, kind, field, value, confidence, pass_no from f
union all select doc_id, kind, field, value, confidence, pass_no from r join d using (doc_id) where {sheet} and field not in ('name', 'marks', 'school', {group}, {quoted(P.FILLED_FIELDS)}) and pass_no = base"""


@job("reconciled_fields", "A9", sql=_reconciled_sql())
def reconciled_fields(spark, base):
    return P.reconcile_fields(pass_fields(spark, base))


@job("pass_consensus", "A10", sql=f"""with p as ({PASSES}),
k as (select *, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') as k from p where name is not null),
g as (select doc_id, k, count(*) as n, min(pass_no) as fp, max(engine_conf) as top, arg_max(name, engine_conf * 1000 - pass_no) as name from k group by 1, 2),
b as (select *, row_number() over (partition by doc_id order by n desc, fp) as rn, sum(n) over (partition by doc_id) as total from g),
d as (select distinct doc_id from p),
j as (select d.doc_id, coalesce(total, 0) as total, name, top, coalesce(not (total >= 2 and n = 1) and (n >= 2 or top >= 75), false) as ok from d left join b on b.doc_id = d.doc_id and b.rn = 1)
select doc_id, cast(total as bigint) as n_candidates, case when ok then name end as name, case when not ok then 'NOT_DETECTED' when top >= 75 then 'HIGH_CONFIDENCE' else 'NEEDS_REVIEW' end as status from j""")
def pass_consensus(spark, base):
    return I.pass_consensus(passes(spark, base))


@job("normalized_names", "C1", "C2", sql=f"""with d as (select distinct name from ({CASE_DOCUMENTS}) d where name is not null), k as (select name, {name_key_sql('name')} as name_key from d)
select name, name_key, array_to_string(list_sort(string_split(name_key, ' ')), ' ') as sorted_key from k""")
def normalized_names(spark, base):
    d = case_documents(spark, base).filter("name is not null").select("name").distinct()
    key = I.name_key(F.col("name"))
    return d.select("name", key.alias("name_key"), F.array_join(F.array_sort(F.split(key, " ")), " ").alias("sorted_key"))


