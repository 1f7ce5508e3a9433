"""Jobs between applicants and the scheme catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.functions import categories as C
from grantlens.functions.text import re2
from grantlens.operators import catalogues as K, eligibility as E, profiles as P
from grantlens.plans.registry import job
from grantlens.plans.sqltext import duck_table, quoted, status_sql
from grantlens.plans.views import APPLICANTS, FORMS, UPLOADS, applicants, forms, uploads
from grantlens.rules import corpus as Q
from grantlens.rules.metadata import ACADEMIC_YEAR, DEFAULT_PURPOSE, checklist_rows, metadata_rows
from grantlens.rules.schemes import MINORITY_FORM_LABELS, catalogue_a, catalogue_b
from grantlens.session import table
from grantlens.sources import catalogue as S

META_SQL = duck_table(metadata_rows(), S.METADATA_TYPES)
CHECK_SQL = duck_table(checklist_rows(), S.CHECKLIST_TYPES)
A_SQL = duck_table(catalogue_a(), S.CATALOGUE_A_TYPES)
B_SQL = duck_table(catalogue_b(), S.CATALOGUE_B_TYPES)


def case_sql(pairs, test, default="null"):
    return "case " + " ".join(f"when {test(k)} then '{v}'" for v, k in pairs) + f" else {default} end"


def rx(expr, pattern):
    return f"regexp_matches({expr}, '{re2(pattern)}')"


def _words_sql(expr, words, default="null"):
    return "case " + " ".join(f"when lower(trim({expr})) in ({quoted(ws)}) then '{code}'" for code, ws in words.items()) + f" else {default} end"


_STATE = case_sql(C.STATE_PATTERNS, lambda p: rx("lower(trim(state))", p),
                  "case " + " ".join(f"when lower(trim(state)) = '{s.lower()}' then '{s}'" for s in C.STATES) + " else state end")
_COURSE = case_sql(C.COURSE_PATTERNS, lambda p: rx("lower(coalesce(level, ''))", p), "'All'")


@job("standardized_profiles", "P1", "C11", sql=f"""with f as (select *, cast(null as varchar) as level from ({FORMS}) f0)
select applicant_id, student_name, {_words_sql('community', C.CATEGORY_WORDS)} as category,
 {_words_sql('community', C.COMMUNITY_WORDS, 'lower(trim(community))')} as community,
 nullif(case when nullif(course, '') is not null then course else {_COURSE} end, 'All') as course,
 coalesce(level, {case_sql(C.LEVEL_PATTERNS, lambda p: rx("lower(nullif(course, ''))", p))}) as level,
 case when nullif(gender, '') is null then null else {case_sql(C.GENDER_PATTERNS, lambda p: rx('lower(gender)', p))} end as gender,
 case when nullif(state, '') is not null then {_STATE} when nullif(district, '') is not null and district <> 'All' then 'Tamil Nadu' end as state,
 nullif(district, 'All') as district, income,
 case armed_forces when 'yes' then true when 'no' then false end as armed_forces,
 case when first_graduate in ('yes', 'true') then true when first_graduate in ('no', 'false') then false end as first_graduate,
 case when quota_type in ('government', 'management') then quota_type else 'unknown' end as quota_type
from f""")
def standardized_profiles(spark, base):
    out = P.standardize_profiles(forms(spark, base))
    return out.select("applicant_id", "student_name", "category", "community", "course", "level", "gender", "state", "district",
                      "income", "armed_forces", "first_graduate", "quota_type")


@job("form_profiles", "P2", sql=f"""select applicant_id, student_name, 'student' as income_applicant,
 case when quota_type in ('government', 'management') then quota_type else 'unknown' end as quota_type, community, community as category, income,
 nullif(course, '') as course, coalesce(nullif(gender, ''), 'All') as gender, coalesce(state, 'Tamil Nadu') as state,
 coalesce(district, 'All') as district, coalesce(armed_forces, 'no') as armed_forces from ({FORMS}) f""")
def form_profiles(spark, base):
    out = P.form_defaults(forms(spark, base).drop("first_graduate"))
    return out.drop("parent_name", "first_graduate")


_MATCH = f"""forms as ({FORMS}), b as ({B_SQL}),
f as (select *, case when upper(trim(community)) in ({quoted(MINORITY_FORM_LABELS)}) then 'MIN' else upper(trim(community)) end as comm,
 lower(trim(coalesce(course, ''))) as crs from forms),
m as (select f.*, b.id as b_id, b.amount_type, b.amount_min, b.amount_max, b.amount_ug, b.amount_pg, b.amount_boys from f join b
 on list_contains(b.communities, f.comm) and f.income <= b.max_income and (f.crs = '' or list_contains(b.courses, f.crs))
 and (b.special_condition is null or f.armed_forces = 'yes')),
w as (select *, case amount_type when 'tiered' then case when course = 'pg' then amount_pg else amount_ug end when 'fixed' then amount_boys
 when 'full' then amount_min else cast(floor((amount_min + amount_max) / 2.0 + 0.5) as integer) end as base_amount from m)"""


@job("matched_schemes", "J2", sql=f"with {_MATCH} select applicant_id, b_id from m")
def matched_schemes(spark, base):
    return K.match_schemes(forms(spark, base)).select("applicant_id", "b_id")


@job("award_amounts", "P4", sql=f"""with {_MATCH}
select b_id, amount_type, base_amount, count(*) as n_applicants, cast(sum(base_amount) as bigint) as total_amount from w group by all""")
def award_amounts(spark, base):
    return K.award_amounts(K.match_schemes(forms(spark, base))).groupBy("b_id", "amount_type", "base_amount").agg(
        F.count(F.lit(1)).alias("n_applicants"), F.sum("base_amount").alias("total_amount"))


@job("award_projection", "P5", sql=f"""with {_MATCH},
y as (select *, coalesce(case current_year when '1st' then 4 when '2nd' then 3 when '3rd' then 2 when '4th' then 1 end, 4) as remaining_years,
 coalesce(case current_year when '1st' then 1 when '2nd' then 2 when '3rd' then 3 when '4th' then 4 end, 1) as cur from w)
select applicant_id, b_id, year_no, case when year_no >= cur then base_amount end as year_amount, year_no = cur as is_current,
 remaining_years, base_amount * remaining_years as remaining_amount, base_amount * 4 as total_amount
from y cross join (values (1), (2), (3), (4)) t(year_no)""")
def award_projection(spark, base):
    out = K.award_projection(K.award_amounts(K.match_schemes(forms(spark, base))))
    return out.select("applicant_id", "b_id", "year_no", "year_amount", "is_current", "remaining_years", "remaining_amount", "total_amount")


@job("linked_catalogues", "J3", sql=f"""with {status_sql()}, {_MATCH},
r as (select *, row_number() over (partition by applicant_id order by status_rank desc, score desc, scheme_ord) as pos from results),
c as (select m.applicant_id, m.b_id, r.scheme_id, r.status, r.score, cast(r.pos as integer) as position,
 row_number() over (partition by m.applicant_id, m.b_id order by r.pos) as rn
 from m join b on m.b_id = b.id join r on r.applicant_id = m.applicant_id
 and (r.scheme_id = b.id or lower(r.scheme_name) = lower(b.name) or (contains(r.scheme_name, 'BC') and b.id = 'tn-bc-mbc')))
select m.applicant_id, m.b_id, c.scheme_id, c.status, c.score, c.position from m left join c on c.applicant_id = m.applicant_id and c.b_id = m.b_id and c.rn = 1""")
def linked_catalogues(spark, base):
    return K.link_catalogues(K.match_schemes(forms(spark, base)), E.rank_schemes(applicants(spark, base)))


_TERMS = f"""select coalesce(state, '') as term, case applicant_id % 4 when 0 then 'All' when 1 then 'Central / NSP' when 2 then 'Tamil Nadu' else 'Other States' end as bucket,
 count(*) as n from ({APPLICANTS}) a group by 1, 2"""


@job("scheme_search", "P3", sql=f"""with s as ({A_SQL}), t as ({_TERMS})
select t.term, t.bucket, s.id as scheme_id, cast(t.n as bigint) as searches from t join s
 on (t.term = '' or contains(lower(s.name), lower(t.term)) or contains(lower(s.state), lower(t.term)))
 and (t.bucket = 'All' or (t.bucket = 'Central / NSP' and s.state = 'All-India') or (t.bucket = 'Tamil Nadu' and s.state = 'Tamil Nadu')
  or (t.bucket = 'Other States' and s.state not in ('All-India', 'Tamil Nadu')))""")
def scheme_search(spark, base):
    a = applicants(spark, base)
    bucket = F.element_at(F.array(*[F.lit(b) for b in ("All", "Central / NSP", "Tamil Nadu", "Other States")]), (F.col("applicant_id") % 4 + 1).cast("int"))
    terms = a.groupBy(F.coalesce("state", F.lit("")).alias("term"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("searches"))
    return K.search_schemes(S.scheme_catalogue(spark), terms).select("term", "bucket", F.col("id").alias("scheme_id"), "searches")


@job("schemes_per_state", "S4", "U1", sql=f"""with a as ({APPLICANTS}), s as ({A_SQL})
select s.state, s.id as scheme_id, s.ord as scheme_ord, count(a.applicant_id) as residents from s left join a on a.state = s.state group by all""")
def schemes_per_state(spark, base):
    residents = applicants(spark, base).groupBy("state").agg(F.count(F.lit(1)).alias("residents"))
    out = S.scheme_catalogue(spark).select("state", F.col("id").alias("scheme_id"), F.col("ord").alias("scheme_ord")).join(residents, "state", "left")
    return out.select("state", "scheme_id", "scheme_ord", F.coalesce("residents", F.lit(0)).alias("residents"))


_PICKED = f"""{status_sql()},
picked as (select applicant_id, scheme_id from (select *, row_number() over (partition by applicant_id order by status_rank desc, score desc, scheme_ord) as rn from results) where rn = 1),
meta as ({META_SQL}), a_cat as ({A_SQL})"""


@job("enriched_picks", "J4", sql=f"""with {_PICKED}
select p.applicant_id, p.scheme_id, m.portal, m.jurisdiction, m.rule_status, m.level, m.minimum_disability_percentage,
 coalesce(nullif(m.source_url, ''), c.official_portal) as source_url
from picked p join a_cat c on c.id = p.scheme_id left join meta m on m.id = p.scheme_id""")
def enriched_picks(spark, base):
    schemes = S.scheme_catalogue(spark).select(F.col("id").alias("scheme_id"), "official_portal")
    picks = E.rank_schemes(applicants(spark, base), top_k=1).select("applicant_id", "scheme_id")
    return picks.join(K.enrich_metadata(schemes), "scheme_id").select(
        "applicant_id", "scheme_id", "portal", "jurisdiction", "rule_status", "level", "minimum_disability_percentage", "source_url")


@job("checklist_demand", "J5", sql=f"""with {_PICKED}, chk as ({CHECK_SQL}),
items as (select c.id as scheme_id, k.kind, k.label, k.purpose, m.rule_status, m.academic_year, m.jurisdiction, m.portal from a_cat c join meta m on m.id = c.id join chk k on k.id = c.id
 union all select c.id, 'REQUIRED', unnest(c.documents), '{DEFAULT_PURPOSE}', 'UNVERIFIED', '{ACADEMIC_YEAR}', 'CENTRAL', 'NSP' from a_cat c where c.id not in (select id from meta))
select i.*, n.applicants from items i join (select scheme_id, count(*) as applicants from picked group by 1) n using (scheme_id)""")
def checklist_demand(spark, base):
    """Checklist of every scheme that is some applicant's first choice, with how many need it."""
    schemes = S.scheme_catalogue(spark).select(F.col("id").alias("scheme_id"), "documents")
    demand = E.rank_schemes(applicants(spark, base), top_k=1).groupBy("scheme_id").agg(F.count(F.lit(1)).alias("applicants"))
    return K.document_checklist(schemes).drop("item_ord").join(demand, "scheme_id")


@job("rule_status_of_picks", "P6", sql=f"""with {_PICKED}
select coalesce(m.rule_status, 'UNVERIFIED') as rule_status, count(*) as picks, string_agg(distinct p.scheme_id, ',' order by p.scheme_id) as scheme_ids
from picked p left join meta m on m.id = p.scheme_id group by 1""")
def rule_status_of_picks(spark, base):
    return K.rule_status_counts(E.rank_schemes(applicants(spark, base), top_k=1))


def satisfies_sql(label: str, kind: str, legacy: bool) -> str:
    def names(word):
        if word in K.SHORT_WORDS and not legacy:
            return f"regexp_matches({label}, '(^|[^a-z0-9]){word}($|[^a-z0-9])')"
        return f"contains({label}, '{word}')"
    tests = [f"contains({label}, {kind})", f"contains({kind}, {label})"]
    tests += ["((" + " or ".join(map(names, lw)) + ") and (" + " or ".join(f"contains({kind}, '{w}')" for w in uw) + "))" for lw, uw in K.DOCUMENT_WORDS]
    any_test = "(" + " or ".join(tests) + ")"
    return any_test if legacy else f"({any_test} and {kind} <> '')"


def _missing_sql(legacy: bool) -> str:
    return f"""with chk as ({CHECK_SQL}), u as (select distinct case_id, lower(upload_type) as kind from ({UPLOADS})),
ids as (select id, row_number() over (order by id) - 1 as k, count(*) over () as n from (select distinct id from chk)),
req as (select o_orderkey as case_id, chk.id as scheme_id, chk.label, lower(chk.label) as l from orders join ids on o_orderkey % ids.n = ids.k join chk on chk.id = ids.id and chk.kind = 'REQUIRED')
select case_id, scheme_id, label from req where not exists (select 1 from u where u.case_id = req.case_id and {satisfies_sql('req.l', 'u.kind', legacy)})"""


def required_by_case(spark, base):
    """Each order is one case applying for one scheme; its required labels, one per row."""
    ids = sorted({r["id"] for r in checklist_rows()})
    scheme = F.element_at(F.array(*[F.lit(i) for i in ids]), (F.col("o_orderkey") % len(ids) + 1).cast("int"))
    labels = S.scheme_checklists(spark).filter("kind = 'REQUIRED'").select(F.col("id").alias("scheme_id"), "label")
    return table(spark, base, "orders").select(F.col("o_orderkey").alias("case_id"), scheme.alias("scheme_id")).join(labels, "scheme_id")


@job("missing_documents", "J6", "U4", sql=_missing_sql(False))
def missing_documents(spark, base):
    return K.missing_documents(required_by_case(spark, base), uploads(spark, base)).select("case_id", "scheme_id", "label")


@job("missing_documents_legacy", "J6", sql=_missing_sql(True))
def missing_documents_legacy(spark, base):
    return K.missing_documents(required_by_case(spark, base), uploads(spark, base), legacy=True).select("case_id", "scheme_id", "label")


def corpus_sql() -> str:
    def values(items):
        return ", ".join(f"({i}, '{v}')" for i, v in enumerate(items))
    hand = ", ".join(f"({i}, '{q}', '{c}', '{s}')" for i, q, c, s in Q.HAND_WRITTEN)
    return f"""select id, question, category, state, cast(null as varchar) as course from (values {hand}) h(id, question, category, state)
union all select {Q.FIRST_GENERATED_ID} + ((s.i * 6 + c.i) * 6 + r.i) * 6 + t.i, t.v || ' ' || lower(s.v) || ' ' || lower(c.v) || ' ' || lower(r.v) || ' scholarship', c.v, s.v, r.v
from (values {values(Q.STATES)}) s(i, v) cross join (values {values(Q.CATEGORIES)}) c(i, v) cross join (values {values(Q.COURSES)}) r(i, v) cross join (values {values(Q.TOPICS)}) t(i, v)"""


@job("corpus_for_applicants", "S5", sql=f"""with q as ({corpus_sql()}), a as ({APPLICANTS})
select q.id, q.question, count(*) as applicants from q join a on q.state = a.state and q.category = a.category and q.course = a.course group by all""")
def corpus_for_applicants(spark, base):
    """Which templated questions apply to how many applicants."""
    groups = applicants(spark, base).groupBy("state", "category", "course").agg(F.count(F.lit(1)).alias("applicants"))
    return S.question_corpus(spark).join(groups, ["state", "category", "course"]).select("id", "question", "applicants")


