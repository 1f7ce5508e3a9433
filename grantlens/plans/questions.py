"""Jobs over questions and texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from grantlens.functions import categories as C
from grantlens.functions.text import re2
from grantlens.operators import questions as O
from grantlens.plans.catalogues import case_sql, corpus_sql
from grantlens.plans.registry import job
from grantlens.plans.sqltext import quoted
from grantlens.plans.views import UTTERANCES, utterances
from grantlens.rules import corpus as Q, utterances as U
from grantlens.session import table
from grantlens.sources.catalogue import question_corpus


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rx(expr: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({expr}, {lit(re2(pattern, ignore_case))})"


def tokens_sql(x: str, minimum: int = 1, stop: bool = False) -> str:
    kept = f"length(w) >= {minimum}" + (f" and w not in ({quoted(Q.STOP_WORDS)})" if stop else "")
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: {kept})"


@job("token_counts", "Q1", sql=f"""select doc_id, len({tokens_sql('text')}) as n_tokens, len({tokens_sql('text', 3)}) as n_long_tokens, len({tokens_sql('text', 2, True)}) as n_content_tokens,
 len(list_distinct({tokens_sql('text', 2, True)})) as n_distinct_content from documents""")
def token_counts(spark, base):
    return O.token_counts(table(spark, base, "documents"), "doc_id")


def income_sql(x: str) -> str:
    parts = []
    for pattern, has_unit in U.INCOME_PATTERNS:
        get = lambda g: f"regexp_extract(lower({x}), {lit(re2(pattern))}, {g})"  # noqa: B023, E731
        unit = get(2) if has_unit else "''"
        parts.append(f"when {rx(f'lower({x})', pattern)} then cast(floor(try_cast(replace({get(1)}, ',', '') as double) * case when {unit} in ({quoted(U.LAKH_UNITS)}) then 100000 "
                     f"when {unit} in ({quoted(U.THOUSAND_UNITS)}) then 1000 else 1 end + 0.5) as bigint)")
    return "case " + " ".join(parts) + " end"


@job("stated_income", "Q2", sql=f"select utterance_id, {income_sql('text')} as income from ({UTTERANCES}) u")
def stated_income(spark, base):
    return utterances(spark, base).select("utterance_id", O.extract_income(F.col("text")).alias("income"))


def _slots_sql() -> str:
    has = lambda p: rx("n", p, False)
    category = "case " + " ".join(f"when {has(p)}" + (f" and not {has(u)}" if u else "") + f" then '{name}'" for name, p, u in U.CATEGORY_SLOTS) + " end"
    first = lambda names: "coalesce(" + ", ".join(f"case when {has(chr(92) + 'b' + re.escape(w) + chr(92) + 'b')} then '{v}' end" for w, v in names) + ")"
    district = first([(d.lower(), d) for d in C.DISTRICTS])
    state = first([(re.sub("[^a-z]", " ", s.lower()).strip(), s) for s in C.STATES])
    alias = case_sql(U.STATE_ALIASES, has)
    courses = [("Engineering", has(U.ENGINEERING), "'ug'"), ("Medical", has(U.MEDICAL), "'ug'"),
               ("Diploma", has(U.DIPLOMA), f"case when {has(chr(92) + 'biti' + chr(92) + 'b')} then 'iti' else 'diploma' end"),
               ("School", f"({has(U.SCHOOL)} or ({has(U.SCHOOL_WORD)} and not {has(U.STATE_SCHOOL)}))", "'prematric'"),
               ("Science", has(U.SCIENCE), f"case when {has(chr(92) + 'bmsc' + chr(92) + 'b')} then 'pg' else 'ug' end"),
               ("Arts", f"({has(U.ARTS)} and not {has(U.ARTS_UNLESS)})", "'ug'")]
    course = "case " + " ".join(f"when {t} then '{n}'" for n, t, _ in courses) + " end"
    level = "case " + " ".join(f"when {t} then {lv}" for _, t, lv in courses) + f" else {case_sql(C.LEVEL_PATTERNS, lambda p: rx('n', p))} end"
    pct = "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(n, {lit(re2(p))}, 1), '') as integer)" for p in U.DISABILITY_PERCENT) + ")"
    return f"""with u as (select *, lower(text) as n from ({UTTERANCES}) u0),
a as (select utterance_id, text, n, {category} as category, {district} as district, {state} as named_state, {alias} as alias, {has(U.QUOTA_75)} as quota, {course} as course0, {level} as level0, {pct} as disability_percent from u)
select utterance_id, category, lower(category) as community, district,
 coalesce(alias, case when district is not null then 'Tamil Nadu' end, named_state, case when quota then 'Tamil Nadu' end, case when {has(U.GOVT_SCHOOL)} then 'Tamil Nadu' end) as state,
 case when quota then true end as govt_school_quota, case when not quota then course0 end as course, case when not quota then level0 end as level,
 case when {has(U.GIRLS)} then 'Girls' when {has(U.BOYS)} then 'Boys' end as gender, disability_percent,
 case when disability_percent is not null then disability_percent >= 40 when {has(U.DISABLED)} then true end as disabled,
 case when {has(U.GOVT_SCHOOL)} then true when {has(U.OTHER_SCHOOL)} then false when quota then true end as govt_school,
 case when {has(U.AGRI_LABOR)} then true end as agri_labor, case when {has(U.ARMED_FORCES)} then true end as armed_forces,
 case when {has(U.FIRST_GRADUATE)} then true end as first_graduate, {income_sql('text')} as income from a"""


SLOTS_SQL = _slots_sql()


@job("question_slots", "Q3", sql=SLOTS_SQL)
def question_slots(spark, base):
    return O.extract_slots(utterances(spark, base), "utterance_id").drop("text")


_ENT = "list_filter([" + ", ".join(f"case when {rx('lower(text)', chr(92) + 'b' + a.lower() + chr(92) + 'b', False)} then '{a}' end" for a, _ in U.ACRONYMS) + "], lambda x: x is not null)"


@job("question_entities", "Q4", sql=f"select utterance_id, array_to_string({_ENT}, ',') as entities from ({UTTERANCES}) u")
def question_entities(spark, base):
    return utterances(spark, base).select("utterance_id", F.array_join(O.extract_entities(F.col("text")), ",").alias("entities"))


_FULL = "case x " + " ".join(f"when '{a}' then '{f}'" for a, f in U.ACRONYMS) + " end"


@job("expanded_acronyms", "J12", sql=f"""with u as (select utterance_id, {_ENT} as e, {rx('trim(lower(text))', U.FULL_FORM_TRIGGERS)} or {rx('trim(lower(text))', U.BARE_ACRONYM)} as asks from ({UTTERANCES}) u0)
select utterance_id, case when len(e) > 1 then 'multi' else 'single' end as kind, array_to_string(e, ',') as acronyms, array_to_string(list_transform(e, lambda x: {_FULL}), '; ') as full_forms from u where asks and len(e) > 0""")
def expanded_acronyms(spark, base):
    return O.expand_acronyms(utterances(spark, base), "utterance_id")


def _intent_sql() -> str:
    rows = U.phrase_rows()
    values = ", ".join(f"({r['ord']}, {r['intent_no']}, '{r['intent']}', {lit(r['phrase'])}, {r['weight']}, {str(r['is_priority']).lower()})" for r in rows)
    wanted = " or ".join(f"contains(lower(u.text), '{w}')" for w in U.ELIGIBILITY_WORDS)
    return f"""slots as ({SLOTS_SQL}), phrases as (select * from (values {values}) p(ord, intent_no, intent, phrase, weight, is_priority)),
utt as ({UTTERANCES}),
hits as (select u.utterance_id, p.* from utt u join phrases p on contains(lower(u.text), p.phrase) and regexp_matches(lower(u.text), '(^|[^a-z0-9])' || regexp_escape(p.phrase) || '($|[^a-z0-9])')),
pri as (select utterance_id, arg_min(intent, ord) as intent from hits where is_priority group by 1),
sco as (select utterance_id, intent, intent_no, sum(weight) as pts from hits where not is_priority group by 1, 2, 3),
top as (select utterance_id, intent from (select *, row_number() over (partition by utterance_id order by pts desc, intent_no) as rn from sco) where rn = 1),
intents as (select u.utterance_id, u.text, coalesce(pri.intent, case when (s.category is not null or s.disabled is not null) and ({wanted} or s.income is not null or s.disabled is not null) then 'eligibility' end, top.intent, 'unknown') as intent,
 s.category is not null or s.income is not null or s.disabled is not null as facts
 from utt u join slots s using (utterance_id) left join pri using (utterance_id) left join top using (utterance_id))"""


@job("question_intents", "Q5", sql=f"with {_intent_sql()} select utterance_id, intent from intents")
def question_intents(spark, base):
    return O.detect_intent(utterances(spark, base), "utterance_id")


def _norm_sql(x: str) -> str:
    return f"regexp_replace(trim(lower({x})), '[?.,!]', '', 'g')"


def match_sql(source: str) -> str:
    """CTEs ending in `matched(utterance_id, matched_id, score, tier)` for a relation with utterance_id and text."""
    pri = "case " + " ".join(f"when {rx('norm', p)} then {i}" for p, i in Q.PRIORITY_PHRASES) + " end"
    guard_course = " and ".join(f"(not contains(lower(k.question), '{c.lower()}') or contains(d.norm, '{c.lower()}'))" for c in Q.COURSES)
    return f"""corpus as (select *, {tokens_sql('question', 2, True)} as ct, {_norm_sql('question')} as c_norm from ({corpus_sql()}) c0),
asked as (select utterance_id, {_norm_sql('text')} as norm from {source} src where {_norm_sql('text')} <> ''),
d0 as (select distinct norm from asked), d as (select norm, {tokens_sql('norm', 2, True)} as qt, {pri} as pid from d0),
ex as (select d.norm, min(c.id) as id from d join corpus c on c.c_norm = d.norm group by 1),
ph as (select d.norm, d.pid as id from d where pid is not null and norm not in (select norm from ex)),
sc as (select d.norm, k.id, len(list_filter(d.qt, lambda t: list_contains(k.ct, t))) as hits, len(list_distinct(list_concat(d.qt, k.ct))) as un, contains(d.norm, lower(k.question)) or contains(lower(k.question), d.norm) as inside
 from d join corpus k on (k.id < 1000 or ((lower(k.state) = '{Q.UNGUARDED_STATE}' or contains(d.norm, trim(regexp_replace(lower(k.state), '[^a-z]', ' ', 'g')))) and regexp_matches(d.norm, '\\b' || lower(k.category) || '\\b') and {guard_course}))
 where d.norm not in (select norm from ex) and d.norm not in (select norm from ph)),
ov as (select * from (select norm, id, hits * 1.0 / un + case when inside then 0.35 else 0 end as score, row_number() over (partition by norm order by hits * 1.0 / un + case when inside then 0.35 else 0 end desc, id) as rn from sc where hits > 0) where rn = 1 and score >= 0.2),
found as (select norm, id, 1.0 as score, 'exact' as tier from ex union all select norm, id, 0.95, 'phrase' from ph union all select norm, id, score, 'overlap' from ov),
matched as (select a.utterance_id, cast(f.id as bigint) as matched_id, cast(f.score as double) as score, f.tier from asked a join found f using (norm))"""


@job("matched_questions", "J11", sql=f"with {match_sql('(' + UTTERANCES + ')')} select utterance_id, matched_id, round(score, 6) as score, tier from matched")
def matched_questions(spark, base):
    return O.match_questions(utterances(spark, base), question_corpus(spark), "utterance_id").withColumn("score", F.round("score", 6))


@job("texts_matched_to_items", "J11", "U2", sql=f"""with q as (select doc_id, {_norm_sql('text')} as norm, {tokens_sql(_norm_sql('text'), 2, True)} as qt from documents), c as (select item_id, text, {tokens_sql('text', 2, True)} as ct from benchmark),
qx as (select doc_id, token, count(*) as times from (select doc_id, unnest(qt) as token from q) group by 1, 2), cx as (select distinct item_id, unnest(ct) as token from c),
p as (select doc_id, item_id, sum(times) as hits, count(*) as shared from qx join cx using (token) group by 1, 2),
s as (select p.doc_id, p.item_id, hits * 1.0 / (len(list_distinct(q.qt)) + len(list_distinct(c.ct)) - shared) + case when contains(q.norm, lower(c.text)) or contains(lower(c.text), q.norm) then 0.35 else 0 end as score
 from p join q using (doc_id) join c using (item_id))
select doc_id, item_id, round(cast(score as double), 6) as score from (select *, row_number() over (partition by doc_id order by score desc, item_id) as rn from s) where rn = 1 and score >= 0.2""")
def texts_matched_to_items(spark, base):
    out = O.match_texts(table(spark, base, "documents"), table(spark, base, "benchmark"), "doc_id", "item_id")
    return out.withColumn("score", F.round("score", 6))


def _purpose_sql(n: str) -> str:
    has = {k: rx(n, p) for k, p in U.PURPOSE_WORDS.items()}
    excluded = " or ".join([f"({rx(n, U.PURPOSE_WAY[0])} and {rx(n, U.PURPOSE_WAY[1])})", *[rx(n, p) for p in U.PURPOSE_EXCLUDES]])
    about = f"({has['scholarship']} or {has['participation']})"
    phrased = "(" + " or ".join(rx(n, p) for p in U.PURPOSE_PHRASES) + ")"
    yes = " or ".join([
        f"({has['why']} and {about})", f"(({has['benefit']} or {has['purpose']} or {has['importance']} or {has['value']}) and {about})",
        f"(({has['utility']} or {has['value']} or {has['need']} or {has['importance']}) and ({has['scholarship']} or ({has['need']} and {has['participation']})))",
        f"({has['scholarship']} and {has['utility']})", f"({about} and {phrased})"])
    return f"(not ({excluded}) and ({yes}))"


def _route_sql() -> str:
    n = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[''’]', '', 'g'), '[^A-Za-z0-9_\\s%]', ' ', 'g'), '\\s+', ' ', 'g'))"
    t = "trim(text)"
    target = case_sql(U.APPLY_TARGETS, lambda p: rx(f"lower({t})", p), "'apply_general'")
    early = (f"case when {rx(t, U.GREETING)} then 'greeting' when {rx(t, U.IDENTITY)} then 'bot_identity' when {rx(t, U.QUOTA_75)} then 'quota_7_5' when {_purpose_sql('pn')} then 'scholarship_purpose' "
             f"when ({rx(f'lower({t})', U.FULL_FORM_TRIGGERS)} or {rx(f'lower({t})', U.BARE_ACRONYM)}) and len({_ENT}) > 0 then 'full_form' "
             f"when {rx(f'lower({t})', U.HOW_TO_APPLY)} or lower({t}) in ('apply', 'how to apply?', 'how to apply') then {target} end")
    return f"""with {_intent_sql()},
e as (select *, {early} as early from (select *, {n} as pn from intents where trim(text) <> '') e0),
l as (select *, case when intent not in ({quoted(U.ANSWERED_ELSEWHERE)}) then intent when intent = 'eligibility' or facts then 'eligibility' end as late from e where early is null),
{match_sql("(select utterance_id, text from l where late is null)")}
select utterance_id, early as route from e where early is not null
union all select l.utterance_id, coalesce(late, case when m.score >= 0.25 then 'qa_match' end, intent) from l left join matched m using (utterance_id)"""


@job("question_routes", "Q6", sql=_route_sql())
def question_routes(spark, base):
    return O.route_queries(utterances(spark, base), question_corpus(spark), "utterance_id")


@job("screened_utterances", "Q7")
def screened_utterances(spark, base):
    return O.screen_utterances(utterances(spark, base), "utterance_id")
