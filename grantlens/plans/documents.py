"""Jobs over document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.functions.banding import EVALUATION_BANDS, FIELD_BANDS, PROFILE_BANDS, band
from grantlens.functions.text import escape_html, re2
from grantlens.operators import documents as O
from grantlens.plans.identity import iso_sql
from grantlens.plans.readiness import band_sql
from grantlens.plans.questions import lit, rx
from grantlens.plans.registry import job
from grantlens.plans.views import AS_OF, CERTIFICATES, TEXTS, certificates, texts
from grantlens.rules import documents as R
from grantlens.session import table


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _score_sql(kind: str, x: str = "clean") -> str:
    return " + ".join(f"case when regexp_matches({x}, {lit(re2(p, True, dot))}) then {w} else 0 end" for w, p, dot in R.CLASSIFICATION[kind])


def class_sql(source: str, key: str, keep: str = "") -> str:
    """CTEs ending in `classified`."""
    entries = ", ".join(f"{{'score': s_{k}, 'ord': {-i}, 'kind': '{k}'}}" for i, k in enumerate(R.TYPES))
    return f"""cl0 as (select {key}{keep}, {_squeeze("coalesce(text, '')")} as clean from ({source}) src),
cl1 as (select {key}{keep}, length(clean) as n, {', '.join(f'{_score_sql(k)} as s_{k}' for k in R.TYPES)} from cl0),
cl2 as (select {key}{keep}, n, list_reverse_sort([{entries}]) as r from cl1),
cl3 as (select *, r[1].score as sc, r[1].score - r[2].score as mg, least(greatest(r[1].score * 8, 30), 98) as sure from cl2),
cl4 as (select *, n < 15 as short, sc < 6 as weak, mg < 3 and r[2].score >= 6 as mixed from cl3),
classified as (select {key}{keep}, case when short or weak then 'unknown' else r[1].kind end as doc_type, case when short then 0 when weak then sc * 10 when mixed then greatest(30, sure - 25) else sure end as confidence,
 case when short then 0 else sc end as top_score, case when short then 0 else mg end as margin, not short and not weak and (case when mixed then greatest(30, sure - 25) else sure end) >= 60 and mg >= 3 as is_confident from cl4)"""


@job("classified_texts", "A16", "W5", sql=f"with {class_sql(TEXTS, 'text_id')} select * from classified")
def classified_texts(spark, base):
    return O.classify_documents(texts(spark, base), "text_id")


def state_sql(x: str, what: str) -> str:
    parts = []
    for name, patterns in R.STATES:
        hits = " + ".join(f"case when {rx(x, p)} then 1 else 0 end" for p in patterns)
        value = f"'{name}'" if what == "state" else f"least(98, 70 + 14 * ({hits}))"
        parts.append(f"when ({hits}) > 0 then {value}")
    return "case " + " ".join(parts) + " end"


def authority_sql(x: str) -> str:
    return "case " + " ".join(f"when {rx(x, p)} then '{n}'" for n, p in R.AUTHORITIES) + " end"


@job("states_and_authorities", "D1", "D2", sql=f"""select text_id, {state_sql('text', 'state')} as state, coalesce({state_sql('text', 'confidence')}, 0) as state_confidence, {authority_sql('text')} as authority,
 case when {authority_sql('text')} is null then 0 else 90 end as authority_confidence from ({TEXTS}) t""")
def states_and_authorities(spark, base):
    t = texts(spark, base).select("text_id", O.detect_state(F.col("text")).alias("s"), O.detect_authority(F.col("text")).alias("authority"))
    return t.select("text_id", "s.state", F.coalesce("s.confidence", F.lit(0)).alias("state_confidence"), "authority",
                    F.when(F.col("authority").isNull(), 0).otherwise(R.AUTHORITY_CONFIDENCE).alias("authority_confidence"))


def _title_sql() -> str:
    repaired = "header"
    for pattern, by in R.TITLE_REPAIRS:
        repaired = f"regexp_replace({repaired}, {lit(re2(pattern))}, {lit(by.replace('$1', chr(92) + '1'))}, 'g')"
    def pick(i: int) -> str:
        arms = ["when n < 10 then " + ("'unknown'", "'Unknown Document'", "0", "false")[i]]
        arms += [f"when {rx('header', p)} then " + (f"'{k}'", f"'{t}'", str(c), "true")[i] for k, t, c, p in R.TITLES]
        arms += [f"when {rx('repaired', p)} then " + (f"'{k}'", f"'{t}'", str(max(60, c - 10)), "true")[i] for k, t, c, p in R.TITLES]
        arms += [f"when {rx('header', p)} then " + ("'unknown'", f"'{t}'", "61", "false")[i] for t, p in R.PARTIAL_TITLES]
        return "case " + " ".join(arms) + " else " + ("'unknown'", "'Unknown Document'", "15", "false")[i] + " end"
    return f"""with h as (select text_id, left(trim(text), 1500) as header, length(trim(text)) as n from ({TEXTS}) t), r as (select *, {_squeeze(repaired)} as repaired from h)
select text_id, {pick(0)} as doc_type, {pick(1)} as title, {pick(2)} as confidence, {pick(3)} as identified from r"""


@job("document_titles", "D3", sql=_title_sql())
def document_titles(spark, base):
    return texts(spark, base).select("text_id", O.detect_title(F.col("text")).alias("t")).select("text_id", "t.*")




@job("marksheet_boards", "D4", sql=f"""with t as (select doc_id, text, {state_sql('text', 'state')} as st from ({CERTIFICATES}) c)
select doc_id, case {' '.join(f"when {rx('text', p)} then '{t}'" for t, _, p in R.TEMPLATES)} when st is not null and {rx('text', R.STATE_BOARD_WORDS)} then 'state_board' else 'generic' end as template,
 case {' '.join(f"when {rx('text', p)} then '{b}'" for _, b, p in R.TEMPLATES)} when st is not null and {rx('text', R.STATE_BOARD_WORDS)} then st || ' State Board of School Examinations' end as board from t""")
def marksheet_boards(spark, base):
    return certificates(spark, base).select("doc_id", O.detect_board(F.col("text")).alias("b")).select("doc_id", "b.template", "b.board")


@job("slot_validation", "P13", sql=f"""with {class_sql(CERTIFICATES, 'doc_id', ', slot')}
select doc_id, slot, doc_type, confidence, case when doc_type = 'unknown' or confidence < 50 then 'unconfident' when doc_type = slot then 'valid' else 'mismatch' end as validation from classified""")
def slot_validation(spark, base):
    out = O.classify_documents(certificates(spark, base), "doc_id", keep=("slot",))
    return out.select("doc_id", "slot", "doc_type", "confidence", O.slot_validation(F.col("slot"), F.col("doc_type"), F.col("confidence")).alias("validation"))


@job("privacy_gate", "P7", sql=f"""with t as (select text_id, coalesce(text, '') as text from ({TEXTS}) t0)
select text_id, length(text) < 1 or length(text) > 800 or {rx('text', R.PRIVATE_TEXT)} as is_blocked from t""")
def privacy_gate(spark, base):
    return texts(spark, base).select("text_id", O.private_text(F.col("text")).alias("is_blocked"))


_IDS = """select c_custkey as id, case c_custkey % 3 when 0 then 'aadhaar' when 1 then 'bank' else 'general' end as kind,
 case c_custkey % 4 when 0 then concat(cast(1000 + c_custkey % 8999 as varchar(4)), ' 5678 ', cast(1000 + c_custkey % 777 as varchar(4))) when 1 then cast(1000000000 + c_custkey as varchar(12)) when 2 then ' 123 ' else concat('A&B <', c_name, '>') end as value from customer"""


@job("masked_identifiers", "P8", "C17", sql=f"""with i as ({_IDS}), v as (select id, kind, trim(value) as v, regexp_replace(value, '[^0-9]', '', 'g') as d from i)
select id, case when kind = 'aadhaar' and length(d) = 12 then 'XXXX-XXXX-' || right(d, 4) when kind = 'bank' and length(v) > 4 then repeat('X', greatest(4, length(v) - 4)) || right(v, 4) else v end as masked,
 replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from v""")
def masked_identifiers(spark, base):
    from grantlens.session import sql_over

    ids = sql_over(spark, base, _IDS)
    return ids.select("id", O.mask_identifier(F.col("value"), F.col("kind")).alias("masked"), escape_html(F.trim("value")).alias("escaped"))


@job("confidence_bands", "P9", "P10", sql=f"""with e as (select event_id, case when event_id % 7 = 0 then null else value end as engine, cast(event_id % 101 as double) as pattern, cast(case when event_id % 5 = 0 then 0 else 40 + event_id % 61 end as double) as label,
 case when event_id % 3 = 0 then null else cast(event_id % 120 as double) end as validity from events),
c as (select *, least(greatest(case when engine is null then 85 when engine = 0 then 75 else engine end, 0), 100) as a, least(greatest(case when pattern = 0 then 70 else pattern end, 0), 100) as b,
 least(greatest(case when label = 0 then 50 else label end, 0), 100) as d, least(greatest(case when validity is null then 100 when validity = 0 then 80 else validity end, 0), 100) as v from e),
s as (select event_id, cast(floor(round(a * 0.35::double + b * 0.25::double + d * 0.2::double + v * 0.2::double, 6) + 0.5) as integer) as score from c)
select event_id, score, score < 70 as uncertain, {band_sql('score', PROFILE_BANDS)} as profile_band, {band_sql('score', FIELD_BANDS)} as field_band, {band_sql('score', EVALUATION_BANDS)} as evaluation_band from s""")
def confidence_bands(spark, base):
    i, v = F.col("event_id"), F.col("value")
    e = table(spark, base, "events").select(
        "event_id", F.when(i % 7 != 0, v).alias("engine"), (i % 101).cast("double").alias("pattern"),
        F.when(i % 5 == 0, 0).otherwise(40 + i % 61).cast("double").alias("label"), F.when(i % 3 != 0, (i % 120).cast("double")).alias("validity"))
    s = O.scored_fields(e)
    return s.select("event_id", "score", "uncertain", *[band(F.col("score"), b).alias(n) for n, b in (
        ("profile_band", PROFILE_BANDS), ("field_band", FIELD_BANDS), ("evaluation_band", EVALUATION_BANDS))])


_EXTRACTED = """select o_orderkey as doc_id, case o_orderkey % 4 when 0 then 'ms10' when 1 then 'ms12' when 2 then 'community' else 'income' end as doc_type,
 case when o_orderkey % 5 = 0 then null else 'ARUN' end as name, case when o_orderkey % 3 = 0 then null else 'CBSE' end as board, case when o_orderkey % 7 = 0 then null else '400' end as marks,
 case when o_orderkey % 2 = 0 then null else '2024' end as year, concat(cast(20 + o_orderkey % 60 as varchar(3)), '.5%') as percentage, case when o_orderkey % 6 = 0 then null else 'BC' end as category,
 case when o_orderkey % 8 = 0 then null else 'TN-1' end as cert_number, case when o_orderkey % 9 = 0 then null else 'Tahsildar' end as authority, case when o_orderkey % 11 = 0 then null else '90000' end as income,
 case o_orderkey % 6 when 0 then null when 1 then '15-01-2026' when 2 then '15-09-2025' else '01-02-2025' end as issue_date,
 case when o_orderkey % 10 = 0 then null else cast(o_orderkey % 100 as double) end as engine, case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 90 as double) / 100 end as f1, case when o_orderkey % 2 = 0 then null else 0.75 end as f2,
 cast(o_orderkey % 98 as int) as classification from orders"""


@job("document_issue_flags", "P11", "P12", sql=f"""with e as (select *, date_diff('day', {iso_sql('issue_date')}, date '{AS_OF}') / 30.0 as age, try_cast(replace(percentage, '%', '') as double) as pct, doc_type in ('ms10', 'ms12') as ms, list_filter([f1, cast(f2 as double)], lambda x: x is not null) as fs from ({_EXTRACTED}) e0),
f as (select *, case when len(fs) > 0 then floor(list_sum(fs) / len(fs) * 100 + 0.5) else 70 end as fc from e)
select doc_id, array_to_string(list_filter([case when ms and pct < 35 then 'low_percentage' end, case when doc_type = 'community' and category is null then 'category_missing' end, case when doc_type = 'income' and income is null then 'income_missing' end,
 case when doc_type = 'income' and age > 12 then 'certificate_outdated' end], lambda x: x is not null), ',') as issues,
 array_to_string(list_filter([case when name is null then 'name_missing' end, case when ms and board is null then 'board_missing' end, case when ms and marks is null then 'marks_missing' end, case when ms and year is null then 'year_missing' end,
 case when doc_type = 'community' and cert_number is null then 'cert_number_missing' end, case when doc_type = 'community' and authority is null then 'authority_missing' end, case when doc_type = 'income' and issue_date is null then 'issue_date_missing' end,
 case when doc_type = 'income' and age > 6 and age <= 12 then 'certificate_ageing' end], lambda x: x is not null), ',') as warnings,
 cast(floor(round(cast(coalesce(engine, fc) * 0.4::double + fc * 0.4::double + classification * 0.2::double as double), 6) + 0.5) as bigint) as overall_confidence from f""")
def document_issue_flags(spark, base):
    from grantlens.session import sql_over

    e = sql_over(spark, base, _EXTRACTED)
    issues, warnings = O.document_issues(F.col("doc_type"), F.lit(AS_OF).cast("date"), F.col)
    fields = F.array(F.col("f1"), F.col("f2").cast("double"))
    return e.select("doc_id", F.array_join(issues, ",").alias("issues"), F.array_join(warnings, ",").alias("warnings"),
                    O.overall_confidence(F.col("engine"), fields, F.col("classification")).alias("overall_confidence"))
