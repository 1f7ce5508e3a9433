"""Jobs that measure extraction, and jobs over records that come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.functions.banding import EVALUATION_BANDS
from grantlens.functions.name_match import INSTITUTION_ABBREVIATIONS, evaluation_match
from grantlens.operators import evaluation as O
from grantlens.plans.questions import lit
from grantlens.plans.readiness import band_sql, dashed_sql
from grantlens.plans.registry import job
from grantlens.plans.sqltext import quoted
from grantlens.plans.views import FILES, INTAKE, RESULTS
from grantlens.session import sql_over, table
from grantlens.sources import records as S

FIELDS = ("studentName", "dateOfBirth", "certificateNumber", "percentage", "parentName")


def results(spark, base):
    return sql_over(spark, base, RESULTS)


def _letters(x):
    return f"regexp_replace({x}, '[^a-z]', '', 'g')"


def local_match_sql(pairs: str) -> str:
    """SELECT adding `status` of the loose comparator to a relation with columns ra, rb."""
    clean = lambda x: f"trim(lower(translate({x}, '015', 'ois')))"
    ws = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    bare = lambda x: f"trim(regexp_replace(regexp_replace({x}, '\\b[a-z]\\.?\\b', '', 'g'), '\\s+', ' ', 'g'))"
    srt = lambda x: f"array_to_string(list_sort({ws(x)}), ' ')"
    t = f"(select *, {clean('ra')} as a, {clean('rb')} as b from {pairs})"
    t = f"(select *, {bare('a')} as na, {bare('b')} as nb, list_filter({ws('a')}, lambda w: length(w) > 1) as la, list_filter({ws('b')}, lambda w: length(w) > 1) as lb from {t} x1)"
    t = f"(select *, case when len(la) <= len(lb) then la else lb end as sh, case when len(la) <= len(lb) then lb else la end as lo from {t} x2)"
    covered = "len(sh) > 0 and len(list_filter(sh, lambda s: len(list_filter(lo, lambda o: o = s or (length(s) >= 4 and levenshtein(o, s) <= 1))) > 0)) = len(sh)"
    return f"""(select *, case when coalesce(a, '') = '' or coalesce(b, '') = '' then 'MISSING' when {_letters('a')} = {_letters('b')} then 'EXACT_MATCH'
 when {srt('a')} = {srt('b')} or {_letters(srt('a'))} = {_letters(srt('b'))} then 'EXACT_MATCH'
 when na <> '' and nb <> '' and ({srt('na')} = {srt('nb')} or {_letters('na')} = {_letters('nb')}) then 'EXACT_MATCH'
 when {covered} then case when len(lo) > len(sh) then 'NEEDS_REVIEW' else 'EXACT_MATCH' end
 when levenshtein({_letters('a')}, {_letters('b')}) <= 2 and least(length({_letters('a')}), length({_letters('b')})) >= 5 then 'MINOR_DIFFERENCE' else 'MISMATCH' end as status from {t} x3)"""


_ALNUM = lambda x: f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"
_LONG = f"""r as ({RESULTS}), long as (select document_type, cohort_id, status as st, confidence, unnest(['studentName', 'dateOfBirth', 'certificateNumber', 'percentage', 'parentName']) as field,
 unnest([truth, t_dateOfBirth, t_certificateNumber, t_percentage, t_parentName]) as truth, unnest([predicted, p_dob, p_certificateNumber, p_percentage, p_parentName]) as predicted from r),
np as (select distinct predicted as ra, truth as rb from long where field in ('studentName', 'parentName') and predicted is not null),
nm as (select ra, rb, status from {local_match_sql('np')} m)"""


@job("field_metrics", "A11", "N10", sql=f"""with {_LONG},
e as (select l.*, coalesce(predicted, '') <> '' as found, coalesce(case when field in ('studentName', 'parentName') then nm.status in ('EXACT_MATCH', 'MINOR_DIFFERENCE') when field = 'dateOfBirth' then {dashed_sql('predicted')} = {dashed_sql('truth')}
  when field = 'percentage' then abs(try_cast(regexp_extract(predicted, '([0-9]+(?:\\.[0-9]+)?)', 1) as double) - try_cast(truth as double)) <= 1.5 else {_ALNUM('predicted')} = {_ALNUM('truth')} end, false) as ok
 from long l left join nm on nm.ra = l.predicted and nm.rb = l.truth and l.field in ('studentName', 'parentName') where trim(coalesce(truth, '')) <> '' and not (field = 'parentName' and document_type = '10th_marksheet')),
g as (select field, count(*) as evaluated, count(*) filter (found and ok) as correct, count(*) filter (found and not ok) as incorrect, count(*) filter (not found) as not_detected, count(*) filter (found and (st = 'NEEDS_REVIEW' or confidence < 70)) as needs_review from e group by 1)
select *, round(correct * 100.0::double / evaluated, 2) as accuracy, round(correct * 100.0::double / nullif(correct + incorrect, 0), 2) as precision from g""")
def field_metrics(spark, base):
    r = results(spark, base).withColumnsRenamed({"truth": "t_studentName", "predicted": "p_studentName", "p_dob": "p_dateOfBirth"})
    return O.field_metrics(O.unpivot_fields(r, FIELDS, ["document_type", "cohort_id", "status", "confidence"]))


@job("name_match_for_scoring", "N10", sql=f"""with np as (select distinct predicted as ra, truth as rb from ({RESULTS}) r) select ra as predicted, rb as truth, status from {local_match_sql('np')} m""")
def name_match_for_scoring(spark, base):
    d = results(spark, base).select("predicted", "truth").distinct()
    return d.withColumn("status", evaluation_match(F.col("predicted"), F.col("truth")))


_WORDS = lambda x: f"list_filter(regexp_split_to_array(upper({x}), '\\s+'), lambda w: w <> '')"


@job("error_rates", "A12", "C15", "C16", sql=f"""with r as (select document_type, coalesce(predicted, '') as g, truth as t, {_WORDS("coalesce(predicted, '')")} as gw, {_WORDS('truth')} as tw from ({RESULTS}) r0),
v as (select *, list_distinct(list_concat(gw, tw)) as voc from r),
e as (select *, levenshtein(array_to_string(list_transform(gw, lambda w: chr(cast(64 + list_position(voc, w) as integer))), ''), array_to_string(list_transform(tw, lambda w: chr(cast(64 + list_position(voc, w) as integer))), '')) as we from v)
select document_type, count(*) as records, round(avg(cast(upper(trim(g)) = upper(trim(t)) as integer)) * 100, 2) as exact_accuracy, round(avg(cast({_ALNUM('g')} = {_ALNUM('t')} as integer)) * 100, 2) as normalised_accuracy,
 round(sum(levenshtein(upper(g), upper(t))) * 100.0::double / sum(greatest(length(t), 1)), 2) as cer, round(sum(we) * 100.0::double / sum(greatest(len(tw), 1)), 2) as wer from e group by 1""")
def error_rates(spark, base):
    return O.error_rates(results(spark, base), ["document_type"])


@job("calibration_table", "A13", sql=f"""with r as (select {band_sql('confidence', EVALUATION_BANDS)} as band, coalesce({_ALNUM('predicted')} = {_ALNUM('truth')} and predicted <> '', false) as ok from ({RESULTS}) r0),
g as (select band, count(*) as total, count(*) filter (ok) as correct from r group by 1)
select *, total - correct as wrong, case when band = '90-100' and total > correct then 'CALIBRATION VIOLATION' else 'SAFE' end as invariant from g""")
def calibration_table(spark, base):
    return O.calibration_table(results(spark, base))


_FIRST = f"""r as ({RESULTS}), fc as (select * from (select *, row_number() over (partition by cohort_id, document_type order by manifest_ord) as rn from r where degradation = 'clean_scan') where rn = 1)"""
_EXPECTED = "ex as (select distinct cohort_id, case cast(replace(cohort_id, 'COHORT_', '') as bigint) % 3 when 0 then 'CONSISTENT' when 1 then 'MINOR_DIFFERENCE' else 'SIGNIFICANT CONFLICT' end as expected from r)"


@job("first_clean_scans", "U3", sql=f"with {_FIRST} select cohort_id, document_type, manifest_ord, predicted, p_dob from fc")
def first_clean_scans(spark, base):
    return O.first_clean_scans(results(spark, base))


@job("cohort_check", "A14", sql=f"""with {_FIRST}, {_EXPECTED},
pr as (select a.cohort_id, a.predicted as ra, b.predicted as rb from fc a join fc b on a.cohort_id = b.cohort_id and a.document_type < b.document_type where a.predicted is not null and b.predicted is not null),
m as (select cohort_id, status from {local_match_sql('pr')} m0), v as (select cohort_id, bool_or(status = 'MISMATCH') as bad, bool_or(status in ('MINOR_DIFFERENCE', 'NEEDS_REVIEW')) as minor from m group by 1),
f as (select cohort_id, count(*) as n, count(predicted) as nn, min(p_dob) <> max(p_dob) as dd from fc group by 1),
s as (select ex.cohort_id, ex.expected, case when coalesce(n, 0) < 2 or coalesce(nn, 0) < 2 then 'INSUFFICIENT DATA' when coalesce(bad, false) or coalesce(dd, false) then 'SIGNIFICANT CONFLICT' when coalesce(minor, false) then 'MINOR DIFFERENCE' else 'CONSISTENT' end as actual
 from ex left join f using (cohort_id) left join v using (cohort_id))
select *, actual = replace(expected, '_', ' ') as passed from s""")
def cohort_check(spark, base):
    r = results(spark, base)
    n = F.replace("cohort_id", F.lit("COHORT_"), F.lit("")).cast("bigint") % 3
    expected = r.select("cohort_id").distinct().withColumn("expected", F.when(n == 0, "CONSISTENT").when(n == 1, "MINOR_DIFFERENCE").otherwise("SIGNIFICANT CONFLICT"))
    return O.cohort_check(r, expected)


_N = lambda s, c: f"count(*) filter ({c} = '{s}')"


@job("run_delta", "A15", sql="select document_type, " + ", ".join(
    f"{_N(s, 'status_before')} as {s.lower()}_before, {_N(s, 'status')} as {s.lower()}_after, {_N(s, 'status')} - {_N(s, 'status_before')} as {s.lower()}_change"
    for s in ("NOT_DETECTED", "NEEDS_REVIEW", "HIGH_CONFIDENCE")) + f" from ({RESULTS}) r group by 1")
def run_delta(spark, base):
    r = results(spark, base)
    return O.run_delta(r.select("document_type", F.col("status_before").alias("status")), r, ["document_type"])


@job("fixture_outcomes", "J10", sql=f"""with r as ({RESULTS}), first as (select * from (select image_path, predicted, status, row_number() over (partition by image_path order by manifest_ord) as rn from r) where rn = 1),
fx as (select c_custkey as fixture_id, concat('img_', cast(c_custkey * 3 % 12000 as varchar), '.jpg') as image_path, case c_custkey % 2 when 0 then 'ARUN KUMAR K' else 'DIVYA R' end as truth from customer)
select fixture_id, fx.image_path, truth, f.predicted as actual, coalesce(f.status, 'NOT_DETECTED') as status, case when {_ALNUM("coalesce(f.predicted, 'NOT_DETECTED')")} = {_ALNUM('truth')} then 'RECOVERED' else 'MISSING' end as outcome
from fx left join first f on f.image_path = fx.image_path""")
def fixture_outcomes(spark, base):
    k = F.col("c_custkey")
    fixtures = table(spark, base, "customer").select(
        k.alias("fixture_id"), F.concat(F.lit("img_"), (k * 3 % 12000).cast("string"), F.lit(".jpg")).alias("image_path"), F.when(k % 2 == 0, "ARUN KUMAR K").otherwise("DIVYA R").alias("truth"))
    return O.lookup_fixtures(fixtures, results(spark, base))


@job("assigned_splits", "S7", sql="""with d as (select doc_id, row_number() over (order by doc_id) - 1 as ordinal, count(*) over () as n from documents)
select doc_id, ordinal, case when ordinal * 1.0 / n < 0.7 then 'train' when ordinal * 1.0 / n < 0.85 then 'validation' else 'test' end as split from d""")
def assigned_splits(spark, base):
    return O.assign_split(table(spark, base, "documents").select("doc_id"), "doc_id")


@job("expanded_variants", "S8", sql=f"select doc_id, unnest([{quoted(O.VARIANTS)}]) as variant from documents")
def expanded_variants(spark, base):
    return O.expand_variants(table(spark, base, "documents").select("doc_id"))


def _inst_sql(x: str) -> str:
    out = f"upper({x})"
    for pattern, short in INSTITUTION_ABBREVIATIONS:
        out = f"regexp_replace({out}, {lit(pattern)}, '{short}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@job("compared_institutions", "N8", sql=f"""with d as (select school_a, school_b, count(*) as n from ({RESULTS}) r group by 1, 2), k as (select *, {_inst_sql('school_a')} as a, {_inst_sql('school_b')} as b from d),
w as (select *, list_filter(string_split(a, ' '), lambda x: length(x) > 2) as wa, list_filter(string_split(b, ' '), lambda x: length(x) > 2) as wb from k),
o as (select *, case when a is null or b is null or a = '' or b = '' then null when a = b then 1.0 when least(len(wa), len(wb)) = 0 then 0.0 else len(list_filter(wa, lambda x: list_contains(wb, x))) * 1.0 / greatest(len(wa), len(wb)) end as ov from w)
select school_a, school_b, n, case when ov is null then 'MISSING' when ov >= 0.7 then 'MATCH' when ov >= 0.45 then 'LIKELY' else 'DIFFERENT' end as status, round(cast(coalesce(ov, 0) as double), 2) as score from o""")
def compared_institutions(spark, base):
    pairs = results(spark, base).groupBy("school_a", "school_b").agg(F.count(F.lit(1)).alias("n"))
    return O.compare_institutions(pairs, "school_a", "school_b")


@job("parsed_props", "S1", sql="select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, not json_valid(props) as is_corrupt from events")
def parsed_props(spark, base):
    e = S.parse_json_column(table(spark, base, "events").select("event_id", "props"), "props", "k bigint")
    return e.select("event_id", "parsed.k", F.col(f"parsed.{S.CORRUPT}").isNotNull().alias("is_corrupt"))


@job("latest_event_per_user", "S3", sql="select user_id, event_type, value, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1")
def latest_event_per_user(spark, base):
    return S.dedup_latest(table(spark, base, "events").select("user_id", "event_type", "value", "event_id").withColumn("ord", F.col("event_id")), ["user_id"], "ord").drop("ord")


INTAKE_SQL = "case " + " ".join(
    f"when length(coalesce({n}, '')) > {m} then '{n}_too_long'" + (f" when coalesce(email, '') <> '' and not regexp_matches(email, '{S.EMAIL}') then 'email_invalid'" if n == "email" else "")
    for n, m in S.INTAKE_LIMITS.items()) + """ when rating < 0 or rating > 5 then 'rating_out_of_range' when length(coalesce(captcha_token, '')) not between 20 and 4096 then 'token_invalid'
 when trim(coalesce(name, '')) = '' and trim(coalesce(email, '')) = '' and trim(coalesce(issue_type, '')) = '' and trim(coalesce(message, '')) = '' and trim(coalesce(comment, '')) = '' and rating = 0 then 'empty' end"""


@job("intake_verdicts", "S6", sql=f"""with i as (select *, {INTAKE_SQL} as reject_reason from ({INTAKE}) i0)
select record_id, reject_reason, case when reject_reason is null then trim(coalesce(name, '')) else name end as name from i""")
def intake_verdicts(spark, base):
    return S.judge_intake(sql_over(spark, base, INTAKE)).select("record_id", "reject_reason", "name")


@job("upload_verdicts", "S9", sql=f"""with f as (select *, lower(string_split(path, '.')[-1]) as ext from ({FILES}) f0), a as (select *, coalesce(mime in ({quoted(S.UPLOAD_TYPES)}), false) or ext in ({quoted(S.UPLOAD_EXTENSIONS)}) as ok, coalesce(mime = 'application/pdf', false) or ext = 'pdf' as pdf from f)
select file_id, case when not ok then 'unsupported_format' when length > {S.MAX_UPLOAD_BYTES} then 'too_large' when pdf and pages > 3 then 'too_many_pages' else 'accepted' end as verdict from a""")
def upload_verdicts(spark, base):
    return S.upload_admission(sql_over(spark, base, FILES)).select("file_id", "verdict")
