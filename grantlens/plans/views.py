"""Derived inputs: applicants, case documents, certificate texts, utterances, pixels.

Each is one SELECT over the given tables, written so that Spark and the comparison
engine read the same text; they grow with the tables they derive from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grantlens.session import sql_over

AS_OF = "2026-06-01"

APPLICANTS = """
select c_custkey as applicant_id, c_name as applicant_name,
 case c_custkey % 8 when 0 then 'SC' when 1 then 'ST' when 2 then 'BC' when 3 then 'MBC' when 4 then 'DNC' when 5 then 'OBC' when 6 then 'General' else null end as category,
 case when c_custkey % 11 = 0 then null else cast(floor(abs(c_acctbal) * 60) as bigint) end as income,
 case (c_custkey * 5) % 3 when 0 then 'Girls' when 1 then 'Boys' else null end as gender,
 case (c_custkey * 3) % 7 when 0 then null when 1 then 'Kerala' when 2 then 'Maharashtra' else 'Tamil Nadu' end as state,
 case (c_custkey * 7) % 10 when 0 then 'Salem' when 1 then 'Madurai' when 2 then 'Chennai' else null end as district,
 case (c_custkey * 11) % 13 when 0 then 'Engineering' when 1 then 'Engineering' when 2 then 'Medical' when 3 then 'Arts' when 4 then 'Science' when 5 then 'Diploma' when 6 then 'School' when 7 then 'All' else null end as course,
 case (c_custkey * 13) % 9 when 0 then true when 1 then false else null end as disabled,
 case (c_custkey * 17) % 5 when 0 then true when 1 then false else null end as govt_school,
 case (c_custkey * 19) % 6 when 0 then true when 1 then false else null end as agri_labor,
 case (c_custkey * 23) % 7 when 0 then true when 1 then false else null end as armed_forces,
 case (c_custkey * 29) % 4 when 0 then true when 1 then false else null end as first_graduate,
 case (c_custkey * 31) % 3 when 0 then 'government' when 1 then 'management' else 'unknown' end as quota_type
from customer
"""

CASE_DOCUMENTS = """
select distinct case_id, ord,
 case ord when 1 then 'identity' when 2 then 'community' when 3 then 'income' when 4 then 'ms10' when 5 then 'ms12' when 6 then 'bank' else case case_id % 3 when 0 then 'income' when 1 then 'bonafide' else 'disability' end end as doc_type,
 case v when 0 then concat(base, ' ', ini) when 1 then concat(ini, '. ', base) when 2 then base when 3 then concat('Thiru. ', base, ' ', ini) when 4 then concat(replace(base, 'A', 'E'), ' ', ini) when 5 then concat(base, ' ', ini, ' EXTRA') when 6 then concat(lower(base), ' ', lower(ini)) else null end as name,
 case v when 1 then concat('MURUGAN ', ini) when 2 then concat('Murugan. ', ini) when 4 then concat('SELVAM ', ini) when 6 then 'null' else null end as parent_name,
 case v when 5 then concat(yy, '-', mm, '-', dd) when 6 then concat(dd, '/', mm, '/', yy) when 7 then '31-02-2005' else concat(dd, '-', mm, '-', yy) end as dob
from (select l_orderkey as case_id, l_linenumber as ord, (l_orderkey * 7 + l_linenumber * 3) % 8 as v,
  case o_custkey % 6 when 0 then 'ARUN KUMAR' when 1 then 'PRIYADHARSHINI' when 2 then 'KARTHIKEYAN' when 3 then 'SENTHIL KUMAR' when 4 then 'BALASUBRAMANIAM' else 'DIVYA' end as base,
  case o_custkey % 4 when 0 then 'K' when 1 then 'S' when 2 then 'M' else 'R' end as ini,
  lpad(cast(1 + o_custkey % 28 as varchar(2)), 2, '0') as dd, lpad(cast(1 + o_custkey % 12 as varchar(2)), 2, '0') as mm, cast(2003 + o_custkey % 6 as varchar(4)) as yy
 from lineitem join orders on l_orderkey = o_orderkey) b
"""


# Form input as typed by applicants: text codes, text income, yes/no answers.
FORMS = """
select c_custkey as applicant_id, c_name as student_name,
 case c_custkey % 9 when 0 then 'SC' when 1 then 'st' when 2 then 'BC' when 3 then 'MBC' when 4 then ' DNC ' when 5 then 'OBC' when 6 then 'GEN' when 7 then 'Muslim' else 'Jain' end as community,
 case when c_custkey % 13 = 0 then null else cast(floor(abs(c_acctbal) * 60) as bigint) end as income,
 case (c_custkey * 5) % 7 when 0 then 'ug' when 1 then 'PG' when 2 then 'diploma' when 3 then 'iti' when 4 then 'phd' when 5 then '' else null end as course,
 case when (c_custkey * 23) % 7 = 0 then 'yes' else 'no' end as armed_forces,
 case (c_custkey * 3) % 5 when 0 then '1st' when 1 then '2nd' when 2 then '3rd' when 3 then '4th' else null end as current_year,
 case (c_custkey * 31) % 3 when 0 then 'government' when 1 then 'management' else 'other' end as quota_type,
 case (c_custkey * 7) % 4 when 0 then 'Girls' when 1 then 'boy' when 2 then 'x' else '' end as gender,
 case (c_custkey * 3) % 7 when 0 then null when 1 then 'KL' when 2 then 'maharashtra' when 3 then 'Tamilnadu' when 4 then 'up' when 5 then 'Assam' else 'Goa' end as state,
 case (c_custkey * 7) % 10 when 0 then 'Salem' when 1 then 'All' when 2 then 'Chennai' else null end as district,
 case (c_custkey * 29) % 4 when 0 then 'yes' when 1 then 'false' when 2 then 'maybe' else null end as first_graduate
from customer
"""

# Uploads: the document types of a case, plus one row with an empty type now and then.
UPLOADS = """
select l_orderkey as case_id, case when (l_orderkey + l_linenumber) % 3 = 0 then 'photo' else case l_linenumber when 1 then 'aadhaar_card' when 2 then 'community_certificate' when 3 then 'income'
 when 4 then 'tenth_marksheet' when 5 then 'bank_passbook' when 6 then 'bonafide' else '' end end as upload_type
from lineitem
"""


# Several extraction passes of one document.
PASSES = """
select distinct l_orderkey as doc_id, l_linenumber as pass_no,
 case when (l_orderkey * 3 + l_linenumber) % 7 = 0 then null when (l_orderkey + l_linenumber) % 5 = 0 then concat('Arun Kumer ', case l_linenumber % 2 when 0 then 'K' else 'S' end)
  when (l_orderkey + l_linenumber) % 11 = 0 then 'Priya D.' when l_orderkey % 3 = 0 then 'Arun Kumar' else case l_linenumber % 3 when 0 then 'ARUN KUMAR' else 'Arun  Kumar' end end as name,
 cast(60 + (l_orderkey * 7 + l_linenumber * 11) % 35 as double) / 100 as name_conf,
 case when (l_orderkey * 5 + l_linenumber) % 4 = 0 then null else cast(300 + (l_orderkey * 13 + l_linenumber * 17) % 200 as varchar(3)) end as marks,
 cast(50 + (l_orderkey * 3 + l_linenumber * 19) % 45 as double) / 100 as marks_conf,
 case when (l_orderkey + l_linenumber * 2) % 3 = 0 then null when l_linenumber % 2 = 0 then 'GOVT HSS SALEM' else 'GOVT HSS, MADURAI' end as school,
 cast(70 + (l_orderkey + l_linenumber * 7) % 25 as double) / 100 as school_conf,
 case when (l_orderkey + l_linenumber) % 2 = 0 then concat('0', cast(1 + l_linenumber as varchar(1)), '-05-2006') else null end as dob,
 case when (l_orderkey * 2 + l_linenumber) % 3 = 0 then cast(10000000 + l_orderkey * 10 + l_linenumber as varchar(12)) else null end as register_number,
 cast(55 + (l_orderkey * 11 + l_linenumber * 3) % 41 as double) as engine_conf
from lineitem
"""

# The same passes as rows of fields, some without a confidence: field -> (value, confidence).
PASS_KIND = "case doc_id % 4 when 0 then 'ms10' when 1 then 'ms12' when 2 then 'community' else 'income' end"
PASS_FIELDS = {
    "name": ("name", "case when doc_id % 5 = 0 then null else name_conf end"),
    "marks": ("case when doc_id % 7 = 3 then null else marks end", "case when (doc_id + pass_no) % 6 = 0 then null else marks_conf end"),
    "max_marks": ("case when marks is null then null else '500' end", "marks_conf"),
    "percentage": ("case when pass_no % 2 = 0 then concat(cast(40 + (doc_id + pass_no) % 50 as varchar(3)), '%') end", "cast(null as double)"),
    "grade": ("case when pass_no % 3 = 1 then 'A' when pass_no % 3 = 2 then '' end", "cast(null as double)"),
    "school": ("school", "case when (doc_id + pass_no) % 3 = 0 then null else school_conf end"),
    "dob": ("dob", "school_conf"),
    "register_number": ("register_number", "marks_conf"),
    "district": ("case when (doc_id + pass_no) % 3 > 0 then concat('Salem ', cast(pass_no as varchar(3))) end", "name_conf"),
    "income": ("case when pass_no % 2 = 1 then cast(20000 + doc_id as varchar(12)) end", "cast(null as double)"),
}

# What a case states and what its certificates show.
CASE_FACTS = """
select o_orderkey as case_id,
 case o_orderkey % 6 when 0 then concat('Rs. ', cast(amount as varchar(12)), '/-') when 1 then concat('INR ', cast(amount as varchar(12)), '.00') when 2 then null when 3 then concat('-', cast(amount as varchar(12)))
  else cast(amount as varchar(12)) end as income_certificate,
 case o_orderkey % 5 when 0 then cast(amount + 1000 as varchar(12)) when 1 then null when 2 then concat(cast(amount as varchar(12)), ' rupees') else cast(amount as varchar(12)) end as income_stated,
 case o_orderkey % 7 when 0 then null when 1 then '31-02-2026' when 2 then concat('2026-', mm, '-', dd) else concat(dd, '/', mm, '/', case when o_orderkey % 2 = 0 then '2025' else '2026' end) end as issue_date,
 case o_orderkey % 4 when 0 then concat(dd, '.', mm, '.2026') else null end as valid_upto,
 case o_orderkey % 8 when 0 then 'SC' when 1 then 'Most Backward Class (MBC)' when 2 then 'backward classes' when 3 then 'Other Backward Class' when 4 then null when 5 then 'Hindu - Scheduled Caste' when 6 then 'x (gen)' else 'Forward class people' end as community_certificate,
 case o_orderkey % 3 when 0 then 'SC' when 1 then 'MBC' else 'bc' end as community_stated,
 case o_orderkey % 4 when 0 then 'Single' when 1 then 'Joint' when 2 then 'Single' else null end as account_type,
 case when o_custkey % 4 = 0 then 'parent' else 'student' end as income_applicant
from (select o_orderkey, o_custkey, 50000 + (o_orderkey * 7919) % 500 * 1000 as amount, lpad(cast(1 + o_orderkey % 28 as varchar(2)), 2, '0') as dd,
  lpad(cast(1 + o_orderkey % 12 as varchar(2)), 2, '0') as mm from orders) o
"""

# Applications: profile and document evidence of one case in one row.
CASES = """
select k as case_id, s as scheme_no,
 case when k % 31 = 0 then null else full_name end as student_name, concat('MURUGAN ', ini) as parent_name,
 case when k % 4 = 0 then 'parent' else 'student' end as income_applicant, case when k % 17 = 0 then null else concat(dd, '-', mm, '-', yy) end as dob,
 category, income, gender, state, district, course, disabled, govt_school, agri_labor, armed_forces, first_graduate, quota_type,
 case k % 5 when 0 then 'Undergraduate' when 1 then 'ug' when 2 then 'Diploma' when 3 then null else 'Postgraduate' end as level,
 case k % 3 when 0 then 'GOVT COLLEGE SALEM' when 1 then 'Anna University' else null end as institution,
 case k % 6 when 0 then '2025-26' when 1 then null else '2026-27' end as academic_year, k % 5 = 1 as is_renewal,
 case k % 3 when 0 then true when 1 then false else null end as otr_generated, case k % 4 when 0 then true when 1 then false else null end as face_auth_device,
 case when k % 9 in (0, 1) then cast(30 + k % 40 as int) else null end as disability_percentage, k % 9 in (0, 1, 2) as disability,
 case k % 8 when 0 then full_name when 1 then concat(ini, ' ', base) when 2 then concat(replace(base, 'A', 'E'), ' ', ini) when 3 then null when 4 then lower(full_name) else full_name end as aadhaar_name,
 case k % 7 when 0 then concat(yy, '-', mm, '-', dd) when 1 then null when 2 then concat(dd, '/', mm, '/', yy) else concat(dd, '-', mm, '-', yy) end as aadhaar_dob,
 case k % 10 when 0 then null when 1 then 'RAMESH BABU' when 2 then concat(replace(base, 'A', 'E'), ' ', ini) else full_name end as tenth_name,
 case k % 11 when 0 then '01-01-2001' when 1 then null else concat(dd, '.', mm, '.', yy) end as tenth_dob,
 case k % 13 when 0 then 'RAMESH BABU' when 1 then null else full_name end as twelfth_name, case k % 6 when 0 then null else full_name end as bonafide_name,
 case k % 12 when 0 then 'MURUGAN K' when 1 then null else full_name end as bank_holder, k % 9 <> 4 as has_income_doc,
 case when k % 9 = 4 then null when k % 4 = 0 then concat('MURUGAN ', ini) when k % 6 = 1 then 'RAMESH BABU' when k % 6 = 2 then null else full_name end as income_name,
 case when k % 9 = 4 or k % 5 = 3 then null when k % 5 = 1 then cast(floor(income * 1.05) as bigint) when k % 5 = 2 then income * 2 else income end as income_value,
 case when k % 9 = 4 or k % 6 = 0 then null else 'TN-1234567' end as income_cert_number, case when k % 9 = 4 or k % 7 = 0 then null else 'Tahsildar' end as income_authority,
 case when k % 9 = 4 or k % 7 = 0 then null when k % 7 = 1 then '31-02-2026' when k % 7 = 2 then concat('2026-', mm, '-', dd) else concat(dd, '/', mm, '/', case when k % 2 = 0 then '2025' else '2026' end) end as income_issue_date,
 case when k % 9 <> 4 and k % 4 = 0 then concat(dd, '.', mm, '.2026') else null end as income_expiry_date,
 case k % 5 when 0 then category when 1 then 'SC' when 2 then null else category end as community_category,
 case k % 6 when 0 then course when 1 then 'Enginering' when 2 then 'Commerce' else null end as doc_course,
 case k % 4 when 0 then 'ANNA UNIVERSITY' when 1 then 'GOVT COLLEGE OF SALEM' when 2 then null else 'XYZ POLYTECHNIC' end as doc_institution,
 case k % 3 when 0 then 'tamil nadu' when 1 then 'Kerala' else null end as doc_state,
 case k % 5 when 0 then 'SBIN0001234' when 1 then 'sbin0001234 ' when 2 then 'BAD' else null end as ifsc,
 case k % 4 when 0 then true when 1 then false else null end as aadhaar_bank_linked, k % 3 = 0 as disability_cert,
 case k % 4 when 0 then 'aadhaar_card,income,bank_passbook' when 1 then 'community_certificate,tenth_marksheet,bonafide,income' when 2 then ''
  else 'aadhaar,income,community,bank_passbook,bonafide,class 12 marksheet,disability' end as uploads,
 case k % 10 when 0 then 'income' when 1 then 'ms10,bank' else '' end as wrong_types, case k % 8 when 0 then 'ms10' when 1 then 'ms10,ms12,income' else '' end as low_quality,
 k % 2 = 0 as previous_year_marks, cast(40 + k % 60 as int) as tenth_conf, cast(45 + k % 50 as int) as twelfth_conf, case when k % 3 = 0 then null else cast(35 + k % 65 as int) end as income_conf,
 cast(30 + k % 70 as int) as community_conf
from (select o_orderkey as k, o_orderkey % 27 as s, base, ini, concat(base, ' ', ini) as full_name, dd, mm, yy, a.* from
 (select o_orderkey, o_custkey, case o_custkey % 6 when 0 then 'ARUN KUMAR' when 1 then 'PRIYADHARSHINI' when 2 then 'KARTHIKEYAN' when 3 then 'SENTHIL KUMAR' when 4 then 'BALASUBRAMANIAM' else 'DIVYA' end as base,
  case o_custkey % 4 when 0 then 'K' when 1 then 'S' when 2 then 'M' else 'R' end as ini, lpad(cast(1 + o_custkey % 28 as varchar(2)), 2, '0') as dd,
  lpad(cast(1 + o_custkey % 12 as varchar(2)), 2, '0') as mm, cast(2003 + o_custkey % 6 as varchar(4)) as yy from orders) o
 join (""" + APPLICANTS.strip() + """) a on a.applicant_id = o.o_custkey) c
"""

# Cases with everything that their documents show.
EVIDENCE = """
select c.*, case case_id % 6 when 0 then student_name when 1 then 'RAMESH BABU' when 2 then ' ' else null end as community_holder,
 case case_id % 9 when 0 then null when 1 then '02-02-2002' else dob end as twelfth_dob,
 case case_id % 5 when 2 then '' when 3 then 'Hindu Vanniyar' else category end as community_name,
 case case_id % 5 when 0 then concat(cast(40 + case_id % 55 as varchar(3)), '.50%') when 1 then 'pass' when 2 then '' else null end as tenth_percentage,
 case case_id % 4 when 0 then concat(cast(35 + case_id % 65 as varchar(3)), '%') else null end as twelfth_percentage,
 case when case_id % 8 = 0 then null else cast(200 + case_id % 300 as integer) end as tenth_scored, cast(case case_id % 7 when 0 then 0 when 1 then null else 500 end as integer) as tenth_maximum,
 case when case_id % 6 = 0 then null else cast(250 + case_id % 350 as integer) end as twelfth_scored, cast(case case_id % 9 when 0 then null else 600 end as integer) as twelfth_maximum,
 case case_id % 3 when 0 then 'RAMAN' when 1 then '' else null end as community_father, case case_id % 4 when 0 then parent_name else null end as income_father,
 case case_id % 5 when 0 then 'Selvam K' else null end as twelfth_father, case case_id % 7 when 0 then null else 'Murugesan' end as tenth_father,
 case case_id % 4 when 0 then 'Kerala' when 1 then '' else null end as community_state, case case_id % 3 when 0 then 'Karnataka' else null end as income_state,
 case case_id % 5 when 0 then 'Erode' else null end as community_district, case case_id % 3 when 0 then 'Theni' else null end as income_district, case case_id % 2 when 0 then 'Salem' else null end as doc_district,
 case case_id % 4 when 0 then upper(gender) when 1 then 'female' when 2 then null else gender end as aadhaar_gender,
 case when case_id % 5 = 0 then null else cast(2018 + case_id % 6 as varchar(4)) end as tenth_year, case when case_id % 4 = 0 then null else cast(2020 + case_id % 6 as varchar(4)) end as twelfth_year,
 case case_id % 3 when 0 then 'CBSE' else 'State Board' end as tenth_board, case case_id % 5 when 0 then '' when 1 then null else 'State Board' end as twelfth_board,
 concat('R', cast(case_id as varchar(12))) as tenth_register_number, case when case_id % 3 = 0 then concat('H', cast(case_id as varchar(12))) else null end as twelfth_register_number,
 case case_id % 6 when 0 then null when 1 then '30-02-2020' when 2 then '15/03/2019' when 3 then '2021-05-28' else '01.04.2024' end as community_issue_date,
 case case_id % 3 when 0 then '2025-26' else null end as income_year, case case_id % 5 when 0 then 'Joint' when 1 then 'Savings' else null end as account_type,
 case case_id % 4 when 0 then 'Kerala' else null end as domicile, case case_id % 3 when 0 then true when 1 then false else null end as first_graduate_cert
from (""" + CASES.strip() + """) c
"""

# Names of parents as applications give them and as income certificates print them.
PROVIDERS = """
select case_id, case case_id % 3 when 0 then 'student' when 1 then 'parent' else income_applicant end as income_applicant,
 case case_id % 7 when 0 then null when 1 then '' else parent_name end as parent_name, case case_id % 14 when 0 then 'Thiru. Selvam K' else null end as father_name, 'Kamala' as mother_name,
 case case_id % 8 when 0 then concat('Murugan. ', substring(parent_name, 9, 1)) when 1 then 'MURUGAN' when 2 then 'MURUGEN K' when 3 then 'null' when 4 then '  ' when 5 then student_name else parent_name end as income_name
from (""" + CASES.strip() + """) c
"""

# Questions: what users wrote, and one templated question per customer.
UTTERANCES = """
select conv_id * 1000 + turn as utterance_id, text from conversations where role = 'user'
union all
select 1000000000 + c_custkey as utterance_id,
 case c_custkey % 24
  when 0 then concat('I am ', cat, ' ', lower(course), ' student from ', dist, ', family income is ', lakh, ' lakh')
  when 1 then concat('what is ', acr, '?') when 2 then concat('what is the eligibility for ', lower(st), ' ', lower(cat), ' ', lower(course), ' scholarship')
  when 3 then 'Hi' when 4 then concat('am i eligible for ', cat, ' scholarship? income ', cast(amount as varchar(12))) when 5 then 'who are you'
  when 6 then concat('documents needed for ', st, ' ', lower(cat), ' ', lower(course), ' scholarship') when 7 then 'how to apply on NSP'
  when 8 then concat(pct, '% disability ', lower(course), ' student') when 9 then concat('my salary was Rs ', cast(amount as varchar(12)), ' a year')
  when 10 then 'why should i apply for scholarship' when 11 then concat('full form of ', acr, ' and UGC') when 12 then 'check dbt status, npci mapping'
  when 13 then concat('first graduate ', case c_custkey % 2 when 0 then 'boy' else 'girl' end, ' from ', st, ' govt school') when 14 then 'my application rejected, name mismatch in aadhaar'
  when 15 then concat('7.5% quota for ', lower(course)) when 16 then cast(amount as varchar(12)) when 17 then 'is aadhaar mandatory'
  when 18 then concat('son of farmer in ', dist, ' earning ', lakh, ' lpa, studying B.Sc') when 19 then concat('last date to apply for ', lower(st), ' ', lower(cat), ' ', lower(course))
  when 20 then concat('ex-servicemen ward, class 12, private school, tn, income around ', cast(c_custkey % 90 + 10 as varchar(3)), 'k') when 21 then 'umis portal renewal process'
  when 22 then concat('2,', cast(10 + c_custkey % 89 as varchar(2)), ',000 annual income general category') else concat('tell me about the weather in ', dist) end as text
from (select c_custkey, case c_custkey % 7 when 0 then 'SC' when 1 then 'ST' when 2 then 'OBC' when 3 then 'Minority' when 4 then 'EWS' when 5 then 'General' else 'MBC' end as cat,
 case c_custkey % 5 when 0 then 'Engineering' when 1 then 'Medical' when 2 then 'Arts' when 3 then 'Science' else 'Diploma' end as course,
 case c_custkey % 11 when 0 then 'Salem' when 1 then 'Madurai' when 2 then 'Erode' when 3 then 'Mumbai' else 'Theni' end as dist,
 case c_custkey % 13 when 0 then 'Karnataka' when 1 then 'Tamil Nadu' when 2 then 'West Bengal' when 3 then 'up' when 4 then 'Kerala' else 'Bihar' end as st,
 case c_custkey % 4 when 0 then 'NSP' when 1 then 'DBT' when 2 then 'PFMS' else 'EMIS' end as acr, concat(cast(1 + c_custkey % 9 as varchar(1)), '.5') as lakh,
 20000 + (c_custkey * 7919) % 500 * 1000 as amount, cast(20 + c_custkey % 60 as varchar(2)) as pct from customer) c
"""

# Texts: the documents, the pages without their tags, and one templated certificate per order.
CERTIFICATES = """
select o_orderkey as doc_id, slot,
 case slot
  when 'income' then concat('GOVERNMENT OF TAMIL NADU\nINCOME CERTIFICATE\nCertificate No: TN-', cast(1000000 + o_orderkey as varchar(12)), '\nThis is to certify that ', nm, ' son of MURUGAN ', ini, ' residing at Salem Taluk\nAnnual Income: Rs. ', cast(amount as varchar(12)), ' per annum\nDate of Issue: ', issued, '\nTahsildar')
  when 'community' then concat('COMMUNITY CERTIFICATE\nThis is to certify that ', nm, ' daughter of RAMAN ', ini, ' belongs to Hindu ', cat, ' community\nTaluk: Omalur\nDistrict: Salem\nCert No: REV/2024/', cast(10000 + o_orderkey % 90000 as varchar(8)), '\nDate of Issue: ', issued)
  when 'ms10' then concat('STATE BOARD OF SCHOOL EXAMINATIONS, TAMIL NADU\nSECONDARY SCHOOL LEAVING CERTIFICATE\nNAME OF THE CANDIDATE: ', nm, '\nDATE OF BIRTH: ', dob, '\nTAMIL 0', cast(60 + o_orderkey % 39 as varchar(2)), '\nENGLISH 0', cast(55 + o_orderkey % 44 as varchar(2)), '\nMATHEMATICS 0', cast(50 + o_orderkey % 49 as varchar(2)), '\nTOTAL MARKS ', cast(scored as varchar(4)), ' / 500\nRESULT: PASS\nNAME OF THE SCHOOL: GOVT HIGHER SECONDARY SCHOOL')
  when 'ms12' then concat('HIGHER SECONDARY COURSE CERTIFICATE\nSTATEMENT OF MARKS\nNAME OF THE CANDIDATE\n', nm, '\nPHYSICS 0', cast(60 + o_orderkey % 39 as varchar(2)), '\nCHEMISTRY 0', cast(55 + o_orderkey % 44 as varchar(2)), '\nBIOLOGY 0', cast(50 + o_orderkey % 49 as varchar(2)), '\nGRAND TOTAL: ', cast(scored as varchar(4)), '/600\nPERCENTAGE: ', cast(scored % 60 + 35 as varchar(3)), '%\nREGISTER NUMBER: ', cast(20000000 + o_orderkey as varchar(12)))
  when 'bankpass' then concat('CANARA BANK\nSAVINGS BANK PASSBOOK\nAccount Number: ', cast(100000000000 + o_orderkey as varchar(14)), '\nIFSC: CNRB0001234\nCHENNAI')
  else concat('S0METHING UNREAD ', ini) end as text
from (select o_orderkey, case o_orderkey % 6 when 0 then 'income' when 1 then 'community' when 2 then 'ms10' when 3 then 'ms12' when 4 then 'bankpass' else 'aadhaar' end as slot,
 concat(case o_custkey % 6 when 0 then 'ARUN KUMAR' when 1 then 'PRIYADHARSHINI' when 2 then 'KARTHIKEYAN' when 3 then 'SENTHIL KUMAR' when 4 then 'BALASUBRAMANIAM' else 'DIVYA' end, ' ', case o_custkey % 4 when 0 then 'K' when 1 then 'S' when 2 then 'M' else 'R' end) as nm,
 case o_custkey % 4 when 0 then 'K' when 1 then 'S' when 2 then 'M' else 'R' end as ini, 20000 + (o_orderkey * 7919) % 500 * 1000 as amount,
 case o_orderkey % 5 when 0 then 'SC' when 1 then 'MBC' when 2 then 'BC' when 3 then 'ST' else 'Most Backward Class' end as cat, 250 + o_orderkey % 240 as scored,
 concat(lpad(cast(1 + o_orderkey % 28 as varchar(2)), 2, '0'), '-', lpad(cast(1 + o_orderkey % 12 as varchar(2)), 2, '0'), '-', case when o_orderkey % 4 = 0 then '2024' else '2026' end) as issued,
 concat(lpad(cast(1 + o_custkey % 28 as varchar(2)), 2, '0'), '/', lpad(cast(1 + o_custkey % 12 as varchar(2)), 2, '0'), '/', cast(2003 + o_custkey % 6 as varchar(4))) as dob from orders) o
"""
TEXTS = """
select concat('d', cast(doc_id as varchar(20))) as text_id, text from documents
union all select concat('p', cast(page_id as varchar(20))) as text_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as text from pages
union all select concat('c', cast(doc_id as varchar(20))) as text_id, text from (""" + CERTIFICATES.strip() + """) c
"""

# Results of an extraction run with their truth.
RESULTS = """
select o_orderkey as manifest_ord, concat('img_', cast(o_orderkey % 9000 as varchar(8)), '.jpg') as image_path, concat('COHORT_', cast(o_custkey as varchar(10))) as cohort_id,
 case o_orderkey % 4 when 0 then '10th_marksheet' when 1 then '12th_marksheet' when 2 then 'community_certificate' else 'income_certificate' end as document_type,
 case o_orderkey % 3 when 0 then 'shadow_uneven' else 'clean_scan' end as degradation, nm as truth,
 case o_orderkey % 11 when 0 then null when 1 then replace(nm, 'A', 'E') when 2 then concat(nm, ' X') when 3 then lower(nm) when 4 then 'RAMESH BABU' when 5 then replace(nm, 'I', '1') when 6 then base else nm end as predicted,
 dob as t_dateOfBirth, case o_orderkey % 13 when 0 then null when 1 then '01-01-2001' else replace(dob, '-', '/') end as p_dob,
 cast(35 + (o_orderkey * 17) % 64 as int) as confidence,
 case when o_orderkey % 11 = 0 then 'NOT_DETECTED' when 35 + (o_orderkey * 17) % 64 >= 75 then 'HIGH_CONFIDENCE' else 'NEEDS_REVIEW' end as status,
 case when o_orderkey % 5 = 0 then 'NOT_DETECTED' when 35 + (o_orderkey * 11) % 64 >= 80 then 'HIGH_CONFIDENCE' else 'NEEDS_REVIEW' end as status_before,
 concat('TN-', cast(1000000 + o_orderkey as varchar(12))) as t_certificateNumber, case o_orderkey % 9 when 0 then null when 1 then concat('TN-', cast(1000001 + o_orderkey as varchar(12))) else concat('tn ', cast(1000000 + o_orderkey as varchar(12))) end as p_certificateNumber,
 concat(cast(35 + o_orderkey % 60 as varchar(3)), '.5') as t_percentage, case o_orderkey % 8 when 0 then null when 1 then concat(cast(38 + o_orderkey % 60 as varchar(3)), '.5%') else concat(cast(36 + o_orderkey % 60 as varchar(3)), '.0%') end as p_percentage,
 concat('MURUGAN ', ini) as t_parentName, case o_orderkey % 7 when 0 then null when 1 then 'MURUGEN' else concat('Murugan ', ini) end as p_parentName,
 case o_orderkey % 4 when 0 then 'GOVT HR SEC SCHOOL, SALEM' when 1 then 'Government Higher Secondary School Salem' when 2 then 'ANNA ENGINEERING COLLEGE' else null end as school_a,
 case o_orderkey % 5 when 0 then 'GOVT. HIGHER SECONDARY SCHOOL SALEM' when 1 then 'Anna Engg. College Chennai' when 2 then 'Govt HSS' else 'XYZ MATRICULATION SCHOOL' end as school_b
from (select o_orderkey, o_custkey, base, ini, concat(base, ' ', ini) as nm, concat(lpad(cast(1 + o_custkey % 28 as varchar(2)), 2, '0'), '-', lpad(cast(1 + o_custkey % 12 as varchar(2)), 2, '0'), '-', cast(2003 + o_custkey % 6 as varchar(4))) as dob from
 (select o_orderkey, o_custkey, case o_custkey % 6 when 0 then 'ARUN KUMAR' when 1 then 'PRIYADHARSHINI' when 2 then 'KARTHIKEYAN' when 3 then 'SENTHIL KUMAR' when 4 then 'BALASUBRAMANIAM' else 'DIVYA' end as base,
  case o_custkey % 4 when 0 then 'K' when 1 then 'S' when 2 then 'M' else 'R' end as ini from orders) o1) o
"""

# Feedback records and file uploads.
INTAKE = """
select conv_id * 1000 + turn as record_id, case (conv_id + turn) % 6 when 0 then ' ' else concat('User ', cast(conv_id as varchar(10))) end as name,
 case (conv_id * 3 + turn) % 5 when 0 then 'a@b' when 1 then '' when 2 then 'x y@z.in' else concat('u', cast(conv_id as varchar(10)), '@mail.in') end as email,
 case turn % 4 when 0 then '' else 'bug' end as issue_type, text as message, case when conv_id % 7 = 0 then repeat('c', 4001) else null end as comment,
 cast((conv_id + turn * 3) % 8 - 1 as double) as rating, case when (conv_id + turn) % 9 = 0 then 'short' else 'token-token-token-token-1' end as captcha_token
from conversations
"""
FILES = """
select o_orderkey as file_id, concat('u/', cast(o_orderkey as varchar(12)), '.', case o_orderkey % 6 when 0 then 'JPG' when 1 then 'pdf' when 2 then 'txt' when 3 then 'docx' when 4 then 'png' else 'bin' end) as path,
 case o_orderkey % 5 when 0 then 'image/png' when 1 then 'text/plain' when 2 then null else 'application/pdf' end as mime, o_orderkey * 104729 % 20000000 as length, cast(o_orderkey % 6 as int) as pages from orders
"""

# By which columns tables are dealt to tasks: what joins or groups them next.
CUSTOMERS, ORDERS = {"customer": "c_custkey"}, {"orders": "o_orderkey"}
CASE_ROWS, ORDERS_OF_CUSTOMERS = {"lineitem": "l_orderkey"} | ORDERS, {"orders": "o_custkey"} | CUSTOMERS


def applicants(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, APPLICANTS, CUSTOMERS)


def case_documents(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, CASE_DOCUMENTS, CASE_ROWS)


def forms(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, FORMS, CUSTOMERS)


def uploads(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, UPLOADS)


def passes(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, PASSES, {"lineitem": "l_orderkey"})


def pass_fields(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import functions as F

    entries = [F.expr(f"struct('{f}' as field, {v} as value, cast({c} as double) as confidence)") for f, (v, c) in PASS_FIELDS.items()]
    long = passes(spark, base).select("doc_id", F.expr(PASS_KIND).alias("kind"), "pass_no", F.explode(F.array(*entries)).alias("f"))
    return long.select("doc_id", "kind", "pass_no", "f.*")


def case_facts(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, CASE_FACTS, ORDERS)


def cases(spark: SparkSession, base: str) -> DataFrame:
    """Applications with the id of their scheme resolved from its number."""
    from pyspark.sql import functions as F

    from grantlens.operators.readiness import scheme_dimension

    ids = F.array(*[F.lit(r["id"]) for r in scheme_dimension()])
    return sql_over(spark, base, CASES, ORDERS_OF_CUSTOMERS).withColumn("scheme_id", F.element_at(ids, (F.col("scheme_no") + 1).cast("int"))).drop("scheme_no")


def evidence(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, EVIDENCE, ORDERS_OF_CUSTOMERS)


def providers(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, PROVIDERS, ORDERS_OF_CUSTOMERS)


def utterances(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, UTTERANCES, CUSTOMERS)


def certificates(spark: SparkSession, base: str) -> DataFrame:
    return sql_over(spark, base, CERTIFICATES, ORDERS)


def scanned(spark: SparkSession, base: str) -> DataFrame:
    """Certificates with the texts of two recognition passes, the second one with damaged digits, and the engine's confidence."""
    from pyspark.sql import functions as F

    second = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("A"), F.lit("4"))).otherwise(F.regexp_replace("text", r"\b0(\d)", "O$1"))
    slot = F.when(F.col("doc_id") % 11 > 0, F.col("slot"))
    return certificates(spark, base).select(
        "doc_id", slot.alias("slot"), F.array("text", second).alias("passes"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 60 + 40).cast("double").alias("engine"))


def texts(spark: SparkSession, base: str) -> DataFrame:
    """Spark replaces all tags without the flag the comparison engine needs."""
    return sql_over(spark, base, TEXTS.replace(", ' ', 'g')", ", ' ')"), ORDERS | {"documents": "doc_id", "pages": "page_id"})


def pixels(spark: SparkSession, base: str) -> DataFrame:
    """Every embedding as an 8×8 grey image: one row per pixel."""
    from pyspark.sql import functions as F

    from grantlens.session import table

    e = table(spark, base, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    lum = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.55) * 250))).cast("int")
    return e.select("image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), lum.alias("lum"))


PIXELS = """select vec_id as image_id, cast((i - 1) % 8 as integer) as x, cast((i - 1) // 8 as integer) as y,
 cast(greatest(0, least(255, floor((cast(v as double) + 0.55) * 250))) as integer) as lum from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) e"""
