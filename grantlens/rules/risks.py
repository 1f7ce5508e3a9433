"""Readiness risk rules.

Fixed values: rule ids, severities, dimensions, fields, points and thresholds. A rule
is a condition over one prepared case row (columns listed in operators/readiness.py);
`unknown` marks rules about facts nobody has stated, which never cost points.
"""

DIMENSIONS = {"identity": 20, "documents": 20, "eligibility": 20, "application": 20, "bank": 10, "certificates": 10}
HIGH, MEDIUM, LOW = "HIGH_ATTENTION", "MEDIUM_ATTENTION", "LOW_ATTENTION"
CONSISTENCY, SCHEME, ADVISORY = "UNIVERSAL_CONSISTENCY_CHECK", "SCHEME_SPECIFIC_CHECK", "ADVISORY_CHECK"
LEVELS = ((90, "READY_TO_SUBMIT"), (75, "REVIEW_BEFORE_SUBMIT"), (50, "CORRECTIONS_NEEDED"), (None, "NOT_READY"))
UNCONFIRMED_LEVEL, UNCONFIRMED_FROM = "NEEDS_CONFIRMATION", 75

# (id, severity, dimension, field, points, unknown, check type, condition)
RULES = [
    ("IDENTITY_NAME_MISMATCH", HIGH, "identity", "name", "least(15, 6 * n_name_mismatch)", False, CONSISTENCY, "n_name_mismatch > 0"),
    ("IDENTITY_DOB_MISMATCH", HIGH, "identity", "dob", "8", False, CONSISTENCY,
     "(p_dob <> tenth_dob_d or p_dob <> aadhaar_dob_d)"),
    ("IDENTITY_INCOME_NAME_MISMATCH", HIGH, "identity", "incomeProvider", "6", False, CONSISTENCY,
     "income_applicant = 'student' and income_name is not null and student_name is not null and sim_income < 0.70"),
    ("DOCS_MISSING_REQUIRED", "case when n_missing >= 3 then 'HIGH_ATTENTION' else 'MEDIUM_ATTENTION' end", "documents", "requiredDocuments",
     "least(16, 5 * n_missing)", False, SCHEME, "n_uploads > 0 and n_missing > 0"),
    ("DOCS_NONE_UPLOADED", HIGH, "documents", "requiredDocuments", "12", False, SCHEME, "n_required > 0 and n_uploads = 0"),
    ("DOCS_WRONG_TYPE", HIGH, "documents", "documentType", "least(10, 5 * n_wrong)", False, CONSISTENCY, "n_wrong > 0"),
    ("DOCS_LOW_QUALITY", MEDIUM, "documents", "documentQuality", "least(8, 3 * n_low_quality)", False, ADVISORY, "n_low_quality > 0"),
    ("DOCS_MISSING_CERT_NUMBER", LOW, "documents", "certificateNumber", "3", False, ADVISORY, "has_income_doc and income_cert_number is null"),
    ("DOCS_MISSING_AUTHORITY", LOW, "documents", "issuingAuthority", "2", False, ADVISORY, "has_income_doc and income_authority is null"),
    ("RULE_UNVERIFIED_NOTICE", MEDIUM, "eligibility", "ruleStatus", "0", True, SCHEME, "rule_status = 'UNVERIFIED'"),
    ("ELIG_POTENTIAL_ONLY", MEDIUM, "eligibility", "eligibilityStatus", "0", True, SCHEME, "match_rank = 2"),
    ("ELIG_NEEDS_INFO", HIGH, "eligibility", "eligibilityStatus", "0", True, SCHEME, "match_rank = 1"),
    ("ELIG_UNVERIFIED_GAP", MEDIUM, "eligibility", "eligibilityStatus", "0", True, SCHEME, "match_rank = 0 and rule_status = 'UNVERIFIED'"),
    ("ELIG_NOT_MATCHED", HIGH, "eligibility", "eligibilityStatus", "20", False, SCHEME,
     "match_rank = 0 and coalesce(rule_status, '') <> 'UNVERIFIED'"),
    ("ELIG_QUOTA_UNKNOWN", HIGH, "eligibility", "quotaType", "0", True, SCHEME,
     "not is_central and requires_govt_quota and coalesce(quota_type, 'unknown') = 'unknown'"),
    ("ELIG_QUOTA_MANAGEMENT", HIGH, "eligibility", "quotaType", "0", False, SCHEME,
     "not is_central and requires_govt_quota and quota_type = 'management'"),
    ("ELIG_FIRST_GRAD_UNKNOWN", HIGH, "eligibility", "firstGraduate", "0", True, SCHEME,
     "not is_central and requires_first_graduate and first_graduate is null"),
    ("APP_INCOME_MISMATCH", MEDIUM, "application", "income", "4", False, ADVISORY,
     "greatest(income, income_value) > 0 and abs(income - income_value) * 1.0 / greatest(income, income_value) > 0.15"),
    ("APP_CATEGORY_MISMATCH", HIGH, "application", "category", "8", False, CONSISTENCY,
     "upper(trim(category)) <> upper(trim(community_category)) and trim(category) <> '' and trim(community_category) <> ''"),
    ("APP_COURSE_MISMATCH", MEDIUM, "application", "course", "4", False, CONSISTENCY,
     "course is not null and doc_course is not null and sim_course < 0.60"),
    ("APP_INSTITUTION_MISMATCH", MEDIUM, "application", "institution", "4", False, CONSISTENCY,
     "institution is not null and doc_institution is not null and sim_institution < 0.60"),
    ("APP_COURSE_LEVEL_MISMATCH", HIGH, "application", "level", "4", False, SCHEME,
     "not contains(lower(scheme_level), lower(level)) and not contains(lower(level), lower(scheme_level))"),
    ("APP_DOMICILE_MISSING", MEDIUM, "application", "state", "0", True, SCHEME, "requires_domicile and state is null"),
    ("APP_DOMICILE_MISMATCH", HIGH, "application", "state", "10", False, SCHEME,
     "requires_domicile and scheme_state <> 'All-India' and lower(state) <> lower(scheme_state)"),
    ("APP_DISABILITY_PERCENTAGE_BELOW_MIN", HIGH, "application", "disabilityPercentage", "6", False, SCHEME,
     "needs_disability and disability_percentage < min_disability"),
    ("APP_DISABILITY_PERCENTAGE_UNKNOWN", MEDIUM, "application", "disabilityPercentage", "0", True, SCHEME,
     "needs_disability and disability_percentage is null and (coalesce(disability, false) or disability_cert)"),
    ("APP_DISABILITY_CERT_MISSING", HIGH, "application", "disability", "6", False, SCHEME, "needs_disability and not disability_cert"),
    ("BANK_HOLDER_MISMATCH", HIGH, "bank", "bankHolder", "5", False, SCHEME,
     "bank_holder is not null and student_name is not null and sim_bank < 0.75"),
    ("BANK_IFSC_INVALID", MEDIUM, "bank", "ifsc", "3", False, CONSISTENCY, "ifsc is not null and not ifsc_valid"),
    ("BANK_AADHAAR_NOT_SEEDED", HIGH, "bank", "aadhaarBankLinked", "2", False, SCHEME, "not aadhaar_bank_linked"),
    ("BANK_AADHAAR_SEEDING_UNKNOWN", LOW, "bank", "aadhaarBankLinked", "0", True, SCHEME, "aadhaar_bank_linked is null"),
    ("CERT_INCOME_EXPIRED", HIGH, "certificates", "expiryDate", "6", False, SCHEME, "income_validity in ('EXPIRED', 'REQUIRES_REVIEW')"),
    ("CERT_INCOME_DATE_MISSING", MEDIUM, "certificates", "issueDate", "0", True, SCHEME,
     "has_income_doc and income_issue_date is null and income_expiry_date is null"),
    ("WRONG_ACADEMIC_YEAR", MEDIUM, "certificates", "academicYear", "3", False, SCHEME, "scheme_year <> academic_year"),
    ("RENEWAL_DOC_MISSING", MEDIUM, "certificates", "renewalMarks", "0", True, SCHEME,
     "is_renewal and coalesce(renewal_conditions, '') <> '' and not previous_year_marks"),
    ("NSP_2026_OTR_TRACKER", MEDIUM, "application", "otrNumber", "0", True, SCHEME, "is_portal_scheme and not coalesce(otr_generated, false)"),
    ("NSP_2026_FACE_AUTH_DEVICE", LOW, "application", "faceAuthDevice", "0", True, SCHEME, "is_portal_scheme and not coalesce(face_auth_device, false)"),
]

# Schemes known from metadata only; the course text restricts them as written.
METADATA_ONLY_SCHEMES = [
    {"id": "nsp-ishan-uday", "name": "Ishan Uday Special Scholarship Scheme for North Eastern Region", "category": "All",
     "course": "General Degree, Technical / Professional, Medical, Paramedical"},
    {"id": "other-state-incentive", "name": "State Merit Higher Education Incentive (Unverified Current-Year Rule)", "category": "All",
     "course": "Higher Education"},
]
