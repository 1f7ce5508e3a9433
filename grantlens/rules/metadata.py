"""Verified scheme metadata: rule status, jurisdiction and document checklists.

Fixed values: every entry below is a published rule or checklist label.
"""

from __future__ import annotations

ACADEMIC_YEAR = "2026-27"

# (id, portal, scope, jurisdiction, level, rule status, disability rule, minimum disability
#  percentage, domicile rule, renewal conditions, source url)
METADATA = [
    ("nsp-central-sector", "NSP", "All-India", "CENTRAL", "Undergraduate / Postgraduate", "VERIFIED",
     "None (3% horizontal reservation)", None, "All-India (State quota allocation by population)",
     "Annual renewal via NSP. Minimum 50% marks in semester/annual exams. Minimum 75% attendance. No disciplinary backlogs.",
     "https://scholarships.gov.in"),
    ("nsp-pm-yasasvi", "NSP", "All-India", "CENTRAL", "School & Higher Education", "VERIFIED", "None", None, "All-India",
     "Annual renewal via NSP. Must be promoted to next academic year.", "https://scholarships.gov.in"),
    ("nsp-minority-postmatric", "NSP", "All-India", "CENTRAL", "Higher Secondary to Doctoral", "VERIFIED", "None", None,
     "All-India (State quota allocation)", "Annual renewal via NSP. Must score minimum 50% in previous exam.",
     "https://scholarships.gov.in"),
    ("nsp-aicte-pragati", "NSP", "All-India", "CENTRAL", "Degree (1st year / Lateral entry) or Diploma", "VERIFIED", "None", None,
     "All-India", "Annual renewal via NSP. Passing every semester without pending backlog.", "https://www.aicte-india.org"),
    ("nsp-aicte-saksham", "NSP", "All-India", "CENTRAL", "Undergraduate Degree / Diploma", "VERIFIED",
     "Minimum 40% permanent certified disability", 40, "All-India",
     "Annual renewal. Must pass exams without pending backlogs.", "https://www.aicte-india.org"),
    ("nsp-ishan-uday", "NSP", "North Eastern Region", "CENTRAL", "Undergraduate (1st year)", "PARTIALLY_VERIFIED",
     "None (3% horizontal reservation)", None,
     "Permanent Resident of Arunachal Pradesh, Assam, Manipur, Meghalaya, Mizoram, Nagaland, Sikkim, or Tripura",
     "Annual renewal on NSP. Must be promoted to next class with continuous attendance.", "https://www.ugc.gov.in"),
    ("tn-post-matric-bc-mbc", "UMIS", "Tamil Nadu", "TAMIL_NADU", "Diploma / UG / PG / Professional", "VERIFIED", "None", None,
     "Permanent resident of Tamil Nadu",
     "Annual renewal through college nodal officer on UMIS portal. Minimum 75% attendance.", "https://bcmbcmw.tn.gov.in"),
    ("tn-post-matric-sc-st", "UMIS", "Tamil Nadu", "TAMIL_NADU", "Higher Secondary to Doctoral", "VERIFIED", "None", None,
     "Permanent resident of Tamil Nadu",
     "Annual renewal via college nodal officer on UMIS / Adi Dravidar portal.", "https://tnscholarships.gov.in"),
    ("tn-first-graduate", "OTHER", "Tamil Nadu", "TAMIL_NADU", "Undergraduate Professional Degree", "VERIFIED", "None", None,
     "Permanent resident of Tamil Nadu",
     "Automatic annual renewal provided the student maintains enrollment in the professional degree.", "https://tnscholarships.gov.in"),
    ("tn-bc-mbc-free-education", "UMIS", "Tamil Nadu", "TAMIL_NADU", "Undergraduate / Diploma", "PARTIALLY_VERIFIED", "None", None,
     "Permanent resident of Tamil Nadu",
     "Annual renewal via UMIS portal. Continued enrollment in Government or Aided institution.", "https://bcmbcmw.tn.gov.in"),
    ("other-state-incentive", "OTHER", "State", "OTHER_STATE", "Undergraduate", "UNVERIFIED", "None", None,
     "State Resident", "Subject to state notification.", ""),
]

# (kind, label, purpose); kind is REQUIRED, OPTIONAL or RENEWAL.
CHECKLISTS = {
    "nsp-central-sector": [
        ("REQUIRED", "Aadhaar Card", "Identity verification and DBT payment"),
        ("REQUIRED", "Class 12 Marksheet", "Academic eligibility — above 80th percentile"),
        ("REQUIRED", "Income Certificate", "Annual parental income ceiling proof"),
        ("REQUIRED", "Bank Passbook / Account Statement", "DBT disbursement proof"),
        ("REQUIRED", "College Bonafide Student Certificate", "Current enrollment proof"),
        ("OPTIONAL", "Previous Year Marksheet", "Renewal evaluation (min 50% marks)"),
        ("RENEWAL", "Previous Year Marksheet", "Proof of passing with ≥ 50% marks"),
        ("RENEWAL", "Attendance Certificate", "Proof of ≥ 75% attendance"),
    ],
    "nsp-pm-yasasvi": [
        ("REQUIRED", "Aadhaar Card", "Identity and DBT verification"),
        ("REQUIRED", "OBC / EBC / DNT Community Certificate", "Category eligibility"),
        ("REQUIRED", "Income Certificate (≤ ₹2.5 lakh)", "Family income ceiling"),
        ("REQUIRED", "Bonafide Student Certificate", "Enrollment in recognized/empaneled institution"),
        ("REQUIRED", "Previous Year Marksheet", "Academic qualifying proof"),
        ("REQUIRED", "Bank Passbook", "Active bank account in student's name"),
        ("RENEWAL", "Annual Marksheet", "Promotion proof to next academic year"),
    ],
    "nsp-minority-postmatric": [
        ("REQUIRED", "Minority Community Self-Declaration", "Community confirmation"),
        ("REQUIRED", "Income Certificate (≤ ₹2.0 lakh)", "Income ceiling proof"),
        ("REQUIRED", "Aadhaar Card", "Identity and DBT payment"),
        ("REQUIRED", "Previous Qualifying Marksheet (min 50%)", "Academic marks verification"),
        ("REQUIRED", "College / School Fee Receipt", "Fee reimbursement proof"),
        ("REQUIRED", "Bank Passbook", "Student's own Aadhaar-seeded bank account"),
        ("RENEWAL", "Marksheet with ≥ 50% marks", "Proof of academic continuity"),
    ],
    "nsp-aicte-pragati": [
        ("REQUIRED", "AICTE Approved College Admission Letter", "Institution eligibility verification"),
        ("REQUIRED", "Class 10 Marksheet", "Age and academic record"),
        ("REQUIRED", "Class 12 / Diploma Marksheet", "Qualifying examination record"),
        ("REQUIRED", "Parental Income Certificate (≤ ₹8.0 lakh)", "Income ceiling verification"),
        ("REQUIRED", "Aadhaar Card", "Identity and DBT payment"),
        ("REQUIRED", "Tuition Fee Receipt", "Paid tuition fee verification"),
        ("REQUIRED", "Family Composition / Ration Card / Affidavit", "Proof of maximum 2 girls per family"),
        ("OPTIONAL", "Lateral Entry Admission Proof", "For 2nd year direct lateral entry"),
        ("RENEWAL", "Annual Marksheet", "Passing certificate with no pending backlog"),
        ("RENEWAL", "Bonafide Renewal Certificate", "College nodal officer endorsement"),
    ],
    "nsp-aicte-saksham": [
        ("REQUIRED", "Disability Certificate (min 40%)", "Permanent disability verification"),
        ("REQUIRED", "AICTE College Admission Proof", "Institution approval verification"),
        ("REQUIRED", "Income Certificate (≤ ₹8.0 lakh)", "Income ceiling verification"),
        ("REQUIRED", "Aadhaar Card", "Identity and DBT"),
        ("REQUIRED", "Class 10 & 12 Marksheets", "Qualifying exam records"),
        ("REQUIRED", "Bank Passbook", "Student's own Aadhaar-seeded account"),
        ("RENEWAL", "Semester Marksheet", "Passing marks without backlog"),
    ],
    "nsp-ishan-uday": [
        ("REQUIRED", "Domicile / Permanent Residence Certificate (NER)", "NER state residency verification"),
        ("REQUIRED", "Class 12 Marksheet", "Passed from an institution within NER"),
        ("REQUIRED", "Income Certificate (≤ ₹4.5 lakh)", "Income ceiling proof"),
        ("REQUIRED", "Aadhaar Card", "Identity and DBT"),
        ("REQUIRED", "Bonafide Student Certificate", "1st year regular UG admission proof"),
        ("RENEWAL", "Annual Exam Marksheet", "Promotion proof with satisfactory attendance"),
    ],
    "tn-post-matric-bc-mbc": [
        ("REQUIRED", "Community Certificate (BC/MBC/DNC)", "Category verification"),
        ("REQUIRED", "Parental Income Certificate (≤ ₹2.5 lakh)", "Income ceiling verification"),
        ("REQUIRED", "Aadhaar Card copy", "Identity and DBT seeding"),
        ("REQUIRED", "College Admission Allotment Order", "Government Quota allotment proof"),
        ("REQUIRED", "Bank Account Passbook", "Aadhaar-seeded account in student's name"),
        ("OPTIONAL", "UMIS Student ID", "TN UMIS portal student registration"),
        ("RENEWAL", "College Bonafide Renewal Certificate", "Endorsement of continuing enrollment and attendance"),
    ],
    "tn-post-matric-sc-st": [
        ("REQUIRED", "SC / ST Community Certificate", "Category verification"),
        ("REQUIRED", "Parental Income Certificate (≤ ₹2.5 lakh)", "Income ceiling verification"),
        ("REQUIRED", "Aadhaar Card copy", "Identity and DBT verification"),
        ("REQUIRED", "Bonafide Certificate", "College enrollment verification"),
        ("REQUIRED", "Bank Passbook", "Aadhaar-seeded bank account in student's name"),
        ("RENEWAL", "Bonafide Renewal Certificate", "Academic progress endorsement"),
    ],
    "tn-first-graduate": [
        ("REQUIRED", "First Graduate Certificate", "First-generation graduate proof"),
        ("REQUIRED", "Joint Declaration Form", "Family undertaking signed by parents and candidate"),
        ("REQUIRED", "Single-Window Allotment Order (TNEA / TN Medical)", "Single-window admission proof"),
        ("REQUIRED", "Community Certificate", "Community verification"),
        ("REQUIRED", "Transfer Certificate (TC)", "School leaving and conduct proof"),
        ("RENEWAL", "College Continuation Bonafide", "Annual continuation certificate from college principal"),
    ],
    "tn-bc-mbc-free-education": [
        ("REQUIRED", "Community Certificate (BC/MBC/DNC)", "Category verification"),
        ("REQUIRED", "Parental Income Certificate", "Income verification for polytechnic (not required for UG degree)"),
        ("REQUIRED", "Class 12 / Higher Secondary Marksheet", "Qualifying academic record"),
        ("REQUIRED", "College Bonafide Certificate", "Enrollment in Govt or Govt Aided institution"),
        ("RENEWAL", "Annual Marksheet", "Continuation proof"),
    ],
    "other-state-incentive": [
        ("REQUIRED", "State Domicile Certificate", "Residency proof"),
        ("REQUIRED", "College Admission Letter", "Enrollment proof"),
        ("REQUIRED", "Income Certificate", "Income verification"),
    ],
}

# Fixed values used when a scheme has no metadata row.
DEFAULT_RULE_STATUS = "UNVERIFIED"
DEFAULT_JURISDICTION = "CENTRAL"
DEFAULT_PORTAL = "NSP"
DEFAULT_PURPOSE = "Required for this scholarship"

METADATA_FIELDS = (
    "id", "portal", "scope", "jurisdiction", "level", "rule_status", "disability_rule", "minimum_disability_percentage",
    "domicile_rule", "renewal_conditions", "source_url",
)


def metadata_rows() -> list[dict]:
    return [{**dict(zip(METADATA_FIELDS, r, strict=True)), "academic_year": ACADEMIC_YEAR} for r in METADATA]


def checklist_rows() -> list[dict]:
    return [
        {"id": scheme, "item_ord": i, "kind": kind, "label": label, "purpose": purpose}
        for scheme, items in CHECKLISTS.items()
        for i, (kind, label, purpose) in enumerate(items)
    ]
