"""The two scheme catalogues as plain rows.

Fixed values: identifiers, names, limits, required papers and application
windows below have to be exactly these for results to agree with the published
scheme rules.
"""

from __future__ import annotations

NO_LIMIT = 99_999_999

# Column order of CATALOGUE_A rows.
CATALOGUE_A_FIELDS = (
    "id", "name", "category", "state", "district", "course", "gender", "income_limit",
    "flags", "amount", "last_date", "official_portal", "documents",
)

# Flags a row may carry, in the order of the boolean columns.
FLAG_COLUMNS = {
    "govt_quota": "requires_govt_quota",
    "disability": "requires_disability",
    "govt_school": "requires_govt_school",
    "agri_labor": "requires_agri_labor",
    "first_graduate": "requires_first_graduate",
    "armed_forces": "requires_armed_forces",
}

# Schemes that imply a requirement through their id alone.
IMPLIED_BY_ID = {
    "disability": ("nsp-aicte-saksham", "tn-differently-abled"),
    "govt_school": ("tn-pudhumaipenn", "tn-tamil-pudhalvan", "tn-govt-school-7-5-quota", "nsp-nmms-central"),
    "agri_labor": ("tn-salem-farmers",),
    "armed_forces": ("pmss",),
    "first_graduate": ("tn-first-graduate",),
}

# --- fixed values: state schemes maintained by hand ---------------------------------
STATE_ROWS = [
    ("tn-post-matric-bc-mbc", "Tamil Nadu Post-Matric Scholarship for BC / MBC / DNC Students",
     "BC", "Tamil Nadu", "All", "All", "All", 250000, ("govt_quota",),
     "Full Tuition Fee Waiver + Special Fees + Maintenance Allowance", "December 31, 2026", "https://bcmbcmw.tn.gov.in",
     ["Community Certificate (BC/MBC/DNC from Tahsildar)",
      "Income Certificate (Current Year, parental income ≤ ₹2.5 LPA)",
      "Aadhaar Card", "College Admission Allotment Order / Bonafide", "Bank Passbook seeded with Aadhaar"]),
    ("tn-post-matric-sc-st", "Tamil Nadu SC / ST / SCC Post-Matric Scholarship Scheme",
     "SC", "Tamil Nadu", "All", "All", "All", 250000, (),
     "Full Tuition Fee Waiver + Exam Fees + Maintenance up to ₹1,200/month", "December 31, 2026", "https://tnscholarships.gov.in",
     ["SC/ST/SCC Community Certificate", "Parental Income Certificate (≤ ₹2.5 Lakh)", "Aadhaar Card copy",
      "Bonafide Student Certificate", "Bank Account Linked with Aadhaar (DBT active)"]),
    ("tn-first-graduate", "Tamil Nadu First Graduate Tuition Fee Concession",
     "General", "Tamil Nadu", "All", "Engineering", "All", NO_LIMIT, ("first_graduate",),
     "Tuition Fee Waiver (₹25,000/year for Engineering, up to ₹50,000/year for Medical)",
     "Ongoing / Counseling Admission Window", "https://tnscholarships.gov.in",
     ["First Graduate Certificate issued by Tahsildar / e-Sevai", "Joint Declaration Form signed by Parents & Student",
      "Community Certificate", "Single-Window Allotment Order (TNEA / TN Medical Counseling)", "Transfer Certificate"]),
    ("tn-pudhumaipenn", "Moovalur Ramamirtham Ammaiyar Pudhumaipenn Scheme (Higher Education Assurance)",
     "All", "Tamil Nadu", "All", "All", "Girls", NO_LIMIT, ("govt_school",),
     "₹1,000 / month (₹12,000/year credited directly via DBT until course completion)",
     "Open Monthly Enrollment via College", "https://www.pudhumaipenn.tn.gov.in",
     ["Government School Study Bonafide (Class 6th to 12th in TN Govt Schools)", "Student Aadhaar Card",
      "Active Bank Account Passbook (Aadhaar linked)", "College Admission Bonafide / ID Card", "EMIS School Number Verification"]),
    ("tn-tamil-pudhalvan", "Tamil Pudhalvan Scheme for Boy Students",
     "All", "Tamil Nadu", "All", "All", "Boys", NO_LIMIT, ("govt_school",),
     "₹1,000 / month (credited directly to student bank account)", "Ongoing Institutional Registration", "https://www.tn.gov.in",
     ["Government School Study Proof (Class 6 to 12 in Tamil Nadu Govt Schools)", "Student Aadhaar Card",
      "College Bonafide Certificate", "Bank Account Linked with Aadhaar (DBT active)"]),
    ("tn-govt-school-7-5-quota", "Tamil Nadu 7.5% Government School Quota Full Fee Concession",
     "All", "Tamil Nadu", "All", "Engineering", "All", NO_LIMIT, ("govt_school",),
     "100% Complete Fee Waiver: Tuition, Hostel, Mess, & Exam Fees Borne by State",
     "Counseling Admissions Phase", "https://tneaonline.org",
     ["7.5% Government School Quota Counseling Allotment Order",
      "Class 6 to 12 Government School Study Certificate from DEO/CEO", "Aadhaar Card", "College Admission Slip"]),
    ("tn-bc-mbc-free-education", "Tamil Nadu Free Education Scheme for BC / MBC / DNC 3-Year Degree & Polytechnic",
     "MBC", "Tamil Nadu", "All", "Arts", "All", 250000, (),
     "Full Tuition Fee Exemption in Government & Aided Arts & Science Colleges", "December 31, 2026", "https://bcmbcmw.tn.gov.in",
     ["Community Certificate (BC/MBC/DNC)", "Income Certificate (≤ ₹2.5 LPA)", "Marksheet of Higher Secondary (+2)", "College Bonafide"]),
    ("tn-salem-farmers", "Agricultural Laborers Children Special Educational Grant (Salem & Rural TN)",
     "All", "Tamil Nadu", "Salem", "All", "All", 150000, ("agri_labor",),
     "₹5,000 to ₹15,000 / year + Books and Skill Development Allowance", "December 15, 2026", "https://www.tn.gov.in/department/18",
     ["Parent's Registered Agricultural Laborer Welfare Board Identity Card", "Tahsildar Income Certificate (≤ ₹1.5 LPA)",
      "Bonafide Student Certificate", "Aadhaar Card of Parent and Student", "Bank Account Passbook"]),
    ("nsp-central-sector", "Central Sector Scheme of Scholarship for College and University Students",
     "General", "All-India", "All", "All", "All", 450000, (),
     "₹12,000 / year for Graduation (Years 1-3) & ₹20,000 / year for Post-Graduation", "December 31, 2026", "https://scholarships.gov.in",
     ["Class XII Marksheet (>80th percentile)", "Income Certificate (≤ ₹4.5 LPA)", "Aadhaar Card Linked Bank Account (Active DBT)",
      "College Bonafide Student Certificate", "Institute AISHE Code Verification"]),
    ("nsp-aicte-pragati", "AICTE Pragati Scholarship for Girl Students",
     "General", "All-India", "All", "Engineering", "Girls", 800000, (),
     "₹50,000 / year (towards tuition, computer, books, and living expenses)", "November 30, 2026", "https://www.aicte-india.org",
     ["AICTE Approved College Admission Letter", "Class 10 and 12 Marksheets", "Parental Income Certificate (≤ ₹8.0 LPA)",
      "Aadhaar Card", "Tuition Fee Receipt"]),
    ("maha-postmatric-obc", "MahaDBT Post-Matric Scholarship for OBC Students",
     "BC", "Maharashtra", "All", "All", "All", 150000, (),
     "50% to 100% Tuition Fee Reimbursement + Monthly Maintenance Allowance", "January 31, 2026", "https://mahadbt.maharashtra.gov.in",
     ["Aadhaar Card with Biometric e-KYC", "Caste Certificate issued by Maharashtra Competent Authority",
      "State Domicile Certificate", "Income Certificate (≤ ₹1.5 LPA)", "CAP Allotment Letter"]),
    ("kar-ssp-postmatric", "Karnataka State Scholarship Portal (SSP) Post-Matric SC/ST Scheme",
     "SC", "Karnataka", "All", "All", "All", 250000, (),
     "100% Full Fee Waiver + Annual Maintenance Stipend", "December 15, 2026", "https://ssp.postmatric.karnataka.gov.in",
     ["Karnataka Kutumba Family ID", "RD Caste Certificate Number", "RD Income Certificate Number",
      "Aadhaar e-Consent Form", "College Fee Details Receipt"]),
    ("up-saksham-scholarship", "Uttar Pradesh Saksham Post-Matric Scholarship",
     "BC", "Uttar Pradesh", "All", "All", "All", 200000, (),
     "Complete Fee Reimbursement + Boarding Allowance up to ₹10,000/year", "November 10, 2026", "https://scholarship.up.gov.in",
     ["UP Revenue Caste & Income Certificates", "Aadhaar Authentication Copy", "Institute Registration Number",
      "Previous Passing Marksheet"]),
    ("wb-oasis-scholarship", "West Bengal OASIS Post-Matric Scholarship for SC / ST / OBC",
     "ST", "West Bengal", "All", "All", "All", 250000, (),
     "₹5,000 to ₹18,000 / year + Full Tuition Reimbursement", "January 20, 2026", "https://oasis.gov.in",
     ["OASIS Online Registration", "Caste Certificate issued by WB Competent Authority",
      "Income Certificate from BDO / SDO", "Aadhaar Linked Bank Account"]),
    ("bihar-pms-obc-ebc", "Bihar Post-Matric Scholarship (PMS) for BC and EBC Students",
     "BC", "Bihar", "All", "All", "All", 300000, (),
     "Tuition Fee Reimbursement + Monthly Maintenance Stipend", "December 31, 2026", "https://pmsonline.bih.nic.in",
     ["BC/EBC Caste Certificate from Circle Officer", "Residential Certificate of Bihar",
      "Current Income Certificate (≤ ₹3.0 LPA)", "Fee Receipt & Bonafide"]),
]

# --- fixed values: central and other-state schemes taken over from the portals -------
PORTAL_ROWS = [
    ("nsp-pm-yasasvi", "PM-YASASVI Post-Matric Scholarship for OBC, EBC & DNT",
     "BC", "All-India", "All", "All", "All", 250000, (),
     "Tuition Fee waiver + Annual Maintenance up to ₹20,000", "December 31, 2026", "https://scholarships.gov.in",
     ["Aadhaar Card", "Income Certificate (< ₹2.5 LPA)", "OBC/EBC/DNT Caste Certificate", "Bonafide Certificate",
      "Previous Year Marksheet"]),
    ("nsp-aicte-saksham", "AICTE Saksham Scholarship Scheme for Specially-Abled Students",
     "All", "All-India", "All", "Engineering", "All", 800000, ("disability",),
     "₹50,000 / year towards tuition and living expenses", "November 30, 2026", "https://www.aicte-india.org",
     ["Disability Certificate (minimum 40%)", "AICTE College Admission Proof", "Income Certificate", "Aadhaar Card",
      "Class 10 & 12 Marksheets"]),
    ("nsp-minority-postmatric", "Post-Matric Scholarship Scheme for Minorities",
     "Minority", "All-India", "All", "All", "All", 200000, (),
     "Admission & Tuition fee up to ₹10,000/year + Maintenance Allowance", "November 15, 2026", "https://scholarships.gov.in",
     ["Minority Community Self-Declaration", "Income Certificate", "Aadhaar Card", "College Fee Receipt", "Mark Sheet (min 50%)"]),
    ("nsp-nmms-central", "National Means-cum-Merit Scholarship Scheme (NMMSS)",
     "All", "All-India", "All", "School", "All", 350000, (),
     "₹12,000 / year (₹1,000 per month from Class 9 to 12)", "October 31, 2026", "https://scholarships.gov.in",
     ["Class 7 Marksheet", "Income Certificate (≤ ₹3.5 LPA)", "Aadhaar Card linked Bank Account", "NMMSS Selection Examination Result"]),
    ("ap-jvd-vidya-deevena", "Jagananna Vidya Deevena (RTF) - Andhra Pradesh",
     "All", "Andhra Pradesh", "All", "All", "All", 250000, (),
     "100% Full Fee Reimbursement credited directly to Mother's account", "December 31, 2026", "https://jnanabhumi.ap.gov.in",
     ["Rice Card / Income Certificate", "Aadhaar of Student & Mother", "Integrated Caste Certificate", "College Bonafide"]),
    ("ts-epass-postmatric", "Telangana ePASS Post-Matric Fee Reimbursement (RTF & MTF)",
     "All", "Telangana", "All", "All", "All", 200000, (),
     "Full Tuition Fee Reimbursement + Monthly Maintenance Charges", "January 15, 2026", "https://telanganaepass.cgg.gov.in",
     ["Telangana ePASS Registration", "Aadhaar Card", "MeeSeva Caste & Income Certificate", "SSC Hall Ticket & Intermediate Marksheet"]),
    ("kerala-dce-postmatric", "Kerala DCE Post-Matric Scholarship for Minorities & OBC",
     "Minority", "Kerala", "All", "All", "All", 250000, (),
     "₹3,000 to ₹10,000 / year + Hosteller allowance", "December 10, 2026", "https://dcescholarship.kerala.gov.in",
     ["Kerala Nativity Certificate", "Income Certificate from Village Officer", "Community Certificate", "Bank Account seeded with Aadhaar"]),
    ("guj-digital-postmatric", "Digital Gujarat Post-Matric Scholarship for SC/ST/SEBC",
     "BC", "Gujarat", "All", "All", "All", 250000, (),
     "Tuition Fee assistance + Equipment & Maintenance allowances", "December 20, 2026", "https://www.digitalgujarat.gov.in",
     ["Digital Gujarat Portal ID", "Income Certificate", "Caste Certificate", "Fee Receipt", "Aadhaar Card"]),
    ("delhi-edistrict-higher-edu", "Delhi Merit-cum-Means Financial Assistance for Higher Education",
     "General", "Delhi", "All", "All", "All", 600000, (),
     "50% to 100% Fee Waiver (up to ₹1,00,000 / year)", "November 30, 2026", "https://edistrict.delhigovt.nic.in",
     ["Delhi Ration Card (NFSA) / Income Certificate", "Aadhaar Card", "Admission Fee Receipt", "12th Mark Sheet with min 60%"]),
]

# --- fixed values: one scheme added later --------------------------------------------
ADDED_ROWS = [
    ("tn-differently-abled", "Scholarship for Differently Abled Students (TN)",
     "All", "Tamil Nadu", "All", "All", "All", NO_LIMIT, ("disability",),
     "₹1,000 – ₹7,000/year + reader allowance", "October 31, 2026", "https://umis.tn.gov.in",
     ["Disability certificate (minimum 40% from District Medical Board)", "Bonafide student certificate",
      "Income Certificate", "Aadhaar Card copy", "Bank passbook copy"]),
]


def _expand(row: tuple) -> dict:
    out = dict(zip(CATALOGUE_A_FIELDS, row, strict=True))
    flags = set(out.pop("flags"))
    for flag, ids in IMPLIED_BY_ID.items():
        if out["id"] in ids:
            flags.add(flag)
    for flag, column in FLAG_COLUMNS.items():
        out[column] = flag in flags
    return out


def catalogue_a() -> list[dict]:
    """All 25 schemes in list order (`ord` carries that order)."""
    rows = [_expand(r) for part in (STATE_ROWS, PORTAL_ROWS, ADDED_ROWS) for r in part]
    return [{"ord": i, **r} for i, r in enumerate(rows)]


# --- fixed values: the second catalogue (community lists, amounts, course levels) ----
_POST_MATRIC_LEVELS = ["ug", "pg", "diploma", "iti", "phd"]
CATALOGUE_B = [
    {"id": "pms-sc", "name": "Post-Matric Scholarship for SC Students (PMS-SC)", "portal": "NSP", "communities": ["SC"],
     "max_income": 250000, "courses": _POST_MATRIC_LEVELS, "amount_type": "range", "amount_min": 4200, "amount_max": 22300,
     "required_documents": ["10th / 12th Marksheet", "Community / Caste Certificate (SC)", "Income Certificate (≤ ₹2,50,000 / annum)",
                            "Aadhaar Card (Seeded with Bank)", "Bank Passbook (Single Account)", "Bonafide / College Fee Receipt"]},
    {"id": "pms-st", "name": "Post-Matric Scholarship for ST Students (PMS-ST)", "portal": "NSP", "communities": ["ST"],
     "max_income": 250000, "courses": _POST_MATRIC_LEVELS, "amount_type": "range", "amount_min": 4200, "amount_max": 22300,
     "required_documents": ["10th / 12th Marksheet", "Community / Caste Certificate (ST)", "Income Certificate (≤ ₹2,50,000 / annum)",
                            "Aadhaar Card (Seeded with Bank)", "Bank Passbook (Single Account)", "Bonafide / College Fee Receipt"]},
    {"id": "pms-obc", "name": "Post-Matric Scholarship for OBC Students (PMS-OBC)", "portal": "NSP", "communities": ["OBC"],
     "max_income": 100000, "courses": ["ug", "pg", "diploma", "iti"], "amount_type": "range", "amount_min": 4200, "amount_max": 12000,
     "required_documents": ["10th / 12th Marksheet", "OBC Certificate (Competent Authority)", "Income Certificate (≤ ₹1,00,000 / annum)",
                            "Aadhaar Card (Seeded with Bank)", "Bank Passbook (Single Account)", "Bonafide Certificate"]},
    {"id": "csss", "name": "PM-USP — Central Sector Scheme of Scholarships (CSSS)", "portal": "NSP",
     "communities": ["SC", "ST", "OBC", "EBC", "BC", "MBC", "GEN"], "max_income": 450000, "courses": ["ug", "pg"],
     "amount_type": "tiered", "amount_ug": 12000, "amount_pg": 20000,
     "required_documents": ["12th Marksheet (Top 80th percentile in respective State/CBSE board)", "Income Certificate (≤ ₹4,50,000 / annum)",
                            "Aadhaar Card (Seeded with Bank)", "Bank Passbook (Single Account)", "College Admission / Bonafide Proof"]},
    {"id": "yasasvi", "name": "PM-YASASVI — OBC / EBC / DNT Post-Matric", "portal": "NSP",
     "communities": ["OBC", "EBC", "DNC", "BC", "MBC"], "max_income": 250000, "courses": ["ug", "pg", "diploma"],
     "amount_type": "full", "amount_min": 75000, "amount_max": 200000,
     "required_documents": ["10th / 12th Marksheet", "OBC / EBC / DNT Category Certificate", "Income Certificate (≤ ₹2,50,000 / annum)",
                            "Aadhaar Card", "Bank Passbook (Single Account)", "Institutional Admission Proof"]},
    {"id": "minority-pms", "name": "Post-Matric Scholarship for Minority Communities", "portal": "NSP", "communities": ["MIN"],
     "max_income": 200000, "courses": _POST_MATRIC_LEVELS, "amount_type": "range", "amount_min": 3000, "amount_max": 12000,
     "required_documents": ["Previous Qualifying Exam Marksheet (Minimum 50% marks)", "Self-Declaration of Minority Community",
                            "Income Certificate (≤ ₹2,00,000 / annum)", "Aadhaar Card", "Bank Passbook (Single Account)", "Fee Receipt / Bonafide"]},
    {"id": "pmss", "name": "Prime Minister's Scholarship Scheme for Wards of Armed Forces (PMSS)", "portal": "NSP / KSB",
     "communities": ["SC", "ST", "OBC", "EBC", "BC", "MBC", "GEN", "MIN", "DNC"], "max_income": 999999999,
     "courses": ["ug", "pg", "diploma"], "special_condition": "armed_forces",
     "amount_type": "fixed", "amount_boys": 24000, "amount_girls": 27000,
     "required_documents": ["12th / Diploma / Degree Marksheet (Minimum 60% marks)", "Ex-Servicemen Certificate / ESM Card (Annexure-1)",
                            "Bonafide Certificate from College", "Aadhaar Card", "Bank Passbook (Single Account)"]},
    {"id": "tn-bc-mbc", "name": "Tamil Nadu State Post-Matric Scholarship (BC / MBC / DNC)", "portal": "UMIS",
     "communities": ["BC", "MBC", "DNC"], "max_income": 200000, "courses": ["ug", "pg", "diploma", "iti"],
     "amount_type": "range", "amount_min": 6000, "amount_max": 15000,
     "required_documents": ["10th & 12th Marksheets", "Tamil Nadu Community Certificate (BC / MBC / DNC)",
                            "Income Certificate (≤ ₹2,00,000 / annum)", "Aadhaar Card (Seeded with Bank)", "Bank Passbook (Single Account)",
                            "College Bonafide & UMIS Registration Number"]},
]

# Communities the minority scheme accepts besides the code MIN, and the
# labels a form maps to MIN before matching.
MINORITY_COMMUNITIES = ["MUSLIM", "CHRISTIAN", "SIKH", "BUDDHIST", "JAIN", "PARSI"]
MINORITY_FORM_LABELS = ["MUSLIM", "SIKH", "CHRISTIAN", "BUDDHIST", "ZOROASTRIAN", "JAIN"]

_B_AMOUNTS = ("amount_min", "amount_max", "amount_ug", "amount_pg", "amount_boys", "amount_girls")


def catalogue_b() -> list[dict]:
    rows = []
    for i, row in enumerate(CATALOGUE_B):
        full = {"ord": i, "special_condition": None, **{a: None for a in _B_AMOUNTS}, **row}
        rows.append(full)
    return rows
