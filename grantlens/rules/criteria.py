"""Names, labels and scores of the twelve eligibility criteria.

Fixed values: criterion names, label formats, statuses and points. `{}` marks the
place of the value named in the code that fills it.
"""

NATIONWIDE = ("All", "All-India", "All-India / National")
RESERVED_COMMUNITIES = ("BC", "MBC", "DNC", "DNT")

CONFIRMED = "CONFIRMED MATCH"
POTENTIAL = "POTENTIAL MATCH"
NEEDS_INFORMATION = "NEEDS MORE INFORMATION"
NOT_MATCHED = "NOT MATCHED"
STATUS_RANK = {CONFIRMED: 3, POTENTIAL: 2, NEEDS_INFORMATION: 1, NOT_MATCHED: 0}

BASE_SCORE, POTENTIAL_SCORE = 70, 55
CATEGORY_POINTS, COURSE_POINTS, DISTRICT_POINTS, LOW_INCOME_POINTS = 10, 10, 5, 5
LOW_INCOME_RATIO = 0.6
BENCHMARK_DISABILITY = 40
POTENTIAL_SCHEME_WITH_COURSE = "nsp-aicte-saksham"
POTENTIAL_SCHEME = "tn-differently-abled"
POTENTIAL_COURSES = ("Engineering", "Diploma")

# key: (criterion, missing, failed, passed)
LABELS = {
    "gender": ("Gender Eligibility", "Gender ({} only)", "Gender restriction ({} only)", "Gender: {}"),
    "income": ("Annual Family Income", "Annual Family Income (ceiling ≤ ₹{}/year)", "Income exceeds ₹{}", "Income under ₹{}"),
    "category": ("Community Category", "Community Category ({})", "Reserved for {} category", "Category: {}"),
    "state": ("State Domicile", "State Domicile ({})", "Restricted to {}", "State: {}"),
    "district": ("District Jurisdiction", "District Jurisdiction ({})", "District restricted ({})", "District: {}"),
    "course": ("Course Curriculum", "Course Curriculum ({})", "Course restricted to {}", "Course: {}"),
    "disability": ("Disability Benchmark", "Disability status (minimum 40% benchmark disability)",
                   "Disability certificate required", "Disability certified"),
    "govt_school": ("Government School Background", "Government school background (Class 6 to 12)",
                    "Government school study background required", "Government school confirmed"),
    "agri_labor": ("Parent Occupation", "Parent registered agricultural laborer status",
                   "Parent must be registered agricultural laborer", "Parent registered agricultural laborer confirmed"),
    "armed_forces": ("Armed Forces Ward", "Ward of Armed Forces / Ex-Servicemen status",
                     "Restricted to wards of Armed Forces", "Ward of Armed Forces confirmed"),
    "first_graduate": ("First Graduate", "First Graduate status (no graduate in family)",
                       "Restricted to first-generation graduates", "First graduate in family confirmed"),
    "quota": ("Admission Quota", "Admission Quota type (Government Quota or Management Quota)",
              "Requires Government Quota admission for BC/MBC category", "Government Quota confirmed"),
}
UNDER_BENCHMARK = "Minimum 40% benchmark disability required (provided: {}%)"
# Passed labels of a criterion the scheme does not restrict.
OPEN_LABELS = {
    "gender": "Gender: Open to all", "income": "No income limit", "category": "Open to all categories",
    "state": "Central / Pan-India scheme", "district": "Applicable in all districts",
    "course": "All collegiate & school courses eligible",
}
