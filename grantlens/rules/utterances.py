"""Patterns that read facts and intents out of questions.

Fixed values: slot patterns, income phrases, acronyms and intent phrases, in test order.
"""

CATEGORY_SLOTS = (
    ("MBC", r"\bmbc\b|\bdnc\b|\bmost backward\b", None),
    ("BC", r"\bbc\b|\bobc\b|\bbackward class\b|\bbackward\b", None),
    ("SC", r"\bsc\b|\bs\.c\.\b|\bscheduled caste\b|\bdravidar\b", r"\bst\b|\bscheduled tribe\b"),
    ("ST", r"\bst\b|\bs\.t\.\b|\bscheduled tribe\b|\btribal\b", None),
    ("Minority", r"\bminority\b|\bmuslim\b|\bchristian\b|\bjain\b|\bsikh\b|\bbuddhist\b", None),
    ("General", r"\bgeneral\b|\boc\b|\bfc\b|\bopen category\b|\bews\b", None),
)
STATE_ALIASES = (
    ("Tamil Nadu", r"\btn\b|\btamil\s*nadu\b|\btamilnadu\b"), ("Uttar Pradesh", r"\bup\b|\buttarpra?desh\b"),
    ("West Bengal", r"\bwb\b|\bwest\s*bengal\b"),
)
QUOTA_75 = (r"\b(7\.5\s*(?:%|percent)?\s*(?:government\s*school\s*|govt\s*school\s*)?quota|government\s*school\s*quota|"
            r"govt\s*school\s*quota|7\.5\s*quota)\b")
ENGINEERING = r"\bengineering\b|\bbe\b|\bb\.e\b|\bbtech\b|\bb\.tech\b|\bcse\b|\bmechanical\b|\beee\b|\bece\b"
MEDICAL = r"\bmedicine\b|\bmbbs\b|\bbds\b|\bnursing\b|\bmedical\b|\bpharmacy\b|\bb\.pharm\b"
DIPLOMA = r"\bdiploma\b|\bpolytechnic\b|\biti\b"
SCHOOL = (r"\b(class\s*1[012]\b|class\s*[6-9]\b|high\s*school\b|10th\s*(?:std|standard|marksheet)?\b|12th\s*(?:std|standard|marksheet)?\b|"
          r"nmms\b|school\s*student\b|currently\s+in\s+school\b)")
SCHOOL_WORD, STATE_SCHOOL = r"\bschool\b", r"\b(?:govt|government)\s*school\b"
SCIENCE = r"\bbsc\b|\bb\.sc\b|\bscience\b|\bmsc\b"
ARTS = r"\barts\b|\bhistory\b|\benglish\b|\beconomics\b|\bba\b|\bb\.a\b|\bbcom\b|\bb\.com\b"
ARTS_UNLESS = r"\btamil\s*nadu\b|\btamilnadu\b"
GIRLS = r"\b(girl|girls|female|women|woman|lady|ladies)\b"
BOYS = r"\b(boy|boys|male|men|man)\b"
DISABILITY_PERCENT = (
    r"([0-9]{1,2})\s*%\s*(?:disability|disabled|pwd|benchmark)",
    r"(?:disability|disabled|pwd|benchmark)\s*(?:of|is|at|level|rate|percentage)?\s*([0-9]{1,2})\s*%",
)
DISABLED = r"\b(disabled|disability|differently[\s-]abled|handicapped?|pwd|saksham)\b"
GOVT_SCHOOL = r"\b(govt\s*school|government\s*school|govt\s*\.?\s*aided|tamil\s*medium\s*school|model\s*school)\b"
OTHER_SCHOOL = r"\b(private\s*school|cbse|icse|matriculation)\b"
AGRI_LABOR = r"\b(agricultural\s*(?:laborer|labourer|worker|coolie)|marginal\s*farmer|farmer|farming|peasant)\b"
ARMED_FORCES = r"\b(armed\s*forces|ex[\s-]*servicem[ae]n|esm|defence|defense|crpf|bsf|police\s*ward|military|army|navy|air\s*force)\b"
FIRST_GRADUATE = r"\b(first\s*graduate|first\s*in\s*(?:my\s*)?family|first\s*generation\s*graduate)\b"

_AMOUNT = r"([0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?)"
_UNIT = r"(lakhs?|lpa|lacs?|k|thousand)?"
# (pattern, has a unit group)
INCOME_PATTERNS = (
    (r"(?:income|salary|earns?|earning|earnings)\s*(?:is|was|of|under|below|less than|more than|around|approximately|approx|about|"
     r"actually|currently|now|estimated|near|equal to|to|at|be|:|=|\s)*\s*₹?\s*(?:rs\.?|inr|rupees)?\s*"
     r"([0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?|[0-9.]+)\s*" + _UNIT, True),
    (r"(?:₹|rs\.?|inr)?\s*" + _AMOUNT + r"\s*" + _UNIT + r"\s*(?:per annum|/year|a year)?\s*"
     r"(?:my|our|family|family's|annual|yearly|household)?\s*(?:income|salary|earning)", True),
    (r"(?:₹|rs\.?|inr)\s*" + _AMOUNT + r"\s*" + _UNIT, True),
    (r"\b" + _AMOUNT + r"\s*(lakhs?|lpa|lacs?)\b", True),
    (r"\b([0-9]{1,2},[0-9]{2},[0-9]{3}|[0-9]{1,3},[0-9]{3})\b", False),
    (r"^\s*₹?\s*([0-9]{5,8})\s*$", False),
)
LAKH_UNITS, THOUSAND_UNITS = ("lakh", "lakhs", "lac", "lacs", "lpa"), ("k", "thousand")

# (acronym, full form)
ACRONYMS = (
    ("UMIS", "University Management Information System"), ("NSP", "National Scholarship Portal"), ("DBT", "Direct Benefit Transfer"),
    ("NPCI", "National Payments Corporation of India"), ("UIDAI", "Unique Identification Authority of India"),
    ("EMIS", "Education Management Information System"), ("AICTE", "All India Council for Technical Education"),
    ("UGC", "University Grants Commission"), ("PFMS", "Public Financial Management System"),
)
FULL_FORM_TRIGGERS = (
    r"\bfull\s*form\b|\bfullform\b|\bfull\s+of\b|\bfull\s*names?\b|\bstands?\s+for\b|\bstands?\s+4\b|\bmeans?\b|\bmeaning\b|"
    r"\bwhat\s+does\b|\bexpansion\s+of\b|\bexpand\b"
)
BARE_ACRONYM = r"^[\s]*((what\s+is|what\s+are)\s+(the\s+)?)?(nsp|umis|dbt|npci|uidai|emis|aicte|ugc|pfms)[\s?!.]*$"

GREETING = r"^(hi|hello|hey|vanakkam|namaste|good\s+morning|good\s+afternoon|good\s+evening)[\s!.,]*$"
IDENTITY = r"\b(what\s+is\s+your\s+name|who\s+are\s+you|your\s+name|who\s+made\s+you|who\s+built\s+you)\b"
HOW_TO_APPLY = (r"\b(how\s+to\s+apply|how\s+do\s+i\s+apply|how\s+can\s+i\s+apply|where\s+(?:to|should\s+i|can\s+i|do\s+i)\s+apply|"
                r"application\s+process|procedure\s+to\s+apply|apply\s+online)\b")
APPLY_TARGETS = (("apply_umis", r"\bumis\b"), ("apply_tn", r"\b(tamil\s*nadu|tn\b)"), ("apply_nsp", r"\bnsp\b"))

# Words that make a question about the purpose of scholarships, and words that rule it out.
PURPOSE_EXCLUDES = (
    r"\b(?:documents?|certificates?|proofs?)\b",
    r"\b(?:steps|procedure|process|workflow|guide)\s+to\s+apply\b",
    r"^(?:what\s+is\s+)?(?:nsp|umis|dbt|npci|uidai)\b",
    r"\b7\.5\s*(?:%|percent)?\b",
    r"\b(?:verify|genuine|fake)\b",
)
PURPOSE_WAY = (r"\b(?:how|where|when)\b", r"\b(?:apply|applying|application|register|registration|portal)\b")
PURPOSE_WORDS = {
    "scholarship": r"\bscholarships?\b",
    "participation": r"\b(?:apply|applying|application|take|taking|get|getting|receive|receiving|avail|availing)\b",
    "why": r"\bwhy\b", "purpose": r"\b(?:purpose|purposes)\b", "benefit": r"\b(?:benefits?|advantage|advantages)\b",
    "importance": r"\b(?:importance|important|matter|matters)\b", "value": r"\b(?:value|worth|worthwhile)\b",
    "utility": r"\b(?:useful|usefulness|helpful|help|helps|helping|support|supports)\b",
    "need": r"\b(?:need|needs|needed|necessary|necessity)\b",
}
PURPOSE_PHRASES = (
    r"\bwhy\s+.*?(?:scholarships?|apply|take|get)\b",
    r"\bwhat\s+(?:is|are)\s+the\s+(?:benefit|benefits|purpose|importance|value|advantage|advantages)\b",
    r"\b(?:is|are|do|does)\s+.*?(?:useful|worth|worthwhile|helpful|help|matter|needed|necessary)\b",
    r"\bhow\s+(?:does|can|do)\s+.*?(?:help|support|benefit)\b",
)

# Intents answered first, in order, with all their phrases.
PRIORITY_INTENTS = {
    "greeting": ["hi", "hello", "hey", "vanakkam", "good morning", "good afternoon", "good evening", "welcome", "start"],
    "i_am_student": ["i am student", "i am a student", "student here"],
    "bot_identity": ["your name", "what are you", "who are you", "what is your name", "are you a bot", "are you ai", "are you robot",
                     "tell me about yourself", "introduce yourself", "who made you", "who built you"],
    "quota_7_5": ["7.5% quota", "7.5 percent quota", "7.5% government school quota", "7.5% govt school quota", "government school quota",
                  "govt school quota", "7.5 quota", "7.5% reservation", "7.5 percent reservation", "what is 7.5% quota", "what is 7.5 quota",
                  "am i eligible for 7.5% quota", "am i eligible for 7.5% government school quota", "eligible for 7.5% government school quota",
                  "eligible for 7.5% quota", "eligible for 7.5"],
    "scholarship_purpose": ["why apply scholarship", "why should i apply for scholarship", "why do i need scholarship",
                            "why do i need to apply for scholarship", "why i need to apply scholarship", "what is the purpose of scholarship",
                            "purpose of scholarship", "purpose of scholarships", "why scholarships are important", "why scholarship is important",
                            "benefits of applying for scholarship", "why should students apply for scholarships",
                            "what are the benefits of scholarships", "benefits of scholarship", "benefits of scholarships",
                            "importance of scholarship", "importance of scholarships", "why scholarship", "why apply for scholarship"],
    "how_it_works": ["how do you work", "how you work", "how does this work", "how does it work", "how this works", "api key", "based on",
                     "offline", "online", "internet", "technology"],
    "off_topic": ["time now", "weather", "news", "cricket", "movie", "film", "song", "joke", "porn", "sex", "politics", "stock", "bitcoin", "game"],
}
# Intents chosen by the sum of two points per word of every matching phrase, in order, with all
# their phrases. Both tables are parameters of the jobs.
SCORED_INTENTS = {
    "dbt_what": ["what is dbt", "dbt mean", "direct benefit transfer", "explain dbt"],
    "dbt_activate": ["activate dbt", "enable dbt", "how to dbt", "dbt enable", "npci mapping", "dbt bank", "bank dbt", "dbt active",
                     "dbt not working", "dbt failed", "npci", "how do i enable dbt", "how to enable dbt"],
    "dbt_check": ["check dbt", "dbt status", "my dbt", "verify dbt", "dbt linked or not", "i don't know whether my bank is dbt enabled",
                  "check whether dbt enabled", "is dbt enabled in my bank", "check dbt enabled", "how do i check npci mapping",
                  "check npci mapping", "check npci", "npci mapping"],
    "dbt_difference": ["difference between linked", "difference between linked and seeded", "difference between linked seeded",
                       "linked vs seeded", "seeded vs dbt", "aadhaar linked seeded", "linked and seeded", "linked or seeded", "is dbt enabled",
                       "my aadhaar is linked to my bank. is dbt enabled", "my bank account is aadhaar seeded",
                       "aadhaar seeded can i receive scholarship", "can i receive scholarship with seeded", "what is aadhaar seeding",
                       "aadhaar seeding meaning", "explain aadhaar seeding", "aadhaar seeding"],
    "dbt_issues": ["dbt problem", "dbt issue", "dbt not received", "money not received", "payment failed dbt", "dbt common issue"],
    "bank_link": ["bank not linked", "bank account link", "link bank aadhaar", "bank for scholarship", "account not linked",
                  "how do i link aadhaar with my bank account", "link aadhaar with my bank account", "link aadhaar to bank"],
    "aadhaar_mismatch": ["name mismatch", "dob mismatch", "aadhaar mismatch", "aadhaar correction", "wrong name aadhaar", "update aadhaar",
                         "aadhaar name change", "mismatch aadhaar", "my name is different in aadhaar and 10th marksheet",
                         "name is different in aadhaar", "why should my name match across documents",
                         "what happens if my aadhaar name and marksheet name are different", "name are different", "name is different",
                         "name different in marksheet", "aadhaar name and marksheet", "name match across documents"],
    "rejection": ["why rejected", "rejection reason", "application rejected", "scholarship rejected", "not approved", "failed application"],
    "deadline": ["deadline", "last date", "closing date", "when to apply", "scheme closing", "scheme closing date", "scholarship deadline"],
    "documents": ["documents needed", "document", "certificates needed", "required documents", "what to upload", "which documents",
                  "certificate list", "documents required", "what documents do i need for scholarship", "what documents are required to apply"],
    "apply": ["how to apply", "how do i apply", "how can i apply", "apply online", "how to register", "where to apply", "application process",
              "step by step"],
    "eligibility": ["am i eligible", "check eligibility", "which scholarship for me", "scholarship for me", "which scheme for me", "can i apply",
                    "eligible for scholarship", "qualify for scholarship", "eligible", "scholarships are available", "scholarships available"],
    "scan_tips": ["scan document", "how to scan", "document size", "upload size", "file size"],
    "portal_nsp": ["nsp portal", "scholarships.gov", "portal nsp"],
    "portal_umis": ["umis portal", "umis.tn", "portal umis"],
    "renewal": ["renew scholarship", "how to renew", "renewal process", "second year scholarship", "renewal application", "renew"],
    "income_expired": ["expired income certificate", "income certificate expired", "income validity", "old income certificate", "old date",
                       "income certificate has an old date", "income certificate old"],
    "income_cert": ["income certificate", "get income certificate", "income proof", "family income certificate",
                    "what income certificate is required"],
    "community_cert": ["community certificate", "caste certificate", "get community certificate", "what community certificate is required"],
    "verify_cert": ["verify whether my certificate is genuine", "verify certificate", "genuine certificate", "is my certificate genuine",
                    "check certificate genuine", "can you verify whether my certificate"],
    "dual_scholarship": ["both nsp and tamil nadu", "both nsp and state", "can i get both nsp and tamil nadu scholarship",
                         "two scholarships at the same time", "can i apply for two scholarships", "multiple scholarships"],
    "which_scholarship_first": ["which scholarship should i apply for first", "which scholarship to apply first", "which scheme first"],
    "scholarship_list": ["list of scholarships", "all scholarships", "available scholarships", "what scholarships", "types of scholarship",
                         "scholarship schemes"],
    "amount": ["how much money", "scholarship amount", "how much scholarship", "payment amount", "scholarship money"],
    "status": ["application status", "check status", "track application", "scholarship status"],
    "readiness": ["am i ready", "ready to apply", "check readiness", "before applying", "checklist", "what should i do before applying"],
    "help": ["help", "what can you do", "guide me", "what do you know", "features"],
}
ELIGIBILITY_WORDS = ("eligible", "scholarship", "scheme", "apply", "for me")
# Intents that have an answer of their own; the others go on to eligibility or the corpus.
ANSWERED_ELSEWHERE = ("eligibility", "unknown")


def phrase_rows(priority: dict | None = None, scored: dict | None = None) -> list[dict]:
    """(ord, intent_no, intent, phrase, weight, is_priority) rows of an intent table."""
    rows, number = [], 0
    for table, first in ((PRIORITY_INTENTS if priority is None else priority, True), (SCORED_INTENTS if scored is None else scored, False)):
        for intent, phrases in table.items():
            rows += [{"ord": 0, "intent_no": number, "intent": intent, "phrase": p, "weight": 2 * len(p.split(" ")), "is_priority": first} for p in phrases]
            number += 1
    return [{**r, "ord": i} for i, r in enumerate(rows)]
