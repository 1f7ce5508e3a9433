"""Community, course, level, gender and state mappings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from grantlens.functions.text import blank_to_null, matches

# --- fixed values --------------------------------------------------------------------
COMMUNITY_CODES = {
    "sc": "SC", "scheduled caste": "SC", "adi dravidar": "SC", "adi dravida": "SC",
    "st": "ST", "scheduled tribe": "ST", "tribal": "ST",
    "bc": "BC", "backward class": "BC", "backward classes": "BC",
    "mbc": "MBC", "most backward class": "MBC", "most backward classes": "MBC",
    "dnc": "DNC", "dnt": "DNC", "denotified community": "DNC", "denotified tribe": "DNC",
    "obc": "OBC", "other backward class": "OBC", "other backward classes": "OBC",
    "ebc": "EBC", "economically backward class": "EBC",
    "gen": "General", "general": "General", "fc": "General", "forward class": "General",
    "open category": "General", "unreserved": "General",
}
COMMUNITY_IN_BRACKETS = ("SC", "ST", "BC", "MBC", "DNC", "OBC", "EBC", "GEN")
# Tested in this order: "backward class" comes before "other backward".
COMMUNITY_PHRASES = (
    ("scheduled caste", "SC"), ("scheduled tribe", "ST"), ("most backward", "MBC"), ("denotified", "DNC"),
    ("backward class", "BC"), ("other backward", "OBC"), ("forward class", "General"), ("general", "General"),
)
RELIGION_PHRASES = (
    ("hindu", "Hindu"), ("muslim", "Muslim"), ("islam", "Muslim"), ("christian", "Christian"), ("sikh", "Sikh"),
    ("buddhist", "Buddhist"), ("jain", "Jain"), ("parsi", "Parsi"), ("zoroastrian", "Parsi"),
)
CATEGORY_WORDS = {
    "SC": ("sc", "scheduled caste", "adi dravidar"),
    "ST": ("st", "scheduled tribe", "tribal"),
    "MBC": ("mbc", "most backward", "dnc", "dnt", "denotified"),
    "BC": ("bc", "obc", "backward class", "backward", "ebc"),
    "Minority": ("minority", "muslim", "christian", "sikh", "buddhist", "parsi", "jain"),
    "General": ("general", "oc", "fc", "forward", "open", "ews"),
    "All": ("all",),
}
COMMUNITY_WORDS = {
    "sc": ("sc",), "st": ("st",), "mbc": ("mbc", "dnc", "dnt"), "bc": ("bc", "obc", "ebc"),
    "minority": ("minority",), "general": ("general", "oc", "fc", "ews"), "all": ("all",),
}
COURSE_PATTERNS = (
    ("Engineering", r"\b(engineering|b\.?e|b\.?tech|cse|ece|eee|mech|civil|polytechnic)\b"),
    ("Medical", r"\b(medical|mbbs|bds|nursing|pharmacy|b\.?pharm|paramedical)\b"),
    ("Diploma", r"\b(diploma|iti)\b"),
    ("School", r"\b(school|class 11|class 12|class 10|class 9|high school|10th|12th|nmms)\b"),
    ("Science", r"\b(bsc|b\.?sc|science|msc|m\.?sc)\b"),
    ("Arts", r"\b(arts|history|english|economics|ba|b\.?a|bcom|b\.?com)\b"),
)
LEVEL_PATTERNS = (
    ("pg", r"\b(pg|postgraduate|masters|mtech|msc|mba|mca|ma|md|ms)\b"),
    ("diploma", r"\b(diploma|polytechnic)\b"),
    ("iti", r"\b(iti)\b"),
    ("prematric", r"\b(school|prematric|class 9|class 10|class 6|class 7|class 8|nmms)\b"),
    ("ug", r"\b(ug|undergraduate|degree|bachelor|be|btech|bsc|ba|bcom|bca|bba|mbbs|engineering|medical|arts|science)\b"),
)
GENDER_PATTERNS = (
    ("Girls", r"\b(girl|girls|female|women|woman|she|lady)\b"),
    ("Boys", r"\b(boy|boys|male|men|man|he)\b"),
)
STATE_PATTERNS = (
    ("Tamil Nadu", r"\b(tn|tamil\s*nadu|tamilnadu)\b"), ("Uttar Pradesh", r"\b(up|uttar\s*pradesh)\b"),
    ("West Bengal", r"\b(wb|west\s*bengal)\b"), ("Maharashtra", r"\b(mh|maharashtra)\b"),
    ("Karnataka", r"\b(ka|karnataka)\b"), ("Kerala", r"\b(kl|kerala)\b"),
    ("Andhra Pradesh", r"\b(ap|andhra|andhra\s*pradesh)\b"), ("Telangana", r"\b(ts|telangana)\b"),
    ("All-India", r"\b(national|all-india|central)\b"),
)
STATES = (
    "Tamil Nadu", "All-India / National", "Andhra Pradesh", "Bihar", "Delhi", "Gujarat", "Karnataka", "Kerala",
    "Madhya Pradesh", "Maharashtra", "Odisha", "Punjab", "Rajasthan", "Telangana", "Uttar Pradesh", "West Bengal",
    "Haryana", "Assam", "Jharkhand", "Chhattisgarh", "Himachal Pradesh",
)
DISTRICTS = (
    "Ariyalur", "Chengalpattu", "Chennai", "Coimbatore", "Cuddalore", "Dharmapuri", "Dindigul", "Erode",
    "Kallakurichi", "Kanchipuram", "Kanyakumari", "Karur", "Krishnagiri", "Madurai", "Mayiladuthurai",
    "Nagapattinam", "Namakkal", "Nilgiris", "Perambalur", "Pudukkottai", "Ramanathapuram", "Ranipet", "Salem",
    "Sivaganga", "Tenkasi", "Thanjavur", "Theni", "Thoothukudi", "Tiruchirappalli", "Tirunelveli", "Tirupathur",
    "Tiruppur", "Tiruvallur", "Tiruvannamalai", "Tiruvarur", "Vellore", "Viluppuram", "Virudhunagar",
)
# (scheme community, applicant community) pairs accepted besides equality.
COMPATIBLE_COMMUNITIES = (("BC", "MBC"), ("BC", "DNC"), ("OBC", "BC"), ("OBC", "MBC"))
# -------------------------------------------------------------------------------------


def choose(pairs, test, default: Column | None = None) -> Column:
    """First value of `pairs` whose test holds."""
    out = None
    for value, key in pairs:
        out = F.when(test(key), F.lit(value)) if out is None else out.when(test(key), F.lit(value))
    return out if default is None else out.otherwise(default)


def lookup(key: Column, table: dict[str, str]) -> Column:
    constant = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(constant, key)


def _word_lookup(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    return lookup(F.lower(F.trim(text)), {w: code for code, ws in words.items() for w in ws})


def to_category(text: Column) -> Column:
    return _word_lookup(text, CATEGORY_WORDS)


def to_community(text: Column) -> Column:
    """Lower-case community code; an unknown word is kept in lower case."""
    return F.coalesce(_word_lookup(text, COMMUNITY_WORDS), blank_to_null(F.lower(F.trim(text))))


def to_course(text: Column) -> Column:
    return choose(COURSE_PATTERNS, lambda p: matches(F.lower(text), p), F.lit("All"))


def to_level(text: Column) -> Column:
    return choose(LEVEL_PATTERNS, lambda p: matches(F.lower(text), p))


def to_gender(text: Column) -> Column:
    return choose(GENDER_PATTERNS, lambda p: matches(F.lower(text), p), F.lit("All"))


def to_state(text: Column) -> Column:
    """Full state name; NULL and blank count as Tamil Nadu, unknown text stays as it is."""
    lowered = F.lower(F.trim(text))
    named = lookup(lowered, {s.lower(): s for s in STATES})
    resolved = choose(STATE_PATTERNS, lambda p: matches(lowered, p), F.coalesce(named, text))
    return F.when(blank_to_null(text).isNull(), F.lit("Tamil Nadu")).otherwise(resolved)


def normalize_community(text: Column) -> Column:
    raw = F.lower(F.trim(text))
    inner = F.upper(F.trim(F.regexp_extract(raw, r"\(([^)]+)\)", 1)))
    bracket = F.when(inner == "GEN", "General").when(inner.isin(*COMMUNITY_IN_BRACKETS), inner)
    phrase = choose([(code, p) for p, code in COMMUNITY_PHRASES], lambda p: raw.contains(p), F.trim(text))
    return blank_to_null(F.coalesce(lookup(raw, COMMUNITY_CODES), bracket, phrase))


def normalize_religion(text: Column) -> Column:
    raw = F.lower(F.trim(text))
    return choose([(name, p) for p, name in RELIGION_PHRASES], lambda p: raw.contains(p), F.trim(text))


def community_accepted(scheme: Column, applicant: Column) -> Column:
    s, a = F.upper(scheme), F.upper(applicant)
    accepted = s == a
    for wanted, given in COMPATIBLE_COMMUNITIES:
        accepted = accepted | ((s == wanted) & (a == given))
    return accepted
