"""Question corpus: hand-written questions and the templated matrix.

Fixed values: question texts, topic templates and the dictionaries they are built from.
Generated ids count from 1001 in the order state, category, course, topic.
"""

HAND_WRITTEN = [
    (1, "what is your name", "Identity", "National"), (2, "who are you", "Identity", "National"),
    (3, "hello", "Greetings", "National"), (4, "hi", "Greetings", "National"),
    (5, "greetings", "Greetings", "National"), (6, "vanakkam", "Greetings", "National"),
    (7, "thank you", "Greetings", "National"), (8, "thanks", "Greetings", "National"),
    (9, "who built you", "Identity", "National"), (10, "is aadhaar mandatory", "Documents", "National"),
    (11, "what is nsp", "Technical", "National"), (12, "how does dbt payment work", "Technical", "National"),
    (13, "nsp registration process", "Portal", "National"), (14, "what is umis", "Technical", "Tamil Nadu"),
    (15, "what is emis", "Technical", "Tamil Nadu"), (16, "what is pudhumaipenn scheme", "Welfare", "Tamil Nadu"),
    (17, "what is tamil pudhalvan scheme", "Welfare", "Tamil Nadu"),
    (18, "what is first graduate scholarship eligibility", "Eligibility", "Tamil Nadu"),
    (19, "what is 7.5 percent government school quota fee waiver", "Welfare", "Tamil Nadu"),
    (20, "what is bc mbc scholarship eligibility", "Eligibility", "Tamil Nadu"),
    (21, "what is sc st post matric scholarship in tamil nadu", "Eligibility", "Tamil Nadu"),
    (22, "how can salem district farmers children apply for scholarship", "District", "Tamil Nadu"),
]
STATES = [
    "Central NSP", "Maharashtra", "Uttar Pradesh", "Bihar", "West Bengal", "Karnataka", "Kerala", "Andhra Pradesh",
    "Tamil Nadu", "Delhi", "Rajasthan", "Gujarat", "Madhya Pradesh", "Punjab", "Haryana", "Odisha", "Assam",
    "Telangana", "Jharkhand", "Chhattisgarh", "Himachal Pradesh",
]
CATEGORIES = ["SC", "ST", "OBC", "Minority", "EWS", "General"]
COURSES = ["Engineering", "Medical", "Arts", "Science", "Diploma", "School"]
TOPICS = [
    "what is the eligibility for", "which documents are needed for", "what is the last date to apply for",
    "how to apply for", "what is the income limit for", "what is the helpline for",
]
FIRST_GENERATED_ID = 1001
GUARDED_FROM_ID = 1000
UNGUARDED_STATE = "central nsp"
# Ordered phrases that lead straight to one hand-written question.
PRIORITY_PHRASES = [
    (r"^hi$|^hello$|^hey$|^vanakkam$|^namaste$", 4), (r"what is umis|umis portal", 14), (r"what is emis|emis id", 15),
    (r"pudhumaipenn", 16), (r"tamil pudhalvan", 17), (r"first graduate", 18),
    (r"7\.5\s*%|7\.5 percent|government school quota", 19), (r"bc mbc scholarship|mbc scholarship", 20),
    (r"sc st post matric", 21), (r"salem.*farmer|salem.*agricultural", 22), (r"is aadhaar mandatory|aadhar mandatory", 10),
    (r"what is nsp|national scholarship portal", 11), (r"how does dbt payment work|direct benefit transfer", 12),
]
EXACT_SCORE, PRIORITY_SCORE, CONTAINMENT_BONUS, MIN_SCORE = 1.0, 0.95, 0.35, 0.20
STOP_WORDS = (
    "is are was were be been being have has had do does did a an the and but or as if of at by for with about to in on "
    "into through during before after above below from up down out off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very can "
    "will just should now what who your mine you i me my we our us them their they he him his she her please tell show "
    "give want need get like"
).split()
