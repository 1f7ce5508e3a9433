import re

import pytest
from pyspark.sql import functions as F

from grantlens.functions.text import _guard, _literals, _word_edges, java, matches, squeeze
from grantlens.operators.documents import classify_documents, detect_title
from grantlens.operators.eligibility import rank_schemes
from grantlens.rules import corpus, documents, extraction, utterances

TEXTS = [
    "", " ", "I am MBC, be in b.e. or B.Tech", "income: Rs. 2,50,000 a year", "7.5% quota", "7 quota", "class xii +2 second  year", "CASTE CERTIFICATE", "cert no 5", "₹ 3 lakh",
    "பத்தாம் வகுப்பு மதிப்பெண் சான்றிதழ்", "சாதிச்  சான்றிதழ்", "1234 5678 9012", "S.S.L.C mark certificate", "TC certificate", "T.C. certificate", "x-bc", "abc", "bc_", "İNCOME certificate", "ſslc hſc K",
    "hr.sec hr sec hrsec", "hi!", " hi", "2,34,567", "  45000 ", "12,345", "DATE OF BIRTH: 01/02/2004", "NAME OF THE CANDIDATE\nARUN K", "\n\tincome\n certificate",
]


def patterns(of) -> list[str]:
    if isinstance(of, str):
        return [of] if any(c in of for c in "\\|[(") else []
    if isinstance(of, dict):
        of = list(of.values())
    return [p for v in of for p in patterns(v)] if isinstance(of, list | tuple) else []


def test_look_aheads_and_literals_change_no_match(spark):
    rules = list(dict.fromkeys(p for m in (corpus, documents, extraction, utterances) for n, v in vars(m).items() if not n.startswith("__") for p in patterns(v)))
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, *rules, None]], "t string").cache()
    assert len(rules) > 200 and sum(bool(_guard(p)) for p in rules) > 150 and sum(bool(_literals(p)) for p in rules) > 100
    for i in range(0, len(rules), 40):
        wrong = []
        for j, p in enumerate(rules[i:i + 40]):
            for ignore in (True, False):
                plain = f"{'(?i)' if ignore else ''}{_word_edges(p)}"
                same = F.regexp_extract_all("t", F.lit(plain), F.lit(0)).eqNullSafe(F.regexp_extract_all("t", F.lit(java(p, ignore)), F.lit(0)))
                low = F.lower("t") if ignore else F.col("t")
                same = same & F.col("t").rlike(plain).eqNullSafe(matches(F.col("t"), p, ignore, low=low))
                wrong.append(F.count_if(~same).alias(f"{j} {ignore}"))
        assert not {k: rules[i + int(k.split()[0])] for k, n in rows.agg(*wrong).first().asDict().items() if n}


@pytest.mark.parametrize("pattern, begins, literals", [
    (r"\bmbc\b|\bdnc\b", "(?=[md])", ("mbc", "dnc")), (r"(?:₹|rs\.?)?\s*[0-9]+", r"(?=[₹r\s0-9])", ()), (r"[a-z]*", "", ()), (r"income\s+certificate", "", ("certificate",)),
    (r"(?<!x)ab?c", "", ()), (r"[^a]bcd", "", ("bcd",)), (r"\S+x", "", ()), (r"ab|", "", ()), (r"\|x[|]yyy", r"(?=[\|])", ("yyy",)), (r"(abc)?defg", "(?=[ad])", ("defg",)),
])
def test_what_a_pattern_begins_with_and_holds(pattern, begins, literals):
    assert (_guard(pattern), _literals(pattern)) == (begins, literals)


def test_white_space_is_squeezed(spark):
    texts = ["", " ", "a b", " a  b\t c\n\n", "a\n b", "a \n b", " a  b", "a\r\nb", "a\x0bb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", squeeze(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ") for t in texts]


def test_a_header_is_repaired_once(spark):
    df = spark.createDataFrame([("1NC0ME CERT1F1CATE of",), ("community certificate",), ("the incom e of 12th",), (None,)], "t string").select("t", detect_title(F.col("t")).alias("d"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("C0MMUN1TY") == 1
    assert [r.d.title for r in df.collect()] == ["Income Certificate", "Community Certificate", "Possible 12th Marksheet", "Unknown Document"]


def test_texts_without_a_literal_are_not_searched(spark):
    df = classify_documents(spark.createDataFrame([(1, "State Bank of India PASSBOOK ifsc")], "k int, text string"), "k")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Contains(") > 50
    assert df.first().doc_type == "bankpass"


def test_schemes_are_ranked_once(spark):
    profiles = spark.createDataFrame([(1, "SC", "Girls"), (2, None, None)], "applicant_id int, category string, gender string")
    out = rank_schemes(profiles, top_k=2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1 and out.count() == 4
