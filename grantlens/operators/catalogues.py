"""Jobs between applicants and the scheme catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grantlens.functions.text import blank_to_null
from grantlens.rules import metadata as M
from grantlens.rules.relations import frame
from grantlens.rules.schemes import MINORITY_FORM_LABELS, catalogue_a, catalogue_b
from grantlens.sources.catalogue import CATALOGUE_B_TYPES, accepted_communities, scheme_checklists, scheme_metadata

# Document words that satisfy one another, as (words in the label, words in the upload type).
DOCUMENT_WORDS = [
    (("marksheet", "class", "12th", "10th"), ("marksheet", "twelfth", "tenth", "class")),
    (("bank", "passbook", "statement"), ("bank", "passbook", "statement")),
    (("bonafide", "enrollment", "college", "admission"), ("bonafide", "college", "enrollment", "admission")),
    (("aishe", "institute"), ("aishe", "institute", "bonafide", "college")),
    (("aadhaar", "identity"), ("aadhaar", "aadhar", "identity")),
    (("income",), ("income",)),
    (("community", "caste", "obc", "sc", "st"), ("community", "caste")),
    (("first graduate",), ("first_graduate", "graduate")),
    (("disability",), ("disability",)),
]
SHORT_WORDS = ("sc", "st")
PROJECTION_YEARS = 4
YEARS_LEFT = {"1st": 4, "2nd": 3, "3rd": 2, "4th": 1}


def form_community(raw: Column) -> Column:
    """Upper-case community; the minority labels of the form become MIN."""
    upper = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(upper.isin(*MINORITY_FORM_LABELS), "MIN").otherwise(upper)


def match_schemes(forms: DataFrame) -> DataFrame:
    """Schemes of the second catalogue whose lists and ceilings admit the applicant.

    The accepted communities are exploded on the catalogue side, so the match is an
    equi-join on community; the other conditions are residuals of it.
    """
    spark = forms.sparkSession
    accepted = frame(spark, accepted_communities(), {**CATALOGUE_B_TYPES, "community": "string"}).select(
        F.col("community").alias("accepted"), F.col("id").alias("b_id"), F.col("ord").alias("b_ord"), "max_income", "courses",
        "special_condition", "amount_type", "amount_min", "amount_max", "amount_ug", "amount_pg", "amount_boys", "amount_girls")
    course = F.lower(F.trim(F.coalesce("course", F.lit(""))))
    fits = (
        (form_community(F.col("community")) == F.col("accepted"))
        & (F.col("income") <= F.col("max_income"))
        & ((course == "") | F.array_contains("courses", course))
        & (F.col("special_condition").isNull() | (F.col("special_condition") != "armed_forces") | (F.col("armed_forces") == "yes"))
    )
    return forms.join(accepted, fits).drop("accepted", "courses", "special_condition", "max_income")


def base_amount(course: Column) -> Column:
    """The yearly amount of a scheme of the second catalogue."""
    return (
        F.when(F.col("amount_type") == "tiered", F.when(course == "pg", F.col("amount_pg")).otherwise(F.col("amount_ug")))
        .when(F.col("amount_type") == "fixed", F.col("amount_boys"))
        .when(F.col("amount_type") == "full", F.col("amount_min"))
        .otherwise(F.floor((F.col("amount_min") + F.col("amount_max")) / 2 + 0.5).cast("int"))
    )


def award_amounts(matches: DataFrame) -> DataFrame:
    return matches.withColumn("base_amount", base_amount(F.col("course")))


def award_projection(awards: DataFrame) -> DataFrame:
    """P5: four year rows; past years carry no amount."""
    left = F.coalesce(*[F.when(F.col("current_year") == y, n) for y, n in YEARS_LEFT.items()], F.lit(4))
    current = F.coalesce(*[F.when(F.col("current_year") == y, 5 - n) for y, n in YEARS_LEFT.items()], F.lit(1))
    return (
        awards.withColumns({"remaining_years": left, "current_no": current})
        .withColumn("year_no", F.explode(F.sequence(F.lit(1), F.lit(PROJECTION_YEARS))))
        .withColumns({
            "year_amount": F.when(F.col("year_no") >= F.col("current_no"), F.col("base_amount")),
            "is_current": F.col("year_no") == F.col("current_no"),
            "remaining_amount": F.col("base_amount") * F.col("remaining_years"),
            "total_amount": F.col("base_amount") * PROJECTION_YEARS,
        })
        .drop("current_no")
    )


def linked_scheme_ids() -> list[dict]:
    """(b id, a id) pairs that count as the same scheme: same id, same name, or any BC name for the state BC/MBC scheme."""
    return [
        {"b_id": b["id"], "scheme_id": a["id"]}
        for b in catalogue_b() for a in catalogue_a()
        if a["id"] == b["id"] or a["name"].lower() == b["name"].lower() or ("BC" in a["name"] and b["id"] == "tn-bc-mbc")
    ]


def link_catalogues(matches: DataFrame, ranked: DataFrame, key: str = "applicant_id") -> DataFrame:
    """For each matched scheme of the second catalogue the first linked evaluation in ranking order, if any."""
    links = frame(matches.sparkSession, linked_scheme_ids(), {"b_id": "string", "scheme_id": "string"})
    candidates = ranked.join(links, "scheme_id")
    best = candidates.groupBy(key, "b_id").agg(
        F.min_by(F.struct("scheme_id", "status", "score", "position"), "position").alias("e"))
    return matches.select(key, "b_id").join(best, [key, "b_id"], "left").select(key, "b_id", "e.*")


def search_schemes(schemes: DataFrame, terms: DataFrame) -> DataFrame:
    """Schemes whose name or state contains the term, within the chosen bucket.

    `terms(term, bucket, n)` holds each distinct search once; both sides are small by then.
    """
    hit = (F.coalesce("term", F.lit("")) == "") | F.lower("name").contains(F.lower("term")) | F.lower("state").contains(F.lower("term"))
    bucket = F.when(F.col("state") == "All-India", "Central / NSP").when(F.col("state") == "Tamil Nadu", "Tamil Nadu").otherwise("Other States")
    choices = schemes.withColumn("bucket", F.explode(F.array(F.lit("All"), bucket)))
    return choices.join(terms, "bucket").filter(hit)


def enrich_metadata(schemes: DataFrame) -> DataFrame:
    """Metadata added to scheme rows; blank metadata falls back to the scheme's own value."""
    meta = scheme_metadata(schemes.sparkSession).select(
        F.col("id").alias("scheme_id"), F.col("portal").alias("m_portal"), "scope", "jurisdiction", "academic_year", "level",
        "rule_status", "disability_rule", "minimum_disability_percentage", "domicile_rule", "renewal_conditions",
        F.col("source_url").alias("m_url"))
    joined = schemes.join(meta, "scheme_id", "left")
    return joined.withColumns({
        "portal": F.col("m_portal"),
        "source_url": F.coalesce(blank_to_null(F.col("m_url")), F.col("official_portal") if "official_portal" in schemes.columns else F.lit(None)),
    }).drop("m_portal", "m_url")


def document_checklist(schemes: DataFrame) -> DataFrame:
    """Checklist rows per scheme; schemes without metadata list their own documents as required."""
    spark = schemes.sparkSession
    items = scheme_checklists(spark).withColumnRenamed("id", "scheme_id")
    described = schemes.join(scheme_metadata(spark).select(F.col("id").alias("scheme_id"), "rule_status", "academic_year", "jurisdiction", "portal"),
                             "scheme_id", "left")
    head = described.select(
        "scheme_id", "documents", F.col("rule_status").isNotNull().alias("known"),
        F.coalesce("rule_status", F.lit(M.DEFAULT_RULE_STATUS)).alias("rule_status"),
        F.coalesce("academic_year", F.lit(M.ACADEMIC_YEAR)).alias("academic_year"),
        F.coalesce("jurisdiction", F.lit(M.DEFAULT_JURISDICTION)).alias("jurisdiction"),
        F.coalesce("portal", F.lit(M.DEFAULT_PORTAL)).alias("portal"))
    tail = ["rule_status", "academic_year", "jurisdiction", "portal"]
    listed = head.filter("known").join(items, "scheme_id").select("scheme_id", "item_ord", "kind", "label", "purpose", *tail)
    assumed = head.filter("not known").select("scheme_id", F.posexplode("documents").alias("item_ord", "label"), *tail).select(
        "scheme_id", "item_ord", F.lit("REQUIRED").alias("kind"), "label", F.lit(M.DEFAULT_PURPOSE).alias("purpose"), *tail)
    return listed.unionByName(assumed)


def rule_status_counts(picked: DataFrame) -> DataFrame:
    """How many picks fall on verified, partially verified and unverified schemes, and which schemes those are."""
    meta = scheme_metadata(picked.sparkSession).select(F.col("id").alias("scheme_id"), "rule_status")
    per_scheme = picked.groupBy("scheme_id").agg(F.count(F.lit(1)).alias("n")).join(meta, "scheme_id", "left")
    return per_scheme.groupBy(F.coalesce("rule_status", F.lit(M.DEFAULT_RULE_STATUS)).alias("rule_status")).agg(
        F.sum("n").alias("picks"), F.array_join(F.sort_array(F.collect_set("scheme_id")), ",").alias("scheme_ids"))


def _group_mask(groups: list[list[Column]]) -> Column:
    """One bit per group of tests, set if any of them holds."""
    mask = F.lit(0).cast("bigint")
    for bit, tests in enumerate(groups):
        some = tests[0]
        for test in tests[1:]:
            some = some | test
        mask = mask + F.when(some, 1 << bit).otherwise(0)
    return mask


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def label_mask(text: Column, legacy: bool = False) -> Column:
    """The word groups that a lower-case label names. By default the short words SC and ST count only as whole words."""
    names = lambda w: text.rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])") if w in SHORT_WORDS and not legacy else text.contains(w)
    return _group_mask([[names(w) for w in words] for words, _ in DOCUMENT_WORDS])


def upload_mask(kind: Column) -> Column:
    """The word groups that a lower-case document type covers."""
    return _group_mask([[kind.contains(w) for w in words] for _, words in DOCUMENT_WORDS])


def satisfies(text: Column, text_mask: Column, kind: Column, kind_mask: Column, legacy: bool = False) -> Column:
    """Whether a document type covers a label, both in lower case with their masks. By default an empty type covers nothing."""
    found = text.contains(kind) | kind.contains(text) | (text_mask.bitwiseAND(kind_mask) != 0)
    return found if legacy else found & (kind != "") & (text != "")


def missing_documents(required: DataFrame, uploaded: DataFrame, key: str = "case_id", legacy: bool = False) -> DataFrame:
    """Required labels no upload of the same case covers.

    Uploads shrink to the distinct types of a case before the shuffle, so a case with very
    many files still probes a handful of rows. Words are looked up once per label and once
    per type; a pair only compares two bit masks and two texts.
    """
    types = uploaded.select(F.col(key).alias("u_key"), lowered(F.col("upload_type")).alias("u_kind")).distinct().withColumn("u_mask", upload_mask(F.col("u_kind")))
    labels = required.withColumn("l_text", lowered(F.col("label"))).withColumn("l_mask", label_mask(F.col("l_text"), legacy))
    covered = satisfies(F.col("l_text"), F.col("l_mask"), F.col("u_kind"), F.col("u_mask"), legacy)
    return labels.join(types, (F.col(key) == F.col("u_key")) & covered, "left_anti").drop("l_text", "l_mask")


