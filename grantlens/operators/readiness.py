"""Readiness of an application before it is submitted.

Every case is one wide row: its profile, the evidence of its documents and, through one
join with the scheme dimension, the scheme it applies for. All 37 rules are one
projection to an array of risks; scores, levels and counts are taken from that array in
the same stage, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grantlens.functions import dates as D
from grantlens.functions.banding import PROFILE_BANDS, band, js_round
from grantlens.functions.categories import to_category
from grantlens.functions.names import letters_key, name_similarity, similarity
from grantlens.functions.text import blank_to_null, let, unfolded
from grantlens.operators.catalogues import label_mask, lowered, satisfies, upload_mask
from grantlens.operators.eligibility import SCHEME_TYPES, rank_of, tally_of, prepare_schemes, profile_fields
from grantlens.operators.identity import certificate_expiry
from grantlens.rules import risks as R
from grantlens.rules.metadata import checklist_rows, metadata_rows
from grantlens.rules.relations import frame
from grantlens.rules.schemes import catalogue_a

IFSC = "^[A-Z]{4}0[A-Z0-9]{6}$"
DEFAULT_MIN_DISABILITY = 40
DIMENSION_TYPES = {
    **SCHEME_TYPES, "requires_govt_quota": "boolean", "requires_first_graduate": "boolean", "rule_status": "string", "jurisdiction": "string",
    "portal": "string", "scheme_state": "string", "scheme_level": "string", "scheme_year": "string", "renewal_conditions": "string",
    "requires_domicile": "boolean", "needs_disability": "boolean", "min_disability": "int", "is_central": "boolean",
    "is_portal_scheme": "boolean", "required_labels": "array<string>",
}


def scheme_dimension() -> list[dict]:
    """One row per scheme with its metadata and the derived scheme-level facts."""
    meta = {m["id"]: m for m in metadata_rows()}
    labels: dict[str, list[str]] = {}
    for item in checklist_rows():
        if item["kind"] == "REQUIRED":
            labels.setdefault(item["id"], []).append(item["label"])
    rows = []
    for row in prepare_schemes(catalogue_a() + [{"ord": 100 + i, **r} for i, r in enumerate(R.METADATA_ONLY_SCHEMES)]):
        m = meta.get(row["id"], {})
        state = row.get("state") or "All-India"
        jurisdiction = m.get("jurisdiction") or ("TAMIL_NADU" if row.get("state") == "Tamil Nadu" else "CENTRAL")
        domicile, disability = m.get("domicile_rule") or "", m.get("disability_rule") or "None"
        rows.append({
            **row, "rule_status": m.get("rule_status"), "jurisdiction": jurisdiction, "portal": m.get("portal"), "scheme_state": state,
            "scheme_level": m.get("level"), "scheme_year": m.get("academic_year"), "renewal_conditions": m.get("renewal_conditions"),
            "requires_govt_quota": bool(row.get("requires_govt_quota")), "requires_first_graduate": bool(row.get("requires_first_graduate")),
            "requires_domicile": (state != "All-India" and jurisdiction != "CENTRAL")
            or bool(domicile and "All-India" not in domicile and not domicile.startswith("None")),
            "needs_disability": bool(row.get("requires_disability")) or not disability.startswith("None"),
            "min_disability": m.get("minimum_disability_percentage") or DEFAULT_MIN_DISABILITY,
            "is_central": jurisdiction == "CENTRAL" or state == "All-India",
            "is_portal_scheme": jurisdiction == "CENTRAL" or m.get("portal") == "NSP" or state == "All-India",
            "required_labels": labels.get(row["id"]) or row.get("documents") or [],
        })
    return rows


def scheme_frame(spark: SparkSession) -> DataFrame:
    return frame(spark, scheme_dimension(), DIMENSION_TYPES)


def _listed(csv: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(csv), F.lit("")), ","), lambda x: x != "")


def valid_ifsc(code: Column) -> Column:
    return F.upper(F.trim(code)).rlike(IFSC)


def prepare_cases(cases: DataFrame, as_of: Column, legacy_documents: bool = False) -> DataFrame:
    """Case rows joined to their scheme, with everything the rules test."""
    dim = scheme_frame(cases.sparkSession)
    needs = F.transform("required_labels", lambda label: let(lowered(label), lambda t: F.struct(label.alias("label"), t.alias("text"), label_mask(t, legacy_documents).alias("mask"))))
    scheme = dim.select(F.col("id").alias("scheme_id"), F.struct(*SCHEME_TYPES).alias("scheme"), needs.alias("required"),
                        *[c for c in DIMENSION_TYPES if c not in SCHEME_TYPES])
    # A case of an unknown scheme stays: what depends on the scheme is unknown.
    none = F.array().cast("array<struct<label:string,text:string,mask:bigint>>")
    joined = cases.join(scheme, "scheme_id", "left").withColumn("required", F.coalesce("required", none))
    p = profile_fields(cases)
    s = lambda name: F.col("scheme").getField(name)
    compared = ("student_name", "aadhaar_name", "tenth_name", "twelfth_name", "bank_holder", "bonafide_name")
    joined = joined.withColumns({f"k_{c}": letters_key(F.col(c)) for c in compared})
    differs = lambda c: F.when(F.col(c).isNotNull() & (similarity(F.col("k_student_name"), F.col(f"k_{c}")) < 0.75), 1).otherwise(0)
    mismatches = sum((differs(c) for c in compared[1:]), F.lit(0))
    kinds = F.transform(_listed("uploads"), lambda u: let(lowered(u), lambda k: F.struct(k.alias("kind"), upload_mask(k).alias("mask"))))
    joined = joined.withColumn("upload_kinds", kinds)
    uploads = F.col("upload_kinds")
    covers = lambda need: F.exists(uploads, lambda u: satisfies(need["text"], need["mask"], u["kind"], u["mask"], legacy_documents))
    missing = F.transform(F.filter("required", lambda need: ~covers(need)), lambda need: need["label"])
    joined = joined.withColumns({
        "tally": tally_of(p, s), "missing_labels": missing, "n_required": F.size("required"), "n_uploads": F.size(uploads),
        "n_wrong": F.size(_listed("wrong_types")), "n_low_quality": F.size(_listed("low_quality")),
        "n_name_mismatch": F.when(F.col("student_name").isNull(), 0).otherwise(mismatches),
        "sim_income": similarity(F.col("k_student_name"), letters_key(F.col("income_name"))),
        "sim_course": name_similarity(F.col("course"), F.col("doc_course")),
        "sim_institution": name_similarity(F.col("institution"), F.col("doc_institution")),
        "sim_bank": similarity(F.col("k_student_name"), F.col("k_bank_holder")),
        "p_dob": D.dashed_date(F.col("dob")), "tenth_dob_d": D.dashed_date(F.col("tenth_dob")), "aadhaar_dob_d": D.dashed_date(F.col("aadhaar_dob")),
        "ifsc_valid": valid_ifsc(F.col("ifsc")),
        "income_validity": certificate_expiry(as_of, F.col("income_issue_date"), F.col("income_expiry_date"), 12),
    })
    return joined.withColumns({"match_rank": rank_of(F.col("tally"), p, s), "n_missing": F.size("missing_labels")})


def risk_array(evidence: bool = False) -> Column:
    """R1 as one array of structs in rule order; rules that do not apply leave no entry."""
    out = []
    for i, (rule, severity, dimension, field, points, unknown, check, condition) in enumerate(R.RULES):
        shown = F.expr(severity) if severity.startswith("case") else F.lit(severity)
        fields = [
            F.lit(i).alias("ordinal"), F.lit(rule).alias("rule_id"), shown.alias("severity"), F.lit(dimension).alias("dimension"),
            F.lit(field).alias("field"), F.expr(points).cast("int").alias("points"), F.lit(unknown).alias("is_unknown"), F.lit(check).alias("check_type"),
        ]
        if evidence:
            fields.append(F.array_join("missing_labels", ", ").alias("evidence") if rule == "DOCS_MISSING_REQUIRED" else F.lit(condition).alias("evidence"))
        out.append(F.when(F.coalesce(F.expr(condition), F.lit(False)), F.struct(*fields)))
    return F.array_compact(F.array(*out))


def with_risks(cases: DataFrame, as_of: Column, key: str = "case_id", evidence: bool = False) -> DataFrame:
    return prepare_cases(cases, as_of).select(key, "scheme_id", risk_array(evidence).alias("risks"))


def readiness_risks(cases: DataFrame, as_of: Column, key: str = "case_id", evidence: bool = True) -> DataFrame:
    """One row per risk."""
    return unfolded(with_risks(cases, as_of, key, evidence), [key, "scheme_id"], F.col("risks"), "r").select(key, "scheme_id", "r.*")


def order_risks(cases: DataFrame, as_of: Column, key: str = "case_id", legacy_order: bool = False) -> DataFrame:
    """Risks by severity, then rule order. `legacy_order` puts MEDIUM first and leaves HIGH and LOW interleaved."""
    ranks = {R.HIGH: 2, R.MEDIUM: 1, R.LOW: 2} if legacy_order else {R.HIGH: 0, R.MEDIUM: 1, R.LOW: 2}

    def keyed(r: Column) -> Column:
        severity = r.getField("severity")
        rank = F.when(severity == R.HIGH, ranks[R.HIGH]).when(severity == R.MEDIUM, ranks[R.MEDIUM]).otherwise(ranks[R.LOW])
        return F.struct(rank.alias("rank"), r.getField("ordinal").alias("ordinal"), r.getField("rule_id").alias("rule_id"), severity.alias("severity"))

    ordered = F.sort_array(F.transform("risks", keyed))
    return with_risks(cases, as_of, key).select(key, F.posexplode(ordered).alias("pos", "r")).select(
        key, (F.col("pos") + 1).alias("position"), "r.rule_id", "r.severity")


def missing_document_lists(cases: DataFrame, as_of: Column, key: str = "case_id", k: int = 4) -> DataFrame:
    """The first k missing documents of every case, in the scheme's order, and the number left out; cases that uploaded nothing
    or lack nothing have no row."""
    lacking = prepare_cases(cases, as_of).filter((F.col("n_uploads") > 0) & (F.col("n_missing") > 0))
    return lacking.select(key, "scheme_id", "n_missing", F.array_join(F.slice("missing_labels", 1, k), ", ").alias("documents"), F.greatest(F.col("n_missing") - k, F.lit(0)).alias("more"))


def readiness_level(score: Column, has_unknown: Column) -> Column:
    """A3."""
    out = F.when(has_unknown & (score >= R.UNCONFIRMED_FROM), R.UNCONFIRMED_LEVEL)
    for bound, name in R.LEVELS:
        out = out.otherwise(name) if bound is None else out.when(score >= bound, name)
    return out


def readiness_score(cases: DataFrame, as_of: Column, key: str = "case_id") -> DataFrame:
    """A2-A4: capped score per dimension, total, level and counts by severity."""
    base = with_risks(cases, as_of, key)

    def lost(dimension: str) -> Column:
        return F.aggregate(F.filter("risks", lambda r: r.getField("dimension") == dimension), F.lit(0), lambda acc, r: acc + r.getField("points"))

    def count(severity: str) -> Column:
        return F.size(F.filter("risks", lambda r: r.getField("severity") == severity))

    scored = base.withColumns({d: F.greatest(F.lit(0), most - lost(d)) for d, most in R.DIMENSIONS.items()})
    scored = scored.withColumns({
        "total": sum((F.col(d) for d in R.DIMENSIONS), F.lit(0)), "has_unknown": F.exists("risks", lambda r: r.getField("is_unknown")),
        "high_count": count(R.HIGH), "medium_count": count(R.MEDIUM), "low_count": count(R.LOW),
    })
    return scored.select(key, "scheme_id", *R.DIMENSIONS, "total", (F.lit(sum(R.DIMENSIONS.values())) - F.col("total")).alias("lost_points"),
                         "has_unknown", readiness_level(F.col("total"), F.col("has_unknown")).alias("level"), "high_count", "medium_count", "low_count")


def application_vs_document(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Up to seven compared fields per case; income provider and state only where both sides exist."""
    c = F.col
    doc_name, doc_dob = F.coalesce("aadhaar_name", "tenth_name", "twelfth_name"), F.coalesce("tenth_dob", "aadhaar_dob")
    sim = lambda a, b: name_similarity(a, b)
    app_cat, doc_cat = blank_to_null(F.upper(F.trim("category"))), blank_to_null(F.upper(F.trim("community_category")))
    most = F.greatest("income", "income_value")
    share = F.when(most > 0, F.abs(c("income") - c("income_value")) / most).otherwise(0.0)
    by_parent = c("income_applicant") == "parent"
    provider = F.when(by_parent, c("parent_name")).otherwise(c("student_name"))
    row = lambda field, status: F.when(status.isNotNull(), F.struct(F.lit(field).alias("field"), status.alias("status")))
    name_sim = sim(c("student_name"), doc_name)
    rows = [
        row("Name", F.when(doc_name.isNull(), "MISSING").when(name_sim >= 0.90, "MATCH").when(name_sim >= 0.75, "MINOR_DIFFERENCE").otherwise("MISMATCH")),
        row("Date of Birth", F.when(doc_dob.isNull(), "MISSING").when(D.dashed_date(c("dob")) == D.dashed_date(doc_dob), "MATCH").otherwise("MISMATCH")),
        row("Category", F.when(doc_cat.isNull(), "MISSING").when(app_cat == doc_cat, "MATCH").otherwise("MISMATCH")),
        row("Family Income", F.when(c("income_value").isNull(), "MISSING").when(c("income") == c("income_value"), "MATCH")
            .when(c("income").isNotNull() & (share <= 0.10), "MINOR_DIFFERENCE").otherwise("MISMATCH")),
        row("Income Provider", F.when(by_parent & (c("parent_name").isNull() | c("income_name").isNull()), "MISSING")
            .when(provider.isNull() | c("income_name").isNull(), F.lit(None).cast("string"))
            .when(sim(provider, c("income_name")) >= 0.75, "MATCH").otherwise("MISMATCH")),
        row("Bank Account Holder", F.when(c("bank_holder").isNull(), "MISSING").when(sim(c("student_name"), c("bank_holder")) >= 0.75, "MATCH").otherwise("MISMATCH")),
        row("State Domicile", F.when(c("state").isNotNull() & c("doc_state").isNotNull(),
                                     F.when(F.lower("state") == F.lower("doc_state"), "MATCH").otherwise("MISMATCH"))),
    ]
    return cases.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*")


# Confidence of values typed from a reference and from a passbook, and of documents that carry none.
REFERENCE_CONFIDENCE, PASSBOOK_CONFIDENCE, DEFAULT_CONFIDENCE = 100, 95, 90
# The state where no certificate names one, and fields that only the applicant can give.
DEFAULT_STATE = "Tamil Nadu"
ONLY_ENTERED = ("course", "current_year")


def marks_percentage(percentage: Column, scored: Column, maximum: Column) -> Column:
    """The stated percentage, also where it can't be read; without one, the whole percentage of the marks."""
    stated = F.regexp_extract(F.trim(F.replace(percentage, F.lit("%"), F.lit(""))), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    derived = F.when(maximum > 0, js_round(scored / maximum * 100)).cast("double")
    return F.when(blank_to_null(percentage).isNotNull(), stated).otherwise(derived)


def _percent_text(x: Column) -> Column:
    return F.concat(F.regexp_replace(F.round(x, 4).cast("decimal(14,4)").cast("string"), r"\.?0+$", ""), F.lit("%"))


def profile_from_documents(cases: DataFrame, key: str = "case_id", default_state: str | None = DEFAULT_STATE) -> DataFrame:
    """The profile that the documents of a case give: (field, value, source, confidence, status).

    Every field takes the first source that has a value: reference input, marksheets, certificates, passbook. Name, birth date,
    community and income read with less than 50 % confidence are not taken over; marks are. Parent, state and district have a
    source and no confidence. Course and current year are always missing rows; quota and first-graduate answers are never
    assumed. `default_state=None` leaves an unnamed state out. Blank values count as missing.
    """
    c = F.col
    filled = lambda column: blank_to_null(F.trim(column))
    conf = lambda column: F.coalesce(F.col(column), F.lit(DEFAULT_CONFIDENCE))
    fixed, none = F.lit, F.lit(None)
    amount = lambda column: F.col(column).cast("bigint")
    stated = F.coalesce(filled("community_category"), filled("community_name"))
    category = F.coalesce(to_category(stated), F.upper(stated))
    marks = lambda slot: _percent_text(marks_percentage(c(f"{slot}_percentage"), c(f"{slot}_scored"), c(f"{slot}_maximum")))
    sources = {
        "name": [("identity", filled("aadhaar_name"), fixed(REFERENCE_CONFIDENCE)), ("ms10", filled("tenth_name"), conf("tenth_conf")),
                 ("ms12", filled("twelfth_name"), conf("twelfth_conf")), ("community", filled("community_holder"), conf("community_conf")),
                 ("income", filled("income_name"), conf("income_conf")), ("bank", filled("bank_holder"), fixed(PASSBOOK_CONFIDENCE))],
        "dob": [("identity", filled("aadhaar_dob"), fixed(REFERENCE_CONFIDENCE)), ("ms10", filled("tenth_dob"), conf("tenth_conf")), ("ms12", filled("twelfth_dob"), conf("twelfth_conf"))],
        "community": [("community", category, conf("community_conf")), ("entered", filled("category"), fixed(REFERENCE_CONFIDENCE))],
        "income": [("income", F.when(amount("income_value") > 0, amount("income_value")).cast("string"), conf("income_conf")),
                   ("entered", F.when(amount("income") >= 0, amount("income")).cast("string"), fixed(REFERENCE_CONFIDENCE))],
        "marks10": [("ms10", marks("tenth"), conf("tenth_conf"))], "marks12": [("ms12", marks("twelfth"), conf("twelfth_conf"))],
        "parent_name": [(slot, filled(f"{of}_father"), none) for slot, of in (("community", "community"), ("income", "income"), ("ms12", "twelfth"), ("ms10", "tenth"))],
        "state": [("community", filled("community_state"), none), ("income", filled("income_state"), none), ("default", F.lit(default_state), none)],
        "district": [("community", filled("community_district"), none), ("income", filled("income_district"), none)],
    }
    entry = lambda field, value, source, confidence: F.struct(
        F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(source).cast("string").alias("source"), confidence.cast("int").alias("confidence"))
    rows = [F.coalesce(*[F.when(value.isNotNull(), entry(field, value, source, confidence)) for source, value, confidence in options]) for field, options in sources.items()]
    rows += [entry(field, none, None, F.lit(0)) for field in ONLY_ENTERED]
    long = cases.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*")
    status = F.when(F.col("field").isin(*ONLY_ENTERED), "missing").when(F.col("confidence").isNotNull(), band(F.col("confidence"), PROFILE_BANDS, "review"))
    distrusted = (F.col("status") == "untrusted") & F.col("field").isin("name", "dob", "community", "income")
    return long.withColumn("status", status).withColumn("value", F.when(~F.coalesce(distrusted, F.lit(False)), F.col("value")))


def profile_warnings(consistency: DataFrame, key: str = "case_id") -> DataFrame:
    """(severity, field) of the conflicts that the consistency checks found: rows of name_status, dob_status, income_status
    and community_status as A6 gives them. A case without conflicts has no row."""
    warn = lambda when, severity, field: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field")))
    codes = F.array(
        warn(F.col("name_status") == "red", "danger", "name"), warn(F.col("name_status") == "yellow", "warning", "name"), warn(F.col("dob_status") == "red", "danger", "dob"),
        warn(F.col("income_status") == "MISMATCH", "warning", "income"), warn(F.col("community_status") == "MISMATCH", "warning", "community"))
    return consistency.select(key, F.explode(F.array_compact(codes)).alias("w")).select(key, "w.*")


def document_matrix(cases: DataFrame, as_of: Column, key: str = "case_id") -> DataFrame:
    """Identity, academic, social, financial, bank and residence sections side by side.

    Where both mark sheets have a value, the later one's counts. Genders are compared only where both are known; validity of
    certificates follows their age alone (12 months for income, 60 for community), unknown dates are not expired.
    """
    c = F.col
    names = F.array_compact(F.array("aadhaar_name", "tenth_name", "twelfth_name", "bank_holder", "bonafide_name"))
    others_differ = F.exists(names, lambda n: name_similarity(F.get(names, F.lit(0)), n) < 0.75)
    dob_differs = D.dashed_date(c("tenth_dob")) != D.dashed_date(c("aadhaar_dob"))
    later = lambda field: F.coalesce(blank_to_null(c(f"twelfth_{field}").cast("string")), blank_to_null(c(f"tenth_{field}").cast("string"))).alias(field)
    expired = lambda issue, months: F.coalesce(certificate_expiry(as_of, c(issue), F.lit(None).cast("string"), months) == "REQUIRES_REVIEW", F.lit(False))
    months_old = lambda issue: js_round(D.months_between_days(as_of, D.parse_date(c(issue)), D.DAYS_PER_MONTH_EXPIRY))
    genders = F.when(F.lower("gender") == F.lower("aadhaar_gender"), "MATCH").when(c("gender").isNull() | c("aadhaar_gender").isNull(), "UNCONFIRMED").otherwise("MISMATCH")
    return cases.select(
        key, "aadhaar_name", "tenth_name", "twelfth_name", "bank_holder", "bonafide_name",
        F.when((F.size(names) > 1) & others_differ, "MISMATCH").otherwise("MATCH").alias("name_consistency"),
        "tenth_dob", "aadhaar_dob", F.when(F.coalesce(dob_differs, F.lit(False)), "MISMATCH").otherwise("MATCH").alias("dob_consistency"),
        c("gender").alias("profile_gender"), "aadhaar_gender", genders.alias("gender_consistency"),
        "tenth_year", "twelfth_year", later("scored"), later("percentage"), later("board"), later("register_number"),
        F.coalesce("doc_course", "course").alias("course"), F.coalesce("doc_institution", "institution").alias("institution"),
        c("community_name").alias("community"), c("community_category").alias("category"), "disability_percentage", "first_graduate",
        F.when(c("first_graduate_cert"), "certificate").otherwise("entered").alias("first_graduate_source"),
        expired("community_issue_date", 60).alias("community_expired"), months_old("community_issue_date").alias("community_months_old"),
        c("income_value").cast("bigint").alias("income_amount"), "income_year",
        F.when(c("income_applicant") == "parent", F.coalesce("parent_name", F.lit("Parent"))).otherwise(F.coalesce("student_name", F.lit("Student"))).alias("income_provider"),
        c("income_applicant").alias("income_provider_role"), c("income_name").alias("income_certificate_name"), "income_cert_number", "income_issue_date",
        expired("income_issue_date", 12).alias("income_expired"), months_old("income_issue_date").alias("income_months_old"),
        "ifsc", valid_ifsc(c("ifsc")).alias("ifsc_valid"), F.coalesce("account_type", F.lit("Savings")).alias("account_type"), "aadhaar_bank_linked",
        F.coalesce("state", "doc_state").alias("state"), F.coalesce("district", "doc_district").alias("district"), F.coalesce("domicile", "state").alias("domicile"),
    )
