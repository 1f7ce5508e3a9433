"""Identity resolution across the documents of a case.

Checks between slots (identity card, certificates, marksheets, passbook) take the first
document of each. The long document table is reduced to those slots by a partial
aggregation, so a case of any size travels as one row of at most six documents, and the
fifteen slot pairs are built inside that row. The cross-document status compares all
documents of any type: a case is reduced to its distinct names first, and every distinct
pair of names of the whole table is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grantlens.functions import dates as D, name_match as M
from grantlens.functions.banding import js_round
from grantlens.functions.categories import normalize_community
from grantlens.functions.money import parse_income
from grantlens.functions.names import name_tokens, real_name
from grantlens.session import stored

# Document slots in comparison order; strict slots are compared strictly.
SLOTS = ("identity", "community", "income", "ms10", "ms12", "bank")
STRICT_SLOTS = ("identity", "community", "income", "bank")
DATED_SLOTS = ("community", "income", "ms10", "ms12")
REFERENCE_SLOT = "identity"
# Points of the consistency score.
NAME_POINTS, NAME_POINTS_MINOR, DOB_POINTS, INCOME_POINTS, INCOME_POINTS_AGEING, COMMUNITY_POINTS, BANK_POINTS = 30, 20, 20, 20, 15, 15, 15
MINOR_STATUSES = ("MINOR_DIFFERENCE", "LIKELY_MATCH", "NEEDS_REVIEW")


def name_key(name: Column) -> Column:
    """Tokens of a usable name joined by single spaces, NULL otherwise."""
    joined = F.array_join(name_tokens(real_name(name)), " ")
    return F.when(joined != "", joined)


def case_slots(docs: DataFrame, fields: tuple[str, ...] = ("name", "dob"), key: str = "case_id") -> DataFrame:
    """One row per case with the first document of every slot, as columns `<field>_<slot>`."""
    firsts = [
        F.min_by(F.when(F.col("doc_type") == slot, F.col(f)), F.when((F.col("doc_type") == slot) & F.col(f).isNotNull(), F.col("ord"))).alias(f"{f}_{slot}")
        for slot in SLOTS for f in fields
    ]
    return docs.filter(F.col("doc_type").isin(*SLOTS)).groupBy(key).agg(*firsts)


def with_name_keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn("name_key", name_key(F.col("name")))


def slot_pairs(slots: DataFrame, value: str, key: str = "case_id", strict_by_slot: bool = True) -> DataFrame:
    """Pairs i<j of the slots that carry `value`, as (a_doc, b_doc, a_value, b_value, is_strict)."""
    pairs = []
    for i, a in enumerate(SLOTS):
        for b in SLOTS[i + 1:]:
            va, vb = F.col(f"{value}_{a}"), F.col(f"{value}_{b}")
            strict = strict_by_slot and (a in STRICT_SLOTS or b in STRICT_SLOTS)
            pairs.append(F.when(va.isNotNull() & vb.isNotNull(), F.struct(
                F.lit(a).alias("a_doc"), F.lit(b).alias("b_doc"), va.alias("a_value"), vb.alias("b_value"), F.lit(strict).alias("is_strict"))))
    others = [c for c in slots.columns if not c.startswith(f"{value}_")]
    return slots.select(*others, F.explode(F.array(*pairs)).alias("p")).filter("p is not null").select(*others, "p.*")


def compare_names(pairs: DataFrame) -> DataFrame:
    """N1 over (a_value, b_value, is_strict): status and score of every pair."""
    staged = pairs.withColumn("level", M.name_level(F.col("a_value"), F.col("b_value")))
    staged = staged.withColumn("similar", F.when(F.col("level") == 6, M.text_similarity(F.col("a_value"), F.col("b_value"))))
    level, similar, strict = F.col("level"), F.col("similar"), F.col("is_strict")
    return staged.withColumns({"status": M.name_status(level, similar, strict), "score": M.name_score(level, similar, strict)}).drop("level", "similar")


def pairwise_names(docs: DataFrame, key: str = "case_id") -> DataFrame:
    """J7 + N1: compared name pairs of every case."""
    slots = case_slots(with_name_keys(docs), ("name_key",), key)
    return compare_names(slot_pairs(slots, "name_key", key)).select(key, "a_doc", "b_doc", "is_strict", "status", "score")


def parent_income_override(pairs: DataFrame) -> DataFrame:
    """With a parent as income provider, pairs touching the income certificate are only reviewed."""
    touches = (F.col("a_doc") == "income") | (F.col("b_doc") == "income")
    by_parent = (F.col("income_applicant") == "parent") & touches
    return pairs.withColumns({
        "status": F.when(by_parent, "NEEDS_REVIEW").otherwise(F.col("status")),
        "parent_name_used": F.coalesce(by_parent, F.lit(False)),
    })


def parent_income_check(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Whose name the income certificate is checked against: (student_name_match, parent_name_used, match, score, consistent).

    A parent as provider is never held against the student; the first known of parent, father and mother is compared, leniently,
    with the holder of the income certificate. Without either name, match and score are NULL; a name without letters is MISSING.
    """
    filled = lambda column: F.nullif(F.trim(column), F.lit(""))
    by_parent = F.coalesce(F.col("income_applicant") == "parent", F.lit(False))
    named = cases.select(key, by_parent.alias("by_parent"), F.when(by_parent, F.coalesce(*[filled(c) for c in ("parent_name", "father_name", "mother_name")])).alias("parent"),
                         F.when(by_parent, filled("income_name")).alias("holder"))
    judged = compare_names(named.withColumns({"a_value": name_key(F.col("parent")), "b_value": name_key(F.col("holder")), "is_strict": F.lit(False)}))
    both = F.col("parent").isNotNull() & F.col("holder").isNotNull()
    return judged.select(
        key, F.when(F.col("by_parent"), "SKIPPED").otherwise("CHECKED").alias("student_name_match"), F.col("by_parent").alias("parent_name_used"),
        F.when(both, F.col("status")).alias("match"), F.when(both, F.col("score")).alias("score"),
        F.coalesce(both & F.col("status").isin("MATCH", "EXACT_MATCH"), F.lit(False)).alias("consistent"))


def compare_dob(a: Column, b: Column) -> Column:
    """N3."""
    da, db = D.parse_date(a), D.parse_date(b)
    return (
        F.when(F.coalesce(a, F.lit("")) == "", "MISSING").when(F.coalesce(b, F.lit("")) == "", "MISSING")
        .when(da.isNull() | db.isNull(), "UNREADABLE").when(da == db, "MATCH").otherwise("MISMATCH")
    )


def compare_to_reference(docs: DataFrame, key: str = "case_id") -> DataFrame:
    """Every dated slot against the identity card, in the same slot row; grey where that has no date."""
    slots = case_slots(docs, ("dob",), key)
    ref = F.col(f"dob_{REFERENCE_SLOT}")
    rows = [F.when(F.col(f"dob_{s}").isNotNull(), F.struct(F.lit(s).alias("doc_type"), F.col(f"dob_{s}").alias("dob"),
                                                          F.when(F.coalesce(F.trim(ref), F.lit("")) == "", "grey").otherwise(compare_dob(F.col(f"dob_{s}"), ref)).alias("status"))) for s in DATED_SLOTS]
    return slots.select(key, F.explode(F.array(*rows)).alias("r")).filter("r is not null").select(key, "r.*")


def _any(status: Column, wanted) -> Column:
    return F.coalesce(F.bool_or(status.isin(*wanted)), F.lit(False))


def name_consistency(docs: DataFrame, key: str = "case_id") -> DataFrame:
    """A5: grey with fewer than two names, red on a mismatch, yellow on a minor difference, else green."""
    pairs = pairwise_names(docs, key)
    verdict = pairs.groupBy(key).agg(_any(F.col("status"), ["MISMATCH"]).alias("bad"), _any(F.col("status"), MINOR_STATUSES).alias("minor"))
    named = name_key(F.col("name")).isNotNull() & F.col("doc_type").isin(*SLOTS)
    names = docs.groupBy(key).agg(F.count_distinct(F.when(named, F.col("doc_type"))).alias("n_names"))
    colour = F.when(F.col("n_names") < 2, "grey").when(F.col("bad"), "red").when(F.col("minor"), "yellow").otherwise("green")
    return names.join(verdict, key, "left").select(key, "n_names", colour.alias("name_status"))


def income_freshness(as_of: Column, issue: Column, valid_upto: Column) -> Column:
    """Expired / warning / valid / unknown from the stated end, else from the age in 30-day months."""
    end, issued = D.parse_date(valid_upto), D.parse_date(issue)
    left = D.months_between_days(end, as_of, D.DAYS_PER_MONTH_FRESHNESS)
    age = D.months_between_days(as_of, issued, D.DAYS_PER_MONTH_FRESHNESS)
    return (
        F.when(end < as_of, "expired").when(left < 1, "warning").when(end.isNotNull(), "valid")
        .when(age > 12, "expired").when(age > 6, "warning").when(issued.isNotNull(), "valid").otherwise("unknown")
    )


def certificate_expiry(as_of: Column, issue: Column, explicit_end: Column, max_months: int) -> Column:
    """EXPIRED / VALID from a stated end; else REQUIRES_REVIEW / VALID by age in 30.44-day months."""
    end, issued = D.parse_date(explicit_end), D.parse_date(issue)
    age = D.months_between_days(as_of, issued, D.DAYS_PER_MONTH_EXPIRY)
    return (
        F.when(as_of > end, "EXPIRED").when(end.isNotNull(), "VALID")
        .when(age > max_months, "REQUIRES_REVIEW").when(issued.isNotNull(), "VALID").otherwise("UNKNOWN")
    )


def compare_income(certificate: Column, stated: Column, freshness: Column) -> Column:
    """Exact equality of the parsed amounts."""
    c, s = parse_income(certificate), parse_income(stated)
    return (
        F.when(c.isNull() & s.isNull(), "MISSING").when(c.isNull() | s.isNull(), "WARNING")
        .when(c == s, F.when(freshness == "expired", "EXPIRED").otherwise("MATCH")).otherwise("MISMATCH")
    )


def compare_community(certificate: Column, stated: Column) -> Column:
    """N6."""
    c, s = normalize_community(certificate), normalize_community(stated)
    return (
        F.when(c.isNull() & s.isNull(), "MISSING").when(c.isNull() | s.isNull(), "WARNING")
        .when(c == s, "MATCH").otherwise("MISMATCH")
    )


def consistency_score(cases: DataFrame, docs: DataFrame, as_of: Column, key: str = "case_id") -> DataFrame:
    """Weighted agreement of names, birth dates, income, community and account type.

    `cases` carries income_certificate, income_stated, issue_date, valid_upto,
    community_certificate, community_stated, account_type and income_applicant.
    """
    slots = case_slots(with_name_keys(docs), ("name_key", "dob"), key)
    applicant = cases.select(key, "income_applicant")
    compared = compare_names(slot_pairs(slots.select(key, *[f"name_key_{s}" for s in SLOTS]), "name_key", key))
    pairs = parent_income_override(compared.join(applicant, key)).groupBy(key).agg(
        _any(F.col("status"), ["MISMATCH"]).alias("name_bad"), _any(F.col("status"), MINOR_STATUSES).alias("name_minor"))
    ref = F.col(f"dob_{REFERENCE_SLOT}")
    dob = F.array(*[compare_dob(F.col(f"dob_{s}"), ref) for s in DATED_SLOTS])
    n_names = sum((F.col(f"name_key_{s}").isNotNull().cast("int") for s in SLOTS), F.lit(0))
    base = slots.select(key, n_names.alias("n_names"), ref.isNotNull().alias("has_ref"), dob.alias("dob_results"))
    joined = cases.join(base, key, "left").join(pairs, key, "left")
    joined = joined.withColumn("freshness", income_freshness(as_of, F.col("issue_date"), F.col("valid_upto")))
    joined = joined.withColumns({
        "income_status": compare_income(F.col("income_certificate"), F.col("income_stated"), F.col("freshness")),
        "community_status": compare_community(F.col("community_certificate"), F.col("community_stated")),
        "name_status": F.when(F.coalesce("n_names", F.lit(0)) < 2, "grey").when(F.col("name_bad"), "red")
        .when(F.col("name_minor"), "yellow").otherwise("green"),
        "dob_status": F.when(~F.coalesce("has_ref", F.lit(False)), "grey").when(F.array_contains("dob_results", "MISMATCH"), "red")
        .when(F.array_contains("dob_results", "MATCH"), "green").otherwise("grey"),
    })
    income_ok = F.col("income_status") == "MATCH"
    points = (
        F.when(F.col("name_status") == "green", NAME_POINTS).when(F.col("name_status") == "yellow", NAME_POINTS_MINOR).otherwise(0)
        + F.when(F.col("dob_status") == "green", DOB_POINTS).otherwise(0)
        + F.when(income_ok & F.col("freshness").isin("valid", "unknown"), INCOME_POINTS)
        .when(income_ok & (F.col("freshness") == "warning"), INCOME_POINTS_AGEING).otherwise(0)
        + F.when(F.col("community_status") == "MATCH", COMMUNITY_POINTS).otherwise(0)
        + F.when(F.col("account_type") == "Single", BANK_POINTS).otherwise(0)
    )
    hard = (
        (F.col("name_status") == "red") | (F.col("dob_status") == "red") | F.coalesce(F.col("account_type") == "Joint", F.lit(False))
        | (F.col("income_status") == "EXPIRED") | (F.col("community_status") == "MISMATCH")
    )
    out = joined.withColumn("points", points)
    level = (
        F.when(hard, "Issues Found — Correction Required").when(F.col("points") >= 85, "High Consistency — Ready for Official Application")
        .when(F.col("points") >= 60, "Moderate Consistency — Review Warnings").otherwise("Needs Review")
    )
    return out.select(key, "name_status", "dob_status", "income_status", "community_status", "freshness", "points", level.alias("readiness"))


#: Distinct pairs of names that are sent to all tasks, instead of meeting the pairs of the cases by a shuffle.
BROADCAST_PAIRS = 100_000


def _judged(pairs: DataFrame) -> DataFrame:
    """Status of every distinct pair (a_value, b_value), compared leniently; each is judged once for the whole table."""
    tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    judged = compare_names(pairs.distinct().repartition(tasks).withColumn("is_strict", F.lit(False)))
    judged = stored(judged.select("a_value", "b_value", "status"), "judged-names")
    return F.broadcast(judged) if judged.count() <= BROADCAST_PAIRS else judged


def cross_document_status(docs: DataFrame, key: str = "case_id") -> DataFrame:
    """Overall, name, birth-date and parent status of every case, over all its documents; names compared leniently.

    Documents are read once: they become the distinct names of each case with what is counted of it. Every name
    then meets those seen before it in its case, the one seen first on the left; equal names agree anyway.
    """
    unreadable = ("null", "not_detected")
    readable = lambda c: F.when(~F.lower(F.trim(F.col(c))).isin(*unreadable) & (F.trim(F.col(c)) != ""), F.trim(F.col(c)))
    has_parent = "parent_name" in docs.columns
    keyed = docs.select(
        key, "ord", readable("name").alias("name"), F.when(F.trim("dob") != "", F.trim("dob")).alias("dob"),
        (readable("parent_name") if has_parent else F.lit(None).cast("string")).alias("parent_name"),
    ).filter("name is not null or dob is not null")
    # A name without letters is a name too, the empty one.
    letters = lambda c: F.when(F.col(c).isNotNull(), F.array_join(name_tokens(real_name(F.col(c))), " "))
    keyed = keyed.select(key, "ord", "dob", letters("name").alias("name"), letters("parent_name").alias("parent"), D.parse_date(F.col("dob")).alias("iso"))
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("name", "parent")])
    # Rows of kind `name` stand for all documents, also those without one.
    long = keyed.select(key, "ord", "dob", "iso", F.explode(kinds).alias("f")).select(key, "ord", "dob", "iso", "f.*").filter("kind = 'name' or value is not null")
    names = stored(long.groupBy(key, "kind", "value").agg(
        F.min("ord").alias("seen"), F.count(F.lit(1)).alias("n"), F.count("dob").alias("n_dobs"), F.min("iso").alias("first"), F.max("iso").alias("last")), "case-names")

    placed = F.when(F.col("seen").isNotNull() & F.col(key).isNotNull(), F.col("value"))
    before = Window.partitionBy(key, "kind").orderBy("seen", "value").rowsBetween(Window.unboundedPreceding, -1)
    met = names.withColumn("earlier", F.collect_list(placed).over(before))
    pairs = met.select("*", F.posexplode_outer(F.when(placed.isNotNull(), F.col("earlier"))).alias("at", "a_value")).drop("earlier").withColumnRenamed("value", "b_value")
    judged = _judged(pairs.filter("a_value is not null").select("a_value", "b_value"))
    pairs = pairs.join(judged, ["a_value", "b_value"], "left")

    # What belongs to a name counts on the first of its pairs.
    own = F.coalesce(F.col("at"), F.lit(0)) == 0
    total = lambda n, kind, named=F.lit(True): F.coalesce(F.sum(F.when(own & (F.col("kind") == kind) & named, F.col(n))), F.lit(0))
    any_of = lambda kind, wanted: F.coalesce(F.bool_or((F.col("kind") == kind) & F.col("status").isin(*wanted)), F.lit(False))
    out = pairs.groupBy(key).agg(
        total("n", "name").alias("n_docs"), total("n", "name", F.col("b_value").isNotNull()).alias("n_names"), total("n_dobs", "name").alias("n_dobs"),
        total("n", "parent").alias("n_parents"), (F.min("first") != F.max("last")).alias("dob_differs"),
        any_of("name", ["MISMATCH"]).alias("name_bad"), any_of("name", MINOR_STATUSES).alias("name_minor"),
        any_of("parent", ["MISMATCH"]).alias("parent_bad"), any_of("parent", MINOR_STATUSES).alias("parent_minor"))
    no = F.lit(False)
    out = out.withColumns({"dob_bad": F.coalesce("dob_differs", no), "enough": (F.col("n_docs") >= 2) & (F.col("n_names") >= 2)})
    out = out.withColumns({
        "bad": F.coalesce("name_bad", no) | F.col("dob_bad") | F.coalesce("parent_bad", no),
        "minor": F.coalesce("name_minor", no) | F.coalesce("parent_minor", no),
    })
    label = lambda bad, minor, enough: (
        F.when(~enough, "INSUFFICIENT DATA").when(bad, "SIGNIFICANT CONFLICT").when(minor, "MINOR DIFFERENCE").otherwise("CONSISTENT"))
    enough = F.col("enough")
    return out.select(
        key, F.col("n_docs").alias("document_count"),
        label(F.col("bad"), F.col("minor"), enough).alias("status"),
        label(F.col("bad"), F.col("minor"), enough).alias("name_status"),
        F.when(enough & F.col("dob_bad"), "SIGNIFICANT CONFLICT").when(enough & (F.col("n_dobs") >= 2), "CONSISTENT").otherwise("INSUFFICIENT DATA").alias("dob_status"),
        F.when(enough & F.coalesce("parent_bad", no), "SIGNIFICANT CONFLICT").when(enough & F.coalesce("parent_minor", no), "MINOR DIFFERENCE")
        .when(enough & (F.col("n_parents") >= 2), "CONSISTENT").otherwise("INSUFFICIENT DATA").alias("parent_status"),
    )


def stable_mode(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per group; the one seen first wins ties. Two partial aggregations, no window."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    best = counted.groupBy(*group).agg(F.max_by(F.struct(value, "n", "first_seen"), F.struct("n", -F.col("first_seen"))).alias("m"))
    return best.select(*group, "m.*")


def name_consensus(docs: DataFrame, key: str = "case_id") -> DataFrame:
    """The name most documents of a case agree on, with conflict and confidence.

    Documents shrink to one row per (case, letters of the name) first; those rows are then
    compared with the winning key through a join on the case.
    """
    confidence = F.coalesce(F.col("confidence").cast("double"), F.lit(80.0)) if "confidence" in docs.columns else F.lit(80.0)
    raw = F.trim(F.col("name"))
    members = docs.filter("name is not null").select(
        key, "ord", raw.alias("raw"), F.translate(raw, "0158", "OISB").alias("cleaned"), raw.rlike(r"\d").alias("digits"), confidence.alias("conf"))
    members = members.withColumn("k", F.regexp_replace(F.upper("cleaned"), "[^A-Z]", "")).filter(F.length("k") >= 3)
    keys = members.groupBy(key, "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.bool_or("digits").alias("any_digits"),
        F.min_by(F.when(~F.col("digits"), F.col("raw")), F.when(~F.col("digits"), F.col("ord"))).alias("clean_raw"),
        F.min_by("cleaned", "ord").alias("first_cleaned"), F.min_by("conf", "ord").alias("first_conf"), F.min_by("digits", "ord").alias("first_digits"))
    best = keys.groupBy(key).agg(
        F.max_by(F.struct("k", "n", "any_digits", "clean_raw", "first_cleaned", "first_conf", "first_digits"), F.struct("n", -F.col("first_ord"))).alias("b"),
        F.sum("n").alias("total_documents"))
    conflicts = keys.join(best.select(key, F.col("b.k").alias("best_k")), key).groupBy(key).agg(
        F.bool_or((F.col("k") != F.col("best_k")) & (F.levenshtein("k", "best_k") > 2)).alias("has_conflict"))
    n, conflict = F.col("b.n"), F.col("has_conflict")
    return best.join(conflicts, key).select(
        key, F.coalesce("b.clean_raw", "b.first_cleaned").alias("consensus_name"),
        F.when(conflict, "NEEDS_REVIEW").when(n >= 2, F.when(F.col("b.any_digits"), "NEEDS_REVIEW").otherwise("HIGH_CONFIDENCE"))
        .when(F.col("b.first_digits"), "NEEDS_REVIEW").otherwise("HIGH_CONFIDENCE").alias("status"),
        F.when(conflict, 60).when(n >= 2, F.least(F.lit(98), 85 + 4 * n)).when(F.col("b.first_digits"), 68)
        .otherwise(js_round(F.col("b.first_conf"))).cast("int").alias("confidence"),
        n.alias("agreements"), "total_documents", conflict.alias("has_conflict"))


def reconcile_passes(passes: DataFrame, key: str = "doc_id") -> DataFrame:
    """One record per document from several extraction passes.

    Name: highest confidence plus 0.20 when at least two passes agree; marks and school:
    highest confidence; other fields: first pass that has them.
    """
    named = passes.filter("name is not null").withColumn("k", F.regexp_replace(F.lower("name"), "[^a-z]", ""))
    per_key = named.groupBy(key, "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("name", "name_conf", "pass_no"), F.struct("name_conf", -F.col("pass_no"))).alias("c"))
    total = F.round(F.col("c.name_conf") + F.when(F.col("n") >= 2, 0.20).otherwise(0.0), 6)
    names = per_key.groupBy(key).agg(F.max_by(F.struct(F.col("c.name").alias("name"), total.alias("total")), F.struct(total, -F.col("c.pass_no"))).alias("b"))

    def best(value: str, conf: str) -> Column:
        return F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(F.coalesce(conf, F.lit(0.0)), -F.col("pass_no"))))

    def first(value: str) -> Column:
        return F.min_by(value, F.when(F.col(value).isNotNull(), F.col("pass_no"))).alias(value)

    rest = passes.groupBy(key).agg(best("marks", "marks_conf").alias("marks"), best("school", "school_conf").alias("school"),
                                   first("dob"), first("register_number"), F.count(F.lit(1)).alias("n_passes"))
    return rest.join(names, key, "left").select(
        key, "n_passes", F.col("b.name").alias("name"), F.least(F.lit(0.98), F.round("b.total", 2)).alias("name_confidence"),
        "marks", "school", "dob", "register_number")


def pass_consensus(passes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A10: the stricter policy: several passes that all disagree yield no name at all."""
    named = passes.filter("name is not null").withColumn("k", F.regexp_replace(F.upper("name"), "[^A-Z0-9]", ""))
    per_key = named.groupBy(key, "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("pass_no").alias("first_pass"), F.max("engine_conf").alias("top"),
        F.max_by("name", F.struct("engine_conf", -F.col("pass_no"))).alias("name"))
    best = per_key.groupBy(key).agg(F.max_by(F.struct("n", "top", "name"), F.struct("n", -F.col("first_pass"))).alias("b"), F.sum("n").alias("n_candidates"))
    joined = passes.select(key).distinct().join(best, key, "left")
    n, top = F.col("b.n"), F.col("b.top")
    diverged = (F.col("n_candidates") >= 2) & (n == 1)
    accepted = ~diverged & ((n >= 2) | (top >= 75))
    return joined.select(
        key, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(accepted, F.col("b.name")).alias("name"),
        F.when(F.coalesce(~accepted, F.lit(True)), "NOT_DETECTED").when(top >= 75, "HIGH_CONFIDENCE").otherwise("NEEDS_REVIEW").alias("status"))
