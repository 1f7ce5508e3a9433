"""Three-valued eligibility of every applicant for every scheme.

The catalogue is a bounded constant. It enters the plan as one folded array
literal, so every (applicant, scheme) pair is produced and judged inside the scan
stage: there is no join. Ranking judges the schemes as one array per applicant and
sorts that small array, so even the top-k per applicant needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from grantlens.functions.categories import community_accepted
from grantlens.functions.money import inr
from grantlens.functions.text import fill, present
from grantlens.rules import criteria as R
from grantlens.rules.relations import literal_array
from grantlens.rules.schemes import NO_LIMIT, catalogue_a

Field = Callable[[str], Column]

CRITERIA = tuple(R.LABELS)
SCHEME_TYPES = {
    "ord": "int", "id": "string", "name": "string", "category": "string", "state": "string", "district": "string",
    "course": "string", "gender": "string", "income_limit": "bigint", **{f"tests_{c}": "boolean" for c in CRITERIA},
}
# Outcome codes: their sum over the criteria tells failures (hundreds) from gaps (units).
PASSED, MISSING, FAILED = 0, 1, 100
OUTCOME_NAMES = {MISSING: "NEEDS_INFO", FAILED: "FAILED", PASSED: "PASSED"}
FLAG_FIELDS = {"disability": "disabled", "govt_school": "govt_school", "agri_labor": "agri_labor",
               "armed_forces": "armed_forces", "first_graduate": "first_graduate"}


def prepare_schemes(rows: list[dict] | None = None) -> list[dict]:
    """Catalogue rows with one flag per criterion telling whether the scheme tests it."""
    rows = catalogue_a() if rows is None else rows
    out = []
    for row in rows:
        tests = {c: row.get(c) not in (None, "", "All") for c in ("gender", "district", "course")}
        tests["category"] = row.get("category") not in (None, "", "All", "all")
        tests["state"] = row.get("state") not in (None, "", *R.NATIONWIDE)
        tests["income"] = row.get("income_limit") not in (None, NO_LIMIT)
        tests["quota"] = bool(row.get("requires_govt_quota"))
        tests.update({c: bool(row.get(f"requires_{c}")) for c in FLAG_FIELDS})
        out.append({**row, **{f"tests_{c}": t for c, t in tests.items()}})
    return out


def profile_fields(df: DataFrame) -> Field:
    """Access to profile columns; a column the caller does not have is unanswered."""
    def get(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        kind = {"income": "bigint", "disability_percent": "int"}.get(name)
        return F.lit(None).cast(kind or ("boolean" if name in FLAG_FIELDS.values() else "string"))
    return get


def _outcome(unknown: Column, failed: Column) -> Column:
    return F.when(unknown, MISSING).when(failed, FAILED).otherwise(PASSED)


def _student_category(p: Field) -> Column:
    return F.coalesce(F.when(p("category") != "", p("category")), F.when(p("community") != "", p("community")))


def judge(name: str, p: Field, s: Field) -> Column:
    """Outcome code of one criterion, for a scheme that tests it. Unknown is never a failure."""
    if name == "income":
        return _outcome(p("income").isNull(), p("income") > s("income_limit"))
    if name == "category":
        given = _student_category(p)
        return _outcome(given.isNull(), ~community_accepted(s("category"), given))
    if name == "gender":
        return _outcome(~present(p("gender")) | (p("gender") == "All"), p("gender") != s("gender"))
    if name == "state":
        return _outcome(~present(p("state")), F.lower(p("state")) != F.lower(s("state")))
    if name in ("district", "course"):
        return _outcome(~present(p(name)) | (p(name) == "All"), F.lower(p(name)) != F.lower(s(name)))
    if name == "agri_labor":
        return _outcome(p("agri_labor").isNull() & p("parent_occupation").isNull(), ~p("agri_labor"))
    if name == "quota":
        quota = F.lower(F.coalesce(F.when(p("quota_type") != "", p("quota_type")), F.lit("unknown")))
        reserved = F.upper(_student_category(p)).isin(*R.RESERVED_COMMUNITIES)
        return F.when(reserved, _outcome(quota == "unknown", quota == "management"))
    return _outcome(p(FLAG_FIELDS[name]).isNull(), ~p(FLAG_FIELDS[name]))


def tally_of(p: Field, s: Field) -> Column:
    total = F.lit(0)
    for c in CRITERIA:
        total = total + F.when(s(f"tests_{c}"), F.coalesce(judge(c, p, s), F.lit(0))).otherwise(0)
    return total


def rank_of(tally: Column, p: Field, s: Field) -> Column:
    """Status as a rank. Any failure rules out; a gap holds back, except for two disability schemes."""
    course_fits = ~present(p("course")) | p("course").isin(*R.POTENTIAL_COURSES)
    likely = ((s("id") == R.POTENTIAL_SCHEME_WITH_COURSE) & course_fits) | (s("id") == R.POTENTIAL_SCHEME)
    return (
        F.when(tally >= FAILED, R.STATUS_RANK[R.NOT_MATCHED])
        .when(tally == 0, R.STATUS_RANK[R.CONFIRMED])
        .when(p("disabled") & likely, R.STATUS_RANK[R.POTENTIAL])
        .otherwise(R.STATUS_RANK[R.NEEDS_INFORMATION])
    )


def _score(rank: Column, p: Field, s: Field) -> Column:
    earn = lambda test, points: F.when(test, points).otherwise(0)
    aligned = lambda name, given: (s(name) != "All") & (F.lower(s(name)) == F.lower(given))
    low_income = (p("income") != 0) & (s("income_limit") != NO_LIMIT) & (p("income") / s("income_limit") < R.LOW_INCOME_RATIO)
    confirmed = (
        F.lit(R.BASE_SCORE)
        + earn(aligned("category", _student_category(p)), R.CATEGORY_POINTS)
        + earn(aligned("course", p("course")), R.COURSE_POINTS)
        + earn(aligned("district", p("district")), R.DISTRICT_POINTS)
        + earn(low_income, R.LOW_INCOME_POINTS)
    )
    return (
        F.when(rank == R.STATUS_RANK[R.CONFIRMED], F.least(confirmed, F.lit(100)))
        .when(rank == R.STATUS_RANK[R.POTENTIAL], R.POTENTIAL_SCORE)
        .otherwise(0)
    )


def status_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in sorted(R.STATUS_RANK, key=R.STATUS_RANK.get)]), rank + 1)


def _scheme_field(name: str) -> Column:
    return F.col("scheme").getField(name)


def _catalogue(schemes: list[dict] | None) -> Column:
    return F.expr(literal_array(prepare_schemes(schemes), SCHEME_TYPES))


def judged_pairs(profiles: DataFrame, schemes: list[dict] | None = None) -> DataFrame:
    """Every profile with every scheme and one outcome code per criterion, NULL where not tested."""
    pairs = profiles.withColumn("scheme", F.explode(_catalogue(schemes)))
    p = profile_fields(pairs)
    return pairs.withColumns({f"o_{c}": F.when(_scheme_field(f"tests_{c}"), judge(c, p, _scheme_field)) for c in CRITERIA})


def scored_pairs(profiles: DataFrame, schemes: list[dict] | None = None) -> DataFrame:
    pairs = judged_pairs(profiles, schemes)
    p = profile_fields(pairs)
    pairs = pairs.withColumn("tally", sum((F.coalesce(f"o_{c}", F.lit(0)) for c in CRITERIA), F.lit(0)))
    pairs = pairs.withColumn("rank", rank_of(F.col("tally"), p, _scheme_field))
    return pairs.withColumn("score", _score(F.col("rank"), p, _scheme_field).cast("int"))


def evaluate_eligibility(profiles: DataFrame, schemes: list[dict] | None = None, key: str = "applicant_id") -> DataFrame:
    """One row per (applicant, scheme, criterion) that the scheme tests."""
    # Grouped once per applicant, not once per scheme and again for both forms of the income criterion.
    income = F.coalesce(F.concat(F.lit("₹"), inr(profile_fields(profiles)("income")), F.lit("/year")), F.lit("Not Provided"))
    pairs = judged_pairs(profiles.withColumn("income_shown", income), schemes)
    p, s = profile_fields(pairs), _scheme_field
    limit_text = F.concat(F.lit("≤ ₹"), inr(s("income_limit")), F.lit("/year"))
    shown = lambda c: F.coalesce(p(c).cast("string"), F.lit("Not Provided"))
    required = {
        "gender": F.when(s("gender") == "Girls", "Female Only").otherwise("Male Only"), "income": limit_text,
        "category": s("category"), "state": s("state"), "district": s("district"), "course": s("course"),
    }
    actual = {
        "gender": shown("gender"), "state": shown("state"), "district": shown("district"), "course": shown("course"),
        "income": F.col("income_shown"),
        "category": F.coalesce(_student_category(p), F.lit("Not Provided")),
        "disability": shown("disabled"), "govt_school": shown("govt_school"), "agri_labor": shown("agri_labor"),
        "armed_forces": shown("armed_forces"), "first_graduate": shown("first_graduate"), "quota": shown("quota_type"),
    }
    always = {"income": "No Income Limit", "state": "Pan-India / Central"}
    items = []
    for i, name in enumerate(CRITERIA, start=1):
        code = F.col(f"o_{name}")
        outcome = F.when(code == MISSING, "NEEDS_INFO").when(code == FAILED, "FAILED").otherwise("PASSED")

        def item(status, hard, wanted):
            return F.struct(
                F.lit(i).alias("criterion_no"), F.lit(R.LABELS[name][0]).alias("criterion"), status.alias("status"),  # noqa: B023
                F.lit(hard).alias("is_hard"), wanted.cast("string").alias("required"), actual[name].alias("actual"),  # noqa: B023
            )
        row = F.when(code.isNotNull(), item(outcome, True, required.get(name, F.lit(R.LABELS[name][0]))))
        if name in always:
            row = row.otherwise(item(F.lit("PASSED"), False, F.lit(always[name])))
        items.append(row)
    return (
        pairs.select(key, s("ord").alias("scheme_ord"), s("id").alias("scheme_id"), F.explode(F.array(*items)).alias("c"))
        .filter(F.col("c").isNotNull())
        .select(key, "scheme_ord", "scheme_id", "c.*")
    )


def _label(name: str, kind: int, p: Field, s: Field) -> Column:
    template = R.LABELS[name][kind]
    if name == "income":
        return fill(template, inr(s("income_limit")))
    if name == "category" and kind == 3:
        return fill(template, _student_category(p))
    if name == "disability" and kind == 2:
        return F.when(p("disability_percent") < R.BENCHMARK_DISABILITY, fill(R.UNDER_BENCHMARK, p("disability_percent"))).otherwise(template)
    return fill(template, s(name)) if "{}" in template else F.lit(template)


def eligibility_status(profiles: DataFrame, schemes: list[dict] | None = None, key: str = "applicant_id") -> DataFrame:
    """A1: one row per (applicant, scheme) with status, score and the ordered criterion lists."""
    pairs = scored_pairs(profiles, schemes)
    p, s = profile_fields(pairs), _scheme_field

    def collect(kind: int, outcome: int) -> Column:
        parts = []
        for name in CRITERIA:
            hit = F.when(F.col(f"o_{name}") == outcome, _label(name, kind, p, s))
            if outcome == PASSED and name in R.OPEN_LABELS:
                hit = hit.when(F.col(f"o_{name}").isNull(), F.lit(R.OPEN_LABELS[name]))
            parts.append(hit)
        return F.array_compact(F.array(*parts))

    out = pairs.select(
        key, s("ord").alias("scheme_ord"), s("id").alias("scheme_id"), s("name").alias("scheme_name"),
        status_name(F.col("rank")).alias("status"), "score",
        collect(3, PASSED).alias("passed"), collect(2, FAILED).alias("failed"), collect(1, MISSING).alias("missing"),
        F.coalesce(p("quota_type"), F.lit("unknown")).alias("quota_type"),
    )
    joined = lambda c, sep: F.array_join(c, sep)
    summary = (
        F.when(F.col("status") == R.NOT_MATCHED, F.concat(F.lit("Ineligible: "), joined("failed", "; "), F.lit(".")))
        .when(F.col("status") == R.POTENTIAL,
              F.concat(F.lit("Potential match: Primary criteria satisfied. Confirmation requires: "), joined("missing", ", "), F.lit(".")))
        .when(F.col("status") == R.NEEDS_INFORMATION, F.concat(F.lit("Needs more information: "), joined("missing", ", "), F.lit(".")))
        .otherwise(F.concat(F.lit("Meets all mandatory criteria for "), F.col("scheme_name"), F.lit(". Eligibility score: "),
                            F.col("score").cast("string"), F.lit("%.")))
    )
    return out.withColumn("is_eligible", F.col("status") == R.CONFIRMED).withColumn("summary", summary)


def _ranked_array(profiles: DataFrame, schemes: list[dict] | None) -> Column:
    """All results of one applicant as an array sorted by status, score and catalogue order."""
    p = profile_fields(profiles)
    of = lambda r: (lambda name: r.getField("s").getField(name))
    tallied = F.transform(_catalogue(schemes), lambda s: F.struct(s.alias("s"), tally_of(p, s.getField).alias("tally")))
    ranked = F.transform(tallied, lambda r: F.struct(r.getField("s").alias("s"), rank_of(r.getField("tally"), p, of(r)).alias("rank")))
    return F.sort_array(F.transform(ranked, lambda r: F.struct(
        (-r.getField("rank")).alias("rank_key"), (-_score(r.getField("rank"), p, of(r)).cast("int")).alias("score_key"),
        of(r)("ord").alias("scheme_ord"), of(r)("id").alias("scheme_id"))))


def rank_schemes(
    profiles: DataFrame, schemes: list[dict] | None = None, key: str = "applicant_id",
    only_eligible: bool = False, top_k: int | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Schemes of each applicant by status, score and catalogue order."""
    ranked = _ranked_array(profiles, schemes)
    if only_eligible:
        ranked = F.filter(ranked, lambda r: r.getField("rank_key") == -R.STATUS_RANK[R.CONFIRMED])
    if top_k is not None:
        ranked = F.slice(ranked, 1, top_k)
    # From posexplode() Spark infers a filter that judges all schemes again; from the outer form it infers none.
    return profiles.select(key, *keep, F.posexplode_outer(ranked).alias("pos", "r")).filter(F.col("r").isNotNull()).select(
        key, *keep, (F.col("pos") + 1).alias("position"), "r.scheme_ord", "r.scheme_id",
        status_name(-F.col("r.rank_key")).alias("status"), (-F.col("r.score_key")).alias("score"))


def top_k_per_status(profiles: DataFrame, limits: dict[str, int], key: str = "applicant_id",
                     schemes: list[dict] | None = None) -> DataFrame:
    """The first k schemes of each listed status, with the number left out."""
    def cut(status: str, k: int) -> Column:
        hits = F.filter("results", lambda r: r.getField("rank_key") == -R.STATUS_RANK[status])
        return F.transform(F.slice(hits, 1, k), lambda r, i: F.struct(
            F.lit(status).alias("status"), (i + 1).alias("position"), r.getField("scheme_id").alias("scheme_id"),
            (-r.getField("score_key")).alias("score"), F.greatest(F.size(hits) - k, F.lit(0)).alias("more")))

    lists = F.concat(*[cut(status, k) for status, k in limits.items()])
    ranked = profiles.select(key, _ranked_array(profiles, schemes).alias("results"))
    return ranked.select(key, F.explode(lists).alias("t")).select(key, "t.*")


def with_key_documents(matches: DataFrame, catalogue: DataFrame, k: int = 3) -> DataFrame:
    """Every match with the first k documents that its scheme asks for and the number left out; a scheme without a list asks for none."""
    asked = catalogue.select(F.col("id").alias("scheme_id"), F.coalesce("documents", F.array().cast("array<string>")).alias("asked"))
    joined = matches.join(asked, "scheme_id", "left").withColumn("n_asked", F.coalesce(F.size("asked"), F.lit(0)))
    return joined.select(*matches.columns, F.coalesce(F.array_join(F.slice("asked", 1, k), ", "), F.lit("")).alias("documents"), F.greatest(F.col("n_asked") - k, F.lit(0)).alias("more_documents"))
