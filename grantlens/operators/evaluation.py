"""Measuring extraction against known truth.

Status and confidence come from the extraction alone; the truth only scores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grantlens.functions import name_match as M
from grantlens.functions.banding import EVALUATION_BANDS, band
from grantlens.functions.dates import dashed_date
from grantlens.functions.text import alnum_upper, words
from grantlens.session import durable

NAME_FIELDS, DATE_FIELDS = ("studentName", "parentName"), ("dateOfBirth", "issueDate")
PERCENT_TOLERANCE = 1.5
SPLITS = ((0.70, "train"), (0.85, "validation"), (None, "test"))
# Augmentation kinds of a base certificate.
VARIANTS = ("clean", "grayscale", "blurred", "low_resolution", "low_contrast", "brightness", "shadow", "noise", "compression", "rotated", "skew",
            "perspective", "faint_text", "uneven_background")


def unpivot_fields(df: DataFrame, fields: tuple[str, ...], keys: list[str]) -> DataFrame:
    """(keys, field, truth, predicted) rows from `t_<field>` and `p_<field>` columns."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").cast("string").alias("truth"), F.col(f"p_{f}").cast("string").alias("predicted")) for f in fields])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def field_correct(field: Column, predicted: Column, truth: Column, lenient: bool = False) -> Column:
    """Whether a value counts as right; `lenient` also accepts one value containing the other."""
    a, b = alnum_upper(predicted), alnum_upper(truth)
    number = lambda x: F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    plain = (a == b) | (a.contains(b) | b.contains(a)) if lenient else a == b
    return F.coalesce(
        F.when(field.isin(*NAME_FIELDS), M.evaluation_match(predicted, truth).isin("EXACT_MATCH", "MINOR_DIFFERENCE"))
        .when(field.isin(*DATE_FIELDS), dashed_date(predicted) == dashed_date(truth))
        .when(field == "percentage", F.abs(number(predicted) - number(truth)) <= PERCENT_TOLERANCE).otherwise(plain), F.lit(False))


def field_metrics(long: DataFrame, lenient: bool = False) -> DataFrame:
    """Counts and rates per field; fields a layout does not print are not evaluated."""
    unprinted = ((F.col("field") == "issueDate") & F.col("document_type").contains("marksheet")) | (
        (F.col("field") == "parentName") & (F.col("document_type") == "10th_marksheet") & (F.col("cohort_id") != "CBSE_VALIDATION"))
    known, found = F.trim(F.coalesce("truth", F.lit(""))) != "", F.coalesce("predicted", F.lit("")) != ""
    right = field_correct(F.col("field"), F.col("predicted"), F.col("truth"), lenient)
    n = lambda test: F.count(F.when(test, 1))
    out = long.filter(known & ~unprinted).withColumn("right", found & right).groupBy("field").agg(
        F.count(F.lit(1)).alias("evaluated"), n(F.col("right")).alias("correct"), n(found & ~F.col("right")).alias("incorrect"), n(~found).alias("not_detected"),
        n(found & ((F.col("status") == "NEEDS_REVIEW") | (F.col("confidence") < 70))).alias("needs_review"))
    rate = lambda a, b: F.round(F.when(b > 0, a * 100.0 / b), 2)
    return out.select("*", rate(F.col("correct"), F.col("evaluated")).alias("accuracy"), rate(F.col("correct"), F.col("correct") + F.col("incorrect")).alias("precision"))


def word_edits(a: Column, b: Column) -> Column:
    """Edit distance over words: every distinct word of the pair becomes one character, surrogates being stepped over."""
    vocabulary = F.array_distinct(F.concat(a, b))

    def character(word: Column) -> Column:
        point = F.array_position(vocabulary, word) + F.lit(19968)
        point = point + F.when(point >= 0xD800, 0x800).otherwise(0)
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    coded = lambda ws: F.array_join(F.transform(ws, character), "")
    return F.levenshtein(coded(a), coded(b))


def error_rates(results: DataFrame, by: list[str]) -> DataFrame:
    """Exact and normalised accuracy, character and word error rates of names."""
    got, want = F.coalesce("predicted", F.lit("")), F.coalesce("truth", F.lit(""))
    gw, ww = words(F.upper(got)), words(F.upper(want))
    rows = results.select(
        *by, (F.upper(F.trim(got)) == F.upper(F.trim(want))).cast("int").alias("exact"), (alnum_upper(got) == alnum_upper(want)).cast("int").alias("norm"),
        F.levenshtein(F.upper(got), F.upper(want)).alias("edits"), F.greatest(F.length(want), F.lit(1)).alias("chars"),
        word_edits(gw, ww).alias("w_edits"), F.greatest(F.size(ww), F.lit(1)).alias("n_words"))
    pct = lambda a, b: F.round(F.sum(a) * 100.0 / F.sum(b), 2)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg("exact") * 100, 2).alias("exact_accuracy"), F.round(F.avg("norm") * 100, 2).alias("normalised_accuracy"),
        pct("edits", "chars").alias("cer"), pct("w_edits", "n_words").alias("wer"))


def calibration_table(results: DataFrame) -> DataFrame:
    """Right and wrong names by confidence band; any wrong one in the top band is a violation."""
    right = (alnum_upper(F.col("predicted")) == alnum_upper(F.col("truth"))) & (F.col("predicted") != "")
    rows = results.select(band(F.coalesce("confidence", F.lit(0)), EVALUATION_BANDS).alias("band"), F.coalesce(right, F.lit(False)).alias("right"))
    out = rows.groupBy("band").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("right"), 1)).alias("correct"))
    wrong = F.col("total") - F.col("correct")
    return out.select("band", "total", "correct", wrong.alias("wrong"), F.when((F.col("band") == "90-100") & (wrong > 0), "CALIBRATION VIOLATION").otherwise("SAFE").alias("invariant"))


def first_clean_scans(results: DataFrame) -> DataFrame:
    """The first clean scan of every (cohort, document type), by manifest order."""
    clean = results.filter("degradation = 'clean_scan'")
    picked = clean.groupBy("cohort_id", "document_type").agg(F.min_by(F.struct("manifest_ord", "predicted", "p_dob"), "manifest_ord").alias("m"))
    return picked.select("cohort_id", "document_type", "m.*")


def cohort_check(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Consistency of each cohort's first clean scans, compared with what is expected of it.

    A cohort keeps one scan per document type, so its name pairs are few; they come from an
    equi-join on the cohort.
    """
    scans = first_clean_scans(results)
    named = scans.filter(F.coalesce("predicted", F.lit("")) != "")
    a, b = named.alias("a"), named.alias("b")
    pairs = a.join(b, (F.col("a.cohort_id") == F.col("b.cohort_id")) & (F.col("a.document_type") < F.col("b.document_type"))).select(
        F.col("a.cohort_id").alias("cohort_id"), M.evaluation_match(F.col("a.predicted"), F.col("b.predicted")).alias("status"))
    verdict = pairs.groupBy("cohort_id").agg(F.bool_or(F.col("status") == "MISMATCH").alias("bad"), F.bool_or(F.col("status").isin("MINOR_DIFFERENCE", "NEEDS_REVIEW")).alias("minor"))
    facts = scans.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("predicted") != "", 1)).alias("n_names"), (F.min("p_dob") != F.max("p_dob")).alias("dob_differs"))
    joined = expected.join(facts, "cohort_id", "left").join(verdict, "cohort_id", "left")
    no = F.lit(False)
    status = (
        F.when((F.coalesce("n", F.lit(0)) < 2) | (F.coalesce("n_names", F.lit(0)) < 2), "INSUFFICIENT DATA")
        .when(F.coalesce("bad", no) | F.coalesce("dob_differs", no), "SIGNIFICANT CONFLICT").when(F.coalesce("minor", no), "MINOR DIFFERENCE").otherwise("CONSISTENT"))
    return joined.select("cohort_id", "expected", status.alias("actual")).withColumn("passed", F.col("actual") == F.replace("expected", F.lit("_"), F.lit(" ")))


def status_counts(results: DataFrame, by: list[str]) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    return results.groupBy(*by).agg(n("NOT_DETECTED"), n("NEEDS_REVIEW"), n("HIGH_CONFIDENCE"))


def run_delta(baseline: DataFrame, improved: DataFrame, by: list[str]) -> DataFrame:
    """Status counts of two runs and their difference."""
    names = ("not_detected", "needs_review", "high_confidence")
    a = status_counts(baseline, by).select(*by, *[F.col(n).alias(f"{n}_before") for n in names])
    b = status_counts(improved, by).select(*by, *[F.col(n).alias(f"{n}_after") for n in names])
    joined = a.join(b, by, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(*by, *[x for n in names for x in (zero(f"{n}_before").alias(f"{n}_before"), zero(f"{n}_after").alias(f"{n}_after"),
                                                          (zero(f"{n}_after") - zero(f"{n}_before")).alias(f"{n}_change"))])


def lookup_fixtures(fixtures: DataFrame, results: DataFrame) -> DataFrame:
    """Known failures joined to the first result of their image: recovered or still missing."""
    first = results.groupBy("image_path").agg(F.min_by(F.struct("predicted", "status"), "manifest_ord").alias("r"))
    joined = fixtures.join(first, "image_path", "left")
    recovered = alnum_upper(F.coalesce("r.predicted", F.lit("NOT_DETECTED"))) == alnum_upper(F.col("truth"))
    return joined.select("fixture_id", "image_path", "truth", F.col("r.predicted").alias("actual"), F.coalesce("r.status", F.lit("NOT_DETECTED")).alias("status"),
                         F.when(recovered, "RECOVERED").otherwise("MISSING").alias("outcome"))


def global_ordinal(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """0-based rank of every row by a unique key, without a single-task sort.

    Rows are range-partitioned and numbered inside their partition; only one count per
    partition is summed up to turn that into a global rank.
    """
    placed = df.repartitionByRange(key).sortWithinPartitions(key).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    placed = durable(placed.withColumn("_local", F.col("_id") - F.shiftleft(F.col("_part").cast("bigint"), 33)).drop("_id"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    return placed.join(before, "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def assign_split(df: DataFrame, key: str) -> DataFrame:
    """Train / validation / test by ordinal ratio."""
    ranked = global_ordinal(df, key)
    ratio = F.col("ordinal") / F.greatest(F.col("_total"), F.lit(1))
    out = None
    for bound, name in SPLITS:
        out = out.otherwise(name) if bound is None else (F.when(ratio < bound, name) if out is None else out.when(ratio < bound, name))
    return ranked.withColumn("split", out).drop("_total")


def expand_variants(df: DataFrame) -> DataFrame:
    """Every base record with each augmentation kind."""
    return df.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))


def compare_institutions(df: DataFrame, a: str, b: str) -> DataFrame:
    """N8."""
    staged = df.withColumns({"norm_a": M.normalize_institution(F.col(a)), "norm_b": M.normalize_institution(F.col(b))})
    staged = staged.withColumn("overlap", M.institution_overlap(F.col("norm_a"), F.col("norm_b")))
    return staged.withColumns({"status": M.institution_status(F.col("overlap")), "score": F.round(F.coalesce("overlap", F.lit(0.0)), 2)}).drop("overlap", "norm_a", "norm_b")
