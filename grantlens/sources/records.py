"""Manifests, results, metadata folders, intake records and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"
TRUTH_FIELDS = ("studentName", "dateOfBirth", "parentName", "community", "category", "annualIncome", "certificateNumber", "registrationNumber", "schoolName",
                "board", "passingYear", "marks", "percentage", "issueDate", "validity", "issuingAuthority")
MANIFEST_SCHEMA = StructType([
    *[StructField(c, StringType()) for c in ("id", "image_filename", "image_path", "cohort_id", "document_type", "degradation", "expected_cross_status")],
    StructField("ground_truth", StructType([StructField(f, StringType()) for f in TRUTH_FIELDS])),
])
MAX_UPLOAD_BYTES, MAX_PDF_PAGES = 15 * 1024 * 1024, 3
UPLOAD_TYPES = ("image/jpeg", "image/png", "image/webp", "image/bmp", "image/gif", "application/pdf")
UPLOAD_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "pdf")
# Intake limits.
INTAKE_FIELDS = ("name", "email", "issue_type", "message", "comment", "rating", "captcha_token")
INTAKE_LIMITS = {"name": 100, "email": 254, "issue_type": 100, "message": 4000, "comment": 4000}
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
TOKEN_LENGTH = (20, 4096)


def _with_corrupt(schema: StructType) -> StructType:
    return schema if CORRUPT in schema.names else StructType([*schema.fields, StructField(CORRUPT, StringType())])


def read_manifest(spark: SparkSession, path: str, schema: StructType = MANIFEST_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line is kept in `_corrupt_record`."""
    return spark.read.schema(_with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines)."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def parse_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same reading for JSON that arrives in a column."""
    parsed = F.from_json(F.col(column), f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return df.withColumn("parsed", parsed)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("errorifexists").json(path)


def read_metadata_dir(spark: SparkSession, path: str, schema: StructType = MANIFEST_SCHEMA) -> DataFrame:
    """S3: one JSON object per file, with the file it came from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())


def dedup_latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of every key by `order`, as a partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def reject_reason(df: DataFrame) -> Column:
    """The first intake rule a record breaks, NULL when it is valid."""
    c = lambda name: F.coalesce(F.col(name), F.lit("" if name != "rating" else 0.0))
    out = F.when(F.size("extra_keys") > 0, "unknown_field") if "extra_keys" in df.columns else F.when(F.lit(False), "unknown_field")
    for name, limit in INTAKE_LIMITS.items():
        out = out.when(F.length(c(name)) > limit, f"{name}_too_long")
        if name == "email":
            out = out.when((c(name) != "") & ~c(name).rlike(EMAIL), "email_invalid")
    rating = c("rating").cast("double")
    out = out.when(F.isnan(rating) | (rating < 0) | (rating > 5), "rating_out_of_range")
    out = out.when(~F.length(c("captcha_token")).between(*TOKEN_LENGTH), "token_invalid")
    blank = F.lit(True)
    for name in INTAKE_LIMITS:
        blank = blank & (F.trim(c(name)) == "")
    return out.when(blank & (rating == 0), "empty")


def judge_intake(df: DataFrame) -> DataFrame:
    """Records with `reject_reason`; texts of valid ones are trimmed. Works on streams too."""
    judged = df.withColumn("reject_reason", reject_reason(df))
    tidy = {n: F.when(F.col("reject_reason").isNull(), F.trim(F.coalesce(n, F.lit("")))).otherwise(F.col(n)) for n in (*INTAKE_LIMITS, "captcha_token")}
    return judged.withColumns(tidy)


def validate_intake(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)."""
    judged = judge_intake(df)
    return judged.filter("reject_reason is null").drop("reject_reason"), judged.filter("reject_reason is not null")


def upload_admission(files: DataFrame) -> DataFrame:
    """Verdict per file of an inventory (path, mime, length, pages)."""
    extension = F.lower(F.element_at(F.split("path", r"\."), -1))
    accepted = F.coalesce(F.col("mime").isin(*UPLOAD_TYPES), F.lit(False)) | extension.isin(*UPLOAD_EXTENSIONS)
    is_pdf = F.coalesce(F.col("mime") == "application/pdf", F.lit(False)) | (extension == "pdf")
    return files.withColumn("verdict", F.when(~accepted, "unsupported_format").when(F.col("length") > MAX_UPLOAD_BYTES, "too_large")
                            .when(is_pdf & (F.col("pages") > MAX_PDF_PAGES), "too_many_pages").otherwise("accepted"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of uploaded files, without reading their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.lit(None).cast("string").alias("mime"), F.lit(None).cast("int").alias("pages"))
