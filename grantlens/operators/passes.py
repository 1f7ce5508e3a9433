"""The fields of several extraction passes, reconciled into one record per document.

Rows are long: (document, kind, pass_no, field, value, confidence from 0 to 1). Passes that agree are counted by a
partial aggregation over (document, field, value or pass), and the winner of a field by a second one, so a document
of any number of passes travels as one row per field; no window sees more than the fields of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grantlens.functions.text import blank_to_null
from grantlens.operators import extraction as X
from grantlens.operators.documents import classify_documents, document_issues, overall_confidence, slot_validation

# The bonus of a name that two passes read, the most a name can have, and the confidence of values that carry none.
AGREEMENT_BONUS, MOST_NAME_CONFIDENCE = 0.20, 0.98
NAME_DEFAULT, MARKS_DEFAULT, SCHOOL_DEFAULT = 0.75, 0.90, 0.85
# Kinds of mark sheets, what travels with their marks, and fields that any pass may fill.
MARKSHEETS = ("ms10", "ms12")
MARKS_GROUP = ("max_marks", "percentage", "grade")
FILLED_FIELDS = ("register_number", "roll_number", "dob", "year", "month", "board", "father_name", "mother_name", "subject_marks")

AGREE, BEST, FIRST, BASE = "agree", "best", "first", "base"


def _policy(kind: Column, field: Column) -> Column:
    """How a field is reconciled: names by agreement, marks and school of mark sheets by confidence, else the first pass that has it;
    what else a mark sheet holds comes from its first pass alone."""
    marksheet = F.coalesce(kind.isin(*MARKSHEETS), F.lit(False))
    return (F.when(field == "name", AGREE).when(~marksheet, FIRST).when(field.isin("marks", "school", *MARKS_GROUP), BEST)
            .when(field.isin(*FILLED_FIELDS), FIRST).otherwise(BASE))


def _winners(passes: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per document and group of fields with the array of its reconciled fields."""
    held = [key, "kind", *keep]
    rows = passes.select(*held, "pass_no", "field", blank_to_null(F.col("value")).alias("value"), F.col("confidence").cast("double").alias("confidence"))
    rows = rows.withColumn("policy", _policy(F.col("kind"), F.col("field")))
    rows = rows.withColumn("lead", F.when((F.col("policy") == BEST) & F.col("field").isin(*MARKS_GROUP), "marks").otherwise(F.col("field")))
    letters = F.concat(F.lit("n"), F.regexp_replace(F.lower("value"), "[^a-z]", ""))
    rows = rows.withColumn("part", F.when((F.col("policy") == AGREE) & F.col("value").isNotNull(), letters).otherwise(F.col("pass_no").cast("string")))

    # First level: equal names of a document, or one pass of any other field.
    leads = (F.col("field") == F.col("lead")) & F.col("value").isNotNull()
    sure = F.when(F.col("policy") == AGREE, F.coalesce("confidence", F.lit(NAME_DEFAULT))).otherwise(F.col("confidence"))
    read = F.when(leads, F.struct("value", sure.alias("sure"), F.col("confidence").alias("own"), "pass_no"))
    order = F.when(leads, F.struct(F.coalesce(sure, F.lit(-1.0)), -F.col("pass_no"), F.col("value")))
    member = lambda m: F.max(F.when((F.col("field") == m) & (F.col("lead") != m) & F.col("value").isNotNull(), F.struct("value", "confidence"))).alias(m)
    parts = rows.groupBy(*held, "policy", "lead", "part").agg(
        F.max_by(read, order).alias("top"), F.min_by(read, F.when(leads, F.struct("pass_no", "value"))).alias("early"), F.min(F.when(leads, F.col("pass_no"))).alias("read_from"),
        F.max(F.when(leads, F.col("pass_no"))).alias("read_to"), F.min("pass_no").alias("from_pass"), F.max("pass_no").alias("to_pass"), *[member(m) for m in MARKS_GROUP])

    # Second level: the winner of every group of fields.
    total = F.round(F.col("top.sure") + F.when(F.col("read_from") < F.col("read_to"), AGREEMENT_BONUS).otherwise(0.0), 6)
    members = F.array(*[F.struct(F.lit(m).alias("field"), F.col(m)["value"].alias("value"), F.col(m)["confidence"].alias("confidence")) for m in MARKS_GROUP])
    entry = lambda of: F.struct(F.col(of)["value"].alias("value"), F.col(of)["own"].alias("own"), total.alias("total"), F.col(of)["pass_no"].alias("pass_no"), members.alias("members"))
    known = F.col("top.sure").isNotNull()
    groups = parts.groupBy(*held, "policy", "lead").agg(
        F.max_by(entry("top"), F.when(known, F.struct(total, -F.col("top.pass_no"), F.col("top.value")))).alias("best"),
        F.min_by(entry("early"), F.when(F.col("early").isNotNull(), F.struct("early.pass_no", "early.value"))).alias("first"),
        F.min_by(F.struct("from_pass", members.alias("members")), "from_pass").alias("opening"), F.max("to_pass").alias("to_pass"))

    # Which pass is the first of the document, over its fields.
    document = Window.partitionBy(key)
    groups = groups.withColumns({"base": F.min("opening.from_pass").over(document), "last": F.max("to_pass").over(document)})
    best, first, base = F.col("best"), F.col("first"), F.col("base")
    default = F.when(F.col("lead") == "school", SCHOOL_DEFAULT).otherwise(MARKS_DEFAULT)
    held_by_first = F.coalesce(first["own"], F.when(first["pass_no"] == base, 0.0).otherwise(default))
    winner = (F.when(F.col("policy") == AGREE, best).when((F.col("policy") == BASE) & (first["pass_no"] != base), F.lit(None))
              .when((F.col("policy") == BEST) & (best["total"].isNotNull()) & (first["own"].isNotNull() | (best["total"] > held_by_first)), best).otherwise(first))
    groups = groups.withColumn("winner", winner)
    w = F.col("winner")
    confidence = (F.when((F.col("policy") == AGREE) & (F.col("last") > base), F.least(F.lit(MOST_NAME_CONFIDENCE), F.round(w["total"], 2)))
                  .when((F.col("policy") == BEST) & (w["pass_no"] != base), F.coalesce(w["own"], default)).otherwise(w["own"]))
    # Without marks anywhere, a mark sheet keeps what its first pass has of the group.
    loose = F.when(F.col("opening.from_pass") == base, F.col("opening.members"))
    followers = F.transform(F.coalesce(F.when(F.col("policy") == BEST, F.coalesce(w["members"], loose)), F.array().cast(groups.schema["opening"].dataType["members"].dataType)),
                            lambda m: F.struct(m["field"].alias("field"), m["value"].alias("value"), m["confidence"].alias("confidence"), F.coalesce(w["pass_no"], base).alias("pass_no")))
    own = F.array(F.struct(F.col("lead").alias("field"), w["value"].alias("value"), confidence.alias("confidence"), w["pass_no"].alias("pass_no")))
    return groups.select(*held, F.filter(F.concat(own, followers), lambda f: f["value"].isNotNull()).alias("fields"), base.alias("first_pass"), F.col("last").alias("last_pass"))


def reconcile_fields(passes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, kind, field, value, confidence, pass_no) from rows of several passes.

    Names: the highest confidence (0.75 if unknown) plus 0.20 when two passes read the same letters, at most 0.98; a document
    of one pass keeps its own. Marks of mark sheets with maximum, percentage and grade travel together from the pass most sure
    of the marks; schools by confidence; other known fields from the first pass that has them; any other field of a mark sheet
    from its first pass. Every field of a certificate but the name comes from the first pass that has it. Equal confidences go to
    the earlier pass, repeated fields of one pass to the surer, then greater value (marks and names) or the smaller. Blank values
    count as missing; a pass without any field may stand as a row whose field is NULL. Values keep the confidence of their pass.
    """
    return _winners(passes, key, ()).select(key, "kind", F.explode("fields").alias("f")).select(key, "kind", "f.*")


def reports_of_passes(df: DataFrame, as_of: Column, key: str = "doc_id", passes: str = "passes", slot: str = "slot", engine: str = "engine") -> DataFrame:
    """One report per document from the texts of its passes (an array, the first one decides the type where no slot does).

    Type, fit to the slot, fields of every pass reconciled, issues and warnings, and the overall confidence from the engine's,
    the fields' and the type's. Documents without text have a report without fields; a NULL or empty array counts as one pass
    without text.
    """
    # As a string, for rows grouped by a number with a fraction are sorted anew before every grouping; 0.0 makes one of both zeros.
    known = df.select(key, slot, (F.col(engine).cast("double") + 0.0).cast("string").alias("engine"), F.when(F.size(passes) > 0, F.col(passes)).otherwise(F.array(F.lit("").cast("string"))).alias("texts"))
    kinds = classify_documents(known.withColumn("text", F.get("texts", F.lit(0))), key, "text", keep=(slot, "engine", "texts"))
    # posexplode() would have all texts made a second time where the table is read, for a filter; there is always one.
    typed = kinds.select(key, F.coalesce(slot, "doc_type").alias("kind"), "doc_type", F.col("confidence").alias("class_confidence"), "engine",
                         slot_validation(F.col(slot), F.col("doc_type"), F.col("confidence")).alias("validation"), F.posexplode_outer("texts").alias("pos", "text"))
    typed = typed.withColumn("pass_no", F.col("pos") + 1).drop("pos")
    facts = ("doc_type", "class_confidence", "engine", "validation")
    long = X.field_rows(X.with_fields(typed, "text"), [key, "kind", *facts, "pass_no"], outer=True)
    rows = long.withColumn("confidence", F.col("confidence") / 100.0)
    whole = _winners(rows, key, facts).groupBy(key, "kind", *facts).agg(
        F.flatten(F.collect_list("fields")).alias("fields"), (F.max("last_pass") - F.min("first_pass") + 1).alias("n_passes"))
    whole = whole.withColumn("value_of", F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["value"]))))
    get = lambda field: F.try_element_at("value_of", F.lit(field))
    issues, warnings = document_issues(F.col("kind"), as_of, get)
    add = lambda status, code, codes: F.concat(F.when(F.col("validation") == status, F.array(F.lit(code))).otherwise(F.array().cast("array<string>")), codes)
    confidences = F.transform("fields", lambda f: f["confidence"])
    out = whole.withColumns({"issues": add("mismatch", "slot_mismatch", issues), "warnings": add("unconfident", "slot_unconfident", warnings)})
    incomplete = F.col("kind").isin(*MARKSHEETS) & (get("name").isNull() | get("marks").isNull() | get("year").isNull())
    return out.select(
        key, "kind", "doc_type", "validation", "n_passes", F.size("fields").alias("n_fields"), F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"),
        overall_confidence(F.col("engine").cast("double"), confidences, F.col("class_confidence")).cast("int").alias("confidence"), (F.size("issues") == 0).alias("is_valid"), incomplete.alias("fields_incomplete"))
