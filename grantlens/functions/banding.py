"""Confidence bands and the field-confidence formula. The three bandings differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: (lower bound, label) from high to low, last one is the floor.
PROFILE_BANDS = ((90, "high"), (70, "review"), (50, "confirm"), (None, "untrusted"))
FIELD_BANDS = ((90, "high"), (70, "medium"), (50, "low"), (None, "unreliable"))
EVALUATION_BANDS = ((90, "90-100"), (70, "70-89"), (50, "50-69"), (None, "<50"))


def band(confidence: Column, bands, missing: str | None = None) -> Column:
    out = None
    for bound, label in bands:
        if bound is None:
            out = out.otherwise(F.lit(label))
        else:
            out = F.when(confidence >= bound, label) if out is None else out.when(confidence >= bound, label)
    return out if missing is None else F.when(confidence.isNull() | F.isnan(confidence.cast("double")), missing).otherwise(out)


def _clamped(value: Column, absent: float, falsy: float) -> Column:
    given = F.when(value.isNull(), F.lit(absent)).when(F.isnan(value) | (value == 0), F.lit(falsy)).otherwise(value)
    return F.least(F.greatest(given, F.lit(0.0)), F.lit(100.0))


def field_confidence(engine: Column, pattern: Column, label: Column, validity: Column) -> Column:
    """Weighted 0..100 score; a missing input and a zero input fall back to different values."""
    score = (
        _clamped(engine.cast("double"), 85, 75) * 0.35
        + _clamped(pattern.cast("double"), 90, 70) * 0.25
        + _clamped(label.cast("double"), 90, 50) * 0.20
        + _clamped(validity.cast("double"), 100, 80) * 0.20
    )
    return F.floor(F.round(score, 6) + 0.5).cast("int")


def js_round(value: Column) -> Column:
    """Round half up, as a 64-bit integer."""
    return F.floor(value + F.lit(0.5)).cast("bigint")
