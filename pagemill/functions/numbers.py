"""Tolerant number and date parsing, and the trial score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import strip


def whole(c: Column) -> Column:
    """Whole number of any length with optional sign and surrounding white space, as its plain digits, else NULL."""
    t = strip(c)
    digits = F.regexp_replace(t, r"^[+-]?0*(?=\d)", "")
    plain = F.when(t.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(t.rlike(r"^[+-]?\d++\z"), plain)


def order_key(number: Column) -> Column:
    """STRUCT that orders plain whole numbers of any length: by signed length, then by digits, or those that are missing
    to nine for numbers below zero."""
    negative = number.startswith("-")
    digits = F.regexp_replace(number, "^-", "")
    return F.struct(
        F.when(negative, -F.length(digits)).otherwise(F.length(digits)).alias("size"),
        F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"),
    )


def to_date(c: Column) -> Column:
    """`year-month-day` in exactly three numeric parts, leading zeros at will, year 1 to 9999, else NULL."""
    parts = F.transform(F.split(c, "-"), lambda p: F.regexp_replace(strip(p), r"^0++(?=\d)", ""))
    widths = F.array(F.lit(4), F.lit(2), F.lit(2))
    padded = F.zip_with(parts, widths, lambda p, w: F.when(F.length(p) > 0, F.lpad(p, F.greatest(w, F.length(p)), "0")))
    shape = F.array_join(padded, "-")
    return F.when(shape.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}\z"), shape.try_cast("date"))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def gain(base: Column, value: Column) -> Column:
    """Share of `base` saved by `value`, within [0, 1]; 0 where there is no positive base."""
    return F.when(base > 0, clamp01((base - value) / base)).otherwise(0.0)


def score(
    rc: Column, correct: Column, time_s: Column, peak_mb: Column, base_time_s: Column, base_peak_mb: Column
) -> Column:
    """0 for a failed or wrong trial, otherwise 0.5 plus up to 0.5 for saved time (60 %) and memory (40 %)."""
    saved = F.lit(0.6) * gain(base_time_s, time_s) + F.lit(0.4) * gain(base_peak_mb, peak_mb)
    return F.when((rc == 0) & (correct >= 1.0), correct * (F.lit(0.5) + F.lit(0.5) * saved)).otherwise(0.0)
