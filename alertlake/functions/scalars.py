"""Column expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(flag: Column) -> Column:
    """'true' in any case, or boolean true; everything else including NULL is false."""
    return F.coalesce(F.lower(flag.cast("string")) == "true", F.lit(False))


def flag_to_boolean(flag: Column) -> Column:
    """Booleans, their text and 1/0 to boolean; NULL to false."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))).isin("true", "1", "1.0"), F.lit(False))


def no_nan(value: Column) -> Column:
    """NaN to NULL, so that no comparison with it is true."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def parse_time(text: Column) -> Column:
    """Timestamp without zone from text or from any timestamp or date; NULL where it does not parse."""
    return F.try_to_timestamp(text.cast("string")).cast("timestamp_ntz")


def hour_in(ts: Column, first: int, before: int) -> Column:
    return (F.hour(ts) >= first) & (F.hour(ts) < before)


def elapsed_minutes(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60e6)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days of elapsed time, rounded down; not calendar days."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86400e6)).cast("bigint")


def percent_change(previous: Column, current: Column) -> Column:
    return F.try_divide(current - previous, previous) * 100


def next_version(current: Column, fallback_stamp: Column) -> Column:
    """v0.0.0 -> v1.0.0, vM.m.p -> v(M+1).0.0, anything else -> 'v' + stamp."""
    major = F.nullif(F.regexp_extract(current, r"^.(\d+)\.\d+\.\d+$", 1), F.lit("")).try_cast("bigint")
    return F.coalesce(F.concat(F.lit("v"), (major + 1).cast("string"), F.lit(".0.0")),
                      F.concat(F.lit("v"), fallback_stamp))


def format_fixed(value: Column, digits: int = 2) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value, halves to even.

    ``format_string`` rounds the shortest decimal text instead, which differs when that text ends in a 5 just behind the last
    digit kept. There the sign of the error of value - tie decides; it is found exactly by splitting the double in two.
    """
    value = value.cast("double")
    scale = float(10 ** (digits + 1))
    scaled = F.rint(value * scale)
    tie = (F.abs(scaled) % 10 == 5) & (value == scaled / scale) & (F.abs(scaled) < 2.0 ** 52)
    factor = value * 134217729.0
    high = factor - (factor - value)
    error = (scaled - high * scale) - (value - high) * scale
    below, above = (scaled - 5) / 10, (scaled + 5) / 10
    even = F.when(below % 2 == 0, below).otherwise(above)
    chosen = F.when(error > 0, below).when(error < 0, above).otherwise(even)
    return F.format_string(f"%.{digits}f", F.when(tie, chosen / float(10 ** digits)).otherwise(value))


# Rule limits and labels of the weekly branch report.
REPORT_REVENUE_DROP = -20
REPORT_COMPLAINTS = 30
REPORT_UPTIME = 92
REPORT_FRAUD_FLAGS = 0
REPORT_LABELS = {
    "revenue": "Significant revenue drop",
    "complaints": "Spike in customer complaints",
    "uptime": "ATM downtime increased",
    "fraud": "Potential fraud detected",
    "none": "No significant issues",
}


def report_label(revenue_change: Column, complaints: Column, uptime: Column, fraud_flags: Column) -> Column:
    """Labels of all rules that hold, joined by '; '."""
    joined = F.concat_ws(
        "; ",
        F.when(revenue_change <= REPORT_REVENUE_DROP, REPORT_LABELS["revenue"]),
        F.when(complaints > REPORT_COMPLAINTS, REPORT_LABELS["complaints"]),
        F.when(uptime < REPORT_UPTIME, REPORT_LABELS["uptime"]),
        F.when(fraud_flags > REPORT_FRAUD_FLAGS, REPORT_LABELS["fraud"]),
    )
    return F.when(joined == "", REPORT_LABELS["none"]).otherwise(joined)


# Age bands. Lower bounds inclusive.
AGE_BANDS = [(18, "18-24"), (25, "25-34"), (35, "35-44"), (45, "45-54"), (55, "55-64"), (65, "65+")]


def age_group(age: Column) -> Column:
    band = F.lit(None).cast("string")
    for start, label in AGE_BANDS:
        band = F.when(age >= start, label).otherwise(band)
    return band
