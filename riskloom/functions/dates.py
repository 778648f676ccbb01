"""Dates, periods, numbers and times from text. Malformed text is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date_prefix(c: Column) -> Column:
    """The leading YYYY-MM-DD as a date."""
    said = F.trim(c)
    return F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(said, F.lit(10)), "yyyy-MM-dd"))


def flexible_date(c: Column) -> tuple[Column, Column]:
    """The year of any text that begins with four digits, and the date of one that begins with YYYY-MM-DD or is YYYY-MM or YYYY (then with 01 for what is missing)."""
    year = F.when(c.rlike(r"^\d{4}"), F.left(c, F.lit(4)).cast("int"))
    full = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(c, F.lit(10))).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01")))
    return year, F.try_to_date(full, "yyyy-MM-dd")


def safe_timestamp(c: Column) -> Column:
    """Text that begins with an ISO date, as a timestamp."""
    said = F.trim(c)
    return F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(said))


def strict_iso_timestamp(c: Column) -> Column:
    """Exactly YYYY-MM-DDThh:mm:ss, without zone."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), c.try_cast("timestamp_ntz"))


def period_to_date(period: Column, frequency: Column) -> Column:
    """First day of a day or quarter (YYYY-Qn), of a month only where the frequency is M, and of a year only where it is A."""
    p = F.trim(period)
    quarter = F.concat(F.left(p, F.lit(4)), F.lit("-"), F.lpad(((F.right(p, F.lit(1)).cast("int") - 1) * 3 + 1).cast("string"), 2, "0"), F.lit("-01"))
    text = (
        F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), p)
        .when((frequency == "M") & p.rlike(r"^\d{4}-\d{2}$"), F.concat(p, F.lit("-01")))
        .when(p.rlike(r"^\d{4}-Q[1-4]$"), quarter)
        .when((frequency == "A") & p.rlike(r"^\d{4}$"), F.concat(p, F.lit("-01-01")))
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def guarded_decimal(c: Column) -> Column:
    """Plain decimal text (no exponent) as a number."""
    said = F.trim(c)
    return F.when(said.rlike(r"^-?\d+(\.\d+)?$"), said.try_cast("decimal(18,6)"))


def run_duration(started: Column, finished: Column) -> Column:
    """Whole seconds, rounded."""
    return F.round((F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / F.lit(1e6)).cast("int")


def latest_of(*cols: Column) -> Column:
    """The greatest; nulls are passed over."""
    return F.greatest(*cols)


def snapshot_age(load_date: Column, today: Column) -> Column:
    """Days from a snapshot to the given day."""
    return F.datediff(today, load_date)


def snapshot_freshness(load_date: Column, today: Column, most_days: int, policy: str = "warn") -> Column:
    """fresh, or how the policy calls a snapshot older than ``most_days``; unknown without a date."""
    stale = {"fail": "stale_failed", "warn": "stale_warning", "allow": "stale_allowed"}[policy]
    age = snapshot_age(load_date, today)
    return F.when(age.isNull(), F.lit("unknown")).when(age <= most_days, F.lit("fresh")).otherwise(F.lit(stale))
