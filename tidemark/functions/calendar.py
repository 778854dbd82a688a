"""Business dates and run identifiers."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: text formats of dates and run identifiers ---
DATE_FORMAT = "%Y-%m-%d"
RUN_ID_FORMAT = "%Y%m%dT%H%M%S%fZ"
# --- end of fixed values ---


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def business_date(explicit: str | date | None = None, now: datetime | None = None) -> date:
    """The explicit date, or the day before today in UTC."""
    if isinstance(explicit, date):
        return explicit
    if explicit:
        return datetime.strptime(explicit, DATE_FORMAT).date()
    return (now or utc_now()).astimezone(timezone.utc).date() - timedelta(days=1)


def run_id(now: datetime | None = None) -> str:
    return (now or utc_now()).astimezone(timezone.utc).strftime(RUN_ID_FORMAT)


def run_id_column(at: Column) -> Column:
    """The run identifier of a timestamp column."""
    return F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS'Z'")
