"""Column functions for preparation tracks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
URGENT_DAYS = 3
SOON_DAYS = 7
EMPTY_TRACK_TOTAL = 10
NO_TOPICS = "Algorithm & Data Structures"
# ---------------------------------------------------------------------------


def interview_date(today: Column, days_until: Column) -> Column:
    return F.date_add(today, days_until.cast("int"))


def days_remaining(interview_date: Column, today: Column, days_until: Column) -> Column:
    return F.coalesce(F.datediff(interview_date, today), days_until)


def is_finished(done: Column, total: Column) -> Column:
    return (done == total) & (total > 0)


def status(finished: Column, days_left: Column) -> Column:
    return (
        F.when(finished, "FINISHED")
        .when(days_left <= URGENT_DAYS, "URGENT")
        .when(days_left <= SOON_DAYS, "SOON")
        .otherwise("ON TRACK")
    )


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))


def shown_total(total: Column) -> Column:
    return F.when(total > 0, total).otherwise(F.lit(EMPTY_TRACK_TOTAL))
