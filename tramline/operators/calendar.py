"""Service days: which services run when, and the busiest day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs_on(date, days="days", start="start_date", end="end_date", additions="additions", exceptions="exceptions") -> Column:
    """Whether a service runs: a null date always; an addition always; outside the span or on an exception never; else by weekday."""
    date = date if isinstance(date, Column) else F.col(date)
    within = F.coalesce(date.between(F.col(start), F.col(end)), F.lit(False))
    return (
        F.when(date.isNull(), True).when(F.coalesce(F.array_contains(additions, date), F.lit(False)), True)
        .when(~within | F.coalesce(F.array_contains(exceptions, date), F.lit(False)), False)
        .otherwise(F.coalesce(F.get(F.col(days), F.weekday(date)), F.lit(False)))
    )


def service_days(services: DataFrame, *more: str) -> DataFrame:
    """(service_id, date) of all days covered: weekdays in the span and additions, without exceptions that aren't additions; ``more`` columns before the date."""
    span = F.when(F.col("start_date") <= F.col("end_date"), F.sequence("start_date", "end_date")).otherwise(F.array().cast("array<date>"))
    regular = F.filter(span, lambda d: F.coalesce(F.get(F.col("days"), F.weekday(d)), F.lit(False)))
    none = F.array().cast("array<date>")
    added = F.coalesce("additions", none)
    covered = F.array_union(F.array_except(F.coalesce(regular, none), F.coalesce("exceptions", none)), added)
    return services.select("service_id", *more, F.explode(covered).alias("date"))


def busiest(days: DataFrame, n: Column | None = None) -> DataFrame:
    """One row (best_day, n) of the date with most rows, or the largest sum of ``n``; the earliest of equals. No rows give none."""
    total = F.count("*") if n is None else F.sum(n)
    return days.groupBy(F.col("date").alias("best_day")).agg(total.alias("n")).orderBy(F.desc("n"), "best_day").limit(1)


def by_trips(service_of_trips: DataFrame, services: DataFrame) -> DataFrame:
    """The day with most trips. Trips are counted by service, and services meet their counts before they unfold into days, so no table of days is broadcast."""
    trips = service_of_trips.groupBy("service_id").agg(F.count("*").alias("_trips"))
    return busiest(service_days(services.hint("merge").join(trips.hint("merge"), "service_id"), "_trips"), F.col("_trips"))


def by_services(services: DataFrame) -> DataFrame:
    return busiest(service_days(services))
