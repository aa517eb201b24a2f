"""Names of the periods that hold a date, for period tables of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.operators.skew import adaptive_join


def with_period(
    rows: DataFrame,
    periods: DataFrame,
    date: str,
    name: str = "period",
    start: str = "start_date",
    end: str = "end_date",
) -> DataFrame:
    """Add the ``name`` of the period whose inclusive range holds the date, else NULL.

    Where periods overlap, the one that starts last counts, of these the one that ends first, then
    the least name. Periods with a missing or reversed border hold nothing. Dates meet periods by
    month and once per distinct date, so no date is compared with all periods.
    """
    day = F.col(date).cast("date")
    days = rows.select(day.alias("_day")).distinct().where("_day IS NOT NULL")
    spans = periods.select(
        F.col(start).cast("date").alias("_start"), F.col(end).cast("date").alias("_end"), name
    ).where("_start <= _end")
    months = F.sequence(F.trunc("_start", "MM"), F.trunc("_end", "MM"), F.expr("INTERVAL 1 MONTH"))
    binned = spans.withColumn("_month", F.explode(months))
    asked = days.withColumn("_month", F.trunc("_day", "MM"))
    met = adaptive_join(asked, binned, ["_month"], "inner")
    held = met.where(F.col("_day").between(F.col("_start"), F.col("_end")))
    rank = F.struct((-F.unix_date("_start")).alias("late"), F.unix_date("_end").alias("end"), name)
    chosen = held.groupBy("_day").agg(F.min(rank)[name].alias(name))
    named = adaptive_join(rows.drop(name).withColumn("_day", day), chosen, ["_day"], "left")
    return named.drop("_day")
