"""Business days: weekends, bank holidays and the feasts that move with Easter, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: holidays as month and day, and feasts as days from Easter Sunday
FIXED = ["01-01", "01-25", "04-21", "05-01", "07-09", "09-07", "10-12", "11-02", "11-15", "11-20", "12-25"]
FROM_EASTER = [-48, -47, -2, 60]


def with_easter(years: DataFrame) -> DataFrame:
    """``years`` (y: int) with the date of Easter Sunday: the Sunday after the paschal moon, counted from 28 March (Oudin)."""
    years = years.withColumn("golden", F.expr("y % 19")).withColumn("century", F.expr("y div 100"))
    years = years.withColumn("age", F.expr("(century - century div 4 - (8 * century + 13) div 25 + 19 * golden + 15) % 30"))
    years = years.withColumn("moon", F.expr("age - (age div 28) * (1 - (29 div (age + 1)) * ((21 - golden) div 11))"))
    weekday = F.expr("(y + y div 4 + moon + 2 - century + century div 4) % 7")
    return years.select("y", F.date_add(F.make_date("y", F.lit(3), F.lit(28)), (F.col("moon") - weekday).cast("int")).alias("easter"))


def holidays(years: DataFrame) -> DataFrame:
    """One row (day) per holiday of the ``years`` (y)."""
    fixed = years.withColumn("date", F.explode(F.array(*map(F.lit, FIXED)))).select(F.to_date(F.concat_ws("-", "y", "date")).alias("day"))
    moving = with_easter(years).withColumn("days", F.explode(F.array(*map(F.lit, FROM_EASTER)))).select(F.expr("date_add(easter, days)").alias("day"))
    return fixed.unionByName(moving).distinct()


def next_business_days(dates: DataFrame, name: str, most: int = 9) -> DataFrame:
    """(name, business): each distinct date of column ``name`` with the first business day on or after it."""
    distinct = dates.select(name).filter(F.col(name).isNotNull()).distinct()
    days = distinct.withColumn("day", F.explode(F.sequence(F.col(name), F.date_add(name, most))))
    off = holidays(days.select(F.year("day").alias("y")).distinct())
    return days.filter(~F.dayofweek("day").isin(1, 7)).join(off, "day", "left_anti").groupBy(name).agg(F.min("day").alias("business"))
