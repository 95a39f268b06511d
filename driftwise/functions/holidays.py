"""Public holidays of the United Kingdom by their rules, as columns over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(n)).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday: the Sunday after the full moon that the golden number and the century give."""
    golden, century = year % 19, _div(year, 100)
    age = F.pmod(century - _div(century, 4) - _div(8 * century + 13, 25) + 19 * golden + 15, F.lit(30))
    moon = F.when(age == 29, 28).when((age == 28) & (golden > 10), 27).otherwise(age)
    weekday = F.pmod(year + _div(year, 4) + moon + 2 - century + _div(century, 4), F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def monday_from(day: Column) -> Column:
    """The first Monday on or after a day."""
    return F.date_add(day, F.pmod(7 - F.weekday(day), F.lit(7)).cast("int"))


def holidays(years: DataFrame) -> DataFrame:
    """(event, on) of each year: the days themselves, and the days off in place of those on a weekend."""
    year = F.col("year").cast("int")
    on = lambda month, day: F.make_date(year, F.lit(month), F.lit(day))
    named = {
        "new year's day": on(1, 1), "good friday": F.date_sub(easter(year), 2), "easter monday": F.date_add(easter(year), 1),
        "early may": monday_from(on(5, 1)), "spring": monday_from(on(5, 25)), "summer": monday_from(on(8, 25)),
        "christmas day": on(12, 25), "boxing day": on(12, 26),
    }
    days = years.select(F.explode(F.array(*[F.struct(F.lit(n).alias("event"), d.alias("on")) for n, d in named.items()])).alias("h")).select("h.*")
    # Saturday and Sunday move to Monday; where two days in a row are free, the second moves past the first.
    late = F.weekday("on")
    two = F.col("event").isin("christmas day", "boxing day")
    shift = F.when(late < 5, 0).when(two, 2).otherwise(7 - late)
    moved = days.filter(F.weekday("on") >= 5).select(F.concat("event", F.lit(" (observed)")).alias("event"), F.date_add("on", shift).alias("on"))
    return days.unionByName(moved)
