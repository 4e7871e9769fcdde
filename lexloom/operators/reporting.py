"""Presentation of summaries: numbers, salaries, durations, charts, status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of the chart and words of two languages.
BARS = " ▁▂▃▄▅▆▇█"
PERIODS = {
    "en": {"hour": "per hour", "day": "per day", "week": "per week", "month": "per month", "year": "per year"},
    "ru": {"hour": "в час", "day": "в день", "week": "в неделю", "month": "в месяц", "year": "в год"},
}
WORDS = {"en": ("from", "up to", " gross", " net", ("s", "min", "h")), "ru": ("от", "до", " до вычета", " на руки", ("с", "мин", "ч"))}


def number(value: Column, locale: str = "en") -> Column:
    """Grouped thousands: commas, or no-break spaces in Russian."""
    text = F.format_number(F.round(value), 0)
    return F.replace(text, F.lit(","), F.lit(" ")) if locale == "ru" else text


def salary(value: Column, locale: str = "en") -> Column:
    """One line for a salary struct; null for none."""
    low, up, gross, net, _ = WORDS[locale]
    a, b = number(value["from"], locale), number(value["to"], locale)
    amount = F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("–"), b)).when(a.isNotNull(), F.concat(F.lit(low + " "), a)).otherwise(F.concat(F.lit(up + " "), b))
    period = F.lit("")
    for k, v in PERIODS[locale].items():
        period = F.when(value["period"] == k, " " + v).otherwise(period)
    return F.concat(amount, F.lit(" "), value["currency"], F.when(value["gross"], gross).when(~value["gross"], net).otherwise(""), period)


def duration(milliseconds: Column, locale: str = "en") -> Column:
    """Rounded to seconds, then minutes, then hours."""
    seconds = F.round(milliseconds / 1000)
    minutes = F.round(seconds / 60)
    hours = F.round(minutes / 60)
    s, m, h = WORDS[locale][4]
    line = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(" " + unit))
    return F.when(seconds < 60, line(seconds, s)).when(minutes < 60, line(minutes, m)).otherwise(line(hours, h))


def chart(values: Column, count: int = 25) -> Column:
    """One letter for each of the last ``count`` values, by their share of the largest; missing ones are 0."""
    padded = F.slice(F.concat(F.array_repeat(F.lit(0.0), count), F.transform(values, lambda x: x.cast("double"))), -count, count)
    most = F.array_max(padded)
    letters = F.array(*[F.lit(x) for x in BARS])
    return F.array_join(F.transform(padded, lambda x: F.when(most > 0, F.get(letters, F.least(F.lit(8), F.round(x / most * 8).cast("int")))).otherwise(BARS[0])), "")


def nice_step(maximum: Column, steps: int = 12) -> Column:
    """The step of 1, 2 or 5 times a power of ten that covers a range in ``steps`` parts."""
    raw = maximum / steps
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    scaled = raw / power
    return F.when(maximum <= 0, 0.0).otherwise(F.when(scaled <= 1, 1).when(scaled <= 2, 2).when(scaled <= 5, 5).otherwise(10) * power)


def status_lines(summary: DataFrame, locale: str = "en") -> DataFrame:
    """name, text of each measure of a one-row summary."""
    kinds = dict(summary.dtypes)
    pairs = [F.struct(F.lit(c).alias("name"), (number(F.col(c), locale) if kinds[c] in ("bigint", "int", "double") else F.col(c).cast("string")).alias("text")) for c in summary.columns]
    return summary.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
