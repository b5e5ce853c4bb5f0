"""Queries through user-defined mergeable aggregates."""

from __future__ import annotations

from tempora.catalog.base import B0, B1, CITY, MATRIX, SPEC, query, with_sql
from tempora.operators import climatology as C
from tempora.operators import combine as K
from tempora.sources import star


@query("combine_keyed_sum", "A27", "SELECT event_type, sum(value) AS total FROM events GROUP BY event_type", "total")
def _(spark, path):
    return K.combine_per_key(star.table(spark, path, "events"), ["event_type"], K.Sum(), ["value"])


@query(
    "combine_monthly_means", "A1",
    with_sql(CITY) + """ SELECT city, year, month, avg(temperature_2m_mean) AS mean, count(temperature_2m_mean) AS count
      FROM city_cal GROUP BY city, year, month""", "mean",
)
def _(spark, path):
    daily = C.with_year_month_day(star.city_daily(spark, path), SPEC.time)
    return K.combine_per_key(daily.withColumn("month", C.F.month(SPEC.time)), ["city", "year", "month"], K.MeanCount(), [SPEC.temp])


@query(
    "combine_baseline_stats", "A2",
    with_sql(MATRIX) + """ SELECT city, month, baseline_mean AS mean, baseline_std AS std,
      (SELECT count(*) FROM monthly m WHERE m.city = base.city AND m.month = base.month AND year BETWEEN %d AND %d) AS n FROM base""" % (B0, B1),
    "mean std",
)
def _(spark, path):
    monthly = C.monthly_means(star.city_daily(spark, path, B0, B1), SPEC)
    return K.combine_per_key(monthly, ["city", "month"], K.MeanStd(), ["mean_temp"])
