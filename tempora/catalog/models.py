"""Feature, model, forecast, selection, gate and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import climate, summaries
from tempora.catalog.base import B0, B1, CITY, MATRIX, REGION, SPEC, query, with_sql
from tempora.functions.plausibility import reasonable_temperature_signal
from tempora.operators import climatology as C
from tempora.operators import features as FT
from tempora.operators import gates as G
from tempora.operators import ledger as L
from tempora.operators import modeling as MD
from tempora.operators import selection as SEL
from tempora.sources import star

CUR = SPEC.current_year
TEST_FROM = 2000
REF, SCALE = 1991, 30.0

FEATURE_COLS = "sin_doy cos_doy year_norm precip_log1p snow_log1p sunshine_frac_day wind_norm et0_norm y y_min y_max"
FEATURES = REGION + """,
features AS (SELECT time, year, sin(2 * pi() * dayofyear(time) / 365.0) AS sin_doy,
  cos(2 * pi() * dayofyear(time) / 365.0) AS cos_doy, (year - 1991) / 30.0 AS year_norm,
  CASE WHEN precipitation_sum IS NOT NULL THEN ln(1 + greatest(precipitation_sum, 0.0)) END AS precip_log1p,
  CASE WHEN snowfall_sum IS NOT NULL THEN ln(1 + greatest(snowfall_sum, 0.0)) END AS snow_log1p,
  sunshine_duration / 86400.0 AS sunshine_frac_day, wind_speed_10m_max / 30.0 AS wind_norm,
  et0_fao_evapotranspiration / 10.0 AS et0_norm, temperature_2m_mean AS y, temperature_2m_min AS y_min,
  temperature_2m_max AS y_max FROM region_all WHERE temperature_2m_mean IS NOT NULL)"""
INPUTS = FEATURE_COLS.split()[:8]


def region_all(spark, path, first=None, last=None):
    return C.region_daily(star.city_daily(spark, path, first, last), SPEC)


def features(spark, path):
    return FT.build_features(region_all(spark, path), SPEC, ("time",))


@query("seasonal_features", "F1 F2", with_sql(FEATURES) + " SELECT time, sin_doy, cos_doy, year_norm FROM features",
       "sin_doy cos_doy year_norm")
def _(spark, path):
    d = region_all(spark, path).filter(F.col(SPEC.temp).isNotNull())
    return d.select("time", *[c.alias(n) for n, c in FT.seasonal_columns("time").items()])


@query("feature_table", "F4 F1 F2 F3", with_sql(FEATURES) + " SELECT * FROM features", FEATURE_COLS)
def _(spark, path):
    return features(spark, path)


@query(
    "train_test_split", "F5",
    with_sql(FEATURES) + f""" SELECT CASE WHEN year < {TEST_FROM} THEN 'train' ELSE 'test' END AS part, year,
      count(*) AS rows, avg(y) AS mean_y FROM features GROUP BY ALL""",
    "mean_y",
)
def _(spark, path):
    train, test = FT.chronological_split(features(spark, path), TEST_FROM)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "year").agg(F.count("*").alias("rows"), F.avg("y").alias("mean_y"))


@query(
    "feature_defaults", "A32",
    with_sql(FEATURES) + " " + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, avg({n}) AS default_value FROM features WHERE year < {TEST_FROM}" for n in INPUTS),
    "default_value",
)
def _(spark, path):
    train, _ = FT.chronological_split(features(spark, path), TEST_FROM)
    return FT.feature_defaults(train, INPUTS)


MANIFEST = ("year_norm", "cos_doy", "sin_doy", "wind_norm", "humidity_norm", "et0_norm")
STORED_DEFAULTS = {"humidity_norm": 0.5, "wind_norm": 0.33}


@query(
    "feature_contract_apply", "F6",
    with_sql(FEATURES) + f""" SELECT time, year_norm, cos_doy, sin_doy, 0.25 AS wind_norm, 0.5 AS humidity_norm,
      coalesce(et0_norm, 0.0) AS et0_norm FROM features WHERE year >= {TEST_FROM}""",
    "year_norm cos_doy sin_doy et0_norm wind_norm humidity_norm",
)
def _(spark, path):
    _, test = FT.chronological_split(features(spark, path), TEST_FROM)
    contract = FT.FeatureContract(MANIFEST, STORED_DEFAULTS)
    return contract.apply(test, ("time",), {"wind_norm": 0.25, "cos_doy": None})


@query(
    "feature_contract_check", "Q6",
    with_sql(FEATURES) + " " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS feature, {'false' if n == 'humidity_norm' else 'true'} AS present, "
        f"{'CAST(count(*) * 0 AS BIGINT)' if n == 'humidity_norm' else f'count({n})'} AS \"values\" FROM features" for i, n in enumerate(MANIFEST)),
)
def _(spark, path):
    return FT.contract_check(features(spark, path), list(MANIFEST))


HORIZON = 14
FUTURE = REGION + f""",
future AS (SELECT CAST(d + CAST(i AS INTEGER) AS DATE) AS time FROM (SELECT max(time) AS d FROM region_all), range(1, {HORIZON + 1}) r(i))"""


def future(spark, path):
    last = star.city_daily(spark, path).agg(F.max("time").alias("last_date"))
    return FT.future_dates(last, "last_date", HORIZON)


@query(
    "future_features", "F7",
    with_sql(FUTURE) + """ SELECT time, sin(2 * pi() * dayofyear(time) / 365.0) AS sin_doy,
      cos(2 * pi() * dayofyear(time) / 365.0) AS cos_doy, (year(time) - 1991) / 30.0 AS year_norm, 0.33 AS wind_norm FROM future""",
    "sin_doy cos_doy year_norm wind_norm",
)
def _(spark, path):
    contract = FT.FeatureContract((*FT.SEASONAL, "wind_norm"), STORED_DEFAULTS)
    return FT.future_features(future(spark, path), contract)


# deterministic predictions: the climatology of the baseline years stands for the model -------------

PRED = REGION + f""",
clim AS (SELECT month_day, avg(temperature_2m_mean) AS p FROM region_all WHERE year BETWEEN {B0} AND {B1} GROUP BY month_day),
pred AS (SELECT r.time, r.year, r.temperature_2m_mean AS y_true, c.p AS y_pred, r.temperature_2m_mean - c.p AS residual
  FROM region_all r JOIN clim c USING (month_day) WHERE r.year >= {TEST_FROM} AND r.temperature_2m_mean IS NOT NULL AND c.p IS NOT NULL)"""
CITY_PRED = CITY + f""",
clim AS (SELECT city, month_day, avg(temperature_2m_mean) AS p FROM city_cal WHERE year BETWEEN {B0} AND {B1} GROUP BY city, month_day),
pred AS (SELECT r.city, r.time, r.year, r.temperature_2m_mean AS y_true, c.p AS y_pred, r.temperature_2m_mean - c.p AS residual
  FROM city_cal r JOIN clim c USING (city, month_day) WHERE r.year >= {TEST_FROM} AND r.temperature_2m_mean IS NOT NULL AND c.p IS NOT NULL)"""


def climatology_predictions(daily, keys=()):
    clim = C.daily_climatology(daily, SPEC, keys).select(*keys, "month_day", F.col("climatology_temp_mean").alias("y_pred"))
    test = daily.filter(F.col("year") >= TEST_FROM).select(*keys, "month_day", "time", "year", F.col(SPEC.temp).alias("y_true"))
    return (
        test.join(clim, [*keys, "month_day"]).drop("month_day")
        .filter("y_true is not null and y_pred is not null").withColumn("residual", F.col("y_true") - F.col("y_pred"))
    )


def region_pred(spark, path):
    return climatology_predictions(region_all(spark, path))


def city_pred(spark, path):
    return climatology_predictions(C.with_year_month_day(star.city_daily(spark, path)), ("city",))


METRICS = """ SELECT {k} count(*) AS n, avg(residual * residual) AS mse, sqrt(avg(residual * residual)) AS rmse,
  avg(abs(residual)) AS mae, coalesce(1 - sum(residual * residual) / nullif(var_pop(y_true) * count(*), 0), 0.0) AS r2,
  avg(residual) AS residual_mean, stddev_pop(residual) AS residual_std FROM pred {g}"""


@query("regression_metrics", "A25", with_sql(PRED) + METRICS.format(k="", g=""), "mse rmse mae r2 residual_mean residual_std")
def _(spark, path):
    return MD.regression_metrics(region_pred(spark, path))


@query("regression_metrics_by_entity", "A25", with_sql(CITY_PRED) + METRICS.format(k="city,", g="GROUP BY city"),
       "mse rmse mae r2 residual_mean residual_std")
def _(spark, path):
    return MD.regression_metrics(city_pred(spark, path), ("city",))


@query(
    "residual_histogram", "A29",
    with_sql(PRED) + """, r AS (SELECT round(y_true - y_pred + 1e-9, 2) AS r FROM pred),
      b AS (SELECT CAST(unnest(range(CAST(floor(min(r)) AS BIGINT), CAST(ceil(max(r)) AS BIGINT) + 1)) AS INTEGER) AS bin FROM r)
      SELECT bin, count(r) AS residuals FROM b LEFT JOIN r ON floor(r) = bin GROUP BY bin""",
)
def _(spark, path):
    return MD.residual_histogram(region_pred(spark, path))


@query(
    "prediction_histogram", "A30",
    with_sql(CITY_PRED) + " " + " UNION ALL ".join(
        f"SELECT '{e}' AS le, count(*) FILTER (WHERE y_pred <= {e}) AS \"count\" FROM pred" for e in MD.PREDICTION_EDGES)
    + " UNION ALL SELECT '+Inf', count(*) FROM pred",
)
def _(spark, path):
    return MD.prediction_histogram(city_pred(spark, path))


@query(
    "even_sample", "W9",
    with_sql(CITY_PRED) + """, p AS (SELECT city, time, y_true, y_pred, row_number() OVER (ORDER BY time, md5(city)[1:2], city) - 1 AS position,
        count(*) OVER () AS n FROM pred)
      SELECT city, time, y_true, y_pred, position FROM p WHERE position IN
        (SELECT CAST(round_even(i * ((SELECT max(n) FROM p) - 1) / 199.0, 0) AS BIGINT) FROM range(0, 200) t(i))""",
    "y_true y_pred",
)
@star.one_daily_pass
def _(spark, path):
    return MD.even_sample(city_pred(spark, path), "time", ["city"]).select("city", "time", "y_true", "y_pred", "position")


BIAS_COLS = "ytd_bias recent_bias recent_observed_mean"
BIAS = CITY_PRED + f""",
bias0 AS (SELECT city, y_true, y_true - y_pred AS b, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rn
  FROM pred WHERE year = {CUR}),
bias AS (SELECT city, avg(b) AS ytd_bias, count(*) AS n_ytd, avg(b) FILTER (WHERE rn <= 30) AS recent_bias,
  count(*) FILTER (WHERE rn <= 30) AS n_recent, avg(y_true) FILTER (WHERE rn <= 30) AS recent_observed_mean
  FROM bias0 GROUP BY city)"""


@query("year_bias", "W10", with_sql(BIAS) + " SELECT * FROM bias", BIAS_COLS)
def _(spark, path):
    return MD.year_bias(city_pred(spark, path).filter(F.col("year") == CUR), ["city"], "time")


RECENT = """ rec0 AS (SELECT city, temperature_2m_mean AS t, row_number() OVER (PARTITION BY city ORDER BY time DESC) AS rn
  FROM city_cal WHERE temperature_2m_mean IS NOT NULL),
rec AS (SELECT city, avg(t) AS recent_mean, count(*) AS observed_days FROM rec0 WHERE rn <= 7 GROUP BY city)"""


@query("recent_mean", "W11", with_sql(CITY, RECENT) + " SELECT * FROM rec", "recent_mean")
def _(spark, path):
    return MD.recent_mean(star.city_daily(spark, path), ["city"], "time", SPEC.temp)


RANGE = """ tr AS (SELECT time AS target_date, (SELECT struct_pack(lo := avg(temperature_2m_min), hi := avg(temperature_2m_max))
    FROM city_cal c WHERE temperature_2m_min IS NOT NULL AND temperature_2m_max IS NOT NULL
    AND least(abs(dayofyear(c.time) - dayofyear(f.time)), 365 - abs(dayofyear(c.time) - dayofyear(f.time))) <= 7) AS r FROM future f)"""


def _targets(spark, path):
    return future(spark, path).withColumnRenamed("time", "target_date")


@query(
    "typical_range_doy", "M4 J6",
    with_sql(FUTURE, RANGE) + " SELECT target_date, r.lo AS typical_low, r.hi AS typical_high FROM tr",
    "typical_low typical_high",
)
def _(spark, path):
    return MD.circular_range(star.city_daily(spark, path), _targets(spark, path), SPEC)


@query(
    "typical_range_every_day", "M4 J6",
    with_sql(CITY) + """, d AS (SELECT dayofyear(time) AS doy, sum(temperature_2m_min) AS lo, sum(temperature_2m_max) AS hi, count(*) AS n
        FROM city_cal WHERE temperature_2m_min IS NOT NULL AND temperature_2m_max IS NOT NULL GROUP BY 1),
      t AS (SELECT DISTINCT time AS target_date, dayofyear(time) AS tdoy FROM city_cal),
      m AS (SELECT tdoy, sum(lo) / sum(n) AS typical_low, sum(hi) / sum(n) AS typical_high
        FROM (SELECT DISTINCT tdoy FROM t) JOIN d ON least(abs(doy - tdoy), 365 - abs(doy - tdoy)) <= 7 GROUP BY tdoy)
      SELECT target_date, typical_low, typical_high FROM t LEFT JOIN m USING (tdoy)""",
    "typical_low typical_high",
)
def _(spark, path):
    daily = star.city_daily(spark, path)
    days = daily.select(F.col("time").alias("target_date")).distinct()
    return MD.circular_range(daily, days, SPEC)


CITY_FUTURE = f""" lastday AS (SELECT city, max(time) AS d FROM city_cal GROUP BY city),
fut AS (SELECT city, CAST(d + CAST(i AS INTEGER) AS DATE) AS time FROM lastday, range(1, {HORIZON + 1}) r(i)),
fc AS (SELECT f.city, f.time, c.p AS y_pred FROM fut f JOIN clim c ON f.city = c.city AND strftime(f.time, '%m-%d') = c.month_day)"""


def _city_forecast(spark, path):
    daily = C.with_year_month_day(star.city_daily(spark, path))
    last = daily.groupBy("city").agg(F.max("time").alias("d"))
    clim = C.daily_climatology(daily, SPEC, ("city",)).select("city", "month_day", F.col("climatology_temp_mean").alias("y_pred"))
    dates = FT.future_dates(last, "d", HORIZON, ("city",)).withColumn("month_day", F.date_format("time", "MM-dd"))
    return dates.join(clim, ["city", "month_day"]).drop("month_day")


@query(
    "bias_adjusted_forecast", "M5",
    with_sql(BIAS, CITY_FUTURE) + f""" SELECT city, time, y_pred, {', '.join(BIAS_COLS.split())}, n_ytd, n_recent,
      CASE WHEN n_ytd >= 7 THEN y_pred + recent_bias ELSE y_pred END AS adjusted, coalesce(n_ytd >= 7, false) AS is_adjusted
      FROM fc LEFT JOIN bias USING (city)""",
    "y_pred adjusted " + BIAS_COLS,
)
def _(spark, path):
    bias = MD.year_bias(city_pred(spark, path).filter(F.col("year") == CUR), ["city"], "time")
    return MD.bias_adjusted(_city_forecast(spark, path), bias, ["city"])


@query(
    "forecast_recent_fallback", "M3",
    with_sql(FUTURE, RECENT, RANGE) + """ SELECT city, target_date, CAST(NULL AS DOUBLE) AS model_temp, recent_mean, observed_days,
      recent_mean AS temperature, r.lo AS temp_low, r.hi AS temp_high, 'recent-observations' AS mode
      FROM rec JOIN tr ON true""",
    "model_temp recent_mean temperature temp_low temp_high",
)
@star.one_daily_pass
def _(spark, path):
    daily = star.city_daily(spark, path)
    recent = MD.recent_mean(daily, ["city"], "time", SPEC.temp)
    # every entity has its own last day; the forecast runs from the latest of all
    from_latest = recent.withColumn("d", daily.agg(F.max("time")).scalar())
    t = FT.future_dates(from_latest, "d", HORIZON, tuple(recent.columns)).withColumnRenamed("time", "target_date")
    t = t.withColumn("model_temp", F.lit(None).cast("double"))
    return MD.forecast_table(t, MD.circular_range(daily, t.select("target_date").distinct(), SPEC))


# The same fit in SQL: moments of every target with the inputs, eliminated column by column.
_N = len(INPUTS) + 1
_FILLED = "[1.0, " + ", ".join(f"coalesce({n}, (SELECT avg({n}) FROM features WHERE year < {TEST_FROM}))" for n in INPUTS) + "]"
MODEL = FEATURES + f""",
filled AS (SELECT time, year, {_FILLED} AS x, y, y_min, y_max FROM features),
goals AS (SELECT x, unnest(['y', 'y_min', 'y_max']) AS target, unnest([y, y_min, y_max]) AS v FROM filled WHERE year < {TEST_FROM}),
moments AS (SELECT target, i, j, sum(x[i] * list_append(x, v)[j]) AS m FROM goals, range(1, {_N + 1}) r(i), range(1, {_N + 2}) c(j)
  WHERE v IS NOT NULL GROUP BY target, i, j),
lines AS (SELECT target, i, list(m ORDER BY j) AS line FROM moments GROUP BY target, i),
solved AS (SELECT target, 1 AS k, list(line ORDER BY i) AS a FROM lines GROUP BY target
  UNION ALL SELECT target, k + 1, list_transform(a, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda z: z / line[k])
    ELSE list_transform(line, lambda z, j: z - line[k] * a[k][j] / a[k][k]) END) FROM solved WHERE k <= {_N}),
weights AS (SELECT target, list_transform(a, lambda line: line[{_N + 1}]) AS w FROM solved WHERE k = {_N + 1}),
w_y AS (SELECT w FROM weights WHERE target = 'y'), w_min AS (SELECT w FROM weights WHERE target = 'y_min'), w_max AS (SELECT w FROM weights WHERE target = 'y_max'),
modelled AS (SELECT time, year, y AS y_true, list_inner_product(x, (SELECT w FROM w_y)) AS y_pred, list_inner_product(x, (SELECT w FROM w_min)) AS y_min_pred,
  list_inner_product(x, (SELECT w FROM w_max)) AS y_max_pred FROM filled WHERE year >= {TEST_FROM})"""
_SEASON = ("sin(2 * pi() * dayofyear(time) / 365.0)", "cos(2 * pi() * dayofyear(time) / 365.0)", "(year(time) - 1991) / 30.0")
AHEAD = f""",
ahead_x AS (SELECT time, [1.0, {', '.join(_SEASON)}, {', '.join(f"(SELECT avg({n}) FROM features WHERE year < {TEST_FROM})" for n in INPUTS[3:])}] AS x FROM future),
ahead AS (SELECT time, list_inner_product(x, (SELECT w FROM w_y)) AS y_pred, list_inner_product(x, (SELECT w FROM w_min)) AS y_min_pred,
  list_inner_product(x, (SELECT w FROM w_max)) AS y_max_pred FROM ahead_x)"""


def recursive_sql(*parts: str) -> str:
    """One WITH RECURSIVE clause; a block that several parts begin with is written once."""
    return "WITH RECURSIVE " + ",".join(p.strip().removeprefix(",") for p in parts)


def _fitted(spark, path):
    train, test = FT.chronological_split(features(spark, path), TEST_FROM)
    contract = FT.fit_contract(train, INPUTS)
    return MD.fit_regressors(train, contract), contract, test


@query(
    "fit_regressors", "M1",
    recursive_sql(MODEL) + " " + " UNION ALL ".join(
        f"SELECT target, '{n}' AS feature, w[{i}] AS coefficient FROM weights" for i, n in enumerate(("intercept", *INPUTS), 1)),
    "coefficient",
)
@star.one_daily_pass
def _(spark, path):
    models, contract, _ = _fitted(spark, path)
    return MD.coefficients(spark, models, contract)


@query(
    "fit_normal_equations", "M1 M2",
    with_sql(FEATURES) + f", tr AS (SELECT *, 1.0 AS intercept FROM features WHERE year < {TEST_FROM}) " + " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{n}' AS feature, avg({n} * {t}) AS moment, avg({n} * {t}) AS fitted_moment FROM tr"
        for t in FT.TARGETS for n in ("intercept", *INPUTS)),
    "moment fitted_moment",
)
@star.one_daily_pass
def _(spark, path):
    # at the least-squares solution, and only there, the fitted values have the targets' moments with every input
    models, contract, _ = _fitted(spark, path)
    train, _ = FT.chronological_split(features(spark, path), TEST_FROM)
    scored = MD.score(train, models, contract, FT.TARGETS).withColumn("intercept", F.lit(1.0))
    names = {"y": "y_pred", "y_min": "y_min_pred", "y_max": "y_max_pred"}
    cells = [
        F.struct(F.lit(t).alias("target"), F.lit(n).alias("feature"), F.avg(F.col(t) * F.col(n)).alias("moment"),
                 F.avg(F.col(names[t]) * F.col(n)).alias("fitted_moment"))
        for t in FT.TARGETS for n in ("intercept", *contract.columns)
    ]
    one = scored.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return one.select(F.explode(F.array(*one.columns)).alias("c")).select("c.*")


@query(
    "batch_predictions", "M2",
    recursive_sql(MODEL) + " SELECT time, y_true, y_pred, y_true - y_pred AS residual, y_min_pred, y_max_pred FROM modelled",
    "y_true y_pred residual y_min_pred y_max_pred",
)
@star.one_daily_pass
def _(spark, path):
    models, contract, test = _fitted(spark, path)
    return MD.predictions(test, models, contract, ("time",))


@query(
    "forecast_days", "M3 F7 M2",
    recursive_sql(MODEL, FUTURE.removeprefix(REGION), AHEAD) + """ SELECT time AS target_date, y_pred AS model_temp, y_min_pred AS model_low, y_max_pred AS model_high,
      y_pred AS temperature, y_min_pred AS temp_low, y_max_pred AS temp_high, 'model' AS mode FROM ahead""",
    "model_temp model_low model_high temperature temp_low temp_high",
)
@star.one_daily_pass
def _(spark, path):
    models, contract, _ = _fitted(spark, path)
    daily = star.city_daily(spark, path)
    names = {"time": "target_date", "y_pred": "model_temp", "y_min_pred": "model_low", "y_max_pred": "model_high"}
    scored = MD.score(FT.future_features(future(spark, path), contract), models, contract, ("time",))
    t = scored.select(*[F.col(a).alias(b) for a, b in names.items()]).withColumn("recent_mean", F.lit(None).cast("double"))
    return MD.forecast_table(t, MD.circular_range(daily, t.select("target_date"), SPEC)).drop("recent_mean")


# selections ---------------------------------------------------------------------------------------

@query(
    "best_and_runner_up_month", "T-4",
    with_sql(MATRIX) + """, r AS (SELECT city, year, month, round(anomaly, 6) AS anomaly FROM matrix WHERE anomaly IS NOT NULL),
      w AS (SELECT *, 'warmest' AS extreme, row_number() OVER (PARTITION BY city, year ORDER BY anomaly DESC, month) AS rank FROM r
        UNION ALL SELECT *, 'coldest', row_number() OVER (PARTITION BY city, year ORDER BY anomaly, month) FROM r)
      SELECT city, year, month, anomaly, extreme, CAST(rank AS INTEGER) AS rank FROM w WHERE rank <= 2""",
    "anomaly",
)
def _(spark, path):
    m = climate.matrix(spark, path).withColumn("anomaly", F.round("anomaly", 6))
    return SEL.extreme_months(m, "city").select("city", "year", "month", "anomaly", "extreme", "rank")


@query(
    "top_anomalies", "T-6 P8",
    with_sql(MATRIX) + """ SELECT city, year, month, anomaly, z_score FROM matrix WHERE abs(anomaly) <= 15 AND abs(z_score) <= 6
      ORDER BY abs(round(anomaly, 6)) DESC, city, year, month LIMIT 10""",
    "anomaly z_score",
)
def _(spark, path):
    m = climate.matrix(spark, path)
    ok = m.filter(reasonable_temperature_signal(F.col("anomaly"), F.col("z_score")))
    return SEL.top_by_abs(ok, "anomaly", 10, ["city", "year", "month"]).select("city", "year", "month", "anomaly", "z_score")


@query(
    "top_residuals", "T-6",
    with_sql(CITY_PRED) + " SELECT city, time, y_true, y_pred, residual FROM pred ORDER BY abs(round(residual, 6)) DESC, city, time LIMIT 5",
    "y_true y_pred residual",
)
def _(spark, path):
    return SEL.top_by_abs(city_pred(spark, path), "residual", 5, ["city", "time"]).select("city", "time", "y_true", "y_pred", "residual")


@query(
    "decade_extremes", "T-7",
    with_sql(CITY, summaries._annual_sql("city_ytd", "city")) + """ SELECT city, arg_max(year, ytd_mean_temp) AS warmest_year,
      max(ytd_mean_temp) AS warmest, arg_min(year, ytd_mean_temp) AS coldest_year, min(ytd_mean_temp) AS coldest
      FROM (SELECT * FROM annual QUALIFY row_number() OVER (PARTITION BY city ORDER BY year DESC) <= 10) GROUP BY city""",
    "warmest coldest",
)
def _(spark, path):
    return SEL.recent_extremes(summaries.city_annual(spark, path), ["city"], "ytd_mean_temp", 10)


@query(
    "latest_month_extreme_entities", "T-8",
    with_sql(climate.CITY_MONTHLY) + """, ok AS (SELECT * FROM monthly_anom WHERE abs(temp_anomaly) <= 15 AND abs(temp_zscore) <= 6)
      SELECT year, month, arg_max(city, temp_zscore) AS warmest_city, max(temp_zscore) AS warmest_z,
      arg_min(city, temp_zscore) AS coldest_city, min(temp_zscore) AS coldest_z, count(*) AS entities
      FROM ok GROUP BY year, month HAVING count(*) >= 2 ORDER BY year DESC, month DESC LIMIT 1""",
    "warmest_z coldest_z",
)
def _(spark, path):
    m = climate.city_monthly(spark, path)
    ok = m.filter(reasonable_temperature_signal(F.col("temp_anomaly"), F.col("temp_zscore")))
    return SEL.latest_month_extremes(ok, "city", "temp_zscore")


@query(
    "year_on_year", "W7",
    with_sql(CITY, summaries._annual_sql("city_ytd", "city")) + """ SELECT city, year, ytd_mean_temp,
      lag(ytd_mean_temp) OVER w AS previous, ytd_mean_temp - lag(ytd_mean_temp) OVER w AS change
      FROM annual WINDOW w AS (PARTITION BY city ORDER BY year)""",
    "ytd_mean_temp previous change",
)
def _(spark, path):
    return SEL.year_on_year(summaries.city_annual(spark, path), ["city"], "ytd_mean_temp").select(
        "city", "year", "ytd_mean_temp", "previous", "change")


@query(
    "positives_last_ten_years", "A31",
    with_sql(summaries.SLICES) + """ SELECT city, month, count(*) FILTER (WHERE round(anomaly_c, 6) > 0) AS positive, count(*) AS years
      FROM (SELECT * FROM slices QUALIFY row_number() OVER (PARTITION BY city, month ORDER BY year DESC) <= 10) GROUP BY city, month""",
)
def _(spark, path):
    s = summaries.slices(spark, path).withColumn("anomaly_c", F.round("anomaly_c", 6))
    return SEL.positives_among_last(s, ["city", "month"], "anomaly_c", 10)


@query(
    "month_vs_other_years", "J5",
    with_sql(summaries.SLICES) + """, l AS (SELECT city, month, max(year) AS latest FROM slices GROUP BY ALL)
      SELECT a.city, a.month, a.year AS latest_year, b.year AS other_year, a.mean_temp_c AS latest_temp, b.mean_temp_c AS other_temp,
      a.mean_temp_c - b.mean_temp_c AS delta FROM slices a JOIN l ON a.city = l.city AND a.month = l.month AND a.year = l.latest
      JOIN slices b ON a.city = b.city AND a.month = b.month AND b.year <> a.year""",
    "latest_temp other_temp delta",
)
def _(spark, path):
    return SEL.latest_versus_others(summaries.slices(spark, path), ["city", "month"], "mean_temp_c").select(
        "city", "month", "latest_year", "other_year", "latest_temp", "other_temp", "delta")


@query(
    "share_of_latest_year", "J4",
    with_sql(MATRIX) + """ SELECT city, month, mean_temp, (SELECT avg(mean_temp) FROM monthly) AS overall_mean,
      mean_temp - (SELECT avg(mean_temp) FROM monthly) AS gap FROM monthly WHERE year = (SELECT max(year) FROM monthly)""",
    "mean_temp overall_mean gap",
)
def _(spark, path):
    # scalar sub-queries: one value each, no join
    m = C.monthly_means(star.city_daily(spark, path), SPEC)
    overall = m.agg(F.avg("mean_temp")).scalar()
    latest = m.agg(F.max("year")).scalar()
    return m.filter(F.col("year") == latest).select(
        "city", "month", "mean_temp", overall.alias("overall_mean"), (F.col("mean_temp") - overall).alias("gap"))


# gates ----------------------------------------------------------------------------------------------

def _gate_sql(facts: str, keys: str, checks: list[tuple[str, str, float, str]]) -> str:
    k = f"{keys}, " if keys else ""
    reason = "CASE " + " ".join(f"WHEN NOT coalesce({ok}, true) THEN '{n}'" for n, _, _, ok in checks) + " END"
    return " UNION ALL ".join(
        f"SELECT {k}'{n}' AS \"check\", CAST({v} AS DOUBLE) AS value, CAST({t} AS DOUBLE) AS threshold, coalesce({ok}, true) AS passed, "
        f"{reason} AS first_failure FROM {facts}" for n, v, t, ok in checks)


COUNTERS = """ counters AS (SELECT {k} count(*) FILTER (WHERE days < {d} AND month < m) AS n_weak_months,
  count(*) FILTER (WHERE abs(temp_zscore) > {tz}) AS n_extreme_temp_months,
  count(*) FILTER (WHERE abs(precip_zscore) > {pz}) AS n_extreme_precip_months
  FROM (SELECT *, max(month) OVER ({p}) AS m FROM monthly_anom) {g})"""
GATE_CHECKS = [
    ("days_observed", "days_observed", 10, "days_observed >= 10"),
    ("temp_zscore", "temp_zscore", 5, "abs(temp_zscore) <= 5"),
    ("precip_zscore", "precip_zscore", 5, "abs(precip_zscore) <= 5"),
    ("weak_months", "n_weak_months", 0, "n_weak_months = 0"),
    ("extreme_temp_months", "n_extreme_temp_months", 0, "n_extreme_temp_months = 0"),
    ("extreme_precip_months", "n_extreme_precip_months", 0, "n_extreme_precip_months = 0"),
]
_BY_CITY = climate._monthly_sql("city_ytd", "city").strip() + "," + summaries._annual_sql("city_ytd", "city") + "," + summaries._summary_sql("city")
_BY_REGION = climate._monthly_sql("region_ytd", "").strip() + "," + summaries._annual_sql("region_ytd", "") + "," + summaries._summary_sql("")


@query(
    "weather_gate", "Q1",
    with_sql(CITY, _BY_CITY, COUNTERS.format(k="city,", d=5, tz=3.5, pz=3.5, p="PARTITION BY city", g="GROUP BY city"),
             " facts AS (SELECT * FROM summary JOIN counters USING (city))") + " " + _gate_sql("facts", "city", GATE_CHECKS),
    "value threshold",
)
def _(spark, path):
    return G.weather_gate(summaries.city_summary(spark, path), climate.city_monthly(spark, path), ["city"])


@query(
    "weather_gate_region", "Q1",
    with_sql(REGION, _BY_REGION, COUNTERS.format(k="", d=5, tz=3.5, pz=3.5, p="", g=""),
             " facts AS (SELECT * FROM summary, counters)") + " " + _gate_sql("facts", "", GATE_CHECKS),
    "value threshold",
)
def _(spark, path):
    return G.weather_gate(summaries.region_summary(spark, path), climate.region_monthly(spark, path), [])


@query(
    "gate_counters", "Q4",
    with_sql(climate.CITY_MONTHLY, COUNTERS.format(k="city,", d=28, tz=1.0, pz=1.0, p="PARTITION BY city", g="GROUP BY city"))
    + " SELECT * FROM counters",
)
def _(spark, path):
    return G.month_counters(climate.city_monthly(spark, path), ["city"], 28, 1.0, 1.0)


@query(
    "model_gate", "Q2",
    with_sql(CITY_PRED) + ", facts AS (" + METRICS.format(k="city,", g="GROUP BY city") + ") " + _gate_sql(
        "facts", "city", [("mse", "mse", 50, "mse <= 50"), ("r2", "r2", 0.65, "r2 >= 0.65")]),
    "value threshold",
)
def _(spark, path):
    return G.model_gate(MD.regression_metrics(city_pred(spark, path), ("city",)), ["city"])


@query(
    "month_slice_gate", "Q3",
    with_sql(summaries.SLICES) + """, facts AS (SELECT city, month, count(*) AS years, min(days_observed) AS min_days,
      max(abs(zscore)) AS max_z FROM slices GROUP BY city, month) """ + _gate_sql("facts", "city, month", [
        ("years_included", "years", 6, "years = 6"), ("min_days", "min_days", 25, "min_days >= 25"),
        ("max_abs_z", "max_z", 1.9, "round(max_z, 9) <= 1.9")]),
    "value threshold",
)
def _(spark, path):
    return G.month_slice_gate(summaries.slices(spark, path), ["city", "month"], 6, 25, 1.9)


@query(
    "short_history_tag", "Q5",
    with_sql(CITY) + """, h AS (SELECT city, count(DISTINCT year) AS years FROM city_cal WHERE temperature_2m_mean > 18 GROUP BY city)
      SELECT city, years, CASE WHEN years < 5 THEN 'only ' || years || ' year(s) of history' END AS data_quality_warning FROM h""",
)
def _(spark, path):
    warm = star.city_daily(spark, path).filter(F.col(SPEC.temp) > 18)
    return G.short_history_tag(warm.groupBy("city").agg(F.count_distinct(F.year("time")).alias("years")), "years")


# run ledger: orders play the runs, their status the run name ------------------------------------------

LEDGER = """WITH runs AS (SELECT o_orderstatus AS name, o_orderkey AS run_id, o_orderdate AS start_time,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice / 1e6 END AS r2, o_totalprice / 1e5 AS rmse FROM orders)"""


def _runs(spark, path):
    o = star.table(spark, path, "orders")
    r2 = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 1e6)
    rmse = F.create_map(F.lit("test_rmse"), F.col("o_totalprice") / 1e5)
    metrics = F.when(r2.isNotNull(), F.map_concat(rmse, F.create_map(F.lit("test_r2"), r2))).otherwise(rmse)
    return o.select(F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("run_id"),
                    F.col("o_orderdate").alias("start_time"), metrics.alias("metrics"))


@query(
    "run_history", "T-10",
    LEDGER + """ SELECT run_id, CAST(start_time AS DATE) AS date, r2, rmse FROM
      (SELECT * FROM runs WHERE name = 'F') WHERE r2 IS NOT NULL""",
    "r2 rmse",
)
def _(spark, path):
    h = L.run_history(_runs(spark, path), "F", ["test_r2", "test_rmse"])
    return h.select("run_id", F.to_date("start_time").alias("date"),
                    F.col("metrics")["test_r2"].alias("r2"), F.col("metrics")["test_rmse"].alias("rmse"))


@query(
    "newest_run", "T-10",
    LEDGER + """ SELECT name, run_id, CAST(start_time AS DATE) AS date, rmse FROM runs
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY start_time DESC, run_id DESC) = 1""",
    "rmse",
)
def _(spark, path):
    return L.newest_run(_runs(spark, path)).select(
        "name", "run_id", F.to_date("start_time").alias("date"), F.col("metrics")["test_rmse"].alias("rmse"))


def _versions(spark, path):
    li = star.table(spark, path, "lineitem")
    return li.select(F.col("l_suppkey").alias("model"), F.col("l_orderkey").alias("run_id"),
                     F.col("l_linenumber").alias("version"), (F.col("l_extendedprice") < 20000).alias("passed"))


@query(
    "champion_version", "T-11",
    """WITH v AS (SELECT l_suppkey AS model, l_orderkey AS run_id, l_linenumber AS version, l_extendedprice < 20000 AS passed FROM lineitem)
      SELECT model, version, run_id FROM v WHERE passed
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC, run_id DESC) = 1""",
)
def _(spark, path):
    return L.champion(_versions(spark, path))


@query(
    "version_for_run", "T-11",
    "SELECT l_suppkey AS model, l_orderkey AS run_id, max(l_linenumber) AS version FROM lineitem GROUP BY ALL",
)
def _(spark, path):
    return L.version_for_run(_versions(spark, path))


@query(
    "promotion_ledger", "T-11",
    """WITH p AS (SELECT l_suppkey AS model, l_linenumber AS version, max(l_orderkey) AS run_id FROM lineitem WHERE l_extendedprice < 20000 GROUP BY ALL)
      SELECT model, 'champion' AS alias, version, run_id, lag(version) OVER w AS previous_version, lead(version) OVER w IS NULL AS current,
        'passed' AS quality_gate, 'champion' AS promoted_alias FROM p WINDOW w AS (PARTITION BY model ORDER BY version)""",
)
def _(spark, path):
    p = L.promotions(_versions(spark, path))
    return p.withColumns({t: F.col("tags")[t] for t in ("quality_gate", "promoted_alias")}).drop("tags")
