"""SQL of the templated texts: fine-tuning examples builder by builder, and the corpus documents.

The wording is the output format, so it stands here a second time.
"""

from __future__ import annotations

from tempora.catalog import climate, models, summaries
from tempora.catalog.base import B0, B1, CITY, MATRIX, SPEC, with_sql

CUR, PERIOD = SPEC.current_year, f"01-01 to {SPEC.cutoff}"


def num(c: str, digits: int = 2, plus: bool = False, absolute: bool = False) -> str:
    """A figure with fixed decimals; NULL stays NULL."""
    return f"printf('%{'+' if plus else ''}.{digits}f', {'abs' if absolute else ''}(round({c}, {digits})) + 0.0)"


def tone(c: str, up: str, down: str) -> str:
    return f"CASE WHEN {c} > 0 THEN '{up}' ELSE '{down}' END"


def precip(before: str, between: str, after: str = "", deviation: str = "precip_anomaly", z: str = "precip_zscore") -> str:
    z_part = f" || {num(z, 2, True)} || '{after}'" if after else ""
    return (f"CASE WHEN abs(round({deviation}, 1)) <= 600 AND abs(round({z}, 2)) <= 8 THEN '{before}' || {num(deviation, 1, True)} || '{between}'{z_part} ELSE '' END")


def pair(instruction: str, output: str, rows: str) -> str:
    return f"SELECT {instruction} AS instruction, {output} AS output FROM {rows}"


def both(*parts: str) -> str:
    return " UNION ALL ".join(parts)


OK_YTD = "abs(temp_deviation) <= 15 AND abs(temp_zscore) <= 6"
OK_MONTH = "abs(round(temp_anomaly, 2)) <= 15 AND abs(round(temp_zscore, 2)) <= 6"
MONTH = "monthname(make_date(2000, CAST(month AS INTEGER), 1))"
_HEAD = "CASE WHEN abs(temp_zscore) > 1.5 THEN 'significantly ' ELSE '' END || " + tone("temp_deviation", "warmer", "colder")
_SCORED = summaries.CITY_SUMMARY + ", scored AS (SELECT *, greatest(abs(temp_zscore), abs(precip_zscore)) AS score FROM summary)"
OK_SLICES = summaries.SLICES + """,
ok AS (SELECT * FROM slices WHERE abs(mean_temp_c) <= 25 AND abs(anomaly_c) <= 15 AND abs(zscore) <= 6),
ranked AS (SELECT *, round(anomaly_c, 2) AS a, row_number() OVER (PARTITION BY city, month ORDER BY year DESC) AS rn FROM ok),
facts AS (SELECT city, month, count(*) AS n, max(year) AS y, arg_max(round(mean_temp_c, 2), year) AS t, arg_max(a, year) AS la, arg_max(round(zscore, 2), year) AS lz,
  arg_max(year, {'a': a, 'y': -year}) AS hot_year, max(a) AS hot, arg_min(year, {'a': a, 'y': year}) AS cold_year, min(a) AS cold,
  count(*) FILTER (rn <= 10 AND a > 0) AS positive FROM ranked GROUP BY city, month)"""
_GRADE = "CASE WHEN r2 > 0.7 THEN 'good' WHEN r2 > 0.5 THEN 'moderate' ELSE 'poor' END"
_METRICS = models.CITY_PRED + ", metrics AS (" + models.METRICS.format(k="", g="").strip() + ")"

#: (instruction, output) of every builder over the result tables.
SFT = {
    "ytd": with_sql(summaries.REGION_SUMMARY) + " " + both(
        pair("'Summarize the region year-to-date weather anomaly signal.'",
             f"'For {PERIOD}, the region is ' || {_HEAD} || ' than the baseline by ' || {num('temp_deviation', absolute=True)} || ' C (z=' || {num('temp_zscore', plus=True)} || ').' || "
             + precip(" Precipitation deviation is ", " mm (z=", ").", "precip_deviation"), f"summary WHERE {OK_YTD}"),
        pair("'Is the region currently warmer or colder than normal this year?'",
             f"'the region is ' || {_HEAD} || ' than normal in {PERIOD}: temperature anomaly ' || {num('temp_deviation', plus=True)} || ' C, z-score ' || {num('temp_zscore', plus=True)} || '.'",
             f"summary WHERE {OK_YTD}")),
    "entity_ytd": with_sql(summaries.CITY_SUMMARY) + " " + pair(
        "'Summarize the year-to-date temperature anomaly for ' || city || '.'",
        f"city || ' is ' || {tone('temp_deviation', 'warmer', 'colder')} || ' than the baseline by ' || {num('temp_deviation', absolute=True)} || ' C (z=' || {num('temp_zscore', plus=True)} || ') year-to-date.'",
        f"summary WHERE {OK_YTD}"),
    "ranking": with_sql(_SCORED) + """, top AS (SELECT * FROM scored ORDER BY score DESC, city LIMIT 1), low AS (SELECT city AS low_city, score AS low_score FROM scored ORDER BY score, city DESC LIMIT 1),
      hot AS (SELECT * FROM scored WHERE temp_zscore IS NOT NULL ORDER BY abs(temp_zscore) DESC, city LIMIT 1) """ + both(
        pair("'Which city currently has the strongest combined anomaly signal?'",
             f"'The strongest combined anomaly is in ' || city || ' (score ' || {num('score', plus=True)} || '). The weakest is ' || low_city || ' (score ' || {num('low_score', plus=True)} || ').'",
             "top, low WHERE score <= 15 AND low_score <= 15"),
        pair("'Which city has the most extreme temperature anomaly right now?'",
             f"city || ' has the most extreme temperature z-score at ' || {num('temp_zscore', plus=True)} || '.'", f"hot WHERE {OK_YTD}")),
    "annual_trend": with_sql(climate.REGION, summaries._annual_sql("region_ytd", "")) + """, r AS (SELECT year, round(ytd_mean_temp, 2) AS t, row_number() OVER (ORDER BY year DESC) AS rn, count(*) OVER () AS n FROM annual),
      f AS (SELECT max(year) AS y, max(t) FILTER (rn = 1) AS cur, max(year) FILTER (rn = 2) AS py, max(t) FILTER (rn = 2) AS prev, arg_max(year, {'t': t, 'y': -year}) AS wy, max(t) AS w,
        arg_min(year, {'t': t, 'y': year}) AS cy, min(t) AS c FROM r WHERE n >= 5 AND rn <= 10 HAVING count(*) > 0),
      g AS (SELECT *, round(cur - prev, 2) AS diff FROM f) """ + both(
        pair("'How does the ' || y || ' YTD temperature compare to ' || py || '?'",
             f"y || ' YTD mean temp is ' || {num('cur')} || ' C vs ' || {num('prev')} || ' C in ' || py || ', so ' || y || ' is ' || {num('diff', absolute=True)} || ' C ' || {tone('diff', 'warmer', 'colder')} || ' year-on-year.'", "g"),
        pair("'Which year in the last decade had the warmest and coldest YTD temperature?'",
             f"'In the last decade, ' || wy || ' was warmest (' || {num('w')} || ' C YTD) and ' || cy || ' was coldest (' || {num('c')} || ' C YTD).'", "g")),
    "latest_month": with_sql(climate.CITY_MONTHLY) + """, ok AS (SELECT * FROM monthly_anom WHERE abs(temp_anomaly) <= 15 AND abs(temp_zscore) <= 6),
      f AS (SELECT year, month, arg_max(city, temp_zscore) AS w, max(temp_zscore) AS wz, arg_min(city, temp_zscore) AS c, min(temp_zscore) AS cz FROM ok
        GROUP BY year, month HAVING count(*) >= 2 ORDER BY year DESC, month DESC LIMIT 1) """ + pair(
        "'Which city was warmest and coldest relative to normal in month ' || month || ' of ' || year || '?'",
        f"'In month ' || month || '/' || year || ', ' || w || ' was most above normal (z=' || {num('wz', plus=True)} || ') and ' || c || ' was most below normal (z=' || {num('cz', plus=True)} || ').'", "f"),
    "region_month": with_sql(climate.REGION_MONTHLY) + " " + pair(
        "'Describe the national weather anomaly for the region in month ' || month || ' of ' || year || '.'",
        f"'the region month ' || month || '/' || year || ': temperature was ' || {tone('temp_anomaly', 'above', 'below')} || ' normal by ' || {num('temp_anomaly', absolute=True)} || ' C (z='"
        f" || {num('temp_zscore', plus=True)} || ');' || {precip(' precipitation anomaly ', ' mm.')}", f"monthly_anom WHERE {OK_MONTH}"),
    "rolling": with_sql(summaries.CITY_LATEST) + " " + pair(
        "'What is the recent temperature trend for ' || city || '?'",
        f"'As of ' || CAST(latest_time AS VARCHAR) || ', ' || city || ' has a 7-day rolling temperature anomaly of ' || {num('latest_7d_temp_anomaly', plus=True)} || ' C and a 30-day rolling anomaly of '"
        f" || {num('latest_30d_temp_anomaly', plus=True)} || ' C.'", "latest WHERE abs(latest_7d_temp_anomaly) <= 15 AND abs(latest_30d_temp_anomaly) <= 15"),
    "slice": with_sql(OK_SLICES) + f""", s AS (SELECT city, month, max(year) AS end_year, max(cutoff_day) AS cut, avg(mean_temp_c) AS bm, coalesce(stddev_samp(mean_temp_c), 0.0) AS bs FROM slices GROUP BY city, month),
      last AS (SELECT city, month, max(year) AS y, arg_max(anomaly_c, year) AS a, arg_max(zscore, year) AS z FROM ok GROUP BY city, month),
      j AS (SELECT s.*, y, a, z, greatest(1, least(cut, day(last_day(make_date(CAST(end_year AS INTEGER), CAST(s.month AS INTEGER), 1))))) AS cutoff_day, city || ' ' || {MONTH} AS who
        FROM s LEFT JOIN last USING (city, month)) """ + pair(
        "'Describe the ' || who || ' anomaly for the latest year.'",
        f"CASE WHEN y IS NOT NULL THEN who || ' ' || y || ' (through day ' || cutoff_day || '): temperature anomaly ' || {num('a', plus=True)} || ' C (z=' || {num('z', plus=True)} || ') '"
        f" || {tone('a', 'above', 'below')} || ' the ' || {num('bm')} || ' C baseline.' ELSE who || ' latest year is ' || end_year || '. Baseline mean: ' || {num('bm')} || ' C (std ' || {num('bs')} || ' C).' END", "j"),
    "slice_trend": with_sql(OK_SLICES) + " " + both(
        pair(f"'How unusual is this ' || {MONTH} || ' in ' || city || ' compared to history?'",
             f"city || ' ' || {MONTH} || ' ' || y || ' anomaly is ' || {num('la', plus=True)} || ' C (z=' || {num('lz', plus=True)} || '). Historically, the warmest ' || {MONTH} || ' was ' || hot_year || ' ('"
             f" || {num('hot', plus=True)} || ' C) and coldest was ' || cold_year || ' (' || {num('cold', plus=True)} || ' C). In the last 10 years, ' || positive || '/10 were above normal.'", "facts WHERE n >= 5"),
        pair(f"'Is ' || city || ' ' || {MONTH} || ' showing a long-term warming trend?'",
             f"'Over the recorded period, ' || positive || ' of the last 10 in ' || city || ' were above the baseline. The most recent year (' || y || ') shows an anomaly of ' || {num('la', plus=True)}"
             f" || ' C (z=' || {num('lz', plus=True)} || ').'", "facts WHERE n >= 5")),
    "slice_comparison": with_sql(OK_SLICES) + """, p AS (SELECT f.*, o.year AS oy, o.mean_temp_c AS ot, round(t - round(o.mean_temp_c, 2), 2) AS diff FROM facts f JOIN ok o USING (city, month) WHERE n >= 2 AND o.year <> y) """ + pair(
        f"'Is this ' || {MONTH} || ' in ' || city || ' warmer than ' || oy || '? Give a yes/no answer with the degree difference.'",
        f"CASE WHEN diff > 0 THEN 'Yes, ' ELSE 'No, ' END || {MONTH} || ' ' || y || ' (' || {num('t')} || ' C) is ' || {tone('diff', 'warmer', 'colder')} || ' than ' || {MONTH} || ' ' || oy || ' (' || {num('ot')}"
        f" || ' C) by ' || {num('diff', absolute=True)} || ' C.'", "p"),
    "model": with_sql(_METRICS) + " " + both(
        pair("'Evaluate model quality from metrics.'",
             f"'The climate model has ' || {_GRADE} || ' fit: R2=' || {num('r2', 4)} || ', RMSE=' || {num('rmse', 4)} || ' C, MAE=' || {num('mae', 4)} || ' C on held-out data.'", "metrics"),
        pair("'Can you trust the climate model predictions?'",
             f"'The model achieves R2=' || {num('r2', 4)} || ' (' || {_GRADE} || ' fit), meaning it explains ' || {num('round(r2, 4) * 100', 1)} || '% of temperature variance. Typical error is ' || {num('mae')} || ' C (MAE).'", "metrics")),
    "residual": with_sql(models.CITY_PRED) + """, w AS (SELECT *, abs(round(residual, 6)) AS size FROM pred ORDER BY size DESC, city, time LIMIT 5),
      f AS (SELECT avg(abs(round(residual, 2))) AS av, arg_max({'r': residual, 'p': y_pred, 't': y_true}, size) AS x FROM w HAVING count(*) > 0) """ + pair(
        "'Where does the climate model make its largest prediction errors?'",
        f"'The 5 largest prediction errors average ' || {num('av')} || ' C. The worst case has a residual of ' || {num('x.r', plus=True)} || ' C (predicted ' || {num('x.p')} || ' C, actual ' || {num('x.t')} || ' C).'", "f"),
    "matrix": with_sql(MATRIX) + f""", l AS (SELECT * FROM matrix QUALIFY year = max(year) OVER (PARTITION BY city)),
      f AS (SELECT city, year, string_agg('month ' || month || ': ' || {num('anomaly', plus=True)} || ' C', '; ' ORDER BY month) AS pattern FROM l WHERE abs(anomaly) <= 15 GROUP BY city, year) """ + pair(
        "'Summarize ' || city || ' regional monthly anomalies for ' || year || '.'", "'For ' || city || ' in ' || year || ', monthly anomaly pattern: ' || pattern || '.'", "f"),
    "strongest": with_sql(MATRIX) + f""", w AS (SELECT *, abs(round(anomaly, 6)) AS size FROM matrix WHERE abs(anomaly) <= 15 AND abs(z_score) <= 6 ORDER BY size DESC, city, year, month LIMIT 10),
      f AS (SELECT string_agg(city || ' ' || year || '-' || month || ': ' || {num('anomaly', plus=True)} || ' C (z=' || {num('z_score', plus=True)} || ')', '; ' ORDER BY size DESC, city, year, month) AS listed FROM w HAVING count(*) > 0) """ + pair(
        "'Identify strongest regional monthly anomaly signals.'", "'Top anomaly signals: ' || listed || '.'", "f"),
}


# corpus ---------------------------------------------------------------------------------------------------------------

def _n(c: str, digits: int = 2, plus: bool = False) -> str:
    return f"coalesce({num(c, digits, plus)}, 'n/a')"


def _sub(sql: str, alias: str = "q") -> str:
    return f"({sql}) AS {alias}"


_SLUG = f"replace(lower(city), ' ', '-') || '-' || lower({MONTH})"
_SLICE_FACTS = with_sql(summaries.SLICES) + """, s AS (SELECT city, month, min(year) AS y0, max(year) AS y1, count(*) AS n, max(cutoff_day) AS cut, avg(mean_temp_c) AS bm, coalesce(stddev_samp(mean_temp_c), 0.0) AS bs,
  arg_max(mean_temp_c, year) AS t, arg_max(anomaly_c, year) AS a, arg_max(zscore, year) AS z, arg_max(year, anomaly_c) AS wy, max(anomaly_c) AS wa, arg_min(year, anomaly_c) AS cy, min(anomaly_c) AS ca
  FROM slices GROUP BY city, month), sc AS (SELECT *, greatest(1, least(cut, day(last_day(make_date(CAST(y1 AS INTEGER), CAST(month AS INTEGER), 1))))) AS cutoff FROM s)"""
_REGION_FACTS = (with_sql(summaries.REGION_SUMMARY) + " SELECT * FROM summary", with_sql(summaries.REGION_LATEST) + " SELECT * FROM latest")


def corpus_sql(threshold_days: str, degree_ytd: str, degree_season: str) -> str:
    """id, title, source, text of the corpus; the arguments are registered SQL of its tables."""
    scored = with_sql(_SCORED)
    paragraphs = lambda name, parts: both(*[
        f"SELECT 'report-' || {name} || '-{i}' AS id, {name} || ' narrative {i}' AS title, 'report' AS source, {p} AS text" for i, p in enumerate(parts, 1)])
    slice_report = [
        f"city || ' ' || {MONTH} || ' Temperature Anomalies'",
        f"'Window: ' || y0 || ' to ' || y1 || ' ' || {MONTH} || ' day cutoff used for every year: ' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(CAST(cutoff AS VARCHAR), 2, '0') || ' Years analyzed: ' || n",
        "'Baseline'"]
    capital = "array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ')"
    parts = [
        f"""SELECT 'weather-overview' AS id, 'Region YTD weather overview' AS title, 'ytd_summary' AS source, 'Region year-to-date weather for {PERIOD} shows a temperature anomaly of ' || {_n('temp_deviation')}
          || ' C with z-score ' || {_n('temp_zscore')} || '. Precipitation anomaly is ' || {_n('precip_deviation', 1)} || ' mm with z-score ' || {_n('precip_zscore')} || '. The latest 7-day temperature anomaly is '
          || {_n('latest_7d_temp_anomaly')} || ' C.' AS text FROM {_sub(_REGION_FACTS[0], 'r')}, {_sub(_REGION_FACTS[1], 'l')}""",
        f"""SELECT * FROM ({scored}, t AS (SELECT * FROM scored WHERE temp_zscore IS NOT NULL ORDER BY abs(temp_zscore) DESC, city LIMIT 1), p AS (SELECT * FROM scored WHERE precip_zscore IS NOT NULL ORDER BY abs(precip_zscore) DESC, city LIMIT 1),
          c AS (SELECT * FROM scored ORDER BY score DESC, city LIMIT 1) SELECT 'weather-city-rankings' AS id, 'City anomaly rankings' AS title, 'entity_rankings' AS source, 'The strongest temperature signal is ' || t.city || ' with anomaly '
          || {_n('t.temp_deviation')} || ' and z-score ' || {_n('t.temp_zscore')} || '. The strongest precipitation signal is ' || p.city || ' with anomaly ' || {_n('p.precip_deviation')} || ' and z-score ' || {_n('p.precip_zscore')}
          || '. The highest combined anomaly ranking is ' || c.city || ' with combined score ' || {_n('c.score')} || '.' AS text FROM t, p, c)""",
        f"""SELECT * FROM ({_SLICE_FACTS} SELECT {_SLUG} || '-overview' AS id, city || ' ' || {MONTH} || ' anomaly overview' AS title, 'month_slices' AS source, city || ' ' || {MONTH} || ' through day ' || cutoff || ' in ' || y1
          || ' has mean temperature ' || {_n('t')} || ' C, an anomaly of ' || {_n('a')} || ' C, and z-score ' || {_n('z')} || '. The baseline mean is ' || {_n('bm')} || ' C with standard deviation ' || {_n('bs')} || ' C.' AS text FROM sc
          UNION ALL SELECT {_SLUG} || '-extremes', city || ' ' || {MONTH} || ' historical extremes', 'month_slices', 'The warmest ' || {MONTH} || ' slice in the window was ' || wy || ' with anomaly ' || {_n('wa')}
          || ' C. The coldest was ' || cy || ' with anomaly ' || {_n('ca')} || ' C.' FROM sc
          UNION ALL SELECT r.* FROM sc, LATERAL ({paragraphs(_SLUG, slice_report)}) AS r)""",
        f"""SELECT 'ml-evaluation' AS id, 'Climate model evaluation' AS title, 'model_evaluation' AS source, 'The climate model reports R2 ' || {_n('r2', 4)} || ', RMSE ' || {_n('rmse', 4)} || ', and MAE ' || {_n('mae', 4)}
          || ' on held-out data. That indicates ' || CASE WHEN r2 >= 0.65 THEN 'usable' ELSE 'weak' END || ' predictive skill for climate anomaly briefing rather than exact deterministic weather forecasting.' AS text
          FROM {_sub(with_sql(_METRICS) + ' SELECT * FROM metrics')}""",
        f"""SELECT 'heat-stress' AS id, 'Region {CUR} heat and frost stress' AS title, 'threshold_days' AS source, 'Region {PERIOD} {CUR} heat and frost day counts versus the {B0}-{B1} baseline: ' || string_agg(line, ' ' ORDER BY line) AS text
          FROM (SELECT {capital} || ': ' || current || ' (baseline ' || {_n('baseline_mean', 1)} || ', anomaly ' || {_n('anomaly', 1, True)} || ').' AS line FROM {_sub(threshold_days)})""",
        f"""SELECT 'heating-degree-days-' || lower(y.city) AS id, y.city || ' Heating Degree Days' AS title, 'degree_days' AS source, y.city || ' Heating Degree Days ' || y.label || ': ' || {_n('y.total_hdd', 1)}
          || ' HDD total, versus a {B0}-{B1} baseline of ' || {_n('y.baseline_mean', 1)} || ' HDD (anomaly ' || {_n('y.anomaly', 1, True)}
          || ' HDD). A negative anomaly indicates lower heating demand than the historical average, consistent with a warmer-than-normal winter.' || coalesce(' Heating season ' || s.label || ': ' || {_n('s.total_hdd', 1)}
          || ' HDD so far (baseline ' || {_n('s.baseline_mean', 1)} || ', anomaly ' || {_n('s.anomaly', 1, True)} || ' HDD).', '') AS text
          FROM {_sub(degree_ytd, 'y')} LEFT JOIN (SELECT * FROM {_sub(degree_season)} WHERE months_included > 0) AS s ON s.city = y.city""",
        f"""SELECT r.* FROM {_sub(_REGION_FACTS[0], 'f')}, LATERAL ({paragraphs("'weather-summary'", ["'Region Weather Summary'", f"'Coverage: {PERIOD} Days observed: ' || days_observed", "'Country-level anomaly'"])}) AS r""",
    ]
    return both(*parts)
