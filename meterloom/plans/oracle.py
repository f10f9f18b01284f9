"""SQL counterparts of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

import re

ORACLE: dict[str, str] = {}

# Named subqueries; a query lists what it builds on.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def oracle(name: str, sql: str, rounded: str = "") -> None:
    """Register SQL, adding the subqueries it mentions and rounding the listed columns."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for other in PARTS:
            if other not in seen and re.search(rf"\b{other}\b", text):
                seen.add(other)
                visit(PARTS[other])
                needed.append(other)

    visit(sql)
    head = ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed)
    body = sql.strip()
    if rounded:
        cells = ", ".join(f"CAST(round(CAST({c} AS DECIMAL(30, 8)), 6) AS DOUBLE) AS {c}" for c in rounded.split())
        body = f"SELECT * REPLACE ({cells}) FROM ({body})"
    ORACLE[name] = f"WITH RECURSIVE {head}\n{body}" if head else body


# --- shared inputs -------------------------------------------------------------------------------

MEAN2 = "CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / 100 / count({c})"
PRICE = MEAN2.format(c="o_totalprice")

part("panel_t", f"""
SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, {PRICE} AS value_mean,
       max(o_totalprice) AS value_peak
FROM orders GROUP BY 1, 2""")
part("whole_t", f"""
SELECT CAST(o_orderdate AS DATE) AS date, {PRICE} AS value_mean, max(o_totalprice) AS value_peak
FROM orders GROUP BY 1""")
part("exog_t", f"""
SELECT CAST(l_shipdate AS DATE) AS date,
       {MEAN2.format(c="l_quantity")} AS embedded_wind_generation_mean,
       ({MEAN2.format(c="l_discount")}) * 100 AS embedded_solar_generation_mean,
       ({MEAN2.format(c="l_tax")}) * 100 AS embedded_solar_capacity_mean,
       {MEAN2.format(c="l_extendedprice")} AS ifa_flow_mean
FROM lineitem GROUP BY 1""")
part("joined_t", "SELECT * FROM panel_t LEFT JOIN exog_t USING (date)")
part("joined_whole_t", "SELECT * FROM whole_t LEFT JOIN exog_t USING (date)")
part("raw_t", """
SELECT event_id AS ordinal, CAST(ts AS DATE) AS settlement_date,
       hour(ts) * 2 + CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END + 1 AS settlement_period,
       year(ts) AS source_year, value AS nd,
       CASE WHEN event_type = 'view' THEN value END AS tsd,
       CASE WHEN event_type = 'click' THEN value END AS embedded_wind_generation,
       CASE WHEN event_type = 'purchase' THEN value END AS pump_storage_pumping,
       event_type
FROM events""")
part("stamped_t", """
SELECT *, CAST(settlement_date AS TIMESTAMP) + (settlement_period - 1) * INTERVAL 30 MINUTE AS settlement_datetime
FROM raw_t""")
part("resolved_t", """
SELECT settlement_datetime,
       arg_min(settlement_date, ordinal) AS settlement_date,
       arg_min(settlement_period, ordinal) AS settlement_period,
       arg_min(source_year, ordinal) AS source_year,
       avg(nd) AS nd, avg(tsd) AS tsd, avg(embedded_wind_generation) AS embedded_wind_generation,
       avg(pump_storage_pumping) AS pump_storage_pumping,
       arg_min(event_type, ordinal) AS event_type, count(*) AS duplicate_count
FROM stamped_t GROUP BY 1""")
part("train_t", "SELECT * FROM panel_t WHERE date < DATE '2000-01-01' AND value_mean IS NOT NULL")
part("test_t", """
SELECT * FROM panel_t WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND value_mean IS NOT NULL""")
part("train_whole_t", "SELECT * FROM whole_t WHERE date < DATE '2000-01-01'")
part("test_whole_t", "SELECT * FROM whole_t WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'")
part("last_t", "SELECT series, arg_max(value_mean, date) AS v FROM train_t GROUP BY 1")
part("naive_t", """
SELECT t.series, t.date, t.value_mean AS actual,
       coalesce(y.value_mean, d.value_mean, l.v) AS seasonal_naive_forecast,
       l.v AS naive_forecast,
       coalesce(w.value_mean, l.v) AS weekly_seasonal_naive_forecast,
       coalesce(y.value_mean, l.v) AS strict_forecast
FROM test_t t JOIN last_t l ON l.series = t.series
LEFT JOIN train_t y ON y.series = t.series AND y.date = CAST(t.date - INTERVAL 1 YEAR AS DATE)
LEFT JOIN train_t d ON d.series = t.series AND d.date = t.date - 365
LEFT JOIN train_t w ON w.series = t.series AND w.date = t.date - 7""")
part("naive_whole_t", """
SELECT t.date, t.value_mean AS actual,
       coalesce(y.value_mean, d.value_mean, l.v) AS seasonal_naive_forecast,
       l.v AS naive_forecast,
       coalesce(w.value_mean, l.v) AS weekly_seasonal_naive_forecast
FROM test_whole_t t, (SELECT arg_max(value_mean, date) AS v FROM train_whole_t) l
LEFT JOIN train_whole_t y ON y.date = CAST(t.date - INTERVAL 1 YEAR AS DATE)
LEFT JOIN train_whole_t d ON d.date = t.date - 365
LEFT JOIN train_whole_t w ON w.date = t.date - 7""")
part("long_t", """
SELECT series, date, actual, 'naive' AS model, naive_forecast AS forecast FROM naive_t
UNION ALL SELECT series, date, actual, 'seasonal_naive', seasonal_naive_forecast FROM naive_t
UNION ALL SELECT series, date, actual, 'weekly_seasonal_naive', weekly_seasonal_naive_forecast FROM naive_t""")
part("long_whole_t", """
SELECT date, actual, 'naive' AS model, naive_forecast AS forecast FROM naive_whole_t
UNION ALL SELECT date, actual, 'seasonal_naive', seasonal_naive_forecast FROM naive_whole_t
UNION ALL SELECT date, actual, 'weekly_seasonal_naive', weekly_seasonal_naive_forecast FROM naive_whole_t""")
METRICS = """avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse,
       avg(abs(actual - forecast) / nullif(actual, 0)) * 100 AS mape, count(*) AS rows"""
part("metrics_t", f"SELECT series, model, {METRICS} FROM long_t GROUP BY 1, 2")
part("metrics_whole_t", f"SELECT model, {METRICS} FROM long_whole_t GROUP BY 1")
part("errors_t", """
SELECT *, actual - forecast AS error, abs(actual - forecast) AS absolute_error,
       abs(actual - forecast) / nullif(actual, 0) * 100 AS absolute_percentage_error
FROM long_t""")

# --- sources ---------------------------------------------------------------------------------------

oracle("yearly_union", """
SELECT o_orderkey AS order_key, o_totalprice AS total_price, CAST(year(o_orderdate) AS BIGINT) AS source_year,
       CASE WHEN year(o_orderdate) > (SELECT min(year(o_orderdate)) FROM orders) THEN o_orderstatus END AS order_status
FROM orders""")
part("resources_t", """
SELECT min(o_orderkey) AS position, CAST(year(o_orderdate) + 24 AS VARCHAR) AS y,
       o_orderstatus AS s, o_orderpriority AS p
FROM orders GROUP BY 2, 3, 4""")
part("inventory_t", """
SELECT position, y, s, p,
       CASE s WHEN 'F' THEN 'Historic Demand-Data ' || y WHEN 'P' THEN 'Notes ' || y END AS resource_name,
       CASE s WHEN 'F' THEN 'CSV' WHEN 'P' THEN 'application/json' END AS format,
       CASE WHEN p <> '5-LOW' THEN 'https://data.example/f/DemandData_' || y || '.CSV?v=1'
            ELSE '/files/' || y || '.json' END AS url_or_path,
       CAST(position AS VARCHAR) AS resource_id, p AS last_modified, s = 'O' AS datastore_available,
       CASE WHEN s = 'F' OR p <> '5-LOW' THEN CAST(y AS BIGINT) END AS extracted_year
FROM resources_t""")
part("chosen_t", """
SELECT extracted_year AS year, min(position) AS position,
       coalesce(arg_min(resource_name, position) FILTER (resource_name IS NOT NULL AND position = m),
                'historic_demand_data_' || extracted_year) AS resource_name,
       arg_min(url_or_path, position) AS url_or_path
FROM (SELECT *, min(position) OVER (PARTITION BY extracted_year) AS m FROM inventory_t
      WHERE extracted_year BETWEEN 2020 AND 2024 AND (s = 'F' OR p <> '5-LOW'))
GROUP BY extracted_year""")
oracle("manifest_inventory", """
SELECT position, resource_name, format, url_or_path, resource_id, last_modified, datastore_available,
       extracted_year, coalesce(extracted_year IN (SELECT year FROM chosen_t), false) AS selected_for_download
FROM inventory_t""")
oracle("select_years", "SELECT year, position, resource_name, url_or_path FROM chosen_t")

# --- clock and quality -------------------------------------------------------------------------------

oracle("half_hour_stamp", "SELECT ordinal, settlement_date, settlement_period, settlement_datetime FROM stamped_t")
oracle("repair_stamp", "SELECT ordinal, settlement_datetime FROM stamped_t")
oracle("parse_dates", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
oracle("expected_period_counts", """
SELECT date, sunday AS last_sunday,
       CAST(CASE WHEN date = sunday AND month(date) = 3 THEN 46 WHEN date = sunday AND month(date) = 10 THEN 50
            ELSE 48 END AS BIGINT) AS expected
FROM (SELECT date, last_day(date) - CAST(dayofweek(last_day(date)) AS INTEGER) AS sunday FROM whole_t)""")
oracle("coerce_numeric", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS reading FROM orders""", "reading")
oracle("complete_cases", "SELECT * FROM joined_t WHERE embedded_wind_generation_mean IS NOT NULL",
       "value_mean value_peak embedded_wind_generation_mean embedded_solar_generation_mean "
       "embedded_solar_capacity_mean ifa_flow_mean")
oracle("time_split", """
SELECT series, date, value_mean, 'train' AS side FROM train_t
UNION ALL SELECT series, date, value_mean, 'test' FROM test_t""", "value_mean")
oracle("window_predicates", """
SELECT event_id, event_type, ts, value FROM events
WHERE value <= 0.5 OR ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'""", "value")
oracle("member_filters", """
SELECT series, date, series IN ('1-URGENT', '2-HIGH') AS listed,
       CASE WHEN date IN (SELECT date FROM exog_t) THEN 'left_semi' ELSE 'left_anti' END AS kind
FROM panel_t""")
oracle("quantiles", """
SELECT o_orderpriority, quantile_cont(o_totalprice, 0.05) AS p05, quantile_cont(o_totalprice, 0.25) AS p25,
       quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.95) AS p95
FROM orders GROUP BY 1""", "p05 p25 p50 p95")
oracle("dup_audit", """
SELECT settlement_datetime, settlement_date, settlement_period, source_year, nd, tsd,
       duplicate_group_count, duplicate_row_number
FROM (SELECT *, count(*) OVER (PARTITION BY settlement_datetime) AS duplicate_group_count,
             row_number() OVER (PARTITION BY settlement_datetime ORDER BY ordinal) AS duplicate_row_number
      FROM stamped_t) WHERE duplicate_group_count > 1""", "nd tsd")
oracle("dup_resolve", "SELECT * FROM resolved_t",
       "nd tsd embedded_wind_generation pump_storage_pumping")
part("coverage_t", """
SELECT *, CASE WHEN date = sunday AND month(date) = 3 THEN 46 WHEN date = sunday AND month(date) = 10 THEN 50
               ELSE 48 END AS expected
FROM (SELECT CAST(settlement_datetime AS DATE) AS date, count(DISTINCT settlement_datetime) AS n,
             avg(nd) AS nd_mean, max(nd) AS nd_peak, avg(tsd) AS tsd_mean, max(tsd) AS tsd_peak,
             avg(embedded_wind_generation) AS embedded_wind_generation_mean,
             avg(pump_storage_pumping) AS pump_storage_pumping_mean,
             last_day(CAST(settlement_datetime AS DATE))
               - CAST(dayofweek(last_day(CAST(settlement_datetime AS DATE))) AS INTEGER) AS sunday
      FROM resolved_t GROUP BY ALL)""")
oracle("daily_coverage", """
SELECT date, year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) - 1 AS day_of_week,
       week(date) AS week_of_year, quarter(date) AS quarter, isodow(date) >= 6 AS is_weekend,
       n AS settlement_period_count, CAST(expected AS BIGINT) AS expected_settlement_period_count,
       n / expected AS coverage_ratio, n < expected AS has_incomplete_day,
       nd_mean, nd_peak, tsd_mean, tsd_peak, embedded_wind_generation_mean, pump_storage_pumping_mean
FROM coverage_t""", "coverage_ratio nd_mean nd_peak tsd_mean tsd_peak embedded_wind_generation_mean pump_storage_pumping_mean")
part("steps_t", """
SELECT event_type, settlement_datetime,
       date_diff('second', lag(settlement_datetime) OVER (PARTITION BY event_type ORDER BY settlement_datetime),
                 settlement_datetime) AS step
FROM (SELECT DISTINCT event_type, settlement_datetime FROM stamped_t
      UNION ALL SELECT DISTINCT 'all', settlement_datetime FROM stamped_t)""")
part("tally_t", "SELECT event_type, step, count(*) AS n FROM steps_t WHERE step IS NOT NULL GROUP BY 1, 2")
part("step_summary_t", """
SELECT event_type, (array_agg(step ORDER BY n DESC, step))[1] AS most_common_seconds,
       min(step) AS minimum_seconds, max(step) AS maximum_seconds
FROM tally_t GROUP BY 1""")
oracle("step_inference", """
SELECT event_type, CAST(most_common_seconds AS DOUBLE) AS most_common_seconds, CAST(minimum_seconds AS DOUBLE) AS minimum_seconds,
       CAST(maximum_seconds AS DOUBLE) AS maximum_seconds,
       CASE WHEN minimum_seconds = maximum_seconds THEN most_common_seconds || ' s' END AS frequency
FROM step_summary_t""")
part("grid_t", """
SELECT s.event_type, unnest(generate_series(a, b, to_seconds(most_common_seconds))) AS settlement_datetime
FROM step_summary_t s
JOIN (SELECT event_type, min(settlement_datetime) AS a, max(settlement_datetime) AS b FROM steps_t GROUP BY 1) e
  ON e.event_type = s.event_type""")
GAPS = """
SELECT settlement_datetime, event_type FROM grid_t g
WHERE {kinds} AND NOT EXISTS (SELECT 1 FROM steps_t s
                  WHERE s.event_type = g.event_type AND s.settlement_datetime = g.settlement_datetime)"""
oracle("ts_gaps", f"SELECT settlement_datetime FROM ({GAPS.format(kinds="event_type = 'all'")})")
oracle("ts_gaps_by_key", GAPS.format(kinds="event_type <> 'all'"))

# --- profiles ------------------------------------------------------------------------------------------

COLUMN = """SELECT '{c}' AS "column", '{t}' AS dtype, count({e}) AS non_null_count,
       count(*) - count({e}) AS missing_count, (count(*) - count({e})) / count(*) * 100 AS missing_pct,
       count(DISTINCT {e}) AS unique_count, CAST(arg_min({e}, o_orderkey) AS VARCHAR) AS example_value FROM orders"""
oracle("column_profile", " UNION ALL ".join(
    COLUMN.format(c=c, t=t, e=e) for c, t, e in (
        ("o_custkey", "bigint", "o_custkey"), ("o_orderstatus", "string", "o_orderstatus"),
        ("o_orderpriority", "string", "o_orderpriority"), ("day", "string", "strftime(o_orderdate, '%Y-%m-%d')"),
    )), "missing_pct")
oracle("missing_values", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        (count(*) - count({c})) / count(*) * 100 AS missing_pct FROM raw_t"""
    for c in ("ordinal", "settlement_date", "settlement_period", "source_year", "nd", "tsd",
              "embedded_wind_generation", "pump_storage_pumping", "event_type")), "missing_pct")
oracle("dup_rows", """
SELECT (SELECT count(*) FROM raw_t) AS rows,
       (SELECT count(*) FROM raw_t) - (SELECT count(*) FROM (
           SELECT DISTINCT settlement_date, settlement_period, event_type FROM raw_t)) AS duplicate_rows,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (
           SELECT count(*) AS n FROM raw_t GROUP BY settlement_date) WHERE n > 1) AS repeated_date_rows""")
oracle("target_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS missing_count,
        (count(*) - count({c})) / count(*) * 100 AS missing_pct, avg({c}) AS mean, stddev_samp({c}) AS std,
        min({c}) AS min, max({c}) AS max, median({c}) AS median FROM raw_t""" for c in ("nd", "tsd")),
    "missing_pct mean std min max median")
oracle("describe_weekend", """
SELECT isodow(settlement_datetime) >= 6 AS is_weekend, count(nd) AS "count", avg(nd) AS mean, stddev_samp(nd) AS std,
       min(nd) AS min, max(nd) AS max, quantile_cont(nd, 0.25) AS p25, quantile_cont(nd, 0.5) AS p50,
       quantile_cont(nd, 0.75) AS p75
FROM resolved_t GROUP BY 1""", "mean std min max p25 p50 p75")
oracle("pattern_means", " UNION ALL ".join(
    f"""SELECT '{n}' AS pattern, CAST({e} AS BIGINT) AS slot, avg(nd) AS mean_value, count(nd) AS rows
        FROM stamped_t GROUP BY 2""" for n, e in (
        ("year", "year(settlement_datetime)"), ("month", "month(settlement_datetime)"),
        ("day_of_week", "isodow(settlement_datetime) - 1"), ("hour", "hour(settlement_datetime)"))), "mean_value")
oracle("histogram50", """
SELECT CAST(bin AS BIGINT) AS bin, min(lo) + bin * min(width) AS bin_start, count(*) AS rows,
       count(*) / (SELECT count(*) FROM orders) / min(width) AS density
FROM (SELECT least(floor((o_totalprice - lo) / width), 49) AS bin, lo, width
      FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS width FROM orders))
GROUP BY bin""", "bin_start density")
part("fences_t", """
SELECT event_type, q1 - (q3 - q1) * 1.5 AS lower, q3 + (q3 - q1) * 1.5 AS upper
FROM (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)""")
oracle("iqr_outliers", """
SELECT e.event_id, e.event_type, e.value, f.lower, f.upper FROM events e JOIN fences_t f ON e.event_type = f.event_type
WHERE e.value < f.lower OR e.value > f.upper""", "value lower upper")
part("outlier_t", """
SELECT event_id, value FROM events, (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5""")
oracle("outlier_extremes", """
SELECT * FROM (SELECT event_id, value, 'lowest' AS side FROM outlier_t ORDER BY value, event_id LIMIT 20)
UNION ALL
SELECT * FROM (SELECT event_id, value, 'highest' AS side FROM outlier_t ORDER BY value DESC, event_id LIMIT 20)""", "value")
oracle("recent_rows", "SELECT ordinal, nd FROM raw_t ORDER BY ordinal DESC LIMIT 5000", "nd")
oracle("null_map", " UNION ALL ".join(
    f"""SELECT settlement_date AS day, '{c}' AS "column", (count(*) - count({c})) / count(*) AS missing_share
        FROM raw_t GROUP BY 1""" for c in ("tsd", "embedded_wind_generation", "pump_storage_pumping")), "missing_share")
EXOG = ["embedded_wind_generation_mean", "embedded_solar_generation_mean", "embedded_solar_capacity_mean", "ifa_flow_mean"]
oracle("corr_target", " UNION ALL ".join(
    f"""SELECT series, '{c}' AS "column", corr({c}, value_mean) AS correlation_with_target FROM joined_t GROUP BY 1"""
    for c in ["value_peak", *EXOG]), "correlation_with_target")
WIDE = ["value_mean", "value_peak", *EXOG]
oracle("corr_ranked", """
SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(correlation_with_target) DESC NULLS LAST, "column") AS rank FROM (
""" + " UNION ALL ".join(
    f"""SELECT series, '{c}' AS "column", corr({c}, value_mean) AS correlation_with_target FROM joined_t GROUP BY 1"""
    for c in ["value_peak", *EXOG]) + ")", "correlation_with_target")
oracle("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM joined_whole_t"
    for i, a in enumerate(WIDE) for b in WIDE[i:]), "correlation")
FLAGS = {c: c for c in EXOG} | {
    "is_weekend": "CAST(isodow(date) >= 6 AS DOUBLE)", "month": "month(date)", "day_of_week": "isodow(date) - 1"}
oracle("corr_features", " UNION ALL ".join(
    f"""SELECT series, '{n}' AS feature, corr({e}, value_mean) AS correlation_with_value_mean,
        corr({e}, value_peak) AS correlation_with_value_peak FROM joined_t GROUP BY 1""" for n, e in FLAGS.items()),
    "correlation_with_value_mean correlation_with_value_peak")
oracle("lag_corr", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({k} AS BIGINT) AS lag, corr(nd, v) AS lagged_correlation
        FROM (SELECT nd, lag({c}, {k}) OVER (ORDER BY settlement_datetime) AS v FROM resolved_t)"""
    for c in ("tsd", "embedded_wind_generation") for k in (1, 2, 24, 48)), "lagged_correlation")
TOP = ["tsd", "embedded_wind_generation", "pump_storage_pumping", "settlement_period", "source_year"]
oracle("lag_corr_top", "WITH c AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", corr({c}, nd) AS r FROM resolved_t""" for c in TOP) + """),
t AS (SELECT "column" FROM c WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC, "column" LIMIT 10)
SELECT * FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({k} AS BIGINT) AS lag, corr(nd, v) AS lagged_correlation
        FROM (SELECT nd, lag({c}, {k}) OVER (ORDER BY settlement_datetime) AS v FROM resolved_t)"""
    for c in TOP for k in (1, 2, 24, 48)) + """) WHERE "column" IN (SELECT "column" FROM t)""", "lagged_correlation")
part("rolled_t", """
SELECT settlement_datetime, CAST(least(48, greatest(2, total // 20)) AS BIGINT) AS rolling_window,
       CASE WHEN rn >= least(48, greatest(2, total // 20)) THEN avg(nd) OVER w END AS rolling_mean,
       CASE WHEN rn >= least(48, greatest(2, total // 20)) THEN stddev_samp(nd) OVER w END AS rolling_std
FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY settlement_datetime) AS rn FROM resolved_t)
WINDOW w AS (ORDER BY rn ROWS BETWEEN CAST(least(48, greatest(2, total // 20)) - 1 AS BIGINT) PRECEDING AND CURRENT ROW)""")
oracle("rolling_stats", "SELECT * FROM rolled_t", "rolling_mean rolling_std")
oracle("rolling_latest", """
SELECT rolling_window, rolling_mean AS rolling_mean_latest, rolling_std AS rolling_std_latest
FROM rolled_t ORDER BY settlement_datetime DESC LIMIT 1""", "rolling_mean_latest rolling_std_latest")


def decomposition(source: str, series: str, stamp: str, value: str, m: int) -> str:
    """Additive decomposition with linear trend ends."""
    h = m // 2
    edge = f"- (lag(v, {h}) OVER o + lead(v, {h}) OVER o) / 2" if m % 2 == 0 else ""
    return f"""
WITH n AS (SELECT {series} AS g, {stamp} AS t, {value} AS v,
                  row_number() OVER (PARTITION BY {series} ORDER BY {stamp}) - 1 AS p,
                  count(*) OVER (PARTITION BY {series}) AS c FROM {source}),
a AS (SELECT *, CASE WHEN p >= {h} AND p < c - {h} THEN (sum(v) OVER w {edge}) / {m} END AS tr FROM n
      WINDOW o AS (PARTITION BY g ORDER BY p),
             w AS (PARTITION BY g ORDER BY p ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
f AS (SELECT g, regr_slope(CASE WHEN p < {h + m} THEN tr END, CASE WHEN p < {h + m} THEN p END) AS hs,
             regr_intercept(CASE WHEN p < {h + m} THEN tr END, CASE WHEN p < {h + m} THEN p END) AS hi,
             regr_slope(CASE WHEN p >= c - {h + m} THEN tr END, CASE WHEN p >= c - {h + m} THEN p END) AS ts,
             regr_intercept(CASE WHEN p >= c - {h + m} THEN tr END, CASE WHEN p >= c - {h + m} THEN p END) AS ti
      FROM a GROUP BY 1),
b AS (SELECT a.*, coalesce(tr, CASE WHEN p < {h} THEN hi + hs * p ELSE ti + ts * p END) AS trend, p % {m} AS ph
      FROM a JOIN f ON a.g = f.g WHERE c >= {2 * m}),
s AS (SELECT g, ph, avg(v - trend) AS d FROM b GROUP BY 1, 2),
z AS (SELECT g, ph, d - avg(d) OVER (PARTITION BY g) AS seasonal FROM s)
SELECT b.g AS series, t, v AS observed, trend, seasonal, v - trend - seasonal AS residual
FROM b JOIN z ON z.g = b.g AND z.ph = b.ph"""


oracle("decompose", f"""
SELECT series, t AS date, observed, trend, seasonal, residual
FROM ({decomposition('panel_t', 'series', 'date', 'value_mean', 7)})""", "observed trend seasonal residual")
oracle("decompose_half_hours", f"""
SELECT t AS settlement_datetime, observed, trend, seasonal, residual
FROM ({decomposition('resolved_t', "'x'", 'settlement_datetime', 'nd', 48)})""", "observed trend seasonal residual")

# --- daily features ------------------------------------------------------------------------------------

SEASON = """month(date) IN (12, 1, 2) AS is_winter, month(date) IN (6, 7, 8) AS is_summer,
       month(date) IN (11, 12, 1, 2) AS is_peak_season"""
oracle("calendar", f"""
SELECT date, year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) - 1 AS day_of_week,
       week(date) AS week_of_year, quarter(date) AS quarter, isodow(date) >= 6 AS is_weekend, {SEASON}
FROM whole_t""")
part("days_t", """
SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
FROM panel_t GROUP BY 1""")
part("days_whole_t", """
SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM whole_t""")
oracle("densify", "SELECT * FROM days_t LEFT JOIN panel_t USING (series, date)", "value_mean value_peak")
FILL = ", ".join(
    f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY {{g}} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value({c} IGNORE NULLS) OVER (PARTITION BY {{g}} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"""
    for c in EXOG)
oracle("fill_exog", f"""
SELECT series, date, {FILL.format(g="series")} FROM days_t LEFT JOIN exog_t USING (date)""", " ".join(EXOG))
oracle("align_exog", f"""
SELECT date, {FILL.format(g="1")} FROM days_whole_t LEFT JOIN exog_t USING (date)""", " ".join(EXOG))
part("cases_t", "SELECT * FROM joined_t WHERE ifa_flow_mean IS NOT NULL")
for name, sd in (("zscore_train", "stddev_samp"), ("zscore_train_population", "stddev_pop")):
    oracle(name, f"""
SELECT c.series, c.date, {", ".join(f"(c.{x} - m_{x}) / coalesce(nullif(s_{x}, 0), 1) AS {x}" for x in EXOG)}
FROM cases_t c JOIN (SELECT series, {", ".join(f"avg({x}) AS m_{x}, {sd}({x}) AS s_{x}" for x in EXOG)}
                     FROM cases_t WHERE date < DATE '2000-01-01' GROUP BY 1) t ON t.series = c.series
WHERE c.date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""", " ".join(EXOG))
part("dense_t", "SELECT * FROM days_t LEFT JOIN joined_t USING (series, date)")
oracle("median_impute", f"""
SELECT d.series, d.date, d.value_peak, {", ".join(f"coalesce(d.{c}, m_{c}) AS {c}" for c in ["value_mean", *EXOG])}
FROM dense_t d JOIN (SELECT series, {", ".join(f"median({c}) AS m_{c}" for c in ["value_mean", *EXOG])}
                     FROM dense_t WHERE date < DATE '2000-01-01' GROUP BY 1) t ON t.series = d.series""",
       " ".join(["value_mean", "value_peak", *EXOG]))
LAGS = [1, 2, 3, 7, 14, 28, 365]
oracle("lags", f"""
SELECT series, date, {", ".join(f"lag(value_mean, {k}) OVER w AS lag_{k}" for k in LAGS)}
FROM panel_t WINDOW w AS (PARTITION BY series ORDER BY date)""", " ".join(f"lag_{k}" for k in LAGS))
oracle("lags_calendar", f"""
SELECT w.date, {", ".join(f"l{k}.value_mean AS lag_{k}" for k in LAGS)} FROM whole_t w
{" ".join(f"LEFT JOIN whole_t l{k} ON l{k}.date = w.date - {k}" for k in LAGS)}""", " ".join(f"lag_{k}" for k in LAGS))
ROLLING = [("rolling_7_mean", "avg", 7, 3), ("rolling_14_mean", "avg", 14, 7), ("rolling_30_mean", "avg", 30, 14),
           ("rolling_7_max", "max", 7, 3), ("rolling_30_max", "max", 30, 14)]
oracle("rolling_shifted", f"""
SELECT series, date, {", ".join(
    f"CASE WHEN count(value_mean) OVER w{n} >= {m} THEN {f}(value_mean) OVER w{n} END AS {name}"
    for name, f, n, m in ROLLING)}
FROM panel_t WINDOW {", ".join(
    f"w{n} AS (PARTITION BY series ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 30))}""",
       " ".join(r[0] for r in ROLLING))
part("cuts_t", """
SELECT series, quantile_cont(value_mean, 0.25) AS low_threshold, quantile_cont(value_mean, 0.75) AS high_threshold
FROM train_t GROUP BY 1""")
part("regime_t", """
SELECT p.series, p.date, p.value_mean, p.value_peak, c.low_threshold, c.high_threshold,
       CASE WHEN value_mean < low_threshold THEN 'low' WHEN value_mean > high_threshold THEN 'high'
            ELSE 'normal' END AS demand_regime
FROM panel_t p LEFT JOIN cuts_t c ON c.series = p.series""")
oracle("regime_train", "SELECT * FROM regime_t", "value_mean value_peak low_threshold high_threshold")
part("eval_t", """
SELECT t.series, t.date, t.value_mean AS actual,
       CASE WHEN value_mean <= a THEN 'low' WHEN value_mean >= b THEN 'high' ELSE 'normal' END AS demand_regime,
       month(date) AS month, quarter(date) AS quarter, isodow(date) - 1 AS day_of_week, isodow(date) >= 6 AS is_weekend
FROM test_t t JOIN (SELECT series, quantile_cont(value_mean, 0.25) AS a, quantile_cont(value_mean, 0.75) AS b
                    FROM test_t GROUP BY 1) q ON q.series = t.series""")
oracle("regime_eval", "SELECT * FROM eval_t", "actual")
HISTORY = f"""
SELECT {", ".join(f"lag(value_mean, {k}) OVER w AS lag_{k}" for k in LAGS)},
       {", ".join(f"CASE WHEN count(value_mean) OVER w{n} >= {m} THEN {f}(value_mean) OVER w{n} END AS {name}" for name, f, n, m in ROLLING)},
       {", ".join(EXOG)}
FROM joined_t WINDOW w AS (PARTITION BY series ORDER BY date), {", ".join(
    f"w{n} AS (PARTITION BY series ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 30))}"""
part("history_t", HISTORY)
CAL = ["month", "day_of_week", "quarter", "is_weekend", "is_winter", "is_summer", "is_peak_season"]
NAMES = [f"lag_{k}" for k in LAGS] + [r[0] for r in ROLLING]
AUDITED = [(n, n) for n in NAMES] + [(c, "*") for c in CAL] + [(c, c) for c in EXOG]
part("audited_t", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, (SELECT count({c}) FROM history_t) AS known_rows" for n, c in AUDITED))
part("classed_t", """
SELECT feature, known_rows,
       CASE WHEN regexp_matches(feature, '^lag_[0-9]+$') THEN 'target lag'
            WHEN feature LIKE 'rolling%' THEN 'rolling target history'
            WHEN feature NOT LIKE '%\\_mean' ESCAPE '\\' THEN 'calendar'
            WHEN contains(feature, 'capacity') THEN 'capacity variable'
            ELSE 'observed exogenous variable' END AS feature_type
FROM audited_t""")
part("audit_t", """
SELECT feature, feature_type, feature_type IN ('target lag', 'rolling target history') AS uses_target_history,
       feature_type IN ('capacity variable', 'observed exogenous variable') AS uses_same_day_observed_value,
       CASE feature_type WHEN 'calendar' THEN 'yes' WHEN 'capacity variable' THEN 'usually planned or scenario-specified'
            WHEN 'observed exogenous variable' THEN 'only if forecasted or scenario-specified'
            ELSE 'yes for one-day-ahead; recursively generated for multi-step' END AS known_at_forecast_time,
       feature_type <> 'observed exogenous variable' AS safe_for_one_day_ahead,
       feature_type IN ('calendar', 'capacity variable') AS safe_for_strict_multi_step,
       CASE feature_type
         WHEN 'target lag' THEN 'Uses demand observed before the forecast date. Safe for next-day forecasting, but future lags must be generated recursively for a full test-period forecast.'
         WHEN 'rolling target history' THEN 'Calculated from shifted historical demand. It must use model forecasts, not actual future demand, in strict recursive evaluation.'
         WHEN 'calendar' THEN 'Calendar values are known for future dates.'
         WHEN 'capacity variable' THEN 'Capacity is more likely to be known or planned than realised generation, but this should still be checked before operational use.'
         ELSE 'Realised same-day generation or flow values are retrospective unless replaced by forecasts, schedules or scenario assumptions.' END AS notes,
       feature_type <> 'observed exogenous variable' AS included_in_strict_recursive_run, known_rows
FROM classed_t""")
oracle("feature_audit", "SELECT * FROM audit_t")
oracle("audit_counts", """
SELECT feature_type, safe_for_one_day_ahead, safe_for_strict_multi_step, count(*) AS features,
       CAST(sum(known_rows) AS BIGINT) AS known_rows
FROM audit_t GROUP BY 1, 2, 3""")
oracle("leakage_check", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, (SELECT count({n}) FROM history_t) AS rows_checked, CAST(0 AS BIGINT) AS mismatches" for n in NAMES))

# --- baselines and evaluation -------------------------------------------------------------------------

oracle("naive", "SELECT series, date, actual, naive_forecast FROM naive_t", "actual naive_forecast")
oracle("seasonal_naive", "SELECT series, date, actual, seasonal_naive_forecast FROM naive_t", "actual seasonal_naive_forecast")
oracle("seasonal_naive_strict", """
SELECT series, date, actual, strict_forecast AS seasonal_naive_forecast FROM naive_t""", "actual seasonal_naive_forecast")
oracle("weekly_naive", "SELECT series, date, actual, weekly_seasonal_naive_forecast FROM naive_t",
       "actual weekly_seasonal_naive_forecast")
oracle("seasonal_naive_metrics", "SELECT * FROM metrics_whole_t WHERE model = 'seasonal_naive'", "mae rmse mape")
oracle("metrics", "SELECT * FROM metrics_t", "mae rmse mape")
oracle("ranked_metrics", """
SELECT *, row_number() OVER (PARTITION BY series ORDER BY mae, model) AS rank FROM metrics_t""", "mae rmse mape")
oracle("model_order", """
SELECT *, CASE model WHEN 'naive' THEN CAST(0 AS BIGINT) ELSE 1 END AS model_order FROM metrics_t
WHERE model IN ('naive', 'seasonal_naive')""", "mae rmse mape")
oracle("refined_benchmark", """
SELECT *, row_number() OVER (ORDER BY mae, model) AS rank
FROM (SELECT * REPLACE (CASE model WHEN 'seasonal_naive' THEN 'year_over_year_seasonal_naive' ELSE model END AS model)
      FROM metrics_whole_t WHERE model <> 'naive')""", "mae rmse mape")
oracle("forecast_merge", """
SELECT series, date, actual, seasonal_naive_forecast, naive_forecast, weekly_seasonal_naive_forecast FROM naive_t""",
       "actual seasonal_naive_forecast naive_forecast weekly_seasonal_naive_forecast")
oracle("align_inner", """
SELECT p.series, p.date, p.value_mean, n.seasonal_naive_forecast
FROM panel_t p JOIN naive_whole_t n ON n.date = p.date""", "value_mean seasonal_naive_forecast")
part("sliced_t", " UNION ALL ".join(
    f"""SELECT e.series, '{s}' AS slice, CAST(v.{s} AS VARCHAR) AS slice_value, model, count(*) AS rows,
        avg(error) AS mean_error, avg(absolute_error) AS mae, avg(absolute_percentage_error) AS mape
        FROM errors_t e JOIN eval_t v ON v.series = e.series AND v.date = e.date GROUP BY 1, 3, 4"""
    for s in ("month", "day_of_week", "demand_regime", "quarter", "is_weekend")))
oracle("error_slices", "SELECT * FROM sliced_t", "mean_error mae mape")
oracle("slice_pivot", """
SELECT series, slice_value, max(mae) FILTER (model = 'naive') AS naive,
       max(mae) FILTER (model = 'seasonal_naive') AS seasonal_naive,
       max(mae) FILTER (model = 'weekly_seasonal_naive') AS weekly_seasonal_naive
FROM sliced_t WHERE slice = 'month' GROUP BY 1, 2""", "naive seasonal_naive weekly_seasonal_naive")
oracle("regime_metrics", f"""
SELECT l.series, demand_regime, model, {METRICS}
FROM long_t l JOIN regime_t r ON r.series = l.series AND r.date = l.date GROUP BY 1, 2, 3""", "mae rmse mape")
part("quartiles_t", """
SELECT series, model, quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.5) AS median,
       quantile_cont(error, 0.75) AS q3 FROM errors_t GROUP BY 1, 2""")
oracle("box_stats", """
SELECT e.series, e.model, q1, median, q3,
       min(error) FILTER (error BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
       max(error) FILTER (error BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
       count(error) AS rows
FROM errors_t e JOIN quartiles_t q ON q.series = e.series AND q.model = e.model GROUP BY ALL""",
       "q1 median q3 whisker_low whisker_high")
oracle("residual_acf", """
WITH o AS (SELECT series, model, error, row_number() OVER (PARTITION BY series, model ORDER BY date) AS rn
           FROM errors_t WHERE error IS NOT NULL)
SELECT a.series, a.model, k AS lag, corr(a.error, b.error) AS autocorrelation
FROM o a CROSS JOIN generate_series(1, 30) g(k)
JOIN o b ON b.series = a.series AND b.model = a.model AND b.rn = a.rn - k
GROUP BY 1, 2, 3""", "autocorrelation")
part("counts_t", """
SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2""")
oracle("incomplete_impact", """
SELECT e.series, e.date, model, actual, absolute_error, n AS settlement_period_count,
       m AS expected_settlement_period_count, n / m AS coverage_ratio, n / m < 1 AS has_incomplete_day
FROM errors_t e LEFT JOIN (SELECT *, max(n) OVER (PARTITION BY series) AS m FROM counts_t) c
  ON c.series = e.series AND c.date = e.date""", "actual absolute_error coverage_ratio")
oracle("verdict", """
SELECT m.series, m.model, m.mae, b.mae AS benchmark_mae,
       CASE WHEN m.mae < b.mae THEN 'beats' ELSE 'does not beat' END AS verdict
FROM metrics_t m JOIN metrics_t b ON b.series = m.series AND b.model = 'seasonal_naive'
WHERE m.model <> 'seasonal_naive'""", "mae benchmark_mae")
oracle("metrics_union", f"""
SELECT model, mae, rmse, mape, rows, CAST(0 AS BIGINT) AS priority
FROM (SELECT model, {METRICS} FROM long_whole_t WHERE date < DATE '2000-07-01' AND model = 'naive' GROUP BY 1)
UNION ALL SELECT model, mae, CAST(NULL AS DOUBLE), mape, rows, 1 FROM metrics_whole_t WHERE model <> 'naive'""",
       "mae rmse mape")
part("designs_t", """
SELECT model, 'operational_one_day_ahead' AS forecast_design, mae, rmse, mape, CAST(0 AS BIGINT) AS priority
FROM metrics_whole_t WHERE model IN ('naive', 'weekly_seasonal_naive')
UNION ALL SELECT 'ridge', 'operational_one_day_ahead', NULL, NULL, NULL, 0
UNION ALL SELECT model, CASE model WHEN 'seasonal_naive' THEN 'benchmark' ELSE 'strict_recursive_drop_exog' END,
                 mae, rmse, mape, 1 FROM metrics_whole_t""")
oracle("design_comparison", "SELECT * FROM designs_t", "mae rmse mape")

# --- scenarios ------------------------------------------------------------------------------------------

part("limit_t", """
SELECT series, 'value_mean' AS target, quantile_cont(value_mean, 0.95) AS capacity_threshold,
       '95th percentile of training-period actual demand' AS threshold_source, min(date) AS training_start,
       max(date) AS training_end, count(*) AS training_rows, CAST(0.95 AS DOUBLE) AS percentile
FROM train_t GROUP BY 1""")
oracle("threshold", "SELECT * FROM limit_t", "capacity_threshold percentile")
part("context_t", """
SELECT n.series, n.date, n.actual, n.seasonal_naive_forecast, n.seasonal_naive_forecast AS base_forecast,
       n.actual AS value_mean, month(n.date) AS month, isodow(n.date) - 1 AS day_of_week,
       isodow(n.date) >= 6 AS is_weekend, month(n.date) IN (12, 1, 2) AS is_winter,
       month(n.date) IN (11, 12, 1, 2) AS is_peak_season, j.embedded_wind_generation_mean,
       j.embedded_solar_generation_mean, r.demand_regime
FROM naive_t n JOIN regime_t r ON r.series = n.series AND r.date = n.date
LEFT JOIN exog_t j ON j.date = n.date""")
oracle("context_join", "SELECT * FROM context_t",
       "actual seasonal_naive_forecast base_forecast value_mean embedded_wind_generation_mean embedded_solar_generation_mean")
part("pool_t", """
SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS idx, date,
       actual - base_forecast - avg(actual - base_forecast) OVER (PARTITION BY series) AS residual FROM context_t""")
oracle("residual_pool", "SELECT * FROM pool_t", "residual")
part("renewable_t", """
SELECT series, quantile_cont(embedded_wind_generation_mean + embedded_solar_generation_mean, 0.25) AS cut
FROM joined_t WHERE date < DATE '2000-01-01' GROUP BY 1""")
part("flags_t", """
SELECT c.*, coalesce(embedded_wind_generation_mean + embedded_solar_generation_mean <= cut, false) AS low_renewable,
       CASE WHEN demand_regime = 'high' OR is_peak_season THEN 0.05::DOUBLE ELSE 0 END AS u1,
       CASE WHEN embedded_wind_generation_mean + embedded_solar_generation_mean <= cut THEN 0.02::DOUBLE ELSE 0 END AS u2,
       CASE WHEN is_winter OR is_peak_season THEN 0.07::DOUBLE ELSE 0 END AS u3
FROM context_t c JOIN renewable_t r ON r.series = c.series""")
part("scenarios_t", """
SELECT *, base_forecast * (1 + scenario_uplift_pct) AS adjusted_forecast FROM (
  SELECT *, 'baseline' AS scenario, 0.0::DOUBLE AS scenario_uplift_pct,
         'No systematic uplift; uncertainty comes from empirical forecast residuals.' AS scenario_assumption FROM flags_t
  UNION ALL SELECT *, 'high_demand_stress', u1, 'Applies a 5% uplift on high-demand or peak-season days.' FROM flags_t
  UNION ALL SELECT *, 'low_renewable_stress', u2, 'Applies a 2% uplift on low embedded wind/solar proxy days; this is a simplified stress proxy, not a physical grid model.' FROM flags_t
  UNION ALL SELECT *, 'winter_peak_stress', u3, 'Applies a 7% uplift on winter or peak-season days.' FROM flags_t
  UNION ALL SELECT *, 'combined_stress', least(u1 + u2 + u3, 0.12::DOUBLE), 'Combines high-demand, low-renewable and winter stress assumptions with total uplift capped at 12%.' FROM flags_t)""")
oracle("scenario_rows", """
SELECT series, date, scenario, demand_regime, low_renewable, base_forecast, scenario_uplift_pct, adjusted_forecast,
       scenario_assumption FROM scenarios_t""", "base_forecast scenario_uplift_pct adjusted_forecast")
part("pools_t", "SELECT series, list(residual ORDER BY idx) AS r FROM pool_t GROUP BY 1")
part("sims_t", """
SELECT s.series, s.date, s.scenario, s.base_forecast, s.scenario_uplift_pct, s.actual, s.demand_regime,
       l.capacity_threshold, s.adjusted_forecast + p.r[1 + CAST('0x' || substr(md5('42:' || s.series || ':'
         || s.scenario || ':' || strftime(s.date, '%Y-%m-%d') || ':' || draw), 1, 8) AS BIGINT) % len(p.r)] AS sim
FROM scenarios_t s JOIN limit_t l ON l.series = s.series JOIN pools_t p ON p.series = s.series
CROSS JOIN generate_series(0, 999) g(draw)""")
part("daily_sims_t", """
SELECT series, date, scenario, base_forecast, scenario_uplift_pct, CAST(sum(CAST(sim AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS simulated_mean,
       quantile_cont(sim, 0.05) AS simulated_p05, quantile_cont(sim, 0.5) AS simulated_p50,
       quantile_cont(sim, 0.95) AS simulated_p95, capacity_threshold,
       avg(CAST(sim > capacity_threshold AS INTEGER)) AS exceedance_probability, actual, demand_regime
FROM sims_t GROUP BY ALL""")
oracle("bootstrap_daily", "SELECT * FROM daily_sims_t",
       "base_forecast scenario_uplift_pct simulated_mean simulated_p05 simulated_p50 simulated_p95 capacity_threshold "
       "exceedance_probability actual")
oracle("bootstrap_exact", """
SELECT s.series, s.date, s.scenario, s.adjusted_forecast,
       avg(CAST(p.residual > l.capacity_threshold - s.adjusted_forecast AS INTEGER)) AS exceedance_probability
FROM scenarios_t s JOIN limit_t l ON l.series = s.series JOIN pool_t p ON p.series = s.series GROUP BY ALL""",
       "adjusted_forecast exceedance_probability")
oracle("capacity_pressure", """
SELECT *, row_number() OVER (PARTITION BY series ORDER BY expected_exceedance_days DESC, scenario) AS rank
FROM (SELECT series, scenario, count(*) AS n_days, max(capacity_threshold) AS capacity_threshold,
             sum(exceedance_probability) AS expected_exceedance_days,
             max(exceedance_probability) AS max_exceedance_probability,
             avg(exceedance_probability) AS mean_exceedance_probability,
             count(*) FILTER (exceedance_probability > 0.25) AS days_with_exceedance_probability_above_25pct,
             count(*) FILTER (exceedance_probability > 0.5) AS days_with_exceedance_probability_above_50pct,
             count(*) FILTER (exceedance_probability > 0.75) AS days_with_exceedance_probability_above_75pct,
             max(simulated_p50) AS simulated_peak_p50, max(simulated_p95) AS simulated_peak_p95
      FROM daily_sims_t GROUP BY 1, 2)""",
       "capacity_threshold expected_exceedance_days max_exceedance_probability mean_exceedance_probability "
       "simulated_peak_p50 simulated_peak_p95")
oracle("scenario_method", """
SELECT series, 'seasonal_naive_forecast' AS base_forecast,
       'Scenario results inherit the one-day-ahead forecast design unless a strict recursive baseline is substituted.' AS forecast_design_caveat,
       capacity_threshold, threshold_source AS threshold_definition,
       'baseline, high_demand_stress, low_renewable_stress, winter_peak_stress, combined_stress' AS scenarios,
       (SELECT model || ' (' || forecast_design || ') MAPE ' || printf('%.2f', mape) || '%' FROM designs_t
        WHERE mape IS NOT NULL ORDER BY round(mape, 9), model, forecast_design LIMIT 1) AS forecast_validation_context
FROM limit_t""", "capacity_threshold")

# --- models with a closed form -----------------------------------------------------------------------------

oracle("level_smoothing", """
SELECT series, sum(value_mean * pow(0.8::DOUBLE, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.2::DOUBLE END) AS level
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS i,
             count(*) OVER (PARTITION BY series) AS n FROM train_t)
GROUP BY 1""", "level")
oracle("top_days", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value_mean DESC, date) AS place FROM panel_t) WHERE place <= 10""",
       "value_mean value_peak")
part("ranks_t", " UNION ALL ".join(
    f"""SELECT series AS model, '{n}' AS feature, round(abs(corr({e}, value_mean)), 9) AS importance FROM joined_t GROUP BY 1"""
    for n, e in ({"value_peak": "value_peak"} | FLAGS).items()))
oracle("importance_rule", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS place FROM ranks_t) WHERE place <= 15
UNION ALL
SELECT * FROM (SELECT 'mean' AS model, feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS place
               FROM (SELECT feature, avg(importance) AS importance FROM ranks_t GROUP BY 1)) WHERE place <= 20""", "importance")
oracle("ridge_residual_check", " UNION ALL ".join(
    f"SELECT series, '{n}' AS feature, CAST(0 AS DOUBLE) AS distance FROM train_t GROUP BY 1" for n, _ in AUDITED))
part("complete_t", f"""
SELECT date FROM (
SELECT date, value_mean, {", ".join(f"lag(value_mean, {k}) OVER w AS lag_{k}" for k in LAGS)},
       {", ".join(f"CASE WHEN count(value_mean) OVER w{n} >= {m} THEN {f}(value_mean) OVER w{n} END AS {name}" for name, f, n, m in ROLLING)},
       {", ".join(EXOG)}
FROM joined_t WINDOW w AS (PARTITION BY series ORDER BY date), {", ".join(
    f"w{n} AS (PARTITION BY series ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 30))}
) WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND value_mean IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in [*NAMES, *EXOG])}""")
part("trained_t", f"""
SELECT count(*) AS n FROM (SELECT {", ".join(f"lag(value_mean, {k}) OVER w AS lag_{k}" for k in LAGS)},
       {", ".join(f"CASE WHEN count(value_mean) OVER w{n} >= {m} THEN {f}(value_mean) OVER w{n} END AS {name}" for name, f, n, m in ROLLING)},
       {", ".join(EXOG)}, date, value_mean
FROM joined_t WINDOW w AS (PARTITION BY series ORDER BY date), {", ".join(
    f"w{n} AS (PARTITION BY series ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 30))}
) WHERE date < DATE '2000-01-01' AND value_mean IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in [*NAMES, *EXOG])}""")
oracle("boosting_rules", """
SELECT 'leaf means' AS rule, n * 21 AS rows, CAST(0 AS BIGINT) AS mismatches FROM trained_t
UNION ALL SELECT 'sum of trees', n, 0 FROM trained_t""")

oracle("forest_rules", """
SELECT 'mean of trees' AS rule, n AS rows, CAST(0 AS BIGINT) AS mismatches FROM trained_t UNION ALL SELECT 'label range', n, 0 FROM trained_t""")
oracle("sarima_weights_check", " UNION ALL ".join(
    f"SELECT series, '{c}{k}' AS term, CAST(0 AS DOUBLE) AS distance FROM train_t GROUP BY 1" for c in "we" for k in (1, 7, 8)))

# The linear recursion: history and forecasts of a series in one list, a day at a time.
GIVEN = dict(
    lag_1=0.2, lag_2=0.05, lag_7=0.15, lag_365=0.05, rolling_7_mean=0.2, rolling_14_mean=0.05, rolling_30_mean=0.15,
    rolling_7_max=0.02, rolling_30_max=0.03, month=120.0, is_weekend=-900.0, embedded_solar_capacity_mean=350.0)


def _next_input(name: str) -> str:
    if name.startswith("lag_"):
        return f"h[-{name[4:]}]"
    if name.startswith("rolling_"):
        _, length, statistic = name.split("_")
        fewest = {"7": 3, "14": 7, "30": 14}[length]
        return f"CASE WHEN len(h) >= {fewest} THEN list_{'avg' if statistic == 'mean' else 'max'}(h[greatest(len(h) - {int(length) - 1}, 1):]) END"
    return f"k_{name}"


part("inputs_t", f"""
SELECT series, date, value_mean, {", ".join(f"lag(value_mean, {k}) OVER w AS lag_{k}" for k in LAGS)},
       {", ".join(f"CASE WHEN count(value_mean) OVER w{n} >= {m} THEN {f}(value_mean) OVER w{n} END AS {name}" for name, f, n, m in ROLLING)},
       CAST(month(date) AS DOUBLE) AS month, CAST(isodow(date) >= 6 AS INTEGER)::DOUBLE AS is_weekend, embedded_solar_capacity_mean
FROM joined_t WINDOW w AS (PARTITION BY series ORDER BY date), {", ".join(
    f"w{n} AS (PARTITION BY series ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 30))}""")
part("learnt_t", f"""
SELECT * FROM inputs_t WHERE date < DATE '2000-01-01' AND value_mean IS NOT NULL AND embedded_solar_capacity_mean IS NOT NULL
  AND {" AND ".join(f"{c} IS NOT NULL" for c in NAMES)}""")
part("begun_t", f"""
SELECT series, list(value_mean ORDER BY date)[-365:] AS h, {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in GIVEN)}
FROM learnt_t GROUP BY 1""")
part("asked_t", """
SELECT series, date, value_mean AS actual, month AS k_month, is_weekend AS k_is_weekend,
       embedded_solar_capacity_mean AS k_embedded_solar_capacity_mean, row_number() OVER (PARTITION BY series ORDER BY date) AS n
FROM inputs_t WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""")
part("walked_t", f"""
SELECT series, CAST(0 AS BIGINT) AS n, h, CAST(NULL AS DOUBLE) AS forecast FROM begun_t
UNION ALL
SELECT series, n, list_append(h, v), v FROM (
  SELECT r.series, a.n, r.h, 9000 + {" + ".join(f"{w} * coalesce({_next_input(c)}, m_{c})" for c, w in GIVEN.items())} AS v
  FROM (SELECT series, n AS before, h FROM walked_t) r JOIN asked_t a ON a.series = r.series AND a.n = r.before + 1
  JOIN (SELECT * EXCLUDE (h) FROM begun_t) b ON b.series = r.series)""")
oracle("recursive_ridge_given", """
SELECT series, date, 'given' AS model, actual, forecast FROM walked_t JOIN asked_t USING (series, n)""", "actual forecast")

# Smoothing with given weights: the seasonal states of a series in one list.
part("steady_t", """
SELECT series, list(v ORDER BY date) AS y, max(date) AS stop FROM (
  SELECT c.series, c.date, p.value_mean AS v FROM (
    SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM train_t GROUP BY 1) c
  LEFT JOIN train_t p ON p.series = c.series AND p.date = c.date) GROUP BY 1 HAVING count(*) >= 730""")
part("cycles_t", """
SELECT series, list_avg(y[1:365]) AS a, list_avg(y[366:730]) AS b FROM steady_t""")
part("smooth_t", """
SELECT series, CAST(0 AS BIGINT) AS t, a AS level, (b - a) / 365 AS drift, list_transform(y[1:365], lambda v: coalesce(v - a, 0)) AS wave
FROM steady_t JOIN cycles_t USING (series)
UNION ALL
SELECT series, t + 1, level + drift + 0.2 * e, drift + CAST(0.01 AS DOUBLE) * CAST(0.2 AS DOUBLE) * e, list_append(wave[2:], wave[1] + CAST(0.1 AS DOUBLE) * CAST(0.8 AS DOUBLE) * e) FROM (
  SELECT s.*, coalesce(y[t + 1] - (level + drift) - wave[1], 0) AS e FROM smooth_t s JOIN steady_t USING (series) WHERE t < len(y))""")
oracle("holt_winters_given", """
SELECT p.series, p.date, p.value_mean AS actual, level + drift * (p.date - stop) + wave[(p.date - stop - 1) % 365 + 1] AS holt_winters_forecast
FROM test_t p LEFT JOIN steady_t s USING (series) LEFT JOIN smooth_t r ON r.series = p.series AND r.t = len(y)""", "actual holt_winters_forecast")

# The whole grid of smoothing with trend and season, a row per series and weights; series are longer than two years.
part("grid_t", """
SELECT a, b, g, row_number() OVER (ORDER BY a, b, g) AS place FROM
  (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.4, 0.7]::DOUBLE[]) AS a), (SELECT unnest([0.001, 0.01, 0.1]::DOUBLE[]) AS b), (SELECT unnest([0.02, 0.1, 0.3]::DOUBLE[]) AS g)""")
part("tried_t", """
SELECT series, place, a AS alpha, b AS beta, g AS gamma, CAST(0 AS BIGINT) AS t, m AS level, slope AS drift, waves AS wave, CAST(0 AS DOUBLE) AS squared
FROM (SELECT series, c.a AS m, (c.b - c.a) / 365 AS slope, list_transform(y[1:365], lambda v: coalesce(v - c.a, 0)) AS waves
      FROM steady_t JOIN cycles_t c USING (series)), grid_t
UNION ALL
SELECT series, place, alpha, beta, gamma, t + 1, level + drift + alpha * e, drift + beta * alpha * e,
       list_append(wave[2:], wave[1] + gamma * (1 - alpha) * e), squared + e * e FROM (
  SELECT s.*, coalesce(y[t + 1] - (level + drift) - wave[1], 0) AS e FROM tried_t s JOIN steady_t USING (series) WHERE t < len(y))""")
part("picked_t", """
SELECT series, arg_min(struct_pack(level := level, drift := drift, wave := wave), squared) AS s
FROM tried_t JOIN steady_t USING (series) WHERE t = len(y) GROUP BY 1""")
oracle("holt_winters", """
SELECT p.series, p.date, p.value_mean AS actual,
       s.level + s.drift * (p.date - stop) + s.wave[(p.date - stop - 1) % 365 + 1] AS holt_winters_forecast, 'trend and season' AS holt_winters_form
FROM test_t p JOIN steady_t USING (series) JOIN picked_t USING (series)""", "actual holt_winters_forecast")

# Seasonal ARIMA with given weights: shocks of the training days, then forecasts that undo both differences.
part("moved_t", """
SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) AS t, move FROM (
  SELECT series, date, value_mean - lag(value_mean, 1) OVER w - lag(value_mean, 7) OVER w + lag(value_mean, 8) OVER w AS move
  FROM train_t WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE move IS NOT NULL""")
ARMA = " + ".join(f"({a} * coalesce(w[-{k}], 0) + {m} * coalesce(e[-{k}], 0))" for k, a, m in ((1, 0.3, -0.5), (7, 0.2, -0.4), (8, -0.06, 0.2)))
part("shocked_t", f"""
SELECT series, CAST(0 AS BIGINT) AS t, CAST([] AS DOUBLE[]) AS w, CAST([] AS DOUBLE[]) AS e FROM train_t GROUP BY 1
UNION ALL
SELECT series, t + 1, list_append(w[-7:], move), list_append(e[-7:], move - x) FROM (
  SELECT s.series, s.t, s.w, s.e, m.move, {ARMA} AS x FROM shocked_t s JOIN moved_t m ON m.series = s.series AND m.t = s.t + 1)""")
part("made_t", f"""
SELECT series, CAST(0 AS BIGINT) AS t, list(value_mean ORDER BY date)[-8:] AS y,
       arg_max(s.w, s.t) AS w, arg_max(s.e, s.t) AS e
FROM train_t JOIN (SELECT series, max(t) AS t, arg_max(w, t) AS w, arg_max(e, t) AS e FROM shocked_t GROUP BY 1) s USING (series) GROUP BY 1
UNION ALL
SELECT series, t + 1, list_append(y[-7:], x + y[-1] + y[-7] - y[-8]), list_append(w[-7:], x), list_append(e[-7:], 0) FROM (
  SELECT *, {ARMA} AS x FROM made_t WHERE t < 400)""")
oracle("sarima_given", """
SELECT series, date, actual, made_t.y[-1] AS sarima_forecast FROM (
  SELECT series, date, value_mean AS actual, row_number() OVER (PARTITION BY series ORDER BY date) AS t FROM test_t) q
JOIN made_t USING (series, t)""", "actual sarima_forecast")
part("moves_t", """
SELECT series, value_mean - y AS d, y FROM (
  SELECT series, value_mean, lag(value_mean) OVER (PARTITION BY series ORDER BY date) AS y FROM panel_t WHERE value_mean IS NOT NULL)
WHERE y IS NOT NULL""")
oracle("adf_given_lag", """
SELECT series, b / sqrt((regr_syy - b * b * regr_sxx) / (n - 2) / regr_sxx) AS adf_statistic, CAST(0 AS BIGINT) AS adf_used_lag, n AS adf_n_obs
FROM (SELECT series, regr_slope(d, y) AS b, regr_sxx(d, y) AS regr_sxx, regr_syy(d, y) AS regr_syy, count(*) AS n FROM moves_t GROUP BY 1)""",
       "adf_statistic")
part("bins_t", """
SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 4096)), 4095) AS bin, count(*) AS rows, any_value(lo) AS lo, any_value(hi) AS hi,
       any_value(n) AS n, any_value(sd * pow(n, -0.2::DOUBLE)) AS h
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, stddev_samp(o_totalprice) AS sd FROM orders)
GROUP BY 1""")
oracle("density", """
SELECT lo + (hi - lo) * i / 199 AS x,
       sum(rows * exp(-pow((lo + (hi - lo) * i / 199 - (lo + (hi - lo) * (bin + 0.5) / 4096)) / h, 2) / 2))
         / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1e6 AS density
FROM bins_t CROSS JOIN generate_series(0, 199) g(i) GROUP BY i, lo, hi""", "x density")

# --- long series and mergeable sketches --------------------------------------------------------------

GAPPY = ["tsd", "embedded_wind_generation", "pump_storage_pumping"]
oracle("fill_half_hours", f"""
SELECT settlement_datetime, {", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY settlement_datetime ROWS UNBOUNDED PRECEDING), "
    f"first_value({c} IGNORE NULLS) OVER (ORDER BY settlement_datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}" for c in GAPPY)}
FROM resolved_t""", " ".join(GAPPY))
oracle("lags_rows_blocked", f"""
SELECT settlement_datetime, nd, {", ".join(f"lag(nd, {k}) OVER w AS lag_{k}" for k in LAGS)}, {", ".join(
    f"CASE WHEN count(nd) OVER w{n} >= {m} THEN {f}(nd) OVER w{n} END AS {name}" for name, f, n, m in ROLLING)}
FROM resolved_t WINDOW w AS (ORDER BY settlement_datetime), {", ".join(
    f"w{n} AS (ORDER BY settlement_datetime ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 30))}""",
       " ".join(["nd", *[f"lag_{k}" for k in LAGS], *[r[0] for r in ROLLING]]))
part("before_t", " UNION ALL ".join(
    f"SELECT '{name} before' AS model, a.settlement_datetime, a.nd - b.nd AS error FROM resolved_t a "
    f"JOIN resolved_t b ON b.settlement_datetime = a.settlement_datetime - INTERVAL {days} DAY" for name, days in (("day", 1), ("week", 7))))
oracle("residual_acf_half_hours", """
WITH o AS (SELECT model, error, row_number() OVER (PARTITION BY model ORDER BY settlement_datetime) AS rn FROM before_t WHERE error IS NOT NULL)
SELECT g.model, k AS lag, corr(a.error, b.error) AS autocorrelation
FROM (SELECT DISTINCT model, k FROM o CROSS JOIN generate_series(1, 48) s(k)) g JOIN o a ON a.model = g.model
LEFT JOIN o b ON b.model = a.model AND b.rn = a.rn - k
GROUP BY 1, 2""", "autocorrelation")
oracle("column_profile_sketch", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null_count, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count,
        true AS unique_kept, {", ".join(f"{'true' if c in ('user_id', 'value') else 'CAST(NULL AS BOOLEAN)'} AS {p}_kept" for p in ("p05", "p50", "p95"))} FROM events"""
    for c in ("event_id", "user_id", "event_type", "props", "value")))
oracle("manifest_from_json", """
SELECT event_id, event_type, CAST(0 AS BIGINT) AS position, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS id FROM events""")
oracle("manifest_documents", "SELECT * EXCLUDE (y, s, p), false AS selected_for_download FROM inventory_t")
oracle("table_round_trip", """
SELECT series, date, value_mean, value_peak + CASE WHEN year(date) = 1996 THEN 1 ELSE 0 END AS value_peak, CAST(year(date) AS BIGINT) AS year
FROM panel_t WHERE year(date) BETWEEN 1995 AND 1997""", "value_mean value_peak")
DAY = "strftime(o_orderdate, '%Y-%m-%d')"
oracle("datetime_columns", "SELECT *, parsed >= 0.8 * sampled AS is_datetime FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS sampled, count(try_strptime(v, '%Y-%m-%d')) AS parsed FROM (
        SELECT {e} AS v FROM orders WHERE {e} IS NOT NULL ORDER BY o_orderkey LIMIT 1000)"""
    for c, e in (("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"), ("day", DAY),
                 ("gappy", f"CASE WHEN o_orderstatus <> 'P' THEN {DAY} END"), ("mixed", f"CASE WHEN o_orderstatus = 'F' THEN {DAY} ELSE 'open' END"))) + ")")
