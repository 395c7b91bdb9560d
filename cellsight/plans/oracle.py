"""Reference SQL (DuckDB dialect) for the registered queries.

Each statement recomputes a query of :mod:`cellsight.plans.catalog` from the
raw tables, as an independent statement of its semantics; sums and ratios
of doubles are brought to 12 significant digits like the Spark side.
"""

from __future__ import annotations


def _nan0(x: str) -> str:
    return f"coalesce(CASE WHEN isnan({x}) THEN 0.0 ELSE {x} END, 0.0)"


def _key(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


CTE = {}

CTE["raw"] = """raw AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime,
         'R' || CAST(user_id AS VARCHAR) AS CellID,
         CAST(event_id % 5 AS VARCHAR) AS countrycode,
         CASE WHEN event_type = 'signup' THEN value END AS smsin,
         CASE WHEN event_type = 'purchase' THEN value END AS smsout,
         CASE WHEN event_type = 'click' THEN value END AS callin,
         CASE WHEN event_type = 'view' THEN value END AS callout,
         CASE WHEN event_type = 'error' THEN value END AS internet
  FROM events)"""

CTE["cleaned"] = f"""cleaned AS (
  SELECT grid_id, call_count, sms_count, internet_usage, event_timestamp,
         CAST(event_timestamp AS DATE) AS event_date,
         CAST(hour(event_timestamp) AS INTEGER) AS hour
  FROM (SELECT CellID AS grid_id,
               {_nan0('callin')} + {_nan0('callout')} AS call_count,
               {_nan0('smsin')} + {_nan0('smsout')} AS sms_count,
               {_nan0('internet')} AS internet_usage,
               try_cast(datetime AS TIMESTAMP) AS event_timestamp
        FROM raw WHERE CellID IS NOT NULL)
  WHERE event_timestamp IS NOT NULL)"""


def _mapping_cte(name: str, where: str = "") -> str:
    return f"""{name} AS (
  SELECT 'R' || CAST(u.user_id AS VARCHAR) AS grid_id, n.n_name AS region_name, r.r_name AS city
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) u
  LEFT JOIN nation n ON n.n_nationkey = CAST(u.user_id % 25 AS INTEGER)
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  {where})"""


CTE["mapping"] = _mapping_cte("mapping")
CTE["mapping_partial"] = _mapping_cte("mapping_partial", "WHERE u.user_id % 25 < 20")


def _enriched_cte(name: str, mapping: str) -> str:
    return f"""{name} AS (
  SELECT c.grid_id, c.call_count, c.sms_count, c.internet_usage, c.event_timestamp, c.event_date,
         c.hour, m.region_name, m.city
  FROM cleaned c LEFT JOIN (
    SELECT grid_id, region_name, city FROM (
      SELECT *, row_number() OVER (PARTITION BY grid_id
                                   ORDER BY region_name NULLS LAST, city NULLS LAST) AS rn
      FROM {mapping}) WHERE rn = 1) m
  ON c.grid_id = m.grid_id)"""


CTE["enriched"] = _enriched_cte("enriched", "mapping")
CTE["enriched_partial"] = _enriched_cte("enriched_partial", "mapping_partial")


def _usage_cte(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT date, hour, region_name, city, call_count, sms_count, internet_mb,
         {_key('date', 'hour')} AS time_id,
         {_key('region_name', 'city')} AS region_id
  FROM (SELECT event_date AS date, CAST(hour(event_timestamp) AS INTEGER) AS hour,
               coalesce(region_name, grid_id) AS region_name, coalesce(city, 'Unknown') AS city,
               CAST(trunc({_nan0('call_count')}) AS BIGINT) AS call_count,
               CAST(trunc({_nan0('sms_count')}) AS BIGINT) AS sms_count,
               {_nan0('internet_usage')} AS internet_mb
        FROM {source}
        WHERE event_timestamp IS NOT NULL AND event_date IS NOT NULL AND grid_id IS NOT NULL))"""


CTE["usage"] = _usage_cte("usage", "enriched")
CTE["usage_partial"] = _usage_cte("usage_partial", "enriched_partial")

def _star_ctes(sfx: str, usage: str) -> dict[str, str]:
    return {
        f"dim_time{sfx}": f"""dim_time{sfx} AS (
  SELECT DISTINCT time_id, date, hour, CAST(day(date) AS INTEGER) AS day,
         CAST(month(date) AS INTEGER) AS month, dayname(date) AS weekday
  FROM {usage})""",
        f"dim_region{sfx}": f"""dim_region{sfx} AS (SELECT DISTINCT region_id, region_name, city FROM {usage})""",
        f"fact{sfx}": f"""fact{sfx} AS (
  SELECT {_key('time_id', 'region_id', 'call_count', 'sms_count', 'inet', 'ord')} AS usage_id,
         time_id, region_id, call_count, sms_count, internet_mb
  FROM (SELECT *, row_number() OVER (PARTITION BY time_id, region_id, call_count, sms_count, inet
                                     ORDER BY internet_mb) AS ord
        FROM (SELECT *, CAST(CAST(internet_mb AS DECIMAL(18,4)) AS VARCHAR) AS inet FROM {usage})))""",
        f"star_rows{sfx}": f"""star_rows{sfx} AS (
  SELECT r.region_name, r.city, t.date, t.hour, f.call_count, f.sms_count, f.internet_mb
  FROM fact{sfx} f JOIN dim_time{sfx} t ON f.time_id = t.time_id
  JOIN dim_region{sfx} r ON f.region_id = r.region_id)""",
    }


CTE.update(_star_ctes("", "usage"))

CTE["flat"] = """flat AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
         'R' || CAST(user_id AS VARCHAR) AS grid_id,
         CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0.0 END AS call_count,
         CASE WHEN event_type IN ('signup', 'purchase') THEN value ELSE 0.0 END AS sms_count,
         CASE WHEN event_type = 'error' THEN value ELSE 0.0 END AS internet_usage
  FROM events)"""

CTE["flat_clean"] = """flat_clean AS (
  SELECT DISTINCT timestamp, grid_id, call_count, sms_count, internet_usage,
         CAST(hour(timestamp) AS INTEGER) AS hour, CAST(timestamp AS DATE) AS day
  FROM (SELECT try_cast(timestamp AS TIMESTAMP) AS timestamp, grid_id,
               call_count, sms_count, internet_usage FROM flat)
  WHERE timestamp IS NOT NULL AND grid_id IS NOT NULL
    AND call_count IS NOT NULL AND NOT isnan(call_count)
    AND sms_count IS NOT NULL AND NOT isnan(sms_count)
    AND internet_usage IS NOT NULL AND NOT isnan(internet_usage)
    AND call_count >= 0 AND sms_count >= 0 AND internet_usage >= 0)"""

def _feature_ctes(sfx: str) -> dict[str, str]:
    return {
        f"rows{sfx}": f"""rows{sfx} AS (
  SELECT r.region_name, t.date, t.hour, k.total_usage
  FROM (SELECT region_id, time_id, SUM(call_count + sms_count + internet_mb) AS total_usage
        FROM fact{sfx} GROUP BY region_id, time_id) k
  JOIN dim_region{sfx} r ON k.region_id = r.region_id JOIN dim_time{sfx} t ON k.time_id = t.time_id)""",
        f"daily{sfx}": f"""daily{sfx} AS (
  SELECT region_name, date, SUM(total_usage) AS total_usage FROM rows{sfx}
  WHERE region_name IS NOT NULL AND date IS NOT NULL GROUP BY region_name, date)""",
        f"growth{sfx}": f"""growth{sfx} AS (
  SELECT region_name, date, total_usage, prev_usage,
         CASE WHEN prev_usage > 0 THEN (total_usage - prev_usage) / prev_usage ELSE 0.0 END AS growth_rate
  FROM (SELECT *, lag(total_usage, 1) OVER (PARTITION BY region_name ORDER BY date) AS prev_usage
        FROM daily{sfx}))""",
        f"stats{sfx}": f"""stats{sfx} AS (
  SELECT region_name, AVG(total_usage) AS avg_usage, AVG(growth_rate) AS growth_rate,
         coalesce(stddev_samp(total_usage), 0.0) AS variability
  FROM growth{sfx} GROUP BY region_name)""",
        f"hourly{sfx}": f"""hourly{sfx} AS (
  SELECT region_name, hour, SUM(total_usage) AS total_usage FROM rows{sfx}
  WHERE region_name IS NOT NULL AND hour IS NOT NULL GROUP BY region_name, hour)""",
        f"ratio{sfx}": f"""ratio{sfx} AS (
  SELECT region_name, CASE WHEN AVG(total_usage) > 0 THEN MAX(total_usage) / AVG(total_usage)
                           ELSE 0.0 END AS peak_ratio
  FROM hourly{sfx} GROUP BY region_name)""",
        f"features{sfx}": f"""features{sfx} AS (
  SELECT s.region_name, coalesce(s.avg_usage, 0.0) AS avg_usage, coalesce(s.growth_rate, 0.0) AS growth_rate,
         coalesce(s.variability, 0.0) AS variability, coalesce(p.peak_ratio, 0.0) AS peak_ratio
  FROM stats{sfx} s LEFT JOIN ratio{sfx} p ON s.region_name = p.region_name)""",
    }


CTE.update(_feature_ctes(""))

# The benchmark adapter: lineitem rows as cleaned usage, supplier -> nation -> region lookup.
CTE["enriched_li"] = """enriched_li AS (
  SELECT CAST(l.l_suppkey AS VARCHAR) AS grid_id, CAST(l.l_quantity AS DOUBLE) AS call_count,
         CAST(l.l_linenumber AS DOUBLE) AS sms_count, CAST(l.l_extendedprice AS DOUBLE) AS internet_usage,
         l.l_shipdate + to_hours(CAST(l.l_orderkey % 24 AS INTEGER)) AS event_timestamp,
         CAST(l.l_shipdate + to_hours(CAST(l.l_orderkey % 24 AS INTEGER)) AS DATE) AS event_date,
         CAST(hour(l.l_shipdate + to_hours(CAST(l.l_orderkey % 24 AS INTEGER))) AS INTEGER) AS hour,
         n.n_name AS region_name, r.r_name AS city
  FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  WHERE l.l_shipdate IS NOT NULL AND l.l_suppkey IS NOT NULL)"""
CTE["usage_li"] = _usage_cte("usage_li", "enriched_li")
CTE.update(_star_ctes("_li", "usage_li"))
CTE.update(_feature_ctes("_li"))

CTE["labelled"] = """labelled AS (
  SELECT f.*, CASE WHEN avg_usage >= q.p90 THEN 'HIGH' WHEN avg_usage >= q.p50 THEN 'MEDIUM'
                   ELSE 'LOW' END AS label
  FROM features f, (SELECT quantile_cont(avg_usage, 0.5) AS p50, quantile_cont(avg_usage, 0.9) AS p90
                    FROM features) q)"""

# What each CTE reads, so a statement can list only its final step.
DEPENDS = {
    "raw": [], "cleaned": ["raw"], "mapping": [], "mapping_partial": [],
    "enriched": ["cleaned", "mapping"], "enriched_partial": ["cleaned", "mapping_partial"],
    "usage": ["enriched"], "usage_partial": ["enriched_partial"],
    "flat": [], "flat_clean": ["flat"], "labelled": ["features"],
    "enriched_li": [], "usage_li": ["enriched_li"],
}
for _sfx, _usage in (("", "usage"), ("_li", "usage_li")):
    DEPENDS.update({
        f"dim_time{_sfx}": [_usage], f"dim_region{_sfx}": [_usage], f"fact{_sfx}": [_usage],
        f"star_rows{_sfx}": [f"fact{_sfx}", f"dim_time{_sfx}", f"dim_region{_sfx}"],
        f"rows{_sfx}": [f"fact{_sfx}", f"dim_time{_sfx}", f"dim_region{_sfx}"],
        f"daily{_sfx}": [f"rows{_sfx}"], f"growth{_sfx}": [f"daily{_sfx}"], f"stats{_sfx}": [f"growth{_sfx}"],
        f"hourly{_sfx}": [f"rows{_sfx}"], f"ratio{_sfx}": [f"hourly{_sfx}"],
        f"features{_sfx}": [f"stats{_sfx}", f"ratio{_sfx}"],
    })


def _closure(names):
    order: list[str] = []

    def visit(n):
        for dep in DEPENDS[n]:
            visit(dep)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    return order


def with_ctes(names, body: str, extra: tuple[str, ...] = ()) -> str:
    return "WITH " + ",\n".join([CTE[n] for n in _closure(names)] + list(extra)) + "\n" + body


def rnd(x: str) -> str:
    """Comparison rounding, as in the Spark catalog: nudge exact ties, then 12 significant
    digits but at most 10 decimal places."""
    n = f"(({x}) + ({x}) * 1e-13)"
    k = f"least(11 - floor(log10(abs({n}))), 10)"
    return (f"(CASE WHEN ({x}) IS NULL OR ({x}) = 0 OR isnan({x}) OR isinf({x}) THEN ({x}) "
            f"WHEN {k} >= 0 THEN round({n} * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round({n} / pow(10.0, -{k})) * pow(10.0, -{k}) END)")


def r6(x: str, alias: str) -> str:
    return f"{rnd(x)} AS {alias}"


REGION = "nation_3"

SQL: dict[str, str] = {}

SQL["S1_scan_raw_csv"] = with_ctes(["raw"], """SELECT datetime, CellID, countrycode,
  smsin, smsout, callin,
  callout, internet FROM raw""")

SQL["S2_scan_region_mapping"] = with_ctes(["mapping"], "SELECT grid_id, region_name, city FROM mapping")

SQL["S4_scan_flat_csv"] = with_ctes(["flat"], """SELECT timestamp, grid_id,
  CAST(call_count AS VARCHAR) AS call_count, CAST(sms_count AS VARCHAR) AS sms_count,
  CAST(internet_usage AS VARCHAR) AS internet_usage FROM flat""")

_ENRICHED_COLS = """grid_id, call_count, sms_count, internet_usage, event_timestamp, event_date, hour, region_name, city"""

SQL["S5_K1_scan_cleaned"] = with_ctes(["enriched"], f"SELECT {_ENRICHED_COLS} FROM enriched")

SQL["S6_J2_J3_star_rows"] = with_ctes(["star_rows"], """SELECT region_name, city, date, hour,
  call_count, sms_count, internet_mb FROM star_rows""")

SQL["P1_P7_clean_raw"] = with_ctes(["cleaned"], """SELECT grid_id, call_count,
  sms_count, internet_usage, event_timestamp, event_date, hour
  FROM cleaned""")

SQL["S3_missing_mapping"] = SQL["P1_P7_clean_raw"]

_DAY = "coalesce(CAST(event_date AS VARCHAR), '')"
SQL["K2_summaries_round_trip"] = with_ctes(["enriched"], f"""
  SELECT 'calls_per_hour' AS summary, CAST(hour AS VARCHAR) AS key, {r6('SUM(call_count)', 'value')} FROM enriched GROUP BY hour
  UNION ALL SELECT 'sms_per_region_day', {_DAY} || '|' || grid_id, {rnd('SUM(sms_count)')} FROM enriched GROUP BY event_date, grid_id
  UNION ALL SELECT 'internet_per_day', {_DAY}, {rnd('SUM(internet_usage)')} FROM enriched GROUP BY event_date
  UNION ALL SELECT * FROM (SELECT 'top_5_peak_hours', CAST(hour AS VARCHAR),
    {rnd('SUM(call_count + sms_count + internet_usage)')} FROM enriched GROUP BY hour
    ORDER BY SUM(call_count + sms_count + internet_usage) DESC, hour LIMIT 5)""")

SQL["S4_P1_P7_clean_flat_usage"] = with_ctes(["flat"], f"""SELECT grid_id,
  {rnd(_nan0('call_count'))} AS call_count, {rnd(_nan0('sms_count'))} AS sms_count,
  {rnd(_nan0('internet_usage'))} AS internet_usage, event_timestamp,
  CAST(event_timestamp AS DATE) AS event_date, CAST(hour(event_timestamp) AS INTEGER) AS hour
  FROM (SELECT *, try_cast(timestamp AS TIMESTAMP) AS event_timestamp FROM flat WHERE grid_id IS NOT NULL)
  WHERE event_timestamp IS NOT NULL""")

SQL["P9_activity_long"] = with_ctes(["cleaned"], """
  SELECT grid_id, event_timestamp, event_date, hour, 'call' AS activity_type, call_count AS activity_value FROM cleaned
  UNION ALL
  SELECT grid_id, event_timestamp, event_date, hour, 'sms', sms_count FROM cleaned
  UNION ALL
  SELECT grid_id, event_timestamp, event_date, hour, 'internet', internet_usage FROM cleaned""")

SQL["P10_Q3_F4_F5_D2_clean_flat"] = with_ctes(["flat_clean"], f"""SELECT timestamp, grid_id,
  {r6('call_count', 'call_count')}, {r6('sms_count', 'sms_count')}, {r6('internet_usage', 'internet_usage')},
  hour, day FROM flat_clean""")

SQL["Q6_quality_profile"] = with_ctes(["flat"], """SELECT
  CAST(COUNT(*) AS BIGINT) AS rows,
  CAST(COUNT(*) FILTER (WHERE try_cast(timestamp AS TIMESTAMP) IS NULL) AS BIGINT) AS missing_timestamps,
  CAST(COUNT(*) FILTER (WHERE call_count < 0) AS BIGINT) AS negative_call_count,
  CAST(COUNT(*) FILTER (WHERE sms_count < 0) AS BIGINT) AS negative_sms_count,
  CAST(COUNT(*) FILTER (WHERE internet_usage < 0) AS BIGINT) AS negative_internet_usage,
  CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT try_cast(timestamp AS TIMESTAMP), grid_id,
       call_count, sms_count, internet_usage FROM flat)) AS BIGINT) AS duplicate_rows
  FROM flat""")

SQL["J1_enrich_region"] = with_ctes(["enriched"], f"SELECT {_ENRICHED_COLS} FROM enriched")
SQL["J1_enrich_region_partial"] = with_ctes(["enriched_partial"],
                                            f"SELECT {_ENRICHED_COLS} FROM enriched_partial")

SQL["D1_dedup_mapping"] = with_ctes(["mapping"], """SELECT grid_id, region_name, city FROM (
  SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY region_name NULLS LAST, city NULLS LAST) AS rn
  FROM (SELECT grid_id, region_name, city FROM mapping
        UNION ALL
        SELECT 'R' || CAST(u.user_id AS VARCHAR), n.n_name, CAST(NULL AS VARCHAR)
        FROM (SELECT DISTINCT user_id FROM events) u
        JOIN nation n ON n.n_nationkey = (u.user_id + 1) % 25))
  WHERE rn = 1""")

SQL["J7_enrich_plan"] = """SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
  CASE WHEN c_custkey % 3 <> 0 THEN 'Plan ' || (c_custkey % 7) ELSE 'Premium Plus' END AS plan_name,
  CAST(CASE WHEN c_custkey % 3 <> 0 THEN 1000 * (c_custkey % 5) ELSE 25000 END AS INTEGER) AS data_limit_mb,
  CAST(CASE WHEN c_custkey % 3 <> 0 THEN 100 ELSE 1200 END AS INTEGER) AS voice_limit_minutes,
  CAST(CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 50 ELSE 1000 END AS INTEGER) AS sms_limit,
  'ACTIVE' AS status FROM customer"""

SQL["A2_calls_per_hour"] = with_ctes(["enriched"], f"""SELECT hour, {r6('SUM(call_count)', 'total_calls')}
  FROM enriched GROUP BY hour""")
SQL["A3_sms_per_region_day"] = with_ctes(["enriched"], f"""SELECT event_date, grid_id,
  {r6('SUM(sms_count)', 'total_sms')} FROM enriched GROUP BY event_date, grid_id""")
SQL["A4_internet_per_day"] = with_ctes(["enriched"], f"""SELECT event_date,
  {r6('SUM(internet_usage)', 'total_internet_usage')} FROM enriched GROUP BY event_date""")
SQL["A5_top_5_peak_hours"] = with_ctes(["enriched"], f"""SELECT hour,
  {r6('SUM(call_count + sms_count + internet_usage)', 'total_usage')} FROM enriched GROUP BY hour
  ORDER BY SUM(call_count + sms_count + internet_usage) DESC, hour LIMIT 5""")

SQL["A6_daily_usage"] = with_ctes(["flat_clean"], f"""SELECT day, {r6('SUM(call_count)', 'total_calls')},
  {r6('SUM(sms_count)', 'total_sms')}, {r6('SUM(internet_usage)', 'total_internet_usage')}
  FROM flat_clean WHERE day IS NOT NULL GROUP BY day""")
SQL["A7_usage_per_region"] = with_ctes(["flat_clean"], f"""SELECT grid_id, {r6('SUM(call_count)', 'call_count')},
  {r6('SUM(sms_count)', 'sms_count')}, {r6('SUM(internet_usage)', 'internet_usage')}
  FROM flat_clean WHERE grid_id IS NOT NULL GROUP BY grid_id""")
SQL["A8_avg_usage_per_hour"] = with_ctes(["flat_clean"], f"""SELECT hour, {r6('AVG(call_count)', 'avg_calls')},
  {r6('AVG(sms_count)', 'avg_sms')}, {r6('AVG(internet_usage)', 'avg_internet_usage')}
  FROM flat_clean WHERE hour IS NOT NULL GROUP BY hour""")
SQL["A9_peak_usage_hour"] = with_ctes(["flat_clean"], f"""SELECT hour AS peak_usage_hour,
  {r6('SUM(call_count + sms_count + internet_usage)', 'total_usage')} FROM flat_clean
  WHERE hour IS NOT NULL GROUP BY hour ORDER BY SUM(call_count + sms_count + internet_usage) DESC, hour LIMIT 1""")
SQL["A10_total_rows"] = with_ctes(["flat_clean"], "SELECT CAST(COUNT(*) AS BIGINT) AS total_rows FROM flat_clean")
SQL["A23_grid_top20"] = with_ctes(["flat"], f"""SELECT grid_id,
  {r6('coalesce(SUM(internet_usage), 0.0)', 'internet_usage')} FROM flat WHERE grid_id IS NOT NULL
  GROUP BY grid_id ORDER BY SUM(internet_usage) DESC, grid_id LIMIT 20""")

SQL["T1_dim_time"] = with_ctes(["dim_time"], "SELECT * FROM dim_time")
SQL["T2_dim_region"] = with_ctes(["dim_region"], "SELECT * FROM dim_region")
SQL["T2_dim_region_partial"] = with_ctes(["usage_partial"],
                                         "SELECT DISTINCT region_id, region_name, city FROM usage_partial")
SQL["T3_fact_usage"] = with_ctes(["fact"], """SELECT usage_id, time_id, region_id, call_count, sms_count,
  internet_mb FROM fact""")
SQL["T1_T4_star_by_day"] = SQL["T3_fact_usage"]
SQL["Q7_Q8_Q9_star_checks"] = with_ctes(["fact", "dim_time", "dim_region"], """
  SELECT 'primary_key' AS check_name, 'dim_time.time_id' AS target,
         CAST((SELECT COUNT(*) FROM (SELECT time_id FROM dim_time GROUP BY time_id HAVING COUNT(*) > 1)) AS BIGINT) AS violations
  UNION ALL SELECT 'primary_key', 'dim_region.region_id',
         CAST((SELECT COUNT(*) FROM (SELECT region_id FROM dim_region GROUP BY region_id HAVING COUNT(*) > 1)) AS BIGINT)
  UNION ALL SELECT 'primary_key', 'fact_usage.usage_id',
         CAST((SELECT COUNT(*) FROM (SELECT usage_id FROM fact GROUP BY usage_id HAVING COUNT(*) > 1)) AS BIGINT)
  UNION ALL SELECT 'foreign_key', 'fact_usage.time_id',
         CAST((SELECT COUNT(*) FROM fact WHERE time_id NOT IN (SELECT time_id FROM dim_time)) AS BIGINT)
  UNION ALL SELECT 'foreign_key', 'fact_usage.region_id',
         CAST((SELECT COUNT(*) FROM fact WHERE region_id NOT IN (SELECT region_id FROM dim_region)) AS BIGINT)
  UNION ALL SELECT 'not_null', 'dim_time', CAST(0 AS BIGINT)
  UNION ALL SELECT 'not_null', 'dim_region', CAST(0 AS BIGINT)
  UNION ALL SELECT 'not_null', 'fact_usage', CAST(0 AS BIGINT)""")

_TOTAL = "f.call_count + f.sms_count + f.internet_mb"

SQL["A12_summary_totals"] = with_ctes(["fact"], f"""SELECT
  CAST(coalesce(SUM(call_count), 0) AS BIGINT) AS total_calls,
  CAST(coalesce(SUM(sms_count), 0) AS BIGINT) AS total_sms,
  {r6('coalesce(SUM(internet_mb), 0.0)', 'total_internet_mb')} FROM fact""")
SQL["A13_usage_by_hour"] = with_ctes(["fact", "dim_time"], f"""SELECT t.hour, {r6(f'SUM({_TOTAL})', 'total_usage')}
  FROM fact f JOIN dim_time t ON f.time_id = t.time_id GROUP BY t.hour""")
SQL["A14_usage_by_region"] = with_ctes(["fact", "dim_region"], f"""SELECT r.region_name,
  {r6(f'SUM({_TOTAL})', 'total_usage')}
  FROM fact f JOIN dim_region r ON f.region_id = r.region_id GROUP BY r.region_name""")

_REGION_JOIN = f"""FROM fact f JOIN dim_time t ON f.time_id = t.time_id
  JOIN dim_region r ON f.region_id = r.region_id WHERE lower(r.region_name) = lower('{REGION}')"""

SQL["A15_region_hourly"] = with_ctes(["fact", "dim_time", "dim_region"], f"""SELECT t.hour,
  {r6('CAST(SUM(f.call_count) AS DOUBLE)', 'calls')}, {r6('CAST(SUM(f.sms_count) AS DOUBLE)', 'sms')},
  {r6('SUM(f.internet_mb)', 'internet_mb')} {_REGION_JOIN} GROUP BY t.hour""")
SQL["A16_region_trend"] = with_ctes(["fact", "dim_time", "dim_region"], f"""SELECT t.hour,
  {r6('AVG(f.call_count)', 'calls')}, {r6('AVG(f.sms_count)', 'sms')},
  {r6('AVG(f.internet_mb)', 'internet_mb')} {_REGION_JOIN} GROUP BY t.hour""")
SQL["E2_region_usage"] = with_ctes(["fact", "dim_time", "dim_region"], f"""
  SELECT 'hourly_distribution' AS kind, t.hour, {r6('CAST(SUM(f.call_count) AS DOUBLE)', 'calls')},
         {r6('CAST(SUM(f.sms_count) AS DOUBLE)', 'sms')}, {r6('SUM(f.internet_mb)', 'internet_mb')}
  {_REGION_JOIN} GROUP BY t.hour
  UNION ALL
  SELECT 'trend', t.hour, {rnd('AVG(f.call_count)')}, {rnd('AVG(f.sms_count)')}, {rnd('AVG(f.internet_mb)')}
  {_REGION_JOIN} GROUP BY t.hour""")

SQL["A17_region_hour_calls"] = with_ctes(["fact", "dim_time", "dim_region"], """SELECT r.region_name, t.hour,
  CAST(SUM(f.call_count) AS BIGINT) AS total_calls
  FROM fact f JOIN dim_time t ON f.time_id = t.time_id JOIN dim_region r ON f.region_id = r.region_id
  GROUP BY r.region_name, t.hour ORDER BY total_calls DESC, r.region_name, t.hour LIMIT 10""")

SQL["A17_region_hour_calls_lineitem"] = """WITH li AS (
  SELECT CAST(l.l_suppkey AS VARCHAR) AS grid_id, l.l_quantity AS call_count,
         l.l_shipdate + to_hours(CAST(l.l_orderkey % 24 AS INTEGER)) AS ts,
         n.n_name AS region_name, r.r_name AS city
  FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT coalesce(region_name, grid_id) AS region_name, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(SUM(CAST(trunc(coalesce(call_count, 0.0)) AS INTEGER)) AS BIGINT) AS total_calls
FROM li WHERE ts IS NOT NULL AND grid_id IS NOT NULL
GROUP BY 1, 2 ORDER BY total_calls DESC, region_name, hour LIMIT 10"""

def _usage_summary_sql(sfx: str) -> str:
    return with_ctes([f"fact{sfx}", f"dim_time{sfx}", f"dim_region{sfx}"], f"""
  SELECT CAST(coalesce(SUM(call_count), 0) AS BIGINT) AS total_calls,
         CAST(coalesce(SUM(sms_count), 0) AS BIGINT) AS total_sms,
         {r6('coalesce(SUM(internet_mb), 0.0)', 'total_internet_mb')},
         (SELECT list(hour ORDER BY u DESC, hour) FROM (
            SELECT t.hour, SUM({_TOTAL}) AS u FROM fact{sfx} f JOIN dim_time{sfx} t ON f.time_id = t.time_id
            GROUP BY t.hour ORDER BY u DESC, t.hour LIMIT 3)) AS top_peak_hours,
         (SELECT list(region_name ORDER BY u DESC, region_name) FROM (
            SELECT r.region_name, SUM({_TOTAL}) AS u FROM fact{sfx} f JOIN dim_region{sfx} r
              ON f.region_id = r.region_id
            GROUP BY r.region_name ORDER BY u DESC, r.region_name LIMIT 3)) AS top_busiest_regions
  FROM fact{sfx}""")


SQL["E1_usage_summary"] = _usage_summary_sql("")
SQL["E1_usage_summary_lineitem"] = _usage_summary_sql("_li")

SQL["E3_peak_traffic"] = with_ctes(["fact", "dim_time", "dim_region"], f"""
  SELECT * FROM (SELECT 'top_hours' AS kind, t.hour, CAST(NULL AS VARCHAR) AS region,
                        {r6(f'SUM({_TOTAL})', 'total_usage')}
                 FROM fact f JOIN dim_time t ON f.time_id = t.time_id GROUP BY t.hour
                 ORDER BY SUM({_TOTAL}) DESC, t.hour LIMIT 5)
  UNION ALL
  SELECT * FROM (SELECT 'top_regions', CAST(NULL AS INTEGER), r.region_name, {rnd(f'SUM({_TOTAL})')}
                 FROM fact f JOIN dim_region r ON f.region_id = r.region_id GROUP BY r.region_name
                 ORDER BY SUM({_TOTAL}) DESC, r.region_name LIMIT 5)""")

_FEATURE_COLS = f"""{r6('avg_usage', 'avg_usage')}, {r6('growth_rate', 'growth_rate')},
  {r6('variability', 'variability')}, {r6('peak_ratio', 'peak_ratio')}"""

SQL["E4_M1b_region_features"] = with_ctes(["fact", "dim_time", "dim_region"], f"""
  SELECT '{REGION}' AS region, {rnd('AVG(total_usage)')} AS avg_usage, {rnd('AVG(growth)')} AS growth_rate,
         {rnd('coalesce(stddev_samp(total_usage), 0.0)')} AS variability,
         {rnd('(SELECT CASE WHEN AVG(total_usage) > 0 THEN MAX(total_usage) / AVG(total_usage) ELSE 0.0 END FROM one_h)')} AS peak_ratio
  FROM one_g""", extra=(
    f"one AS (SELECT t.date, t.hour, {_TOTAL} AS total_usage {_REGION_JOIN})",
    "one_d AS (SELECT date, SUM(total_usage) AS total_usage FROM one GROUP BY date)",
    """one_g AS (SELECT total_usage, CASE WHEN prev > 0 THEN (total_usage - prev) / prev ELSE 0.0 END AS growth
             FROM (SELECT *, lag(total_usage) OVER (ORDER BY date) AS prev FROM one_d))""",
    "one_h AS (SELECT hour, SUM(total_usage) AS total_usage FROM one GROUP BY hour)"))

SQL["A18_daily_region_usage"] = with_ctes(["daily"], f"""SELECT region_name, date,
  {r6('total_usage', 'total_usage')} FROM daily""")
SQL["W1_W2_growth"] = with_ctes(["growth"], f"""SELECT region_name, date, {r6('total_usage', 'total_usage')},
  {r6('prev_usage', 'prev_usage')}, {r6('growth_rate', 'growth_rate')} FROM growth""")
SQL["A19_region_stats"] = with_ctes(["stats"], f"""SELECT region_name, {r6('avg_usage', 'avg_usage')},
  {r6('growth_rate', 'growth_rate')}, {r6('variability', 'variability')} FROM stats""")
SQL["A20_hour_region_usage"] = with_ctes(["hourly"], f"""SELECT region_name, hour,
  {r6('total_usage', 'total_usage')} FROM hourly""")
SQL["A21_peak_ratio"] = with_ctes(["ratio"], f"SELECT region_name, {r6('peak_ratio', 'peak_ratio')} FROM ratio")
SQL["M1_features"] = with_ctes(["features"], f"SELECT region_name, {_FEATURE_COLS} FROM features")
SQL["O9_preview"] = SQL["M1_features"] + " ORDER BY region_name LIMIT 5"
SQL["M2_label_risk"] = with_ctes(["labelled"], f"SELECT region_name, {_FEATURE_COLS}, label FROM labelled")
SQL["M3_split"] = with_ctes(["labelled"], """SELECT region_name, label,
  CASE WHEN rk <= n_test THEN 'test' ELSE 'train' END AS split
  FROM (SELECT region_name, label,
               row_number() OVER (PARTITION BY label ORDER BY md5(region_name || '|42')) AS rk,
               CAST(round(COUNT(*) OVER (PARTITION BY label) * 0.2) AS BIGINT) AS n_test
        FROM labelled)""")

SQL["Q10_range_check"] = with_ctes(["features"], f"""SELECT region,
  {rnd('avg_usage')} AS avg_usage, {rnd('growth_rate')} AS growth_rate, {rnd('variability')} AS variability,
  {rnd('peak_ratio')} AS peak_ratio,
  CASE WHEN err = '' THEN NULL ELSE err END AS error
  FROM (SELECT *, concat_ws('; ',
          CASE WHEN avg_usage IS NULL THEN 'Missing feature: avg_usage' END,
          CASE WHEN growth_rate IS NULL THEN 'Missing feature: growth_rate' END,
          CASE WHEN variability IS NULL THEN 'Missing feature: variability' END,
          CASE WHEN avg_usage < 0 THEN 'avg_usage: input should be greater than or equal to 0' END,
          CASE WHEN variability < 0 THEN 'variability: input should be greater than or equal to 0' END,
          CASE WHEN peak_ratio < 0 THEN 'peak_ratio: input should be greater than or equal to 0' END) AS err
        FROM (SELECT region_name AS region, avg_usage - variability AS avg_usage, growth_rate, variability,
                     coalesce(CASE WHEN growth_rate >= 0 THEN peak_ratio END, 1.0) AS peak_ratio
              FROM features))""")

SQL["A2_calls_per_hour_lineitem"] = with_ctes(["enriched_li"], f"""SELECT hour,
  {r6('SUM(call_count)', 'total_calls')} FROM enriched_li GROUP BY hour""")
SQL["A5_top_5_peak_hours_lineitem"] = with_ctes(["enriched_li"], f"""SELECT hour,
  {r6('SUM(call_count + sms_count + internet_usage)', 'total_usage')} FROM enriched_li GROUP BY hour
  ORDER BY SUM(call_count + sms_count + internet_usage) DESC, hour LIMIT 5""")
SQL["T3_fact_usage_lineitem"] = with_ctes(["fact_li"], """SELECT usage_id, time_id, region_id, call_count,
  sms_count, internet_mb FROM fact_li""")
SQL["M1_features_lineitem"] = with_ctes(["features_li"], f"SELECT region_name, {_FEATURE_COLS} FROM features_li")


def _profile_sql() -> str:
    numeric = [("call_count", "double"), ("sms_count", "double"), ("internet_usage", "double"), ("hour", "int")]
    other = [("timestamp", "timestamp_ntz"), ("grid_id", "string"), ("day", "date")]
    parts = []
    for name, dtype in numeric:
        parts.append(f"""SELECT '{name}' AS "column", '{dtype}' AS dtype, COUNT({name}) AS count,
  COUNT(*) - COUNT({name}) AS nulls, {rnd(f'AVG({name})')} AS mean, {rnd(f'stddev_samp({name})')} AS std,
  {rnd(f'CAST(MIN({name}) AS DOUBLE)')} AS min, {rnd(f'quantile_cont({name}, 0.25)')} AS p25,
  {rnd(f'quantile_cont({name}, 0.5)')} AS p50, {rnd(f'quantile_cont({name}, 0.75)')} AS p75,
  {rnd(f'CAST(MAX({name}) AS DOUBLE)')} AS max, CAST(NULL AS BIGINT) AS "unique",
  CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM flat_clean""")
    for name, dtype in other:
        top = f"""(SELECT CAST({name} AS VARCHAR) AS v, COUNT(*) AS c FROM flat_clean WHERE {name} IS NOT NULL
             GROUP BY 1 ORDER BY c DESC, v LIMIT 1)"""
        parts.append(f"""SELECT '{name}', '{dtype}', COUNT({name}), COUNT(*) - COUNT({name}),
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), COUNT(DISTINCT {name}),
  (SELECT v FROM {top}), (SELECT c FROM {top}) FROM flat_clean""")
    return with_ctes(["flat_clean"], "\nUNION ALL\n".join(parts))


SQL["Q6b_profile_columns"] = _profile_sql()

# The landing fixture holds one flat CSV file per event day (part numbers left
# out); the day of the month modulo 6 decides what a file is like, and every
# fifth day counts as already ingested.
CTE["landing"] = """landing AS (
  SELECT 'usage_' || strftime(day, '%Y-%m-%d') AS file_name, dayofmonth(day) AS n, dayofmonth(day) % 6 AS kind
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL))"""
DEPENDS["landing"] = []

_VALID = "kind IN (0, 3, 4)"
_REASON = """CASE kind WHEN 1 THEN 'missing required columns' WHEN 2 THEN 'null in required column'
  WHEN 5 THEN 'unreadable or empty file' END"""
SQL["S7_list_landing"] = with_ctes(["landing"], "SELECT file_name FROM landing")
SQL["Q1_validate_files"] = with_ctes(["landing"], f"""SELECT file_name, {_VALID} AS valid,
  {_REASON} AS reason FROM landing""")
_ROUTE = f"""SELECT file_name, {_VALID} AS valid, {_REASON} AS reason,
  CASE WHEN NOT {_VALID} THEN 'rejected' WHEN n % 5 = 0 THEN 'duplicate' ELSE 'accepted' END AS status,
  CASE WHEN {_VALID} AND n % 5 = 0 THEN 'duplicate_' || file_name ELSE file_name END AS target_name
  FROM landing"""
SQL["Q2_route_files"] = with_ctes(["landing"], _ROUTE)
SQL["Q2b_ingest_status"] = with_ctes(["landing"], f"""SELECT status, CAST(COUNT(*) AS BIGINT) AS files
  FROM ({_ROUTE}) GROUP BY status""")
SQL["Q2_J1_K1_ingest_twice"] = with_ctes(["flat", "mapping"], """SELECT f.grid_id, f.call_count, f.sms_count,
  f.internet_usage, CAST(f.timestamp AS TIMESTAMP) AS event_timestamp, CAST(CAST(f.timestamp AS TIMESTAMP) AS DATE) AS event_date,
  CAST(hour(CAST(f.timestamp AS TIMESTAMP)) AS INTEGER) AS hour, m.region_name, m.city
  FROM flat f LEFT JOIN mapping m ON f.grid_id = m.grid_id
  WHERE f.grid_id IS NOT NULL AND dayofmonth(CAST(f.timestamp AS TIMESTAMP)) % 6 IN (0, 3)""")

SQL["S8_A1_records_per_file"] = """SELECT 'activity_' || strftime(ts, '%Y-%m-%d') AS file_name,
  CAST(COUNT(*) AS BIGINT) AS records FROM events WHERE ts IS NOT NULL GROUP BY 1"""

CTE["labelled_li"] = """labelled_li AS (
  SELECT f.*, CASE WHEN avg_usage >= q.p90 THEN 'HIGH' WHEN avg_usage >= q.p50 THEN 'MEDIUM'
                   ELSE 'LOW' END AS label
  FROM features_li f, (SELECT quantile_cont(avg_usage, 0.5) AS p50, quantile_cont(avg_usage, 0.9) AS p90
                       FROM features_li) q)"""
DEPENDS["labelled_li"] = ["features_li"]
SQL["M2_label_risk_lineitem"] = with_ctes(["labelled_li"], f"SELECT region_name, {_FEATURE_COLS}, label FROM labelled_li")

# ---- bad rows -------------------------------------------------------------------------

CTE["flat_dirty"] = """flat_dirty AS (
  SELECT CASE WHEN k = 1 THEN NULL ELSE CAST(timestamp AS TIMESTAMP) END AS timestamp,
         CASE WHEN k <> 6 THEN grid_id END AS grid_id,
         CASE k WHEN 2 THEN -2.5 WHEN 4 THEN 3.0 ELSE call_count END AS call_count,
         CASE k WHEN 3 THEN NULL WHEN 4 THEN 3.0 ELSE sms_count END AS sms_count,
         CASE k WHEN 5 THEN CAST('NaN' AS DOUBLE) WHEN 4 THEN 3.0 ELSE internet_usage END AS internet_usage
  FROM (SELECT event_id % 11 AS k, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
               'R' || CAST(user_id AS VARCHAR) AS grid_id,
               CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0.0 END AS call_count,
               CASE WHEN event_type IN ('signup', 'purchase') THEN value ELSE 0.0 END AS sms_count,
               CASE WHEN event_type = 'error' THEN value ELSE 0.0 END AS internet_usage
        FROM events) CROSS JOIN (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR k = 4)"""
DEPENDS["flat_dirty"] = []
SQL["Q6_quality_profile_dirty"] = with_ctes(["flat_dirty"], """SELECT
  CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) FILTER (WHERE timestamp IS NULL) AS BIGINT) AS missing_timestamps,
  CAST(COUNT(*) FILTER (WHERE call_count < 0) AS BIGINT) AS negative_call_count,
  CAST(COUNT(*) FILTER (WHERE sms_count < 0) AS BIGINT) AS negative_sms_count,
  CAST(COUNT(*) FILTER (WHERE internet_usage < 0) AS BIGINT) AS negative_internet_usage,
  CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM flat_dirty)) AS BIGINT) AS duplicate_rows
  FROM flat_dirty""")
SQL["P10_Q3_F4_F5_D2_clean_flat_dirty"] = with_ctes(["flat_dirty"], """SELECT DISTINCT *,
  CAST(hour(timestamp) AS INTEGER) AS hour, CAST(timestamp AS DATE) AS day FROM flat_dirty
  WHERE timestamp IS NOT NULL AND grid_id IS NOT NULL AND call_count >= 0 AND sms_count >= 0
    AND internet_usage >= 0 AND NOT isnan(internet_usage) AND NOT isnan(call_count) AND NOT isnan(sms_count)""")
SQL["F1_F2_Q3_clean_flat_usage_dirty"] = with_ctes(["flat_dirty"], f"""SELECT grid_id, {_nan0('call_count')} AS call_count,
  {_nan0('sms_count')} AS sms_count, {_nan0('internet_usage')} AS internet_usage, timestamp AS event_timestamp,
  CAST(timestamp AS DATE) AS event_date, CAST(hour(timestamp) AS INTEGER) AS hour
  FROM flat_dirty WHERE timestamp IS NOT NULL AND grid_id IS NOT NULL""")

_REQUIRED = "['timestamp', 'grid_id', 'call_count', 'sms_count', 'internet_usage']"
SQL["Q4_Q5_required"] = """SELECT c.name AS "check", c.message, CAST(n AS BIGINT) AS rows
  FROM (VALUES ('columns', NULL), ('missing column', 'Missing required columns: [''sms_count'']'),
               ('rows', NULL), ('no rows', 'usage data is empty')) c(name, message),
       (SELECT COUNT(*) AS n FROM events)"""
SQL["A11_kpis"] = with_ctes(["flat_clean"], f"""
  SELECT 'total_rows' AS kpi, '' AS key, CAST(COUNT(*) AS DOUBLE) AS value FROM flat_clean
  UNION ALL SELECT * FROM (SELECT 'peak_usage_hour', CAST(hour AS VARCHAR),
    {rnd('SUM(call_count + sms_count + internet_usage)')} FROM flat_clean WHERE hour IS NOT NULL GROUP BY hour
    ORDER BY SUM(call_count + sms_count + internet_usage) DESC, hour LIMIT 1)
  UNION ALL SELECT 'usage_per_region.' || m, key, {rnd('v')} FROM (
    SELECT grid_id AS key, unnest(['call_count', 'sms_count', 'internet_usage']) AS m,
           unnest([SUM(call_count), SUM(sms_count), SUM(internet_usage)]) AS v
    FROM flat_clean WHERE grid_id IS NOT NULL GROUP BY grid_id)
  UNION ALL SELECT 'avg_usage_per_hour.' || m, key, {rnd('v')} FROM (
    SELECT CAST(hour AS VARCHAR) AS key, unnest(['avg_calls', 'avg_sms', 'avg_internet_usage']) AS m,
           unnest([AVG(call_count), AVG(sms_count), AVG(internet_usage)]) AS v
    FROM flat_clean WHERE hour IS NOT NULL GROUP BY hour)""")
SQL["T4_load_star"] = with_ctes(["fact", "dim_time", "dim_region"], """
  SELECT 'dim_time' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows FROM dim_time
  UNION ALL SELECT 'dim_region', CAST(COUNT(*) AS BIGINT) FROM dim_region
  UNION ALL SELECT 'fact_usage', CAST(COUNT(*) AS BIGINT) FROM fact""")

# ---- risk model --------------------------------------------------------------------------

SQL["M4_train_model"] = with_ctes(["labelled"], """SELECT f.position, f.feature, 200 AS trees,
  'LOW|MEDIUM|HIGH' AS labels, t.train_rows
  FROM (VALUES (0, 'avg_usage'), (1, 'growth_rate'), (2, 'variability'), (3, 'peak_ratio')) f(position, feature),
       (SELECT CAST(SUM(n - CAST(round(n * 0.2) AS BIGINT)) AS BIGINT) AS train_rows
        FROM (SELECT COUNT(*) AS n FROM labelled GROUP BY label)) t""")
CTE["judged"] = """judged AS (
  SELECT l.region_name, l.label, CASE WHEN l.variability >= q.p90 THEN 'HIGH' WHEN l.variability >= q.p50 THEN 'MEDIUM'
         ELSE 'LOW' END AS predicted
  FROM labelled l, (SELECT quantile_cont(variability, 0.5) AS p50, quantile_cont(variability, 0.9) AS p90 FROM features) q)"""
DEPENDS["judged"] = ["labelled", "features"]
CTE["per_class"] = """per_class AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score
  FROM (SELECT c.cls, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp
        FROM (SELECT cls, CAST(SUM(CASE WHEN label = cls THEN 1 ELSE 0 END) AS DOUBLE) AS support,
                     CAST(SUM(CASE WHEN predicted = cls THEN 1 ELSE 0 END) AS DOUBLE) AS n_pred,
                     CAST(SUM(CASE WHEN label = cls AND predicted = cls THEN 1 ELSE 0 END) AS DOUBLE) AS tp
              FROM judged, (SELECT DISTINCT cls FROM (SELECT label AS cls FROM judged UNION SELECT predicted FROM judged))
              GROUP BY cls) c))"""
DEPENDS["per_class"] = ["judged"]


def _report_row(label: str, precision: str, recall: str, f1: str, support: str) -> str:
    return (f"SELECT {label} AS label, {rnd(precision)} AS precision, {rnd(recall)} AS recall, {rnd(f1)} AS f1_score, "
            f"CAST({support} AS BIGINT) AS support FROM per_class")


def _weighted(x: str) -> str:
    return f"SUM({x} * support) / SUM(support)"


SQL["M5_evaluate"] = with_ctes(["per_class"], "\nUNION ALL ".join([
    _report_row("cls", "precision", "recall", "f1_score", "support"),
    _report_row("'accuracy'", *["SUM(tp) / SUM(support)"] * 3, "SUM(support)"),
    _report_row("'macro avg'", "AVG(precision)", "AVG(recall)", "AVG(f1_score)", "SUM(support)"),
    _report_row("'weighted avg'", _weighted("precision"), _weighted("recall"), _weighted("f1_score"), "SUM(support)")]))
SQL["M5_confusion_matrix"] = with_ctes(["judged"], """SELECT c.cls AS actual,
  CAST(COUNT(*) FILTER (WHERE label = cls AND predicted = 'HIGH') AS BIGINT) AS "HIGH",
  CAST(COUNT(*) FILTER (WHERE label = cls AND predicted = 'LOW') AS BIGINT) AS "LOW",
  CAST(COUNT(*) FILTER (WHERE label = cls AND predicted = 'MEDIUM') AS BIGINT) AS "MEDIUM"
  FROM judged, (SELECT label AS cls FROM judged UNION SELECT predicted FROM judged) c GROUP BY c.cls""")
CTE["probabilities"] = """probabilities AS (
  SELECT region_name, p_low, p_medium, p_high, greatest(p_low, p_medium, p_high) AS top,
         CASE WHEN p_low >= greatest(p_medium, p_high) THEN 'LOW' WHEN p_medium >= greatest(p_low, p_high) THEN 'MEDIUM'
              ELSE 'HIGH' END AS congestion_risk
  FROM (SELECT region_name, variability / (avg_usage + variability + peak_ratio) AS p_low,
               peak_ratio / (avg_usage + variability + peak_ratio) AS p_medium,
               avg_usage / (avg_usage + variability + peak_ratio) AS p_high FROM features))"""
DEPENDS["probabilities"] = ["features"]
SQL["M6_score_columns"] = with_ctes(["probabilities"], f"""SELECT region_name, congestion_risk,
  {r6('round_even(top, 4)', 'score')}, congestion_risk = 'HIGH' AND top > 0.75 AS anomaly_flag FROM probabilities""")
SQL["M6_K4_K5_score_batch"] = with_ctes(["features"], """SELECT region_name, true AS class_ok, true AS score_ok,
  true AS flag_ok FROM features""")
SQL["M7_E5_predict_risk"] = f"""SELECT region, CASE WHEN error IS NULL THEN 200 ELSE 422 END AS status_code,
  error AS detail, CASE WHEN error IS NULL THEN true END AS ok FROM ({SQL["Q10_range_check"]})"""

# ---- extensions ---------------------------------------------------------------------------

CTE["hourly_series"] = """hourly_series AS (SELECT region_name, date, hour, SUM(call_count) AS calls, SUM(internet_mb) AS internet_mb
  FROM star_rows GROUP BY region_name, date, hour)"""
DEPENDS["hourly_series"] = ["star_rows"]
_LAST_DAY = "OVER (PARTITION BY region_name ORDER BY date, hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
SQL["X1_X2_rolling_averages"] = with_ctes(["hourly_series"], f"""SELECT region_name, date, hour,
  {r6('a', 'avg_call_count')}, {r6('b', 'avg_internet_usage')}
  FROM (SELECT *, AVG(calls) {_LAST_DAY} AS a, AVG(internet_mb) {_LAST_DAY} AS b FROM hourly_series)""")
SQL["X3_peak_hour_flags"] = with_ctes(["star_rows"], f"""SELECT region_name, hour, {r6('u', 'total_usage')},
  row_number() OVER (PARTITION BY region_name ORDER BY u DESC, hour) <= 3 AS peak_hour_flag
  FROM (SELECT region_name, hour, SUM(call_count + sms_count + internet_mb) AS u FROM star_rows GROUP BY region_name, hour)""")
SQL["X4_weekend"] = with_ctes(["dim_time"], "SELECT *, isodow(date) IN (6, 7) AS is_weekend FROM dim_time")
SQL["X5_usage_between"] = with_ctes(["enriched"], """SELECT grid_id, call_count, sms_count, internet_usage, event_timestamp, event_date, hour, region_name, city FROM enriched
  WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'""")
SQL["X6_flag_high_risk"] = with_ctes(["probabilities"], f"""SELECT region_name, {r6('p_high', 'p_high')},
  CASE WHEN p_high >= 0.3 THEN 'HIGH' ELSE congestion_risk END AS congestion_risk FROM probabilities""")
SQL["X7_usage_drift"] = f"""WITH rows AS (
    SELECT CAST(least(greatest(floor(value / 10), 0), 9) AS INTEGER) AS bin, dayofmonth(ts) > 15 AS later
    FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
  counted AS (SELECT b.bin, COUNT(*) FILTER (WHERE NOT later) AS a, COUNT(*) FILTER (WHERE later) AS b
    FROM range(10) b(bin) LEFT JOIN rows r ON r.bin = b.bin GROUP BY b.bin),
  total AS (SELECT SUM(a) AS na, SUM(b) AS nb FROM counted)
  SELECT CAST(na AS BIGINT) AS n_before, CAST(nb AS BIGINT) AS n_after, {rnd('s')} AS psi
  FROM (SELECT na, nb, SUM(((b + 0.5) / (nb + 5.0) - (a + 0.5) / (na + 5.0))
        * ln(((b + 0.5) / (nb + 5.0)) / ((a + 0.5) / (na + 5.0)))) AS s FROM counted, total GROUP BY na, nb)"""
