"""The SQL twins of the catalog's queries, for checking results against another engine."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from ..functions import normal
from ..functions.temporal import DATE_HINT
from ..operators.profile import ID_NAME

SQL: dict[str, str] = {}

GAPPY = """ev AS (
  SELECT event_id, ts, user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 10 <> 0 THEN value END AS value, props FROM events)"""
SCORED = """sc AS (
  SELECT *, CAST(l_quantity + l_partkey % 40 > 45 AS INTEGER) AS label,
         ROUND((l_quantity + l_discount * 100 + l_linenumber) / 70, 4) AS score,
         CAST(ROUND((l_quantity + l_discount * 100 + l_linenumber) / 70, 4) >= 0.5 AS INTEGER) AS prediction
  FROM lineitem)"""
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


def unioned(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- Sources --------------------------------------------------------------------

SQL["S1_csv_scan"] = """
SELECT o_orderstatus, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total, MAX(o_custkey) AS top
FROM orders GROUP BY 1"""
SQL["S3_csv_round_trip"] = """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, event_type, ROUND(value, 6) AS value FROM events, b
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
SQL["S3_parquet_round_trip"] = "SELECT c_custkey, ROUND(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer"
SQL["S4_sensor_text"] = """
SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n,
       COUNT(CASE WHEN event_id % 10 <> 0 AND value / 100 < 99 THEN 1 END) AS speeds,
       COUNT(CASE WHEN value < 99 THEN 1 END) AS waves, COUNT(CASE WHEN event_id % 10 <> 0 THEN 1 END) AS pressures,
       ROUND(AVG(CASE WHEN event_id % 10 <> 0 THEN value END), 4) AS mean_pressure,
       ROUND(SUM(CAST(user_id % 360 AS DOUBLE)), 4) AS directions
FROM events GROUP BY 1"""

# --- Profiling ------------------------------------------------------------------

_EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
                "value": "double", "props": "string"}
SQL["P1_dataset_info"] = f"WITH {GAPPY}\n" + unioned(
    [f"SELECT '{c}' AS \"column\", '{k}' AS dtype, COUNT(*) - COUNT({c}) AS missing, COUNT(*) AS rows FROM ev"
     for c, k in _EVENT_TYPES.items()]
)
SQL["P2_numeric_describe"] = unioned(
    [f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,
ROUND(MIN({c})::DOUBLE, 4) AS min, ROUND(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25,
ROUND(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, ROUND(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75,
ROUND(MAX({c})::DOUBLE, 4) AS max FROM lineitem""" for c in LINE_NUMBERS]
)
SQL["P3_text_describe"] = f"WITH {GAPPY}\n" + unioned(
    [f"""SELECT '{c}' AS "column", (SELECT COUNT(DISTINCT {c}) FROM ev) AS unique_count,
{c} AS most_frequent, n AS frequency
FROM (SELECT {c}, COUNT(*) AS n FROM ev WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {c} LIMIT 1)"""
     for c in ("event_type", "props")]
)
SQL["P4_missing_summary"] = f"""WITH {GAPPY}, m AS (
  SELECT COUNT(*) * 6 AS cells, CAST(SUM((event_type IS NULL)::INT + (value IS NULL)::INT) AS BIGINT) AS missing FROM ev)
SELECT missing AS total_missing, ROUND(missing * 100.0 / cells, 2) AS missing_percentage FROM m"""


def _pearson_pairs(columns: list[str], source: str, with_n: bool = True) -> str:
    n = ", COUNT(*) AS n" if with_n else ""
    return unioned(
        [f"SELECT '{a}' AS x, '{b}' AS y, ROUND(corr({a}::DOUBLE, {b}::DOUBLE), 6) + 0.0 AS r{n} "
         f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(columns, 2)]
    )


SQL["P5_high_correlations"] = f"""
WITH li AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem),
pairs AS ({_pearson_pairs([*LINE_NUMBERS, 'revenue'], 'li')})
SELECT x AS feature1, y AS feature2, ROUND(r, 3) AS correlation FROM pairs WHERE ABS(r) > 0.7"""

_ROLE_TABLE = """rt AS (
  SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS o_day, 'x' AS o_fixed, CAST(NULL AS VARCHAR) AS o_empty,
         year(o_orderdate) AS o_year, o_orderkey AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_half,
         'note ' || CAST(CAST(floor(o_orderkey / 1.5) AS BIGINT) AS VARCHAR) AS o_note,
         'c' || CAST(o_custkey % 60 AS VARCHAR) AS o_code FROM orders)"""
_ROLE_COLUMNS = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number",
    "o_orderdate": "time", "o_orderpriority": "text", "o_day": "text", "o_fixed": "text", "o_empty": "text",
    "o_year": "number", "row_id": "number", "o_half": "text", "o_note": "text", "o_code": "text",
}


def _role_part(column: str, kind: str) -> str:
    rules = ["WHEN n = 0 OR u = 0 THEN 'empty'", "WHEN u = 1 THEN 'constant'"]
    dated = "0"
    if kind == "time":
        rules.append("ELSE 'datetime'")
    elif kind == "number":
        rules += [f"WHEN regexp_matches('{column}', '(?i){ID_NAME}') AND u > 0.9 * n THEN 'id'",
                  "WHEN u <= 15 THEN 'discrete'", "ELSE 'numeric'"]
    else:
        dated = (f"COUNT(CASE WHEN regexp_matches({column}, '{DATE_HINT}') "
                 f"AND TRY_CAST({column} AS TIMESTAMP) IS NOT NULL THEN 1 END)")
        rules += ["WHEN dated >= 0.9 * present THEN 'datetime'", "WHEN u >= 0.95 * n THEN 'id'",
                  "WHEN u >= 0.5 * n THEN 'text'", "WHEN u <= 50 THEN 'categorical'", "ELSE 'high_cardinality'"]
    return f"""SELECT '{column}' AS "column", '{kind}' AS kind, CASE {' '.join(rules)} END AS role, u AS nunique,
ROUND((n - present) * 100.0 / n, 2) AS missing_pct
FROM (SELECT COUNT(*) AS n, COUNT({column}) AS present, COUNT(DISTINCT {column}) AS u, {dated} AS dated FROM rt)"""


_ROLES = unioned([_role_part(c, k) for c, k in _ROLE_COLUMNS.items()])
SQL["P6_column_roles"] = f"""WITH {_ROLE_TABLE}, roles AS ({_ROLES})
SELECT "column", role, nunique, missing_pct FROM roles"""
SQL["P7_type_buckets"] = f"""WITH {_ROLE_TABLE}, roles AS ({_ROLES})
SELECT "column", role, CASE WHEN role = 'datetime' OR kind = 'time' THEN 'datetime' WHEN kind = 'number' THEN 'numeric'
  WHEN role IN ('categorical', 'high_cardinality', 'constant') THEN 'categorical'
  WHEN role IN ('text', 'id') THEN 'text' ELSE 'other' END AS bucket FROM roles"""

SQL["P8_duplicate_summary"] = """
SELECT COUNT(*) - COUNT(DISTINCT text) AS duplicate_count,
       ROUND((COUNT(*) - COUNT(DISTINCT text)) * 100.0 / COUNT(*), 2) AS duplicate_percentage,
       COUNT(*) AS total_rows FROM documents"""
SQL["P8_duplicate_rows"] = """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1"""
SQL["P8_duplicate_preview"] = """
SELECT o_orderkey FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
WHERE k > 1 ORDER BY o_orderkey LIMIT 100"""
SQL["P9_missingness"] = f"""WITH {GAPPY}, m AS (
  SELECT 'event_type' AS "column", COUNT(*) - COUNT(event_type) AS missing, COUNT(*) AS n FROM ev
  UNION ALL SELECT 'value', COUNT(*) - COUNT(value), COUNT(*) FROM ev)
SELECT "column", ROUND(missing * 100.0 / n, 2) AS missing_pct, n AS total_rows,
       COUNT(*) OVER () AS columns_with_missing FROM m WHERE missing > 0"""
SQL["P10_missingness_matrix"] = f"""WITH {GAPPY}, placed AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, COUNT(*) OVER () AS n, event_type, value, props FROM ev),
kept AS (SELECT DISTINCT CASE WHEN n <= 2000 THEN k ELSE CAST(floor(k * (n - 1) / 1999) AS BIGINT) END AS position
  FROM generate_series(0, 1999) AS g(k), (SELECT COUNT(*) AS n FROM ev))
SELECT position, (event_type IS NULL)::INT AS event_type, (value IS NULL)::INT AS value, (props IS NULL)::INT AS props
FROM placed JOIN kept USING (position)"""
SQL["P11_date_likeness"] = f"""WITH o AS (
  SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
SELECT COUNT(d) AS n, ROUND(COUNT(CASE WHEN regexp_matches(d, '{DATE_HINT}') THEN 1 END) / COUNT(d), 6) AS date_shaped,
  ROUND(COUNT(TRY_CAST(d AS TIMESTAMP)) / COUNT(d), 6) AS parsed,
  COUNT(TRY_CAST(d AS TIMESTAMP)) / COUNT(d) >= 0.9 AS is_datetime FROM o"""
SQL["P12_data_size"] = """
SELECT CAST(SUM(16 + strlen(text) + strlen(lang) + strlen(source)) AS BIGINT) AS bytes,
       ROUND(SUM(16 + strlen(text) + strlen(lang) + strlen(source)) / 1048576.0, 2) AS megabytes FROM documents"""

# --- Cleaning -------------------------------------------------------------------

_MODE_TEXT = "(SELECT event_type FROM ev WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)"
_MODE_VALUE = "(SELECT value FROM ev WHERE value IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)"


def _imputed(value: str, text: str = f"COALESCE(event_type, {_MODE_TEXT})", tail: str = "") -> str:
    return f"WITH {GAPPY}\nSELECT event_id, {text} AS event_type, ROUND({value}, 6) AS value FROM ev {tail}"


SQL["C1_impute_mean"] = _imputed("COALESCE(value, (SELECT AVG(value) FROM ev))")
SQL["C2_impute_median"] = _imputed("COALESCE(value, (SELECT quantile_cont(value, 0.5) FROM ev))")
SQL["C3_impute_mode"] = _imputed(f"COALESCE(value, {_MODE_VALUE})")
_CARRY = "last_value({} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SQL["C4_forward_fill"] = _imputed(_CARRY.format("value"), _CARRY.format("event_type"))
SQL["C5_drop_missing"] = _imputed("value", "event_type", "WHERE value IS NOT NULL AND event_type IS NOT NULL")
SQL["C5_fill_then_drop"] = _imputed(
    "COALESCE(value, (SELECT quantile_cont(value, 0.5) FROM ev))", "event_type", "WHERE event_type IS NOT NULL"
)
SQL["L3_drop_missing_subset"] = f"WITH {GAPPY} SELECT event_id, event_type, value FROM ev WHERE value IS NOT NULL"

for _method, _bounds in (
    ("iqr", "SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
            "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev)"),
    ("zscore", "SELECT AVG(value) - 3 * STDDEV_SAMP(value) AS lo, AVG(value) + 3 * STDDEV_SAMP(value) AS hi FROM ev"),
):
    _head = (f"WITH {GAPPY}, b AS ({_bounds}), f AS "
             "(SELECT ev.*, COALESCE(value < lo OR value > hi, FALSE) AS is_outlier, lo, hi FROM ev, b)\n")
    SQL[f"C6_outlier_flags_{_method}"] = _head + "SELECT event_id, is_outlier FROM f"
    SQL[f"C7_outlier_summary_{_method}"] = _head + """SELECT COUNT(*) FILTER (is_outlier) AS outlier_count,
ROUND(ROUND(COUNT(*) FILTER (is_outlier) * 100.0 / COUNT(*), 2), 4) AS outlier_percentage,
ROUND(MAX(lo), 4) AS lower_bound, ROUND(MAX(hi), 4) AS upper_bound FROM f"""
    SQL[f"C7_outlier_preview_{_method}"] = _head + (
        "SELECT event_id, value FROM f WHERE is_outlier ORDER BY event_id LIMIT 100"
    )
    SQL[f"C8_remove_outliers_{_method}"] = _head + "SELECT event_id, value FROM f WHERE NOT is_outlier"

SQL["C9_label_encode"] = f"""WITH {GAPPY}
SELECT event_id, dense_rank() OVER (ORDER BY COALESCE(event_type, 'nan')) - 1 AS event_type FROM ev"""
SQL["C9_label_classes"] = """
SELECT p_name AS level, COUNT(*) AS rows, row_number() OVER (ORDER BY p_name) - 1 AS code FROM part GROUP BY p_name"""
_EVENT_LEVELS = ["click", "error", "purchase", "signup", "view"]
SQL["C10_one_hot"] = f"WITH {GAPPY}\nSELECT event_id, " + ", ".join(
    f"COALESCE(event_type = '{v}', FALSE) AS event_type_{v}" for v in _EVENT_LEVELS
) + " FROM ev"
SQL["C10_one_hot_sparse"] = f"""WITH {GAPPY},
levels AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS position FROM ev WHERE event_type IS NOT NULL GROUP BY event_type)
SELECT event_id, position, levels.event_type AS level FROM ev LEFT JOIN levels ON ev.event_type = levels.event_type"""
for _id, _method, _centre, _width in (
    ("C11", "standard", "AVG", "STDDEV_POP({0})"), ("C12", "minmax", "MIN", "MAX({0}) - MIN({0})"),
):
    SQL[f"{_id}_scale_{_method}"] = f"WITH {GAPPY}\nSELECT event_id, " + ", ".join(
        f"ROUND(({c} - (SELECT {_centre}({c}) FROM ev)) / (SELECT {_width.format(c)} FROM ev), 6) + 0.0 AS {c}"
        for c in ("value", "user_id")
    ) + " FROM ev"
SQL["C11_scale_standard_info"] = f"WITH {GAPPY}\n" + unioned(
    [f"SELECT '{c}' AS \"column\", ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_POP({c}), 6) AS std FROM ev"
     for c in ("value", "user_id")]
)
SQL["C12_scale_minmax_info"] = f"WITH {GAPPY}\n" + unioned(
    [f"SELECT '{c}' AS \"column\", ROUND(MIN({c})::DOUBLE, 6) AS min, ROUND(MAX({c})::DOUBLE, 6) AS max FROM ev"
     for c in ("value", "user_id")]
)

# --- Features -------------------------------------------------------------------

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
SQL["F1_derived_column"] = f"""
SELECT {_KEY}, ROUND(sqrt(l_extendedprice) * (1 - l_discount) / NULLIF(l_quantity - 1, 0) + l_tax, 6) AS derived
FROM lineitem"""


def _product(term: tuple[str, ...]) -> str:
    names = " ".join(c if term.count(c) == 1 else f"{c}^{term.count(c)}" for c in dict.fromkeys(term))
    return f'ROUND({" * ".join(term)}, 6) AS "{names}"'


SQL["F2_polynomial"] = f"SELECT {_KEY}, " + ", ".join(
    _product(p) for d in (2, 3) for p in combinations_with_replacement(["l_quantity", "l_discount"], d)
) + " FROM lineitem"
SQL["F3_interactions"] = f"SELECT {_KEY}, " + ", ".join(
    _product(p) for d in (2, 3) for p in combinations(["l_quantity", "l_discount", "l_tax"], d)
) + " FROM lineitem"
SQL["F4_datetime_parts"] = "WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS ts FROM events)\n" + (
    "SELECT event_id, CAST(COALESCE(isodow(ts) >= 6, FALSE) AS DOUBLE) AS ts_is_weekend, "
    + ", ".join(f"CAST({p}(ts) AS DOUBLE) AS ts_{p}" for p in ("year", "month", "day", "hour", "minute", "second", "quarter"))
    + ", CAST(isodow(ts) - 1 AS DOUBLE) AS ts_dayofweek FROM e"
)
SQL["F5_preview"] = """
SELECT o_orderkey, ROUND(o_totalprice / 1000, 6) AS thousands FROM orders ORDER BY o_orderkey LIMIT 5"""

# --- Grouped aggregates -----------------------------------------------------------

_AGGREGATES = {
    "sum": "COALESCE(SUM(value), 0)", "mean": "AVG(value)", "median": "quantile_cont(value, 0.5)", "min": "MIN(value)",
    "max": "MAX(value)", "std": "STDDEV_SAMP(value)", "var": "VAR_SAMP(value)",
    "first": "arg_min(value, event_id) FILTER (value IS NOT NULL)",
    "last": "arg_max(value, event_id) FILTER (value IS NOT NULL)", "prod": "product(1 + value / 1e6)",
    "sem": "STDDEV_SAMP(value) / SQRT(COUNT(value))", "skew": "skewness(value)", "kurt": "kurtosis(value)",
}
for _name, _text in _AGGREGATES.items():
    SQL[f"A1_{_name}"] = f"""WITH {GAPPY}
SELECT event_type, ROUND({_text}, 4) AS value FROM ev WHERE event_type IS NOT NULL GROUP BY 1"""
for _name, _text in {"count": "COUNT(value)", "size": "COUNT(*)", "nunique": "COUNT(DISTINCT value)"}.items():
    SQL[f"A1_{_name}"] = f"""WITH {GAPPY}
SELECT event_type, {_text} AS value FROM ev WHERE event_type IS NOT NULL GROUP BY 1"""
SQL["A1_global_median"] = "SELECT ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS value FROM lineitem"
SQL["A2_value_counts"] = f"""WITH {GAPPY}
SELECT event_type, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS percent
FROM ev WHERE event_type IS NOT NULL GROUP BY 1"""
SQL["A3_target_distribution"] = """
WITH c AS (SELECT o_orderpriority, COUNT(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, count, ROUND(count * 100.0 / SUM(count) OVER (), 2) AS percent,
       MIN(count) OVER () * 100.0 / SUM(count) OVER () < 30 AS is_imbalanced,
       (SELECT COUNT(*) FROM orders) AS total_samples FROM c"""
SQL["A4_bar_counts"] = """
SELECT p_brand, COUNT(*) AS value, COUNT(*) OVER () AS n_categories FROM part GROUP BY 1
ORDER BY value DESC, p_brand LIMIT 20"""
SQL["A4_bar_median"] = """
SELECT p_brand, ROUND(quantile_cont(p_retailprice, 0.5), 4) AS value, COUNT(*) OVER () AS n_categories
FROM part GROUP BY 1 ORDER BY quantile_cont(p_retailprice, 0.5) DESC, p_brand LIMIT 20"""
_CROSSTAB = """
SELECT b.p_brand, t.p_type, COUNT(p.p_partkey) AS count
FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t
LEFT JOIN part p ON p.p_brand = b.p_brand AND p.p_type = t.p_type GROUP BY 1, 2"""
SQL["A5_crosstab"] = _CROSSTAB
SQL["A5_crosstab_wide"] = """
SELECT l_returnflag, COUNT(*) FILTER (l_linestatus = 'F') AS "F", COUNT(*) FILTER (l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY 1"""
SQL["A6_pivot"] = "SELECT p_brand, p_type, ROUND(AVG(p_retailprice), 4) AS value FROM part GROUP BY 1, 2"
SQL["A6_pivot_wide"] = """
SELECT l_returnflag, ROUND(quantile_cont(l_quantity, 0.5) FILTER (l_linestatus = 'F'), 4) AS "F",
       ROUND(quantile_cont(l_quantity, 0.5) FILTER (l_linestatus = 'O'), 4) AS "O" FROM lineitem GROUP BY 1"""


def folded(source: str, column: str, limit: int = 8) -> str:
    """Common table expressions ``lv`` (levels by size) and ``fd`` (rows with the folded column)."""
    return f"""lv AS (
  SELECT {column} AS level, row_number() OVER (ORDER BY COUNT(*) DESC, {column}) AS k, COUNT(*) OVER () AS levels
  FROM {source} GROUP BY {column}),
fd AS (SELECT s.* REPLACE (CASE WHEN lv.levels <= {limit} OR lv.k < {limit} THEN s.{column} ELSE 'Other' END AS {column})
  FROM {source} s JOIN lv ON s.{column} = lv.level)"""


def stacked(category: str, stack: str, value: str, top: int, share: bool) -> str:
    shown = "COALESCE(value, 0) / total * 100" if share else "COALESCE(value, 0)"
    return f"""WITH {folded('part', stack)},
cells AS (SELECT {category}, {stack}, CAST({value} AS DOUBLE) AS value FROM fd GROUP BY 1, 2),
best AS (SELECT {category}, SUM(value) AS total FROM cells GROUP BY 1 ORDER BY total DESC, {category} LIMIT {top})
SELECT best.{category}, s.{stack}, ROUND({shown}, 4) AS value, ROUND(total, 4) AS total
FROM best CROSS JOIN (SELECT DISTINCT {stack} FROM cells) s
LEFT JOIN cells c ON c.{category} = best.{category} AND c.{stack} = s.{stack}"""


SQL["A7_stacked_values"] = stacked("p_type", "p_brand", "SUM(p_retailprice)", 12, False)
SQL["A7_stacked_shares"] = stacked("p_brand", "p_type", "COUNT(*)", 12, True)


def pareto(totals: str, key: str, tail: str = "") -> str:
    return f"""WITH c AS ({totals}), r AS (
  SELECT {key}, CAST(total AS DOUBLE) AS total, row_number() OVER w AS rank, SUM(total) OVER () AS everything,
         SUM(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM c WINDOW w AS (ORDER BY total DESC, {key}))
SELECT {key}, rank, ROUND(total, 4) AS total, ROUND(total / everything * 100, 4) AS share,
       ROUND(upto / everything * 100, 4) AS cumulative,
       rank = 1 OR (upto - total) / everything * 100 < 80 AS in_80 FROM r {tail}"""


SQL["A8_pareto_counts"] = pareto("SELECT o_custkey, COUNT(*) AS total FROM orders GROUP BY 1", "o_custkey")
SQL["A8_pareto_values"] = pareto(
    "SELECT c_nationkey, SUM(c_acctbal) AS total FROM customer GROUP BY 1 HAVING SUM(c_acctbal) > 0", "c_nationkey")
SQL["A9_waterfall"] = """
WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS category, SUM(c_acctbal) AS v FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY ABS(v) DESC, category) AS k FROM p),
b AS (SELECT CAST(k AS INTEGER) AS position, category, v FROM r WHERE k <= 12
      UNION ALL SELECT 13, 'Other', SUM(v) FROM r WHERE k > 12 HAVING COUNT(*) > 0),
e AS (SELECT *, SUM(v) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             SUM(v) OVER () AS total FROM b)
SELECT position, category, ROUND(v, 4) AS contribution, ROUND(upto - v, 4) + 0.0 AS "start", ROUND(upto, 4) AS "end",
       ROUND(total, 4) AS total FROM e"""
SQL["A10_slope"] = """
WITH o AS (SELECT o_orderpriority, o_totalprice, CAST(year(o_orderdate) AS VARCHAR) AS p FROM orders),
m AS (SELECT MIN(p) AS p0, MAX(p) AS p1 FROM o),
w AS (SELECT o_orderpriority, p0 AS start_period, p1 AS end_period, AVG(o_totalprice) FILTER (p = p0) AS a,
             AVG(o_totalprice) FILTER (p = p1) AS b FROM o, m GROUP BY 1, 2, 3)
SELECT o_orderpriority, start_period, end_period, ROUND(a, 4) AS start_value, ROUND(b, 4) AS end_value,
       ROUND(b - a, 4) AS change FROM w WHERE a IS NOT NULL AND b IS NOT NULL
ORDER BY ABS(b - a) DESC, o_orderpriority LIMIT 8"""
SQL["A11_stat_tile"] = """
SELECT ROUND(AVG(l_extendedprice), 6) AS value, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS compare_value FROM lineitem"""
SQL["A12_fold_rare"] = f"WITH {folded('part', 'p_brand')} SELECT p_partkey, p_brand FROM fd"
SQL["A13_confusion"] = f"WITH {SCORED} SELECT label, prediction, COUNT(*) AS count FROM sc GROUP BY 1, 2"

# --- Distributions ------------------------------------------------------------------


def binned(source: str, bins: int, key: str = "", extra: str = "", prelude: str = "", digits: int = 6) -> str:
    """Counts of column ``x`` on equal-width bins shared by all keys."""
    k = f"{key}, " if key else ""
    same = f"AND c.{key} = s.{key}" if key else ""
    spine = f"(SELECT DISTINCT {key} FROM b) CROSS JOIN" if key else ""
    return f"""WITH {prelude}v AS ({source}),
l AS (SELECT MIN(x) AS lo, MAX(x) AS hi, (MAX(x) - MIN(x)) / {bins}.0::DOUBLE AS w FROM v),
r AS (SELECT v.*, lo, w, LEAST(floor((x - lo) / w), {bins - 1}) AS raw FROM v, l WHERE x IS NOT NULL),
d AS (SELECT *, CASE WHEN raw > 0 AND x < lo + raw * w THEN raw - 1 ELSE raw END AS dn FROM r),
b AS (SELECT *, CAST(CASE WHEN dn < {bins - 1} AND x >= lo + (dn + 1) * w THEN dn + 1 ELSE dn END AS INTEGER) AS bin FROM d),
c AS (SELECT {k}bin, COUNT(*) AS n FROM b GROUP BY ALL),
s AS (SELECT {k}CAST(g.i AS INTEGER) AS bin FROM {spine} generate_series(0, {bins - 1}) AS g(i))
SELECT {f's.{key}, ' if key else ''}s.bin, ROUND(lo + s.bin * w, {digits}) + 0.0 AS "left",
       ROUND(lo + (s.bin + 1) * w, {digits}) + 0.0 AS "right", COALESCE(n, 0) AS count{extra}
FROM s CROSS JOIN l LEFT JOIN c ON c.bin = s.bin {same}"""


_DENSITY = """, ROUND(COALESCE(n, 0) / (SUM(COALESCE(n, 0)) OVER () * ((lo + (s.bin + 1) * w) - (lo + s.bin * w))), 8) AS density"""
SQL["D1_histogram"] = binned("SELECT l_extendedprice AS x FROM lineitem", 10, extra=_DENSITY, digits=8)
SQL["R2_auto_number"] = SQL["D1_histogram"]
SQL["D3_grouped_histogram"] = binned("SELECT l_returnflag, l_quantity AS x FROM lineitem", 15, "l_returnflag")
SQL["D2_kde"] = """
WITH st AS (SELECT COUNT(value) AS n, STDDEV_SAMP(value) * power(COUNT(value), -0.2) AS h, MIN(value) AS lo,
                   (MAX(value) - MIN(value)) / 199.0::DOUBLE AS step FROM events),
v AS (SELECT value AS x, COUNT(*) AS c FROM events GROUP BY 1),
g AS (SELECT CAST(k AS INTEGER) AS point, lo + k * step AS p, n, h FROM generate_series(0, 199) AS s(k), st)
SELECT point, ROUND(p, 8) AS x, ROUND(SUM(c * exp(-0.5 * power((p - v.x) / h, 2))) / (MAX(n) * MAX(h) * sqrt(2 * pi())), 8)
  AS density FROM g, v GROUP BY point, p"""


def boxes(source: str, keys: str, prelude: str = "") -> str:
    using = f"USING ({keys})"
    return f"""WITH {prelude}v AS ({source}),
q AS (SELECT {keys}, COUNT(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM v WHERE x IS NOT NULL GROUP BY ALL),
m AS (SELECT v.*, n, q1, median, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
      FROM v JOIN q {using} WHERE x IS NOT NULL)
SELECT {keys}, n, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
       ROUND(LEAST(MIN(x) FILTER (ok), q1), 4) AS whisker_low, ROUND(GREATEST(MAX(x) FILTER (ok), q3), 4) AS whisker_high,
       COUNT(*) FILTER (NOT ok) AS n_outliers FROM m GROUP BY {keys}, n, q1, median, q3"""


SQL["D4_box"] = boxes("SELECT COALESCE(event_type, 'nan') AS event_type, value AS x FROM ev", "event_type", GAPPY + ", ")
SQL["R2_auto_number_by_category"] = SQL["D4_box"]
SQL["D4_box_folded"] = boxes(
    "SELECT p_brand, p_retailprice AS x FROM fd", "p_brand", folded("part", "p_brand") + ", "
)
SQL["D5_box_two_keys"] = boxes(
    "SELECT l_returnflag, l_linestatus, l_extendedprice AS x FROM lineitem", "l_returnflag, l_linestatus"
)
SQL["D5_box_outliers"] = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, value FROM events JOIN q USING (event_type)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
SQL["D6_violin"] = """
WITH st AS (SELECT event_type, COUNT(value) AS n, STDDEV_SAMP(value) * power(COUNT(value), -0.2) AS h, MIN(value) AS lo,
                   (MAX(value) - MIN(value)) / 99.0::DOUBLE AS step, quantile_cont(value, 0.25) AS q1,
                   quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
v AS (SELECT event_type, value AS x, COUNT(*) AS c FROM events GROUP BY 1, 2),
g AS (SELECT st.*, CAST(k AS INTEGER) AS point, lo + k * step AS p FROM generate_series(0, 99) AS s(k), st)
SELECT g.event_type, point, ROUND(p, 6) AS x,
       ROUND(SUM(c * exp(-0.5 * power((p - v.x) / h, 2))) / (MAX(n) * MAX(h) * sqrt(2 * pi())), 6) AS density,
       ROUND(MAX(q1), 6) AS q1, ROUND(MAX(median), 6) AS median, ROUND(MAX(q3), 6) AS q3
FROM g JOIN v USING (event_type) GROUP BY g.event_type, point, p"""
SQL["D7_ecdf"] = """
SELECT DISTINCT ROUND(value, 8) AS value, ROUND(cume_dist() OVER (ORDER BY value), 8) AS share FROM events"""
SQL["D7_ecdf_grouped"] = f"""WITH {folded('part', 'p_brand')}
SELECT DISTINCT p_brand, ROUND(p_retailprice, 8) AS value,
       ROUND(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 8) AS share FROM fd"""


def _poly(x: str, coefficients) -> str:
    text = repr(float(coefficients[-1])) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {float(c)!r}::DOUBLE)"
    return text


def normal_quantile_sql(source: str, place: str, name: str) -> str:
    """``source`` with the normal quantile of ``place`` as column ``name``."""
    ratio = [
        (f"{_poly('a', normal.CENTRE_NUM)} / {_poly('a', normal.CENTRE_DEN)}"),
        (f"{_poly('b', normal.MIDDLE_NUM)} / {_poly('b', normal.MIDDLE_DEN)}"),
        (f"{_poly('c', normal.TAIL_NUM)} / {_poly('c', normal.TAIL_DEN)}"),
    ]
    return f"""SELECT * EXCLUDE (p, q, r, a, b, c),
  CASE WHEN ABS(q) <= 0.425 THEN q * {ratio[0]} WHEN r <= 5 THEN SIGN(q) * {ratio[1]} ELSE SIGN(q) * {ratio[2]} END AS {name}
FROM (SELECT *, 0.180625::DOUBLE - q * q AS a, r - 1.6::DOUBLE AS b, r - 5.0::DOUBLE AS c
  FROM (SELECT *, p - 0.5::DOUBLE AS q, sqrt(-ln(LEAST(p, 1.0::DOUBLE - p))) AS r
    FROM (SELECT *, {place} AS p FROM {source})))"""


_FILLIBEN = """CASE WHEN i = n THEN power(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - power(0.5::DOUBLE, 1.0::DOUBLE / n)
  ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END"""


def _ranked(column: str, table: str) -> str:
    return (f"(SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS i, COUNT(*) OVER () AS n "
            f"FROM {table} WHERE {column} IS NOT NULL)")


SQL["D8_qq_points"] = f"""WITH z AS ({normal_quantile_sql(_ranked('c_acctbal', 'customer'), _FILLIBEN, 'm')})
SELECT i, ROUND(m, 6) + 0.0 AS theoretical, ROUND(x, 6) AS observed FROM z"""
SQL["D8_qq_fit"] = f"""WITH z AS ({normal_quantile_sql(_ranked('value', 'events'), _FILLIBEN, 'm')})
SELECT COUNT(*) AS n, ROUND(regr_slope(x, m), 4) AS slope, ROUND(regr_intercept(x, m), 4) AS intercept,
       ROUND(corr(x, m), 4) AS r FROM z"""
SQL["D9_hexbin"] = """
WITH l AS (SELECT MIN(l_quantity) - (MAX(l_quantity) - MIN(l_quantity)) * 1e-9 AS ox,
                  MIN(l_extendedprice) - (MAX(l_extendedprice) - MIN(l_extendedprice)) * 1e-9 AS oy,
                  (MAX(l_quantity) - MIN(l_quantity)) * (1 + 2 * 1e-9) / 40 AS sx,
                  (MAX(l_extendedprice) - MIN(l_extendedprice)) * (1 + 2 * 1e-9) / 23 AS sy FROM lineitem),
p AS (SELECT (l_quantity - ox) / sx AS u, (l_extendedprice - oy) / sy AS v, ox, oy, sx, sy FROM lineitem, l),
d AS (SELECT *, round_even(u, 0) AS eu, round_even(v, 0) AS ev, floor(u) + 0.5 AS du, floor(v) + 0.5 AS dv FROM p),
c AS (SELECT *, power(u - eu, 2) + 3 * power(v - ev, 2) < power(u - du, 2) + 3 * power(v - dv, 2) AS near FROM d)
SELECT ROUND((CASE WHEN near THEN eu ELSE du END) * sx + ox, 4) AS x,
       ROUND((CASE WHEN near THEN ev ELSE dv END) * sy + oy, 4) AS y, COUNT(*) AS count FROM c GROUP BY 1, 2"""
_FACETS = """top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY COUNT(*) DESC, p_brand LIMIT 12),
gone AS (SELECT CAST(COUNT(DISTINCT p_brand) - 12 AS INTEGER) AS dropped FROM part)"""
SQL["D10_small_multiples"] = binned(
    "SELECT p_brand, p_retailprice AS x FROM part WHERE p_brand IN (FROM top)", 20, "p_brand",
    ", (SELECT dropped FROM gone) AS dropped", _FACETS + ", ",
)
SQL["D11_small_multiple_lines"] = f"""WITH {_FACETS}
SELECT p_brand, p_partkey AS axis, p_retailprice AS value, dropped FROM part, gone WHERE p_brand IN (FROM top)"""
_VERSIONS = """b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
both_versions AS (SELECT 'before' AS version, value AS x FROM events UNION ALL
  SELECT 'after', value FROM events, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""
SQL["D12_before_after"] = binned(
    "SELECT version, x FROM both_versions", 30, "version",
    ", CAST(SUM(COALESCE(n, 0)) OVER (PARTITION BY s.version) AS BIGINT) AS n, FALSE AS unchanged",
    _VERSIONS.replace("b AS (", "fence AS (").replace("events, b WHERE", "events, fence WHERE") + ", ",
)
SQL["D13_before_after_box"] = boxes(
    "SELECT version, x FROM both_versions", "version",
    _VERSIONS.replace("b AS (", "fence AS (").replace("events, b WHERE", "events, fence WHERE") + ", ",
)
SQL["D14_scatter"] = f"""WITH {GAPPY}
SELECT user_id, value, event_type FROM ev WHERE user_id IS NOT NULL AND value IS NOT NULL"""

# --- Time series ----------------------------------------------------------------------

SQL["T1_time_axis"] = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_day, CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year
FROM orders"""
SQL["T2_line"] = """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, ROUND(AVG(o_totalprice), 8) AS value FROM orders GROUP BY 1"""
SQL["T3_line_by_group"] = """
SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, ROUND(SUM(o_totalprice), 2) AS value
FROM orders GROUP BY 1, 2"""
SQL["R2_auto_time_by_group"] = SQL["T3_line_by_group"].replace("ROUND(SUM(o_totalprice), 2)", "ROUND(AVG(o_totalprice), 4)")
SQL["R2_auto_category"] = SQL["A4_bar_counts"]
SQL["R2_auto_two_categories"] = SQL["A5_crosstab"]


def resampled(bucket: str, step: str, value: str, label: str = "b") -> str:
    shifted = "SELECT * REPLACE (CASE WHEN day(ts) BETWEEN 10 AND 12 THEN ts + INTERVAL 3 DAY ELSE ts END AS ts) FROM events"
    return f"""WITH e AS (SELECT *, {bucket} AS b FROM ({shifted})),
g AS (SELECT b, {value} AS v FROM e GROUP BY 1),
s AS (SELECT unnest(generate_series(MIN(b), MAX(b), {step})) AS b FROM g)
SELECT strftime({label}, '%Y-%m-%d %H:%M') AS ts, {{}} AS value FROM s LEFT JOIN g USING (b)"""


_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"
SQL["T4_resample_daily_mean"] = resampled(_DAY, "INTERVAL 1 DAY", "AVG(value)").format("ROUND(v, 4)")
SQL["T4_resample_daily_sum"] = resampled(_DAY, "INTERVAL 1 DAY", "SUM(value)").format("ROUND(COALESCE(v, 0), 4)")
SQL["T4_resample_weekly_median"] = resampled(
    "CAST(date_trunc('week', ts) AS TIMESTAMP)", "INTERVAL 7 DAY", "quantile_cont(value, 0.5)", "b + INTERVAL 6 DAY"
).format("ROUND(v, 4)")
SQL["T4_resample_six_hours"] = resampled(
    "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')", "INTERVAL 6 HOUR", "COUNT(value)"
).format("COALESCE(v, 0)")
SQL["T4_resample_monthly"] = """
WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS b, AVG(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT unnest(generate_series(MIN(b), MAX(b), INTERVAL 1 MONTH)) AS b FROM g)
SELECT strftime(last_day(b), '%Y-%m-%d') AS o_orderdate, ROUND(v, 4) AS value FROM s LEFT JOIN g USING (b)"""
SQL["T5_resample_by_group"] = f"""WITH {GAPPY}
SELECT event_type, strftime(ts, '%Y-%m-%d') AS ts, ROUND(COALESCE(SUM(value), 0), 4) AS value
FROM ev WHERE event_type IS NOT NULL GROUP BY 1, 2"""
SQL["T6_area"] = f"""WITH lanes AS (SELECT l_shipdate, l_quantity, CAST(l_suppkey % 12 AS VARCHAR) AS lane FROM lineitem),
{folded('lanes', 'lane')},
c AS (SELECT last_day(l_shipdate) AS d, lane, SUM(l_quantity) AS v FROM fd GROUP BY 1, 2)
SELECT strftime(x.d, '%Y-%m-%d') AS l_shipdate, y.lane, ROUND(COALESCE(v, 0), 2) AS value
FROM (SELECT DISTINCT d FROM c) x CROSS JOIN (SELECT DISTINCT lane FROM c) y LEFT JOIN c ON c.d = x.d AND c.lane = y.lane"""
SQL["T6_area_shares"] = """
WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS ts, event_type, SUM(value) AS v FROM events GROUP BY 1, 2)
SELECT x.ts, y.event_type, ROUND(COALESCE(v, 0) / SUM(COALESCE(v, 0)) OVER (PARTITION BY x.ts) * 100, 4) AS value
FROM (SELECT DISTINCT ts FROM c) x CROSS JOIN (SELECT DISTINCT event_type FROM c) y
LEFT JOIN c ON c.ts = x.ts AND c.event_type = y.event_type"""
for _name, _text, _digits in (
    ("mean", "AVG(raw)", 8), ("median", "quantile_cont(raw, 0.5)", 8), ("std", "STDDEV_SAMP(raw)", 5),
):
    SQL[f"T7_rolling_{_name}"] = f"""
WITH s AS (SELECT o_orderdate AS d, AVG(o_totalprice) AS raw FROM orders GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS o_orderdate, ROUND(raw, 8) AS raw,
       ROUND(CASE WHEN COUNT(*) OVER w >= 3 THEN {_text} OVER w END, {_digits}) AS rolled
FROM s WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
SQL["T7_rolling_events"] = f"""WITH {GAPPY}
SELECT event_id, ROUND(value, 4) AS raw, ROUND(CASE WHEN COUNT(*) OVER w >= 25 THEN SUM(value) OVER w END, 4) AS rolled
FROM ev WHERE value IS NOT NULL WINDOW w AS (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""

# --- Correlation, tests, intervals --------------------------------------------------------

SQL["H1_pearson"] = _pearson_pairs(LINE_NUMBERS, "lineitem")
_GAP_PAIRS = _pearson_pairs(["event_id", "user_id", "value"], "ev", with_n=False)
SQL["H1_pearson_gaps"] = f"""WITH {GAPPY}, p AS ({_GAP_PAIRS})
SELECT x, y, r FROM p UNION ALL SELECT y, x, r FROM p
UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES ('event_id'), ('user_id'), ('value')) AS t(c)"""


def spearman(a: str, b: str, source: str) -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return f"""SELECT '{a}' AS x, '{b}' AS y, ROUND(corr(ra::DOUBLE, rb::DOUBLE), 6) + 0.0 AS r, COUNT(*) AS n
FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


SQL["H2_spearman"] = unioned(
    [spearman(a, b, "lineitem") for a, b in combinations(["l_quantity", "l_extendedprice", "l_discount"], 2)]
)
SQL["H2_spearman_gaps"] = f"WITH {GAPPY}\n" + spearman("user_id", "value", "ev")


def kendall(a: str, b: str, source: str) -> str:
    points = f"SELECT {a} AS u, {b} AS v, COUNT(*) AS w FROM {source} GROUP BY 1, 2"
    return f"""SELECT '{a}' AS x, '{b}' AS y, ROUND(s / (sqrt(pairs - tu) * sqrt(pairs - tv)), 6) + 0.0 AS r, n
FROM (SELECT SUM(p.w::DOUBLE * q.w * sign(p.u - q.u) * sign(p.v - q.v)) / 2 AS s FROM ({points}) p, ({points}) q),
     (SELECT SUM(c * (c - 1.0::DOUBLE) / 2) AS tu FROM (SELECT COUNT(*)::DOUBLE AS c FROM {source} GROUP BY {a})),
     (SELECT SUM(c * (c - 1.0::DOUBLE) / 2) AS tv FROM (SELECT COUNT(*)::DOUBLE AS c FROM {source} GROUP BY {b})),
     (SELECT COUNT(*) AS n, COUNT(*)::DOUBLE * (COUNT(*) - 1) / 2 AS pairs FROM {source})"""


SQL["H3_kendall"] = unioned(
    [kendall(a, b, "lineitem") for a, b in combinations(["l_quantity", "l_discount", "l_tax"], 2)]
)
SQL["H3_kendall_continuous"] = kendall("c_custkey", "c_acctbal", "customer")


def simpson(density: str, upper: str, tables: str, steps: int = 4000) -> str:
    """∫₀^upper of a density in ``u`` by Simpson's rule."""
    return f"""(SELECT SUM(wt * f) * MAX(h) / 3 FROM (
  SELECT {density} AS f, h, CASE WHEN place IN (0, {steps}) THEN 1 WHEN place % 2 = 1 THEN 4 ELSE 2 END AS wt
  FROM (SELECT place, place * ({upper}) / {steps}.0::DOUBLE AS u, ({upper}) / {steps}.0::DOUBLE AS h, st.*
        FROM generate_series(0, {steps}) AS g(place), {tables} st)))"""


SQL["H4_shapiro"] = f"""
WITH z AS ({normal_quantile_sql(_ranked('c_acctbal', 'customer'),
                               "(i - 0.375::DOUBLE) / (n + 0.25::DOUBLE)", 'm')}),
s AS (SELECT MAX(n) AS n, SUM(m * m) AS mm, SUM(m * x) FILTER (i > 2 AND i <= n - 2) AS mx, VAR_POP(x) * MAX(n) AS ss,
  MAX(x) FILTER (i = 1) AS x1, MAX(x) FILTER (i = 2) AS x2, MAX(x) FILTER (i = n) AS y1, MAX(x) FILTER (i = n - 1) AS y2,
  MAX(m) FILTER (i = n) AS m1, MAX(m) FILTER (i = n - 1) AS m2, 1 / sqrt(MAX(n)) AS t FROM z),
a AS (SELECT *, {_poly('t', (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056))} + m1 / sqrt(mm) AS a1,
  {_poly('t', (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))} + m2 / sqrt(mm) AS a2 FROM s),
w AS (SELECT *, power(a1 * (y1 - x1) + a2 * (y2 - x2)
  + mx / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss AS w FROM a),
y AS (SELECT *, (ln(1 - w) - {_poly('ln(n)', (-1.5861, -0.31082, -0.083751, 0.0038915))})
  / exp({_poly('ln(n)', (-0.4803, -0.082676, 0.0030302))}) AS zz FROM w),
p AS (SELECT *, 0.5 - {simpson("exp(-u * u / 2) / sqrt(2 * pi())", "LEAST(GREATEST(zz, -9), 9)", "y")} AS p FROM y)
SELECT 'c_acctbal' AS "column", n, ROUND(w, 4) AS statistic, ROUND(p, 4) + 0.0 AS p_value, p > 0.05 AS is_normal FROM p"""
SQL["H5_t_test"] = f"""
WITH g AS (SELECT l_linestatus AS k, COUNT(*) AS n, AVG(l_extendedprice) AS m, VAR_SAMP(l_extendedprice) AS v
  FROM lineitem GROUP BY 1),
j AS (SELECT a.k AS group1, b.k AS group2, a.n + b.n - 2 AS dof, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v)
  / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t FROM g a JOIN g b ON a.k < b.k),
p AS (SELECT *, 1 - 2 * {simpson(
    "exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0) - (dof + 1) / 2.0 * ln(1 + u * u / dof)) / sqrt(dof * pi())",
    "LEAST(ABS(t), 40)", "j")} AS p FROM j)
SELECT group1, group2, ROUND(t, 4) AS statistic, dof, ROUND(p, 4) + 0.0 AS p_value, p < 0.05 AS is_significant FROM p"""
SQL["H6_anova"] = f"""
WITH g AS (SELECT event_type, COUNT(value) AS n, AVG(value) AS m, VAR_SAMP(value) AS v FROM events GROUP BY 1),
t AS (SELECT SUM(n * m) / SUM(n) AS gm FROM g),
j AS (SELECT COUNT(*) AS k, COUNT(*) - 1 AS d1, SUM(n)::BIGINT - COUNT(*) AS d2,
  (SUM(n * power(m - gm, 2)) / (COUNT(*) - 1)) / (SUM((n - 1) * v) / (SUM(n) - COUNT(*))) AS f FROM g, t),
p AS (SELECT *, 1 - {simpson(
    "CASE WHEN u = 0 THEN 0 ELSE exp(lgamma((d1 + d2) / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0) "
    "+ d1 / 2.0 * ln(d1 / d2) + (d1 / 2.0 - 1) * ln(u) - (d1 + d2) / 2.0 * ln(1 + d1 * u / d2)) END", "f", "j")} AS p FROM j)
SELECT k AS num_groups, ROUND(f, 4) AS statistic, ROUND(p, 4) + 0.0 AS p_value, p < 0.05 AS is_significant FROM p"""


def chi_square(a: str, b: str, source: str, yates: bool) -> str:
    gap = "GREATEST(ABS(o - e) - 0.5, 0)" if yates else "(o - e)"
    return f"""WITH src AS ({source}), r AS (SELECT {a} AS a, COUNT(*) AS ra FROM src GROUP BY 1),
c AS (SELECT {b} AS b, COUNT(*) AS cb FROM src GROUP BY 1),
x AS (SELECT COUNT(s.{a}) AS o, MAX(ra * cb::DOUBLE / (SELECT COUNT(*) FROM src)) AS e
  FROM r CROSS JOIN c LEFT JOIN src s ON s.{a} = r.a AND s.{b} = c.b GROUP BY r.a, c.b),
k AS (SELECT SUM({gap} * {gap} / e) AS x2,
  (SELECT COUNT(*) FROM r) * (SELECT COUNT(*) FROM c) - (SELECT COUNT(*) FROM r) - (SELECT COUNT(*) FROM c) + 1 AS dof FROM x)
"""


# With two degrees of freedom the tail probability is exp(-x / 2).
SQL["H7_chi_square"] = chi_square(
    "l_returnflag", "l_linestatus", "SELECT l_returnflag, l_linestatus FROM lineitem", False
) + """SELECT ROUND(x2, 4) AS statistic, dof, ROUND(exp(-x2 / 2), 4) AS p_value, exp(-x2 / 2) > 0.05 AS is_independent FROM k"""
SQL["H7_chi_square_yates"] = chi_square(
    "returned", "l_linestatus", "SELECT l_returnflag = 'R' AS returned, l_linestatus FROM lineitem", True
) + "SELECT ROUND(x2, 4) AS statistic, dof FROM k"
# The t quantile by its expansion around the normal one, exact to ten digits at these sizes.
SQL["H8_mean_interval"] = """
WITH s AS (SELECT COUNT(c_acctbal) AS n, AVG(c_acctbal) AS m, STDDEV_SAMP(c_acctbal) / sqrt(COUNT(c_acctbal)) AS se,
                  COUNT(c_acctbal) - 1 AS v, 1.959963984540054::DOUBLE AS z FROM customer),
q AS (SELECT *, se * (z + (power(z, 3) + z) / (4 * v) + (5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / (96 * power(v, 2))
  + (3 * power(z, 7) + 19 * power(z, 5) + 17 * power(z, 3) - 15 * z) / (384 * power(v, 3))) AS reach FROM s)
SELECT 'c_acctbal' AS "column", ROUND(m, 4) AS mean, 0.95::DOUBLE AS confidence_level, ROUND(m - reach, 4) AS lower_bound,
       ROUND(m + reach, 4) AS upper_bound, ROUND(reach, 4) AS margin_of_error, n AS sample_size FROM q"""

# --- Model quality on computed scores ----------------------------------------------------------

SQL["M2_task"] = unioned(
    [f"SELECT '{c}' AS target, COUNT(DISTINCT {c}) <= 10 AS is_classification FROM lineitem"
     for c in ("l_linenumber", "l_quantity")]
    + ["SELECT 'l_returnflag' AS target, TRUE AS is_classification"]
)
SQL["M4_metrics_on_scores"] = f"""
WITH {SCORED}, c AS (SELECT label AS k, COUNT(*) AS support, COUNT(*) FILTER (label = prediction) AS hits FROM sc GROUP BY 1),
g AS (SELECT prediction AS k, COUNT(*) AS called FROM sc GROUP BY 1),
m AS (SELECT support, hits, COALESCE(hits / NULLIF(called, 0), 0) AS p, hits / support AS r FROM c LEFT JOIN g USING (k))
SELECT ROUND(SUM(hits) / SUM(support), 4) AS accuracy, ROUND(SUM(support * p) / SUM(support), 4) AS "precision",
       ROUND(SUM(support * r) / SUM(support), 4) AS recall,
       ROUND(SUM(support * COALESCE(2 * p * r / NULLIF(p + r, 0), 0)) / SUM(support), 4) AS f1_score FROM m"""
SQL["M5_metrics_on_scores"] = """
WITH d AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2100 AS g FROM lineitem)
SELECT ROUND(sqrt(AVG(g * g)), 4) AS rmse, ROUND(AVG(ABS(g)), 4) AS mae, ROUND(1 - AVG(g * g) / VAR_POP(y), 4) AS r2_score FROM d"""


def curve(by: str = "") -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{SCORED}, t AS (SELECT {k}score AS threshold, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg
  FROM sc GROUP BY ALL),
cv AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER ({part}) AS p, SUM(neg) OVER ({part}) AS n
  FROM t WINDOW w AS ({part} ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


SQL["M8_roc_pr_points"] = f"""WITH {curve()}
SELECT ROUND(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, ROUND(tp / p, 6) AS tpr,
       ROUND(fp / n, 6) AS fpr, ROUND(tp / (tp + fp), 6) AS "precision" FROM cv"""
_SUMMARY = """ROUND(SUM(neg * (tp - pos / 2) / (p * n)), 4) AS roc_auc,
ROUND(SUM(pos / p * tp / (tp + fp)), 4) AS average_precision, ROUND(MAX(p / (p + n)), 4) AS base_rate FROM cv"""
SQL["M8_M9_roc_pr_summary"] = f"WITH {curve()}\nSELECT {_SUMMARY}"
SQL["M8_roc_pr_summary_by_class"] = f"WITH {curve('l_returnflag')}\nSELECT l_returnflag, {_SUMMARY} GROUP BY 1"
SQL["M10_calibration"] = f"""WITH {SCORED}, e AS (SELECT {', '.join(
    f'quantile_cont(score, {i / 10}) AS e{i}' for i in range(1, 10))} FROM sc),
b AS (SELECT sc.*, {' + '.join(f'(score > e{i})::INT' for i in range(1, 10))} AS bin FROM sc, e),
g AS (SELECT bin, COUNT(*) AS n, AVG(score) AS s, AVG(label) AS o FROM b GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, n, ROUND(s, 6) AS mean_score, ROUND(o, 6) AS observed_rate,
       ROUND(AVG(ABS(o - s)) OVER (), 6) AS mean_gap FROM g"""
SQL["M12_residual_summary"] = """
WITH d AS (SELECT l_extendedprice - l_quantity * 2100 AS g FROM lineitem)
SELECT ROUND(sqrt(AVG(g * g)), 4) AS rmse, ROUND(AVG(g), 4) AS mean_residual FROM d"""
SQL["M12_residual_histogram"] = binned(
    "SELECT l_extendedprice - l_quantity * 2100 AS x FROM lineitem", 30, extra=_DENSITY, digits=8
)
