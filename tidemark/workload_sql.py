"""The same results as ``workload``, stated in SQL and by other means.

Running distinct counts are direct ``count(DISTINCT)`` over a range join, cube cells come
from one SELECT per level, attributed facts from one SELECT per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

SQL: dict[str, str] = {}

K = """CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER)"""
EVENTS = f"""e AS (
  SELECT *, CAST(ts AS DATE) AS d, time_bucket(INTERVAL '10 minutes', ts) AS b, {K} AS k,
         CASE WHEN {K} < 50 THEN 'low' ELSE 'high' END AS band, CAST(value AS DECIMAL(18,2)) AS v
  FROM events)"""
DAY = "CAST(strftime({0}, '%Y%m%d') AS INTEGER)"
MINUTE = "strftime({0}, '%Y%m%d%H%M')"
ALL = "'整体'"


def levels_of(dims: Sequence[str], masks: Sequence[int], source: str, period: str = "d") -> str:
    """Cells per level, one SELECT each."""
    parts = []
    for mask in masks:
        shown = []
        for i, d in enumerate(dims):
            rolled = mask >> (len(dims) - 1 - i) & 1
            shown.append(f"{'NULL' if rolled else d} AS {d}")
        parts.append(f"SELECT DISTINCT {', '.join([period, *shown])}, {mask} AS level FROM {source}")
    return " UNION ALL ".join(parts)


def matches(dims: Sequence[str], cell: str = "c", row: str = "r") -> str:
    tests = [
        f"((({cell}.level >> {len(dims) - 1 - i}) & 1) = 1 OR {cell}.{d} = {row}.{d})" for i, d in enumerate(dims)
    ]
    return " AND ".join(tests) or "TRUE"


def labelled(dims: Sequence[str], cell: str = "c") -> str:
    return "".join(
        f"CASE WHEN (({cell}.level >> {len(dims) - 1 - i}) & 1) = 1 THEN {ALL} ELSE {cell}.{d} END AS {d}, "
        for i, d in enumerate(dims)
    )


def cumulative_sql(
    dims: Sequence[str],
    masks: Sequence[int],
    keys: dict[str, str],
    rows: str = "SELECT * FROM e",
    first: int = 0,
    last: int = 1430,
) -> str:
    counted = "".join(f"count(DISTINCT r.{k}) AS {out}, " for k, out in keys.items())
    return f"""WITH {EVENTS},
 r AS ({rows}), cells AS ({levels_of(dims, masks, 'r')}),
 points AS (SELECT c.*, unnest(generate_series(CAST(d AS TIMESTAMP) + INTERVAL {first} MINUTE,
            CAST(d AS TIMESTAMP) + INTERVAL {last} MINUTE, INTERVAL 10 MINUTE)) AS p FROM cells c)
SELECT {labelled(dims)} c.level, {MINUTE.format('c.p')} AS date_minute, {counted}
       coalesce(CAST(sum(r.v) AS DOUBLE), 0) AS amount, {DAY.format('c.d')} AS date_p
FROM points c LEFT JOIN r ON r.d = c.d AND r.b <= c.p AND {matches(dims)}
GROUP BY c.d, c.p, c.level{''.join(f', c.{d}' for d in dims)}"""


TWO = ["event_type", "band"]
USERS = {"user_id": "users"}
SQL["cum_leaf"] = cumulative_sql(TWO, [0], USERS)
SQL["cum_incremental"] = SQL["cum_leaf"]
SQL["cum_cube"] = cumulative_sql(TWO, [0, 1, 2, 3], USERS)
SQL["cum_cube_hot_keys"] = SQL["cum_cube"]
SQL["cum_cube_checkpoint"] = SQL["cum_cube"]
SQL["cum_double_amounts"] = cumulative_sql(
    TWO,
    [0, 1],
    USERS,
    rows="SELECT * REPLACE ((k + 1) * CASE event_type WHEN 'click' THEN pow(2.0::DOUBLE, 100) WHEN 'view' THEN pow(2.0::DOUBLE, -30)"
    " WHEN 'error' THEN pow(2.0::DOUBLE, 60) ELSE 1.0::DOUBLE END AS v) FROM e",
)
SEVEN = ["flag", "status", "order_status", "priority", "amount_band", "discount_band", "tax_band"]
SQL["cum_cube_seven"] = f"""WITH r AS (
  SELECT l_orderkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) AS q, l_returnflag AS flag, l_linestatus AS status,
    o_orderstatus AS order_status, o_orderpriority AS priority, CASE WHEN l_quantity < 26 THEN 'low' ELSE 'high' END AS amount_band,
    CASE WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS discount_band, CASE WHEN l_tax < 0.04 THEN 'low' ELSE 'high' END AS tax_band,
    year(l_shipdate) AS y, quarter(l_shipdate) AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 points AS (SELECT unnest(range(1, 5)) AS p),
 g AS (SELECT y, p, CAST(GROUPING({', '.join(SEVEN)}) AS INTEGER) AS level, {', '.join(f"coalesce({d}, {ALL}) AS {d}_" for d in SEVEN)},
   count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, sum(q) AS quantity
   FROM r JOIN points ON b <= p GROUP BY y, p, CUBE ({', '.join(SEVEN)})),
 cells AS (SELECT DISTINCT y, level, {', '.join(f"{d}_" for d in SEVEN)} FROM g)
SELECT {', '.join(f"c.{d}_ AS {d}" for d in SEVEN)}, c.level, CAST(c.y AS VARCHAR) || '0101' || lpad(CAST(6 * (points.p - 1) AS VARCHAR), 2, '0') || '00' AS date_minute,
  coalesce(orders, 0) AS orders, coalesce(suppliers, 0) AS suppliers, coalesce(CAST(quantity AS DOUBLE), 0) AS quantity,
  CAST(c.y * 10000 + 101 AS INTEGER) AS date_p
FROM cells c CROSS JOIN points LEFT JOIN g ON g.y = c.y AND g.p = points.p AND g.level = c.level
  AND {' AND '.join(f"g.{d}_ = c.{d}_" for d in SEVEN)}"""
SQL["cum_nodims"] = cumulative_sql([], [0], USERS)
SQL["cum_rollup"] = cumulative_sql(TWO, [0, 1, 3], USERS)
SQL["cum_chosen_levels"] = cumulative_sql(TWO, [2, 3], USERS)
SQL["cum_opening_balance"] = cumulative_sql(
    TWO,
    [0, 1, 2, 3],
    USERS,
    rows="SELECT * FROM e WHERE b <= CAST(d AS TIMESTAMP) + INTERVAL 840 MINUTE",
    first=600,
    last=840,
)
SQL["cum_range"] = cumulative_sql(
    TWO,
    [0, 1, 2, 3],
    USERS,
    rows="SELECT * FROM e WHERE ts >= CAST(d AS TIMESTAMP) + INTERVAL 605 MINUTE"
    " AND ts < CAST(d AS TIMESTAMP) + INTERVAL 840 MINUTE",
    first=600,
    last=830,
)
SQL["cum_one_day"] = cumulative_sql(TWO, [0, 1, 2, 3], USERS, rows="SELECT * FROM e WHERE d = DATE '2024-01-15'")
SQL["cum_two_keys"] = cumulative_sql(["event_type"], [0, 1], {"event_id": "requests", "user_id": "users"})
REQUESTS = {"event_id": "requests", "user_id": "users"}
# each delivery against the latest stamp of those before it
LATE = " + ".join(
    f"(SELECT count(*) FROM events WHERE event_id % 3 = {i} AND ts < (SELECT max(ts) FROM events WHERE event_id % 3 < {i}) - INTERVAL 2 DAY)"
    for i in (1, 2)
)
SQL["stream_late_rows"] = f"SELECT *, CAST({LATE} AS BIGINT) AS late_rows FROM ({cumulative_sql(['event_type'], [0], REQUESTS)})"
SQL["stream_text_stamp"] = cumulative_sql(
    ["event_type"], [0], REQUESTS, rows="SELECT * REPLACE (CASE WHEN user_id % 10 = 0 THEN CAST(d + 1 AS DATE) ELSE d END AS d) FROM e"
)
SQL["stream_compacted"] = SQL["cum_two_keys"]
SQL["cum_double_stamp"] = SQL["cum_large_amounts"] = SQL["cum_leaf"]
SQL["cum_text_days"] = SQL["cum_one_day"]
SQL["rejected_rules"] = """SELECT CAST(p_partkey AS BIGINT) AS rule_no, CASE WHEN p_partkey % 3 = 0 THEN 'level1 is blank'
  ELSE 'event_id is not a name' END AS reason FROM part WHERE p_partkey % 3 = 0 OR p_size % 2 = 0"""
SQL["cum_stored_day"] = SQL["cum_leaf"]

ITEM_DIMS = ["l_returnflag", "l_linestatus"]
SQL["cum_multi_key"] = f"""WITH r AS (
  SELECT *, date_trunc('month', l_shipdate) AS d, CAST(l_shipdate AS DATE) AS b FROM lineitem),
 cells AS ({levels_of(ITEM_DIMS, [0, 1, 2, 3], 'r')}),
 points AS (SELECT c.*, unnest(generate_series(CAST(d AS TIMESTAMP), CAST(last_day(d) AS TIMESTAMP),
            INTERVAL 1 DAY)) AS p FROM cells c)
SELECT {labelled(ITEM_DIMS)} c.level, {MINUTE.format('c.p')} AS date_minute,
       count(DISTINCT r.l_orderkey) AS orders, count(DISTINCT r.l_suppkey) AS suppliers,
       coalesce(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0) AS quantity,
       coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 0) AS amount,
       {DAY.format('c.d')} AS date_p
FROM points c LEFT JOIN r ON r.d = c.d AND r.b <= c.p AND {matches(ITEM_DIMS)}
GROUP BY c.d, c.p, c.level, c.l_returnflag, c.l_linestatus"""

# --- clean-up -------------------------------------------------------------------------

SQL["parse_minute"] = f"WITH {EVENTS} SELECT event_id, {MINUTE.format('ts')} AS minute FROM e WHERE k % 10 <> 4"
SQL["floor_bucket"] = f"""SELECT event_id, strftime(date_trunc('hour', ts), '%Y%m%d%H')
  || CAST(extract(minute FROM ts) // 10 AS VARCHAR) || '0' AS bucket FROM events"""
SQL["filter_until"] = f"""WITH {EVENTS} SELECT {DAY.format('d')} AS period, count(*) AS row_count,
  {MINUTE.format('max(b)')} AS bucket FROM e WHERE strftime(ts, '%H%M') < '1240' GROUP BY d"""
SQL["select_spec"] = f"WITH {EVENTS} SELECT event_type, band, user_id, value, {MINUTE.format('ts')} AS ts FROM e"
SQL["coalesce_columns"] = (
    f"WITH {EVENTS} SELECT event_id, CASE WHEN event_type = 'error' THEN band ELSE event_type END AS func FROM e"
)
SQL["normalize_dims"] = f"""WITH {EVENTS} SELECT event_id,
  CASE WHEN event_type = 'error' THEN '未定义功能' ELSE event_type END AS func_name,
  CASE WHEN k < 20 THEN '未知' ELSE band END AS os_type FROM e"""
SQL["valid_key"] = f"""WITH {EVENTS} SELECT event_id,
  CASE WHEN k < 20 THEN chr(92) || 'n' ELSE CAST(user_id AS VARCHAR) END AS key
  FROM e WHERE k BETWEEN 15 AND 19 OR k >= 25"""
SQL["numeric_metrics"] = (
    f"WITH {EVENTS} SELECT event_id, CASE WHEN k < 20 THEN 0 ELSE CAST(v AS DOUBLE) END AS cost FROM e"
)
SQL["spine"] = f"""SELECT {DAY.format('d')} AS period, {MINUTE.format('d + m * INTERVAL 10 MINUTE')} AS bucket
  FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events), range(144) AS t(m)"""

# --- aggregation ----------------------------------------------------------------------

PERIOD = f"{DAY.format('d')} AS period"
BUCKET = f"{MINUTE.format('b')} AS bucket"
AMOUNT = "CAST(sum(v) AS DOUBLE) AS amount"
SQL["preagg"] = f"""WITH {EVENTS} SELECT event_type, band, user_id, {BUCKET}, CAST(sum(v) AS DOUBLE) AS value, max(k) AS k
  FROM e GROUP BY event_type, band, user_id, b"""
SQL["bucket_sums"] = f"WITH {EVENTS} SELECT {PERIOD}, event_type, band, {BUCKET}, {AMOUNT} FROM e GROUP BY d, event_type, band, b"
SQL["first_seen"] = f"""WITH {EVENTS} SELECT DISTINCT {PERIOD}, event_type, band, user_id, {BUCKET} FROM e
  WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.d = e.d AND x.event_type = e.event_type AND x.band = e.band
                    AND x.user_id = e.user_id AND x.b < e.b)"""
SQL["new_keys"] = f"""WITH {EVENTS}, f AS (SELECT d, event_type, band, user_id, min(b) AS b FROM e GROUP BY ALL)
  SELECT {PERIOD}, event_type, band, {BUCKET}, count(*) AS users FROM f GROUP BY d, event_type, band, b"""
SQL["cumulative_distinct"] = f"""WITH {EVENTS},
  f AS (SELECT DISTINCT d, event_type, band, min(b) AS b FROM e GROUP BY d, event_type, band, user_id)
  SELECT {DAY.format('f.d')} AS period, f.event_type, f.band, {MINUTE.format('f.b')} AS bucket,
         count(DISTINCT e.user_id) AS users
  FROM f JOIN e ON e.d = f.d AND e.event_type = f.event_type AND e.band = f.band AND e.b <= f.b
  GROUP BY f.d, f.event_type, f.band, f.b"""


def per_level(select: str, group: str, masks: Sequence[int] = (0, 1, 2, 3)) -> str:
    parts = []
    for mask in masks:
        type_, band = (ALL if mask & 2 else "event_type"), (ALL if mask & 1 else "band")
        grouped = [c for c, rolled in (("event_type", mask & 2), ("band", mask & 1)) if not rolled]
        parts.append(
            f"SELECT {PERIOD}, {type_} AS event_type, {band} AS band, {mask} AS level{select}"
            f" FROM {{source{mask}}} GROUP BY {', '.join(['d', *grouped, *([group] if group else [])])}"
        )
    return " UNION ALL ".join(parts)


SQL["cube_sums"] = f"WITH {EVENTS} " + per_level(f", {BUCKET}, {AMOUNT}", "b").format(
    **{f"source{m}": "e" for m in range(4)}
)
SQL["cube_distinct"] = f"WITH {EVENTS} " + per_level(f", {BUCKET}, count(*) AS users", "b").format(
    source0="(SELECT d, event_type, band, user_id, min(b) AS b FROM e GROUP BY ALL)",
    source1="(SELECT d, event_type, user_id, min(b) AS b FROM e GROUP BY ALL)",
    source2="(SELECT d, band, user_id, min(b) AS b FROM e GROUP BY ALL)",
    source3="(SELECT d, user_id, min(b) AS b FROM e GROUP BY ALL)",
)
SQL["cell_keys"] = f"WITH {EVENTS} " + per_level("", "").format(**{f"source{m}": "e" for m in range(4)})
SQL["union_cells"] = f"WITH {EVENTS} SELECT DISTINCT {PERIOD}, event_type, band FROM e"
EXACT = f"count(DISTINCT event_id) AS requests, count(DISTINCT user_id) AS users, {AMOUNT}"
SQL["per_bucket"] = f"WITH {EVENTS} SELECT {PERIOD}, {BUCKET}, {EXACT} FROM e GROUP BY d, b"
UNTIL = "ts < TIMESTAMP '2024-01-15 12:10:00'"
SQL["snapshot_at"] = f"WITH {EVENTS} SELECT {EXACT} FROM e WHERE {UNTIL}"
SQL["snapshot_by"] = f"WITH {EVENTS} SELECT event_type, {EXACT} FROM e WHERE {UNTIL} GROUP BY event_type"
SQL["two_layer_totals"] = (
    f"WITH {EVENTS} SELECT {PERIOD}, event_type, band, count(DISTINCT user_id) AS users, {AMOUNT} FROM e"
    " GROUP BY d, event_type, band"
)
SQL["fact_rollup"] = f"WITH {EVENTS} SELECT event_type, band, user_id, count(*) AS cnt FROM e GROUP BY ALL"
SQL["dedupe_lookup"] = "SELECT DISTINCT user_id FROM events"

# --- windows and grids ----------------------------------------------------------------

SQL["running_sum"] = f"""WITH {EVENTS}, s AS (SELECT DISTINCT d, event_type, band, b FROM e)
  SELECT {DAY.format('s.d')} AS period, s.event_type, s.band, {MINUTE.format('s.b')} AS bucket, {AMOUNT}
  FROM s JOIN e ON e.d = s.d AND e.event_type = s.event_type AND e.band = s.band AND e.b <= s.b
  GROUP BY s.d, s.event_type, s.band, s.b"""


def grid_sql(bucket_test: str, metric: str) -> str:
    return f"""WITH {EVENTS}, g AS (SELECT d, event_type, band, d + m * INTERVAL 10 MINUTE AS p
      FROM (SELECT DISTINCT d, event_type, band FROM e), range(144) AS t(m))
    SELECT {DAY.format('g.d')} AS period, g.event_type, g.band, {MINUTE.format('g.p')} AS bucket, {metric}
    FROM g LEFT JOIN e ON e.d = g.d AND e.event_type = g.event_type AND e.band = g.band AND {bucket_test}
    GROUP BY g.d, g.event_type, g.band, g.p"""


SQL["attach_buckets"] = grid_sql("e.b = g.p", "coalesce(CAST(sum(e.v) AS DOUBLE), 0) AS amount")
SQL["carry_forward"] = grid_sql("e.b <= g.p", "count(DISTINCT e.user_id) AS users")
SQL["merge_metrics"] = f"""WITH {EVENTS}, f AS (SELECT d, event_type, band, user_id, min(b) AS b FROM e GROUP BY ALL),
  n AS (SELECT d, event_type, band, b, count(*) AS users FROM f GROUP BY ALL),
  s AS (SELECT d, event_type, band, b, sum(v) AS amount FROM e GROUP BY ALL)
  SELECT {PERIOD}, event_type, band, {BUCKET}, CAST(coalesce(amount, 0) AS DOUBLE) AS amount, coalesce(users, 0) AS users
  FROM s FULL JOIN n USING (d, event_type, band, b)"""

# --- reports and quality --------------------------------------------------------------

PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
SPAN = "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'"
SQL["range_summary"] = f"""SELECT CAST(sum({PRICE}) AS DOUBLE) AS total_cost, count(*) AS row_count
  FROM orders WHERE {SPAN} AND o_orderpriority >= '0000'"""
SQL["daily_summary"] = f"""SELECT {DAY.format('o_orderdate')} AS date_p, CAST(sum({PRICE}) AS DOUBLE) AS total_cost,
  count(*) AS row_count FROM orders WHERE {SPAN} GROUP BY o_orderdate"""
SQL["cost_analysis"] = f"""SELECT o_orderstatus AS status, o_orderpriority AS type_p,
  CAST(sum({PRICE}) AS DOUBLE) AS total_cost, count(*) AS calls,
  round(CAST(sum({PRICE}) AS DOUBLE) / count(*), 6) AS avg_cost FROM orders GROUP BY ALL"""
SQL["weekly_change"] = f"""WITH w AS (SELECT o_orderstatus, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
    sum({PRICE}) AS price FROM orders GROUP BY ALL)
  SELECT a.o_orderstatus, {DAY.format('a.week')} AS week, CAST(a.price AS DOUBLE) AS price_this_week,
    CAST(b.price AS DOUBLE) AS price_last_week,
    round((CAST(a.price AS DOUBLE) - CAST(b.price AS DOUBLE)) / CAST(b.price AS DOUBLE), 6) AS price_change
  FROM w a LEFT JOIN w b ON b.o_orderstatus = a.o_orderstatus AND b.week = a.week - 7"""
CUSTOMER = [
    ("c_custkey", "bigint", "false"),
    ("c_name", "string", "false"),
    ("c_nationkey", "int", "true"),
    ("c_acctbal", "double", "false"),
    ("c_mktsegment", "string", "false"),
]
SQL["table_profile"] = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS column_type, {part} AS is_partition,"
    f" min(CAST({c} AS VARCHAR)) AS sample_value FROM customer"
    for i, (c, kind, part) in enumerate(CUSTOMER)
)
SQL["null_check"] = """SELECT 'event_id' AS column_name, count(*) AS row_count, 0 AS null_count FROM events
  UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type = 'error') FROM events
  UNION ALL SELECT 'value', count(*), 0 FROM events"""
SQL["duplicate_check"] = """SELECT l_orderkey, l_partkey, count(*) AS copies FROM lineitem
  GROUP BY ALL HAVING count(*) > 1"""
SQL["range_check"] = """SELECT count(*) AS row_count, count(*) FILTER (l_quantity < 5) AS below,
  count(*) FILTER (l_quantity > 45) AS above, count(*) FILTER (l_quantity BETWEEN 5 AND 45) AS inside,
  count(*) FILTER (l_quantity IS NULL) AS null_count FROM lineitem"""
SQL["consistency_check"] = """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
  WHERE l_returnflag = 'N' AND l_linestatus = 'F'"""
SQL["reference_check"] = """SELECT c_custkey, count(*) AS row_count FROM customer WHERE c_custkey NOT IN
  (SELECT o_custkey FROM orders) GROUP BY c_custkey"""
SQL["reconcile"] = f"""WITH {EVENTS}, o AS (SELECT event_type, band, {DAY.format('d')} AS date_p,
    count(DISTINCT user_id) AS users FROM e GROUP BY ALL),
  r AS (SELECT event_type, band, date_p, users + CASE WHEN date_p % 7 = 0 AND event_type = 'click' THEN 1 ELSE 0 END AS users
    FROM o WHERE NOT (date_p % 5 = 0 AND event_type = 'view'))
  SELECT event_type, band, date_p, CASE WHEN r.users IS NULL THEN 0 ELSE 1 END AS result_rows,
    CASE WHEN o.users IS NULL THEN 0 ELSE 1 END AS oracle_rows, r.users AS users_result, o.users AS users_oracle
  FROM r FULL JOIN o USING (event_type, band, date_p) WHERE r.users IS DISTINCT FROM o.users"""
# a cell has two rows unless one was lost; damaged days and cells go on whole
SQL["reconcile_digest"] = f"""WITH found AS ({SQL['reconcile']}), {EVENTS},
 o AS (SELECT event_type, band, {DAY.format('d')} AS date_p FROM e GROUP BY ALL),
 r AS (SELECT * FROM o WHERE NOT (date_p % 5 = 0 AND event_type = 'view')),
 compared AS (SELECT * FROM o UNION ALL SELECT * FROM r)
SELECT *, CAST((SELECT count(*) FROM compared) AS BIGINT) AS rows_all,
  CAST((SELECT count(*) FROM compared WHERE date_p IN (SELECT date_p FROM found)) AS BIGINT) AS rows_days,
  CAST((SELECT count(*) FROM compared WHERE (date_p, event_type) IN (SELECT (date_p, event_type) FROM found)) AS BIGINT) AS rows_cells
FROM found"""
SQL["falling_metrics"] = f"""WITH p AS (SELECT * REPLACE (CASE WHEN substr(date_minute, 9, 4) = '1200' THEN users // 2
    ELSE users END AS users) FROM ({SQL['cum_cube']})),
  s AS (SELECT *, lag(users) OVER w AS u, lag(amount) OVER w AS a FROM p
    WINDOW w AS (PARTITION BY date_p, level, event_type, band ORDER BY date_minute))
  SELECT event_type, band, level, date_minute, users, amount, date_p FROM s WHERE users < u OR amount < a"""

# --- event attribution ----------------------------------------------------------------

ALIASED = """CASE WHEN event_type = 'error' AND band = 'low' THEN 'error_low'
  WHEN event_type = 'signup' AND d < DATE '2024-01-10' THEN 'signup_early' ELSE event_type END"""
TAB = "'t' || CAST(k % 3 AS VARCHAR)"
IDS = "'[' || CAST(k AS VARCHAR) || '.5;' || CAST(user_id AS VARCHAR) || '&1,0]'"
LOG = f"""{EVENTS}, log AS (SELECT event_id AS record, {ALIASED} AS event_id, user_id AS gid, {DAY.format('d')} AS date_p,
  k, CAST(k AS VARCHAR) AS kt, band, {TAB} AS tab, 's' || CAST(k AS VARCHAR) AS scm, {IDS} AS ids FROM e)"""
CLICKED = "event_id = 'click' AND (k < 50 OR k >= 80)"
# rule number -> (test, level1, level2, level3, depth, module, deal, camera, share, icon, scm, tab, posi, material)
FACTS = {
    0: (CLICKED, "'相机'", "'shot'", "NULL", 2, "'camera'", "'one'", "'经典'", "'否'", "'是'",
        "CASE WHEN k < 50 THEN scm ELSE tab END", "CASE WHEN k < 50 THEN tab END", "NULL", "NULL"),
    1: (CLICKED, "'相机'", "'shot'", "NULL", 2, "'camera'", "'two'", "'经典'", "'否'", "'否'",
        "CASE WHEN k < 50 THEN scm ELSE tab END", "CASE WHEN k < 50 THEN tab END", "NULL", "NULL"),
    2: ("event_id = 'view'", "'美化'", "NULL", "NULL", 1, "'mh'", "NULL", "tab",
        "CASE WHEN k = 3 THEN '是' ELSE '否' END", "CASE WHEN k = 7 THEN '是' ELSE '否' END",
        "NULL", "NULL", "kt", "NULL"),
    3: ("event_id = 'view'", "'美容'", "'skin'", "'smooth'", 3, "'mr'", "NULL", "NULL", "'否'", "'否'",
        "NULL", "NULL", "NULL", "NULL"),
    4: ("event_id = 'purchase' AND k IN (1, 2, 3)", "'拼图'", "NULL", "NULL", 1, "'pt'", "NULL", "NULL", "'否'",
        "'否'", "NULL", "NULL", "NULL", "ids"),
    5: ("event_id = 'error_low'", "'首页垂类'", "NULL", "NULL", 1, "'homeicon'", "NULL", "NULL", "'否'", "'否'",
        "NULL", "NULL", "NULL", "NULL"),
    6: ("event_id = 'signup_early'", "'其他'", "NULL", "NULL", 1, "NULL", "NULL", "NULL", "'否'", "'否'",
        "NULL", "NULL", "NULL", "NULL"),
}
FACT_COLUMNS = (
    "main_func_name", "sub_func_level2_name", "sub_func_level3_name", "tool_level", "model_p", "deal_mode",
    "camera_mode", "sharephone", "second_icon", "scm", "tab_id", "posi_id", "material_id",
)


def facts_sql(columns: str) -> str:
    parts = []
    for number, (test, *values) in FACTS.items():
        typed = [
            f"CAST({v} AS {'INTEGER' if c == 'tool_level' else 'VARCHAR'}) AS {c}" for c, v in zip(FACT_COLUMNS, values)
        ]
        parts.append(
            f"SELECT record, gid, date_p, event_id, {number} AS rule_no, {', '.join(typed)} FROM log WHERE {test}"
        )
    return f"WITH {LOG}, facts AS ({' UNION ALL '.join(parts)}) {columns}"


SQL["rule_match"] = " UNION ALL ".join(
    f"SELECT event_id AS record, {number} AS rule_no, '{level1}' AS level1 FROM events WHERE event_type = '{kind}'"
    for number, kind, level1 in (
        (0, "click", "相机"), (1, "click", "相机"), (2, "view", "美化"), (3, "view", "美容"),
        (4, "purchase", "拼图"), (7, "purchase", "拼图"), (8, "view", "美化"),
    )
)
SQL["alias_events"] = f"WITH {EVENTS} SELECT event_id AS record, {ALIASED} AS event_id FROM e"
SQL["gate_events"] = f"""WITH {EVENTS} SELECT event_id AS record, event_type AS event_id FROM e
  WHERE event_type NOT IN ('click', 'view') OR k % 3 IN (1, 2)"""
SQL["fingerprint"] = """SELECT event_id,
  md5(CAST(event_id AS VARCHAR) || '#' || CAST(user_id AS VARCHAR) || '#'
      || CASE WHEN event_type = 'error' THEN chr(92) || 'N' ELSE event_type END || '#' || props) AS mark,
  md5(CAST(event_id AS VARCHAR) || '#' || CAST(user_id AS VARCHAR)
      || CASE WHEN event_type = 'error' THEN '' ELSE '#' || event_type END || '#' || props) AS old_mark FROM events"""
JSON_MARK = """md5(CAST(event_id AS VARCHAR) || '#{"band":"' || band || '","type":"' || event_type || '"}')"""
SQL["fingerprint_json"] = f"WITH {EVENTS} SELECT event_id, {JSON_MARK} AS mark, {JSON_MARK} AS turned_mark FROM e"
SQL["local_day"] = f"SELECT event_id, {DAY.format('ts + INTERVAL 8 HOUR')} AS day_number FROM events"
SQL["attribute"] = facts_sql("SELECT record, event_id, rule_no, 1 AS cnt FROM facts")
SQL["extract_attrs"] = facts_sql("SELECT record, rule_no, scm, tab_id, posi_id, material_id FROM facts")
SQL["mode_flags"] = facts_sql("SELECT record, rule_no, camera_mode, sharephone, second_icon FROM facts")
STRUCTURED = ("k >= 20 AND k % 3 <> 1", "k NOT IN (1, 2)", "TRUE")
SQL["structured_rules"] = f"WITH {EVENTS} " + " UNION ALL ".join(
    f"SELECT event_id AS record, {number} AS rule_no FROM e WHERE event_type = '{kind}' AND {STRUCTURED[c]}"
    for number, (kind, c) in enumerate([("click", 0), ("view", 0), ("click", 1), ("view", 2), ("error", 1)])
)
SQL["many_rules"] = f"""WITH {EVENTS}, kinds AS (SELECT ['click', 'view', 'purchase', 'signup', 'error'] AS names),
 ev AS (SELECT event_id AS record, event_type, user_id, k, k % 3 AS tab, band FROM e),
 orders_hit AS (SELECT record, o_orderkey AS rule_no, event_type, greatest(o_custkey, 99) AS grp,
   CASE o_orderkey % 3 WHEN 0 THEN 't' || tab WHEN 1 THEN band END AS value, o_orderkey % 3 < 2 AS named
  FROM ev, kinds, orders
  WHERE event_type = names[o_orderkey % 5 + 1]
    AND (user_id = o_custkey OR (o_orderkey % 3 = 0 AND user_id = o_custkey + 1))
    AND CASE o_orderkey % 4 WHEN 0 THEN k >= o_orderkey % 100 WHEN 1 THEN tab IN (0, 2) WHEN 2 THEN k NOT IN (1, o_orderkey % 100) ELSE TRUE END),
 said AS (SELECT record, event_type, grp, arg_min_null(value, rule_no) FILTER (WHERE named) AS tab_id FROM orders_hit GROUP BY ALL),
 of_orders AS (SELECT o_orderkey AS rule_no, said.tab_id, record FROM said, kinds, orders
  WHERE event_type = names[o_orderkey % 5 + 1] AND grp = greatest(o_custkey, 99)),
 of_nations AS (SELECT -1 - n_nationkey AS rule_no, CAST(k AS VARCHAR) AS tab_id, record FROM ev, kinds, nation
  WHERE event_type = names[n_nationkey % 5 + 1]
    AND CASE n_nationkey % 3 WHEN 0 THEN k < n_nationkey WHEN 1 THEN TRUE ELSE band = 'low' END)
SELECT CAST(rule_no AS BIGINT) AS rule_no, tab_id, count(*) AS events, CAST(sum(record) AS BIGINT) AS records
FROM (SELECT * FROM of_orders UNION ALL SELECT * FROM of_nations) GROUP BY ALL"""
SQL["rule_levels"] = facts_sql(
    "SELECT record, rule_no, main_func_name, sub_func_level2_name, sub_func_level3_name, tool_level, model_p FROM facts"
)
SQL["area_of"] = (
    "SELECT c_custkey, CASE WHEN c_nationkey IN (3, 7) THEN 'China' ELSE 'Overseas' END AS area FROM customer"
)
SQL["first_number"] = f"WITH {EVENTS} SELECT event_id, CAST(k AS BIGINT) AS number FROM e WHERE k % 3 < 2 AND k > 0"
SQL["explode_ids"] = f"""WITH {LOG} SELECT record, kt || '.5' AS id FROM log
  UNION ALL SELECT record, CAST(gid AS VARCHAR) || '&1' FROM log UNION ALL SELECT record, '0' FROM log"""
NEW = "CASE WHEN {0} IN (SELECT user_id FROM events WHERE value > 250) THEN 1 ELSE 0 END AS is_new_user"
SQL["exists_flag"] = f"SELECT event_id AS record, user_id AS gid, {NEW.format('user_id')} FROM events"
SQL["behaviour_facts"] = facts_sql(f"""SELECT gid, date_p, event_id, main_func_name, deal_mode, scm, tab_id, second_icon,
  model_p, tool_level, {NEW.format('gid')}, cnt FROM (
  SELECT gid, date_p, event_id, rule_no, main_func_name, deal_mode, scm, tab_id, second_icon, model_p, tool_level,
         count(*) AS cnt FROM facts
  GROUP BY ALL, posi_id, material_id, camera_mode, sharephone)""").replace(
    "GROUP BY ALL, posi_id, material_id, camera_mode, sharephone",
    "GROUP BY gid, date_p, event_id, rule_no, main_func_name, deal_mode, scm, tab_id, second_icon, model_p,"
    " tool_level, posi_id, material_id, camera_mode, sharephone",
)
SQL["material_facts"] = f"""WITH {LOG}, facts AS (
   SELECT gid, date_p, event_id, '拼图' AS main_func_name, kt, k FROM log WHERE event_id = 'purchase'
   UNION ALL SELECT gid, date_p, event_id, '美化', kt, k FROM log WHERE event_id = 'view' AND band = 'low'),
 ids AS (SELECT gid, date_p, event_id, main_func_name, kt || '.5' AS material_id_new, k AS number FROM facts
   UNION ALL SELECT gid, date_p, event_id, main_func_name, CAST(gid AS VARCHAR) || '&1', gid FROM facts)
SELECT gid, date_p, event_id, main_func_name, material_id_new,
  max(CASE WHEN number IN (SELECT user_id FROM events WHERE value > 200) THEN 1 ELSE 0 END) AS is_vip_material,
  {NEW.format('gid')}, count(*) AS cnt
FROM ids WHERE number > 0 GROUP BY gid, date_p, event_id, main_func_name, material_id_new"""

# --- text -----------------------------------------------------------------------------

SQL["page_text"] = """SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text,
  length(regexp_replace(html, '<[^>]*>', '', 'g')) AS whole_length FROM pages"""
SQL["mentions"] = r"""SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '@([0-9A-Za-z_\x{4e00}-\x{9fa5}-]+)', 1)))
  AS handle FROM documents"""
SQL["recent_turns"] = """SELECT * FROM conversations c WHERE (SELECT count(*) FROM conversations x
  WHERE x.conv_id = c.conv_id AND x.turn >= c.turn AND trim(x.text) <> '') <= 3 AND trim(text) <> ''"""
SPACE = "chr(32) || chr(9) || chr(10) || chr(13)"
SQL["recent_context"] = f"""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '用户' ELSE '助手' END AS who,
    trim(text, {SPACE}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
  SELECT conv_id, count(*) AS messages, string_agg(who || '：' || body, chr(10) ORDER BY turn) AS context
  FROM m WHERE n <= 12 GROUP BY conv_id"""
SQL["latest_pages"] = """SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages
  WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) SIMILAR TO '.*(tion|que).*' ORDER BY page_id DESC LIMIT 10"""

# --- sources and sinks ----------------------------------------------------------------

SQL["read_query"] = """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
  AND year(o_orderdate) = 1997 GROUP BY ALL"""
TWO_KEY_LEAF = cumulative_sql(["event_type"], [0], {"event_id": "requests", "user_id": "users"})
SQL["align_to_table"] = f"""SELECT event_type, CAST(requests AS DOUBLE) AS requests,
  CAST(CAST(CAST(amount AS DECIMAL(28,2)) AS DECIMAL(10,1)) AS DOUBLE) AS amount,
  CAST(date_minute AS BIGINT) AS date_minute, CAST(date_p AS BIGINT) AS date_p FROM ({TWO_KEY_LEAF})"""
SQL["write_day_roundtrip"] = f"""SELECT event_type, date_minute,
  CASE WHEN date_p = 20240102 THEN requests + 1000 ELSE requests END AS requests, users, amount, date_p
  FROM ({TWO_KEY_LEAF})"""
SQL["write_dynamic_roundtrip"] = f"""WITH {EVENTS} SELECT CASE WHEN band = 'low' THEN -count(*) ELSE count(*) END AS cnt,
  {AMOUNT}, {DAY.format('d')} AS date_p, band AS model_p FROM e GROUP BY d, band"""
SQL["delimited_roundtrip"] = """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
  event_type, props, '' AS absent FROM events"""

SQL["delimited_mixed"] = SQL["delimited_roundtrip"]
SQL["read_rules_files"] = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS rule_no, p_name AS level1 FROM part"
SQL["read_detail"] = "SELECT o_orderkey, o_orderstatus FROM orders"
SQL["read_rules"] = """SELECT p_name AS level1, 'click' AS event_id, p_type AS record_type, '无参数' AS scm
  FROM part WHERE p_name <> ''"""
SQL["insert_day_roundtrip"] = f"""WITH {EVENTS}, n AS (SELECT event_type, count(*) AS cnt, {DAY.format('d')} AS date_p FROM e GROUP BY ALL)
  SELECT event_type, CASE WHEN date_p = 20240102 THEN -cnt ELSE cnt END AS cnt, date_p FROM n"""

# --- streams --------------------------------------------------------------------------

SQL["stream_bucket_sums"] = (
    f"WITH {EVENTS} SELECT {PERIOD}, {BUCKET}, event_type, {AMOUNT} FROM e GROUP BY d, b, event_type"
)
SQL["stream_first_seen"] = f"""WITH {EVENTS}, f AS (SELECT d, event_type, user_id, min(b) AS b FROM e GROUP BY ALL)
  SELECT {PERIOD}, event_type, user_id, {BUCKET} FROM f"""
