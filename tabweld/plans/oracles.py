"""The same results in ANSI-style SQL, run by another engine over the same tables."""

from __future__ import annotations

from tabweld.functions.text import WHITESPACE
from tabweld.plans.fixtures import LEFT, RIGHT
from tabweld.plans.queries import ADDRESS_A, ADDRESS_B, CONTENT_A, CONTENT_B, CUSTOMER_SIDE, DECIMAL_GAPS, GAPS, LOG_A, LOG_B, NUMBERS_A, NUMBERS_B, ORDER_SIDE, TABLES

_SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def _clean(column: str) -> str:
    return f"lower(trim({column}, {_SPACES}))"


def _mode(column: str, source: str) -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


def _median(column: str, source: str) -> str:
    return f"(SELECT median({column}) FROM {source})"


def _close(a: str, b: str) -> str:
    return (
        f"CASE WHEN greatest(abs({a}), abs({b})) = 0 THEN 1.0 "
        f"ELSE 1.0 - abs(CAST({a} AS DOUBLE) - {b}) / greatest(abs({a}), abs({b})) END"
    )


def _grams(name: str, source: str, key: str, text: str) -> str:
    """CTE with the bigram counts of a text per key, padded by one space a side."""
    return f"""{name} AS (
  SELECT k, substr(t, i, 2) AS g, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {key} AS k, concat(' ', {text}, ' ') AS t, unnest(range(1, length({text}) + 2)) AS i FROM {source})
  GROUP BY 1, 2),
{name}_norm AS (SELECT k, sqrt(sum(n * n)) AS norm FROM {name} GROUP BY k)"""


# Cosine per key of two texts of the same row.
def _row_cosines(source: str, key: str, a: str, b: str) -> str:
    return f"""{_grams('ga', source, key, a)},
{_grams('gb', source, key, b)},
dots AS (SELECT ga.k, sum(ga.n * gb.n) AS dot FROM ga JOIN gb ON ga.k = gb.k AND ga.g = gb.g GROUP BY ga.k),
cosines AS (
  SELECT x.k, coalesce(dot, 0) / (x.norm * y.norm) AS cosine
  FROM ga_norm x JOIN gb_norm y ON x.k = y.k LEFT JOIN dots ON dots.k = x.k)"""


_SIDES = f"""l AS ({LEFT}), r AS ({RIGHT}),
lc AS (SELECT customer_id, {_clean('name')} AS name, balance, nation, {_clean('segment')} AS segment FROM l),
rc AS (SELECT cust_id, {_clean('full_name')} AS full_name, acct_balance, nation_key,
  {_clean('mkt_segment')} AS mkt_segment, {_clean('source_tag')} AS source_tag FROM r),
li AS (SELECT customer_id, name, coalesce(balance, {_median('balance', 'lc')}) AS balance, nation,
  coalesce(segment, {_mode('segment', 'lc')}) AS segment FROM lc),
ri AS (SELECT cust_id, full_name, coalesce(acct_balance, {_median('acct_balance', 'rc')}) AS acct_balance,
  nation_key, mkt_segment, source_tag FROM rc)"""

_LEFT_TEXT = (
    "concat('customer_id: ', printf('%.2f', CAST(customer_id AS DOUBLE)), ' | name: ', name, ' | balance: ', "
    "printf('%.2f', balance), ' | nation: ', printf('%.2f', CAST(nation AS DOUBLE)), ' | segment: ', segment)"
)
_RIGHT_TEXT = (
    "concat('cust_id: ', printf('%.2f', CAST(cust_id AS DOUBLE)), ' | full_name: ', full_name, ' | acct_balance: ', "
    "printf('%.2f', acct_balance), ' | nation_key: ', printf('%.2f', CAST(nation_key AS DOUBLE)), "
    "' | mkt_segment: ', mkt_segment)"
)

_SCORED = f"""{_SIDES},
pairs AS (SELECT *, {_LEFT_TEXT} AS left_text, {_RIGHT_TEXT} AS right_text FROM li JOIN ri ON customer_id = cust_id),
{_row_cosines('pairs', 'customer_id', 'left_text', 'right_text')},
fields AS (SELECT customer_id, (5.0 + jaro_winkler_similarity(name, full_name) + 2 * ({_close('balance', 'acct_balance')})
    + 2 * ({_close('nation', 'nation_key')}) + jaro_winkler_similarity(segment, mkt_segment)) / 11 AS field_score FROM pairs),
scored AS (SELECT customer_id, field_score, cosine, 0.3 * cosine + 0.7 * field_score AS score
  FROM fields JOIN cosines ON customer_id = k)"""

# Identifiers are unique on both sides, so each passing pair is a match, with score 1.
_MATCHED = f"""{_SCORED},
matched AS (SELECT customer_id AS id FROM scored WHERE round(score, 9) >= 0.85)"""


def _merged(aligned: bool) -> str:
    matched = _MATCHED.replace(">= 0.85", ">= 0.8") if aligned else _MATCHED

    def own(column: str) -> str:
        return column if aligned else "NULL"

    def filled(column: str, kind: str) -> str:
        return f"coalesce({column}, {(_median if kind == 'number' else _mode)(column, 'u')}) AS {column}"

    return f"""WITH {matched},
u AS (
  SELECT customer_id, name, balance, nation, segment, {own('customer_id')} AS cust_id, {own('name')} AS full_name,
    {own('balance')} AS acct_balance, {own('nation')} AS nation_key, {own('segment')} AS mkt_segment,
    CAST(NULL AS VARCHAR) AS source_tag,
    customer_id IN (SELECT id FROM matched) AS is_matched, CAST(NULL AS DOUBLE) AS match_score FROM l
  UNION ALL
  SELECT cust_id, full_name, acct_balance, nation_key, mkt_segment, cust_id, full_name, acct_balance, nation_key,
    mkt_segment, source_tag, cust_id IN (SELECT id FROM matched),
    CASE WHEN cust_id IN (SELECT id FROM matched) THEN 1.0 END FROM r)
SELECT customer_id, name, {filled('balance', 'number')}, nation, {filled('segment', 'text')},
  {'cust_id' if aligned else filled('cust_id', 'number')},
  {'full_name' if aligned else filled('full_name', 'text')}, {filled('acct_balance', 'number')},
  {'nation_key' if aligned else filled('nation_key', 'number')}, {filled('mkt_segment', 'text')},
  {filled('source_tag', 'text')}, is_matched, match_score FROM u"""


def _expanded(column: str) -> str:
    words = f"replace(lower({column}), '_', ' ')"
    with_id = f"concat({words}, CASE WHEN contains({words}, 'id') THEN ' identifier primary key' ELSE '' END)"
    with_age = (
        f"concat({with_id}, CASE WHEN contains({with_id}, 'age') OR contains({with_id}, 'years') "
        "THEN ' age in years numeric' ELSE '' END)"
    )
    return f"concat({with_age}, CASE WHEN contains({with_age}, 'name') THEN ' person name text' ELSE '' END)"


def _catalog_match(left: str, right: str) -> str:
    """Column matches of catalogs with ``pair, position, column_name``."""
    return f"""lcat AS ({left}), rcat AS ({right}),
cand AS (SELECT lcat.pair, lcat.position AS lp, lcat.column_name AS left_column, rcat.position AS rp,
    rcat.column_name AS right_column FROM lcat JOIN rcat ON lcat.pair = rcat.pair),
words AS (SELECT DISTINCT column_name AS x, {_expanded('column_name')} AS w
  FROM (SELECT column_name FROM lcat UNION SELECT column_name FROM rcat)),
{_grams('gw', 'words', 'x', 'w')},
dots AS (
  SELECT x.k AS a, y.k AS b, sum(x.n * y.n) AS dot FROM gw x JOIN gw y ON x.g = y.g
  WHERE x.k IN (SELECT column_name FROM lcat) AND y.k IN (SELECT column_name FROM rcat) GROUP BY 1, 2),
sims AS (
  SELECT cand.*, round(0.7 * (coalesce(dot, 0) / (p.norm * q.norm))
    + 0.3 * jaro_winkler_similarity(lower(left_column), lower(right_column)), 9) AS score
  FROM cand JOIN gw_norm p ON p.k = left_column JOIN gw_norm q ON q.k = right_column
  LEFT JOIN dots ON a = left_column AND b = right_column),
chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, lp ORDER BY score DESC, rp) AS n FROM sims)
  WHERE n = 1 AND score >= 0.6),
col_matches AS (
  SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY pair, rp ORDER BY lp) AS n FROM chosen) WHERE n = 1)"""


def _names(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT 0 AS pair, {i} AS position, '{n}' AS column_name" for i, n in enumerate(names))


_LEFT_NAMES = ("customer_id", "name", "balance", "nation", "segment")
_RIGHT_NAMES = ("cust_id", "full_name", "acct_balance", "nation_key", "mkt_segment", "source_tag")
_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_SUPPLIER = {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}


def _values(table: str, *names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS column_name, count({n}) AS non_null FROM {table}" for n in names)


def _profile(ctes: str, source: str, types: dict[str, str], columns: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
        f"CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) * 100.0 / count(*), 2) END AS null_percent FROM {source}"
        for c, t in types.items()
    )
    return f"WITH {ctes} SELECT {columns} FROM ({rows})"


_GAP_TYPES = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "price": "double", "quantity": "int", "flag": "string",
}

_LINES = f"""g AS ({GAPS}), filled AS (
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(price, {_median('price', 'g')}) AS price,
  coalesce(CAST(quantity AS DOUBLE), {_median('quantity', 'g')}) AS quantity,
  coalesce(flag, {_mode('flag', 'g')}) AS flag FROM g)"""

_ORDERS_TO_CUSTOMERS = f"""WITH l AS ({ORDER_SIDE}), r AS ({CUSTOMER_SIDE}),
pairs AS (
  SELECT order_no, cust_id, lower(name) AS name, lower(full_name) AS full_name, balance, acct_balance,
    concat('customer_id: ', printf('%.2f', CAST(customer_id AS DOUBLE)), ' | name: ', lower(name), ' | balance: ',
      printf('%.2f', balance)) AS left_text,
    concat('cust_id: ', printf('%.2f', CAST(cust_id AS DOUBLE)), ' | full_name: ', lower(full_name), ' | acct_balance: ',
      printf('%.2f', acct_balance)) AS right_text
  FROM l JOIN r ON customer_id = cust_id),
{_row_cosines('pairs', 'order_no', 'left_text', 'right_text')},
scored AS (SELECT order_no, cust_id, 0.3 * cosine + 0.7 * (5 + jaro_winkler_similarity(name, full_name)
    + 2 * ({_close('balance', 'acct_balance')})) / 8 AS score FROM pairs JOIN cosines ON order_no = k)
SELECT max(order_no) AS left_id, cust_id AS right_id, 1.0 AS match_score
FROM scored WHERE round(score, 9) >= 0.85 GROUP BY cust_id"""

# Greedy pass per user: left entries from the highest down, each takes the highest
# passing right entry that is still free.
_EVENT_LOGS = f"""WITH RECURSIVE l AS ({LOG_A}), r AS ({LOG_B}),
lt AS (SELECT *, concat('user_id: ', printf('%.2f', CAST(user_id AS DOUBLE)), ' | action: ', action, ' | amount: ',
    printf('%.2f', amount)) AS t FROM l),
rt AS (SELECT line, userid, lower(action_name) AS action_name, amount_paid,
  concat('userid: ', printf('%.2f', CAST(userid AS DOUBLE)), ' | action_name: ', lower(action_name), ' | amount_paid: ',
    printf('%.2f', amount_paid)) AS t FROM r),
{_grams('ga', 'lt', 'entry', 't')},
{_grams('gb', 'rt', 'line', 't')},
au AS MATERIALIZED (SELECT k, n, concat(user_id, g) AS ug FROM ga JOIN lt ON k = entry),
bu AS MATERIALIZED (SELECT k, n, concat(userid, g) AS ug FROM gb JOIN rt ON k = line),
dots AS MATERIALIZED (SELECT au.k AS entry, bu.k AS line, sum(au.n * bu.n) AS dot
  FROM au JOIN bu ON au.ug = bu.ug GROUP BY 1, 2),
passing AS MATERIALIZED (
  SELECT user_id, lt.entry, rt.line
  FROM lt JOIN rt ON user_id = userid JOIN dots ON dots.entry = lt.entry AND dots.line = rt.line
  JOIN ga_norm x ON x.k = lt.entry JOIN gb_norm y ON y.k = rt.line
  WHERE round(0.3 * (dot / (x.norm * y.norm)) + 0.7 * (5 + jaro_winkler_similarity(action, action_name)
    + 2 * ({_close('amount', 'amount_paid')})) / 8, 9) >= 0.85),
lists AS MATERIALIZED (SELECT user_id, entry, list(line ORDER BY line DESC) AS options,
    row_number() OVER (PARTITION BY user_id ORDER BY entry DESC) AS turn FROM passing GROUP BY user_id, entry),
steps(user_id, turn, entry, line, used) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) FROM l
  UNION ALL
  SELECT user_id, turn, entry, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (SELECT s.user_id, s.turn + 1 AS turn, o.entry, s.used,
      list_filter(o.options, lambda v: NOT list_contains(s.used, v))[1] AS pick
    FROM steps s JOIN lists o ON o.user_id = s.user_id AND o.turn = s.turn + 1))
SELECT entry AS left_id, line AS right_id, 1.0 AS match_score FROM steps WHERE turn > 0 AND line IS NOT NULL"""

# Greedy pass over all passing pairs, one match per step; the smaller table bounds the steps.
_CUSTOMERS_TO_SUPPLIERS = f"""WITH RECURSIVE
lt AS (SELECT *, lower(c_name) AS a, concat('c_name: ', lower(c_name), ' | c_nationkey: ',
    printf('%.2f', CAST(c_nationkey AS DOUBLE)), ' | c_acctbal: ', printf('%.2f', c_acctbal)) AS t FROM customer),
rt AS (SELECT *, lower(s_name) AS b, concat('s_name: ', lower(s_name), ' | s_nationkey: ',
    printf('%.2f', CAST(s_nationkey AS DOUBLE)), ' | s_acctbal: ', printf('%.2f', s_acctbal)) AS t FROM supplier),
{_grams('ga', 'lt', 'c_custkey', 't')},
{_grams('gb', 'rt', 's_suppkey', 't')},
dots AS MATERIALIZED (SELECT ga.k AS a, gb.k AS b, sum(ga.n * gb.n) AS dot FROM ga JOIN gb ON ga.g = gb.g GROUP BY 1, 2),
edges AS MATERIALIZED (SELECT * FROM (
  SELECT c_custkey AS l, s_suppkey AS r, round(0.3 * (dot / (x.norm * y.norm)) + 0.7 * (jaro_winkler_similarity(lt.a, rt.b)
    + 2 * ({_close('c_nationkey', 's_nationkey')}) + 2 * ({_close('c_acctbal', 's_acctbal')})) / 5, 9) AS score
  FROM dots JOIN lt ON c_custkey = dots.a JOIN rt ON s_suppkey = dots.b
  JOIN ga_norm x ON x.k = dots.a JOIN gb_norm y ON y.k = dots.b) WHERE score >= 0.8),
steps(l, r, score, used_l, used_r) AS (
  SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT * FROM (
    SELECT e.l, e.r, e.score, list_append(used_l, e.l), list_append(used_r, e.r) FROM steps s
    JOIN edges e ON NOT list_contains(s.used_l, e.l) AND NOT list_contains(s.used_r, e.r)
    ORDER BY e.score DESC, e.l DESC, e.r DESC LIMIT 1))
SELECT l AS left_id, r AS right_id, round(score, 6) AS match_score FROM steps WHERE l >= 0"""


def _one_to_one(left: str, right: str, a: str, b: str, field: str) -> str:
    """Greedy pass over all pairs that reach 0.85; ``lt`` and ``rt`` have the row texts as ``t``."""
    return f"""WITH RECURSIVE lt AS ({left}), rt AS ({right}),
{_grams('ga', 'lt', a, 't')},
{_grams('gb', 'rt', b, 't')},
dots AS MATERIALIZED (SELECT ga.k AS a, gb.k AS b, sum(ga.n * gb.n) AS dot FROM ga JOIN gb ON ga.g = gb.g GROUP BY 1, 2),
edges AS MATERIALIZED (SELECT * FROM (
  SELECT {a} AS l, {b} AS r, round(0.3 * (dot / (x.norm * y.norm)) + 0.7 * ({field}), 9) AS score
  FROM dots JOIN lt ON {a} = dots.a JOIN rt ON {b} = dots.b
  JOIN ga_norm x ON x.k = dots.a JOIN gb_norm y ON y.k = dots.b) WHERE score >= 0.85),
steps(l, r, score, used_l, used_r) AS (
  SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT * FROM (
    SELECT e.l, e.r, e.score, list_append(used_l, e.l), list_append(used_r, e.r) FROM steps s
    JOIN edges e ON NOT list_contains(s.used_l, e.l) AND NOT list_contains(s.used_r, e.r)
    ORDER BY e.score DESC, e.l DESC, e.r DESC LIMIT 1))
SELECT l AS left_id, r AS right_id, round(score, 6) AS match_score FROM steps WHERE l >= 0"""


def _numbers_text(columns: list[str]) -> str:
    return "concat(" + ", ' | ', ".join(f"'{c}: ', printf('%.2f', CAST({c} AS DOUBLE))" for c in columns) + ") AS t"


_PAGES_BY_ADDRESS = _one_to_one(
    f"SELECT *, lower(link) AS x, concat('link: ', lower(link)) AS t FROM ({ADDRESS_A})",
    f"SELECT *, lower(address) AS y, concat('address: ', lower(address)) AS t FROM ({ADDRESS_B})",
    "page", "place", "jaro_winkler_similarity(lt.x, rt.y)",
)

_CUSTOMERS_BY_NUMBERS = _one_to_one(
    f"SELECT *, {_numbers_text(list('abcdef'))} FROM ({NUMBERS_A})",
    f"SELECT *, {_numbers_text([c * 2 for c in 'abcdef'])} FROM ({NUMBERS_B})",
    "row_no", "pos", "(" + " + ".join(f"({_close('lt.' + c, 'rt.' + c * 2)})" for c in "abcdef") + ") / 6",
)


def _middle(column: str) -> str:
    """Median of a decimal column in thousandths, from ranks."""
    return (
        f"(SELECT CAST(sum({column}) * 1000 / count(*) AS BIGINT) FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) AS k, "
        f"count(*) OVER () AS n FROM d WHERE {column} IS NOT NULL) WHERE k IN ((n + 1) // 2, n // 2 + 1))"
    )


def _contents(source: str, columns: str) -> str:
    """Distinct values of each column as text; numbers alike in any type."""
    parts = []
    for i, c in enumerate(columns.split()):
        plain = f"lower(trim(CAST({c} AS VARCHAR), {_SPACES}))"
        whole = f"CASE WHEN typeof({c}) = 'DOUBLE' AND TRY_CAST({c} AS DOUBLE) = floor(TRY_CAST({c} AS DOUBLE)) THEN CAST(TRY_CAST(TRY_CAST({c} AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE {plain} END"
        parts.append(f"SELECT {i} AS p, '{c}' AS c, {whole} AS v FROM ({source})")
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) WHERE v <> ''"


_CONTENT_COLUMNS = f"""WITH lv AS ({_contents(CONTENT_A, 'a0 a1 a2 a3 a4')}), rv AS ({_contents(CONTENT_B, 'b0 b1 b2 b3 b4 b5')}),
ln AS (SELECT p, c, count(*) AS n FROM lv GROUP BY ALL), rn AS (SELECT p, c, count(*) AS n FROM rv GROUP BY ALL),
shared AS (SELECT lv.p AS lp, rv.p AS rp, count(*) AS n FROM lv JOIN rv USING (v) GROUP BY 1, 2),
scored AS (SELECT lp, rp, ln.c AS left_column, rn.c AS right_column, round(s.n / ln.n, 9) AS score, round(s.n / (ln.n + rn.n - s.n), 9) AS overlap
  FROM shared s JOIN ln ON ln.p = lp JOIN rn ON rn.p = rp),
chosen AS (SELECT *, row_number() OVER (PARTITION BY lp ORDER BY score DESC, overlap DESC, rp) AS k FROM scored WHERE score >= 0.5),
picked AS (SELECT *, row_number() OVER (PARTITION BY rp ORDER BY score DESC, overlap DESC, lp) AS m FROM chosen WHERE k = 1)
SELECT left_column, right_column, round(score, 6) AS score FROM picked WHERE m = 1"""


def oracle_sql() -> dict[str, str]:
    shapes = {
        "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
        "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
    }
    part_pairs = {"name_type": ("p_name", "p_type"), "name_brand": ("p_name", "p_brand"), "brand_type": ("p_brand", "p_type")}
    order_types = {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    }
    merged_types = dict.fromkeys((*_LEFT_NAMES, *_RIGHT_NAMES, "is_matched", "match_score"), "")
    return {
        "merge_customers": _merged(False),
        "merge_customers_aligned": _merged(True),
        "verified_merge": _merged(False),
        "keyless_merge": _merged(False),
        "preprocessed_customers": f"WITH {_SIDES} SELECT customer_id, name, balance, nation, segment FROM li",
        "csv_codes": "SELECT p_partkey, concat(p_size, CASE WHEN p_size % 2 = 0 THEN 'D' ELSE 'f' END) AS code FROM part",
        "exported_orders": "SELECT o_orderstatus, count(*) AS orders, max(o_orderkey) AS last, (SELECT count(*) FROM orders)::INTEGER AS rows FROM orders GROUP BY 1",
        "pages_by_address": _PAGES_BY_ADDRESS,
        "content_columns": _CONTENT_COLUMNS,
        "impute_decimals": f"""WITH d AS ({DECIMAL_GAPS}) SELECT l_orderkey, l_linenumber,
  coalesce(CAST(price * 1000 AS BIGINT), {_middle('price')}) AS price_milli,
  coalesce(CAST(discount * 1000 AS BIGINT), {_middle('discount')}) AS discount_milli FROM d""",
        "customers_by_numbers": _CUSTOMERS_BY_NUMBERS,
        "matched_pairs": f"WITH {_MATCHED} SELECT id AS left_id, id AS right_id, 1.0 AS match_score FROM matched",
        "match_statistics": f"""WITH {_MATCHED} SELECT n AS total_matches, 5 AS schema_matches, a - n AS unmatched_left,
  b - n AS unmatched_right, round(n * 100.0 / least(a, b), 2) AS match_rate
FROM (SELECT (SELECT count(*) FROM matched) AS n, (SELECT count(*) FROM l) AS a, (SELECT count(*) FROM r) AS b)""",
        "match_quality": f"""WITH {_MATCHED}, counts AS (SELECT (SELECT count(*) FROM matched) AS predicted,
  (SELECT count(*) FROM customer WHERE c_nationkey >= 5) AS actual,
  (SELECT count(*) FROM matched JOIN customer ON id = c_custkey WHERE c_nationkey >= 5) AS correct)
SELECT predicted, actual, correct, round(correct / predicted, 6) AS precision, round(correct / actual, 6) AS recall,
  round(2 * (correct / predicted) * (correct / actual) / (correct / predicted + correct / actual), 6) AS f1 FROM counts""",
        "golden_customers": f"""WITH {_MATCHED}
SELECT coalesce(customer_id, cust_id) AS customer_id, coalesce(name, full_name) AS name,
  coalesce(balance, acct_balance) AS balance, coalesce(nation, nation_key) AS nation,
  coalesce(segment, mkt_segment) AS segment, source_tag
FROM l LEFT JOIN matched ON customer_id = id FULL JOIN r ON id = cust_id""",
        "orders_to_customers": _ORDERS_TO_CUSTOMERS,
        "event_logs": _EVENT_LOGS,
        "customers_to_suppliers": _CUSTOMERS_TO_SUPPLIERS,
        "field_similarity": f"""WITH {_SCORED} SELECT customer_id AS left_id, round(field_score, 6) AS field_score,
  round(cosine, 6) AS cosine, round(round(score, 9), 6) AS score FROM scored""",
        "row_texts": f"WITH {_SIDES} SELECT customer_id, {_LEFT_TEXT} AS row_text FROM li",
        "text_row_texts": """SELECT o_orderkey, concat('order_id: ord-', o_orderkey, ' | order_id: ord-', o_orderkey,
  ' | order_id: ord-', o_orderkey, ' | o_orderpriority: ', lower(o_orderpriority), ' | o_totalprice: ',
  printf('%.2f', o_totalprice)) AS row_text FROM orders""",
        "id_texts": """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_number_text,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
    ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice_text,
  CAST(o_custkey AS VARCHAR) AS o_custkey_text, lower(o_orderstatus) AS status_text FROM orders""",
        "part_spelling": "SELECT p_partkey, "
        + ", ".join(f"round(jaro_winkler_similarity(lower({a}), lower({b})), 6) AS {n}" for n, (a, b) in part_pairs.items())
        + " FROM part",
        "turn_cosines": f"""WITH pairs AS (SELECT a.conv_id, a.turn, a.text, b.text AS next_text,
  a.conv_id * 100000 + a.turn AS id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
{_row_cosines('pairs', 'id', 'text', 'next_text')}
SELECT conv_id, turn, round(cosine, 6) AS cosine FROM pairs JOIN cosines ON id = k""",
        "document_label_cosines": f"""WITH pairs AS (SELECT doc_id, text, concat(lang, ' ', source) AS tag FROM documents),
{_row_cosines('pairs', 'doc_id', 'text', 'tag')} SELECT k AS doc_id, round(cosine, 6) AS cosine FROM cosines""",
        "price_closeness": f"""SELECT l_returnflag, l_linestatus,
  round(avg({_close('l_extendedprice', '(l_quantity * p_retailprice)')}), 6) AS price_closeness,
  round(avg({_close('l_discount', 'l_tax')}), 6) AS rate_closeness
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
        "vector_cosines": """WITH cells AS (SELECT vec_id, label, unnest(embedding) AS x,
  unnest(range(len(embedding))) AS place FROM embeddings),
means AS (SELECT label, place, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY 1, 2)
SELECT vec_id, round(sum(CAST(x AS DOUBLE) * m) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(m * m))), 6) AS cosine
FROM cells JOIN means USING (label, place) GROUP BY vec_id""",
        "near_vectors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding, lambda x: round(x::DOUBLE, 1)) AS w FROM embeddings)
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.v, b.w), 6) AS cosine
FROM e a JOIN e b ON list_cosine_similarity(a.v, b.w) >= 0.975""",
        "text_embeddings": """SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS n_spaces,
  length(text) - length(replace(text, chr(10), '')) AS n_breaks, length(text) - length(translate(text, 'ea', '')) AS n_vowels
FROM documents""",
        "schema_match_report": f"""WITH l AS ({LEFT}), r AS ({RIGHT}), {_catalog_match(_names(*_LEFT_NAMES), _names(*_RIGHT_NAMES))},
lv AS ({_values('l', *_LEFT_NAMES)}), rv AS ({_values('r', *_RIGHT_NAMES)})
SELECT left_column, right_column, round(score, 6) AS score, lv.non_null AS left_values, rv.non_null AS right_values
FROM col_matches JOIN lv ON lv.column_name = left_column JOIN rv ON rv.column_name = right_column""",
        "unmatched_column_report": f"""WITH {_catalog_match(_names(*_CUSTOMER), _names(*_SUPPLIER))},
lv AS ({_values('customer', *_CUSTOMER)}), rv AS ({_values('supplier', *_SUPPLIER)})
SELECT 'left' AS side, * FROM lv WHERE column_name NOT IN (SELECT left_column FROM col_matches)
UNION ALL SELECT 'right', * FROM rv WHERE column_name NOT IN (SELECT right_column FROM col_matches)""",
        "shared_columns": " UNION ALL ".join(
            f"SELECT '{a}' AS left_table, '{b}' AS right_table, {shares} AS compatible, "
            f"(SELECT count(*) FROM {a}) + (SELECT count(*) FROM {b}) AS n_rows"
            for a, b, shares in (
                ("documents", "labels", "true"), ("documents", "conversations", "true"),
                ("customer", "supplier", "false"), ("documents", "benchmark", "true"),
            )
        ),
        "catalog_matches": f"""WITH {_catalog_match(
            "SELECT p_brand AS pair, row_number() OVER (PARTITION BY p_brand ORDER BY c) - 1 AS position, c AS column_name "
            "FROM (SELECT DISTINCT p_brand, replace(p_name, ' ', '_') AS c FROM part)",
            "SELECT p_brand AS pair, row_number() OVER (PARTITION BY p_brand ORDER BY c) - 1 AS position, c AS column_name "
            "FROM (SELECT DISTINCT p_brand, concat(split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)) AS c FROM part)",
        )} SELECT pair AS p_brand, left_column, right_column, round(score, 6) AS score FROM col_matches""",
        "expanded_names": f"""SELECT p_partkey, {_expanded("concat(p_name, '_', p_type)")} AS words FROM part""",
        "clean_documents": f"SELECT {_clean('text')} AS text, {_clean('lang')} AS lang FROM (SELECT DISTINCT text, lang FROM documents)",
        "first_copies": f"""SELECT doc_id, length({_clean('text')}) AS n_chars
FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text, lang)""",
        "impute_customers": f"WITH {_SIDES} SELECT * FROM li",
        "impute_lines": f"WITH {_LINES} SELECT * FROM filled",
        "impute_empty_columns": "SELECT o_orderkey, '' AS note, CAST(0 AS DOUBLE) AS weight FROM orders",
        "nulls_after_imputation": _profile(_LINES, "filled", _GAP_TYPES, "column_name, non_null, nulls"),
        "profile_lines": _profile(f"g AS ({GAPS})", "g", _GAP_TYPES, "*"),
        "profile_merged": _profile(
            f"m AS ({_merged(False)})", "m", merged_types, "column_name, non_null, nulls, null_percent"
        ),
        "table_shapes": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, {shapes[t]} AS n_columns" for t in TABLES
        ),
        "indexed_orders": """SELECT o_orderkey, o_custkey, o_totalprice,
  row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders""",
        "content_positions": """SELECT l_suppkey, l_linenumber, l_returnflag, l_linestatus,
  row_number() OVER (ORDER BY md5(concat_ws(chr(31), l_suppkey, l_linenumber, l_returnflag, l_linestatus))) - 1 AS row_id
FROM lineitem""",
        "renamed_columns": "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_totalprice AS total_price_paid FROM orders",
        "dropped_column": "SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS VARCHAR) AS remark FROM supplier",
        "exported_types": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS big
FROM orders""",
        "listed_columns": "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM orders"
            for i, (c, t) in enumerate(order_types.items())
        )
        + ")",
        "latest_events": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 20",
        "csv_round_trip": LEFT,
        "json_round_trip": LEFT,
        "sqlite_round_trip": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS big FROM orders""",
    }
