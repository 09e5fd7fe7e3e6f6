"""Queries over the data-quality checks; the result of each is its failing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.catalogue.registry import query
from keyloom.operators import checks
from keyloom.operators.joins import name_set_difference
from keyloom.operators.suite import RowRule, TableRule, run_suite
from keyloom.session import small_table


def _nulled(t):
    """Lines with NULLs: these tables have none of their own."""
    flag = F.nullif("l_returnflag", F.lit("A"))
    qty = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", flag.alias("flag"), qty.alias("qty"), "l_shipdate")


_NULLED = """(SELECT l_orderkey, l_partkey, l_linenumber, nullif(l_returnflag, 'A') AS flag,
    CASE WHEN l_linenumber <> 7 THEN l_quantity END AS qty, l_shipdate FROM lineitem)"""


@query("dq_accepted_range", f"SELECT l_orderkey, l_linenumber, qty FROM {_NULLED} WHERE qty < 3 OR qty > 48")
def accepted_range(t):
    return checks.accepted_range(_nulled(t), "qty", 3, 48).select("l_orderkey", "l_linenumber", "qty")


@query(
    "dq_accepted_range_exclusive",
    f"SELECT l_orderkey, l_linenumber, qty FROM {_NULLED} WHERE qty <= l_linenumber AND l_linenumber <> 5",
)
def accepted_range_exclusive(t):
    rows = checks.accepted_range(_nulled(t), "qty", low="l_linenumber", inclusive=False, where="l_linenumber <> 5")
    return rows.select("l_orderkey", "l_linenumber", "qty")


@query(
    "dq_at_least_one",
    f"SELECT l_orderkey, count(flag) AS filler_column FROM {_NULLED} GROUP BY 1 HAVING count(flag) = 0",
)
def at_least_one(t):
    return checks.at_least_one(_nulled(t), "flag", ["l_orderkey"])


@query(
    "dq_at_least_one_ungrouped",
    "SELECT count(x) AS filler_column FROM (SELECT CASE WHEN l_quantity < 0 THEN 1 END AS x FROM lineitem) HAVING count(x) = 0",
)
def at_least_one_ungrouped(t):
    return checks.at_least_one(t.lineitem.select(F.when(F.col("l_quantity") < 0, 1).alias("x")), "x")


@query(
    "dq_cardinality_equality",
    """
    WITH a AS (SELECT n_nationkey AS value, count(*) AS num_rows FROM nation GROUP BY 1), b AS (SELECT c_nationkey, count(*) FROM customer GROUP BY 1)
    (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)
    """,
)
def cardinality_equality(t):
    return checks.cardinality_equality(t.nation, "n_nationkey", t.customer, "c_nationkey")


@query(
    "dq_equal_rowcount",
    """
    SELECT a.k AS group_key_a, b.k AS group_key_b, a.s AS flag_a, b.s AS flag_b, count_a, count_b, abs(count_a - count_b) AS diff_count
    FROM (SELECT 1 AS k, o_orderstatus AS s, count(*) AS count_a FROM orders GROUP BY 1, 2) a
    FULL JOIN (SELECT 1 AS k, l_linestatus AS s, count(*) AS count_b FROM lineitem GROUP BY 1, 2) b ON a.k = b.k AND a.s = b.s
    """,
)
def equal_rowcount(t):
    a, b = t.orders.select(F.col("o_orderstatus").alias("flag")), t.lineitem.select(F.col("l_linestatus").alias("flag"))
    return checks.equal_rowcount(a, b, ["flag"]).rows


@query(
    "dq_equal_rowcount_failures",
    "SELECT abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM lineitem)) AS failures",
)
def equal_rowcount_failures(t):
    return checks.equal_rowcount(t.orders, t.lineitem).failures()


@query(
    "dq_equality",
    """
    WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders)
    SELECT 'a_minus_b' AS which_diff, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_minus_a', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    """,
)
def equality(t):
    a = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    changed = F.when(F.col("o_custkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    return checks.equality(a, a.withColumn("o_orderstatus", changed), exclude_columns=["O_CUSTKEY"]).rows


@query(
    "dq_equality_precision",
    """
    WITH a AS (SELECT round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS p FROM orders), b AS (SELECT round(CAST(o_totalprice + CASE WHEN o_custkey % 7 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(18,2)), 1) AS p FROM orders),
      d AS (SELECT 1 AS s FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT -1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
    SELECT CAST(count(*) + coalesce(abs(sum(s)), 0) AS BIGINT) AS failures FROM d
    """,
)
def equality_precision(t):
    shifted = F.col("o_totalprice") + F.when(F.col("o_custkey") % 7 == 0, 0.5).otherwise(0.0)
    a = t.orders.select("o_totalprice")
    return checks.equality(a, t.orders.select(shifted.alias("o_totalprice")), precision=1).failures()


@query("dq_expression_is_true", f"SELECT l_orderkey, l_linenumber, qty FROM {_NULLED} WHERE NOT (qty + l_linenumber < 50)")
def expression_is_true(t):
    return checks.expression_is_true(_nulled(t), "qty + l_linenumber < 50").select("l_orderkey", "l_linenumber", "qty")


@query("dq_expression_is_true_column", f"SELECT l_orderkey, l_linenumber, qty FROM {_NULLED} WHERE NOT (qty > 2) AND flag = 'R'")
def expression_is_true_column(t):
    return checks.expression_is_true(_nulled(t), "> 2", column="qty", where="flag = 'R'").select("l_orderkey", "l_linenumber", "qty")


@query(
    "dq_fewer_rows_than",
    """
    SELECT a.k AS group_key_a, b.k AS group_key_b, a.n AS nation_a, b.n AS nation_b, count_our_model, count_comparison_model,
      CAST(CASE WHEN count_our_model > count_comparison_model THEN count_our_model - count_comparison_model WHEN count_our_model = count_comparison_model THEN 1 ELSE 0 END AS BIGINT) AS row_count_delta
    FROM (SELECT 1 AS k, c_nationkey AS n, count(*) AS count_our_model FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2) a
    FULL JOIN (SELECT 1 AS k, c_nationkey AS n, count(*) AS count_comparison_model FROM customer WHERE c_acctbal <= 5000 GROUP BY 1, 2) b ON a.k = b.k AND a.n = b.n
    """,
)
def fewer_rows_than(t):
    c = t.customer.select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return checks.fewer_rows_than(c.where("c_acctbal > 5000"), c.where("c_acctbal <= 5000"), ["nation"]).rows


_RANGES = """
    WITH w AS (SELECT {by} lo AS lower_bound, hi AS upper_bound, lead(lo) OVER ({part} ORDER BY lo NULLS LAST, hi NULLS LAST) AS next_lower_bound,
        lead(1) OVER ({part} ORDER BY lo NULLS LAST, hi NULLS LAST) IS NULL AS is_last_record FROM {rows}),
      c AS (SELECT *, coalesce(lower_bound {zero} upper_bound, false) AS {zero_name}, coalesce(upper_bound {gap} next_lower_bound, is_last_record, false) AS {gap_name} FROM w)
    SELECT * FROM c WHERE NOT ({zero_name} AND {gap_name})
"""


def _ranges_sql(rows, gap, gap_word, by=None, zero="<", zero_word="less_than"):
    return _RANGES.format(
        rows=rows,
        by=f"{by} AS partition_by_col," if by else "",
        part=f"PARTITION BY {by}" if by else "",
        zero=zero,
        zero_name=f"lower_bound_{zero_word}_upper_bound",
        gap=gap,
        gap_name=f"upper_bound_{gap_word}_next_lower_bound",
    )


@query(
    "dq_mutually_exclusive_ranges",
    _ranges_sql("(SELECT o_custkey, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi FROM orders)", "<=", "less_than_or_equal_to", by="o_custkey"),
)
def mutually_exclusive_ranges(t):
    df = t.orders.select("o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"))
    return checks.mutually_exclusive_ranges(df, "lo", "hi", partition_by="o_custkey")


@query(
    "dq_ranges_not_allowed_gaps",
    _ranges_sql("(SELECT event_id AS lo, event_id + CASE WHEN value > 20 THEN 1 ELSE user_id % 3 END AS hi FROM events)", "=", "equal_to", zero="<=", zero_word="less_than_or_equal_to"),
)
def ranges_not_allowed_gaps(t):
    step = F.when(F.col("value") > 20, 1).otherwise(F.col("user_id") % 3)
    df = t.events.select(F.col("event_id").alias("lo"), (F.col("event_id") + step).alias("hi"))
    return checks.mutually_exclusive_ranges(df, "lo", "hi", gaps="not_allowed", zero_length=True)


@query(
    "dq_ranges_required_gaps",
    _ranges_sql("(SELECT p_brand, nullif(p_size, 50) AS lo, CASE WHEN p_partkey % 11 <> 0 THEN p_size + 1 END AS hi FROM part)", "<", "less_than", by="p_brand"),
)
def ranges_required_gaps(t):
    """Repeated and NULL bounds."""
    hi = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") + 1)
    df = t.part.select("p_brand", F.nullif("p_size", F.lit(50)).alias("lo"), hi.alias("hi"))
    return checks.mutually_exclusive_ranges(df, "lo", "hi", partition_by="p_brand", gaps="required")


@query("dq_not_accepted_values", "SELECT DISTINCT event_type AS value_field FROM events WHERE event_type IN ('error', 'click', 'nothing')")
def not_accepted_values(t):
    return checks.not_accepted_values(t.events, "event_type", ["error", "click", "nothing"])


@query(
    "dq_not_constant",
    f"SELECT l_orderkey, count(DISTINCT flag) AS filler_column FROM {_NULLED} GROUP BY 1 HAVING count(DISTINCT flag) = 1",
)
def not_constant(t):
    return checks.not_constant(_nulled(t), "flag", ["l_orderkey"])


@query(
    "dq_not_empty_string",
    """SELECT trim(s) AS s FROM (SELECT CASE WHEN length(text) % 7 = 0 THEN '   ' WHEN length(text) % 11 = 0 THEN '' WHEN lang <> 'en' THEN NULL ELSE text END AS s FROM documents) WHERE trim(s) = ''""",
)
def not_empty_string(t):
    n = F.length("text")
    s = F.when(n % 7 == 0, "   ").when(n % 11 == 0, "").when(F.col("lang") != "en", None).otherwise(F.col("text"))
    return checks.not_empty_string(t.documents.select(s.alias("s")), "s")


@query(
    "dq_not_null_proportion",
    f"SELECT l_linenumber, count(flag) / count(*) AS not_null_proportion FROM {_NULLED} GROUP BY 1 HAVING count(flag) / count(*) < 0.67 OR count(flag) / count(*) > 0.9",
)
def not_null_proportion(t):
    return checks.not_null_proportion(_nulled(t), "flag", 0.67, 0.9, ["l_linenumber"])


@query(
    "dq_recency",
    """
    SELECT user_id, max(ts) AS most_recent, (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS threshold FROM events
    GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR
    """,
)
def recency(t):
    now = t.events.agg(F.max("ts")).head()[0]
    return checks.recency(t.events, "ts", "hour", 6, now=F.lit(now).cast("timestamp_ntz"), groups=["user_id"])


@query(
    "dq_recency_date_only",
    """
    SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS most_recent, CAST(TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 90 DAY AS DATE) AS threshold
    FROM orders GROUP BY 1 HAVING CAST(max(o_orderdate) AS DATE) < CAST(TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 90 DAY AS DATE)
    """,
)
def recency_date_only(t):
    now = F.lit("2001-08-01 12:00:00").cast("timestamp_ntz")
    return checks.recency(t.orders, "o_orderdate", "day", 90, now=now, ignore_time=True, groups=["o_custkey"])


@query(
    "dq_relationships_where",
    """
    SELECT l_orderkey AS id, CAST(NULL AS BIGINT) AS right_id FROM lineitem WHERE l_quantity > 10
      AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    """,
)
def relationships_where(t):
    return checks.relationships_where(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "l_quantity > 10", "o_orderstatus <> 'P'")


@query(
    "dq_sequential_values",
    """
    SELECT * FROM (SELECT o_custkey, y AS o_year, lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS previous_o_year
      FROM (SELECT o_custkey, year(o_orderdate) AS y FROM orders)) WHERE NOT (o_year = previous_o_year + 1)
    """,
)
def sequential_values(t):
    df = t.orders.select("o_custkey", F.year("o_orderdate").cast("bigint").alias("o_year"))
    return checks.sequential_values(df, "o_year", 1, groups=["o_custkey"])


@query(
    "dq_sequential_timestamps",
    """
    SELECT * FROM (SELECT d, lag(d) OVER (ORDER BY d) AS previous_d FROM (SELECT l_shipdate AS d FROM lineitem)) WHERE NOT (d = previous_d + INTERVAL 1 DAY)
    """,
)
def sequential_timestamps(t):
    return checks.sequential_values(t.lineitem.select(F.col("l_shipdate").alias("d")), "d", 1, datepart="day")


@query(
    "dq_unique_combination",
    "SELECT l_orderkey, flag FROM " + _NULLED + " GROUP BY 1, 2 HAVING count(*) > 1",
)
def unique_combination(t):
    return checks.unique_combination(_nulled(t), ["l_orderkey", "flag"])


@query("dq_not_null", f"SELECT * FROM {_NULLED} WHERE qty IS NULL")
def not_null(t):
    return checks.not_null(_nulled(t), "qty")


@query(
    "dq_unique",
    "SELECT k AS unique_field, count(*) AS n_records FROM (SELECT nullif(o_custkey, 0) AS k FROM orders) WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
)
def unique(t):
    return checks.unique(t.orders.select(F.nullif("o_custkey", F.lit(0)).alias("k")), "k")


@query(
    "dq_accepted_values",
    "SELECT o_orderpriority AS value_field, count(*) AS n_records FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1",
)
def accepted_values(t):
    return checks.accepted_values(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("dq_assert_equal", f"SELECT l_orderkey, l_linenumber FROM {_NULLED} WHERE qty <> l_linenumber * 5")
def assert_equal(t):
    return checks.assert_equal(_nulled(t), "qty", "l_linenumber * 5").select("l_orderkey", "l_linenumber")


@query(
    "dq_column_set",
    """
    SELECT a.n AS actual, e.n AS expected FROM (SELECT DISTINCT upper(event_type) AS n FROM events) a
    FULL JOIN (SELECT unnest(['CLICK', 'VIEW', 'LOGIN', 'PURCHASE']) AS n) e ON a.n = e.n WHERE a.n IS NULL OR e.n IS NULL
    """,
)
def column_set(t):
    """Names held as data, one for each kind of event, against a declared set."""
    return name_set_difference(t.events.select("event_type"), small_table(t.spark, [(n,) for n in ("click", "view", "login", "purchase")], "name string"))


@query(
    "dq_non_empty",
    "SELECT 'late orders: load returned zero rows' AS message WHERE (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0",
)
def non_empty(t):
    return checks.non_empty(t.orders.where("o_totalprice < 0"), "late orders")


@query(
    "dq_suite",
    f"""
    SELECT 'qty_in_range' AS "check", 'qty' AS "column", count(*) FILTER (qty < 3 OR qty > 48) AS failures, CASE WHEN count(*) FILTER (qty < 3 OR qty > 48) > 0 THEN 'fail' ELSE 'pass' END AS status FROM {_NULLED}
    UNION ALL SELECT 'flag_present', 'flag', count(*) FILTER (flag IS NULL), CASE WHEN count(*) FILTER (flag IS NULL) > 0 THEN 'warn' ELSE 'pass' END FROM {_NULLED}
    UNION ALL SELECT 'line_positive', NULL, count(*) FILTER (NOT l_linenumber > 0), 'pass' FROM {_NULLED}
    UNION ALL SELECT 'flag_where', 'flag', count(*) FILTER (flag <> 'R' AND l_linenumber = 1), CASE WHEN count(*) FILTER (flag <> 'R' AND l_linenumber = 1) > 100000000 THEN 'fail' ELSE 'warn' END FROM {_NULLED}
    UNION ALL SELECT 'line_unique', NULL, (SELECT count(*) FROM (SELECT 1 FROM {_NULLED} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 'fail'
    """,
)
def suite(t):
    df = _nulled(t)
    return run_suite(
        df,
        [
            RowRule("qty_in_range", "qty", checks.in_range("qty", 3, 48)),
            RowRule("flag_present", "flag", F.col("flag").isNotNull(), severity="warn"),
            RowRule("line_positive", None, F.col("l_linenumber") > 0),
            RowRule("flag_where", "flag", F.col("flag") == "R", where="l_linenumber = 1", error_if="> 100000000"),
            TableRule("line_unique", None, checks.unique_combination(df, ["l_orderkey", "l_linenumber"])),
        ],
    )
