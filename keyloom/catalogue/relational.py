"""Queries over projections, joins, aggregates, windows, set operations and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.catalogue.registry import joined, money, query
from keyloom.operators import joins, profile, projection, relational
from keyloom.plans import models

# -- projections ----------------------------------------------------------------------------


@query("declared_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def declared_columns(t):
    return projection.keep_columns(t.orders, ["o_totalprice", "not_there", "o_orderkey"])


@query(
    "star_except",
    "SELECT o_orderkey AS src_o_orderkey_x, o_custkey AS src_o_custkey_x, o_orderstatus AS src_o_orderstatus_x, o_orderdate AS src_o_orderdate_x FROM orders",
)
def star_except(t):
    df = t.orders
    return df.select(projection.star(df, leave_out=["O_TOTALPRICE", "o_orderpriority"], prefix="src_", suffix="_x"))


@query(
    "blank_to_null",
    "SELECT p_partkey, nullif(replace(p_type, 'ECONOMY', ''), '') AS p_type, p_brand, p_size FROM part",
)
def blank_to_null(t):
    blanked = t.part.select("p_partkey", F.replace("p_type", F.lit("ECONOMY"), F.lit("")).alias("p_type"), "p_brand", "p_size")
    return projection.blank_to_null(blanked)


@query(
    "typed_projection",
    "SELECT c_custkey, TRY_CAST(c_mktsegment AS BIGINT) AS c_mktsegment, TRY_CAST(substr(c_name, 10) AS BIGINT) AS c_name FROM customer",
)
def typed_projection(t):
    df = t.customer.select("c_custkey", "c_mktsegment", F.expr("substr(c_name, 10)").alias("c_name"))
    return projection.cast_columns(df, {"c_mktsegment": "bigint", "c_name": "bigint"})


@query(
    "nested_to_json",
    """
    SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS props,
      '[' || CAST(user_id AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) || ']' AS ids
    FROM events
    """,
)
def nested_to_json(t):
    nested = t.events.select("event_id", F.from_json("props", "k int").alias("props"), F.array("user_id", "event_id").alias("ids"))
    return projection.nested_to_json(nested)


def _order_rules(df):
    spec = {
        "o_orderpriority": {"required": True},
        "o_totalprice": {"type": "double", "min": 1000, "max": 400000},
        "o_clerk": {"type": "bigint"},
    }
    return projection.column_rules(df, spec)


def _loose_orders(t):
    priority = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")
    clerk = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("o_clerk")
    return t.orders.select("o_orderkey", priority, "o_totalprice", clerk)


_LOOSE = """(SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice,
    CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS o_clerk FROM orders)"""


@query(
    "validation_rejects",
    f"""
    SELECT * FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority IS NULL THEN 'o_orderpriority:required' END,
      CASE WHEN o_totalprice < 1000 THEN 'o_totalprice:min' END, CASE WHEN o_totalprice > 400000 THEN 'o_totalprice:max' END,
      CASE WHEN TRY_CAST(o_clerk AS BIGINT) IS NULL AND o_clerk IS NOT NULL THEN 'o_clerk:type' END) AS faults FROM {_LOOSE}) WHERE faults <> ''
    """,
)
def validation_rejects(t):
    df = _loose_orders(t)
    _, rejected = projection.validation_gate(df, _order_rules(df))
    return rejected.select("o_orderkey", joined(F.col("faults")).alias("faults"))


@query(
    "validation_summary",
    f"""
    SELECT count(*) AS rows_in, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected
    FROM (SELECT o_orderpriority IS NULL OR o_totalprice < 1000 OR o_totalprice > 400000 OR TRY_CAST(o_clerk AS BIGINT) IS NULL AS bad FROM {_LOOSE})
    """,
)
def validation_summary(t):
    df = _loose_orders(t)
    return projection.gate_summary(df, _order_rules(df))


# -- joins and the modelled tables -------------------------------------------------------------


@query(
    "enriched_join",
    """
    SELECT o.o_orderkey, year(o.o_orderdate) AS ano, o.o_totalprice, f.flag, f.items
    FROM orders o LEFT JOIN (SELECT l_orderkey, year(l_shipdate) AS y, max(l_returnflag) AS flag, count(*) AS items FROM lineitem GROUP BY 1, 2) f
      ON o.o_orderkey = f.l_orderkey AND year(o.o_orderdate) = f.y
    """,
)
def enriched_join(t):
    facts = t.orders.withColumn("ano", F.year("o_orderdate").cast("bigint"))
    finance = t.lineitem.groupBy("l_orderkey", F.year("l_shipdate").cast("bigint").alias("y")).agg(
        F.max("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("items")
    )
    return models.enriched(
        facts, finance, {"o_orderkey": "l_orderkey", "ano": "y"}, ["o_orderkey", "ano", "o_totalprice"], ["flag", "items"]
    )


@query(
    "gold_panel",
    """
    SELECT year(o.o_orderdate) AS ano, o.o_orderstatus AS ug, o.o_orderpriority AS fonte_recurso, count(DISTINCT o.o_orderkey) AS qtd_empenhos,
      CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_empenhado, count(DISTINCT l.l_partkey) AS qtd_planos_acao
    FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2, 3
    """,
)
def gold_panel(t):
    panel = models.execution_panel(
        t.orders.withColumn("ano", F.year("o_orderdate").cast("bigint")),
        t.lineitem,
        {"o_orderkey": "l_orderkey"},
        {"ano": "ano", "ug": "o_orderstatus", "fonte_recurso": "o_orderpriority"},
        "o_orderkey",
        money(F.col("o_totalprice")),
        "l_partkey",
    )
    return panel.withColumn("total_empenhado", F.col("total_empenhado").cast("double"))


@query(
    "match_rate_custkey",
    """
    SELECT count(*) AS rows_a, count(c.c_custkey) AS hits, count(c.c_custkey) / count(*) AS match_rate
    FROM orders o LEFT JOIN (SELECT DISTINCT 3 * c_custkey AS c_custkey FROM customer) c ON o.o_custkey = c.c_custkey
    """,
)
def match_rate_custkey(t):
    return joins.match_rate(t.orders, "o_custkey", t.customer.select((3 * F.col("c_custkey")).alias("c_custkey")), "c_custkey")


@query(
    "match_rate_by_year",
    """
    SELECT year(o_orderdate) AS "by", count(*) AS rows_a, count(v) AS hits, count(v) / count(*) AS match_rate
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS v, year(l_shipdate) AS y FROM lineitem) ON o_orderkey = v AND year(o_orderdate) = y GROUP BY 1
    """,
)
def match_rate_by_year(t):
    year = lambda c: F.year(c).cast("bigint")
    return joins.match_rate(t.orders, "o_orderkey", t.lineitem, "l_orderkey", by_a=year("o_orderdate"), by_b=year("l_shipdate"))


@query(
    "year_aligned_rate",
    """
    WITH oy AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
      ly AS (SELECT DISTINCT year(l_shipdate) + 2 AS y FROM lineitem),
      a AS (SELECT * FROM orders WHERE year(o_orderdate) IN (SELECT y FROM ly)),
      b AS (SELECT * FROM lineitem WHERE year(l_shipdate) + 2 IN (SELECT y FROM oy))
    SELECT count(*) AS rows_a, count(k) AS hits, count(k) / count(*) AS match_rate FROM a LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM b) ON o_orderkey = k
    """,
)
def year_aligned_rate(t):
    """Orders against lines shipped two years before: the tables share some years only."""
    a, b = joins.common_groups(t.orders, F.year("o_orderdate"), t.lineitem, F.year("l_shipdate") + 2)
    return joins.match_rate(a, "o_orderkey", b, "l_orderkey")


@query(
    "name_set_difference",
    """
    WITH named AS (SELECT upper(p_name || ' ' || p_type || ' ' || (p_partkey % 7)) AS n, p_size FROM part)
    SELECT a.n AS actual, e.n AS expected FROM (SELECT DISTINCT n FROM named WHERE p_size % 2 = 0) a
    FULL JOIN (SELECT DISTINCT n FROM named WHERE p_size % 2 = 1) e ON a.n = e.n WHERE a.n IS NULL OR e.n IS NULL
    """,
)
def name_set_difference(t):
    named = t.part.select(F.concat_ws(" ", "p_name", "p_type", F.pmod("p_partkey", F.lit(7)).cast("string")).alias("name"), "p_size")
    return joins.name_set_difference(named.where("p_size % 2 = 0").select("name"), named.where("p_size % 2 = 1").select("name"))


# -- aggregates ----------------------------------------------------------------------------------


@query(
    "group_by_first",
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2
    """,
)
def group_by_first(t):
    df = t.orders.select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return relational.group_by_first(
        df, 2, F.count(F.lit(1)).alias("n"), F.sum(money(F.col("o_totalprice"))).cast("double").alias("total")
    )


_PROFILE_SQL = """
    SELECT '{c}' AS column_name, (SELECT count(*) FROM {t}) AS row_count, count(DISTINCT v) AS unique_count, 1 - count(v) / count(*) AS null_rate,
      count(DISTINCT v) / count(v) AS uniqueness_rate,
      (SELECT string_agg(v, ',' ORDER BY r) FROM (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS r
         FROM (SELECT CAST({e} AS VARCHAR) AS v FROM {t}) WHERE v IS NOT NULL GROUP BY v) WHERE r <= 5) AS top_values
    FROM (SELECT CAST({e} AS VARCHAR) AS v FROM {t})"""


@query(
    "column_profile",
    "WITH p AS (SELECT p_partkey, p_brand, nullif(p_type, 'ECONOMY') AS p_type, p_size FROM part) "
    + " UNION ALL ".join(_PROFILE_SQL.format(c=c, e=c, t="p") for c in ("p_partkey", "p_brand", "p_type", "p_size")),
)
def column_profile(t):
    df = t.part.select("p_partkey", "p_brand", F.nullif("p_type", F.lit("ECONOMY")).alias("p_type"), "p_size")
    got = profile.column_profile(df)
    return got.select("column_name", "row_count", "unique_count", "null_rate", "uniqueness_rate", joined(F.col("top_values")).alias("top_values"))


@query(
    "key_suggestions",
    """
    SELECT column_name, dtype FROM (SELECT 'o_orderkey' AS column_name, 'bigint' AS dtype, count(DISTINCT o_orderkey) / count(*) AS u FROM orders
      UNION ALL SELECT 'o_custkey', 'bigint', count(DISTINCT o_custkey) / count(*) FROM orders
      UNION ALL SELECT 'o_orderstatus', 'string', count(DISTINCT o_orderstatus) / count(*) FROM orders
      UNION ALL SELECT 'o_totalprice', 'double', count(DISTINCT o_totalprice) / count(*) FROM orders
      UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(DISTINCT o_orderdate) / count(*) FROM orders
      UNION ALL SELECT 'o_orderpriority', 'string', count(DISTINCT o_orderpriority) / count(*) FROM orders) WHERE u > 0.95
    """,
)
def key_suggestions(t):
    return profile.key_suggestions(t.orders).select("column_name", "dtype")


@query(
    "table_profile",
    """
    WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(2019 + user_id % 5 AS INTEGER) END AS cd_ano FROM events)
    SELECT 'events' AS table_name, count(*) AS row_count,
      (SELECT string_agg(coalesce(CAST(cd_ano AS VARCHAR), 'nan') || ':' || n, ',' ORDER BY coalesce(CAST(cd_ano AS VARCHAR), 'nan')) FROM (SELECT cd_ano, count(*) AS n FROM e GROUP BY 1)) AS years,
      'cd_ano:' || count(DISTINCT cd_ano) || ',event_id:' || count(DISTINCT event_id) || ',event_type:' || count(DISTINCT event_type) || ',user_id:' || count(DISTINCT user_id) AS cardinality,
      (count(*) - count(cd_ano)) / (4 * count(*)) < 0.2 AS quality_ok
    FROM e
    """,
)
def table_profile(t):
    year = F.when(F.col("user_id") % 3 != 0, (2019 + F.col("user_id") % 5).cast("int"))
    df = t.events.select("event_id", "user_id", "event_type", year.alias("cd_ano"))
    got = profile.table_profile(df, "events")
    shown = lambda m: joined(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return got.select(
        "table_name", "row_count", shown("exercicio_distribution").alias("years"), shown("cardinality_per_col").alias("cardinality"), "quality_ok"
    )


@query(
    "pivot_status",
    """
    SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS "F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS "O",
      CAST(sum(CASE WHEN o_orderstatus = 'none such' THEN 1 ELSE 0 END) AS BIGINT) AS none_such,
      count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_custkey END) AS "cust_F_not"
    FROM orders GROUP BY 1
    """,
)
def pivot_status(t):
    counts = relational.pivot_columns("o_orderstatus", ["F", "O"])
    absent = relational.pivot_columns("o_orderstatus", ["none such"], quote=False)
    others = relational.pivot_columns(
        "o_orderstatus", ["F"], agg="count", cmp="<>", prefix="cust_", suffix="_not", then=F.col("o_custkey"), otherwise=None, distinct=True
    )
    return t.orders.groupBy("o_orderpriority").agg(*counts, *absent, *others)


@query(
    "column_values",
    """
    SELECT value, n FROM (SELECT nullif(p_type, 'ECONOMY') AS value, count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1)
    ORDER BY n DESC, value LIMIT 4
    """,
)
def column_values(t):
    df = t.part.withColumn("kind", F.nullif("p_type", F.lit("ECONOMY")))
    return relational.column_values(df, "kind", max_records=4, where="p_size > 5")


@query(
    "year_distribution",
    "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def year_distribution(t):
    year = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.year("o_orderdate").cast("string"))
    return profile.year_distribution(t.orders.select(year.alias("ano")), "ano")


@query(
    "single_value",
    "SELECT coalesce((SELECT max(o_orderkey) FROM orders), -1) AS value UNION ALL SELECT coalesce((SELECT max(o_orderkey) FROM orders WHERE o_totalprice < 0), -1)",
)
def single_value(t):
    # a query whose first cell is a number, and one that finds no row
    biggest = t.orders.agg(F.max("o_orderkey").alias("k"))
    nothing = t.orders.where("o_totalprice < 0").select("o_orderkey")
    return relational.single_value(biggest, -1).unionAll(relational.single_value(nothing, -1))


@query("high_water_mark", "SELECT event_type, max(ts) AS mark FROM events GROUP BY 1")
def high_water_mark(t):
    return t.events.groupBy("event_type").agg(F.max("ts").alias("mark"))


# -- windows, top-k --------------------------------------------------------------------------------


@query(
    "dedup_latest",
    """
    SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1
    """,
)
def dedup_latest(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return relational.deduplicate(df, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")])


@query(
    "first_values",
    """
    SELECT 'c_name' AS column_name, string_agg(c_name, ',' ORDER BY c_custkey) AS sample FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)
    UNION ALL SELECT 'segment', string_agg(segment, ',' ORDER BY c_custkey) FROM
      (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer WHERE c_mktsegment <> 'MACHINERY' ORDER BY c_custkey LIMIT 5)
    """,
)
def first_values(t):
    df = t.customer.select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    got = profile.column_samples(df, ["c_name", "segment"], 5, ["c_custkey"])
    return got.select("column_name", joined(F.col("sample")).alias("sample"))


@query(
    "top_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def top_orders(t):
    return relational.top(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query(
    "top_per_customer",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3
    """,
)
def top_per_customer(t):
    df = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.top_per_group(df, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


# -- set operations, unpivot, generators -------------------------------------------------------------


@query(
    "except_both_ways",
    """
    WITH a AS (SELECT l_partkey AS k, l_returnflag AS f FROM lineitem WHERE l_quantity <= 25), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 25)
    SELECT 'a_minus_b' AS which_diff, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'b_minus_a', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    """,
)
def except_both_ways(t):
    df = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("f"), "l_quantity")
    return relational.symmetric_difference(df.where("l_quantity <= 25").drop("l_quantity"), df.where("l_quantity > 25").drop("l_quantity"))


@query(
    "union_relations",
    """
    SELECT 'customer' AS _dbt_source_relation, c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance
    FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'supplier', s_suppkey, CAST(s_nationkey AS BIGINT), NULL, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0
    """,
)
def union_relations(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_name")
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return relational.union_relations(
        {"customer": a, "supplier": b}, column_override={"nation": "bigint"}, exclude=["C_NAME"], where="id % 2 = 0"
    )


@query(
    "union_all",
    "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT c_nationkey, c_name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier",
)
def union_all(t):
    part = lambda df, k, n: df.select(F.col(k).alias("k"), F.col(n).alias("name"))
    return part(t.nation, "n_nationkey", "n_name").unionAll(part(t.customer, "c_nationkey", "c_name")).unionAll(part(t.supplier, "s_nationkey", "s_name"))


@query("accepted_distinct", "SELECT DISTINCT p_brand AS value_field FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'Brand#99')")
def accepted_distinct(t):
    return relational.accepted_distinct(t.part, "p_brand", ["Brand#2", "Brand#17", "Brand#99"])


@query("number_series", "SELECT CAST(n AS BIGINT) AS generated_number FROM range(1, (SELECT count(*) FROM lineitem) + 1) r(n)")
def number_series(t):
    return relational.number_series(t.spark, t.lineitem.count())


@query(
    "date_spine",
    """
    SELECT CAST(d AS TIMESTAMP) AS date_day FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)
    WHERE d < (SELECT max(o_orderdate) FROM orders)
    """,
)
def date_spine(t):
    return relational.date_spine(t.orders.agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")), "day")


@query(
    "month_spine",
    """
    SELECT CAST(d AS TIMESTAMP) AS date_month FROM (SELECT unnest(generate_series(date_trunc('month', min(l_shipdate)), max(l_shipdate), INTERVAL 1 MONTH)) AS d FROM lineitem)
    WHERE d < (SELECT max(l_shipdate) FROM lineitem)
    """,
)
def month_spine(t):
    bounds = t.lineitem.agg(F.date_trunc("month", F.min("l_shipdate")).cast("timestamp_ntz").alias("start"), F.max("l_shipdate").alias("end"))
    return relational.date_spine(bounds, "month")


@query(
    "unpivot_part",
    """
    SELECT p_partkey, 'p_brand' AS prop, p_brand AS val FROM part UNION ALL SELECT p_partkey, 'p_type', nullif(p_type, 'ECONOMY') FROM part
    UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'big', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM part
    """,
)
def unpivot_part(t):
    df = t.part.withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY"))).withColumn("big", F.col("p_size") > 25)
    return relational.unpivot(df, exclude=["P_PARTKEY"], remove=["p_name", "p_retailprice"], field_name="prop", value_name="val")
