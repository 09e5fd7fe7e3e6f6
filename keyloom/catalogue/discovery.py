"""Queries over vocabulary, profiles and join-key discovery."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.catalogue import discovery_sql as sql
from keyloom.catalogue.discovery_sql import KEYS
from keyloom.catalogue.registry import joined, query
from keyloom.functions import strings
from keyloom.functions.vocabulary import Vocabulary, load_vocabulary
from keyloom.operators import profile
from keyloom.plans import derived, discovery, models
from keyloom.session import scratch_dir

def _tables(t, *names, **options):
    return discovery.Tables({n: getattr(t, n) for n in names}, order_by={n: KEYS[n] for n in names}, **options)


# -- vocabulary -------------------------------------------------------------------------------

# An alias vocabulary over part names, so that the number of names grows with the data.
SHADES = Vocabulary(
    "shades",
    {"warm": ["red", "Red Ring"], "round": ["ring", "small ring"], "tool": ["widget", "gear", "large"], "rest": ["metal blue"]},
    {},
    False,
)

GROUP_SQL = """
    CASE WHEN n IN ('red', 'red_ring') THEN 'warm' WHEN n IN ('ring', 'small_ring') THEN 'round' WHEN n IN ('widget', 'gear', 'large') THEN 'tool' WHEN n = 'metal_blue' THEN 'rest'
      WHEN contains(n, 'red') OR contains('red', n) OR contains(n, 'red_ring') OR contains('red_ring', n) THEN 'warm'
      WHEN contains(n, 'ring') OR contains('ring', n) OR contains(n, 'small_ring') OR contains('small_ring', n) THEN 'round'
      WHEN contains(n, 'widget') OR contains('widget', n) OR contains(n, 'gear') OR contains('gear', n) OR contains(n, 'large') OR contains('large', n) THEN 'tool'
      WHEN contains(n, 'metal_blue') OR contains('metal_blue', n) THEN 'rest' END"""


@query(
    "vocabulary_group",
    f"SELECT p_partkey, p_name, {GROUP_SQL} AS grp FROM (SELECT *, replace(lower(p_name), ' ', '_') AS n FROM part)",
)
def vocabulary_group(t):
    return t.part.select("p_partkey", "p_name", SHADES.group_of(F.col("p_name")).alias("grp"))


@query(
    "vocabulary_coverage",
    f"""
    SELECT p_brand, count(*) AS total_columns, count(g) AS recognized, count(g) / count(*) AS coverage, count(g) / count(*) >= 0.6 AS passes_threshold
    FROM (SELECT *, {GROUP_SQL} AS g FROM (SELECT *, replace(lower(p_name), ' ', '_') AS n FROM part)) GROUP BY 1
    """,
)
def vocabulary_coverage(t):
    return discovery.name_coverage(t.part, "p_name", SHADES, groups=["p_brand"])


@query(
    "unrecognized_names",
    f"SELECT DISTINCT p_brand, p_name FROM (SELECT *, {GROUP_SQL} AS g FROM (SELECT *, replace(lower(p_name), ' ', '_') AS n FROM part)) WHERE g IS NULL",
)
def unrecognized_names(t):
    return discovery.unrecognized_names(t.part, "p_name", SHADES, groups=["p_brand"])


@query(
    "vocabulary_from_file",
    """
    SELECT p_brand, count(*) AS n, count(CASE WHEN contains(replace(lower(p_name), ' ', '_'), 'ring') OR contains('ring', replace(lower(p_name), ' ', '_')) THEN 1 END) AS ringed FROM part GROUP BY 1
    """,
)
def vocabulary_from_file(t):
    path = f"{scratch_dir(t.spark, 'vocabulary')}"
    body = json.dumps({"domain_name": "rings", "semantic_groups": {"ringed": ["ring"]}})
    t.spark.range(1).select(F.lit(body).alias("value")).coalesce(1).write.text(path)
    group = load_vocabulary(t.spark, path).group_of(F.col("p_name"))
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count(group).alias("ringed"))


# -- patterns and years --------------------------------------------------------------------------


@query(
    "pattern_profile",
    r"""
    WITH s AS (SELECT 'c_name' AS column_name, c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT 'code', c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') FROM customer
        UNION ALL SELECT 'year_like', c_custkey, CAST(c_custkey + 1900 AS VARCHAR) FROM customer),
      n AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k) AS r FROM s)
    SELECT column_name, CASE WHEN avg(CASE WHEN regexp_matches(v, '^\d{5}$') THEN 1.0 ELSE 0 END) > 0.5 THEN 'orgao'
        WHEN avg(CASE WHEN regexp_matches(v, '^\d{4}$') THEN 1.0 ELSE 0 END) > 0.5 THEN 'exercicio' END AS best_pattern,
      greatest(avg(CASE WHEN regexp_matches(v, '^\d{5}$') THEN 1.0 ELSE 0 END), avg(CASE WHEN regexp_matches(v, '^\d{4}$') THEN 1.0 ELSE 0 END)) AS best_score,
      avg(length(v)) AS avg_length, string_agg(v, ',' ORDER BY r) FILTER (r <= 5) AS sample_values
    FROM n GROUP BY 1
    """,
)
def pattern_profile(t):
    code = strings.pad_left(F.col("c_custkey"), 5)
    df = t.customer.select("c_custkey", "c_name", code.alias("code"), (F.col("c_custkey") + 1900).alias("year_like"))
    got = profile.pattern_profile(df, ["c_name", "code", "year_like"], order_by=["c_custkey"])
    return got.select("column_name", "best_pattern", "best_score", "avg_length", joined(F.col("sample_values")).alias("sample_values"))


@query(
    "year_column",
    r"""
    SELECT min_by(column_name, ord) AS year_column FROM (
      SELECT 'o_orderkey' AS column_name, 0 AS ord, avg(CASE WHEN regexp_matches(CAST(o_orderkey AS VARCHAR), '^\d{4}$') THEN 1.0 ELSE 0 END) AS share, false AS in_span FROM orders
      UNION ALL SELECT 'fiscal', 1, avg(CASE WHEN regexp_matches(CAST(year(o_orderdate) AS VARCHAR), '^\d{4}$') THEN 1.0 ELSE 0 END), min(year(o_orderdate)) >= 1990 AND max(year(o_orderdate)) <= 2040 FROM orders)
    WHERE share >= 0.8 AND in_span
    """,
)
def year_column(t):
    df = t.orders.select("o_orderkey", F.year("o_orderdate").alias("fiscal"), "o_orderstatus")
    return profile.year_column(df, {"exercicio": ["ano"]})


@query(
    "year_histogram",
    "SELECT string_agg(y || ':' || n, ',' ORDER BY y) AS years FROM (SELECT CAST(year(l_shipdate) AS VARCHAR) AS y, count(*) AS n FROM lineitem GROUP BY 1)",
)
def year_histogram(t):
    got = profile.year_map(t.lineitem.select(F.year("l_shipdate").alias("ano")), "ano")
    entries = F.array_sort(F.map_entries("exercicio_distribution"))
    return got.select(joined(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))).alias("years"))


# -- value overlap -------------------------------------------------------------------------------

_KEY_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderpriority"],
    "customer": ["c_custkey", "c_nationkey", "c_name"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
    "part": ["p_partkey", "p_size"],
    "supplier": ["s_suppkey", "s_nationkey", "s_name"],
    "nation": ["n_nationkey", "n_name"],
}


def _overlap_sql():
    text = lambda c: f"regexp_replace(upper({c}), '[.\\-/\\s]', '', 'g')" if c in ("o_orderpriority", "c_name", "s_name", "n_name") else f"CAST({c} AS VARCHAR)"
    rows = [
        f"SELECT {i * 10 + j} AS o, {i} AS ti, '{table}' AS t, '{c}' AS c, {text(c)} AS v FROM {table}"
        for i, (table, cols) in enumerate(_KEY_COLUMNS.items())
        for j, c in enumerate(cols)
    ]
    return f"""
    WITH v AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(rows)})), u AS (SELECT o, ti, t, c, count(*) AS n FROM v GROUP BY ALL),
      x AS (SELECT a.o AS oa, b.o AS ob, count(*) AS n, array_to_string(list_slice(list_sort(list(a.v)), 1, 5), ',') AS s FROM v a JOIN v b ON a.v = b.v AND a.ti < b.ti GROUP BY 1, 2)
    SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, a.n AS unique_a, b.n AS unique_b, coalesce(x.n, 0) AS intersection,
      coalesce(x.n, 0) / a.n AS match_rate_a_in_b, coalesce(x.n, 0) / b.n AS match_rate_b_in_a, coalesce(x.s, '') AS sample_matches
    FROM u a JOIN u b ON a.ti < b.ti LEFT JOIN x ON x.oa = a.o AND x.ob = b.o
    """


@query("overlap_matrix", _overlap_sql())
def overlap_matrix(t):
    tables = discovery.Tables({n: getattr(t, n).select(cols) for n, cols in _KEY_COLUMNS.items()})
    got = discovery.overlap_matrix(tables)
    return got.withColumn("sample_matches", joined(F.col("sample_matches")))


_CONTAINED = """
    WITH a AS (SELECT DISTINCT {a} AS v FROM {ta}), b AS (SELECT DISTINCT {b} AS v FROM {tb}),
      lens AS (SELECT DISTINCT length(v) AS l FROM (SELECT v FROM a UNION SELECT v FROM b)),
      ca AS (SELECT DISTINCT substr(v, i, l) AS s FROM (SELECT v, l, unnest(range(1, length(v) - l + 2)) AS i FROM a, lens WHERE l <= length(v))),
      cb AS (SELECT DISTINCT substr(v, i, l) AS s FROM (SELECT v, l, unnest(range(1, length(v) - l + 2)) AS i FROM b, lens WHERE l <= length(v))),
      s AS (SELECT round(greatest((SELECT count(*) FROM a WHERE v IN (SELECT s FROM cb)) / (SELECT count(*) FROM a), (SELECT count(*) FROM b WHERE v IN (SELECT s FROM ca)) / (SELECT count(*) FROM b)), 4) AS sub,
          round((SELECT count(*) FROM a WHERE v IN (SELECT v FROM b)) / (SELECT count(*) FROM a), 4) AS ov)"""


@query(
    "substring_rate",
    _CONTAINED.format(a="CAST(c_custkey AS VARCHAR)", ta="customer", b="s_name", tb="supplier") + " SELECT sub AS substring_match_rate FROM s",
)
def substring_rate(t):
    tables = discovery.Tables({"customer": t.customer.select("c_custkey"), "supplier": t.supplier.select("s_name")})
    return discovery.with_content(tables, discovery.column_pairs(tables)).select("substring_match_rate")


@query(
    "content_evidence",
    _CONTAINED.format(a="CAST(o_custkey AS VARCHAR)", ta="orders", b="CAST(c_custkey AS VARCHAR)", tb="customer")
    + " SELECT false AS format_match, ov AS overlap_rate, sub AS substring_match_rate, round(greatest(0.6 * ov + 0.4 * sub, 0.8 * sub), 4) AS content_score,"
    " round(greatest(0.6 * ov + 0.4 * sub, 0.8 * sub), 4) >= 0.5 AS promoted FROM s",
)
def content_evidence(t):
    tables = discovery.Tables({"orders": t.orders.select("o_custkey"), "customer": t.customer.select("c_custkey")})
    return discovery.with_content(tables, discovery.column_pairs(tables)).select(
        "format_match", "overlap_rate", "substring_match_rate", "content_score", "promoted"
    )


# -- candidates -----------------------------------------------------------------------------------


@query("candidate_ranking", sql.candidates_sql(["orders", "customer"]))
def candidate_ranking(t):
    return discovery.candidates(_tables(t, "orders", "customer")).select(sql.RESULT_COLUMNS)


@query("candidate_ranking_lines", sql.candidates_sql(["lineitem", "orders"]))
def candidate_ranking_lines(t):
    return discovery.candidates(_tables(t, "lineitem", "orders")).select(sql.RESULT_COLUMNS)


@query("candidate_evidence", sql.evidence_sql(["lineitem", "part"]))
def candidate_evidence(t):
    """The evidence texts of each candidate."""
    found = discovery.candidates(_tables(t, "lineitem", "part"))
    texts = [joined(F.col(c)).alias(c) for c in ("evidence_for", "evidence_against", "required_transformations")]
    return found.select("table_a", "column_a", "table_b", "column_b", "rank", *texts)


@query("key_decision", sql.decision_sql(["customer", "nation"]))
def key_decision(t):
    tables = _tables(t, "customer", "nation")
    best = discovery.decide(discovery.candidates(tables), tables.pairs())
    return best.select("table_a", "column_a", "table_b", "column_b", "confidence", "summary")


@query("compare_columns", sql.compare_sql(["customer", "nation"], "c_nationkey", "n_nationkey"))
def compare_columns(t):
    return discovery.compare_columns(_tables(t, "customer", "nation"), "c_nationkey", "n_nationkey").select(sql.COMPARE_COLUMNS)


@query("affinity", sql.affinity_sql(list(KEYS)))
def affinity(t):
    """Affinity of all table pairs, with the sizes of the tables."""
    found = discovery.affinity(_tables(t, *KEYS))
    counts = reduce(DataFrame.unionAll, [getattr(t, n).agg(F.count(F.lit(1)).alias("rows")).withColumn("t", F.lit(n)) for n in KEYS])
    for s in "ab":
        found = found.join(counts.select(F.col("t").alias(f"table_{s}"), F.col("rows").alias(f"rows_{s}")), f"table_{s}")
    return found


@query("map_tables", sql.candidates_sql(list(KEYS), by_affinity=True))
def map_tables(t):
    return discovery.map_tables(_tables(t, *KEYS)).select(sql.RESULT_COLUMNS)


@query("auto_pairs", sql.auto_pairs_sql(["customer", "supplier", "part"]))
def auto_pairs(t):
    return discovery.auto_pairs(_tables(t, "customer", "supplier", "part"))


_FORMS_SQL = r"""
    WITH a AS (SELECT regexp_replace(upper(trim(c_name)), '[.\-/\s]', '', 'g') AS v, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders),
      kinds(i, k) AS (VALUES (0, 'as_is'), (1, 'digits'), (2, 'no_leading_zeros'), (3, 'digits_no_leading_zeros'), (4, 'pad_6'), (5, 'pad_9'), (6, 'first_4'), (7, 'last_4'), (8, 'first_6'), (9, 'last_6')),
      fa AS (SELECT i, k, n, {form} AS f FROM a, kinds), fb AS (SELECT DISTINCT i, k, {form} AS f FROM b, kinds),
      met AS (SELECT fa.i AS i, fb.i AS j, fa.k AS transform_a, fb.k AS transform_b, CAST(sum(n) AS BIGINT) AS hits FROM fa JOIN fb ON fa.f = fb.f AND fa.f <> '' GROUP BY ALL)
    SELECT transform_a, transform_b, (SELECT count(c_name) FROM customer) AS rows_a, hits, hits / (SELECT count(c_name) FROM customer) AS match_rate,
      CAST(row_number() OVER (ORDER BY hits DESC, i + j, i) AS INTEGER) AS rank FROM met
    """.replace(
    "{form}",
    """CASE i WHEN 0 THEN v WHEN 1 THEN regexp_replace(v, '[^0-9]', '', 'g') WHEN 2 THEN regexp_replace(v, '^0+', '') WHEN 3 THEN regexp_replace(regexp_replace(v, '[^0-9]', '', 'g'), '^0+', '')
        WHEN 4 THEN CASE WHEN length(v) >= 6 THEN v ELSE lpad(v, 6, '0') END WHEN 5 THEN CASE WHEN length(v) >= 9 THEN v ELSE lpad(v, 9, '0') END
        WHEN 6 THEN CASE WHEN length(v) > 4 THEN left(v, 4) END WHEN 7 THEN CASE WHEN length(v) > 4 THEN right(v, 4) END
        WHEN 8 THEN CASE WHEN length(v) > 6 THEN left(v, 6) END WHEN 9 THEN CASE WHEN length(v) > 6 THEN right(v, 6) END END""",
)


@query("derived_key_search", _FORMS_SQL)
def derived_key_search(t):
    """Which transforms make customer names and customer numbers of orders one key."""
    return derived.derived_key_search(t.customer, "c_name", t.orders, "o_custkey")


@query(
    "derived_key_rate",
    r"""
    SELECT (SELECT count(*) FROM customer) AS rows_a, (SELECT count(*) FROM customer WHERE regexp_replace(upper(c_name), '[.\-/\s]', '', 'g') IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)) / (SELECT count(*) FROM customer) AS rate_before,
      (SELECT count(*) FROM customer WHERE regexp_replace(c_name, '\D', '', 'g') IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer)) / (SELECT count(*) FROM customer) AS rate_after
    """,
)
def derived_key_rate(t):
    return models.derived_key_rate(t.customer, "c_name", t.customer, "c_custkey", strings.digits, lambda c: strings.pad_left(c, 9))


@query(
    "derived_key_rate_by_year",
    """
    WITH a AS (SELECT year(o_orderdate) AS "by", 'O-' || o_orderkey AS k, o_orderkey FROM orders), b AS (SELECT DISTINCT year(l_shipdate) AS y, CAST(l_orderkey AS VARCHAR) AS v FROM lineitem)
    SELECT "by", count(*) AS rows_a, 0.0::DOUBLE AS rate_before, count(v) / count(*) AS rate_after FROM a LEFT JOIN b ON "by" = y AND CAST(o_orderkey AS VARCHAR) = v GROUP BY 1
    """,
)
def derived_key_rate_by_year(t):
    year = lambda c: F.year(c).cast("bigint")
    a = t.orders.select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("code"), "o_orderdate")
    return models.derived_key_rate(
        a, "code", t.lineitem, "l_orderkey", strings.digits, by_a=year("o_orderdate"), by_b=year("l_shipdate")
    )
