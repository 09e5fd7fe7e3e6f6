"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.catalogue.discovery_sql import match_form, ratio_ctes
from keyloom.catalogue.registry import query
from keyloom.functions import names, numbers, similarity, strings
from keyloom.functions.vocabulary import BUILTIN_PATTERNS
from keyloom.operators.profile import patterns_compatible


@query(
    "name_forms",
    r"""
    SELECT page_id,
      regexp_replace(trim(lower(url)), '[^a-z0-9_]', '_', 'g') AS staged,
      trim(regexp_replace(regexp_replace(trim(lower(url)), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_') AS matched,
      regexp_replace(trim(lower(url)), '[^a-z0-9]', '_', 'g') AS coverage,
      CASE WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END AS slug
    FROM (SELECT *, regexp_replace(regexp_replace(lower(substr(url, 12)), '[ -]+', '_', 'g'), '[^a-z0-9_]+', '', 'g') AS s FROM pages)
    """,
)
def name_forms(t):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        names.name_form_col(url, "staged").alias("staged"),
        names.name_form_col(url, "match").alias("matched"),
        names.name_form_col(url, "coverage").alias("coverage"),
        names.name_form_col(F.substr(url, F.lit(12)), "slug").alias("slug"),
    )


@query(
    "normalize_values",
    r"""
    SELECT c_custkey, regexp_replace(upper(trim(c_name)), '[.\-/\s]', '', 'g') AS name_form,
      trim(CAST(c_custkey AS VARCHAR)) AS key_form,
      regexp_replace(upper(trim(' ' || c_mktsegment || ' - ' || c_name || '/1.5 ')), '[.\-/\s]', '', 'g') AS mixed_form
    FROM customer
    """,
)
def normalize_values(t):
    df = t.customer
    form = lambda c: strings.match_text(F.col(c), df.schema[c].dataType)
    mixed = F.concat(F.lit(" "), "c_mktsegment", F.lit(" - "), "c_name", F.lit("/1.5 "))
    return df.select(
        "c_custkey", form("c_name").alias("name_form"), form("c_custkey").alias("key_form"), strings.normalize_text(mixed).alias("mixed_form")
    )


@query(
    "pad_left",
    """
    SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS padded,
      CASE WHEN length(s) >= 4 THEN s WHEN s LIKE '-%' THEN '-' || lpad(substr(s, 2), 3, '0') ELSE lpad(s, 4, '0') END AS signed,
      c_name AS untouched
    FROM (SELECT *, CAST(c_nationkey - 12 AS VARCHAR) AS s FROM customer)
    """,
)
def pad_left(t):
    return t.customer.select(
        "c_custkey",
        strings.pad_left(F.col("c_custkey"), 6).alias("padded"),
        strings.pad_left(F.col("c_nationkey") - 12, 4).alias("signed"),
        strings.pad_left(F.col("c_name"), 6).alias("untouched"),
    )


@query(
    "strip_zeros",
    r"""SELECT c_custkey, regexp_replace(regexp_replace(c_name, '\D', '', 'g'), '^0+', '') AS stripped FROM customer""",
)
def strip_zeros(t):
    return t.customer.select("c_custkey", strings.strip_zeros(strings.digits(F.col("c_name"))).alias("stripped"))


@query(
    "digits",
    r"""SELECT p_partkey, regexp_replace(p_brand, '\D', '', 'g') AS brand_digits FROM part""",
)
def digits(t):
    return t.part.select("p_partkey", strings.digits(F.col("p_brand")).alias("brand_digits"))


@query(
    "concat_columns",
    """
    SELECT p_partkey, concat_ws('|', p_brand, CAST(p_size AS VARCHAR), coalesce(nullif(p_type, 'ECONOMY'), 'nan')) AS with_text,
      concat_ws('|', p_brand, CAST(p_size AS VARCHAR), nullif(p_type, 'ECONOMY')) AS without_null
    FROM part
    """,
)
def concat_columns(t):
    cols = [F.col("p_brand"), F.col("p_size"), F.nullif("p_type", F.lit("ECONOMY"))]
    return t.part.select(
        "p_partkey",
        strings.concat_columns(cols, "|").alias("with_text"),
        strings.concat_columns(cols, "|", null_text=None).alias("without_null"),
    )


@query(
    "surrogate_key",
    """
    SELECT l_orderkey, l_linenumber,
      md5(concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), coalesce(nullif(l_returnflag, 'N'), '_dbt_utils_surrogate_key_null_'))) AS row_key,
      md5(concat_ws('-', CAST(l_orderkey AS VARCHAR), coalesce(nullif(l_returnflag, 'N'), ''))) AS old_key
    FROM lineitem
    """,
)
def surrogate_key(t):
    flag = F.nullif("l_returnflag", F.lit("N"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        strings.surrogate_key([F.col("l_orderkey"), F.col("l_linenumber"), flag]).alias("row_key"),
        strings.surrogate_key([F.col("l_orderkey"), flag], null_text="").alias("old_key"),
    )


@query(
    "url_host",
    """
    SELECT page_id, split_part(split_part(replace(replace(replace(url, 'android-app://', ''), 'http://', ''), 'https://', ''), '/', 1), '?', 1) AS host
    FROM pages
    """,
)
def url_host(t):
    return t.pages.select("page_id", strings.url_host(F.col("url")).alias("host"))


@query(
    "url_path",
    """
    SELECT page_id,
      split_part(substr(u, coalesce(nullif(strpos(u, '/'), 0), strpos(u, '?') - 1) + 1), '?', 1) AS path,
      CASE WHEN strpos(u, '?') > 0 THEN '' ELSE split_part(u, '/', 1) END AS bare_path
    FROM (SELECT page_id, replace(replace(url, 'http://', ''), 'https://', '') AS u FROM pages)
    """,
)
def url_path(t):
    url = F.col("url")
    # the same addresses without a path: a bare host, or a host with a query only
    bare = F.concat(strings.url_host(url), F.when(F.contains(url, F.lit("?")), F.lit("?q=1")).otherwise(F.lit("")))
    return t.pages.select("page_id", strings.url_path(url).alias("path"), strings.url_path(bare).alias("bare_path"))


@query(
    "url_parameter",
    """
    SELECT page_id, nullif(split_part(split_part(url, 'page=', 2), '&', 1), '') AS page,
      nullif(split_part(split_part(url, 'ref=', 2), '&', 1), '') AS ref
    FROM pages
    """,
)
def url_parameter(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", strings.url_parameter(url, "page").alias("page"), strings.url_parameter(url, "ref").alias("ref")
    )


@query(
    "pattern_of_value",
    r"""
    SELECT o_orderkey, CASE WHEN regexp_matches(v, '^\d{4}NE\d{6}$') THEN 'empenho' WHEN regexp_matches(v, '^\d{6}/\d{4}$') THEN 'convenio'
      WHEN regexp_matches(v, '^\d{5}$') THEN 'orgao' WHEN regexp_matches(v, '^\d{4}$') THEN 'exercicio' END AS pattern
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey AS VARCHAR)
        WHEN 'O' THEN CAST(year(o_orderdate) AS VARCHAR) || 'NE' || lpad(CAST(o_custkey AS VARCHAR), 6, '0')
        ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '/' || CAST(year(o_orderdate) AS VARCHAR) END AS v FROM orders)
    """,
)
def pattern_of_value(t):
    year = F.year("o_orderdate").cast("string")
    code = strings.pad_left(F.col("o_custkey"), 6)
    v = (
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))
        .when(F.col("o_orderstatus") == "O", F.concat(year, F.lit("NE"), code))
        .otherwise(F.concat(code, F.lit("/"), year))
    )
    return t.orders.select("o_orderkey", strings.any_match(v, BUILTIN_PATTERNS).alias("pattern"))


@query(
    "patterns_compatible",
    """
    SELECT o_orderkey, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN pa = pb ELSE abs(la - lb) <= 2 END AS compatible
    FROM (SELECT o_orderkey, CASE length(a) WHEN 5 THEN 'orgao' WHEN 4 THEN 'exercicio' END AS pa,
            CASE length(b) WHEN 5 THEN 'orgao' WHEN 4 THEN 'exercicio' END AS pb, length(a) AS la, length(b) AS lb
          FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders))
    """,
)
def patterns_compat(t):
    a, b = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey"))
    best = lambda v: strings.any_match(v, BUILTIN_PATTERNS)
    ok = patterns_compatible(best(a), best(b), F.length(a).cast("double"), F.length(b).cast("double"))
    return t.orders.select("o_orderkey", ok.alias("compatible"))


@query(
    "structured_identifier",
    """
    SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS unit, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS management,
      CAST(year(o_orderdate) AS VARCHAR) AS year, 'NE' AS kind, lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS sequence,
      CAST(year(o_orderdate) AS VARCHAR) || 'NE' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS short_form, true AS rebuilt
    FROM orders
    """,
)
def structured_identifier(t):
    short = F.concat(F.year("o_orderdate").cast("string"), F.lit("NE"), strings.pad_left(F.col("o_orderkey") % 1000000, 6))
    long = strings.extend_identifier(short, F.col("o_custkey"), F.col("o_orderkey") % 100000)
    df = t.orders.select("o_orderkey", long.alias("id"), "o_custkey")
    parts = df.select("o_orderkey", "id", strings.parse_identifier(F.col("id")).alias("p"), strings.shorten_identifier(F.col("id")).alias("short_form"))
    again = strings.extend_identifier(F.col("short_form"), F.col("p.unit"), F.col("p.management"))
    return parts.select("o_orderkey", "p.*", "short_form", (again == F.col("id")).alias("rebuilt"))



def _lines(t):
    tax, discount = (F.nullif(c, F.lit(0.0)) for c in ("l_tax", "l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", tax.alias("tax"), discount.alias("discount"))


@query(
    "safe_add",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + coalesce(nullif(l_tax, 0), 0) + coalesce(nullif(l_discount, 0), 0) AS total FROM lineitem",
)
def safe_add(t):
    total = numbers.safe_add([F.col("l_quantity"), F.col("tax"), F.col("discount")])
    return _lines(t).select("l_orderkey", "l_linenumber", "l_partkey", total.alias("total"))


@query(
    "safe_subtract",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - coalesce(nullif(l_tax, 0), 0) - coalesce(nullif(l_discount, 0), 0) AS rest FROM lineitem",
)
def safe_subtract(t):
    rest = numbers.safe_subtract([F.col("l_quantity"), F.col("tax"), F.col("discount")])
    return _lines(t).select("l_orderkey", "l_linenumber", "l_partkey", rest.alias("rest"))


@query(
    "safe_divide",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem",
)
def safe_divide(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio")
    )


@query(
    "width_bucket",
    """
    SELECT CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity >= 40 THEN 7 ELSE floor((l_quantity - 10) / 5) + 1 END AS BIGINT) AS bucket,
      count(*) AS n, min(l_quantity) AS lowest, max(l_quantity) AS highest
    FROM lineitem GROUP BY 1
    """,
)
def width_bucket(t):
    bucket = numbers.width_bucket(F.col("l_quantity"), F.lit(10), F.lit(40), F.lit(6))
    return t.lineitem.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lowest"), F.max("l_quantity").alias("highest")
    )


@query(
    "haversine",
    """
    WITH p AS (SELECT c_custkey, radians(c_nationkey * 3.0 - 36) AS a1, radians(c_acctbal / 100) AS o1,
        radians(36 - c_nationkey * 2.0) AS a2, radians(CAST(c_custkey % 180 AS DOUBLE)) AS o2 FROM customer),
      d AS (SELECT c_custkey, 2 * 3961.0 * asin(sqrt(pow(sin((a2 - a1) / 2), 2) + cos(a1) * cos(a2) * pow(sin((o2 - o1) / 2), 2))) AS mi FROM p)
    SELECT c_custkey, round(mi, 3) AS miles, round(mi * 1.60934, 3) AS km FROM d
    """,
)
def haversine(t):
    at = (
        F.col("c_nationkey") * 3.0 - 36,
        F.col("c_acctbal") / 100,
        36 - F.col("c_nationkey") * 2.0,
        (F.col("c_custkey") % 180).cast("double"),
    )
    return t.customer.select(
        "c_custkey", F.round(numbers.haversine(*at), 3).alias("miles"), F.round(numbers.haversine(*at, unit="km"), 3).alias("km")
    )


@query(
    "date_arithmetic",
    """
    SELECT event_id, ts + INTERVAL 1 MONTH AS next_month, ts - INTERVAL 36 HOUR AS earlier, date_trunc('week', ts) AS week,
      date_diff('day', ts, ts + INTERVAL 36 HOUR) AS days, date_diff('month', ts, ts + INTERVAL 40 DAY) AS months
    FROM events
    """,
)
def date_arithmetic(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        numbers.date_add("month", 1, ts).alias("next_month"),
        numbers.date_add("hour", -36, ts).alias("earlier"),
        numbers.date_trunc("week", ts).cast("timestamp_ntz").alias("week"),
        numbers.date_diff("day", ts, numbers.date_add("hour", 36, ts)).alias("days"),
        numbers.date_diff("month", ts, numbers.date_add("day", 40, ts)).alias("months"),
    )


@query(
    "name_similarity",
    f"""
    WITH RECURSIVE pairs AS (SELECT DISTINCT p_name, p_type, {match_form('p_name')} AS x, {match_form('p_type')} AS y FROM part),
    {ratio_ctes('pairs')}
    SELECT p_name, p_type, ratio AS similarity, CASE WHEN split_part(p_name, ' ', 1) = lower(substr(p_type, 1, 5)) THEN greatest(ratio, 0.75) ELSE ratio END AS semantic
    FROM pairs JOIN ratios USING (x, y)
    """,
)
def name_similarity(t):
    """Ratcliff-Obershelp ratios of part names and types."""
    pairs = t.part.select("p_name", "p_type").distinct()
    ratio = similarity.name_similarity(F.col("p_name"), F.col("p_type"))
    scored = pairs.withColumn("similarity", ratio)
    group = F.split_part("p_name", F.lit(" "), F.lit(1))
    semantic = similarity.semantic_score(F.col("similarity"), group, F.lower(F.substring("p_type", 1, 5)))
    return scored.withColumn("semantic", semantic)


@query(
    "type_compatibility",
    """
    SELECT family_a, family_b, count(*) AS n,
      bool_or(family_a = family_b OR (family_a, family_b) IN (('object','category'), ('int64','int32'), ('int64','float64'), ('int64','object'),
        ('float64','int64'), ('float64','object'), ('category','object'))) AS compatible
    FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'int64' WHEN 'N' THEN 'float64' ELSE 'object' END AS family_a,
        CASE l_linenumber % 4 WHEN 0 THEN 'int64' WHEN 1 THEN 'object' WHEN 2 THEN 'category' ELSE 'float64' END AS family_b FROM lineitem)
    GROUP BY 1, 2
    """,
)
def type_compatibility(t):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber") % 4
    a = F.when(flag == "A", "int64").when(flag == "N", "float64").otherwise("object")
    b = F.when(line == 0, "int64").when(line == 1, "object").when(line == 2, "category").otherwise("float64")
    counted = t.lineitem.groupBy(a.alias("family_a"), b.alias("family_b")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("compatible", similarity.types_compatible(F.col("family_a"), F.col("family_b")))


@query(
    "cardinality_labels",
    """
    SELECT user_id, CASE WHEN u > 0.95 THEN 'high (near-unique)' WHEN u > 0.5 THEN 'medium' ELSE 'low (repetitive)' END AS label
    FROM (SELECT user_id, count(DISTINCT CAST(value AS INTEGER)) / count(*) AS u FROM events GROUP BY 1)
    """,
)
def cardinality_labels(t):
    share = F.count_distinct(F.round("value").cast("int")) / F.count(F.lit(1))
    per_user = t.events.groupBy("user_id").agg(share.alias("u"))
    return per_user.select("user_id", similarity.cardinality_label(F.col("u")).alias("label"))
