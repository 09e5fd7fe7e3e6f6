"""Queries over keyed merges, incremental loads, streaming and the context tables.

Targets, updates and discoveries are derived from the given tables, so they grow with them.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from keyloom.catalogue.discovery import GROUP_SQL, SHADES
from keyloom.catalogue.discovery_sql import decision_sql
from keyloom.catalogue.registry import query
from keyloom.operators import merge
from keyloom.sources import context, keyed
from keyloom.session import scratch_dir
from keyloom.streaming.incremental import stream_merge

# -- merges -------------------------------------------------------------------------------------


def _split_events(t):
    """Per-user state before noon of day two, and everything that has come in by then."""
    df = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    cut = F.lit("2024-01-04 12:00:00").cast("timestamp_ntz")
    return df, df.where(F.col("ts") <= cut)


_LAST = """(SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r
    FROM events WHERE {w}) WHERE r = 1)"""
_CUT = "TIMESTAMP '2024-01-04 12:00:00'"


def _latest(df):
    from keyloom.operators.relational import latest_per_key

    return latest_per_key(df, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")])


@query(
    "incremental_merge",
    f"""
    WITH old AS {_LAST.format(w=f"ts <= {_CUT}")}, new AS {_LAST.format(w=f"ts > (SELECT max(ts) FROM events WHERE ts <= {_CUT})")}
    SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.user_id = old.user_id AND new.event_type = old.event_type) UNION ALL SELECT * FROM new
    """,
)
def incremental_merge(t):
    everything, before = _split_events(t)
    order = [F.col("ts").desc(), F.col("event_id")]
    return merge.incremental_merge(everything, _latest(before), ["user_id", "event_type"], "ts", order)


@query(
    "incremental_first_run",
    "SELECT user_id, event_type, event_id, ts, value FROM events",
)
def incremental_first_run(t):
    everything, _ = _split_events(t)
    return merge.incremental_merge(everything, None, ["user_id", "event_type"], "ts")


@query(
    "incremental_lookback",
    f"SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts <= {_CUT}) - INTERVAL 1 DAY",
)
def incremental_lookback(t):
    everything, before = _split_events(t)
    return merge.newer_rows(everything, before, "ts", timedelta(days=1)).select("event_id", "ts")


@query(
    "schema_sync",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority FROM orders
    """,
)
def schema_sync(t):
    """The target lacks a column the source has gained and holds one it has dropped."""
    target = t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice")
    updates = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    return merge.merge_latest(target, updates, ["o_orderkey"])


@query(
    "merge_latest",
    """
    WITH u AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1, 2),
      s AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2)
    SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.l_orderkey = s.l_orderkey AND u.l_linenumber = s.l_linenumber) UNION ALL SELECT * FROM u
    """,
)
def merge_latest(t):
    """Upsert by a composite key; several updates for one key leave the largest."""
    old = t.lineitem.where("l_shipdate < timestamp_ntz '1999-01-01'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    new = t.lineitem.where("l_shipdate >= timestamp_ntz '1999-01-01'").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    return merge.merge_latest(old, new, ["l_orderkey", "l_linenumber"], [F.col("q").desc()])


@query(
    "partitioned_merge",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) >= 1999 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, year(o_orderdate) AS ano FROM orders
    """,
)
def partitioned_merge(t):
    """Upsert that rewrites only the years it touches."""
    path = scratch_dir(t.spark, "partitioned")
    year = F.year("o_orderdate").cast("bigint").alias("ano")
    # rows of a year spread over several files when there are many
    t.orders.select("o_orderkey", "o_orderpriority", year).write.partitionBy("ano").parquet(path)
    changes = t.orders.where("o_orderstatus = 'F' AND year(o_orderdate) >= 1999").select("o_orderkey", F.lit("changed").alias("o_orderpriority"), year)
    merge.merge_touched_partitions(path, changes, ["o_orderkey", "ano"], "ano")
    return t.spark.read.schema("o_orderkey bigint, o_orderpriority string, ano bigint").parquet(path)


@query(
    "keyed_merge",
    """
    SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders
    """,
)
def keyed_merge(t):
    """Two incremental loads into a bucketed table: all orders of earlier months, then the last month's, by the recorded mark."""
    table = keyed.KeyedTable(t.spark, scratch_dir(t.spark, "keyed"), ["o_orderkey"], buckets=32)
    table.load_newer(t.orders.where("o_orderdate < timestamp_ntz '2001-07-01'").select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderdate")
    late = F.when(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz"), "changed").otherwise("not newer")
    table.load_newer(t.orders.select("o_orderkey", late.alias("o_orderpriority"), "o_orderdate"), "o_orderdate")
    return table.read()


@query(
    "append_copy",
    "SELECT 'first' AS load, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    "SELECT 'second', count(*), count(DISTINCT o_orderkey) FROM orders WHERE o_orderstatus <> 'P'",
)
def append_copy(t):
    """Append-only copies without a key: the second load repeats rows of the first."""
    path = scratch_dir(t.spark, "append")
    for load, condition in (("first", "o_orderstatus = 'F'"), ("second", "o_orderstatus <> 'P'")):
        keyed.append_copy(t.orders.where(condition).withColumn("load", F.lit(load)), path)
    copied = t.spark.read.parquet(path)
    return copied.groupBy("load").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("orders"))


@query(
    "streaming_merge",
    f"""
    SELECT user_id, event_type, event_id, ts, value FROM {_LAST.format(w='1 = 1')}
    """,
)
def streaming_merge(t):
    """Landed files in, bucketed table out, through a stream that stops once all is read."""
    root = scratch_dir(t.spark, "stream")
    everything, before = _split_events(t)
    cut = F.lit("2024-01-04 12:00:00").cast("timestamp_ntz")
    table = keyed.KeyedTable(t.spark, f"{root}/staged", ["user_id", "event_type"], buckets=16)
    order = [F.col("ts").desc(), F.col("event_id")]
    # two landings, one stream run after each
    for landed in (before, everything.where(F.col("ts") > cut)):
        landed.write.mode("append").parquet(f"{root}/raw")
        stream_merge(
            t.spark, f"{root}/raw", everything.schema, table, ["user_id", "event_type"], "ts", f"{root}/checkpoint", order
        ).awaitTermination()
    return table.read()


# -- context tables --------------------------------------------------------------------------------

_FOUND_SQL = """
    SELECT 'cust_' || o_custkey AS table_a, o_orderstatus AS column_a, 'prio_' || substr(o_orderpriority, 1, 1) AS table_b, 'year_' || year(o_orderdate) AS column_b,
      floor(max(o_totalprice) / 50) / 10000 AS confidence, CASE min(o_orderkey) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_validated
    FROM orders GROUP BY 1, 2, 3, 4"""


def _found(t):
    """Discovery rows derived from the orders, in the shape of the stored table."""
    year = F.concat(F.lit("year_"), F.year("o_orderdate").cast("string"))
    keys = t.orders.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("table_a"),
        F.col("o_orderstatus").alias("column_a"),
        F.concat(F.lit("prio_"), F.substring("o_orderpriority", 1, 1)).alias("table_b"),
        year.alias("column_b"),
        "o_totalprice",
        "o_orderkey",
    )
    state = F.min("o_orderkey") % 3
    rows = keys.groupBy("table_a", "column_a", "table_b", "column_b").agg(
        (F.floor(F.max("o_totalprice") / 50) / 10000).alias("confidence"),
        F.when(state == 0, True).when(state == 1, False).alias("is_validated"),
    )
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = F.array().cast("array<string>")
    return rows.select(
        "table_a", "column_a", "table_b", "column_b", "confidence",
        F.lit("semantic").alias("discovery_method"), F.lit(None).cast("string").alias("justification"),
        empty.alias("evidence_for"), empty.alias("evidence_against"), empty.alias("required_transforms"),
        "is_validated", stamp.alias("discovered_at"), F.lit(None).cast("timestamp").alias("last_confirmed_at"),
    )


@query(
    "merge_greatest",
    f"""
    WITH old AS ({_FOUND_SQL}), new AS (SELECT table_a, column_a, table_b, 'year_1999' AS column_b, round(1 - max(confidence), 4) AS confidence FROM old GROUP BY 1, 2, 3)
    SELECT coalesce(o.table_a, n.table_a) AS table_a, coalesce(o.column_a, n.column_a) AS column_a, coalesce(o.table_b, n.table_b) AS table_b, coalesce(o.column_b, n.column_b) AS column_b,
      CASE WHEN o.table_a IS NULL THEN n.confidence WHEN n.table_a IS NULL THEN o.confidence ELSE greatest(o.confidence, n.confidence) END AS confidence,
      CASE WHEN n.table_a IS NULL THEN 'semantic' ELSE 'content' END AS discovery_method, o.is_validated, o.table_a IS NOT NULL AND n.table_a IS NOT NULL AS confirmed
    FROM old o FULL JOIN new n ON o.table_a = n.table_a AND o.column_a = n.column_a AND o.table_b = n.table_b AND o.column_b = n.column_b
    """,
)
def merge_greatest(t):
    old = _found(t)
    again = old.groupBy("table_a", "column_a", "table_b").agg(F.round(1 - F.max("confidence"), 4).alias("confidence")).select(
        "table_a", "column_a", "table_b", F.lit("year_1999").alias("column_b"), "confidence", F.lit("content").alias("discovery_method")
    )
    merged = context.upsert_discoveries(old, again, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return merged.select(
        "table_a", "column_a", "table_b", "column_b", "confidence", "discovery_method", "is_validated",
        F.col("last_confirmed_at").isNotNull().alias("confirmed"),
    )


@query(
    "discoveries_for_table",
    f"SELECT table_a, column_a, table_b, column_b, confidence FROM ({_FOUND_SQL}) WHERE (table_a = 'prio_1' OR table_b = 'prio_1') AND confidence >= 0.7 AND is_validated IS DISTINCT FROM false",
)
def discoveries_for_table(t):
    return context.discoveries_of(_found(t), "prio_1").select("table_a", "column_a", "table_b", "column_b", "confidence")


@query(
    "review_discoveries",
    f"""
    SELECT table_a, column_a, table_b, column_b, CASE WHEN column_b = 'year_1998' THEN confidence > 0.5 ELSE is_validated END AS is_validated, column_b = 'year_1998' AS stamped FROM ({_FOUND_SQL})
    """,
)
def review_discoveries(t):
    found = _found(t)
    keys = context.KEYS["integration_discoveries"]
    decisions = found.where("column_b = 'year_1998'").select(*keys, (F.col("confidence") > 0.5).alias("is_valid"))
    done = context.review(found, decisions, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return done.select(*keys, "is_validated", F.col("last_confirmed_at").isNotNull().alias("stamped"))


@query(
    "model_gate",
    f"""
    WITH d AS ({_FOUND_SQL})
    SELECT 'cust_' || c_custkey AS package, CASE WHEN EXISTS (SELECT 1 FROM d WHERE (table_a = 'cust_' || c_custkey OR table_b = 'cust_' || c_custkey)
      AND confidence >= 0.9 AND is_validated IS DISTINCT FROM false) THEN 'models/' ELSE 'models/bronze/' END AS selected FROM customer
    """,
)
def model_gate(t):
    packages = t.customer.select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("package"))
    return context.gate(packages, _found(t), 0.9)


@query(
    "stored_annotations",
    """
    SELECT 'parts' AS table_name, p_name AS column_name, CASE WHEN contains(p_name, 'ring') THEN 'ringed' END AS domain_group, 2 AS writes FROM (SELECT DISTINCT p_name FROM part)
    """,
)
def stored_annotations(t):
    """Annotations written twice: the second write wins and leaves one row per name."""
    store = context.ContextStore(t.spark, scratch_dir(t.spark, "context"))
    names = t.part.select(F.lit("parts").alias("table_name"), F.col("p_name").alias("column_name")).distinct()
    tags = F.lit(None).cast("array<string>")
    store.put_annotations(names.withColumn("domain_group", SHADES.group_of(F.col("column_name"))).withColumn("semantic_tags", tags))
    ringed = F.when(F.contains("column_name", F.lit("ring")), "ringed")
    store.put_annotations(names.withColumn("domain_group", ringed).withColumn("semantic_tags", tags))
    writes = len(store.tables["column_annotations"].versions())
    return store.annotations("parts").select("table_name", "column_name", "domain_group", F.lit(writes).alias("writes"))


@query(
    "annotated_names",
    f"SELECT p_brand AS table_name, p_name AS column_name, {GROUP_SQL} AS domain_group FROM (SELECT DISTINCT p_brand, p_name, replace(lower(p_name), ' ', '_') AS n FROM part)",
)
def annotated_names(t):
    """Every name of a catalogue annotated, those without a group included, and stored."""
    store = context.ContextStore(t.spark, scratch_dir(t.spark, "context"))
    names = t.part.select(F.col("p_brand").alias("table_name"), F.col("p_name").alias("column_name")).distinct()
    store.put_annotations(context.annotate_names(names, SHADES))
    return store.read("column_annotations").select("table_name", "column_name", "domain_group")


@query(
    "stored_profiles",
    """
    SELECT 'orders' AS table_name, count(*) AS row_count, true AS quality_ok, count(DISTINCT o_custkey) AS customers FROM orders
    UNION ALL SELECT 'customer', count(*), true, count(DISTINCT c_custkey) FROM customer
    """,
)
def stored_profiles(t):
    from keyloom.operators.profile import table_profile

    store = context.ContextStore(t.spark, scratch_dir(t.spark, "context"))
    for name in ("orders", "customer", "orders"):
        store.put_profile(table_profile(getattr(t, name), name))
    customers = F.coalesce(F.try_element_at("cardinality_per_col", F.lit("o_custkey")), F.try_element_at("cardinality_per_col", F.lit("c_custkey")))
    both = store.profile("orders").unionAll(store.profile("customer"))
    return both.select("table_name", "row_count", "quality_ok", customers.alias("customers"))


@query(
    "united_profiles",
    """
    SELECT column_name, n AS row_count, nulls AS null_rate, true AS close FROM (
      SELECT 'l_partkey' AS column_name, count(*) AS n, 0.0::DOUBLE AS nulls FROM lineitem UNION ALL SELECT 'l_quantity', count(*), 0.0 FROM lineitem
      UNION ALL SELECT 'flag', count(*), round(1 - count(nullif(l_returnflag, 'A')) / count(*), 12) FROM lineitem)
    """,
)
def united_profiles(t):
    """Lines loaded year by year, sketched load by load; distinct counts within 3 % of the exact ones."""
    from keyloom.operators.profile import column_profile
    from keyloom.operators.sketches import StoredSketches

    year = F.year("l_shipdate")
    lines = t.lineitem.select("l_partkey", "l_quantity", F.nullif("l_returnflag", F.lit("A")).alias("flag"), year.alias("year"))
    store = StoredSketches(t.spark, scratch_dir(t.spark, "sketches"))
    for r in lines.select("year").distinct().orderBy("year").collect():  # one load a year
        store.add(str(r["year"]), lines.where(F.col("year") == r["year"]).drop("year"))
    exact = column_profile(lines.drop("year")).select("column_name", F.col("unique_count").alias("exact"))
    united = store.profile().join(exact, "column_name")
    close = F.abs(F.col("unique_count") - F.col("exact")) <= 0.03 * F.col("exact")
    return united.select("column_name", "row_count", F.round("null_rate", 12).alias("null_rate"), close.alias("close"))


@query(
    "stored_discoveries",
    f"SELECT table_a, column_a, table_b, column_b, confidence FROM ({_FOUND_SQL}) WHERE table_b = 'prio_2' AND confidence >= 0.8",
)
def stored_discoveries(t):
    """Discoveries through the store: written, confirmed again at half the confidence, read."""
    store = context.ContextStore(t.spark, scratch_dir(t.spark, "context"))
    rows = _found(t).drop("is_validated", "discovered_at", "last_confirmed_at")
    store.put_discoveries(rows)
    store.put_discoveries(rows.withColumn("confidence", F.col("confidence") / 2))
    return store.discoveries("prio_2", 0.8).select("table_a", "column_a", "table_b", "column_b", "confidence")


@query(
    "persisted_key",
    f"SELECT table_a, column_a, table_b, column_b, confidence, 'semantic+content' AS discovery_method FROM ({decision_sql(['orders', 'customer'])}) WHERE confidence >= 0.7",
)
def persisted_key(t):
    """The decided key of two tables, kept as a discovery and read back."""
    from keyloom.catalogue.discovery import _tables
    from keyloom.plans import discovery

    tables = _tables(t, "orders", "customer")
    best = discovery.decide(discovery.candidates(tables), tables.pairs())
    store = context.ContextStore(t.spark, scratch_dir(t.spark, "context"))
    store.put_discoveries(context.best_as_discovery(best))
    found = store.discoveries("orders")
    return found.select("table_a", "column_a", "table_b", "column_b", "confidence", "discovery_method")
