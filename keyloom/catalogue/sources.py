"""Queries over sources and sinks.

Each writes one of the given tables whole to the shared scratch folder in the source's
format and reads it back, so the work grows with the table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from keyloom.catalogue.discovery_sql import decision_sql
from keyloom.catalogue.registry import query
from keyloom.operators.relational import union_relations
from keyloom.plans import discovery
from keyloom.session import scratch_dir
from keyloom.sources import artefacts, delimited, pages, zones

_DAY = date(2024, 1, 31)


def _landed_csv(t, header=True, **options):
    path = scratch_dir(t.spark, "csv")
    t.customer.select("c_custkey", F.expr("substr(c_name, 10)").alias("code"), "c_mktsegment", "c_nationkey").write.csv(
        path, sep=";", header=header, **options
    )
    return path


@query(
    "delimited_text",
    "SELECT substr(c_name, 10) AS code, CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer",
)
def delimited_text(t):
    """Zero-padded codes keep their zeros; one column is cast on request."""
    return delimited.read_delimited(
        t.spark, _landed_csv(t), sep=";", columns=["code", "c_custkey", "not_there", "c_nationkey"], types={"c_nationkey": "bigint"}
    )


@query(
    "delimited_preamble",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, substr(c_name, 10) AS code, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer",
)
def delimited_preamble(t):
    """Every file starts with two comment lines and a header line."""
    path = scratch_dir(t.spark, "preamble")
    cells = F.concat_ws(";", F.col("c_custkey").cast("string"), F.expr("substr(c_name, 10)"), "c_mktsegment", F.col("c_nationkey").cast("string"))
    top = ["# extract", "# two lines", "c_custkey;code;c_mktsegment;c_nationkey"]
    # one file per 100,000 customers: its preamble, then its rows
    part = F.floor(F.col("c_custkey") / 100_000).alias("part")
    lines = t.customer.select(part, F.lit(len(top)).alias("o"), cells.alias("value"))
    heads = t.customer.select(part).distinct().select("part", F.posexplode(F.array(*[F.lit(x) for x in top])).alias("o", "value"))
    ordered = heads.unionAll(lines).repartition("part").sortWithinPartitions("part", "o")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    return delimited.read_delimited(t.spark, f"{path}/part=*", sep=";", skip_rows=2)


@query("delimited_quoted", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents")
def delimited_quoted(t):
    """Texts with line breaks, separators and quotes, in quoted cells below a line of comment."""
    path = scratch_dir(t.spark, "quoted")
    docs = t.documents.select("doc_id", "text", "source")
    as_written = {"sep": ",", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.csv(path, header=True, **as_written)
    return delimited.read_delimited(t.spark, path, types={"source": "string"})


@query(
    "delimited_mixed_headers",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority,
      CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS VARCHAR) END AS "Unnamed: 1" FROM orders
    """,
)
def delimited_mixed_headers(t):
    """One folder, files of two kinds: other columns, another order, and a header cell left empty."""
    path = scratch_dir(t.spark, "mixed")
    t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.csv(f"{path}/a", sep=";", header=True)
    # Spark writes no empty header cell: the header is the first line of each file
    part = F.spark_partition_id()
    body = t.orders.where("o_orderstatus <> 'F'").select(part.alias("part"), F.lit(1).alias("o"), F.concat_ws(";", "o_orderstatus", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("value"))
    heads = body.select("part").distinct().select("part", F.lit(0).alias("o"), F.lit("o_orderstatus;;o_orderkey").alias("value"))
    lines = heads.unionAll(body).repartition("part").sortWithinPartitions("part", "o")
    lines.select("part", "value").write.partitionBy("part").text(f"{path}/b")
    return delimited.read_delimited(t.spark, f"{path}/a,{path}/b/part=*".split(","), sep=";")


@query(
    "compressed_dump",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer",
)
def compressed_dump(t):
    path = _landed_csv(t, compression="gzip")
    return delimited.read_source(
        t.spark, {"type": "dump", "format": "csv_gz", "file_path": path, "separator": ";", "columns": ["c_custkey", "c_mktsegment"]}
    )


def _landed_pages(t):
    """Response pages, one a line, of three shapes: a list of records, a single record, no records at all."""
    path = scratch_dir(t.spark, "pages")
    record = F.struct("event_id", "user_id", "event_type")
    n_pages = F.lit(t.events.agg((F.floor(F.max("event_id") / 100) + 1).cast("bigint")).head()[0])
    page = (F.floor(F.col("event_id") / 100) + 1).cast("bigint")
    shown = lambda data: F.to_json(F.struct(*data, "page", (F.col("page") < n_pages).alias("hasNext"))).alias("value")
    # a page is at most 100 records; its first one landed on a page of its own
    first = F.col("event_id") % 100 == 0
    by_page = t.events.where(~first).groupBy(page.alias("page")).agg(F.collect_list(record).alias("items"))
    alone = t.events.where(first).select(page.alias("page"), record.alias("items"))
    pages_of = lambda df: df.select(shown([F.struct("items").alias("data")]))
    none = t.events.select(page.alias("page")).distinct().select(shown([]))
    pages_of(by_page).unionAll(pages_of(alone)).unionAll(none).write.text(path)
    return path


@query("json_pages", "SELECT event_id, user_id, event_type FROM events")
def json_pages(t):
    return pages.page_records(pages.read_pages(t.spark, _landed_pages(t), lines=True), "data.items")


@query(
    "page_completeness",
    """
    SELECT max(p) AS last_page, count(DISTINCT p) AS pages, 1::BIGINT AS final_pages, max(p) AS final_page, count(DISTINCT p) = max(p) AS complete
    FROM (SELECT CAST(floor(event_id / 100) + 1 AS BIGINT) AS p FROM events)
    """,
)
def page_completeness(t):
    landed = pages.read_pages(t.spark, _landed_pages(t), "page bigint, hasNext boolean", lines=True).select("page", "hasNext").distinct()
    return pages.page_completeness(landed, "page", "hasNext")


@query("raw_zone", "SELECT * FROM orders")
def raw_zone(t):
    root = scratch_dir(t.spark, "zone")
    return zones.read_raw(t.spark, zones.write_raw(t.orders, root, "orders", "response.parquet", _DAY))


@query(
    "binary_artefacts",
    "SELECT l_returnflag AS flag, count(*) AS rows FROM lineitem GROUP BY 1",
)
def binary_artefacts(t):
    """Text artefacts read as bytes; lines are counted from the content."""
    path = scratch_dir(t.spark, "bytes")
    t.lineitem.select("l_returnflag", F.lit("x").alias("value")).write.partitionBy("l_returnflag").text(path)
    files = zones.read_artefacts(t.spark, path, "*.txt")
    flag = F.regexp_extract("path", "l_returnflag=([^/]+)/", 1).alias("flag")
    lines = F.length(F.col("content").cast("string")) - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return files.select(flag, lines.alias("n"), (F.length("content") == F.col("length")).alias("ok")).where("ok").groupBy("flag").agg(
        F.sum("n").alias("rows")
    )


@query(
    "artefact_round_trip",
    """
    SELECT CAST(page_id AS VARCHAR) || '.html' AS name, octet_length(encode(html)) AS length, CAST(ceil(octet_length(encode(html)) / 1000) AS BIGINT) AS chunks, sha256(encode(html)) AS sha256,
      sha256(encode(html)[501:2500]) AS range_sha256 FROM pages
    """,
)
def artefact_round_trip(t):
    """Pages as binary artefacts: written in chunks of 1000 bytes, listed by their markers, read back whole and in part."""
    html = t.pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "utf-8").alias("content"))
    path = artefacts.write_artefacts(html, scratch_dir(t.spark, "artefacts"), "pages", _DAY, chunk_bytes=1000)
    whole = artefacts.read_whole(t.spark, path)
    part = F.sha2(F.substring(F.col("content"), 501, 2000), 256).alias("range_sha256")
    read = whole.select("name", F.sha2("content", 256).alias("sha256"), part)
    return artefacts.list_artefacts(t.spark, path).drop("checksum").join(read, "name")


@query(
    "staged_table",
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price, 'my_source_20240131' AS staged_name, 1 AS tables FROM orders",
)
def staged_table(t):
    root = scratch_dir(t.spark, "staged")
    df = t.orders.select(F.col("o_orderkey").alias("Order.Key"), F.col("o_totalprice").alias(" total price"))
    for _ in range(2):  # a second write on the same day replaces the first
        name = zones.stage(df, root, "My-Source", _DAY)
    tables = len(zones.list_staged(t.spark, root))
    return zones.read_staged(t.spark, root, name).withColumnRenamed("_total_price", "total_price").select(
        "order_key", "total_price", F.lit(name).alias("staged_name"), F.lit(tables).alias("tables")
    )


@query(
    "table_metadata",
    """
    SELECT 'customer' AS table_name, 'c_name' AS column_name, 'string' AS dtype, count(*) AS row_count, 'Name' AS description,
      (SELECT string_agg(c_name, ',' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)) AS sample_values FROM customer
    UNION ALL SELECT 'customer', 'c_custkey', 'bigint', count(*), '', (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)) FROM customer
    """,
)
def table_metadata(t):
    got = zones.table_metadata(t.customer.select("c_custkey", "c_name"), "customer", {"c_name": "Name"}, ["c_custkey"])
    return got.select("table_name", "column_name", "dtype", "row_count", "description", F.array_join("sample_values", ",").alias("sample_values"))


@query(
    "seeded_sample",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000",
)
def seeded_sample(t):
    return zones.seeded_sample(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("result_sink", decision_sql(["orders", "customer"]))
def result_sink(t):
    """A decided key written as JSON and read back."""
    tables = discovery.Tables({"orders": t.orders, "customer": t.customer}, order_by={"orders": ["o_orderkey"], "customer": ["c_custkey"]})
    best = discovery.decide(discovery.candidates(tables), tables.pairs())
    path = f"{scratch_dir(t.spark, 'result')}/{zones.result_name('orders', 'customer')}"
    written = t.spark.read.schema(best.schema).json(zones.write_result(best, path))
    return written.select("table_a", "column_a", "table_b", "column_b", "confidence", "summary")


@query(
    "load_catalog",
    """
    SELECT 'lake' AS schema_name, 'orders' AS table_name, 'given' AS source_name, count(*) AS row_count FROM orders
    UNION ALL SELECT 'lake', 'customer', 'given', count(*) FROM customer
    """,
)
def load_catalog(t):
    path = scratch_dir(t.spark, "catalog")
    for i, (name, ok) in enumerate([("orders", True), ("customer", True), ("part", False), ("orders", True)]):
        at = F.timestamp_seconds(F.lit(1700000000 + i))
        zones.record_load(t.spark, path, "given", name, "lake", getattr(t, name).count(), ok, at)
    return zones.usable_tables(t.spark.read.parquet(path)).select("schema_name", "table_name", "source_name", "row_count")


@query(
    "tables_by_pattern",
    """
    SELECT 'nation_' || c_nationkey AS table_schema, 'cust_' || c_mktsegment || '_' || c_custkey AS table_name FROM customer
    WHERE 'nation_' || c_nationkey ILIKE 'NATION_1%' AND c_mktsegment ILIKE 'm%' AND NOT ('cust_' || c_mktsegment || '_' || c_custkey ILIKE '%7')
    """,
)
def tables_by_pattern(t):
    """Table names derived from customers, looked up by schema and name pattern."""
    listed = t.customer.select(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("table_schema"),
        F.concat(F.lit("cust_"), "c_mktsegment", F.lit("_"), F.col("c_custkey").cast("string")).alias("table_name"),
    )
    return zones.find_tables(listed, "NATION_1%", "CUST_m%", exclude="%7")


@query(
    "union_by_prefix",
    """
    SELECT 'loads_error' AS src, event_id, user_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'loads_other', event_id, user_id FROM events WHERE event_type <> 'error'
    """,
)
def union_by_prefix(t):
    """Session tables found by prefix, then united by column name."""
    for kind, which in (("error", F.col("event_type") == "error"), ("other", F.col("event_type") != "error")):
        t.events.where(which).select("event_id", "user_id").createOrReplaceTempView(f"loads_{kind}")
    t.events.select("event_id").createOrReplaceTempView("loads_tmp")
    found = zones.find_tables_by_prefix(zones.catalog_tables(t.spark), "%", "loads_", exclude="%_tmp")
    return union_relations(zones.relations(t.spark, found), source_column="src")
