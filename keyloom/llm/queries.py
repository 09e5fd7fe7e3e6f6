"""Registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, divergence, langid, lexical, lines, ngram_join, onebit, packing, paragraphs, pseudonyms, quality, suffix_dedup, token_files
from keyloom.session import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_checksums(spark, path)


def _az(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORD_SQL = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_az('text')}, {WORD_SQL}) AS w FROM benchmark
), docs AS (
  SELECT doc_id, regexp_extract_all({_az('text')}, {WORD_SQL}) AS w FROM documents
), sized AS (
  SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS t
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
), sizes AS (
  SELECT DISTINCT size FROM sized
), spots AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS t
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, spots.size, i, item FROM spots JOIN wins USING (size, t)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, folder, "benchmark"))
    hit = decontaminate.n_hit(F.col("hit_runs"))
    digest = text_sha(F.array_join("hit_items", ","))
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated")
    )


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP4_SQL = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM cut
), keyed AS (
  SELECT doc_id, line, n, {_az(r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, coalesce(doc_id != first, false) AS lost FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", text_sha(F.col("text")).alias("kept_sha256"))


#: Stands for a key that a deployment keeps secret.
PSEUDONYM_KEY = "registered-query-key"


@query("op5_feistel_pseudonyms")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = pseudonyms.pseudonymize(table(spark, folder, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_pseudonyms"), F.array_join("kinds", ",").alias("kinds"))


@query("op6_paragraph_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = paragraphs.drop_repeated_passages(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped_lines"), text_sha(F.col("text")).alias("kept_sha256"))


@query("op7_vector_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op8_ngram_jaccard")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.drop_repeated_strings(table(spark, folder, "documents").select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return out.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x != 0]) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


@query("op11_rotated_codes", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return onebit.nearest(table(spark, folder, "embeddings"), "id % 50 = 0")


OP12_SQL = rf"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_az('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30
), seen AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT g.lang, g.source, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v,
         coalesce((SELECT sum(n) FROM seen s WHERE s.lang = g.lang AND s.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
), grid AS (
  SELECT z.lang, z.source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM sizes z JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, term)
), overall AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM grid JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM sizes GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term
         WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source != b.source
), terms AS (
  SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM grid JOIN overall USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
) WHERE rank <= 50
"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


OP13_SQL = f"""
WITH docs AS (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all({_az('text')}, {WORD_SQL}) AS w FROM documents) WHERE len(w) > 0
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_az('text')}, {WORD_SQL})) AS term FROM benchmark
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS impact FROM tf JOIN weights USING (term), whole
), scores AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores
) WHERE rank <= 10
"""


@query("op13_best_position", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
