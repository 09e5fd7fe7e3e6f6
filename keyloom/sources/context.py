"""Context tables: vocabularies, column annotations, table profiles, discovered keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.vocabulary import Vocabulary
from keyloom.operators.merge import align, merge_greatest, merge_latest
from keyloom.operators.relational import latest_per_key
from keyloom.sources.versions import VersionedTable
from keyloom.session import small_table

SCHEMAS = {
    "domain_contexts": "domain_name string, semantic_groups map<string,array<string>>, key_patterns map<string,string>, source string, created_at timestamp",
    "column_annotations": "table_name string, column_name string, domain_group string, semantic_tags array<string>, detected_at timestamp",
    "table_profiles": "table_name string, row_count bigint, exercicio_distribution map<string,bigint>, cardinality_per_col map<string,bigint>, quality_ok boolean, profiled_at timestamp",
    "integration_discoveries": "table_a string, column_a string, table_b string, column_b string, confidence double, discovery_method string, "
    "justification string, evidence_for array<string>, evidence_against array<string>, required_transforms array<string>, "
    "is_validated boolean, discovered_at timestamp, last_confirmed_at timestamp",
}
KEYS = {
    "domain_contexts": ["domain_name"],
    "column_annotations": ["table_name", "column_name"],
    "table_profiles": ["table_name"],
    "integration_discoveries": ["table_a", "column_a", "table_b", "column_b"],
}
MIN_CONFIDENCE = 0.7


# -- operators on context tables, usable on any DataFrame of that shape -----------------------


def upsert_discoveries(target: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Keep the greater confidence; the other fields follow the new find, review state stays."""
    return merge_greatest(
        target,
        found.withColumn("discovered_at", now),
        KEYS["integration_discoveries"],
        "confidence",
        keep=["is_validated", "discovered_at"],
        stamp={"last_confirmed_at": now},
    )


def discoveries_of(discoveries: DataFrame, table: str, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Discoveries touching a table, rejected ones left out, best first."""
    touching = (F.col("table_a") == table) | (F.col("table_b") == table)
    return active_discoveries(discoveries, min_confidence).where(touching).orderBy(F.col("confidence").desc(), *KEYS["integration_discoveries"])


def active_discoveries(discoveries: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return discoveries.where((F.col("confidence") >= min_confidence) & ~F.col("is_validated").eqNullSafe(F.lit(False)))


def review(discoveries: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Set the review state of the keys in ``decisions`` (four key columns, ``is_valid``)."""
    keys = KEYS["integration_discoveries"]
    # several decisions for a key: a rejection counts
    decisions = decisions.groupBy(*keys).agg(F.min("is_valid").alias("is_valid"))
    named = decisions.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("is_valid").alias("__valid"), F.lit(True).alias("__hit"))
    joined = discoveries.join(named, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    changed = {
        "is_validated": F.when(F.col("__hit"), F.col("__valid")).otherwise(F.col("is_validated")),
        "last_confirmed_at": F.when(F.col("__hit"), now).otherwise(F.col("last_confirmed_at")),
    }
    return joined.select([changed.get(c, F.col(c)).cast(discoveries.schema[c].dataType).alias(c) for c in discoveries.columns])


def gate(packages: DataFrame, discoveries: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Which models each package may build: all once a good key touches it, else raw copies only.

    Fixed values: the two path labels.
    """
    active = active_discoveries(discoveries, min_confidence)
    touched = active.select(F.explode(F.array("table_a", "table_b")).alias("package")).distinct().withColumn("__hit", F.lit(True))
    label = F.when(F.col("__hit"), "models/").otherwise("models/bronze/")
    return packages.join(touched, "package", "left").select("package", label.alias("selected"))


def best_as_discovery(best: DataFrame) -> DataFrame:
    """Decided keys as rows of the discoveries table."""
    return best.where("column_a is not null").select(
        "table_a", "column_a", "table_b", "column_b", "confidence",
        F.lit("semantic+content").alias("discovery_method"),
        "justification", "evidence_for", "evidence_against",
        F.col("required_transformations").alias("required_transforms"),
    )


# -- the stored tables ---------------------------------------------------------------------------


class ContextStore:
    """The four context tables under one folder; each write is a new version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = {name: VersionedTable(spark, f"{root}/{name}") for name in SCHEMAS}

    def read(self, name: str) -> DataFrame:
        found = self.tables[name].read()
        return found if found is not None else small_table(self.spark, [], SCHEMAS[name])

    def _change(self, name: str, change) -> None:
        """Commit what ``change`` makes of a table; made anew where another writer was first."""
        self.tables[name].update(lambda found: change(found if found is not None else small_table(self.spark, [], SCHEMAS[name])))

    def _upsert(self, name: str, updates: DataFrame, created: str | None = None, stamped: str | None = None) -> None:
        self._change(name, lambda target: self._upserted(name, target, updates, created, stamped))

    def _upserted(self, name: str, target: DataFrame, updates: DataFrame, created: str | None, stamped: str | None) -> DataFrame:
        now = F.current_timestamp()
        # several rows for a key: the first by their other columns
        order = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in updates.columns])).asc_nulls_last()]
        updates = latest_per_key(updates, KEYS[name], order)
        if stamped:
            updates = updates.withColumn(stamped, now)
        if created:
            # the creation stamp of a row that is replaced stays
            first = target.select(*KEYS[name], F.col(created).alias("__first"))
            updates = updates.join(first, KEYS[name], "left").withColumn(created, F.coalesce("__first", now)).drop("__first")
        return merge_latest(target, align(updates, target), KEYS[name])

    def put_vocabulary(self, rows: DataFrame) -> None:
        self._upsert("domain_contexts", rows, created="created_at")

    def put_annotations(self, rows: DataFrame) -> None:
        self._upsert("column_annotations", rows, stamped="detected_at")

    def put_profile(self, rows: DataFrame) -> None:
        self._upsert("table_profiles", rows, stamped="profiled_at")

    def put_discoveries(self, rows: DataFrame) -> None:
        self._change("integration_discoveries", lambda target: upsert_discoveries(target, rows, F.current_timestamp()))

    def review(self, decisions: DataFrame) -> None:
        self._change("integration_discoveries", lambda target: review(target, decisions, F.current_timestamp()))

    def vocabulary(self, base: Vocabulary | None = None) -> Vocabulary:
        """The base vocabulary overlaid with the stored ones, in name order (configuration-sized)."""
        rows = self.read("domain_contexts").orderBy("domain_name").select("semantic_groups").collect()
        return (base or Vocabulary()).overlay(r[0] for r in rows)

    def vocabularies(self) -> DataFrame:
        return self.read("domain_contexts").orderBy("domain_name")

    def annotations(self, table: str) -> DataFrame:
        return self.read("column_annotations").where(F.col("table_name") == table).orderBy("column_name")

    def profile(self, table: str) -> DataFrame:
        return self.read("table_profiles").where(F.col("table_name") == table)

    def discoveries(self, table: str, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
        return discoveries_of(self.read("integration_discoveries"), table, min_confidence)

    def annotate(self, table: str, columns: Sequence[str]) -> None:
        """Annotate every column with its vocabulary group, none included."""
        self.put_annotations(annotate(self.spark, table, columns, self.vocabulary()))


def annotate(spark: SparkSession, table: str, columns: Sequence[str], vocabulary: Vocabulary) -> DataFrame:
    return annotate_names(small_table(spark, [(table, c) for c in columns], "table_name string, column_name string"), vocabulary)


def annotate_names(names: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Annotations of (table_name, column_name) rows, say of a whole catalogue."""
    return names.select("table_name", "column_name", vocabulary.group_of(F.col("column_name")).alias("domain_group"), F.lit(None).cast("array<string>").alias("semantic_tags"))
