"""Join-key discovery: which columns of two or more tables can be joined.

The work is laid out so that data-sized steps are few:

1. names, types and vocabulary are compared on a table of column pairs (schema-sized);
2. pairs the names do not settle are compared by all their values: patterns and lengths from
   one aggregate per table, overlap and containment from the value index;
3. the value index: one grouping by native value counts the rows of every value of every column,
   a second, over those distinct values as text, turns each into the bit set of columns holding
   it, a third counts equal bit sets, and pairs are read off those few sets.  Values are never
   paired with each other, and nothing but the first grouping touches every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import similarity as sim
from keyloom.functions.numbers import fixed_text
from keyloom.functions.strings import is_numeric, normalize_text, plain_text
from keyloom.functions.vocabulary import Vocabulary
from keyloom.operators.containment import containing
from keyloom.operators.profile import best_patterns, column_profile, plain_columns
from keyloom.operators.relational import top, top_per_group
from keyloom.session import settled, small_table

# Thresholds and weights of the scores.
NAME_THRESHOLD = 0.30
PROMOTION_THRESHOLD = 0.50
AFFINITY_THRESHOLD = 0.45
AFFINITY_TOP = 3
MAX_CANDIDATES = 10
AUTO_PAIRS = 15
WEIGHTS = {"name_or_content": 0.35, "match": 0.30, "type": 0.20, "pattern": 0.15}

_BITS = 60


@dataclass
class Tables:
    """Tables taking part, with the order of each and columns to leave out."""

    frames: Mapping[str, DataFrame]
    order_by: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ignore: Sequence[str] = ()
    vocabulary: Vocabulary = field(default_factory=Vocabulary)

    def __post_init__(self) -> None:
        left_out = {c.lower() for c in self.ignore}
        self.columns = []  # (cid, table, ord, field)
        for table, df in self.frames.items():
            for i, f in enumerate(f for f in plain_columns(df) if f.name.lower() not in left_out):
                self.columns.append((len(self.columns), table, i, f))

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.frames.values())).sparkSession

    def ids_of(self, table: str) -> list[int]:
        return [cid for cid, t, _, _ in self.columns if t == table]

    def pairs(self) -> list[tuple[str, str]]:
        return list(combinations(self.frames, 2))


def two_tables(name_a: str, a: DataFrame, name_b: str, b: DataFrame, **options) -> Tables:
    return Tables({name_a: a, name_b: b}, **options)


# -- column pairs ---------------------------------------------------------------------------


def column_pairs(tables: Tables, table_pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """All column pairs of the table pairs with name, vocabulary and type scores."""
    spark = tables.spark
    described = small_table(spark, 
        [(cid, t, o, f.name, sim.type_family(f.dataType)) for cid, t, o, f in tables.columns],
        "cid int, t string, ord int, name string, family string",
    ).withColumn("grp", tables.vocabulary.group_of(F.col("name")))
    # one list of columns per table: schema-sized
    listed = described.groupBy("t").agg(F.collect_list(F.struct("cid", "ord", "name", "family", "grp")).alias("cols"))
    wanted = small_table(spark, list(table_pairs or tables.pairs()), "table_a string, table_b string")
    side = lambda s: listed.select(F.col("t").alias(f"table_{s}"), F.explode("cols").alias(s))
    lists_b = listed.select(F.col("t").alias("table_b"), F.col("cols").alias("cols_b"))
    paired = (
        wanted.join(side("a"), "table_a")
        .join(lists_b, "table_b")
        .select("table_a", "table_b", "a", F.explode("cols_b").alias("b"))
    )
    flat = paired.select(
        "table_a",
        "table_b",
        *[F.col(f"{s}.{k}").alias(f"{n}_{s}") for s in "ab" for k, n in _PAIR_FIELDS.items()],
    )
    scored = flat.withColumn("name_similarity", sim.name_similarity(F.col("column_a"), F.col("column_b")))
    return scored.withColumn(
        "semantic", sim.semantic_score(F.col("name_similarity"), F.col("group_a"), F.col("group_b"))
    ).withColumn("type_score", F.when(sim.types_compatible(F.col("family_a"), F.col("family_b")), 1.0).otherwise(0.0))


_PAIR_FIELDS = {"cid": "cid", "ord": "ord", "name": "column", "family": "family", "grp": "group"}


def affinity(tables: Tables, pairs: DataFrame | None = None) -> DataFrame:
    """Mean of the three best column-pair scores of each table pair, and whether it is enough."""
    pairs = column_pairs(tables) if pairs is None else pairs
    best = top_per_group(pairs, ["table_a", "table_b"], [F.col("semantic").desc(), F.col("ord_a"), F.col("ord_b")], AFFINITY_TOP)
    return (
        best.groupBy("table_a", "table_b")
        .agg(F.round(F.avg("semantic"), 4).alias("affinity"))
        .withColumn("kept", F.col("affinity") >= AFFINITY_THRESHOLD)
    )


# -- value index ------------------------------------------------------------------------------


def _native(data_type: T.DataType) -> T.DataType | None:
    """The type in which equal values of a column are grouped; None: as text."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return data_type
    return None


def value_counts(tables: Tables, cids: Sequence[int]) -> DataFrame:
    """``(cid, value, number, n)``: the texts of the columns' values (NULL too) with their rows.

    Rows are grouped by native values, those of one type together, so that only distinct values
    become text.  A text comes back more than once where different values have the same.
    """
    chosen, parts = set(cids), []
    for table, df in tables.frames.items():
        kinds: dict[T.DataType | None, list[tuple[int, T.StructField]]] = {}
        for cid, t, _, f in tables.columns:
            if t == table and cid in chosen:
                kinds.setdefault(_native(f.dataType), []).append((cid, f))
        for kind, mine in kinds.items():
            key = lambda f: F.col(f"`{f.name}`").cast(kind) if kind else plain_text(F.col(f"`{f.name}`"), f.dataType)
            keys = df.select([key(f).alias(str(cid)) for cid, f in mine])
            long = keys.unpivot([], [F.col(f"`{cid}`") for cid, _ in mine], "cid", "value")
            counted = long.groupBy(F.col("cid").cast("int").alias("cid"), "value").agg(F.count(F.lit(1)).alias("n"))
            text = plain_text(F.col("value"), kind) if kind else F.col("value")
            numbers = [cid for cid, f in mine if is_numeric(f.dataType)]
            number = F.col("cid").isin(numbers) if numbers else F.lit(False)
            parts.append(counted.select("cid", text.cast("string").alias("value"), number.alias("number"), "n"))
    return reduce(DataFrame.unionAll, parts)


def value_sets(tables: Tables, cids: Sequence[int], counted: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``(value, number, w0, w1, ...)``: every distinct value with the bit set of its columns.

    Bit ``i`` stands for ``cids[i]``.  Fixed-width ``bit_or`` buffers keep the grouping in
    generated code.
    """
    words = -(-len(cids) // _BITS)
    counted = value_counts(tables, cids) if counted is None else counted
    bits = F.create_map(*[F.lit(x) for i, cid in enumerate(cids) for x in (cid, i)])
    long = counted.where("value IS NOT NULL").select("value", "number", F.element_at(bits, F.col("cid")).alias("bit"))
    long = long.select("value", "number", *[_word_of(F.col("bit"), w).alias(f"w{w}") for w in range(words)])
    return long.groupBy("value", "number").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)]), words


def _word_of(bit: Column, word: int) -> Column:
    inside = bit.between(word * _BITS, (word + 1) * _BITS - 1)
    return F.when(inside, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit % _BITS)).otherwise(F.lit(0).cast("bigint"))


def match_form_sets(sets: DataFrame, words: int) -> DataFrame:
    """The value sets after match normalisation (numbers keep their text)."""
    form = F.when(F.col("number"), F.trim("value")).otherwise(normalize_text(F.col("value")))
    return sets.groupBy(form.alias("value")).agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)])


def _set_members(words: int, prefix: str = "w") -> Column:
    """Bit numbers present in the words of a row."""
    def members(word: int) -> Column:
        bits = F.col(f"{prefix}{word}")
        present = F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda i: F.call_function("bit_get", bits, i) == 1)
        return F.transform(present, lambda i: i + word * _BITS)

    return F.concat(*[members(w) for w in range(words)])


def set_counts(sets: DataFrame, words: int, samples: int = 0) -> DataFrame:
    """How many values share each set of columns, with the set as a list of bit numbers.

    ``samples`` keeps that many smallest values per set.
    """
    keys = [f"w{w}" for w in range(words)]
    counts = sets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if samples:
        few = top_per_group(sets, keys, [F.col("value").asc()], samples, "__r")
        shown = few.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("shown"))
        counts = counts.join(shown, keys)
    return counts.select(_set_members(words).alias("bits"), "n", *(["shown"] if samples else []))


def _pair_counts(counts: DataFrame, cids: Sequence[int], samples: int = 0) -> DataFrame:
    """``(left, right, shared)`` per column pair, a column with itself giving its distinct count."""
    ids = F.array(*[F.lit(c) for c in cids])
    spread = counts.select(F.explode("bits").alias("i"), "bits", "n", *(["shown"] if samples else []))
    spread = spread.select("i", F.explode(F.filter("bits", lambda j: j >= F.col("i"))).alias("j"), "n", *(["shown"] if samples else []))
    left, right = F.get(ids, F.col("i")).alias("left"), F.get(ids, F.col("j")).alias("right")
    shared = spread.groupBy(left, right).agg(F.sum("n").alias("shared"))
    if not samples:
        return shared
    # a value belongs to one set, so the least values of a pair are among those of its sets
    least = top_per_group(spread.select(left, right, F.explode("shown").alias("value")), ["left", "right"], [F.col("value").asc()], samples, "__r")
    listed = least.groupBy("left", "right").agg(F.sort_array(F.collect_list("value")).alias("sample_matches"))
    return shared.join(listed, ["left", "right"], "left")


def overlap(tables: Tables, pairs: DataFrame, cids: Sequence[int], normalize: bool = True, samples: int = 0) -> DataFrame:
    """Distinct counts, intersection and both match rates for column pairs ``(cid_a, cid_b)``."""
    sets, words = value_sets(tables, cids)
    if normalize:
        sets = match_form_sets(sets, words)
    found = _pair_counts(set_counts(sets, words, samples), cids, samples)
    return _attach_overlap(pairs, found, samples)


def _attach_overlap(pairs: DataFrame, found: DataFrame, samples: int = 0) -> DataFrame:
    own = found.where("left = right")
    alone = lambda s: own.select(F.col("left").alias(f"cid_{s}"), F.col("shared").alias(f"unique_{s}"))
    both = found.where("left <> right").select(
        F.col("left").alias("lo"), F.col("right").alias("hi"), F.col("shared").alias("intersection"),
        *(["sample_matches"] if samples else []),
    )
    out = (
        pairs.withColumn("lo", F.least("cid_a", "cid_b"))
        .withColumn("hi", F.greatest("cid_a", "cid_b"))
        .join(alone("a"), "cid_a", "left")
        .join(alone("b"), "cid_b", "left")
        .join(both, ["lo", "hi"], "left")
        .drop("lo", "hi")
        .fillna(0, ["unique_a", "unique_b", "intersection"])
    )
    rate = lambda s: F.when(F.col(f"unique_{s}") > 0, F.col("intersection") / F.col(f"unique_{s}")).otherwise(0.0)
    out = out.withColumn("match_rate_a_in_b", rate("a")).withColumn("match_rate_b_in_a", rate("b"))
    if samples:
        out = out.withColumn("sample_matches", F.coalesce("sample_matches", F.array().cast("array<string>")))
    return out


def overlap_matrix(tables: Tables, normalize: bool = True, samples: int = 5) -> DataFrame:
    """Value overlap of every column pair across tables, from one value index."""
    spark = tables.spark
    listed = small_table(spark, [(cid, t, f.name) for cid, t, _, f in tables.columns], "cid int, t string, name string")
    later = F.explode(F.sequence(F.col("cid") + 1, F.lit(len(tables.columns) - 1)))
    pairs = listed.where(F.col("cid") < len(tables.columns) - 1).select(F.col("cid").alias("cid_a"), later.alias("cid_b"))
    for s in "ab":
        pairs = pairs.join(
            listed.select(F.col("cid").alias(f"cid_{s}"), F.col("t").alias(f"table_{s}"), F.col("name").alias(f"column_{s}")), f"cid_{s}"
        )
    pairs = pairs.where("table_a <> table_b")
    return overlap(tables, pairs, [c[0] for c in tables.columns], normalize, samples).drop("cid_a", "cid_b")


# -- content evidence -------------------------------------------------------------------------


def column_facts(tables: Tables, cids: Sequence[int], counted: DataFrame) -> DataFrame:
    """``(cid, pattern, avg_length, present, rows)`` of columns, over all rows, from their counted values."""
    patterns, text = dict(tables.vocabulary.patterns), F.col("value")
    times = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hits = F.array(*[times(F.rlike(text, F.lit(p))) for p in patterns.values()])
    listed = small_table(tables.spark, [(cid,) for cid in cids], "cid int")
    found = counted.groupBy("cid").agg(
        F.sum("n").alias("rows"), times(text.isNotNull()).alias("n"), F.sum(F.length(text) * F.col("n")).alias("total"), hits.alias("hits")
    )
    none = F.array_repeat(F.lit(0).cast("long"), len(patterns))
    found = listed.join(found, "cid", "left").fillna(0, ["rows", "n"]).withColumn("hits", F.coalesce("hits", none))
    best = best_patterns(found.withColumn("present", F.col("n")), patterns, ["cid", "present", "rows"])
    return best.select("cid", F.col("best_pattern").alias("pattern"), "avg_length", "present", "rows")


def inside_counts(sets: DataFrame, words: int, cids: Sequence[int]) -> DataFrame:
    """``(inner, outer, held)``: how many distinct values of one column lie in some value of another."""
    keys = [f"w{w}" for w in range(words)]
    # dealt out in full width: what follows is work on the bytes of few, small partitions
    spread = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value")
    texts = spread.groupBy("value").agg(*[F.bit_or(k).alias(k) for k in keys])
    sides = containing(texts, keys).groupBy(*keys, *[f"o{k}" for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    both = sides.select(_set_members(words).alias("inner"), _set_members(words, "ow").alias("outer"), "n")
    ids = F.array(*[F.lit(c) for c in cids])
    spread = both.select(F.explode("inner").alias("i"), "outer", "n").select("i", F.explode("outer").alias("o"), "n").where("i <> o")
    return spread.groupBy(F.get(ids, F.col("i")).alias("inner"), F.get(ids, F.col("o")).alias("outer")).agg(F.sum("n").alias("held"))


def content_score(format_match: Column, overlap_rate: Column, substring: Column) -> Column:
    """Score of the value evidence; a shared format lets the stronger signal count in full.

    Fixed values: the weights.
    """
    mixed = F.greatest(0.6 * overlap_rate + 0.4 * substring, 0.8 * substring)
    return F.round(F.when(format_match, F.greatest(overlap_rate, substring)).otherwise(mixed), 4)


@dataclass
class ValueIndex:
    """Every distinct value of some columns with the bit set of its columns, written once.

    ``facts`` are those of :func:`column_facts`; ``raw`` and ``matched`` count the sets of the
    values and of their match forms, and are as small as the number of different sets.
    """

    sets: DataFrame
    words: int
    cids: list[int]
    facts: DataFrame
    raw: DataFrame
    matched: DataFrame

    @classmethod
    def of(cls, tables: Tables, cids: Sequence[int]) -> ValueIndex:
        counted = settled(value_counts(tables, cids), "counted")
        facts = settled(column_facts(tables, cids, counted), "facts")
        sets, words = value_sets(tables, cids, counted)
        sets = settled(sets, "values")
        raw = settled(set_counts(sets, words), "raw")
        return cls(sets, words, list(cids), facts, raw, settled(set_counts(match_form_sets(sets, words), words), "matched"))

    def of_columns(self, cids: Sequence[int]) -> DataFrame:
        """The values of some of the columns, with their bits of those alone."""
        bits = [i for i, c in enumerate(self.cids) if c in set(cids)]
        masks = [sum(1 << (i - w * _BITS) for i in bits if i // _BITS == w) for w in range(self.words)]
        words = [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("bigint")).alias(f"w{w}") for w, m in enumerate(masks)]
        some = reduce(lambda x, y: x | y, [F.col(f"w{w}") != 0 for w in range(self.words)])
        return self.sets.select("value", "number", *words).where(some)


def _columns_in(pairs: DataFrame) -> list[int]:
    """Column numbers of a table of column pairs: schema-sized."""
    found = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
    return sorted(r["cid"] for r in found.collect())


def with_content(tables: Tables, pairs: DataFrame, index: ValueIndex | None = None) -> DataFrame:
    """Add format, overlap, substring rate and content score, over all values, to column pairs.

    Only the columns of the given pairs are read.  Rates weigh distinct values.
    """
    cids = _columns_in(pairs)
    index = index or ValueIndex.of(tables, cids or [0])
    side = lambda s: index.facts.select(F.col("cid").alias(f"cid_{s}"), F.col("pattern").alias(f"format_{s}"))
    joined = _attach_overlap(pairs.join(side("a"), "cid_a").join(side("b"), "cid_b"), _pair_counts(index.matched, index.cids))
    held = inside_counts(index.of_columns(cids), index.words, index.cids)
    # a column is all numbers or none, so a value is in it once
    own = _pair_counts(index.raw, index.cids).where("left = right").select(F.col("left").alias("inner"), F.col("shared").alias("values"))
    share = settled(held.join(own, "inner").select("inner", "outer", (F.col("held") / F.col("values")).alias("share")), "inside")
    for x, y in ("ab", "ba"):
        joined = joined.join(share.select(F.col("inner").alias(f"cid_{x}"), F.col("outer").alias(f"cid_{y}"), F.col("share").alias(f"share_{x}")), ["cid_a", "cid_b"], "left")
    rate = F.round(F.greatest(F.coalesce("share_a", F.lit(0.0)), F.coalesce("share_b", F.lit(0.0))), 4)
    return (
        joined.withColumn("format_match", F.coalesce(F.col("format_a") == F.col("format_b"), F.lit(False)))
        .withColumn("overlap_rate", F.round("match_rate_a_in_b", 4))
        .withColumn("substring_match_rate", rate)
        .withColumn("content_score", content_score(F.col("format_match"), F.col("overlap_rate"), F.col("substring_match_rate")))
        .withColumn("promoted", F.col("content_score") >= PROMOTION_THRESHOLD)
        .drop("share_a", "share_b", "unique_a", "unique_b", "intersection", "match_rate_a_in_b", "match_rate_b_in_a")
    )


def compare_columns(tables: Tables, column_a: str, column_b: str) -> DataFrame:
    """Every signal for one chosen pair of columns of two tables."""
    table_a, table_b = list(tables.frames)
    cid = {(t, f.name): c for c, t, _, f in tables.columns}
    ids = [cid[table_a, column_a], cid[table_b, column_b]]
    pair = settled(column_pairs(tables).where((F.col("cid_a") == ids[0]) & (F.col("cid_b") == ids[1])))
    index = ValueIndex.of(tables, ids)
    seen = with_content(tables, pair, index)
    found = _pair_counts(set_counts(match_form_sets(index.sets, index.words), index.words, 5), ids, 5)
    return _attach_overlap(seen, found, 5).drop("cid_a", "cid_b")


# -- candidates -----------------------------------------------------------------------------


def _rates(index: ValueIndex) -> DataFrame:
    """Pattern, average length, null rate and uniqueness of the columns still in play."""
    distinct = _pair_counts(index.raw, index.cids).where("left = right").select(F.col("left").alias("cid"), F.col("shared").alias("distinct"))
    joined = index.facts.join(distinct, "cid", "left").fillna(0, ["distinct"])
    return joined.select(
        "cid",
        "pattern",
        "avg_length",
        F.when(F.col("rows") > 0, 1 - F.col("present") / F.col("rows")).otherwise(1.0).alias("null_rate"),
        F.when(F.col("present") > 0, F.col("distinct") / F.col("present")).otherwise(0.0).alias("uniqueness"),
    )


def _percent(c: Column) -> Column:
    return F.concat(fixed_text(c * 100, 1), F.lit("%"))


def _listed(*entries: Column) -> Column:
    return F.array_compact(F.array(*entries))


def _name_evidence() -> dict[str, Column]:
    """Evidence texts of pairs found by name.  Fixed values: the texts and thresholds."""
    s, m = F.col("semantic"), F.col("match_rate")
    mismatch = F.col("type_score") == 0.0
    pa, pb = F.col("pattern_a"), F.col("pattern_b")
    la, lb = F.coalesce("avg_length_a", F.lit(0.0)), F.coalesce("avg_length_b", F.lit(0.0))
    wide = F.abs(la - lb) > 3
    nulls = lambda x: F.when(
        F.col(f"null_rate_{x}") > 0.2,
        F.concat(F.lit("High null rate in "), F.col(f"column_{x}"), F.lit(": "), _percent(F.col(f"null_rate_{x}"))),
    )
    return {
        "evidence_for": _listed(
            F.when(s >= 0.8, F.format_string("High name similarity (%s): '%s' ~ '%s'", fixed_text(s, 2), "column_a", "column_b")).when(
                s >= 0.5, F.format_string("Moderate name similarity (%s)", fixed_text(s, 2))
            ),
            F.when(F.col("group_a") == F.col("group_b"), F.format_string("Both columns belong to domain group '%s'", "group_a")),
            F.when(m >= 0.8, F.concat(F.lit("High match rate: "), _percent(m), F.lit(" of values in A found in B"))).when(
                m >= 0.5, F.concat(F.lit("Moderate match rate: "), _percent(m))
            ),
            F.when(pa == pb, F.format_string("Both match domain pattern '%s'", pa)),
        ),
        "evidence_against": _listed(
            F.when(m < 0.5, F.concat(F.lit("Low match rate: "), _percent(m))),
            F.when(mismatch, F.format_string("Incompatible dtypes: %s vs %s", "family_a", "family_b")),
            nulls("a"),
            nulls("b"),
            F.when(pa != pb, F.format_string("Pattern mismatch: '%s' vs '%s'", pa, pb)),
            F.when(wide, F.format_string("Avg value length differs: %s vs %s", fixed_text(la, 1), fixed_text(lb, 1))),
        ),
        "required_transformations": _listed(
            F.when(mismatch, F.format_string("Cast %s (%s) to %s before join", "column_b", "family_b", "family_a")),
            F.when(wide, F.lit("Check if padding (zfill) or trimming is needed")),
        ),
    }


def _content_evidence() -> dict[str, Column]:
    """Evidence texts of pairs found by content.  Fixed values: the texts and thresholds."""
    c, o, sub = F.col("content_score"), F.col("overlap_rate"), F.col("substring_match_rate")
    same = F.col("format_match")
    mismatch = F.col("type_score") == 0.0
    shown = lambda x: F.when(F.col(f"format_{x}").isNull(), F.lit("None")).otherwise(F.col(f"format_{x}"))
    return {
        "evidence_for": _listed(
            F.format_string("Content-promoted: content_score=%s >= 0.5", fixed_text(c, 3)),
            F.when(same, F.format_string("Format match: both columns match pattern '%s'", "format_a")),
            F.when(o >= 0.5, F.concat(F.lit("Value overlap: "), _percent(o), F.lit(" of A values found in B"))),
            F.when(sub >= 0.5, F.format_string("Substring relation detected: rate=%s (possible Derived Key)", fixed_text(sub, 2))),
        ),
        "evidence_against": _listed(
            F.format_string("Low name similarity (%s): '%s' vs '%s'", fixed_text(F.col("semantic"), 2), "column_a", "column_b"),
            F.when(~same, F.format_string("Format mismatch: '%s' vs '%s'", shown("a"), shown("b"))),
            F.when(mismatch, F.format_string("Incompatible dtypes: %s vs %s", "family_a", "family_b")),
        ),
        "required_transformations": _listed(
            F.when(sub >= 0.5, F.lit("Investigate substring/concatenation transform to align keys")),
            F.when(mismatch, F.format_string("Cast %s (%s) to %s before join", "column_b", "family_b", "family_a")),
        ),
    }


def candidates(
    tables: Tables,
    table_pairs: Sequence[tuple[str, str]] | None = None,
    by_affinity: bool = False,
    max_candidates: int = MAX_CANDIDATES,
    name_threshold: float = NAME_THRESHOLD,
    same_types: bool = False,
) -> DataFrame:
    """Ranked, explained candidate keys of each table pair.

    A pair of columns is judged by name where its name score reaches the threshold, else
    by content, where it must earn promotion.  With ``by_affinity`` (mapping many tables)
    table pairs of low affinity are judged by content only; ``same_types`` leaves out their
    column pairs of incompatible types, in either direction.
    """
    pairs = column_pairs(tables, table_pairs)
    by_name = F.col("semantic") >= name_threshold
    if by_affinity:
        pairs = settled(pairs)
        near = affinity(tables, pairs).select("table_a", "table_b", "kept")
        pairs = pairs.join(near, ["table_a", "table_b"])
        if same_types:
            either = sim.types_compatible(F.col("family_a"), F.col("family_b")) | sim.types_compatible(F.col("family_b"), F.col("family_a"))
            pairs = pairs.where(F.col("kept") | either)
        by_name = by_name & F.col("kept")
    pairs = pairs.withColumn("discovery_method", F.when(by_name, "semantic").otherwise("content"))
    pairs = settled(pairs)
    asked = _columns_in(pairs)
    if not asked:
        return _empty_candidates(tables.spark)
    index = ValueIndex.of(tables, asked)
    named = pairs.where("discovery_method = 'semantic'")
    promoted = settled(with_content(tables, pairs.where("discovery_method = 'content'"), index).where("promoted"))

    if not _columns_in(named.select("cid_a", "cid_b").unionAll(promoted.select("cid_a", "cid_b"))):
        return _empty_candidates(tables.spark)
    rates = settled(_rates(index), "rates")

    content_columns = ["format_a", "format_b", "format_match", "overlap_rate", "substring_match_rate", "content_score"]
    types = dict(promoted.dtypes)
    full = _attach_overlap(named, _pair_counts(index.matched, index.cids)).withColumn("match_rate", F.col("match_rate_a_in_b"))
    full = full.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in content_columns])
    sampled = promoted.drop("promoted").withColumn("match_rate", F.col("overlap_rate"))
    merged = full.unionByName(sampled, allowMissingColumns=True)
    for s in "ab":
        merged = merged.join(rates.select(*[F.col(c).alias(f"{c}_{s}") for c in rates.columns]), f"cid_{s}")
    term = F.coalesce("content_score", "semantic")
    has_pattern = F.when(F.col("pattern_a").isNotNull(), 1.0).otherwise(0.0)
    score = F.round(
        WEIGHTS["name_or_content"] * term
        + WEIGHTS["match"] * F.col("match_rate")
        + WEIGHTS["type"] * F.col("type_score")
        + WEIGHTS["pattern"] * has_pattern,
        4,
    )
    by_name_texts, by_content_texts = _name_evidence(), _content_evidence()
    is_name = F.col("content_score").isNull()
    scored = merged.select(
        "table_a", "column_a", "table_b", "column_b", "ord_a", "ord_b", "discovery_method",
        "semantic", "type_score", "match_rate", "content_score",
        sim.cardinality_label(F.greatest("uniqueness_a", "uniqueness_b")).alias("cardinality"),
        "pattern_a", "pattern_b",
        score.alias("score"),
        *[F.when(is_name, by_name_texts[k]).otherwise(by_content_texts[k]).alias(k) for k in by_name_texts],
    )
    ranked = top_per_group(
        scored, ["table_a", "table_b"], [F.col("score").desc(), F.col("ord_a"), F.col("ord_b")], max_candidates
    )
    return ranked.drop("ord_a", "ord_b").withColumn("decision", F.when(F.col("rank") == 1, "accepted").otherwise("candidate"))


def _empty_candidates(spark: SparkSession) -> DataFrame:
    return small_table(spark, 
        [],
        "table_a string, column_a string, table_b string, column_b string, discovery_method string, semantic double, "
        "type_score double, match_rate double, content_score double, cardinality string, pattern_a string, "
        "pattern_b string, score double, evidence_for array<string>, evidence_against array<string>, "
        "required_transformations array<string>, rank int, decision string",
    )


def decide(ranked: DataFrame, table_pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Best key of each table pair with a summary; pairs without a candidate say so."""
    spark = ranked.sparkSession
    asked = small_table(spark, list(table_pairs), "table_a string, table_b string")
    best = ranked.where("rank = 1").withColumnRenamed("score", "confidence")
    joined = asked.join(best, ["table_a", "table_b"], "left")
    summary = F.concat(
        F.lit("Best candidate: ['"), F.col("column_a"), F.lit("'] ↔ ['"), F.col("column_b"), F.lit("'] (score="),
        F.col("confidence").cast("string"), F.lit(")"),
    )
    return joined.select(
        "table_a",
        "column_a",
        "table_b",
        "column_b",
        "confidence",
        F.coalesce(summary, F.lit("No candidate keys found above threshold.")).alias("summary"),
        F.when(F.col("confidence").isNotNull(), F.array_join("evidence_for", " | ")).alias("justification"),
        "evidence_for",
        "evidence_against",
        "required_transformations",
    )


def map_tables(tables: Tables, **options) -> DataFrame:
    """Candidate keys over all pairs of many tables, from one value index."""
    return candidates(tables, by_affinity=True, **options)


def auto_pairs(tables: Tables, most: int = AUTO_PAIRS) -> DataFrame:
    """The best ``most`` column pairs by name score among key-like columns, before any values are compared."""
    unique = reduce(
        DataFrame.unionAll,
        [
            column_profile(df).where("uniqueness_rate > 0.95").select(F.lit(t).alias("t"), F.col("column_name").alias("name"))
            for t, df in tables.frames.items()
        ],
    )
    pairs = column_pairs(tables).where(F.col("semantic") >= NAME_THRESHOLD)
    for s in "ab":
        pairs = pairs.join(unique.select(F.col("t").alias(f"table_{s}"), F.col("name").alias(f"column_{s}")), [f"table_{s}", f"column_{s}"], "left_semi")
    ordered = top(pairs, [F.col("semantic").desc(), F.col("table_a"), F.col("table_b"), F.col("ord_a"), F.col("ord_b")], most)
    return ordered.select("table_a", "column_a", "table_b", "column_b", "semantic")


def coverage(tables: Tables, threshold: float = 0.60) -> DataFrame:
    """Share of the tables' column names the vocabulary recognises (all, when there is none)."""
    names = small_table(
        tables.spark, [(i, f.name) for i, (_, _, _, f) in enumerate(tables.columns)], "ord int, name string"
    )
    known = tables.vocabulary.group_of(F.col("name"), form="coverage")
    missing = F.when(known.isNull(), F.struct("ord", "name"))
    # column names of the tables: schema-sized
    listed = names.agg(F.transform(F.sort_array(F.collect_list(missing)), lambda x: x["name"]).alias("unrecognized_columns"))
    counted = name_coverage(names, "name", tables.vocabulary, threshold)
    return counted.withColumn("__k", F.lit(1)).join(listed.withColumn("__k", F.lit(1)), "__k").drop("__k")


def name_coverage(names: DataFrame, name: str, vocabulary: Vocabulary, threshold: float = 0.60, groups: Sequence[str] = ()) -> DataFrame:
    """Recognised share of the names in a table of names, per group."""
    known = vocabulary.group_of(F.col(name), form="coverage")
    n, k = F.count(F.lit(1)), F.count(known)
    share = F.when(n > 0, k / n).otherwise(1.0)
    return names.groupBy(*groups).agg(
        n.alias("total_columns"), k.alias("recognized"), share.alias("coverage"), (share >= threshold).alias("passes_threshold")
    )


def unrecognized_names(names: DataFrame, name: str, vocabulary: Vocabulary, groups: Sequence[str] = ()) -> DataFrame:
    """The distinct names the vocabulary does not recognise, per group."""
    unknown = vocabulary.group_of(F.col(name), form="coverage").isNull()
    return names.where(unknown).select(*groups, name).distinct()
