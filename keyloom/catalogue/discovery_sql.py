"""SQL for the discovery queries, on its own: nothing here comes from the code it checks.

Name ratios are computed by a recursive CTE over the tables' column names; the vocabulary
groups of those few names, type rules and patterns are written out.
"""

from __future__ import annotations

from itertools import combinations

# Which column names of the given tables fall in a vocabulary group, the score that a
# common group gives at least, accepted type pairs besides equal ones, and the value patterns.
GROUP_OF = {
    "p_brand": "natureza_despesa",
    "l_extendedprice": "natureza_despesa",
    "l_linenumber": "empenho",
    "l_linestatus": "empenho",
}
SAME_GROUP = 0.75
ACCEPTED = {
    ("object", "category"), ("int64", "int32"), ("int64", "float64"), ("int64", "object"),
    ("float64", "int64"), ("float64", "object"), ("category", "object"),
}
PATTERNS = {
    "empenho": r"^\d{4}NE\d{6}$",
    "convenio": r"^\d{6}/\d{4}$",
    "cpf": r"^\d{3}\.\d{3}\.\d{3}-\d{2}$",
    "cnpj": r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$",
    "orgao": r"^\d{5}$",
    "uo": r"^\d{5}$",
    "exercicio": r"^\d{4}$",
}

# The given tables' columns with their type families.
COLUMNS = {
    "region": {"r_regionkey": "int64", "r_name": "object"},
    "nation": {"n_nationkey": "int64", "n_name": "object", "n_regionkey": "int64"},
    "customer": {"c_custkey": "int64", "c_name": "object", "c_nationkey": "int64", "c_acctbal": "float64", "c_mktsegment": "object"},
    "supplier": {"s_suppkey": "int64", "s_name": "object", "s_nationkey": "int64", "s_acctbal": "float64"},
    "part": {"p_partkey": "int64", "p_name": "object", "p_brand": "object", "p_type": "object", "p_size": "int64", "p_retailprice": "float64"},
    "orders": {
        "o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "object",
    },
    "lineitem": {
        "l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int64", "l_quantity": "float64",
        "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64", "l_returnflag": "object",
        "l_linestatus": "object", "l_shipdate": "timestamp_ntz",
    },
}
KEYS = {
    "orders": ["o_orderkey"],
    "customer": ["c_custkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey"],
    "nation": ["n_nationkey"],
    "region": ["r_regionkey"],
}


def match_form(column: str) -> str:
    """A column name as it is compared: lower case, runs of other characters as one underscore, none at the ends."""
    return rf"trim(regexp_replace(lower(trim({column})), '[^a-z0-9]+', '_', 'g'), '_')"


def ratio_ctes(source: str) -> str:
    """``ratios(x, y, ratio)`` of the distinct texts x, y in ``source``, by the recursion over longest common blocks."""
    block = """list_max(flatten([[ {'k': coalesce(list_max([k FOR k IN range(1, least(ah - i, bh - j) + 1) IF substr(x, i + 1, k) = substr(y, j + 1, k)]), 0),
        'i': -i, 'j': -j} FOR j IN range(bl, bh)] FOR i IN range(al, ah)]))"""
    return f"""texts AS (SELECT DISTINCT x, y FROM {source}),
    parts AS (
      SELECT x, y, 0::BIGINT AS al, length(x)::BIGINT AS ah, 0::BIGINT AS bl, length(y)::BIGINT AS bh FROM texts
      UNION ALL
      SELECT x, y, s.al, s.ah, s.bl, s.bh FROM (
        SELECT x, y, unnest([{{'al': al, 'ah': -m.i, 'bl': bl, 'bh': -m.j}}, {{'al': m.k - m.i, 'ah': ah, 'bl': m.k - m.j, 'bh': bh}}]) AS s
        FROM (SELECT *, {block} AS m FROM parts) WHERE m.k > 0)
      WHERE s.al < s.ah AND s.bl < s.bh),
    ratios AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * sum(coalesce(({block}).k, 0)) / (length(x) + length(y)) END AS ratio
      FROM parts GROUP BY x, y)"""


def names_cte(tables: list[str]) -> str:
    """``names``: all column pairs of the tables with name and type scores."""
    rows = []
    for a, b in combinations(tables, 2):
        for i, (ca, fa) in enumerate(COLUMNS[a].items()):
            for j, (cb, fb) in enumerate(COLUMNS[b].items()):
                fits = 1.0 if fa == fb or (fa, fb) in ACCEPTED else 0.0
                groups = ", ".join(f"'{GROUP_OF[c]}'" if c in GROUP_OF else "NULL::VARCHAR" for c in (ca, cb))
                rows.append(f"('{a}', '{ca}', {i}, '{fa}', '{b}', '{cb}', {j}, '{fb}', {groups}, {fits}::DOUBLE)")
    return f"""asked(table_a, column_a, ord_a, family_a, table_b, column_b, ord_b, family_b, group_a, group_b, type_score) AS (VALUES {', '.join(rows)}),
    forms_of AS (SELECT *, {match_form('column_a')} AS x, {match_form('column_b')} AS y FROM asked),
    {ratio_ctes('forms_of')},
    names AS (SELECT table_a, column_a, ord_a, family_a, group_a, table_b, column_b, ord_b, family_b, group_b,
        CASE WHEN group_a = group_b THEN greatest(ratio, {SAME_GROUP}) ELSE ratio END AS semantic, type_score FROM forms_of JOIN ratios USING (x, y))"""


AFFINITY_CTE = """near AS (SELECT table_a, table_b, round(avg(semantic), 4) AS affinity, round(avg(semantic), 4) >= 0.45 AS kept
    FROM (SELECT *, row_number() OVER (PARTITION BY table_a, table_b ORDER BY semantic DESC, ord_a, ord_b) AS r FROM names) WHERE r <= 3 GROUP BY 1, 2)"""


def affinity_sql(tables: list[str]) -> str:
    counts = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in tables)
    return f"""WITH RECURSIVE {names_cte(tables)}, {AFFINITY_CTE}, counts AS ({counts})
    SELECT table_a, table_b, affinity, kept, a.n AS rows_a, b.n AS rows_b FROM near JOIN counts a ON table_a = a.t JOIN counts b ON table_b = b.t"""


def _text(column: str, family: str) -> str:
    if family == "float64":
        return f"CASE WHEN {column} = TRY_CAST({column} AS BIGINT) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END"
    return f"CAST({column} AS VARCHAR)"


def _form(text: str, family: str) -> str:
    return text if family in ("int64", "float64") else f"regexp_replace(upper(trim({text})), '[.\\-/\\s]', '', 'g')"


def _values(tables: list[str]) -> str:
    """Long form (t, c, v, f): value text and match form of all rows."""
    parts = []
    for t in tables:
        for c, family in COLUMNS[t].items():
            text = _text(c, family)
            parts.append(f"SELECT '{t}' AS t, '{c}' AS c, {text} AS v, {_form(text, family)} AS f FROM {t}")
    return " UNION ALL ".join(parts)


def _best_pattern() -> str:
    shares = {p: f"avg(CASE WHEN regexp_matches(v, '{rx}') THEN 1.0 ELSE 0.0 END)" for p, rx in PATTERNS.items()}
    top = f"greatest({', '.join(shares.values())})"
    cases = " ".join(f"WHEN {s} = {top} THEN '{p}'" for p, s in shares.items())
    return f"CASE WHEN {top} > 0.5 THEN CASE {cases} END END"


def evidence_ctes(tables: list[str]) -> str:
    """CTEs up to ``pairs``: every column pair with name, content and overlap signals."""
    return f"""{names_cte(tables)}, {AFFINITY_CTE},
    everything AS ({_values(tables)}),
    pat AS (SELECT t, c, {_best_pattern()} AS pattern, coalesce(avg(length(v)), 0) AS len, 1 - count(v) / count(*) AS nulls FROM everything GROUP BY 1, 2),
    facts AS (SELECT t, c, count(*) AS n, count(DISTINCT v) AS raw, count(DISTINCT f) AS forms FROM everything GROUP BY 1, 2),
    forms AS (SELECT DISTINCT t, c, f FROM everything),
    shared AS (SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, count(*) AS n FROM forms a JOIN forms b ON a.f = b.f AND a.t <> b.t GROUP BY ALL),
    vals AS (SELECT DISTINCT t, c, v FROM everything),
    val_counts AS (SELECT t, c, count(*) AS n FROM vals GROUP BY 1, 2),
    lens AS (SELECT DISTINCT length(v) AS l FROM vals),
    cuts AS (SELECT DISTINCT t, c, substr(v, i, l) AS s FROM (SELECT t, c, v, l, unnest(range(1, length(v) - l + 2)) AS i FROM vals, lens WHERE l <= length(v))),
    inside AS (SELECT it, ic, ot, oc, x.n / k.n AS share FROM
        (SELECT i.t AS it, i.c AS ic, o.t AS ot, o.c AS oc, count(*) AS n FROM vals i JOIN cuts o ON i.v = o.s AND i.t <> o.t GROUP BY ALL) x
        JOIN val_counts k ON k.t = it AND k.c = ic),
    signals AS (SELECT m.*, pa.pattern AS pattern_a, pb.pattern AS pattern_b, pa.pattern AS format_a, pb.pattern AS format_b, pa.len AS len_a, pb.len AS len_b, pa.nulls AS nulls_a, pb.nulls AS nulls_b, coalesce(pa.pattern = pb.pattern, false) AS format_match,
        round(coalesce(s.n, 0) / fa.forms, 4) AS overlap_rate, round(greatest(coalesce(ab.share, 0), coalesce(ba.share, 0)), 4) AS substring_match_rate,
        fa.forms AS unique_a, fb.forms AS unique_b, coalesce(s.n, 0) AS intersection, coalesce(s.n, 0) / fa.forms AS match_rate_a_in_b, coalesce(s.n, 0) / fb.forms AS match_rate_b_in_a,
        greatest(fa.raw / fa.n, fb.raw / fb.n) AS uniqueness
      FROM names m JOIN pat pa ON m.table_a = pa.t AND m.column_a = pa.c JOIN pat pb ON m.table_b = pb.t AND m.column_b = pb.c
      JOIN facts fa ON m.table_a = fa.t AND m.column_a = fa.c JOIN facts fb ON m.table_b = fb.t AND m.column_b = fb.c
      LEFT JOIN shared s USING (table_a, column_a, table_b, column_b)
      LEFT JOIN inside ab ON ab.it = m.table_a AND ab.ic = m.column_a AND ab.ot = m.table_b AND ab.oc = m.column_b
      LEFT JOIN inside ba ON ba.it = m.table_b AND ba.ic = m.column_b AND ba.ot = m.table_a AND ba.oc = m.column_a),
    pairs AS (SELECT *, round(CASE WHEN format_match THEN greatest(overlap_rate, substring_match_rate)
        ELSE greatest(0.6 * overlap_rate + 0.4 * substring_match_rate, 0.8 * substring_match_rate) END, 4) AS content FROM signals)"""


RESULT_COLUMNS = [
    "table_a", "column_a", "table_b", "column_b", "discovery_method", "semantic", "type_score", "match_rate",
    "content_score", "cardinality", "pattern_a", "score", "rank", "decision",
]


def _ranked(tables: list[str], by_affinity: bool = False) -> str:
    by_name = "semantic >= 0.3 AND kept" if by_affinity else "semantic >= 0.3"
    return f"""WITH RECURSIVE {evidence_ctes(tables)},
    judged AS (SELECT p.*, {by_name} AS named FROM pairs p JOIN near USING (table_a, table_b)),
    scored AS (SELECT *, CASE WHEN named THEN 'semantic' ELSE 'content' END AS discovery_method,
        CASE WHEN NOT named THEN content END AS content_score,
        CASE WHEN uniqueness > 0.95 THEN 'high (near-unique)' WHEN uniqueness > 0.5 THEN 'medium' ELSE 'low (repetitive)' END AS cardinality,
        round(0.35 * CASE WHEN named THEN semantic ELSE content END + 0.30 * match_rate
          + 0.20 * type_score + 0.15 * CASE WHEN pattern_a IS NOT NULL THEN 1.0 ELSE 0.0 END, 4) AS score
      FROM (SELECT *, CASE WHEN named THEN match_rate_a_in_b ELSE overlap_rate END AS match_rate FROM judged WHERE named OR content >= 0.5)),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY table_a, table_b ORDER BY score DESC, ord_a, ord_b) AS INTEGER) AS rank FROM scored)"""


def candidates_sql(tables: list[str], by_affinity: bool = False, where: str = "true") -> str:
    return f"""{_ranked(tables, by_affinity)}
    SELECT {', '.join(c for c in RESULT_COLUMNS if c != 'decision')}, CASE WHEN rank = 1 THEN 'accepted' ELSE 'candidate' END AS decision
    FROM ranked WHERE rank <= 10 AND {where}"""


def _texts(*cases: str) -> str:
    return f"array_to_string([x FOR x IN [{', '.join(cases)}] IF x IS NOT NULL], ',')"


# The evidence texts, in their order.
_MISMATCH = "CASE WHEN type_score = 0 THEN format('Incompatible dtypes: {} vs {}', family_a, family_b) END"
_CAST = "CASE WHEN type_score = 0 THEN format('Cast {} ({}) to {} before join', column_b, family_b, family_a) END"
_FOR_NAMED = _texts(
    "CASE WHEN semantic >= 0.8 THEN format('High name similarity ({:.2f}): ''{}'' ~ ''{}''', semantic, column_a, column_b) WHEN semantic >= 0.5 THEN format('Moderate name similarity ({:.2f})', semantic) END",
    "CASE WHEN group_a = group_b THEN format('Both columns belong to domain group ''{}''', group_a) END",
    "CASE WHEN match_rate >= 0.8 THEN format('High match rate: {:.1f}% of values in A found in B', match_rate * 100) WHEN match_rate >= 0.5 THEN format('Moderate match rate: {:.1f}%', match_rate * 100) END",
    "CASE WHEN pattern_a = pattern_b THEN format('Both match domain pattern ''{}''', pattern_a) END",
)
_AGAINST_NAMED = _texts(
    "CASE WHEN match_rate < 0.5 THEN format('Low match rate: {:.1f}%', match_rate * 100) END",
    _MISMATCH,
    "CASE WHEN nulls_a > 0.2 THEN format('High null rate in {}: {:.1f}%', column_a, nulls_a * 100) END",
    "CASE WHEN nulls_b > 0.2 THEN format('High null rate in {}: {:.1f}%', column_b, nulls_b * 100) END",
    "CASE WHEN pattern_a <> pattern_b THEN format('Pattern mismatch: ''{}'' vs ''{}''', pattern_a, pattern_b) END",
    "CASE WHEN abs(len_a - len_b) > 3 THEN format('Avg value length differs: {:.1f} vs {:.1f}', len_a, len_b) END",
)
_STEPS_NAMED = _texts(_CAST, "CASE WHEN abs(len_a - len_b) > 3 THEN 'Check if padding (zfill) or trimming is needed' END")
_FOR_CONTENT = _texts(
    "format('Content-promoted: content_score={:.3f} >= 0.5', content_score)",
    "CASE WHEN format_match THEN format('Format match: both columns match pattern ''{}''', format_a) END",
    "CASE WHEN overlap_rate >= 0.5 THEN format('Value overlap: {:.1f}% of A values found in B', overlap_rate * 100) END",
    "CASE WHEN substring_match_rate >= 0.5 THEN format('Substring relation detected: rate={:.2f} (possible Derived Key)', substring_match_rate) END",
)
_AGAINST_CONTENT = _texts(
    "format('Low name similarity ({:.2f}): ''{}'' vs ''{}''', semantic, column_a, column_b)",
    "CASE WHEN NOT format_match THEN format('Format mismatch: ''{}'' vs ''{}''', coalesce(format_a, 'None'), coalesce(format_b, 'None')) END",
    _MISMATCH,
)
_STEPS_CONTENT = _texts("CASE WHEN substring_match_rate >= 0.5 THEN 'Investigate substring/concatenation transform to align keys' END", _CAST)


def evidence_sql(tables: list[str]) -> str:
    """The evidence texts of every candidate."""
    return f"""{_ranked(tables)}
    SELECT table_a, column_a, table_b, column_b, rank, CASE WHEN named THEN {_FOR_NAMED} ELSE {_FOR_CONTENT} END AS evidence_for,
      CASE WHEN named THEN {_AGAINST_NAMED} ELSE {_AGAINST_CONTENT} END AS evidence_against,
      CASE WHEN named THEN {_STEPS_NAMED} ELSE {_STEPS_CONTENT} END AS required_transformations FROM ranked WHERE rank <= 10"""


def decision_sql(tables: list[str]) -> str:
    return f"""SELECT table_a, column_a, table_b, column_b, score AS confidence,
      'Best candidate: [''' || column_a || '''] ↔ [''' || column_b || '''] (score=' || score || ')' AS summary FROM ({candidates_sql(tables, where='rank = 1')})"""


COMPARE_COLUMNS = [
    "table_a", "column_a", "table_b", "column_b", "semantic", "type_score", "format_match", "overlap_rate", "substring_match_rate",
    "content_score", "unique_a", "unique_b", "intersection", "match_rate_a_in_b", "match_rate_b_in_a",
]


def compare_sql(tables: list[str], column_a: str, column_b: str) -> str:
    shown = ", ".join("content AS content_score" if c == "content_score" else c for c in COMPARE_COLUMNS)
    return f"WITH RECURSIVE {evidence_ctes(tables)} SELECT {shown} FROM pairs WHERE column_a = '{column_a}' AND column_b = '{column_b}'"


def auto_pairs_sql(tables: list[str]) -> str:
    unique = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) / count(*) AS u FROM {t}" for t in tables for c in COLUMNS[t]
    )
    return f"""WITH RECURSIVE {names_cte(tables)}, keys AS (SELECT t, c FROM ({unique}) WHERE u > 0.95)
    SELECT table_a, column_a, table_b, column_b, semantic FROM names WHERE semantic >= 0.3
      AND (table_a, column_a) IN (SELECT (t, c) FROM keys) AND (table_b, column_b) IN (SELECT (t, c) FROM keys)
    ORDER BY semantic DESC, table_a, table_b, ord_a, ord_b LIMIT 15"""
