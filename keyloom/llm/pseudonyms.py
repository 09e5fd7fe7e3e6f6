"""Format-preserving pseudonyms for personal data, in DataFrame and SQL functions only.

Numbers and dates are found by pattern, validated, and replaced by a keyed permutation of
their own format, a Feistel network: equal values get equal pseudonyms in every document,
different ones different pseudonyms, and nothing but the key leads back.

    card      13 to 19 digits with a valid check digit; the new one is valid too
    iban      valid check digits; country and layout stay, the new check digits are valid
    ssn       valid area, group and serial; permuted among the valid ones
    phone     national digits, after a country code or trunk zero if there is one; national numbers
              of 10 or 11 digits in the usual British, French and German groups
    ip        four octets, permuted among all addresses
    date      yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy, 1900 to 2099, and mm/dd/yyyy where the second number
              can't be a month; days up to the 12th are permuted among themselves, later ones too
    email     letters and digits of the part before the @; case is kept and does not matter
    secret    32 or more hexadecimal digits of both kinds

Digits and letters are permuted apart from the blanks and marks between them, so a value written in
another layout gets the same pseudonym in that layout.
What fails its validation (a number with a wrong check digit, 31 February) stays as it is.

Two networks: on texts, either half's letters and digits are shifted, within their own kind, by
what a hash of the other half gives; on numbers below a x b, the two digits to these
bases are.  Both are permutations of their domain whatever the hash.

Defined results: a null text stays null and an empty one empty; a value may meet itself by chance;
repeated rows are replaced alike; an empty table stays empty; only the text column is read.  Repetitions in the
patterns are possessive or bounded, so no text is too long for the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.textops import spare_name

ROUNDS = 8
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: In the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _END,
    "date": r"(?<![\p{L}\p{N}./-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}/\d{2}/(?:19|20)\d{2}|\d{2}\.\d{2}\.(?:19|20)\d{2})(?![\p{L}\p{N}/-])",
    "ip": r"(?<![\p{L}\p{N}.])" + rf"(?:{_OCTET}\.)" + "{3}" + _OCTET + r"(?![\p{L}\p{N}]|\.\d)",
    "phone": _EDGE
    + r"(?:(?<!\d[ .-])0(?:[1-9](?:[ .-]\d\d){4}|\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|\d{2,4}[ /-]\d{6,8})(?![ .-]\d)"
    + r"|\+?\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|\+\d{1,3}(?:[ .-]?\d){8,11})"
    + r"(?![\p{L}\p{N}]|-\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "card": _EDGE + r"(?<!\d\.)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})" + _END,
    "secret": _EDGE + r"(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,128}" + _END + "|" + _EDGE + r"(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{32,128}" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Country codes of one and of two digits; all others have three.
COUNTRY = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: What every pattern needs; texts without it are not searched.
NEEDED = r"[0-9@]"


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chars(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).', 0)"


def _shift(x: str, hash_: str, hexadecimal: bool) -> str:
    """``x`` with every letter and digit shifted, within its kind, by two digits of a hash."""

    def turn(alphabet: str, place: str) -> str:
        return f"substr('{alphabet}', ({place} + k) % {len(alphabet)} + 1, 1)"

    if hexadecimal:
        cases = f"""
          WHEN instr('0123456789abcdef', c) > 0 THEN {turn('0123456789abcdef', "instr('0123456789abcdef', c) - 1")}
          WHEN instr('0123456789ABCDEF', c) > 0 THEN {turn('0123456789ABCDEF', "instr('0123456789ABCDEF', c) - 1")}"""
    else:
        cases = f"""
          WHEN c >= '0' AND c <= '9' THEN {turn('0123456789', 'ascii(c) - 48')}
          WHEN c >= 'a' AND c <= 'z' THEN {turn('abcdefghijklmnopqrstuvwxyz', 'ascii(c) - 97')}
          WHEN c >= 'A' AND c <= 'Z' THEN {turn('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ascii(c) - 65')}"""
    digits = f"cast(conv(substr({hash_}, (i % 32) * 2 + 1, 2), 16, 10) AS int)"
    one = f"element_at(transform(array({digits}), k -> CASE {cases} ELSE c END), 1)"
    return f"array_join(transform({_chars(x)}, (c, i) -> {one}), '')"


def _poured(new: str, layout: str, kind: str = "[0-9]") -> str:
    """``layout`` with its characters of a kind replaced, in turn, by those of ``new``."""
    step = f"IF(c RLIKE '{kind}', named_struct('t', concat(s.t, substr({new}, s.k + 1, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, c), 'k', s.k))"
    return f"aggregate({_chars(layout)}, named_struct('t', '', 'k', 0), (s, c) -> {step}, s -> s.t)"


def _permuted_text(x: str, label: str, key: str, hexadecimal: bool = False, fold: bool = False) -> str:
    """A permutation of texts with letters and digits at the places of ``x``; with ``fold`` the same one for either case."""
    half = f"cast(length({x}) / 2 AS int)"
    start = f"named_struct('l', substr({x}, 1, {half}), 'r', substr({x}, {half} + 1))"

    def mixed(other: str) -> str:
        return f"sha2(concat_ws('|', {_sql(key)}, '{label}', j, {f'lower({other})' if fold else other}), 256)"

    # the hash is made once a half: bound to a name by a transform over one element
    step_l = f"element_at(transform(array({mixed('s.r')}), h -> {_shift('s.l', 'h', hexadecimal)}), 1)"
    step_r = f"element_at(transform(array({mixed('s.l')}), h -> {_shift('s.r', 'h', hexadecimal)}), 1)"
    step = f"IF(j % 2 = 1, named_struct('l', {step_l}, 'r', s.r), named_struct('l', s.l, 'r', {step_r}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, j) -> {step}, s -> concat(s.l, s.r))"


def _permuted_number(x: str, a: int, b: int, label: str, key: str) -> str:
    """A permutation of 0 .. a * b - 1."""

    def mixed(other: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, '{label}', j, {other}), 256), 1, 14), 16, 10) AS bigint)"

    start = f"named_struct('l', cast({x} AS bigint) DIV {b}, 'r', cast({x} AS bigint) % {b})"
    step = f"IF(j % 2 = 1, named_struct('l', (s.l + {mixed('s.r')} % {a}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {mixed('s.l')} % {b}) % {b}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, j) -> {step}, s -> s.l * {b} + s.r)"


def _luhn(digits: str, doubled: int) -> str:
    """Sum of a number's digits from the right, every second one doubled, from place ``doubled`` on."""
    value = f"IF(i % 2 = {doubled}, 2 * cast(c AS int), cast(c AS int))"
    return f"aggregate(transform({_chars(f'reverse({digits})')}, (c, i) -> {value} - IF({value} > 9, 9, 0)), 0, (n, x) -> n + x)"


def _remainder(x: str) -> str:
    """An account number, letters as 10 to 35, modulo 97."""
    step = "IF(c >= '0' AND c <= '9', (n * 10 + cast(c AS int)) % 97, (n * 100 + ascii(c) - 55) % 97)"
    return f"aggregate({_chars(x)}, 0, (n, c) -> {step})"


def _card(key: str) -> tuple[str, str]:
    plain = "regexp_replace(m, '[^0-9]', '')"
    body = _permuted_text(f"substr({plain}, 1, length({plain}) - 1)", "card", key)
    check = "cast((10 - " + _luhn("b", 0) + " % 10) % 10 AS string)"
    return f"{_luhn(plain, 1)} % 10 = 0", f"element_at(transform(transform(array({body}), b -> concat(b, {check})), n -> {_poured('n', 'm')}), 1)"


def _iban(key: str) -> tuple[str, str]:
    plain = "replace(m, ' ', '')"
    body = _permuted_text(f"substr({plain}, 5)", "iban", key)
    check = "lpad(cast(98 - " + _remainder("concat(b, substr(m, 1, 2), '00')") + " AS string), 2, '0')"
    valid = _remainder(f"concat(substr({plain}, 5), substr({plain}, 1, 4))") + " = 1"
    new = f"transform(transform(array({body}), b -> concat(substr(m, 1, 2), {check}, b)), n -> {_poured('n', 'm', '[A-Z0-9]')})"
    return f"length({plain}) BETWEEN 15 AND 34 AND {valid}", f"element_at({new}, 1)"


def _phone(key: str) -> tuple[str, str]:
    """National digits from the first that is no zero, permuted among those that begin with none."""
    lead = rf"regexp_extract(m, '^((?:[+]?[0-9]{{1,3}}[ .-]?(?=[(])|[+](?:{COUNTRY})[ .-]?)?[(]?0*)', 1)"
    rest = f"substr(m, length({lead}) + 1)"
    once = _permuted_text("d", "phone", key)
    walk = f"aggregate(sequence(1, 100), regexp_replace({rest}, '[^0-9]', ''), (d, w) -> IF(w > 1 AND d NOT LIKE '0%', d, {once}))"
    return "true", f"concat({lead}, element_at(transform(array({walk}), n -> {_poured('n', rest)}), 1))"


def _ssn(key: str) -> tuple[str, str]:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""
    area, group, serial = ("cast(substr(m, 1, 3) AS int)", "cast(substr(m, 5, 2) AS int)", "cast(substr(m, 8, 4) AS int)")
    number = f"(({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1) * 9999 + {serial} - 1"
    new = _permuted_number(number, 898 * 99, 9999, "ssn", key)
    place = "n DIV (99 * 9999)"
    parts = f"lpad(cast({place} + IF({place} + 1 >= 666, 2, 1) AS string), 3, '0'), lpad(cast((n DIV 9999) % 99 + 1 AS string), 2, '0'), lpad(cast(n % 9999 + 1 AS string), 4, '0')"
    return f"{area} BETWEEN 1 AND 899 AND {area} != 666 AND {group} > 0 AND {serial} > 0", f"element_at(transform(array({new}), n -> concat_ws('-', {parts})), 1)"


def _ip(key: str) -> tuple[str, str]:
    number = "aggregate(split(m, '[.]'), cast(0 AS bigint), (n, c) -> n * 256 + cast(c AS bigint))"
    new = _permuted_number(number, 1 << 16, 1 << 16, "ip", key)
    return "true", f"element_at(transform(array({new}), n -> concat_ws('.', n DIV 16777216, (n DIV 65536) % 256, (n DIV 256) % 256, n % 256)), 1)"


def _date(layout: str, key: str) -> tuple[str, str]:
    """73,049 days = 17 x 4297, permuted until a day comes that is as surely not a month: month-first stays so."""
    day = f"to_date(try_to_timestamp(m, '{layout}'))"
    late = "(day(date_add(DATE'1900-01-01', cast({} AS int))) > 12)"
    once = _permuted_number("d", 17, 4297, "date", key)
    walk = f"aggregate(sequence(1, 200), cast(datediff({day}, DATE'1900-01-01') AS bigint), (d, w) -> IF(w > 1 AND {late.format('d')} = (day({day}) > 12), d, {once}))"
    return f"coalesce({day} BETWEEN DATE'1900-01-01' AND DATE'2099-12-31' AND date_format({day}, '{layout}') = m, false)", f"date_format(date_add(DATE'1900-01-01', cast({walk} AS int)), '{layout}')"


def _replacement(key: str) -> str:
    """SQL of struct(kind, text) for a match ``m``; kind is null where it is not valid."""
    email = f"concat({_permuted_text('''substring_index(m, '@', 1)''', 'email', key, fold=True)}, '@', substring_index(m, '@', -1))"
    dates = [("^....-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("[.]", "dd.MM.yyyy")]
    whole = {k: f"m RLIKE {_sql('^(?:' + p + ')$')}" for k, p in PATTERNS.items()}
    cases = [(whole["email"], "email", "true", email), (whole["iban"], "iban", *_iban(key))]
    cases.append((f"{whole['date']} AND m RLIKE '^../(1[3-9]|[2-9][0-9])/'", "date", *_date("MM/dd/yyyy", key)))
    cases += [(f"{whole['date']} AND m RLIKE '{p}'", "date", *_date(layout, key)) for p, layout in dates]
    cases += [(whole["ip"], "ip", *_ip(key)), (whole["phone"], "phone", *_phone(key)), (whole["ssn"], "ssn", *_ssn(key)), (whole["card"], "card", *_card(key))]
    cases.append((whole["secret"], "secret", "true", _permuted_text("m", "secret", key, hexadecimal=True)))
    when = " ".join(f"WHEN {test} THEN IF({valid}, struct('{kind}' AS kind, {new} AS text), {{same}})" for test, kind, valid, new in cases)
    same = "struct(cast(NULL AS string) AS kind, m AS text)"
    return f"CASE {when} ELSE {same} END".replace("{same}", same)


def _matches(text: Column) -> Column:
    return F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pseudonymize(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with pseudonyms in its texts, and ``kinds`` (the kind of each, in order) added.

    A new name that ``df`` already has gets an underscore at its end.
    """
    kinds = spare_name(df.columns, "kinds")
    names = [spare_name([*df.columns, kinds], c) for c in ("pii_matches", "pii_new")]
    text = F.col(f"`{text_col}`")
    out = df.withColumn(names[0], _matches(text))
    out = out.withColumn(names[1], F.expr(f"transform(`{names[0]}`, m -> {_replacement(key)})"))
    rest = F.split(text, ANY, -1)
    # the texts between matches, one more than those, each followed by what takes the place of a match
    new = F.array_join(F.zip_with(rest, F.transform(F.col(names[1]), lambda x: x["text"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = out.withColumn(kinds, F.filter(F.transform(F.col(names[1]), lambda x: x["kind"]), lambda k: k.isNotNull()))
    return out.withColumn(text_col, F.when(F.size(names[0]) > 0, new).otherwise(text)).drop(*names)
