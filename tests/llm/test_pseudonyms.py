import hashlib
import ipaddress
import re
from datetime import date, timedelta

from keyloom.llm import pseudonyms

KEY = "a key for tests"


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], list(r["kinds"] or [])) for r in pseudonyms.pseudonymize(df, key).orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


CASES = [
    ("card", "4111111111111111", lambda s: luhn(s) and re.fullmatch(r"\d{16}", s)),
    ("card", "4111-1111-1111-1111", lambda s: luhn(s) and re.fullmatch(r"\d{4}(-\d{4}){3}", s)),
    ("card", "378282246310005", lambda s: luhn(s) and len(s) == 15),
    ("iban", "DE89370400440532013000", lambda s: iban_ok(s) and s.startswith("DE") and len(s) == 22),
    ("iban", "GB82 WEST 1234 5698 7654 32", lambda s: iban_ok(s) and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", s)),
    ("ssn", "123-45-6789", lambda s: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s)),
    ("phone", "+1 (017) 555-7713", lambda s: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", s)),
    ("phone", "212-555-0123", lambda s: re.fullmatch(r"\d{3}-\d{3}-\d{4}", s)),
    ("ip", "97.51.17.173", lambda s: ipaddress.ip_address(s)),
    ("date", "1987-06-05", lambda s: date(1900, 1, 1) <= date.fromisoformat(s) < date(2100, 1, 1)),
    ("date", "05/06/1987", lambda s: re.fullmatch(r"\d\d/\d\d/(19|20)\d\d", s)),
    ("date", "05.06.1987", lambda s: re.fullmatch(r"\d\d\.\d\d\.(19|20)\d\d", s)),
    ("email", "desleleenpa.90@mail2.example.com", lambda s: re.fullmatch(r"[a-z]{11}\.\d\d@mail2\.example\.com", s)),
    ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962", lambda s: re.fullmatch(r"[0-9a-f]{40}", s)),
]


def test_every_kind_keeps_its_format(spark):
    got = run(spark, [c[1] for c in CASES] + [f"é {c[1]}, x {c[1]}. {c[1]}!!" for c in CASES] + [f"({c[1]})%%%" for c in CASES])
    for (kind, value, ok), (new, kinds), (inside, many), (wrapped, one) in zip(CASES, got, got[len(CASES) :], got[2 * len(CASES) :]):
        assert kinds == [kind] and new != value and ok(new), (kind, value, new)
        assert inside == f"é {new}, x {new}. {new}!!" and many == [kind] * 3
        assert wrapped == f"({new})%%%" and one == [kind]
    other = run(spark, [c[1] for c in CASES], "another key")
    assert sum(a == b for (a, _), (b, _) in zip(got, other)) == 0


def test_what_is_not_valid_stays(spark):
    texts = [
        "4111111111111112 41111111111111111111 x4111111111111111 3.1415926535897932",
        "DE88370400440532013000",
        "000-12-3456 666-12-3456 912-12-3456 123-00-4567 123-45-0000",
        "256.1.1.1 1.2.3 1.2.3.4.5 01.2.3.4",
        "1987-02-31 1887-06-05 31/02/1987 2020-13-01",
        "plain words @ 12 a@b 1,234 §5",
        "",
        None,
    ]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_several_kinds_in_a_text_and_adjacent(spark):
    text = "a +1 (017) 555-7713 4111111111111111 378282246310005 97.51.17.173\n1987-06-05 end"
    new, kinds = run(spark, [text])[0]
    assert kinds == ["phone", "card", "card", "ip", "date"]
    assert new.startswith("a +1 (") and new.endswith(" end") and len(new.split()) == len(text.split())


def test_permutations(spark):
    """No two values share a pseudonym: all days, all three-letter and two-digit names, some numbers."""
    days = [(date(1900, 1, 1) + timedelta(k)).isoformat() for k in range(0, 73049)]
    out = [r[0] for r in pseudonyms.pseudonymize(spark.createDataFrame([(d,) for d in days], "text string"), KEY).select("text").collect()]
    assert sorted(out) == days
    names = [f"{a}{b}.{c}@x.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in range(10)]
    out = [r[0] for r in pseudonyms.pseudonymize(spark.createDataFrame([(d,) for d in names], "text string"), KEY).select("text").collect()]
    assert sorted(out) == names


def test_edge_cases(edge, empty):
    before = {(r["doc_id"], r["text"]) for r in edge.collect()}
    got = pseudonyms.pseudonymize(edge.withColumnRenamed("source", "kinds"), KEY)
    assert got.columns[-1] == "kinds_"
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == before
    assert pseudonyms.pseudonymize(empty, KEY).count() == 0


def test_documents(documents, texts):
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(documents, KEY).collect()}
    emails = 0
    for i, t in texts.items():
        for m in re.findall(r"[\w.]+@\w+\.example\.com|\+1 \(\d{3}\) 555-\d{4}", t):
            emails += 1
            assert m not in got[i]["text"]
        if not re.search(r"[0-9@]", t):
            assert got[i]["text"] == t and not got[i]["kinds"]
    assert emails


def test_month_first_dates(spark):
    """They keep their layout, and no two share a pseudonym, nor one with a day-first date."""
    days = [d.strftime("%m/%d/%Y") for k in range(73049) if (d := date(1900, 1, 1) + timedelta(k)).day > 12]
    out = [r[0] for r in pseudonyms.pseudonymize(spark.createDataFrame([(d,) for d in days], "text string"), KEY).select("text").collect()]
    assert sorted(out) == sorted(days)
    (new, kinds), (same, none) = run(spark, ["born 03/25/1985, 03/04/1985.", "13/25/1985 02/30/1985 00/14/1985"])
    assert kinds == ["date", "date"] and "03/25/1985" not in new and "03/04/1985" not in new
    assert same == "13/25/1985 02/30/1985 00/14/1985" and not none


def test_very_many_labels(spark):
    """A domain of a million labels neither overflows the stack nor stays in clear."""
    texts = [("a@b" + ".b" * n + " end",) for n in (5_000, 1_000_000)]
    for r in pseudonyms.pseudonymize(spark.createDataFrame(texts, "text string"), "k").collect():
        assert r["kinds"] == ["email"] and r["text"].endswith(".b end")


def test_every_pattern_on_long_texts(spark):
    units = ["1.", "a@", "12 ", "4111", "AB12", "ab1", "(123) ", "+1-", "25.", "19", "12/", "é."]
    for r in pseudonyms.pseudonymize(spark.createDataFrame([(u * (2_000_000 // len(u)),) for u in units], "text string"), "k").collect():
        assert r["text"]


def feistel(text, label, key=KEY, fold=False):
    """The network on texts, written once more, row by row."""
    half = len(text) // 2
    sides = [text[:half], text[half:]]
    for j in range(1, pseudonyms.ROUNDS + 1):
        mine, other = (0, 1) if j % 2 else (1, 0)
        seen = sides[other].lower() if fold else sides[other]
        digest = hashlib.sha256("|".join([key, label, str(j), seen]).encode()).digest()
        out = []
        for i, c in enumerate(sides[mine]):
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and 0 <= ord(c) - ord(first) < size:
                    c = chr(ord(first) + (ord(c) - ord(first) + digest[i % 32]) % size)
                    break
            out.append(c)
        sides[mine] = "".join(out)
    return "".join(sides)


def day_network(day):
    late, n = day.day > 12, (day - date(1900, 1, 1)).days
    while True:
        left, right = divmod(n, 4297)
        for j in range(1, pseudonyms.ROUNDS + 1):
            h = int(hashlib.sha256(f"{KEY}|date|{j}|{right if j % 2 else left}".encode()).hexdigest()[:14], 16)
            left, right = ((left + h) % 17, right) if j % 2 else (left, (right + h) % 4297)
        n = left * 4297 + right
        if ((date(1900, 1, 1) + timedelta(n)).day > 12) == late:
            return date(1900, 1, 1) + timedelta(n)


def test_equals_networks_written_once_more(spark):
    mails = ["ana.lópez_7@x.org", "Q@x.org", "some.Body+tag@mail.example.com"]
    days = [date(1987, 6, 5), date(2001, 12, 31), date(1900, 1, 1), date(2099, 12, 31)]
    phones = ["212-555-0123", "+44 20 7946 0958", "+14155552671"]
    cards = ["4111111111111111", "378282246310005"]
    got = [t for t, _ in run(spark, mails + [d.isoformat() for d in days] + phones + cards)]
    assert got[:3] == [feistel(m.split("@")[0], "email", fold=True) + "@" + m.split("@")[1] for m in mails]
    assert got[3:7] == [day_network(d).isoformat() for d in days]
    for phone, new in zip(["2125550123", "2079460958", "4155552671"], got[7:10]):
        want = feistel(phone, "phone")
        while want[0] == "0":
            want = feistel(want, "phone")
        assert re.sub(r"\D", "", new)[-10:] == want
    for card, new in zip(cards, got[10:]):
        assert new[:-1] == feistel(card[:-1], "card") and luhn(new)


def test_one_value_in_all_its_layouts(spark):
    same = [
        ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
        ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"],
        ["2125550123 x 212-555-0123"[11:], "212.555.0123", "+1 212-555-0123", "+1 (212) 555-0123", "(212) 555-0123", "+12125550123"],
        ["020 7946 0958", "+44 20 7946 0958", "020-7946-0958"],
        ["06 12 34 56 78", "06.12.34.56.78", "+33 6 12 34 56 78", "+33612345678"],
        ["030 1234567", "030/1234567", "+49 30 1234567"],
    ]
    got = iter(run(spark, [v for values in same for v in values]))
    for values in same:
        new = set()
        for v in values:
            text, kinds = next(got)
            assert len(kinds) == 1 and text != v and re.sub(r"[A-Z0-9]", "", text) == re.sub(r"[A-Z0-9]", "", v), (v, text)
            plain = re.sub(r"[^A-Z0-9]", "", text)
            if kinds == ["phone"]:
                plain = re.sub(r"^(\+1|\+44|\+33|\+49|0)", "", re.sub(r"[^+0-9]", "", text))
            new.add(plain)
        assert len(new) == 1, (values, new)
    dates = [t for t, _ in run(spark, ["1990-05-23", "23/05/1990", "23.05.1990", "05/23/1990"])]
    day = date.fromisoformat(dates[0])
    assert dates == [day.strftime(f) for f in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y")]
    (low, _), (high, _) = run(spark, ["ana.k@x.org", "Ana.K@x.org"])
    assert low != "ana.k@x.org" and low == high.lower() and high[0].isupper()


def test_rows_of_numbers_are_no_phones(spark):
    texts = ["01 02 03 04 05 06 07", "12 01 02 03 04 05", "page 012 345", "0.25 0123 45"]
    assert run(spark, texts) == [(t, []) for t in texts]
