import datetime
import re

from lexgrove.llm import pii
from lexgrove.llm.queries import op1_pii_pseudonyms
from tests.llm.conftest import SMALL


def luhn(s):
    return sum((lambda d: d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9))(int(c)) for k, c in enumerate(reversed(s))) % 10 == 0


#: The kinds as plain Python finds them.
PLAIN = {"email": r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", "card": r"(?<!\d)\d{16}(?!\d)", "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}"}


def test_query_replaces_all_and_nothing_else(spark, rows):
    out = {r.doc_id: r for r in op1_pii_pseudonyms(spark, SMALL).collect()}
    assert out.keys() == rows.keys()
    changed = 0
    for i, r in rows.items():
        want = {k: [m for m in re.findall(p, r.text) if k != "card" or luhn(m)] for k, p in PLAIN.items()}
        for kind, found in want.items():
            assert out[i][f"n_{kind}"] == len(found)
            assert not any(v in out[i].text for v in found)
            assert len(re.findall(PLAIN[kind], out[i].text)) >= len(found)
        changed += any(want.values())
        strip = lambda t: re.sub("|".join(PLAIN.values()), "#", t)
        assert strip(out[i].text) == strip(r.text) and (any(want.values()) or out[i].text == r.text)
    assert changed > 5


def values(spark, kind_values):
    df = spark.createDataFrame([(v,) for v in kind_values], "v string")
    return {r.v: (r.kind, r.pseudonym) for r in pii.pseudonyms(df, "k").collect()}


def test_formats_and_validation(spark):
    got = values(spark, ["2024-02-29", "2023-02-29", "31/12/1999", "12/31/1999", "99/99/1999", "078-05-1120", "666-05-1120", "078-00-1120", "256.1.1.1", "10.0.0.255", "4111 1111 1111 1111", "4111111111111112", "378282246310005", "+1 (017) 555-7713", "555-867-5309", "a.b@x.org", "été.12@mail3.example.com"])
    kinds = {v: k for v, (k, _) in got.items()}
    assert kinds == {"2024-02-29": "date", "2023-02-29": None, "31/12/1999": "date", "12/31/1999": "date", "99/99/1999": None, "078-05-1120": "ssn", "666-05-1120": None, "078-00-1120": None, "256.1.1.1": None, "10.0.0.255": "ip", "4111 1111 1111 1111": "card", "4111111111111112": None, "378282246310005": "card", "+1 (017) 555-7713": "phone", "555-867-5309": "phone", "a.b@x.org": "email", "été.12@mail3.example.com": "email"}
    again = values(spark, [p for k, p in got.values() if k])
    for v, (k, p) in got.items():
        assert (p is None) == (k is None)
        if k:
            assert p != v and again[p][0] == k
            if k not in ("ip", "email"):
                assert re.sub(r"\d", "0", p) == re.sub(r"\d", "0", v)


def test_an_accented_address_goes_whole(spark):
    out = pii.pseudonymise(spark.createDataFrame([(1, "Voilà: été.12@mail3.example.com, «ÉTÉ@x.org»")], "doc_id long, text string"), "k").first()
    assert re.fullmatch(r"Voilà: u[0-9a-f]{24}@mail3\.example\.com, «u[0-9a-f]{24}@x\.org»", out.text) and out.n_email == 2


def test_one_to_one_and_keyed(spark):
    days = [f"{y}-{m:02}-{d:02}" for y in range(1990, 2000) for m in range(1, 13) for d in range(1, 29)]
    got = values(spark, days)
    assert len({p for _, p in got.values()}) == len(days)
    other = {r.v: r.pseudonym for r in pii.pseudonyms(spark.createDataFrame([(v,) for v in days], "v string"), "other").collect()}
    assert sum(other[v] == p for v, (_, p) in got.items()) < 5
    small = values(spark, [f"+{n} 20 30 40" for n in range(10, 100)])
    assert len({p for _, p in small.values()}) == 90


def permuted(spark, strings):
    """Whether the pseudonyms of all these values are the same values in another order."""
    got = pii.pseudonyms(spark.createDataFrame([(v,) for v in strings], "v string"), "k").select("v", "pseudonym").collect()
    return {r.pseudonym for r in got} == set(strings) and len(got) == len(set(strings)) and sum(r.v == r.pseudonym for r in got) < 10


def days(first, last):
    day, end = datetime.date(first, 1, 1), datetime.date(last, 12, 31)
    return [day + datetime.timedelta(k) for k in range((end - day).days + 1)]


def text(day, form):
    return form.replace("y", f"{day.year:04}").replace("m", f"{day.month:02}").replace("d", f"{day.day:02}")


def test_dates_are_permuted_in_each_form_up_to_the_first_and_last_year(spark):
    for first, last in ((1, 400), (9601, 9999)):
        every = days(first, last)
        assert permuted(spark, [text(d, "y-m-d") for d in every])
        assert permuted(spark, [text(d, "d/m/y") for d in every] + [text(d, "m/d/y") for d in every if d.day > 12])


def test_octets_keep_their_zeros(spark):
    assert permuted(spark, [f"0{a}.0{b}.0{c}.0{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)])
    got = values(spark, ["010.0.0.1", "10.0.0.1", "10.00.0.1", "0.0.0.0"])
    assert len({p for _, p in got.values()}) == 4 and re.fullmatch(r"0\d\d\.\d+\.\d+\.\d+", got["010.0.0.1"][1])


def test_other_numbers_stay_apart(spark):
    ssn = [f"{a:03}-{b:02}-0001" for a in range(1, 900) if a != 666 for b in range(1, 100, 7)]
    got = {r.pseudonym for r in pii.pseudonyms(spark.createDataFrame([(v,) for v in ssn], "v string"), "k").collect()}
    assert len(got) == len(ssn)


def test_links_and_odd_rows(spark, odd, none):
    both = spark.createDataFrame([(1, "a 4111111111111111, b"), (2, "4111111111111111"), (2, "4111111111111111"), (None, "x 1.2.3.4 1.2.3.4."), (3, None)], "doc_id long, text string")
    out = pii.pseudonymise(both, "k").collect()
    card = next(r.text for r in out if r.doc_id == 2)
    assert next(r.text for r in out if r.doc_id == 1) == f"a {card}, b" and sum(r.doc_id == 2 for r in out) == 2
    ip = next(r for r in out if r.doc_id is None)
    a, b = ip.text[2:-1].split(" ")
    assert a == b != "1.2.3.4" and ip.n_ip == 2
    assert next(r for r in out if r.doc_id == 3).text is None
    same = pii.pseudonymise(odd, "k")
    assert same.columns == [*odd.columns, *(f"n_{k}" for k in pii.KINDS)]
    assert sorted((r.doc_id or 0, r.text or "") for r in same.collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert pii.pseudonymise(none, "k").count() == 0
