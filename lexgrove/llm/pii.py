"""PII: format-preserving Feistel pseudonyms.

One pattern finds candidates; each is validated by its kind (check digits, value ranges, the
calendar) and becomes a pair of numbers below two sizes whose product is exactly the number of
valid values of its format. A keyed Feistel network permutes the pair, and the format is filled
again. So a pseudonym is valid, the mapping permutes the values of each format, and equal values
stay equal across documents. A date is permuted within its 400 years, counted from the year 1 to
9999. What could be read day first is; what can only be read month first, as its day is above 12,
is permuted among such dates. A zero before an octet of an address is part of its format. Mail
addresses have no such format: a keyed digest of 96 bits takes the place of the local part.
Everything is a column expression; a round of the network is a projection, so that its terms
don't multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "date", "ssn", "ip", "card", "phone")
#: What a candidate of each kind looks like.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*?\.[A-Za-z]{2,}+",
    "date": r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{2}/\d{2}/\d{4}(?![\d/])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "card": r"\d{13,19}(?!\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d|[.-]\d)",
}
CANDIDATE = rf"(?<![\p{{L}}\p{{N}}._%+-])(?:{PATTERNS['email']})|(?<![A-Za-z0-9.])(?<!\d[-/])(?:" + "|".join(PATTERNS[k] for k in KINDS[1:]) + ")"
_CYCLE = 146_097  # days of 400 years
_EPOCH = 719_162  # days from 0001-01-01 to 1970-01-01
#: Sizes of the pair for all dates of 400 years, and for those after the 12th of a month; then of the last 399 years, to 9999.
_DAYS, _LATE, _LAST_DAYS, _LAST_LATE = (189, 773), (9, 9833), (93, 1567), (825, 107)
FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _day(v: Column, form: str) -> Column:
    return F.try_to_timestamp(v, F.lit(form)).cast("date")


def _refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order."""
    at = lambda p: F.length(_digits(F.substring(shape, F.lit(1), p)))
    one = lambda p: F.substring(shape, p, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda p: F.when(one(p).rlike("[0-9]"), F.substring(digits, at(p), F.lit(1))).otherwise(one(p))), "")


def _luhn_digit(payload: Column) -> Column:
    """The digit that makes payload and digit pass the Luhn check."""
    n = F.length(payload)
    weighed = lambda p: F.substring(payload, p, F.lit(1)).cast("int") * F.when(F.pmod(n - p, F.lit(2)) == 0, 2).otherwise(1)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda p: weighed(p) - F.when(weighed(p) > 9, 9).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def _validated(values: DataFrame) -> DataFrame:
    """Adds kind (null if none), form (what besides the pair is kept), and moved: the digits a number is permuted in."""
    v, d = F.col("v"), _digits(F.col("v"))
    n = F.length(d)
    full = lambda kind: v.rlike(f"^(?:{PATTERNS[kind]})$")
    part = [F.regexp_extract(v, r"^(\d+)[-.](\d+)[-.](\d+)(?:[.](\d+))?$", k) for k in range(1, 5)]
    number = [F.when(p != "", p.cast("long")) for p in part]
    dated = values.withColumns({"form": F.coalesce(*(F.when(_day(v, f).isNotNull(), f) for f in FORMS))})
    kind = (
        F.when(full("email"), "email")
        .when(full("date") & F.col("form").isNotNull(), "date")
        .when(full("ssn") & ~number[0].isin(0, 666) & (number[0] < 900) & (number[1] > 0) & (number[2] > 0), "ssn")
        .when(full("ip") & (F.greatest(*number) < 256), "ip")
        .when(full("card") & n.between(13, 19) & F.call_function("luhn_check", d), "card")
        .when(full("phone") & n.between(8, 15), "phone")
    )
    moved = F.when(F.col("kind") == "card", F.substring(d, F.lit(1), n - 1)).when(F.col("kind") == "phone", F.substring(d, n - F.when(n >= 10, 10).otherwise(n - 2) + 1, n))
    octet = [F.when(~p.startswith("0") | (F.length(p) == 1), 256).when(F.length(p) == 2, 10).otherwise(100) for p in part]  # values with as many zeros before
    return dated.withColumn("kind", kind).withColumns({"moved": moved, **{f"p{k}": F.when(F.col("kind").isin("ssn", "ip"), number[k]) for k in range(4)}, **{f"s{k}": octet[k] for k in range(4)}})


def _late(base: Column, rank: Column) -> Column:
    """The date of that rank among those of 400 years that are after the 12th of their month."""
    start = F.date_from_unix_date((base * _CYCLE - _EPOCH).cast("int"))
    guess = F.floor(rank * 4800 / (_LATE[0] * _LATE[1])).cast("int")  # months have 16 to 19 such days, so it is one off at most

    def tried(m: Column) -> Column:
        month = F.add_months(start, m)
        d = rank - (F.datediff(month, start) - m * 12)
        return F.when((d >= 0) & (d < F.dayofmonth(F.last_day(month)) - 12), F.date_add(month, (d + 12).cast("int")))

    return F.coalesce(*(tried(guess + k) for k in (0, -1, 1)))


def _pairs(values: DataFrame) -> DataFrame:
    """Adds the pair a, b and its sizes size_a, size_b; base is the 400 years that a date stays in."""
    kind, m, form = F.col("kind"), F.length("moved"), F.col("form")
    date = F.when(kind == "date", F.coalesce(*(F.when(form == f, _day(F.col("v"), f)) for f in FORMS)))
    day = F.unix_date(date).cast("long") + _EPOCH
    based = values.withColumns({"base": F.floor(day / _CYCLE), "low": F.floor(m / 2).cast("int"), "late": form == FORMS[2]})
    months = (F.year(date) - 1 - F.col("base") * 400) * 12 + F.month(date)
    based = based.withColumn("day", F.pmod(day, F.lit(_CYCLE)) - F.when(F.col("late"), months * 12).otherwise(0))
    low, high = F.col("low"), m - F.col("low")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    by = lambda date, ssn, ip, number: F.when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "ip", ip).otherwise(number)
    last = F.col("base") == 24
    dates = lambda k: F.when(F.col("late") & last, _LAST_LATE[k]).when(F.col("late"), _LATE[k]).when(last, _LAST_DAYS[k]).otherwise(_DAYS[k])
    sized = based.withColumns({
        "size_a": by(dates(0), F.lit(898), F.col("s0") * F.col("s1"), ten(high)).cast("long"),
        "size_b": by(dates(1), F.lit(99 * 9999), F.col("s2") * F.col("s3"), ten(low)).cast("long"),
    })
    return sized.withColumns({
        "a": by(F.col("day") % F.col("size_a"), F.col("p0") - 1 - F.when(F.col("p0") > 666, 1).otherwise(0), F.col("p0") * F.col("s1") + F.col("p1"), F.substring("moved", F.lit(1), high).cast("long")),
        "b": by(F.floor(F.col("day") / F.col("size_a")), (F.col("p1") - 1) * 9999 + F.col("p2") - 1, F.col("p2") * F.col("s3") + F.col("p3"), F.substring("moved", high + 1, low).cast("long")),
    })


def _permuted(values: DataFrame, key: str) -> DataFrame:
    """The pairs after ROUNDS rounds, each of which adds a keyed digest of one number to the other."""
    for r in range(ROUNDS):
        to, of = ("a", "b") if r % 2 == 0 else ("b", "a")
        digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{r}"), "kind", "size_a", "size_b", of), 256)
        add = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        values = values.select(*(F.pmod(F.col(to) + F.pmod(add, F.col(f"size_{to}")), F.col(f"size_{to}")).alias(c) if c == to else F.col(c) for c in values.columns))
    return values


def pseudonyms(values: DataFrame, key: str) -> DataFrame:
    """Adds kind and pseudonym to rows with a candidate v; both are null where v is no valid value of a kind."""
    kept, v, kind = values.columns, F.col("v"), F.col("kind")
    p = _permuted(_pairs(_validated(values)), key)
    a, b, text = F.col("a"), F.col("b"), lambda x, n: F.lpad(x.cast("string"), n, "0")
    rank = a + b * F.col("size_a")
    day = F.when(F.col("late"), _late(F.col("base"), rank)).otherwise(F.date_from_unix_date((F.col("base") * _CYCLE + rank - _EPOCH).cast("int")))
    date = F.coalesce(*(F.when(F.col("form") == f, F.date_format(day, f)) for f in FORMS))
    ssn = F.concat_ws("-", text(a + 1 + F.when(a + 1 >= 666, 1).otherwise(0), 3), text(F.floor(b / 9999) + 1, 2), text(b % 9999 + 1, 4))
    octets = (F.floor(a / F.col("s1")), a % F.col("s1"), F.floor(b / F.col("s3")), b % F.col("s3"))
    ip = F.concat_ws(".", *(F.when(F.col(f"s{k}") == 256, x.cast("string")).otherwise(text(x, F.length(F.col(f"s{k}").cast("string")))) for k, x in enumerate(octets)))
    number = F.concat(text(a, F.length("moved") - F.col("low")), F.when(F.col("low") > 0, text(b, F.col("low"))).otherwise(""))
    filled = p.select(*kept, "kind", date.alias("date"), ssn.alias("ssn"), ip.alias("ip"), number.alias("number"), "moved")
    card = _refilled(v, F.concat("number", _luhn_digit(F.col("number"))))
    phone = _refilled(v, F.concat(F.substring(_digits(v), F.lit(1), F.length(_digits(v)) - F.length("moved")), F.col("number")))
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(v)), 256), 1, 24), F.lit("@"), F.substring_index(v, "@", -1))
    return filled.select(*kept, "kind", F.when(kind == "email", email).when(kind == "date", F.col("date")).when(kind == "ssn", F.col("ssn")).when(kind == "ip", F.col("ip")).when(kind == "card", card).when(kind == "phone", phone).alias("pseudonym"))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, and n_email ... n_phone, the values replaced by kind.

    All rows and columns stay; texts without a valid value stay as they are; null stays null with
    zero counts; rows that repeat id and text get the same answer; columns of docs with the
    counts' names are replaced. The key is a secret: who has it can map numbers back.
    """
    counts = [f"n_{k}" for k in KINDS]
    text, kept = F.col(f"`{text_col}`"), [c for c in docs.columns if c not in counts]
    d = docs.select(*(F.col(f"`{c}`") for c in kept))
    maybe = F.coalesce(text.rlike("[0-9@]") & text.rlike(CANDIDATE), F.lit(False))
    clean = d.where(~maybe).select("*", *(F.lit(0).cast("long").alias(c) for c in counts))
    dirty = d.where(maybe).withColumn("_pii_th", F.xxhash64(text))
    found = dirty.select(F.col(f"`{id_col}`").alias("id"), F.col("_pii_th").alias("th"), F.posexplode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("pos", "v"))
    subs = pseudonyms(found, key).groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", F.coalesce("pseudonym", "v").alias("s"), "kind"))).alias("_pii_subs"))
    both = dirty.join(subs, dirty[f"`{id_col}`"].eqNullSafe(subs["id"]) & (dirty["_pii_th"] == subs["th"])).withColumn("_pii_pieces", F.split(text, CANDIDATE, -1))
    pieces = F.col("_pii_pieces")
    new = F.concat(F.array_join(F.transform("_pii_subs", lambda s, i: F.concat(F.get(pieces, i), s["s"])), ""), F.element_at(pieces, -1))
    number = lambda k: F.size(F.filter("_pii_subs", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return clean.unionByName(both.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept), *map(number, KINDS)))
