"""PII: format-preserving pseudonyms, with DataFrame functions only.

One pattern finds the candidates in a whole text; each is validated and, if it holds, replaced by a
keyed permutation of its own format, so equal values get equal pseudonyms in every document and
different values of one kind different ones:

* card: 13 to 19 digits, plain, in groups of four or as 4-6-5, with a right check digit.  The digits
  before it are permuted and a new check digit is put.
* phone: ten digits in groups that the North American plan allows (area and exchange from 200 on, none
  ending in 11), permuted among such numbers, so a number stays linked with and without +1.  After an
  explicit +1 other ten digits count too: what the plan forbids stays (the area, or area and exchange)
  and the rest is permuted.  Other numbers with + and 8 to 15 digits keep the first two.
* iban: two capitals, two check digits that hold (mod 97) and 11 to 30 digits or capitals, plain or in
  groups of four.  Its digits (the last 18 of more) are permuted and new check digits are put.
* ip: four numbers to 255.  The 32 bits are permuted.
* ssn: ddd-dd-dddd with an issued area, group and serial; permuted among such numbers.
* date: a real day in 1900 to 2099, as yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or mm/dd/yyyy; permuted
  among those days.
* email, key (AKIA and 16 capitals or digits) and token (32 to 64 hex digits): no number, so a keyed
  hash takes the place of the local part, the 16 characters or the digits, in the same length and
  alphabet (a local part becomes 16 letters; its domain stays).

The permutation is a Feistel network of ``ROUNDS`` rounds on Z_a x Z_b (a x b the size of the
format): in turn, the left or right half is increased by a keyed hash of the other, modulo its size.
It is a bijection and can be undone with the key (``restore`` in the tests).

Everything is row-local: no shuffle, no driver data.  The key is the caller's; the registered query has
one for tests only.

Defined results: a null text stays null and finds nothing; an empty one stays empty; a very long text is
searched whole; repeated rows are treated alike; candidates that fail their check stay as they are; text
around the values stays byte for byte; an empty table gives an empty result; other columns, whatever
their names, are ignored.  Left alone: IPv6 addresses, nine digits without hyphens, dates in other forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Of the registered query; callers bring their own.
QUERY_KEY = "terralume-development-key"
ROUNDS = 8
DAYS = 73049  # 1900-01-01 .. 2099-12-31
KINDS = ("email", "phone", "card", "iban", "ip", "ssn", "date", "key", "token")

#: What may be personal, by kind; a match of the whole is told apart by these again.
FORMS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})|\+1[0-9]{10}",
    "abroad": r"\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": r"[0-9]{4}([-/])[0-9]{2}\2[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "card": r"[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5}|[0-9]{13,19}",
    "key": r"AKIA[A-Z0-9]{16}",
    "token": r"[0-9a-fA-F]{32,64}",
}
#: No letter, digit or joining mark may touch a value.  An email starts where a word does.
_LEFT = r"(?<![A-Za-z0-9_@.+-])"
_RIGHT = r"(?![A-Za-z0-9_@])(?![.-][0-9])"
#: In the order in which they are tried at a place.
ANY = _LEFT + "(?:" + "|".join(f"(?:{FORMS[k]})" for k in FORMS) + ")" + _RIGHT
#: What every value of a kind has in it; a text without any of these holds none, and most hold none.
NEEDS = {
    "email": "@",
    "phone": "[0-9]{3}",
    "abroad": r"\+[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}",
    "ip": r"[0-9]\.[0-9]",
    "ssn": "[0-9]{3}",
    "date": r"[0-9]{4}",
    "card": "[0-9]{4}",
    "key": "AKIA",
    "token": "[0-9a-fA-F]{32}",
}
HINT = "|".join(dict.fromkeys(NEEDS.values()))


def _whole(kind: str) -> str:
    return "^(?:" + FORMS[kind].replace(r"\2", r"\1").replace(r"\3", r"\1").replace(r"\4", r"\2") + ")$"


def _hash(key: str, *parts: Column) -> Column:
    """A keyed number under 2^48."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def permute(x: Column, a: Column, b: Column, key: str, kind: str | Column) -> Column:
    """x in 0 .. a*b - 1 to its image: Feistel rounds on (x div b, x mod b)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def step(acc: Column, i: Column) -> Column:
        tag = F.concat(kind, F.lit(":"), i.cast("string"))
        left = (acc.l + _hash(key, tag, acc.r.cast("string"))) % acc.a
        right = (acc.r + _hash(key, tag, acc.l.cast("string"))) % acc.b
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(acc.l).alias("l"), F.when(even, acc.r).otherwise(right).alias("r"), acc.a.alias("a"), acc.b.alias("b"))

    a, b = a.cast("long"), b.cast("long")
    start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc.l * acc.b + acc.r)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fill(m: Column, digits: Column) -> Column:
    """``m`` with its digits, in turn, replaced by ``digits``."""

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc.o, F.when(is_digit, F.substring(acc.d, acc.i, F.lit(1))).otherwise(c)).alias("o"), (acc.i + is_digit.cast("int")).alias("i"), acc.d.alias("d"))

    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("i"), digits.alias("d"))
    return F.aggregate(F.split(m, ""), start, put, lambda acc: acc.o)


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """The check sum of ``digits``; 1 doubles every second from the last but one, 0 from the last."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == doubled_from_right
        return acc + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k) for k in range(1, 10)]), n.cast("int"))


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0")) if isinstance(n, Column) else F.lpad(x.cast("string"), n, "0")


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    new = _long_number(body, key, "card")
    check = (10 - _luhn_sum(new, 0) % 10) % 10
    valid = (_luhn_sum(d, 1) % 10 == 0) & ~d.rlike("^0+$")
    return valid, _fill(m, F.concat(new, check.cast("string")))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    ten = F.right(d, F.lit(10))
    area, exchange, line = F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)
    plan = "^[2-9](?!11)[0-9]{2}$"  # 8 x 99 codes
    fine_area, fine = area.rlike(plan), area.rlike(plan) & exchange.rlike(plan)

    def rank(code: Column) -> Column:
        rest = code.cast("long") % 100
        return (F.substring(code, 1, 1).cast("long") - 2) * 99 + rest - (rest > 11).cast("long")

    def code(place: Column) -> Column:
        rest = place % 99
        return F.concat((((place - rest) / 99).cast("long") + 2).cast("string"), _padded(rest + (rest >= 11).cast("long"), 2))

    y = permute((rank(area) * 792 + rank(exchange)) * 10**4 + line.cast("long"), F.lit(792 * 792), F.lit(10**4), key, "phone")
    codes = ((y - y % 10**4) / 10**4).cast("long")
    among = F.concat(code(((codes - codes % 792) / 792).cast("long")), code(codes % 792), _padded(y % 10**4, 4))
    seven = permute(F.substring(ten, 4, 7).cast("long"), F.lit(10**4), F.lit(10**3), key, F.concat(F.lit("phone-"), area))
    four = permute(line.cast("long"), F.lit(100), F.lit(100), key, F.concat(F.lit("phone-"), area, exchange))
    new = F.when(fine, among).when(fine_area, F.concat(area, exchange, _padded(four, 4))).otherwise(F.concat(area, _padded(seven, 7)))
    valid = fine | m.startswith("+1")
    return valid, F.when(valid, _fill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new)))


def _long_number(d: Column, key: str, kind: str) -> Column:
    """2 to 18 digits to as many."""
    n = F.length(d)
    half = F.floor(n / 2)
    return _padded(permute(d.cast("long"), _power(n - half), _power(half), key, kind), n)


def _abroad(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    valid = F.length(d).between(8, 15)
    return valid, F.when(valid, _fill(m, F.concat(F.substring(d, 1, 2), _long_number(F.substring(d, F.lit(3), F.length(d) - 2), key, "abroad"))))


def _mod97(code: Column) -> Column:
    """An IBAN without spaces, its first four characters moved to the end, letters as 10 to 35, modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code) - 4), F.substring(code, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    code = F.replace(m, F.lit(" "), F.lit(""))
    rest = _digits(F.substring(code, F.lit(5), F.length(code) - 4))
    n = F.length(rest)
    valid = F.length(code).between(15, 34) & (n >= 2) & (_mod97(code) == 1)
    moved = F.least(n, F.lit(18))
    new = F.concat(F.substring(rest, F.lit(1), n - moved), _long_number(F.right(rest, moved), key, "iban"))
    blank = _fill(code, F.concat(F.lit("00"), new))
    check = _padded(98 - _mod97(blank), 2)
    return valid, F.when(valid, _fill(m, F.concat(check, new)))


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    valid = F.greatest(*[part(i) for i in range(1, 5)]) <= 255
    x = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    y = permute(x, F.lit(65536), F.lit(65536), key, "ip")
    return valid, F.concat_ws(".", *[F.shiftright(y, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    slot = area - 1 - (area > 666).cast("long")  # 898 areas
    y = permute((slot * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    s, g, a = y % 9999 + 1, ((y - y % 9999) / 9999).cast("long") % 99 + 1, ((y - y % (99 * 9999)) / (99 * 9999)).cast("long") + 1
    a = a + (a >= 666).cast("long")
    return valid, F.concat_ws("-", _padded(a, 3), _padded(g, 2), _padded(s, 4))


def _date(m: Column, key: str) -> tuple[Column, Column]:
    year_first, dotted = m.rlike(r"^[0-9]{4}"), m.contains(".")
    cut = lambda at, n: F.substring(m, at, n)
    iso = F.when(year_first, F.concat_ws("-", cut(1, 4), cut(6, 2), cut(9, 2))).when(dotted, F.concat_ws("-", cut(7, 4), cut(4, 2), cut(1, 2))).otherwise(F.concat_ws("-", cut(7, 4), cut(1, 2), cut(4, 2)))
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    x = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    valid = F.coalesce((x >= 0) & (x < DAYS), F.lit(False))
    y = F.date_add(F.lit("1900-01-01").cast("date"), permute(F.coalesce(x, F.lit(0)), F.lit(319), F.lit(229), key, "date").cast("int"))
    order = F.when(year_first, F.date_format(y, "yyyyMMdd")).when(dotted, F.date_format(y, "ddMMyyyy")).otherwise(F.date_format(y, "MMddyyyy"))
    return valid, _fill(m, order)


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", "bcdfghjklmnpqrst")


def _email(m: Column, key: str) -> tuple[Column, Column]:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return F.lit(True), F.concat(_letters(F.substring(digest, 1, 16)), F.regexp_extract(m, "@.*$", 0))


def _secret(m: Column, key: str) -> tuple[Column, Column]:
    known = F.when(m.startswith("AKIA"), m).otherwise(F.lower(m))  # a token in either case stays linked
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), known).cast("binary"), 256)
    token = F.substring(digest, F.lit(1), F.length(m))
    return F.lit(True), F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16)))).otherwise(F.when(m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(token)).otherwise(token))


_RULES: dict[str, Callable] = {"email": _email, "phone": _phone, "abroad": _abroad, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card, "key": _secret, "token": _secret}


def _judged(m: Column, key: str) -> Column:
    """struct(kind or null, what stands for the match)."""
    kind = new = None
    for name, rule in _RULES.items():
        valid, other = rule(m, key)
        holds = F.when(m.rlike(_whole(name)), valid)  # what looks like an IBAN and is none can be a token
        told = "phone" if name == "abroad" else name
        kind = F.when(holds, told) if kind is None else kind.when(holds, told)
        new = F.when(holds, other) if new is None else new.when(holds, other)
    return F.struct(kind.alias("kind"), new.otherwise(m).alias("new"))


def pseudonymise(df: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with pseudonyms, n_pii and one count for each kind, for each row."""
    text = F.col("text").cast("string")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    some = F.col("text").rlike(HINT)
    none = F.array().cast("array<string>")
    # only texts with a match pay for the judging: the list of matches is empty elsewhere
    rows = rows.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(none))
    rows = rows.withColumn("told", F.transform("found", lambda m: _judged(m, key)))
    pieces = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(pieces, F.col("told"), lambda p, t: F.concat(p, F.coalesce(t.new, F.lit("")))), "")
    count = lambda kind: F.size(F.filter("told", lambda t: t.kind == kind)).cast("long")
    return rows.select(
        "doc_id",
        F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.size(F.filter("told", lambda t: t.kind.isNotNull())).cast("long").alias("n_pii"),
        *[count(k).alias(f"n_{k}") for k in KINDS],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
