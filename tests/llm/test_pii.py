"""Pseudonyms against a second version in plain Python, on generated values and on sf0.01."""

import datetime
import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from terralume.llm import pii

from .fixtures import SCHEMA
from .test_text import luhn

KEY = "second"
DAY0 = datetime.date(1900, 1, 1)


def feistel(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(8):
        h = lambda v: int(hashlib.md5(f"{KEY}|{kind}:{i}|{v}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + h(right)) % a
        else:
            right = (right + h(left)) % b
    return left * b + right


def number(d, kind):
    half = len(d) // 2
    return str(feistel(int(d), 10 ** (len(d) - half), 10**half, kind)).zfill(len(d))


def refill(shape, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def phone(m):
    d = re.sub(r"\D", "", m)
    head, area, exchange, line = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
    codes = [f"{n}" for n in range(200, 1000) if n % 100 != 11]
    if area in codes and exchange in codes:
        y = feistel((codes.index(area) * 792 + codes.index(exchange)) * 10000 + int(line), 792 * 792, 10000, "phone")
        new = codes[y // 10000 // 792] + codes[y // 10000 % 792] + f"{y % 10000:04}"
    elif not m.startswith("+1"):
        return None
    elif area in codes:
        new = area + exchange + f"{feistel(int(line), 100, 100, f'phone-{area}{exchange}'):04}"
    else:
        new = area + f"{feistel(int(exchange + line), 10000, 1000, f'phone-{area}'):07}"
    return refill(m, head + new)


def abroad(m):
    d = re.sub(r"\D", "", m)
    return refill(m, d[:2] + number(d[2:], "abroad")) if 8 <= len(d) <= 15 else None


def remainder(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def iban(m):
    code = m.replace(" ", "")
    rest = re.sub(r"\D", "", code[4:])
    if not (15 <= len(code) <= 34 and len(rest) >= 2 and remainder(code) == 1):
        return None
    new = rest[: max(0, len(rest) - 18)] + number(rest[-18:], "iban")
    blank = refill(code, "00" + new)
    return refill(m, f"{98 - remainder(blank):02}" + new)


def ip(m):
    parts = [int(x) for x in m.split(".")]
    if max(parts) > 255:
        return None
    y = feistel(int.from_bytes(bytes(parts), "big"), 65536, 65536, "ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def ssn(m):
    a, g, n = map(int, m.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not g or not n:
        return None
    y = feistel((areas.index(a) * 99 + g - 1) * 9999 + n - 1, 898 * 99, 9999, "ssn")
    return f"{areas[y // 9999 // 99]:03}-{y // 9999 % 99 + 1:02}-{y % 9999 + 1:04}"


def date(m):
    order = "%Y%m%d" if m[:4].isdigit() else "%d%m%Y" if "." in m else "%m%d%Y"
    try:
        day = datetime.datetime.strptime(re.sub(r"\D", "", m), order).date()  # noqa: DTZ007
    except ValueError:
        return None
    x = (day - DAY0).days
    return refill(m, (DAY0 + datetime.timedelta(feistel(x, 319, 229, "date"))).strftime(order)) if 0 <= x < 319 * 229 else None


def card(m):
    d = re.sub(r"\D", "", m)
    if not luhn(d) or not int(d):
        return None
    body = number(d[:-1], "card")
    return refill(m, body + next(c for c in "0123456789" if luhn(body + c)))


def email(m):
    h = hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:16]
    return h.translate(str.maketrans("0123456789abcdef", "bcdfghjklmnpqrst")) + m[m.index("@") :]


def key(m):
    return "AKIA" + hashlib.sha256(f"{KEY}|secret|{m}".encode()).hexdigest()[:16].upper()


def token(m):
    h = hashlib.sha256(f"{KEY}|secret|{m.lower()}".encode()).hexdigest()[: len(m)]
    return h.upper() if m == m.upper() and m != m.lower() else h


SEP = {s: re.escape(s) for s in " .-"}
SHAPES = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63}){1,8}", email),
    ("phone", "|".join([*(rf"(\+1[ .-]?)?\d{{3}}{s}\d{{3}}{s}\d{{4}}" for s in SEP.values()), r"(\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]?\d{4}", r"\+1\d{10}"]), phone),
    ("phone", r"\+[2-9]\d{0,2}([ .-]?\(?\d{1,5}\)?){2,6}", abroad),
    ("iban", r"[A-Z]{2}\d\d( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?", iban),
    ("ip", r"\d{1,3}(\.\d{1,3}){3}", ip),
    ("ssn", r"\d{3}-\d\d-\d{4}", ssn),
    ("date", r"\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}", date),
    ("card", r"\d{4}( \d{4}){3}|\d{4}(-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19}", card),
    ("key", r"AKIA[A-Z0-9]{16}", key),
    ("token", r"[0-9a-fA-F]{32,64}", token),
]
FIND = re.compile(r"(?<![A-Za-z0-9_@.+-])(?:" + "|".join(f"(?:{p})" for _, p, _ in SHAPES) + r")(?![A-Za-z0-9_@])(?![.-]\d)", re.ASCII)


def by_hand(text):
    kinds = []

    def swap(m):
        for kind, shape, new in SHAPES:
            if re.fullmatch(shape, m[0], re.ASCII) and (got := new(m[0])) is not None:
                kinds.append(kind)
                return got
        return m[0]

    return FIND.sub(swap, text), kinds


def values(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    body = d(14)
    full = body + next(c for c in "0123456789" if luhn(body + c))
    sixteen = (b := d(15)) + next(c for c in "0123456789" if luhn(b + c))
    bban = "".join(rng.choice("0123456789ABCDEF") for _ in range(16))
    code = "XK00" + bban
    code = f"XK{98 - remainder(code):02}{bban}"
    day = DAY0 + datetime.timedelta(rng.randrange(-400, 74000))
    return [
        f"{full[:4]} {full[4:10]} {full[10:]}", full, f"{sixteen[:4]}-{sixteen[4:8]}-{sixteen[8:12]}-{sixteen[12:]}", d(16), code, f"{code[:4]} {code[4:8]} {code[8:12]} {code[12:16]} {code[16:]}",
        f"({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1{d(10)}", f"{d(3)}-{d(3)}-{d(4)}", f"212.{rng.randrange(200, 999)}.{d(4)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+49{d(11)}",
        ".".join(str(rng.randrange(300)) for _ in range(4)), f"{d(3)}-{d(2)}-{d(4)}", day.isoformat(), day.strftime("%d.%m.%Y"), day.strftime("%m/%d/%Y"), day.strftime("%Y/%m/%d"), "2024-1-5",
        f"{hexes(5, 'abcXYZ._')}@{hexes(4, 'abc-')}.example.com", "AKIA" + hexes(16, "ABCXYZ0189"), hexes(rng.randrange(30, 67), "0123456789abcdef"), hexes(40, "0123456789ABCDEF"), hexes(36, "0123456789abcdefABCDEF"),
    ]


@pytest.mark.parametrize("source", ["made", "sf0.01"])
def test_second_version_agrees(spark, source):
    if source == "made":
        rng = random.Random(11)
        texts = [v for _ in range(40) for v in values(rng)]
        texts += [" ".join(rng.sample(values(rng), 6)) + rng.choice([".", "", "!", " x"]) for _ in range(200)] + ["pay XK68AB1C2D3E4F5G6H7J now", "000-000-0000", "part 123-456-7890"]
    else:
        texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    rows = [(i, t, "", "", 1) for i, t in enumerate(texts)]
    for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect():
        want, kinds = by_hand(texts[r.doc_id] or "")
        assert (r.text or "") == want, texts[r.doc_id]
        assert {k: r[f"n_{k}"] for k in pii.KINDS} == {k: kinds.count(k) for k in pii.KINDS} and r.n_pii == len(kinds)


def test_hint_covers_every_form():
    rng = random.Random(3)
    seen = 0
    for _ in range(3000):
        for v in values(rng):
            if FIND.search(v):
                seen += 1
                assert re.search(pii.HINT, v), v
    assert seen > 40_000 and set(pii.NEEDS) == set(pii.FORMS)


def test_one_value_one_outcome(spark):
    code = "XK68AB1C2D3E4F5G6H7J"
    body = next(f"XK{98 - remainder('XK00' + code[4:]):02}{code[4:]}" for _ in [0])
    rows = [(1, f"pay {body} now", "", "", 1), (2, f"pay {body} now 123", "", "", 1)]
    a, b = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).orderBy("doc_id").collect()]
    assert b == a + " 123" and body not in a
