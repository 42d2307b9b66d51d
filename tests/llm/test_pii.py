import hashlib
import random
import re
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import types as T

from talus.llm import pii

KEY = "tests-only"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_private", T.StringType())])


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


#: With ASCII classes of digits and word characters; the texts hold no other letters beyond ASCII than these.
PATTERNS = {k: p.replace(r"\p{L}\p{N}", "A-Za-z0-9éüï") for k, p in pii.PATTERNS.items()}

VALUES = {
    "hein.19@mail5.example.com": r"[a-z]{4}\.\d\d@mail5\.example\.com",
    "4111 1111 1111 1111": r"\d{4} \d{4} \d{4} \d{4}",
    "4111111111111111": r"\d{16}",
    "+1 (743) 555-3824": r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}",
    "192.168.10.7": r"\d{1,3}(\.\d{1,3}){3}",
    "123-45-6789": r"\d{3}-\d\d-\d{4}",
    "2023-02-28": r"\d{4}-\d\d-\d\d",
    "24be64439e3e49cf46b2d7c90f3602a3d0b907ff": r"[0-9a-f]{40}",
    "DE89 3704 0044 0532 0130 00": r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d",
    "+49 30 1234567": r"\+\d\d \d\d \d{7}",
}


def test_values_keep_their_format_and_stay_linked(spark):
    rows = [(k, f"a {v}, b\n{v}.", "clash") for k, v in enumerate(VALUES)] + [(100 + k, f"x {v}", None) for k, v in enumerate(VALUES)]
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), KEY).collect()}
    for k, (v, form) in enumerate(VALUES.items()):
        if v == "+49 30 1234567":
            continue
        m = re.fullmatch(rf"a ({form}), b\n({form})\.", out[k].text)
        assert m, (v, out[k].text)
        new = m[1]
        assert new != v and out[k].n_private == 2 and out[100 + k].text == f"x {new}" and out[k].text == f"a {new}, b\n{new}."
        if v.startswith("4111"):
            assert luhn(new)
        if form.startswith(r"\d{1,3}("):
            assert all(int(x) < 256 for x in new.split("."))
        if v == "2023-02-28":
            date.fromisoformat(new)
        if v.startswith("DE"):
            s = new.replace(" ", "")
            assert int(s[4:] + "1314" + s[2:4]) % 97 == 1


@pytest.mark.parametrize("text", [None, "", "no data at all", "4111111111111112", "300.1.2.3", "2023-02-30", "version 2.0. and 3.", "666-12-3456", "12345", "10 skateboarding-enthusiasts met"])
def test_other_texts_stay(spark, text):
    r = pii.pseudonymize(spark.createDataFrame([(1, text, None)], SCHEMA), KEY).first()
    assert r.text == text and r.n_private == 0


def test_permutation_on_a_whole_format(spark):
    df = spark.range(146097).selectExpr("id as doc_id", "date_format(date_add(date'1800-01-01', cast(id as int)), 'yyyy-MM-dd') as text")
    assert pii.pseudonymize(df, KEY).select("text").distinct().count() == 146097
    ids = spark.range(2600).selectExpr("id as doc_id", "concat(char(97 + id % 26), id div 26, '@a.example.com') as text")
    assert pii.pseudonymize(ids, KEY).select("text").distinct().count() == 2600


def test_long_text_and_empty_table(spark):
    text = "word 10.0.0.1 " * 30_000
    r = pii.pseudonymize(spark.createDataFrame([(1, text, None), (1, text, None)], SCHEMA), KEY).collect()
    assert len(r) == 2 and r[0].n_private == 30_000 and "10.0.0.1 " not in r[0].text
    assert pii.pseudonymize(spark.createDataFrame([], SCHEMA), KEY).count() == 0


# A plain model of the whole operator, one value at a time.


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def number(x, a, b, name):
    left, right = divmod(x, b)
    for i in range(8):
        if i % 2 == 0:
            left = (left + int(sha(KEY, f"{name}{i}", right)[:14], 16)) % a
        else:
            right = (right + int(sha(KEY, f"{name}{i}", left)[:14], 16)) % b
    return left * b + right


def string(x, name, hexadecimal=False):
    def shift(part, k):
        capital = part == part.upper() and re.search("[A-F]", part)
        out = ""
        for i, c in enumerate(part):
            by = int(k[2 * (i % 32) : 2 * (i % 32) + 2], 16)
            if hexadecimal:
                alphabet = "0123456789ABCDEF" if c in "ABCDEF" or c.isdigit() and capital else "0123456789abcdef"
            else:
                alphabet = next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), c)
            out += alphabet[(alphabet.index(c) + by) % len(alphabet)]
        return out

    half = len(x) // 2
    left, right = x[:half], x[half:]
    for j in range(8):
        if j % 2 == 0:
            left = shift(left, sha(KEY, f"{name}0", j, right))
        else:
            right = shift(right, sha(KEY, f"{name}1", j, left))
    return left + right


def refill(m, new, what):
    new = iter(new)
    return "".join(next(new) if what(c) else c for c in m)


def model_value(m):
    kind = next((k for k, p in PATTERNS.items() if re.fullmatch(p, m, re.A)), None)
    d = re.sub("[^0-9]", "", m)
    digit = lambda c: c.isascii() and c.isdigit()
    if kind == "email":
        at = m.index("@")
        return string(m[:at], "email") + m[at:]
    if kind == "iban":
        s = m.replace(" ", "")
        check = lambda b: f"{98 - int(''.join(str(int(c, 36)) for c in b + s[:2] + '00')) % 97:02}"
        if s[2:4] != check(s[4:]):
            return m
        b = string(s[4:], "iban")
        return refill(m, s[:2] + check(b) + b, lambda c: c != " ")
    if kind == "secret":
        one_case = re.fullmatch("[0-9a-fA-F]+", m) and m in (m.lower(), m.upper())
        return string(m, "hex", True) if one_case else string(m, "token")
    if kind == "date":
        y, mo, da = (int(x) for x in (m.split("-") if "-" in m else m.split(".")[::-1] if "." in m else (m[6:], m[:2], m[3:5])))
        swap = "/" in m and mo > 12
        try:
            x = (date(y, da, mo) if swap else date(y, mo, da)).toordinal() - date(1800, 1, 1).toordinal()
        except ValueError:
            return m
        if not 0 <= x <= 146096:
            return m
        new = date(1800, 1, 1) + timedelta(number(x, 773, 189, "date"))
        while swap and new.day <= 12:
            new = date(1800, 1, 1) + timedelta(number((new - date(1800, 1, 1)).days, 773, 189, "date"))
        return new.strftime("%Y-%m-%d" if "-" in m else "%d.%m.%Y" if "." in m else "%d/%m/%Y" if swap else "%m/%d/%Y")
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        v = number(int.from_bytes(bytes(o), "big"), 65536, 65536, "ip")
        return ".".join(map(str, v.to_bytes(4, "big")))
    if kind == "ssn":
        a, g, n = (int(x) for x in m.split("-"))
        if not 1 <= a <= 899 or a == 666 or not g or not n:
            return m
        v = number(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + n - 1, 88902, 9999, "ssn")
        a, rest = divmod(v, 989901)
        return f"{a + (2 if a >= 665 else 1):03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04}"
    if kind == "phone":
        if not 8 <= len(d) <= 15:
            return m
        if len(d) >= 10 and d[:-10] in ("", "1") and re.match("[2-9]..[2-9]", d[-10:]):
            t = d[-10:]
            v = number((int(t[:3]) - 200) * 8000000 + (int(t[3:6]) - 200) * 10000 + int(t[6:]), 80000, 80000, "phone")
            return refill(m, f"{d[:-10]}{v // 8000000 + 200}{v // 10000 % 800 + 200}{v % 10000:04}", digit)
        return refill(m, d[:2] + string(d[2:], "phone"), digit)
    if kind == "card" and luhn(d):
        n = len(d) - 1
        body = f"{number(int(d[:-1]), 10 ** ((n + 1) // 2), 10 ** (n // 2), f'card{n}'):0{n}}"
        return refill(m, next(body + str(c) for c in range(10) if luhn(body + str(c))), digit)
    return m


def within(m):
    """(text, number of values): every span of m that no letter or digit touches is tried, from the left and the longest first."""
    alnum = lambda c: c.isascii() and c.isalnum()
    out, i, n = "", 0, 0
    while i < len(m):
        if i and alnum(m[i - 1]):
            out, i = out + m[i], i + 1
            continue
        for j in range(len(m), i, -1):
            if (j == len(m) or not alnum(m[j])) and alnum(m[j - 1]) and (new := model_value(m[i:j])) != m[i:j]:
                out, i, n = out + new, j, n + 1
                break
        else:
            out, i = out + m[i], i + 1
    return out, n


def model(text):
    if text is None:
        return None, 0
    found, out, at, n = "|".join(f"(?:{p})" for p in PATTERNS.values()), "", 0, 0
    for m in re.finditer(found, text, re.A):
        new, k = (model_value(m[0]), 1) if model_value(m[0]) != m[0] else within(m[0]) if len(m[0]) >= 9 else (m[0], 0)
        out, at, n = out + text[at : m.start()] + new, m.end(), n + k
    return out + text[at:], n


BESIDE = [
    ("room 12 4111 1111 1111 1111 ok", r"room 12 \d{4} \d{4} \d{4} \d{4} ok", 1), ("pay 4111 1111 1111 1111 12", r"pay \d{4} \d{4} \d{4} \d{4} 12", 1), ("id 1234567 078-05-1120", r"id 1234567 \d{3}-\d\d-\d{4}", 1),
    ("4111 1111 1111 1111 10.0.0.1", r"\d{4} \d{4} \d{4} \d{4} \d+\.\d+\.\d+\.\d+", 2), ("no 5 5500-0000-0000-0004 7", r"no 5 \d{4}-\d{4}-\d{4}-\d{4} 7", 1), ("\u00fcn\u00efcode@x.de", r"\u00fc[a-z]\u00ef[a-z]{4}@x\.de", 1),
    ("9 2023-02-28 4111111111111111", r"9 \d{4}-\d\d-\d\d \d{16}", 2),
]


@pytest.mark.parametrize(("text", "form", "n"), BESIDE)
def test_values_beside_other_numbers(spark, text, form, n):
    r = pii.pseudonymize(spark.createDataFrame([(1, text, None)], SCHEMA), KEY).first()
    assert re.fullmatch(form, r.text) and r.text != text and r.n_private == n
    assert (r.text, r.n_private) == model(text)


def test_equals_the_plain_model(spark):
    r = random.Random(1)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = lambda n: "".join(r.choice("abcdefXYZ09") for _ in range(n))

    def iban(cc, length):
        b = "".join(r.choice("ABCXYZ0123456789") for _ in range(length - 4))
        good = cc + f"{98 - int(''.join(str(int(c, 36)) for c in b + cc + '00')) % 97:02}" + b
        return " ".join(good[k : k + 4] for k in range(0, length, 4)) if r.random() < 0.5 else good

    def card(n):
        lead = digits(n - 1)
        return next(lead + str(c) for c in range(10) if luhn(lead + str(c)))

    makers = [
        lambda: f"{words(4)}.{words(2)}@mail.{words(3)}.org", lambda: words(3) + "@" + words(5), lambda: iban(*r.choice([("GB", 22), ("NO", 15), ("FR", 27), ("DE", 22), ("NL", 18)])),
        lambda: "GB82 WEST 1234 5698 7654 33", lambda: "GB82 WEST 1234 5698 7654 32 AND MORE", lambda: hashlib.md5(digits(5).encode()).hexdigest(), lambda: hashlib.sha256(digits(5).encode()).hexdigest().upper(),
        lambda: "sk-" + words(r.choice([15, 16, 40, 200])), lambda: "AKIA" + words(16), lambda: "AKIA_ABCDEFGHIJKLMNOPQRST", lambda: "skateboarding-enthusiasts", lambda: f"{r.randint(1700, 2300)}-{r.randint(0, 13):02}-{r.randint(0, 32):02}",
        lambda: f"{r.randint(0, 32):02}/{r.randint(0, 32):02}/{r.randint(1790, 2210)}", lambda: f"{r.randint(1, 31):02}.{r.randint(1, 12):02}.{r.randint(1790, 2210)}", lambda: ".".join(str(r.randint(0, 299)) for _ in range(4)),
        lambda: f"{r.choice(['000', '666', '900', digits(3)])}-{digits(2)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+1 {digits(3)} {digits(3)} {digits(4)}", lambda: f"+49 {digits(3)} {digits(7)}",
        lambda: card(r.randint(13, 19)), lambda: digits(16), lambda: "é" + words(3) + "@x.com", lambda: "plain words", lambda: "_a@b.co.", lambda: "a.b@c..d",
    ]
    rows = [(k, "".join(r.choice(makers)() + r.choice([" ", ", ", "\n", ".", ": "]) for _ in range(r.randint(0, 12))), "x") for k in range(400)]
    numbers = [lambda: digits(r.randint(1, 7)), lambda: card(16), lambda: " ".join(card(16)[k : k + 4] for k in (0, 4, 8, 12)), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: "10.0.0." + digits(1), lambda: "2020-01-1" + digits(1)]
    rows += [(500 + k, r.choice([" ", "-"]).join(r.choice(numbers)() for _ in range(r.randint(2, 5))), "x") for k in range(150)]
    rows += [(1000 + k, m(), "x") for k, m in enumerate(makers)] + [(None, None, None), (2000, "", "x"), (2001, "AKIA_ABCDEFGHIJKLMNOPQRST", "no digit")]
    got = {o.doc_id: (o.text, o.n_private) for o in pii.pseudonymize(spark.createDataFrame(rows, SCHEMA), KEY).collect()}
    assert got == {i: model(t) for i, t, _ in rows}
    assert got[2001][1] == 1


def test_day_first_dates_are_permuted_one_to_one(spark):
    df = spark.range(146097).selectExpr("id as doc_id", "date_format(date_add(date'1800-01-01', cast(id as int)), 'dd/MM/yyyy') as text").where("text >= '13'")
    out = pii.pseudonymize(df, KEY).select("text").distinct()
    assert out.count() == df.count() and out.where("text < '13'").count() == 0


def test_very_long_words_take_time_in_proportion(spark):
    long_ = ["a1" * 500_000, "a." * 500_000, "x@" + "a." * 20_000 + "com", "sk-" * 100_000, "1 " * 200_000, "0123456789abcdef" * 40_000, "GB82" * 100_000, "a@b." * 100_000, "pkx-" * 100_000, "+1" * 200_000]
    began = time.time()
    out = pii.pseudonymize(spark.createDataFrame([(k, t, None) for k, t in enumerate(long_)], SCHEMA).repartition(4), KEY).collect()
    assert len(out) == len(long_) and all(len(o.text) == len(long_[o.doc_id]) for o in out)
    assert time.time() - began < 60


def test_a_key_is_required(spark):
    with pytest.raises(TypeError):
        pii.pseudonymize(spark.range(1))
    with pytest.raises(ValueError):
        pii.pseudonymize(spark.range(1), "it's")
