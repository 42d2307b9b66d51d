"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in DataFrame operations only.

Emails, phone, card, social-security and bank account numbers, IPv4 addresses, dates and long secrets are found by pattern
and, where their kind has a rule, validated (check digits, lengths, ranges, calendar). A value is permuted within the valid
values of its own format under a secret key: equal values get equal pseudonyms in every document, different values of one
format get different ones, and nothing else of a text changes. Of an email the part before the @ changes. Patterns have
bounded or possessive repeats only, so a text takes time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.store import fresh

ROUNDS = 8

# The length of a bank account number (IBAN) of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_ibans = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

# The patterns of each kind, in the order they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,254}+@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}+\.){1,64}[A-Za-z]{2,24}",
    "iban": rf"\b(?=[A-Z]{{2}}\d{{2}})(?:{_ibans})\b",
    "secret": r"\b(?=[a-fA-F]*+\d)(?=\d*+[a-fA-F])[0-9a-fA-F]{32,}+\b|\b(?:sk|pk|ghp|gho|AKIA|xox[bp])(?:[_\-]|(?=[A-Za-z_\-]{0,80}\d))[A-Za-z0-9_\-]{16,}+",
    "date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}\.\d{2}\.\d{4}\b|\b\d{2}/\d{2}/\d{4}\b",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\- ]\d{3}[.\- ]\d{4}(?![\d\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-]|\.\d)",
}
KINDS = tuple(PATTERNS)
#: A text without a match of this has no value of any kind.
MAYBE = r"[0-9@]|(?:sk|pk|ghp|gho|AKIA|xox[bp])[_\-]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _keyed(value: str, step: str, key: str) -> str:
    """64 hex digits that depend on the key, a round and a value."""
    return f"sha2(concat('{key}', ':', cast({step} as string), ':', cast({value} as string)), 256)"


def _number(x: str, a: int, b: int, key: str, name: str) -> str:
    """A permutation of 0 .. a*b-1 applied to the long expression x; each round shifts one part by a keyed hash of the other."""
    add = lambda of, m: f"pmod(cast(conv(substring({_keyed(of, f'concat({chr(39)}{name}{chr(39)}, i)', key)}, 1, 14), 16, 10) as bigint), {m}L)"
    step = f"if(i % 2 = 0, named_struct('l', pmod(f.l + {add('f.r', a)}, {a}L), 'r', f.r), named_struct('l', f.l, 'r', pmod(f.r + {add('f.l', b)}, {b}L)))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({x} as bigint) div {b}L, 'r', pmod(cast({x} as bigint), {b}L)), (f, i) -> {step}, f -> f.l * {b}L + f.r)"


def _shifted(c: str, k: str, hexadecimal: bool) -> str:
    """A character moved by k within its class: digits, small and capital letters; hexadecimal: within 0-9a-f or 0-9A-F."""
    low = "'0123456789abcdef'"
    if hexadecimal:
        move = f"substring({{a}}, (instr({{a}}, {c}) - 1 + {k}) % 16 + 1, 1)"
        return f"case when {c} between 'A' and 'F' then {move.format(a=f'upper({low})')} else {move.format(a=low)} end"
    move = lambda first, n: f"char({first} + (ascii({c}) - {first} + {k}) % {n})"
    return f"case when {c} between '0' and '9' then {move(48, 10)} when {c} between 'a' and 'z' then {move(97, 26)} when {c} between 'A' and 'Z' then {move(65, 26)} else {c} end"


def _string(x: str, key: str, name: str, hexadecimal: bool = False) -> str:
    """A permutation of the strings with x's classes of characters: Feistel rounds over its two halves."""

    def shift(part: str, other: str, r: int) -> str:
        k = _keyed(other, f"'{name}{r}'", key)
        amount = "cast(conv(substring(z.k, 1 + 2 * (i % 32), 2), 16, 10) as int)"
        return f"aggregate(array(struct({part} as p, {k} as k, {part} = upper({part}) and {part} rlike '[A-F]' as u)), '', (acc, z) -> array_join(transform(filter(split(z.p, ''), c -> c <> ''), (c, i) -> {_shifted('c', amount, hexadecimal)}), ''))"

    half = f"cast(length({x}) / 2 as int)"
    start = f"named_struct('l', substring({x}, 1, {half}), 'r', substring({x}, {half} + 1))"
    # the round number is part of the keyed value, so one lambda serves all rounds
    left, right = shift("f.l", "concat(j, ':', f.r)", 0), shift("f.r", "concat(j, ':', f.l)", 1)
    if hexadecimal:  # all digits of one case: capital if any is
        left, right = (e.replace("c between 'A' and 'F'", "(c between 'A' and 'F' or (z.u and c between '0' and '9'))") for e in (left, right))
    step = f"if(j % 2 = 0, named_struct('l', {left}, 'r', f.r), named_struct('l', f.l, 'r', {right}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (f, j) -> {step}, f -> concat(f.l, f.r))"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"


def _refill(digits: str, what: str = "c between '0' and '9'") -> str:
    """m with its digits, or the characters c that are what, replaced in order by those of the string expression."""
    step = f"if({what}, named_struct('o', concat(s.o, substring(s.d, 1, 1)), 'd', substring(s.d, 2)), named_struct('o', concat(s.o, c), 'd', s.d))"
    return f"aggregate(filter(split(m, ''), c -> c <> ''), named_struct('o', '', 'd', {digits}), (s, c) -> {step}, s -> s.o)"


def _luhn(digits: str) -> str:
    """The Luhn sum of a string of digits."""
    d = "cast(substring(reverse({x}), i, 1) as int)".format(x=digits)
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if(i % 2 = 1, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _rules(key: str) -> dict[str, tuple[str, str]]:
    """For each kind: the SQL test of a match m, and its pseudonym."""
    lead = f"substring({_DIGITS}, 1, length({_DIGITS}) - 1)"
    body = f"cast({lead} as bigint)"
    sizes = {n: _number(body, 10 ** ((n + 1) // 2), 10 ** (n // 2), key, f"card{n}") for n in range(12, 19)}
    payload = "case length(" + lead + ") " + " ".join(f"when {n} then lpad(cast({e} as string), {n}, '0')" for n, e in sizes.items()) + " end"
    full = f"aggregate(array({payload}), '', (acc, p) -> concat(p, cast(pmod(10 - {_luhn('concat(p, {z})').format(z=chr(39) + '0' + chr(39))} % 10, 10) as string)))"
    octets = "transform(split(m, '\\\\.'), o -> cast(o as int))"
    ip = "aggregate(split(m, '\\\\.'), 0L, (t, o) -> t * 256 + cast(o as int))"
    ip_new = f"aggregate(array({_number(ip, 65536, 65536, key, 'ip')}), '', (acc, v) -> concat_ws('.', v div 16777216, (v div 65536) % 256, (v div 256) % 256, v % 256))"
    ten = f"right({_DIGITS}, 10)"
    nanp = f"((cast(substring({ten}, 1, 3) as bigint) - 200) * 8000000 + (cast(substring({ten}, 4, 3) as bigint) - 200) * 10000 + cast(substring({ten}, 7) as bigint))"
    number = f"aggregate(array({_number(nanp, 80000, 80000, key, 'phone')}), '', (acc, v) -> concat(cast(v div 8000000 + 200 as string), cast((v div 10000) % 800 + 200 as string), lpad(cast(v % 10000 as string), 4, '0')))"
    country = f"substring({_DIGITS}, 1, length({_DIGITS}) - 10)"
    plus = f"concat(substring({_DIGITS}, 1, 2), {_string(f'substring({_DIGITS}, 3)', key, 'phone')})"
    is_nanp = f"length({_DIGITS}) >= 10 and {country} in ('', '1') and {ten} rlike '^[2-9][0-9]{{2}}[2-9]'"
    phone = f"if({is_nanp}, {_refill(f'concat({country}, {number})')}, {_refill(plus)})"
    area = f"(cast(substring({_DIGITS}, 1, 3) as bigint))"
    ssn = f"((({area} - if({area} > 666, 2, 1)) * 99 + cast(substring({_DIGITS}, 4, 2) as bigint) - 1) * 9999 + cast(substring({_DIGITS}, 6) as bigint) - 1)"
    ssn_new = f"aggregate(array({_number(ssn, 88902, 9999, key, 'ssn')}), '', (acc, v) -> concat_ws('-', lpad(cast(v div 989901 + if(v div 989901 >= 665, 2, 1) as string), 3, '0'), lpad(cast((v div 9999) % 99 + 1 as string), 2, '0'), lpad(cast(v % 9999 + 1 as string), 4, '0')))"
    form = "case when m rlike '^[0-9]{4}-' then 'yyyy-MM-dd' when m like '%.%' then 'dd.MM.yyyy' when try_to_timestamp(m, 'MM/dd/yyyy') is not null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    day = f"(datediff(cast(try_to_timestamp(m, {form}) as date), date'1800-01-01'))"
    as_date = lambda x: f"date_add(date'1800-01-01', cast({x} as int))"
    # with slashes, the first number is a day where it is over 12: the permutation goes on until it is again
    walk = f"aggregate(sequence(1, 64), {_number(day, 773, 189, key, 'date')}, (v, t) -> if(dayofmonth({as_date('v')}) <= 12, {_number('v', 773, 189, key, 'date')}, v))"
    date_new = f"date_format({as_date(f"if({form} = 'dd/MM/yyyy', {walk}, {_number(day, 773, 189, key, 'date')})")}, {form})"
    iban = "regexp_replace(m, ' ', '')"
    digits = lambda x: f"aggregate(filter(split({x}, ''), c -> c <> ''), 0, (t, c) -> if(c between '0' and '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97))"
    check = lambda b: f"lpad(cast(98 - {digits(f"concat({b}, substring({iban}, 1, 2), '00')")} as string), 2, '0')"
    bban = f"substring({iban}, 5)"
    iban_ok = f"substring({iban}, 3, 2) = {check(bban)}"
    iban_new = f"aggregate(array({_string(bban, key, 'iban')}), '', (acc, b) -> concat(substring({iban}, 1, 2), {check('b')}, b))"
    at = "instr(m, '@')"
    return {
        "email": ("true", f"concat({_string(f'substring(m, 1, {at} - 1)', key, 'email')}, substring(m, {at}))"),
        "iban": (iban_ok, _refill(iban_new, "c <> ' '")),
        "secret": ("true", f"if(m rlike '^[0-9a-fA-F]+$', if(m = lower(m) or m = upper(m), {_string('m', key, 'hex', True)}, {_string('m', key, 'token')}), {_string('m', key, 'token')})"),
        "date": (f"{day} between 0 and 146096", date_new),
        "ip": (f"forall({octets}, o -> o < 256)", ip_new),
        "ssn": (f"{area} between 1 and 899 and {area} <> 666 and m not like '%-00-%' and m not like '%-0000'", ssn_new),
        "phone": (f"length({_DIGITS}) between 8 and 15", phone),
        "card": (f"length({_DIGITS}) between 13 and 19 and {_luhn(_DIGITS)} % 10 = 0", _refill(full)),
    }


def _within(kind: str) -> str:
    """(new, n) of a match m that is no value itself: the values within it replaced, and how many.

    A value begins and ends where a run of letters and digits does. From the left, at each place the longest value counts.
    kind: the SQL of what a text m becomes.
    """
    edge = "substring(m, {0}, 1) rlike '[0-9A-Za-z]'"
    starts = f"filter(sequence(1, length(m)), i -> substring(m, i, 1) rlike '[0-9A-Za-z(+]' and (i = 1 or not {edge.format('i - 1')}))"
    ends = f"filter(sequence(length(m), 1, -1), e -> {edge.format('e')} and (e = length(m) or not {edge.format('e + 1')}))"
    part = "substring(m, i, e - i + 1)"
    tried = f"transform(filter({ends}, e -> e - i >= 6 and length(regexp_replace({part}, '[^0-9]', '')) >= 4), e -> named_struct('e', e, 'old', {part}, 'new', aggregate(array({part}), '', (acc, m) -> {kind})))"
    hit = f"get(filter({tried}, x -> x.new <> x.old), 0)"
    step = f"if(i < f.at, f, aggregate(array({hit}), f, (g, x) -> if(x is null, g, named_struct('o', concat(g.o, substring(m, g.at, i - g.at), x.new), 'at', x.e + 1, 'n', g.n + 1))))"
    return f"aggregate({starts}, named_struct('o', '', 'at', 1, 'n', 0), (f, i) -> {step}, f -> named_struct('new', concat(f.o, substring(m, f.at)), 'n', f.n))"


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal data in text replaced, and n_private, the number of replaced values; all other columns stay.

    Whole texts are searched, of any length and with words of any length. What looks like a value and fails its kind's
    validation is searched for values within it, since numbers beside a value may have been taken for a part of it; what is none
    then stays (a number that no check digit confirms is no card), as does what has over 255 characters before an @. Null text
    stays null with 0; texts without such values are unchanged; repeated rows give repeated results; a column n_private
    gives way; an empty table gives no rows. The key is the caller's secret and may hold letters, digits and -.
    """
    if not key or not all(c.isalnum() or c == "-" for c in key):
        raise ValueError("key: letters, digits and - only")
    any_ = _quoted("|".join(f"(?:{p})" for p in PATTERNS.values()))
    kind = "case " + " ".join(f"when m rlike {_quoted(f'^(?:{p})$')} and coalesce({ok}, false) then {new}" for (k, p), (ok, new) in zip(PATTERNS.items(), _rules(key).values(), strict=True)) + " else m end"
    kept = docs.drop("n_private")
    m, new = fresh(kept, "_m"), fresh(kept, "_new")
    out = kept.withColumn("text", F.col("text").cast("string"))
    out = out.withColumn(m, F.expr(f"if(text rlike {_quoted(MAYBE)}, regexp_extract_all(text, {any_}, 0), array())"))
    whole = f"transform({m}, m -> named_struct('m', m, 'new', {kind}))"
    inner = f"transform({whole}, x -> if(x.m <> x.new or length(x.m) < 9, named_struct('new', x.new, 'n', if(x.m <> x.new, 1, 0)), aggregate(array(x.m), named_struct('new', x.m, 'n', 0), (acc, m) -> {_within(kind)})))"
    out = out.withColumn(new, F.expr(inner))
    rebuilt = f"array_join(zip_with(split(text, {any_}), {new}, (a, b) -> concat(coalesce(a, ''), coalesce(b.new, ''))), '')"
    n = f"aggregate({new}, 0, (t, x) -> t + x.n)"
    return out.withColumn("n_private", F.expr(f"if(text is null, 0, {n})")).withColumn("text", F.expr(f"if(size({m}) > 0, {rebuilt}, text)")).select(*kept.columns, "n_private")
