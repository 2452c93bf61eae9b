"""Format-preserving pseudonyms for personal data, in SQL functions only.

Validated numbers and dates are permuted within their format by a keyed Feistel network, so the
same value gets the same pseudonym wherever it stands, a pseudonym is itself valid, and different
values stay different. Permuting again until the outcome is valid keeps it a permutation of the
valid values.

=========  ===============================================  ==========================================
kind       valid                                            what is permuted
=========  ===============================================  ==========================================
card       13 to 19 digits, in groups or not, Luhn holds    all but the first and the check digit
iban       15 to 34 characters, six digits or more behind   the digits behind the check digits
           the check digits, modulo 97
ssn        ddd-dd-dddd, no part of zeros, below 900, not    all nine digits
           666
phone      + and 8 to 15 digits, or ten digits in groups    the digits behind the country's
ip         four numbers up to 255                           all 32 bits
date       yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy   the day, among those from 1900 to 2099
           or dd/mm/yyyy, with or without leading zeros,
           March 5, 1990 or 5 March 1990
email      a name and a host                                the name: a keyed digest, not a permutation
=========  ===============================================  ==========================================

What is not valid stays as it is. A run of digits in groups, however long, is searched for cards made of
whole groups. Of cards that overlap, from the left on, that of more digits is taken; the groups beside
them stay. A run ends where a value of another kind begins.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

#: How each kind is written; the first that matches holds, and no match lies within a longer word or number.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\p{N}-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}.-])\d{4}-\d{2}-\d{2}(?![\p{N}-])|(?<![\p{L}\p{N}/])\d{4}/\d{2}/\d{2}(?![\p{N}/])|(?<![\p{L}\p{N}.])\d{1,2}\.\d{1,2}\.\d{4}(?!\p{N})|(?<![\p{L}\p{N}/])\d{1,2}/\d{1,2}/\d{4}(?![\p{N}/])"
    rf"|(?<![\p{{L}}\p{{N}}])(?:{MONTHS}) \d{{1,2}}, \d{{4}}(?!\p{{N}})|(?<![\p{{L}}\p{{N}}])\d{{1,2}} (?:{MONTHS}) \d{{4}}(?!\p{{N}})",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
}
#: Digits joined by hyphens, beside no letter or further hyphen; a run is such units, a space between them, none of which begins another kind.
UNIT = r"\d++(?:-\d++)*+(?![\p{L}\p{N}-])"
PATTERNS["card"] = rf"(?<![\p{{L}}\p{{N}}-])(?=\d(?:[ -]?\d){{12}}){UNIT}(?: (?!{'|'.join(PATTERNS.values())}){UNIT})*+"
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
ROUNDS = 10
WALK = 48


class Named(str):
    """SQL that stands for a key, in place of the key."""


def derived(key: str, kind: str) -> str:
    """The key of one kind, from which neither ``key`` nor that of another kind can be had."""
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


def key_row(spark: SparkSession, key: str) -> DataFrame:
    """One row, ``keys``: a struct of the derived keys. It is a local relation, of which a plan shows the names but not the values."""
    values = ", ".join(f"'{k}', :{k}" for k in KINDS)
    return spark.sql(f"select * from values (named_struct({values})) as t(keys)", {k: derived(key, k) for k in KINDS})


def _text(x: str) -> str:
    if isinstance(x, Named):
        return str(x)
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digest(key: str, *parts: str) -> str:
    """SQL: 60 bits of a keyed digest of the parts."""
    joined = ", ".join(f"cast({p} as string)" for p in parts)
    return f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, {joined}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, kind: str, value: str, high: str, low: str) -> str:
    """SQL: a keyed permutation of the numbers below high * low. Halves take turns: even rounds change the upper one."""
    start = f"named_struct('a', {value} div {low}, 'b', {value} % {low})"
    mix = lambda half, with_: _digest(key, f"'{kind}'", high, low, "r", with_)  # noqa: E731, ARG005
    step = f"if(r % 2 = 0, named_struct('a', (s.a + {mix('a', 's.b')}) % {high}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {mix('b', 's.a')}) % {low}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> s.a * {low} + s.b)"


def walked(permuted: str, start: str, valid: str) -> str:
    """SQL: ``permuted`` (of y) from ``start`` on, again until ``valid`` (of y) holds; an error after ``WALK`` steps in vain."""
    return f"aggregate(sequence(1, {WALK}), named_struct('y', {start}, 'go', true), (w, i) -> if(w.go, {_let('y', _let('y', 'w.y', permuted), f'''named_struct('y', y, 'go', not ({valid}))''')}, w), w -> if(w.go, raise_error('no valid pseudonym was reached'), w.y))"


def digits_permuted(key: str, kind: str, digits: str) -> str:
    """SQL: a string of 2 to 30 digits permuted among the strings of its length, each half at most 15 digits."""
    low = "cast(pow(10, length(d) div 2) as bigint)"
    high = "cast(pow(10, length(d) - length(d) div 2) as bigint)"
    a, b = "cast(left(d, length(d) - length(d) div 2) as bigint)", "cast(right(d, length(d) div 2) as bigint)"
    mix = lambda with_: _digest(key, f"'{kind}'", "length(d)", "r", with_)
    step = f"if(r % 2 = 0, named_struct('a', (s.a + {mix('s.b')}) % {high}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {mix('s.a')}) % {low}))"
    whole = f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {a}, 'b', {b}), (s, r) -> {step}, s -> concat(lpad(cast(s.a as string), length(d) - length(d) div 2, '0'), lpad(cast(s.b as string), length(d) div 2, '0')))"
    return _let("d", digits, whole)


def luhn(digits: str) -> str:
    """SQL: the Luhn sum modulo 10 of a string of digits; 0 for a valid number."""
    one = "cast(substr(d, length(d) - i, 1) as int)"
    term = f"if(i % 2 = 0, {one}, if({one} < 5, 2 * {one}, 2 * {one} - 9))"
    return _let("d", digits, f"aggregate(sequence(0, length(d) - 1), 0, (s, i) -> s + {term}) % 10")


def refilled(format_: str, digits: str) -> str:
    """SQL: ``format_`` with its digits replaced by ``digits``, in order."""
    step = "named_struct('o', concat(s.o, if(c between '0' and '9', substr(s.d, s.k, 1), c)), 'd', s.d, 'k', s.k + if(c between '0' and '9', 1, 0))"
    return f"aggregate(regexp_extract_all({format_}, '(?s).', 0), named_struct('o', '', 'd', {digits}, 'k', 1), (s, c) -> {step}, s -> s.o)"


def _card(key: str) -> str:
    """SQL: struct (kind, new, n) of a run v of digits in groups with its ``n`` cards replaced."""
    size, digits = "size(g)", "array_join(transform(slice(g, i + 1, j - i + 1), x -> regexp_extract(x, '[0-9]+', 0)), '')"
    # groups i to j: 19 of them at most, as each has a digit
    spans = f"transform(sequence(i, least(i + 18, {size} - 1)), j -> named_struct('n', length({digits}), 'd', {digits}, 'a', i, 'b', j))"
    cards = f"flatten(transform(sequence(0, {size} - 1), i -> filter({spans}, c -> c.n between 13 and 19 and {luhn('c.d')} = 0 and c.d rlike '[1-9]')))"
    none = "named_struct('n', 0, 'd', '', 'a', -1, 'b', -1)"
    step = "if(c.a > s.p.b, named_struct('done', concat(s.done, array(s.p)), 'p', c), if(c.n > s.p.n, named_struct('done', s.done, 'p', c), s))"
    taken = f"aggregate({cards}, named_struct('done', filter(array({none}), x -> false), 'p', {none}), (s, c) -> {step}, s -> filter(concat(s.done, array(s.p)), x -> x.n > 0))"
    body = f"concat(left(c.d, 1), {digits_permuted(key, 'card', 'substr(c.d, 2, length(c.d) - 2)')})"
    check = f"cast((10 - {luhn('concat(p, chr(48))')}) % 10 as string)"
    groups = lambda begin, number: f"array_join(slice(g, {begin}, {number}), '')"
    before = "if(k = 0, -1, q[greatest(k - 1, 0)].b)"
    made = _let("p", body, refilled(groups("c.a + 1", "c.b - c.a + 1"), f"concat(p, {check})"))
    parts = f"transform(q, (c, k) -> concat({_let('z', before, groups('z + 2', 'c.a - z - 1'))}, {made}))"
    rest = groups("element_at(q, -1).b + 2", size)
    found = f"named_struct('kind', 'card', 'new', concat(array_join({parts}, ''), {rest}), 'n', size(q))"
    return _let("g", "regexp_extract_all(v, '[0-9]+[ -]?', 0)", _let("q", taken, f"if(size(q) > 0, {found}, named_struct('kind', cast(null as string), 'new', v, 'n', 0))"))


def _iban(key: str) -> tuple[str, str]:
    plain, bare = "replace(v, ' ', '')", "regexp_replace(substr(v, 5), '[^0-9]', '')"
    rest = lambda check: f"aggregate(split(concat(substr(x, 5), left(x, 2), {check}), ''), 0, (s, c) -> case when c = '' then s when c between '0' and '9' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end)"
    valid = f"length({bare}) >= 6 and " + _let("x", plain, f"length(x) between 15 and 34 and {rest('substr(x, 3, 2)')} = 1")
    moved = refilled("v", f"concat(substr(v, 3, 2), {digits_permuted(key, 'iban', bare)})")
    made = _let("m", moved, _let("x", "replace(m, ' ', '')", refilled("m", f"concat(lpad(cast(98 - {rest(chr(39) + '00' + chr(39))} as string), 2, '0'), regexp_replace(substr(m, 5), '[^0-9]', ''))")))
    return valid, made


def _ssn(key: str) -> tuple[str, str]:
    valid = lambda d: f"left({d}, 3) not in ('000', '666') and left({d}, 1) <> '9' and substr({d}, 4, 2) <> '00' and right({d}, 4) <> '0000'"
    made = walked(digits_permuted(key, "ssn", "y"), "replace(v, '-', '')", valid("y"))
    return valid("replace(v, '-', '')"), refilled("v", made)


def _phone(key: str) -> tuple[str, str]:
    digits = "regexp_replace(v, '[^0-9]', '')"
    country = "if(v like '+%', length(regexp_extract(v, '^\\\\+([0-9]{1,3})(?=[ .(-])', 1)), 0)"
    country = f"if(v rlike '^1[ .-]', 1, if(v like '+%' and {country} = 0, 2, {country}))"
    made = _let("k", country, _let("d0", digits, refilled("v", f"concat(left(d0, k), {digits_permuted(key, 'phone', 'substr(d0, k + 1)')})")))
    return f"length({digits}) between 8 and 15", made


def _ip(key: str) -> tuple[str, str]:
    part = lambda k: f"cast(split(v, '[.]')[{k}] as bigint)"
    value = f"{part(0)} * 16777216 + {part(1)} * 65536 + {part(2)} * 256 + {part(3)}"
    made = _let("y", _let("y", value, feistel(key, "ip", "y", "65536", "65536")), "concat_ws('.', y div 16777216, y div 65536 % 256, y div 256 % 256, y % 256)")
    return "not exists(split(v, '[.]'), p -> cast(p as int) > 255 or p rlike '^0[0-9]')", made


def _date(key: str) -> tuple[str, str]:
    part = lambda k: f"lpad(element_at(split(v, '[-/.]'), {k}), greatest(2, length(element_at(split(v, '[-/.]'), {k}))), '0')"
    american = f"(v rlike '^[0-9]{{1,2}}/' and cast({part(1)} as int) <= 12)"
    short = "v rlike '(^|[./])[0-9]([./]|$)'"
    styles = [
        ("v like '%-%'", "'yyyy-MM-dd'", f"concat_ws('-', {part(1)}, {part(2)}, {part(3)})"), ("v rlike '^[0-9]{4}/'", "'yyyy/MM/dd'", f"concat_ws('-', {part(1)}, {part(2)}, {part(3)})"),
        ("v like '%.%'", f"if({short}, 'd.M.yyyy', 'dd.MM.yyyy')", f"concat_ws('-', {part(3)}, {part(2)}, {part(1)})"), (american, f"if({short}, 'M/d/yyyy', 'MM/dd/yyyy')", f"concat_ws('-', {part(3)}, {part(1)}, {part(2)})"),
        ("v like '%/%'", f"if({short}, 'd/M/yyyy', 'dd/MM/yyyy')", f"concat_ws('-', {part(3)}, {part(2)}, {part(1)})"),
        ("v like '%,%'", "'MMMM d, yyyy'", "cast(try_to_date(v, 'MMMM d, yyyy') as string)"), ("true", "'d MMMM yyyy'", "cast(try_to_date(v, 'd MMMM yyyy') as string)"),
    ]
    pick = lambda k: "case " + " ".join(f"when {s[0]} then {s[k]}" for s in styles) + " end"
    parsed = f"try_to_date({pick(2)}, 'yyyy-MM-dd')"
    first, days = "date'1900-01-01'", "datediff(date'2100-01-01', date'1900-01-01')"
    late = f"(v not like '%/%' or v rlike '^[0-9]{{4}}' or {american} or day(date_add({first}, cast(y as int))) > 12)"  # what reads as dd/mm must go on to do so
    made = walked(feistel(key, "date", "y", "271", "270"), f"cast(datediff({parsed}, {first}) as bigint)", f"case when y >= {days} then false else {late} end")
    return f"{parsed} between {first} and date'2099-12-31'", f"date_format(date_add({first}, cast({made} as int)), {pick(1)})"


def _email(key: str) -> tuple[str, str]:
    name = f"substr(sha2(concat_ws('|', {_text(key)}, 'email', lower(v)), 256), 1, 12)"
    return "true", f"concat('user', {name}, substr(v, instr(v, '@')))"


def pseudonym(keys: str) -> str:
    """SQL: struct (kind, new, n) of a matched string v with n values; kind is null where none is valid and all stays. ``keys`` is a column as of ``key_row``."""
    arms, stays = [], "named_struct('kind', cast(null as string), 'new', v, 'n', 0)"
    whole = {kind: PATTERNS[kind] for kind in ("email", "iban", "ip")}
    whole |= {"phone": r"^\+|\(|^(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}$", "date": rf"^\d{{4}}([-/])\d{{2}}\1\d{{2}}$|^\d{{1,2}}([./])\d{{1,2}}\2\d{{4}}$|{MONTHS}", "ssn": r"^\d{3}-\d{2}-\d{4}$"}
    for kind, make in {"email": _email, "ip": _ip, "phone": _phone, "iban": _iban, "date": _date, "ssn": _ssn}.items():
        valid, made = make(Named(f"{keys}.{kind}"))
        arms.append(f"when v rlike {_text(whole[kind])} then if(coalesce({valid}, false), named_struct('kind', '{kind}', 'new', {made}, 'n', 1), {stays})")
    arms.append(f"when v rlike {_text(r'^[0-9 -]{13,}$')} then {_card(Named(f'{keys}.card'))}")
    return "case " + " ".join(arms) + f" else {stays} end"


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in text, and the number of each kind found: n_card, n_iban, n_ssn, n_phone, n_ip, n_date, n_email.

    Other columns stay; any of these names among them is replaced. A null text stays null and has
    none found, an empty one stays empty, a long one is read whole. Equal values get equal pseudonyms
    in whatever row; rows that repeat stay. No rows: no rows. Whoever has ``key`` can undo the
    permutations. Neither it nor what is derived from it is shown by a plan, as the keys come to the
    rows by a scalar subquery. Hosts of e-mail addresses stay in clear.
    """
    new = [f"n_{k}" for k in sorted(KINDS)]
    rest = [c for c in docs.columns if c not in new and c != "text"]
    found, keys = "found", "keys"
    taken = {c.lower() for c in docs.columns}
    while found in taken:
        found += "_"
    while keys in taken:
        keys += "_"
    keyed = docs.select(*rest, "text", key_row(docs.sparkSession, key).scalar().alias(keys))
    marked = keyed.select(*rest, "text", F.expr(f"if(text rlike '[0-9@]', transform(regexp_extract_all(text, {_text(ANY)}, 0), v -> {pseudonym(keys)}), null)").alias(found))
    text = F.expr(f"if(size({found}) > 0, array_join(zip_with(split(text, {_text(ANY)}), {found}, (t, f) -> concat(t, coalesce(f.new, ''))), ''), text)")
    counts = [F.expr(f"coalesce(aggregate(filter({found}, f -> f.kind = '{n[2:]}'), 0L, (s, f) -> s + f.n), 0L)").alias(n) for n in new]
    return marked.select(*rest, text.alias("text"), *counts)
