"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

One pattern finds candidates: e-mail addresses, secrets, dates, social security numbers, IBANs, phone numbers, IPv4 and IPv6
addresses and card numbers. A candidate is replaced only if it is valid: card numbers and IBANs by their check digits,
addresses by their groups, phone numbers by their length, social security numbers by their ranges, dates by the calendar.

The pseudonym is made by a Feistel network over the two halves of the value's characters. In each round a keyed hash of
one half gives a number for every character of the other half, which is added to it within its class: digits stay
digits, lower and upper case letters stay so, all else stands. So the result has the same format, distinct values get
distinct pseudonyms, and equal values get equal ones in every document. Card numbers and IBANs are permuted without
their check digits, which are computed anew; IP addresses as hexadecimal digits; dates (days since 1900-01-01, 2**16 of
them) as 4 such digits; social security numbers are permuted again until they are valid ones (cycle walking).

Secrets of any length are replaced whole: after a naming word with = or :, letters, digits and `_ / + = ~ . -` up to a blank,
a quote or another mark. Left as they are: values without a form listed here, such as names, street addresses, secrets that
no word announces, national phone numbers other than of 3-3-4 digits, dates with month names or two-digit years.

The key is a parameter without a default; `key_of` takes it from the session's settings. Whoever has it can undo the
pseudonyms. Plans hold one salt a kind, derived from it by HMAC-SHA-256 and beginning with `salt-`, so that
spark.sql.redaction.string.regex can blot them out of logs.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, WALK = 8, 24
#: Characters that one SHA-512 serves.
BLOCK = 42
KEY_SETTING = "spark.barlake.pseudonym.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"(?<![A-Za-z0-9])(?:(?i:password|passwd|token|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?[A-Za-z0-9_/+=~.-]{7,}[A-Za-z0-9_/+=~-]|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))"
CARD = r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
IPV6 = r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01]?[0-9]-[0-3]?[0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "date": DATE, "ssn": SSN, "iban": IBAN, "phone": PHONE, "phone_abroad": ABROAD, "ip": IPV4, "ipv6": IPV6, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def key_of(spark: SparkSession) -> str:
    """The key in spark.barlake.pseudonym.key. Where that is unset a random one is drawn and set for the session: its pseudonyms are linked
    with one another, but with no other session's."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def salt_of(key: str, kind: str) -> str:
    return f"salt-{hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()}|"


def _sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with(name: str, value: str, body: str) -> str:
    """body with `name` standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shift(half: str, seed: str, radix: str) -> str:
    """Each character of `half` moved within its class by its three hexadecimal digits of the stream: SHA-512 of `seed`, and of the
    seed and a number for every further BLOCK characters."""
    step = f"cast(conv(substr(ks[j div {BLOCK}], 3 * (j % {BLOCK}) + 1, 3), 16, 10) as int)"
    if radix == "hex":
        moved = f"lower(hex((cast(conv(c, 16, 10) as int) + {step}) % 16))"
    else:
        moved = (
            f"case when c between '0' and '9' then chr((ascii(c) - 48 + {step}) % 10 + 48) "
            f"when c between 'a' and 'z' then chr((ascii(c) - 97 + {step}) % 26 + 97) "
            f"when c between 'A' and 'Z' then chr((ascii(c) - 65 + {step}) % 26 + 65) else c end"
        )
    stream = f"transform(sequence(0, (length({half}) - 1) div {BLOCK}), b -> sha2(concat({seed}, case when b = 0 then '' else concat('|', b) end), 512))"
    joined = f"array_join(transform(split({half}, ''), (c, j) -> {moved}), '')"
    return f"case when length({half}) = 0 then '' else {_with('ks', stream, joined)} end"


def feistel_sql(value: str, kind: str, key: str, radix: str = "class", rounds: int = ROUNDS) -> str:
    """SQL of the keyed permutation of `value` (an SQL expression for a string of any length)."""
    half = f"(length({value}) div 2)"
    salt = _sql_string(salt_of(key, kind))
    seed = f"concat({salt}, r, '|', length(s.a) + length(s.b), '|', {{}})"
    start = f"struct(substr({value}, 1, {half}) as a, substr({value}, {half} + 1) as b)"
    even = f"struct({_shift('s.a', seed.format('s.b'), radix)} as a, s.b as b)"
    odd = f"struct(s.a as a, {_shift('s.b', seed.format('s.a'), radix)} as b)"
    return f"aggregate(sequence(0, {rounds - 1}), {start}, (s, r) -> case when r % 2 = 0 then {even} else {odd} end, s -> concat(s.a, s.b))"


def _luhn_sum(digits: str, doubled_from: int) -> str:
    """Sum of a digit string's digits from the right, every second doubled; doubled_from 0: the last one is doubled."""
    d = f"cast(substr({digits}, length({digits}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, j) -> t + case when j % 2 = {doubled_from} then case when {d} > 4 then 2 * {d} - 9 else 2 * {d} end else {d} end)"


def _refill(pattern: str, digits: str) -> str:
    """The pattern's digits replaced in order by those of `digits`."""
    return (
        f"aggregate(sequence(1, length({pattern})), struct('' as t, 1 as k), (s, i) -> case when substr({pattern}, i, 1) between '0' and '9' "
        f"then struct(concat(s.t, substr({digits}, s.k, 1)) as t, s.k + 1 as k) else struct(concat(s.t, substr({pattern}, i, 1)) as t, s.k as k) end, s -> s.t)"
    )


def _refill_all(pattern: str, chars: str) -> str:
    """The pattern's letters and digits replaced in order by those of `chars`."""
    one = f"substr({pattern}, i, 1)"
    return (
        f"aggregate(sequence(1, length({pattern})), struct('' as t, 1 as k), (s, i) -> case when {one} rlike '[0-9A-Za-z]' "
        f"then struct(concat(s.t, substr({chars}, s.k, 1)) as t, s.k + 1 as k) else struct(concat(s.t, {one}) as t, s.k as k) end, s -> s.t)"
    )


def _mod97(text: str) -> str:
    return f"aggregate(split({text}, ''), 0, (t, c) -> case when c between '0' and '9' then (t * 10 + ascii(c) - 48) % 97 when c between 'A' and 'Z' then (t * 100 + ascii(c) - 55) % 97 else t end)"


def _iban(m: str, key: str) -> str:
    """Country stays, the account is permuted, the check digits are computed anew."""
    valid = f"length(d) between 15 and 34 and {_mod97('concat(substr(d, 5), substr(d, 1, 4))')} = 1"
    check = f"lpad(cast(98 - {_mod97(_sql_concat('q', 'substr(d, 1, 2)', _sql_string('00')))} as string), 2, '0')"
    made = _with("q", feistel_sql("substr(d, 5)", "iban", key), _refill_all(m, f"concat(substr(d, 1, 2), {check}, q)"))
    return _with("d", f"replace({m}, ' ', '')", f"case when {valid} then {made} end")


def _sql_concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _ipv6(m: str, key: str) -> str:
    """Hexadecimal digits are permuted, in lower case; where groups are left out, they stay so."""
    groups = f"size(filter(split({m}, ':'), g -> g <> ''))"
    made = _with("q", feistel_sql("d", "ipv6", key, "hex"), _refill_all(m, "q"))
    return _with("d", f"lower(replace({m}, ':', ''))", f"case when {m} rlike '[0-9]' and ({groups} = 8 or ({m} like '%::%' and {groups} < 8)) then {made} end")


def _abroad(m: str, key: str) -> str:
    """The country code (its first two digits if nothing sets it off) stays, the rest of 7 to 13 digits is permuted."""
    code = f"coalesce(nullif(regexp_extract({m}, {_sql_string('^[+][0-9]{1,3}(?=[ .(-])')}, 0), ''), substr({m}, 1, 3))"
    rest = f"substr({m}, length(p) + 1)"
    made = _with("q", feistel_sql("d", "phone", key), _refill(rest, "q"))
    return _with("p", code, _with("d", f"regexp_replace({rest}, '[^0-9]', '')", f"case when length(d) between 7 and 13 then concat(p, {made}) end"))


def _card(m: str, key: str) -> str:
    """The longest run of whole digit groups that has 13 to 19 digits and a right check digit is permuted, what is around it stays."""
    payload = feistel_sql("substr(d, 1, length(d) - 1)", "card", key)
    check = f"(10 - {_luhn_sum('q', 0)} % 10) % 10"
    made = _with("d", "translate(v.m, ' -', '')", _with("q", payload, _refill("v.m", f"concat(q, {check})")))
    part = "array_join(slice(g, {}, {}), '')"
    reading = f"struct({part.format(1, 'u')} as h, {part.format('u + 1', 'size(g) - e')} as m, {part.format('u + size(g) - e + 1', 'e - u')} as z)"
    readings = f"flatten(transform(sequence(0, size(g) - 1), e -> transform(sequence(0, e), u -> {reading})))"
    passes = _with("d", "translate(y.m, ' -', '')", f"length(d) between 13 and 19 and {_luhn_sum('d', 1)} % 10 = 0")
    best = f"filter({readings}, y -> case when length(y.m) > 12 then {passes} else false end)"
    return _with("g", f"regexp_extract_all({m}, '[0-9]+[ -]?', 0)", _with("w", best, f"case when size(w) > 0 then {_with('v', 'w[0]', f'concat(v.h, {made}, v.z)')} end"))


def _ip(m: str, key: str) -> str:
    packed = "array_join(transform(o, x -> lpad(lower(hex(x)), 2, '0')), '')"
    back = "array_join(transform(sequence(0, 3), k -> conv(substr(h, 2 * k + 1, 2), 16, 10)), '.')"
    return _with("o", f"transform(split({m}, '[.]'), x -> cast(x as int))", f"case when forall(o, x -> x < 256) then {_with('h', feistel_sql(packed, 'ip', key, 'hex'), back)} end")


def _ssn_valid(d: str) -> str:
    return f"substr({d}, 1, 3) not in ('000', '666') and substr({d}, 1, 1) <> '9' and substr({d}, 4, 2) <> '00' and substr({d}, 6) <> '0000'"


def _ssn(m: str, key: str) -> str:
    once = feistel_sql("w.d", "ssn", key)
    walk = f"aggregate(sequence(1, {WALK}), struct(d as d, false as done), (w, n) -> case when w.done then w else {_with('f', once, f'struct(f as d, {_ssn_valid("f")} as done)')} end, w -> w.d)"
    return _with("d", f"translate({m}, '-', '')", f"case when {_ssn_valid('d')} then {_with('q', walk, _refill(m, 'q'))} end")


def _date(m: str, key: str) -> str:
    def through(style: str) -> str:
        days = f"datediff(to_date({m}, '{style}'), date '1900-01-01')"
        hexed = f"lpad(lower(hex({days})), 4, '0')"
        return _with("h", feistel_sql(hexed, "date", key, "hex"), f"date_format(date_add(date '1900-01-01', cast(conv(h, 16, 10) as int)), '{style}')")

    two, short = "[0-9]{2}", "[0-9]{1,2}"
    arms = []
    for style in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "MM.dd.yyyy", "yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy", "M.d.yyyy"):
        digits = two if "MM" in style else short
        shape = "[0-9]{4}" + f"-{digits}-{digits}" if style[0] == "y" else digits + f"[{style[2 if 'MM' in style else 1]}]" + digits + f"[{style[2 if 'MM' in style else 1]}]" + "[0-9]{4}"
        parsed = f"try_to_date({m}, '{style}')"
        arms.append(f"when {m} rlike '^{shape}$' and {parsed} is not null and {parsed} between date '1900-01-01' and date '2079-06-05' then {through(style)}")
    return f"case {' '.join(arms)} end"


def _secret(m: str, key: str) -> str:
    """The word before = or : stays, what follows is permuted."""
    head = f"regexp_extract({m}, {_sql_string('^(?:AKIA|[^=:]*[=:][ ]*[\"' + chr(39) + ']?)')}, 0)"
    return _with("w", head, f"concat(w, {feistel_sql(f'substr({m}, length(w) + 1)', 'secret', key)})")


def _email(m: str, key: str) -> str:
    local = f"substring_index({m}, '@', 1)"
    return f"concat({feistel_sql(local, 'email', key)}, '@', {feistel_sql(f'substr(regexp_replace({m}, {_sql_string("[.][A-Za-z0-9-]+$")}, {_sql_string("")}), instr({m}, {_sql_string("@")}) + 1)', 'host', key)}, regexp_extract({m}, {_sql_string('[.][A-Za-z0-9-]+$')}, 0))"


def _phone(m: str, key: str) -> str:
    """The country code stays, the ten digits are permuted."""
    code = f"regexp_extract({m}, {_sql_string('^[+][0-9]{1,3}[ .-]?')}, 0)"
    rest = f"substr({m}, length(p) + 1)"
    digits = f"regexp_replace({rest}, '[^0-9]', '')"
    return _with("p", code, f"concat(p, {_with('q', feistel_sql(digits, 'phone', key), _refill(rest, 'q'))})")


def _replacement(key: str) -> str:
    """SQL: array of struct(kind, new) of the candidates in `found`; new is null where a candidate isn't valid."""
    makers = {"email": _email, "secret": _secret, "date": _date, "ssn": _ssn, "iban": _iban, "phone": _phone, "phone_abroad": _abroad, "ip": _ip, "ipv6": _ipv6, "card": _card}
    whole = {kind: _sql_string(f"^(?:{pattern})$") for kind, pattern in KINDS.items()}
    kinds = " ".join(f"when m rlike {whole[k]} then '{k}'" for k in KINDS)
    news = " ".join(f"when x.kind = '{k}' then {make('x.m', key)}" for k, make in makers.items())
    return f"transform(transform(found, m -> struct(m as m, case {kinds} end as kind)), x -> struct(x.kind as kind, x.m as old, case {news} end as new))"


def pseudonymised(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text pseudonymised, and `n_private` (values replaced) and `private_kinds` (their kinds, sorted, repeats kept);
    columns of these names are replaced.

    A null text stays null and an empty one empty, both with nothing replaced; repeated values in one text or in several
    get the same pseudonym; very long texts are taken whole; an empty table gives no rows. Other columns pass through. An
    empty key is refused."""
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col).cast("string")
    some = text.rlike("[0-9@:]|[sS][eE][cC][rR][eE][tT]|[pP][aA][sS][sS][wW]|[tT][oO][kK][eE][nN]|[kK][eE][yY]")
    kept = [c for c in docs.columns if c not in ("n_private", "private_kinds")]
    found = docs.select(*kept, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("found"))
    swapped = found.withColumn("swaps", F.when(F.size("found") > 0, F.expr(_replacement(key))))
    texts: Column = F.when(
        F.size("found") > 0,
        F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(F.transform("swaps", lambda x: F.coalesce(x["new"], x["old"])), F.array(F.lit(""))), lambda part, new: F.concat(part, F.coalesce(new, F.lit("")))), ""),
    ).otherwise(text)
    done = F.filter(F.coalesce("swaps", F.array().cast("array<struct<kind:string,old:string,new:string>>")), lambda x: x["new"].isNotNull())
    return swapped.select(
        *(texts.alias(c) if c == text_col else F.col(c) for c in kept),
        F.size(done).cast("long").alias("n_private"),
        F.array_sort(F.transform(done, lambda x: x["kind"])).alias("private_kinds"),
    )
