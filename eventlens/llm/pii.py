"""Format-preserving pseudonyms (operator 10). DataFrame functions only.

Found values are replaced by keyed permutations of themselves within their
format, so equal values get equal pseudonyms in every document and different
values never get the same one (inside a format). A permutation is a Feistel
network of ``ROUNDS`` rounds on a pair (left, right) of Z_a x Z_b with
addition modulo a and b in turn: a bijection of exactly a * b values. The round function is SHA-256 of
key, kind, round and the other half.

============ ========================================= ===========================
kind         validated by                              permuted
============ ========================================= ===========================
card         13 to 19 digits (or 4-4-4-4 or 4-6-5),    all but the first and the
             Luhn sum                                  check digit, made anew
iban         country, length, remainder 1 modulo 97;   digits of the account part;
             also in groups of four                    check digits made anew
ssn          3-2-4 digits, issued ranges               within the issued ranges
phone        +1 or separators, 3-3-4 digits; another   the ten digits; those after
             country's with 5 to 14 digits             the country (two if unbroken)
ipv4         four numbers up to 255                    the 32 bits
date         a day of the years 1 to 9999, also        the day within 1900-01-01 to
             before a time; dd/MM where MM/dd fails    2099-11-12, before or after;
                                                       its notation stays
email        local part at a domain                    letters and digits of the
                                                       local part, class by class
secret       16 or more hex digits named as such       the hex digits
access key   AKIA or ASIA, 16 capitals and digits      those 16
============ ========================================= ===========================

What fails its validation stays as it is. Defined cases: null text stays
null, empty text empty; the id may be null or repeated; an empty table gives
an empty result; other columns pass through. Every pattern starts at a word
boundary and does not back up, so time is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY = "1900-01-01"
#: Ranges of days that are permuted within themselves: first day (from ``FIRST_DAY``) and two factors of their number.
DAYS = ((0, 250, 292), (-693595, 5, 138719), (73000, 1231, 2344))

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
SECRET = r"(?<![\p{L}\p{N}])(?i:token|secret|password|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}\"?[0-9A-Fa-f]{16,}+(?![\p{L}\p{N}])"
ACCESS_KEY = r"(?<![\p{L}\p{N}])A[KS]IA[A-Z0-9]{16}(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}+(])(?:\+1[ .-]?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])|\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])"
ABROAD = r"(?<![\p{L}\p{N}+(])\+[2-9](?:[0-9]{0,2}(?:[ .-][0-9]{2,8}){1,5}+|[0-9]{7,14}+)(?![\p{L}\p{N}])"
IPV4 = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
DATE = (r"(?<![\p{L}\p{N}-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?!(?!T[0-9])[\p{L}\p{N}-])|(?<![\p{L}\p{N}/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\p{L}\p{N}/])"
        r"|(?<![\p{L}\p{N}.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![\p{L}\p{N}])")
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}(?![\p{L}\p{N}])){2,7}+(?: [A-Z0-9]{1,3})?+)(?![\p{L}\p{N}])"
CARD = (r"(?<![\p{L}\p{N}])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}"
        r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19}+)(?![\p{L}\p{N}])")
KINDS = {"email": EMAIL, "secret": SECRET, "access key": ACCESS_KEY, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE, "phone abroad": ABROAD, "date": DATE, "ipv4": IPV4}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """(left, right) permuted on Z_a x Z_b, as a struct. a, b below 2^31."""
    a, b = a.cast("bigint"), b.cast("bigint")

    def step(s: Column, i: Column) -> Column:
        on_left = i % 2 == 0
        new_left = F.pmod(s["l"] + F.pmod(_number(_hash(key, F.lit(kind), i, a, b, s["r"])), a), a)
        new_right = F.pmod(s["r"] + F.pmod(_number(_hash(key, F.lit(kind), i, a, b, s["l"])), b), b)
        return F.struct(F.when(on_left, new_left).otherwise(s["l"]).alias("l"), F.when(on_left, s["r"]).otherwise(new_right).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("bigint")  # noqa: E731  exact up to 10^9
    p = feistel(F.substr(digits, F.lit(1), h), F.substr(digits, h + 1), power(h), power(n - h), key, kind)
    return F.concat(F.lpad(p["l"].cast("string"), h, "0"), F.lpad(p["r"].cast("string"), n - h, "0"))


def permute_text(text: Column, key: str, kind: str, classes: dict[str, str]) -> Column:
    """A string of any length; each character stays in its class (a string
    of ``classes``), others stay. Feistel on the two halves of the string,
    with one shift per character drawn from the hash of the other half."""
    half = F.floor((F.length(text) + 1) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def shifted(s: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            byte = F.conv(F.substr(digest, (i % 31) * 2 + 1, F.lit(3)), 16, 10).cast("int") + F.floor(i / 31).cast("int")
            out = c
            for letters in classes.values():
                at = F.instr(F.lit(letters), c) - 1
                out = F.when((at >= 0) & (c != ""), F.substr(F.lit(letters), F.pmod(at + byte, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(s, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        on_left = i % 2 == 0
        l, r = shifted(s["l"], _hash(key, F.lit(kind), i, s["r"])), shifted(s["r"], _hash(key, F.lit(kind), i, s["l"]))
        return F.struct(F.when(on_left, l).otherwise(s["l"]).alias("l"), F.when(on_left, s["r"]).otherwise(r).alias("r"))

    p = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(p["l"], p["r"])


LETTERS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789"}
HEX = {"lower": "0123456789abcdef"}
HEX_UPPER = {"upper": "0123456789ABCDEF"}


def luhn_sum(digits: Column) -> Column:
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _refill(m: Column, new: Column) -> Column:
    """``m`` with its letters and digits replaced, one by one, by ``new``'s."""
    def put(s: Column, c: Column) -> Column:
        real = ((c >= "0") & (c <= "9") | (c >= "A") & (c <= "Z")) & (c != "")
        return F.struct(F.concat(s["t"], F.when(real, F.substr(new, s["k"], F.lit(1))).otherwise(c)).alias("t"), (s["k"] + F.when(real, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), put, lambda s: s["t"])


def _card(m: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    def renewed(digits: Column) -> Column:
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_digits(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        return F.when(luhn_sum(digits) % 10 == 0, _refill(m, _let(body, checked))).otherwise(m)

    return _let(F.regexp_replace(m, "[ -]", ""), renewed)


def _mod97(text: Column) -> Column:
    """Remainder of the number that the IBAN rule reads: letters are 10 to 35."""
    def add(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", s).when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """In groups, what follows may have been taken for one more group."""
    def land(plain: Column) -> Column:
        return F.substr(plain, F.lit(1), F.lit(2))

    def renewed(part: Column, plain: Column) -> Column:
        account = permute_text(F.substr(plain, F.lit(5)), key, "iban", {"digit": LETTERS["digit"], "upper": LETTERS["upper"]})
        new = _let(account, lambda x: F.concat(land(plain), F.lpad((98 - _mod97(F.concat(x, land(plain), F.lit("00")))).cast("string"), 2, "0"), x))
        return _refill(part, new)

    def one(part: Column) -> Column:
        """The part with a new account, null if it is no IBAN."""
        return _let(F.replace(part, F.lit(" "), F.lit("")), lambda plain: F.when(_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1, renewed(part, plain)))

    parts = F.array(m, F.regexp_replace(m, " [A-Z0-9]+$", ""))
    tried = F.transform(parts, lambda part: _let(one(part), lambda new: F.concat(new, F.substr(m, F.length(part) + 1))))
    return F.coalesce(F.get(F.filter(tried, lambda t: t.isNotNull()), F.lit(0)), m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(k), F.lit(n)).cast("int") for k, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    a = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    p = feistel(a, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new_area = F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
    two = [(new_area, 3), (F.floor(p["r"] / 9999) + 1, 2), (p["r"] % 9999 + 1, 4)]
    return F.when(valid, F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in two])).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+(?:1|[0-9]{1,3}(?=[ .-])|[0-9]{2})", 0)
    body = F.substr(m, F.length(country) + 1)
    digits = F.regexp_replace(body, "[^0-9]", "")
    return F.when(F.length(digits).between(5, 14), F.concat(country, _refill(body, permute_digits(digits, key, "phone")))).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]
    p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")
    return F.concat_ws(".", *[x.cast("int").cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)])


def _date(m: Column, key: str) -> Column:
    american = F.try_to_date(m, "MM/dd/yyyy")
    like = (F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(F.contains(m, F.lit(".")), "dd.MM.yyyy")
            .when(american.isNotNull(), "MM/dd/yyyy").otherwise("dd/MM/yyyy"))

    def permuted(n: Column) -> Column:
        first, a, b = (F.lit(x).cast("bigint") for x in (None, 1, 1))
        for f, x, y in DAYS:
            inside = (n >= f) & (n < f + x * y)
            first, a, b = (F.when(inside, F.lit(v).cast("bigint")).otherwise(o) for v, o in ((f, first), (x, a), (y, b)))
        return _let(F.struct((n - first).alias("n"), first.alias("first"), a.alias("a"), b.alias("b")), lambda r: _let(
            feistel(F.floor(r["n"] / r["b"]), r["n"] % r["b"], r["a"], r["b"], key, "date"), lambda p: p["l"] * r["b"] + p["r"] + r["first"]))

    def renamed(fmt: Column) -> Column:
        day = F.datediff(F.call_function("try_to_date", m, fmt), F.lit(FIRST_DAY).cast("date"))
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), _let(day, permuted).cast("int"))
        return F.coalesce(F.call_function("date_format", new, fmt), m)

    return _let(like, renamed)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_text(F.substr(m, F.lit(1), at - 1), key, "email", LETTERS), F.substr(m, at))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, "[0-9A-Fa-f]+$", 0)
    name = F.substr(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(name, F.when(value.rlike("[a-f]"), permute_text(value, key, "secret", HEX)).otherwise(permute_text(value, key, "secret", HEX_UPPER)))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.substr(m, F.lit(1), F.lit(4)), permute_text(F.substr(m, F.lit(5)), key, "access key", {"upper": LETTERS["upper"], "digit": LETTERS["digit"]}))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for the found value ``m``; its shape tells its kind."""
    return (F.when(m.rlike("[=:]"), _secret(m, key))
            .when(F.contains(m, F.lit("@")), _email(m, key))
            .when(m.rlike("^A[KS]IA"), _access_key(m, key))
            .when(m.rlike("^[A-Z]"), _iban(m, key))
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key))
            .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), _date(m, key))
            .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), _ipv4(m, key))
            .when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"), _card(m, key))
            .otherwise(_phone(m, key)))


#: Stands around found values while a text is split; texts that hold it are searched twice.
MARK = "\x01"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and, if named, ``found_col``: how
    many values were replaced."""
    old, new = "_pii_old", "_pii_new"
    while {old, new} & set(docs.columns):
        old, new = old + "_", new + "_"
    text = F.col(f"`{text_col}`")
    suspect = text.rlike("[0-9@]|A[KS]IA")  # every pattern has one of these
    # found values at the odd places of an array, what is between them at the even ones: one search of the text
    marked = F.split(F.regexp_replace(text, ANY, MARK + "$0" + MARK), MARK, -1)
    found, between = F.regexp_extract_all(text, F.lit(ANY), 0), F.split(text, ANY, -1)
    twice = F.flatten(F.transform(between, lambda p, i: F.when(i > 0, F.array(F.get(found, i - 1), p)).otherwise(F.array(p))))
    src = docs.withColumn(old, F.when(suspect, F.when(F.contains(text, F.lit(MARK)), twice).otherwise(marked)))
    src = src.withColumn(new, F.transform(old, lambda p, i: F.when(i % 2 == 1, pseudonym(p, key)).otherwise(p)))
    changed = F.coalesce(F.size(old), F.lit(0)) > 1
    out = src.withColumn(text_col, F.when(changed, F.array_join(new, "")).otherwise(text))
    if found_col:
        replaced = F.size(F.filter(F.arrays_zip(F.col(old).alias("o"), F.col(new).alias("n")), lambda z: z["o"] != z["n"]))
        out = out.withColumn(found_col, F.when(changed, replaced).otherwise(0).cast("bigint"))
    return out.drop(old, new)
