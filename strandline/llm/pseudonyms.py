"""Format-preserving pseudonyms for personal data, in Spark SQL functions only.

Validated values go through an alternating Feistel network keyed by a secret: each half of the value is shifted, within its own
alphabet, by a keyed hash of the other half.  That permutes the values of one format, so equal values stay equal in all
documents and different ones stay different; without the key they cannot be undone.

* payment card numbers (13 to 19 digits, Luhn): all digits but the last are permuted, the check digit is computed anew;
* bank account numbers (IBAN of the country's length, mod 97): the characters after the check digits are permuted, the check
  digits computed anew;
* telephone numbers: the digits after the country code;
* social security numbers: permuted among the valid ones (no area 000, 666 or 900 to 999, no group 00, no serial 0000);
* IPv4 addresses: permuted among all 2^32;
* dates (year first with - or /, or day first with .), years 1 to 9999: permuted among the days of one of three ranges, which
  meet at the ends of 1899 and of January 2100, so that dates of today stay dates of today;
* e-mail addresses: the part before @.

Separators stay in place and do not enter the permutation, so differently written equal numbers stay linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Formats, and the alphabets within which characters are shifted.
EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ -]?[0-9]){8,12}(?![0-9])"
# Characters of an account number by country.
ACCOUNT_LENGTHS = (
    "NO15 BE16 DK18 FI18 FO18 GL18 NL18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 "
    "AE23 GI23 IL23 IQ23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 FR27 GR27 IT27 MC27 MR27 SM27 "
    "AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 MT31 SC31 LC32"
).split()


def _account_pattern() -> str:
    """Countries of the table by their length; others by groups of four."""
    by_length: dict[int, list[str]] = {}
    for entry in ACCOUNT_LENGTHS:
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    known = "|".join(f"(?:{'|'.join(names)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in by_length.items())
    others = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    return f"(?<![A-Za-z0-9])(?:{known}|{others})(?![A-Za-z0-9])"


ACCOUNT = _account_pattern()
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3} [0-9]{1,3}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,4}|[0-9]{4}(?:-[0-9]{4}){3}-[0-9]{1,3}"
    r"|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
)
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
#: Days from 0001-01-01 in three ranges, each a product of the sizes of its two halves.
DAY_RANGES = ((682, 1017), (235, 311), (1621, 1780))
#: Valid social numbers: areas, and groups times serials.
AREAS, IN_AREA = 898, 99 * 9999
KINDS = ("email", "address", "date", "social", "phone", "account", "card")
_PATTERNS = dict(zip(KINDS, (EMAIL, ADDRESS, DATE, SOCIAL, PHONE, ACCOUNT, CARD)))
#: In the alternation the date's separator is written out, for group numbers would shift.
_ANY = "|".join(f"(?:{p})" for p in (EMAIL, ADDRESS, DATE.replace(r"(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}", "(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}"), SOCIAL, PHONE, ACCOUNT, CARD))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(key: str, *parts: Column) -> Column:
    """A keyed number below 2^32 from the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 8), 16, 10).cast("long")


def _shifted(half: Column, other: Column, key: str, kind: str, turn: Column) -> Column:
    def all_of(digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            amount = F.conv(F.substring(F.sha2(F.concat_ws("|", digest, i.cast("string")), 256), 1, 8), 16, 10).cast("long")
            out = c
            for alphabet in ALPHABETS:
                place = F.instr(F.lit(alphabet), c)
                out = F.when(place > 0, F.substring(F.lit(alphabet), ((place - 1 + amount) % len(alphabet) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(half, ""), one), "")

    # The other half is hashed once, not for each character.
    return F.when(F.length(half) > 0, bound(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 256), all_of)).otherwise(half)


def permute_text(value: Column, key: str, kind: str) -> Column:
    """Permutes strings of one length and pattern of alphabets; a single character is shifted by a keyed constant."""
    return bound(value, lambda v: _permuted(v, key, kind))


def _permuted(value: Column, key: str, kind: str) -> Column:
    left = F.floor(F.length(value) / 2).cast("int")
    begin = F.struct(F.substring(value, F.lit(1), left).alias("a"), F.substring(value, left + 1, F.length(value)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        even = F.struct(_shifted(s["a"], s["b"], key, kind, r).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), _shifted(s["b"], s["a"], key, kind, r).alias("b"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Permutes whole numbers from 0 to a * b - 1."""
    def turn(s: Column, r: Column) -> Column:
        even = F.struct(((s["x"] + _number(key, F.lit(kind), r.cast("string"), s["y"].cast("string"))) % a).alias("x"), s["y"].alias("y"))
        odd = F.struct(s["x"].alias("x"), ((s["y"] + _number(key, F.lit(kind), r.cast("string"), s["x"].cast("string"))) % b).alias("y"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    def run(v: Column) -> Column:
        begin = F.struct(F.floor(v / b).cast("long").alias("x"), (v % b).cast("long").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: s["x"] * b + s["y"])

    return bound(value, run)


def _filled(shape: Column, symbols: Column, pattern: str) -> Column:
    """The shape with its characters of ``pattern``, in order, replaced by those of ``symbols``."""

    def fill(both: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            c = F.substring(both["shape"], i, F.lit(1))
            takes = c.rlike(pattern)
            return F.struct(F.concat(s["out"], F.when(takes, F.substring(both["symbols"], s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + takes.cast("int")).alias("k"))

        return F.aggregate(F.sequence(F.lit(1), F.length(both["shape"])), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda s: s["out"])

    return bound(F.struct(shape.alias("shape"), symbols.alias("symbols")), fill)


def luhn_sum(digits: Column) -> Column:
    """Sum by Luhn's rule; the digits are valid if 10 divides it."""

    def total(v: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            d = F.substring(v, F.length(v) - i, F.lit(1)).cast("int") * (i % 2 + 1)
            return a + d - F.when(d > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.length(v) - 1), F.lit(0), one)

    return bound(digits, total)


def mod97(text: Column) -> Column:
    """Remainder by 97 of the number that digits and letters (A is 10) spell."""

    def total(t: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            v = F.conv(F.substring(t, i, F.lit(1)), 36, 10).cast("int")
            return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), one)

    return bound(text, total)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    """Of a number of 17 digits or more in groups, which is not valid as a whole, the first 16 digits are tried."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    whole = luhn_sum(digits) % 10 == 0
    size = F.when(whole | ~m.rlike("[ -]"), F.length(digits)).otherwise(F.least(F.length(digits), F.lit(16)))

    def fresh(d: Column) -> Column:
        body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return bound(body, lambda f: F.concat(f, ((10 - luhn_sum(F.concat(f, F.lit("0"))) % 10) % 10).cast("string")))

    number = F.substring(digits, F.lit(1), size)
    rest = F.substring(digits, size + 1, F.length(digits))
    return luhn_sum(number) % 10 == 0, _filled(m, F.concat(bound(number, fresh), rest), "[0-9]")


def _account(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.regexp_replace(m, " ", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    fresh = permute_text(body, key, "account")
    whole = bound(fresh, lambda f: F.concat(country, F.lpad((98 - mod97(F.concat(f, country, F.lit("00")))).cast("string"), 2, "0"), f))
    return mod97(F.concat(body, F.substring(plain, 1, 4))) == 1, _filled(m, whole, "[A-Z0-9]")


def _address(m: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    def dotted(fresh: Column) -> Column:
        return F.concat_ws(".", *((F.shiftright(fresh, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)))

    return F.forall(octets, lambda x: x < 256), bound(permute_number(number, 65536, 65536, key, "address"), dotted)


def _date(m: Column, key: str) -> tuple[Column, Column]:
    dotted = m.contains(".")
    iso = F.when(dotted, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.translate(m, "/", "-"))
    first = F.to_date(F.lit("0001-01-01"))
    number = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), first)

    def moved(n: Column) -> Column:
        out, begin = F.lit(None).cast("long"), 0
        for k, (a, b) in enumerate(DAY_RANGES):
            out = F.when((n >= begin) & (n < begin + a * b), permute_number(n - begin, a, b, key, f"date{k}") + begin).otherwise(out)
            begin += a * b
        return F.date_format(F.date_add(first, out.cast("int")), "yyyy-MM-dd")

    def shaped(f: Column) -> Column:
        return F.when(dotted, F.concat_ws(".", F.substring(f, 9, 2), F.substring(f, 6, 2), F.substring(f, 1, 4))).when(m.contains("/"), F.translate(f, "-", "/")).otherwise(f)

    days = sum(a * b for a, b in DAY_RANGES)
    return F.coalesce(number.between(0, days - 1), F.lit(False)), bound(bound(number, moved), shaped)


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    # The country code is what precedes the last ten digits.
    digits = F.regexp_replace(m, "[^0-9]", "")
    kept = F.greatest(F.length(digits) - 10, F.lit(0))
    fresh = permute_text(F.substring(digits, kept + 1, F.lit(10)), key, "phone")
    return F.lit(True), _filled(m, F.concat(F.substring(digits, F.lit(1), kept), fresh), "[0-9]")


def _social(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = (area - 1 - (area > 666).cast("long")) * IN_AREA + (group - 1) * 9999 + serial - 1

    def written(n: Column) -> Column:
        a = F.floor(n / IN_AREA) + 1
        parts = ((a + (a > 665).cast("long"), 3), (F.floor(n / 9999) % 99 + 1, 2), (n % 9999 + 1, 4))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), size, "0") for x, size in parts))

    return ~m.rlike("^(000|666|9)|-00-|-0000$"), bound(permute_number(place, AREAS, IN_AREA, key, "social"), written)


def _email(m: Column, key: str) -> tuple[Column, Column]:
    host = F.substring_index(m, "@", -1)
    return host.rlike(r"\.[A-Za-z]{2}"), F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), host)


_MAKERS = {"email": _email, "address": _address, "date": _date, "social": _social, "phone": _phone, "account": _account, "card": _card}


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text with pseudonyms, and n_<kind> for each of ``KINDS``.

    ``key`` is the secret that the permutations depend on; an empty one is refused.  Null and empty texts become empty texts.
    Strings that look like a format but are not valid stay as they are.  Repeated rows are treated alike; an empty table gives
    no rows; other columns are not read.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    pieces = F.arrays_zip(F.split("t", _ANY, -1).alias("gap"), F.regexp_extract_all("t", F.lit(_ANY), F.lit(0)).alias("m"))

    def fresh(piece: Column) -> Column:
        m = piece["m"]
        out = F.struct(F.lit(None).cast("string").alias("kind"), F.coalesce(m, F.lit("")).alias("new"))
        for kind in reversed(KINDS):
            valid, new = _MAKERS[kind](m, key)
            out = F.when(m.rlike(f"^(?:{_PATTERNS[kind]})$"), F.when(valid, F.struct(F.lit(kind).alias("kind"), new.alias("new"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))).otherwise(out)
        return F.struct(piece["gap"].alias("gap"), out["kind"].alias("kind"), out["new"].alias("new"))

    maybe = F.col("t").rlike("[@0-9]")
    rows = rows.withColumn("parts", F.when(maybe, F.transform(pieces, fresh)))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["gap"], p["new"])), "")

    def count(kind: str) -> Column:
        return F.when(F.col("parts").isNull(), 0).otherwise(F.size(F.filter("parts", lambda p: p["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", F.when(F.col("parts").isNull(), F.col("t")).otherwise(whole).alias("text"), *map(count, KINDS))
