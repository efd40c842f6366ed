"""Pseudonyms against a plain version of the network, on every format, and on long runs of their characters."""

import datetime
import hashlib
import random
import re

import pytest

from strandline.llm import pseudonyms as ps


def number(*parts):
    return int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:8], 16)


def plain_text(value, key, kind):
    a, b = value[: len(value) // 2], value[len(value) // 2 :]

    def shifted(half, other, turn):
        digest = hashlib.sha256("|".join((key, kind, str(turn), other)).encode()).hexdigest()
        out = ""
        for i, c in enumerate(half):
            alphabet = next((x for x in ps.ALPHABETS if c in x), None)
            out += alphabet[(alphabet.index(c) + number(digest, str(i))) % len(alphabet)] if alphabet else c
        return out

    for turn in range(ps.ROUNDS):
        a, b = (shifted(a, b, turn), b) if turn % 2 == 0 else (a, shifted(b, a, turn))
    return a + b


def plain_number(value, a, b, key, kind):
    x, y = divmod(value, b)
    for turn in range(ps.ROUNDS):
        x, y = ((x + number(key, kind, str(turn), str(y))) % a, y) if turn % 2 == 0 else (x, (y + number(key, kind, str(turn), str(x))) % b)
    return x * b + y


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def refill(shape, pattern, symbols):
    symbols = iter(symbols)
    return "".join(next(symbols) if re.match(pattern, c) else c for c in shape)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def brute(kind, m, key):
    """The pseudonym of one valid value."""
    digits = re.sub(r"\D", "", m)
    if kind == "card":
        fresh = plain_text(digits[:-1], key, kind)
        return refill(m, r"\d", fresh + str(-luhn(fresh + "0") % 10))
    if kind == "account":
        compact = m.replace(" ", "")
        fresh = plain_text(compact[4:], key, kind)
        return refill(m, "[A-Z0-9]", compact[:2] + f"{98 - mod97(fresh + compact[:2] + '00'):02d}" + fresh)
    if kind == "address":
        n = plain_number(int("".join(f"{int(x):02x}" for x in m.split(".")), 16), 65536, 65536, key, kind)
        return ".".join(str(n >> 8 * k & 255) for k in (3, 2, 1, 0))
    if kind == "date":
        y, mo, d = (m[6:], m[3:5], m[:2]) if "." in m else (m[:4], m[5:7], m[8:])
        n, begin = datetime.date(int(y), int(mo), int(d)).toordinal() - 1, 0
        for k, (a, b) in enumerate(ps.DAY_RANGES):
            if n < begin + a * b:
                y, mo, d = datetime.date.fromordinal(plain_number(n - begin, a, b, key, f"date{k}") + begin + 1).isoformat().split("-")
                return f"{d}.{mo}.{y}" if "." in m else m[4].join((y, mo, d))
            begin += a * b
    if kind == "phone":
        kept = max(0, len(digits) - 10)
        return refill(m, r"\d", digits[:kept] + plain_text(digits[kept:], key, kind))
    if kind == "social":
        area, group, serial = map(int, m.split("-"))
        n = plain_number((area - 1 - (area > 666)) * ps.IN_AREA + (group - 1) * 9999 + serial - 1, ps.AREAS, ps.IN_AREA, key, kind)
        area = n // ps.IN_AREA + 1
        return f"{area + (area > 665):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    local, host = m.split("@")
    return plain_text(local, key, kind) + "@" + host


def valid_values(rng):
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    for _ in range(60):
        yield "email", rng.choice(["a", "jane.doe", "Ünal_7", "x+y%z-1"]) + digits(rng.randrange(3)) + "@" + rng.choice(["x.org", "mail.example-1.co.uk", "a.bc"])
        yield "address", ".".join(str(rng.randrange(256)) for _ in range(4))
        day = datetime.date.fromordinal(rng.choice([rng.randrange(1, 3652060), rng.randrange(693000, 767500)]))
        yield "date", rng.choice([day.isoformat(), day.isoformat().replace("-", "/"), ".".join(reversed(day.isoformat().split("-")))])
        yield "social", f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 600)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        yield "phone", rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+49 {digits(10)}"])
        body = digits(rng.choice([12, 15, 16, 18]))
        card = body + str(-luhn(body + "0") % 10)
        yield "card", rng.choice([card, " ".join(re.findall(".{1,4}", card)) if len(card) % 4 else card])
        country, n = rng.choice([("DE", 18), ("ES", 20), ("AT", 16), ("NO", 11)])
        bban = digits(n)
        iban = country + f"{98 - mod97(bban + country + '00'):02d}" + bban
        yield "account", rng.choice([iban, " ".join(re.findall(".{1,4}", iban))])


def test_every_format_matches_the_plain_network(spark):
    values = list(valid_values(random.Random(1)))
    texts = [f"see {m} here" for _, m in values]
    rows = ps.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    for r in rows:
        kind, m = values[r.doc_id]
        assert r[f"n_{kind}"] == 1, (kind, m, r.text)
        assert r.text == f"see {brute(kind, m, 'key')} here", (kind, m)


def test_social_numbers_stay_valid_and_differ(spark):
    values = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 300, 665, 667, 899) for g in (1, 50, 99) for s in range(1, 9999, 400)]
    rows = ps.pseudonymise(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), "key").collect()
    assert len({r.text for r in rows}) == len(values)
    assert not any(re.search("^(000|666|9)|-00-|-0000$", r.text) for r in rows)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("ES9121000418450200051332 EN", "account"), ("AT611904300234573201 2020", "account"), ("born 1850-03-04.", "date"), ("card 4111 1111 1111 1111 123", "card"),
        ("6304 0000 0000 0000 000", "card"), ("write to me@x.org.", "email"), ("me@mail.x.org.5 too", "email"),
    ],
)
def test_values_with_neighbours_are_found(spark, text, kind):
    r = ps.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").first()
    assert r[f"n_{kind}"] == 1 and r.text != text and len(r.text) == len(text)


def test_long_runs_of_every_format(spark):
    """A million characters of each kind, without blanks and with."""
    n = 10**6
    texts = ["me@" + "a." * (n // 2) + "com end", "a" * n + "@x.org", "a." * (n // 2), "1" * n, "1 " * (n // 2), "1.1." * (n // 4), "12-" * (n // 3), "DE12" * (n // 4), "DE12 " * (n // 5), "+1" * (n // 2), "(123) " * (n // 6), "@" * n]
    rows = ps.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12), "key").collect()
    assert all(len(r.text) == len(texts[r.doc_id]) for r in rows)
    assert {r.doc_id: r.n_email for r in rows}[0] == 1 and {r.doc_id: r.n_email for r in rows}[1] == 1


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError, match="key"):
        ps.pseudonymise(spark.createDataFrame([(1, "")], "doc_id long, text string"), "")
