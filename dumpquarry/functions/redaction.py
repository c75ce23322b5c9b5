"""Redaction strategies as Column expressions. NULL stays NULL under each, but for ``null``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dumpquarry.functions import draws, lexicon


def hashed(value: Column, preserve_domain: bool = False) -> Column:
    """The first 16 hex digits of SHA-256; of an e-mail address, with ``preserve_domain``, 8 digits of the local part and the domain."""
    text = value.cast("string")
    whole = F.substring(F.sha2(text, 256), 1, 16)
    if not preserve_domain:
        return whole
    local, domain = F.regexp_extract(text, "(?s)^(.*)@", 1), F.regexp_extract(text, "(?s)@([^@]*)$", 1)
    return F.when(F.instr(text, "@") > 0, F.concat(F.substring(F.sha2(local, 256), 1, 8), F.lit("@"), domain)).otherwise(whole)


def masked(value: Column, pattern: str, *seed: object) -> Column:
    """The pattern with ``*`` for a hidden character, ``X`` for the value's own, ``#`` for a drawn digit, others as they are.

    A literal also passes over the value's character if that is the same; the expression is unrolled over the pattern,
    so a pattern with literals followed by ``X`` carries the place as a column.
    """
    text = value.cast("string")
    moving = any(p == "X" for i, p in enumerate(pattern) if any(q not in "*X#" for q in pattern[:i]))
    place: Column | int = 1
    out = []
    for i, p in enumerate(pattern):
        at = place if isinstance(place, Column) else F.lit(place)
        if p == "*":
            out.append(F.lit("*"))
            place = place + 1
        elif p == "X":
            out.append(F.substring(text, at, F.lit(1)) if isinstance(at, Column) else F.substring(text, at, 1))
            place = place + 1
        elif p == "#":
            out.append((draws.word(*seed, "mask", i) % 10).cast("string"))
            place = place + 1
        else:
            out.append(F.lit(p))
            if moving:
                place = at + F.when(F.substring(text, at, F.lit(1)) == p, 1).otherwise(0)
    return F.when(text.isNotNull(), F.concat(*out) if out else F.lit(""))


def _digits(n: int, low: int, *seed: object) -> Column:
    return draws.integer(low, 10**n - 1, *seed).cast("string")


def fake(value: Column, kind: str, *seed: object) -> Column:
    """A made-up value of the kind, drawn from the seed parts. An unknown kind gives ``FAKE_`` and a number."""
    w = lambda name: draws.choice(lexicon.WORDS[name], *seed, name)
    n = lambda low, high, name: draws.integer(low, high, *seed, name)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.concat(n(1970, 2023, "y").cast("string"), F.lit("-"), two(n(1, 12, "m")), F.lit("-"), two(n(1, 28, "d")))
    time = F.concat(two(n(0, 23, "h")), F.lit(":"), two(n(0, 59, "i")), F.lit(":"), two(n(0, 59, "s")))
    ipv4 = F.concat_ws(".", *[n(1, 254, f"ip{i}").cast("string") for i in range(4)])
    low = lambda c: F.lower(c)
    kinds = {
        "first_name": lambda: w("first"),
        "last_name": lambda: w("last"),
        "name": lambda: F.concat_ws(" ", w("first"), w("last")),
        "username": lambda: F.concat(low(w("first")), F.lit("_"), low(w("last")), n(1, 999, "u").cast("string")),
        "email": lambda: F.concat(low(w("first")), F.lit("."), low(w("last")), n(1, 9999, "e").cast("string"), F.lit("@"), w("domain")),
        "phone": lambda: F.concat(F.lit("+1-"), _digits(3, 200, *seed, "p1"), F.lit("-"), _digits(3, 200, *seed, "p2"), F.lit("-"), _digits(4, 1000, *seed, "p3")),
        "street": lambda: F.concat_ws(" ", n(1, 9999, "no").cast("string"), w("street")),
        "address": lambda: F.concat(n(1, 9999, "no").cast("string"), F.lit(" "), w("street"), F.lit(", "), w("city"), F.lit(", "), w("region"), F.lit(" "), _digits(5, 10000, *seed, "z")),
        "city": lambda: w("city"),
        "state": lambda: w("region"),
        "zip": lambda: _digits(5, 10000, *seed, "z"),
        "country": lambda: F.lit("United States"),
        "company": lambda: F.concat_ws(" ", w("last"), w("company_end")),
        "job_title": lambda: F.concat_ws(" ", w("job_level"), w("job")),
        "url": lambda: F.concat(F.lit("https://"), w("domain"), F.lit("/"), w("word")),
        "ip": lambda: ipv4,
        "ipv6": lambda: F.concat_ws(":", *[F.substring(draws.digest(*seed, "v6"), 1 + 4 * i, 4) for i in range(8)]),
        "uuid": lambda: uuid(*seed),
        "date": lambda: date,
        "datetime": lambda: F.concat(date, F.lit(" "), time),
        "time": lambda: time,
        "credit_card": lambda: F.concat_ws("-", *[_digits(4, 1000, *seed, f"cc{i}") for i in range(4)]),
        "iban": lambda: F.concat(F.lit("DE"), *[_digits(k, 10 ** (k - 1), *seed, f"ib{i}") for i, k in enumerate((2, 4, 4, 4, 4, 2))]),
        "ssn": lambda: F.concat_ws("-", _digits(3, 100, *seed, "s1"), _digits(2, 10, *seed, "s2"), _digits(4, 1000, *seed, "s3")),
        "word": lambda: w("word"),
        "sentence": lambda: F.concat(F.initcap(draws.choice(lexicon.WORDS["word"], *seed, "w0")), F.lit(" "), F.concat_ws(" ", *[draws.choice(lexicon.WORDS["word"], *seed, f"w{i}") for i in range(1, 7)]), F.lit(".")),
    }
    kinds["paragraph"] = lambda: F.concat_ws(" ", *[fake(F.lit(""), "sentence", *seed, i) for i in range(3)])
    kind = ALIASES.get(kind.lower(), kind.lower())
    made = kinds[kind]() if kind in kinds else F.concat(F.lit("FAKE_"), _digits(5, 10000, *seed, "x"))
    return F.when(value.isNotNull(), made)


# Other names of the kinds.
ALIASES = {
    "safe_email": "email", "full_name": "name", "phone_number": "phone", "street_address": "address", "street_name": "street",
    "zip_code": "zip", "postal_code": "zip", "company_name": "company", "user_name": "username", "ip_address": "ip", "ipv4": "ip",
    "date_time": "datetime", "lorem": "paragraph",
}


def uuid(*seed: object) -> Column:
    """A version 4 UUID from the digest of the seed parts."""
    d = draws.digest(*seed, "uuid")
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(d, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("4"), F.substring(d, 14, 3)), F.concat(variant, F.substring(d, 18, 3)), F.substring(d, 21, 12))
