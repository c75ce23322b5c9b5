"""Generators and modifiers: registries of functions from a context and arguments to a Column."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpquarry.functions import draws, lexicon, redaction

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


@dataclass(frozen=True)
class Context:
    """The place a value is made for: seed, table, column, and the row's number as a Column. ``domains`` gives the keys of other tables."""

    seed: int
    table: str
    column: str
    row: Column
    domains: Mapping[str, KeyDomain]

    def parts(self, *more: object) -> tuple:
        return (self.seed, self.table, self.column, *more, self.row)

    def u(self, *more: object) -> Column:
        return draws.uniform(*self.parts(*more))

    def integer(self, low: int, high: int, *more: object) -> Column:
        return draws.integer(low, high, *self.parts(*more))

    def pick(self, values: list, *more: object) -> Column:
        return draws.choice(values, *self.parts(*more))


@dataclass(frozen=True)
class KeyDomain:
    """A table's keys in closed form, start + number * step, so that references need no join."""

    rows: int
    start: int = 1
    step: int = 1

    def key(self, number: Column) -> Column:
        return number.cast("long") * self.step + self.start


GENERATORS: dict[str, Callable[..., Column]] = {}
MODIFIERS: dict[str, Callable[..., Column]] = {}


def generator(*names: str):
    def add(f):
        GENERATORS.update(dict.fromkeys(names, f))
        return f

    return add


def modifier(name: str):
    def add(f):
        MODIFIERS[name] = f
        return f

    return add


# --- core


@generator("constant", "json_value")
def constant(c: Context, value=None) -> Column:
    return F.lit(value)


@generator("null")
def null(c: Context, type: str = "string") -> Column:
    return F.lit(None).cast(type)


@generator("sequence", "monotonic")
def sequence(c: Context, start: int = 1, step: int = 1) -> Column:
    return c.row.cast("long") * step + start


@generator("copy")
def copy(c: Context, source: str) -> Column:
    return F.col(f"`{source}`")


@generator("template")
def template(c: Context, template: str) -> Column:
    """``{row}`` and ``{column}`` of earlier columns within literal text."""
    import re

    out = []
    for text, name in re.findall(r"([^{]+)|\{(\w+)\}", template):
        out.append(F.lit(text) if text else (c.row.cast("string") if name == "row" else F.col(f"`{name}`").cast("string")))
    return F.concat(*out)


@generator("slug")
def slug(c: Context, source: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(f"`{source}`")), "[^a-z0-9]+", "-"), "^-|-$", "")


@generator("pattern")
def pattern(c: Context, pattern: str) -> Column:
    """``#`` a digit, ``?`` a small letter, others as they are."""
    digit = lambda i: (draws.word(*c.parts("p", i)) % 10).cast("string")
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draws.word(*c.parts("p", i)) % 26 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) if p == "#" else letter(i) if p == "?" else F.lit(p) for i, p in enumerate(pattern)])


@generator("database_default")
def database_default(c: Context, expression: str) -> Column:
    return F.expr(expression)


@generator("integer")
def integer(c: Context, low: int = 0, high: int = 1_000_000) -> Column:
    return c.integer(low, high)


@generator("decimal")
def decimal(c: Context, low: float = 0, high: float = 1000, scale: int = 2) -> Column:
    """Drawn in minor units, so the value has exactly the scale."""
    return (c.integer(round(low * 10**scale), round(high * 10**scale)).cast("decimal(38,0)") / F.lit(10**scale)).cast(f"decimal(20,{scale})")


@generator("boolean")
def boolean(c: Context, probability: float = 0.5) -> Column:
    return c.u() < probability


@generator("string")
def string(c: Context, length: int = 12, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    return F.concat(*[F.substring(F.lit(alphabet), (draws.word(*c.parts(i)) % len(alphabet) + 1).cast("int"), F.lit(1)) for i in range(length)])


@generator("bytes")
def bytes_(c: Context, length: int = 16) -> Column:
    return F.unhex(F.substring(F.concat(*[draws.digest(*c.parts(i)) for i in range(-(-length // 16))]), 1, 2 * length))


@generator("uuid")
def uuid(c: Context) -> Column:
    return redaction.uuid(*c.parts())


@generator("choice")
def choice(c: Context, values: list) -> Column:
    return c.pick(values)


@generator("weighted_choice", "observed_sample")
def weighted_choice(c: Context, values: list, weights: list[float] | None = None) -> Column:
    return draws.weighted(values, weights or [1.0] * len(values), *c.parts())


@generator("histogram")
def histogram(c: Context, bins: list, low: float | None = None, high: float | None = None, integer: bool = False) -> Column:
    """A bin by weight, then a place within the bin. ``bins``: (centre, weight) in order."""
    centres = [b[0] for b in bins]
    edges = [low if low is not None else centres[0], *[(a + b) / 2 for a, b in zip(centres, centres[1:])], high if high is not None else centres[-1]]
    spans = draws.weighted(list(range(len(bins))), [b[1] for b in bins], *c.parts("bin"))
    at = F.element_at(F.array(*[F.lit(float(e)) for e in edges[:-1]]), spans + 1)
    to = F.element_at(F.array(*[F.lit(float(e)) for e in edges[1:]]), spans + 1)
    value = at + c.u("in") * (to - at)
    return F.floor(value).cast("long") if integer else value


@generator("normal")
def normal(c: Context, mean: float = 0.0, stddev: float = 1.0) -> Column:
    """Box and Muller's method on two draws."""
    return F.lit(mean) + F.lit(stddev) * F.sqrt(-2 * F.log(1 - c.u("a"))) * F.cos(2 * math.pi * c.u("b"))


@generator("lognormal")
def lognormal(c: Context, mean: float = 0.0, stddev: float = 1.0) -> Column:
    return F.exp(normal(c, mean, stddev))


# --- relations

WEIGHT_BUCKETS = 256


def parent_number(c: Context, rows: int, distribution: str = "uniform", weights: list[float] | None = None) -> Column:
    """The number of a parent row: uniform, sequential (in turn), weighted (bucket b has weight 1/(b+1)) or observed (given weights)."""
    if distribution == "sequential":
        return c.row % F.lit(rows)
    if distribution in ("weighted", "observed"):
        buckets = min(rows, WEIGHT_BUCKETS)
        w = weights[:buckets] if weights else [1 / (b + 1) for b in range(buckets)]
        bucket = draws.weighted(list(range(len(w))), w, *c.parts("bucket")).cast("long")
        low = F.floor(bucket * rows / len(w)).cast("long")
        high = F.floor((bucket + 1) * rows / len(w)).cast("long")
        return low + F.floor(c.u("in") * (high - low)).cast("long")
    return F.floor(c.u() * rows).cast("long")


@generator("relation.foreign_key", "relation.composite_key")
def foreign_key(c: Context, parent: str, distribution: str = "uniform", weights: list[float] | None = None) -> Column:
    domain = c.domains[parent.lower()]
    return domain.key(parent_number(c, domain.rows, distribution, weights))


# --- made-up values with a meaning

for _kind, _fake in {
    "person.first_name": "first_name", "person.last_name": "last_name", "person.full_name": "name", "person.username": "username", "internet.email": "email",
    "internet.url": "url", "internet.ipv4": "ip", "internet.ipv6": "ipv6", "phone.number": "phone", "company.name": "company", "company.job_title": "job_title",
    "address.line1": "street", "address.city": "city", "address.region": "state", "address.postcode": "zip", "text.word": "word", "text.sentence": "sentence", "text.paragraph": "paragraph",
}.items():
    GENERATORS[_kind] = lambda c, _fake=_fake: redaction.fake(F.lit(""), _fake, *c.parts())
for _kind, _words in {
    "person.title": "title", "internet.domain": "domain", "internet.user_agent": "agent", "phone.country_code": "country_code", "company.department": "department",
    "address.country": "country", "commerce.currency": "currency", "file.extension": "extension", "file.mime_type": "mime",
}.items():
    GENERATORS[_kind] = lambda c, _words=_words: c.pick(lexicon.WORDS[_words])


@generator("address.line2")
def line2(c: Context) -> Column:
    return F.concat(F.lit("Unit "), c.integer(1, 99).cast("string"))


@generator("text.slug")
def text_slug(c: Context, words: int = 3) -> Column:
    return F.concat_ws("-", *[c.pick(lexicon.WORDS["word"], i) for i in range(words)])


@generator("file.name")
def file_name(c: Context) -> Column:
    return F.concat(c.pick(lexicon.WORDS["word"]), F.lit("_"), c.integer(1, 9999, "n").cast("string"), F.lit("."), c.pick(lexicon.WORDS["extension"], "x"))


@generator("network.mac")
def mac(c: Context) -> Column:
    d = draws.digest(*c.parts())
    return F.concat_ws(":", F.lit("02"), *[F.substring(d, 1 + 2 * i, 2) for i in range(5)])


@generator("address.latitude")
def latitude(c: Context, low: float = -90, high: float = 90) -> Column:
    return decimal(c, low, high, 6)


@generator("address.longitude")
def longitude(c: Context, low: float = -180, high: float = 180) -> Column:
    return decimal(c, low, high, 6)


@generator("commerce.product_name")
def product_name(c: Context) -> Column:
    return F.concat_ws(" ", c.pick(lexicon.WORDS["adjective"], "a"), c.pick(lexicon.WORDS["product"], "p"))


def _letters(c: Context, alphabet: str, length: int) -> Column:
    return string(c, length, alphabet)


@generator("identifier.token", "credential.token", "credential.secret")
def token(c: Context, length: int = 32) -> Column:
    return F.substring(F.concat(*[draws.digest(*c.parts(i)) for i in range(-(-length // 32))]), 1, length)


@generator("credential.api_key")
def api_key(c: Context, prefix: str = "test_", length: int = 24) -> Column:
    return F.concat(F.lit(prefix), token(c, length))


@generator("credential.placeholder")
def placeholder(c: Context, text: str = "REDACTED") -> Column:
    return F.lit(text)


@generator("credential.password_hash")
def password_hash(c: Context) -> Column:
    """Shaped like a bcrypt hash, of no password."""
    return F.concat(F.lit("$2b$10$"), _letters(c, "./ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 53))


@generator("identifier.nanoid")
def nanoid(c: Context, length: int = 21) -> Column:
    return _letters(c, ALPHABET, length)


@generator("identifier.ulid")
def ulid(c: Context) -> Column:
    return F.concat(F.lit("01"), _letters(c, CROCKFORD, 24))


@generator("identifier.hash")
def hash_(c: Context, length: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *map(draws._text, c.parts())), 256), 1, length)


@generator("commerce.quantity")
def quantity(c: Context, low: int = 1, high: int = 10) -> Column:
    return c.integer(low, high)


@generator("file.size")
def file_size(c: Context, low: int = 1, high: int = 10_000_000) -> Column:
    return c.integer(low, high)


@generator("network.port")
def port(c: Context) -> Column:
    return c.integer(1024, 65535)


@generator("duration")
def duration(c: Context, low: int = 1, high: int = 86_400) -> Column:
    return c.integer(low, high)


@generator("commerce.money")
def money(c: Context, low: float = 1, high: float = 1000) -> Column:
    return decimal(c, low, high, 2)


@generator("commerce.sku")
def sku(c: Context) -> Column:
    return F.concat(_letters(c, "ABCDEFGHJKLMNPQRSTUVWXYZ", 3), F.lit("-"), F.lpad(c.integer(0, 99_999, "n").cast("string"), 5, "0"))


EPOCH, DAY = "2020-01-01 00:00:00", 86_400


def _stamp(seconds: Column, start: str = EPOCH) -> Column:
    """A time so many seconds after a start, without zone."""
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


@generator("datetime")
def datetime_(c: Context, start: str = EPOCH, days: int = 1460) -> Column:
    return _stamp(c.integer(0, days * DAY - 1), start)


@generator("date")
def date(c: Context, start: str = "2020-01-01", days: int = 1460) -> Column:
    return F.date_add(F.lit(start).cast("date"), c.integer(0, days - 1).cast("int"))


@generator("time")
def time(c: Context) -> Column:
    return F.date_format(_stamp(c.integer(0, DAY - 1)), "HH:mm:ss")


@generator("before")
def before(c: Context, source: str, low: int = 0, high: int = DAY) -> Column:
    return F.col(f"`{source}`") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.integer(low, high).cast("decimal(18,6)"))


@generator("after")
def after(c: Context, source: str, low: int = 0, high: int = DAY) -> Column:
    return F.col(f"`{source}`") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.integer(low, high).cast("decimal(18,6)"))


# --- modifiers


@modifier("null_rate")
def null_rate(c: Context, value: Column, rate: float) -> Column:
    return F.when(c.u("null") >= rate, value)


@modifier("prefix")
def prefix(c: Context, value: Column, text: str) -> Column:
    return F.concat(F.lit(text), value.cast("string"))


@modifier("suffix")
def suffix(c: Context, value: Column, text: str) -> Column:
    return F.concat(value.cast("string"), F.lit(text))


@modifier("truncate")
def truncate(c: Context, value: Column, length: int) -> Column:
    return F.substring(value, 1, length)


@modifier("case")
def case(c: Context, value: Column, to: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "title": F.initcap}[to](value)


@modifier("clamp")
def clamp(c: Context, value: Column, low=None, high=None) -> Column:
    value = value if low is None else F.greatest(value, F.lit(low))
    value = value if high is None else F.least(value, F.lit(high))
    return value


@modifier("round")
def round_(c: Context, value: Column, scale: int = 0) -> Column:
    return F.round(value, scale)


@modifier("format")
def format_(c: Context, value: Column, format: str) -> Column:
    return F.format_string(format, value)


def make_unique(df: DataFrame, column: str, row: str) -> DataFrame:
    """Repeated values get a number: the n-th of equal texts (by row) the suffix ``-n``; again until none is repeated.

    Numbers get an offset beyond the largest value instead.
    """
    kind = df.schema[column].dataType.typeName()
    for _ in range(20):
        rank = F.row_number().over(Window.partitionBy(column).orderBy(row))
        ranked = df.withColumn("_r", F.when(F.col(column).isNull(), 1).otherwise(rank))
        if kind == "string":
            df = ranked.withColumn(column, F.when(F.col("_r") > 1, F.concat(F.col(column), F.lit("-"), F.col("_r").cast("string"))).otherwise(F.col(column))).drop("_r")
        else:
            top = df.agg(F.max(column).alias("_top"))
            df = ranked.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("_r") > 1, F.col("_top") + 1 + F.col(row)).otherwise(F.col(column))).drop("_r", "_top")
            return df
        if df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").isEmpty():
            return df
    raise ValueError(f"{column} does not become unique")
