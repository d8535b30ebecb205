"""Filter leaves as columns. Each is true or false, never null, so that & | ~ combine them in two-valued logic.

A leaf about something that a row lacks is false, and its negation therefore true.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import ipv4_number


def sure(leaf: Column) -> Column:
    return F.coalesce(leaf, F.lit(False))


def word(column: str | Column, needle: str) -> Column:
    """needle stands somewhere in the text, in any case."""
    text = F.col(column) if isinstance(column, str) else column
    return sure(F.lower(text).contains(needle.lower()))


def nor(*leaves: Column) -> Column:
    out = F.lit(True)
    for leaf in leaves:
        out = out & ~leaf
    return out


def matches(column: str, pattern: str, limit: int | None = None) -> Column:
    """A case-insensitive regular expression over a text, or over its first characters."""
    text = F.col(column) if limit is None else F.substring(column, 1, limit)
    return sure(text.rlike(f"(?i){pattern}"))


def whole_word(column: str, needle: str) -> Column:
    """needle with no letter or digit beside it, and not followed by a sign and a digit (as in an address)."""
    edge = "[A-Za-z0-9]"
    return sure(F.col(column).rlike(f"(?i)(?<!{edge}){re.escape(needle)}(?!{edge})(?![./:][0-9])"))


def whole_address(column: str, address: str) -> Column:
    """An IPv4 address that is not a part of a longer one."""
    return sure(F.col(column).rlike(rf"(?<![0-9])(?<![0-9]\.){re.escape(address)}(?![0-9])(?!\.[0-9])"))


def glob(column: str | Column, pattern: str) -> Column:
    """* stands for any run of characters; the whole value, in any case."""
    text = F.col(column) if isinstance(column, str) else column
    like = re.sub(r"([%_\\])", r"\\\1", pattern.lower()).replace("*", "%")
    return sure(F.lower(text).like(like))


def in_subnet(column: str | Column, subnet: str) -> Column:
    """IPv4 subnet membership; text that is no address is in none."""
    base, _, bits = subnet.partition("/")
    mask = (0xFFFFFFFF << (32 - int(bits))) & 0xFFFFFFFF
    a, b, c, d = map(int, base.split("."))
    net = (a << 24 | b << 16 | c << 8 | d) & mask
    return sure(ipv4_number(column).bitwiseAND(F.lit(mask)) == net)


def host(address: str, name: str, value: str) -> Column:
    """The address or the name begins with value; value$ is exactly a name, and a whole address exactly an address."""
    low = value.lower()
    if value.endswith("$"):
        return sure(F.lower(name) == low[:-1]) | sure(F.lower(address) == low[:-1])
    if re.fullmatch(r"\d+(\.\d+){3}", value):
        return sure(F.col(address) == value)
    return sure(F.lower(address).startswith(low)) | sure(F.lower(name).startswith(low))


_COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(value: str | Column, op: str, other) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return ~sure(value == other) if op == "!=" else sure(_COMPARE[op](value, F.lit(other)))


def number_or_text(value: Column, op: str, literal: str) -> Column:
    """Numbers compare as numbers; otherwise = is "contains" and an order is that of lower-case text."""
    try:
        number = float(literal)
    except ValueError:
        number = None
    as_text = F.lower(value).contains(literal.lower()) if op == "=" else _COMPARE[op](F.lower(value), F.lit(literal.lower()))
    if number is None:
        return sure(as_text)
    cast = value.try_cast("double")
    return sure(F.when(cast.isNotNull(), _COMPARE[op](cast, F.lit(number))).otherwise(as_text))


def key_is(field: Column, key: str) -> Column:
    """A field's name in any case, or with a numeric instance after it (ifIndex.3 is an ifIndex)."""
    return field["key"].rlike(rf"(?i)^{re.escape(key)}(\.[0-9.]+)?$")


def field_value_is(value: Column, wanted: str) -> Column:
    """One field value against one wanted text: subnet, glob, address, number or beginning, as the wanted text's form says."""
    if re.fullmatch(r"\d+(\.\d+){3}/\d+", wanted):
        return in_subnet(value, wanted)
    if "*" in wanted:
        return glob(value, wanted)
    if re.fullmatch(r"\d+(\.\d+){3}", wanted):
        return sure(value == wanted)
    if re.fullmatch(r"\d+", wanted):
        return sure(F.regexp_replace(value, "^0+(?=.)", "") == (wanted.lstrip("0") or "0"))
    return sure(F.lower(value).startswith(wanted.lower()))


def field_exists(fields: str, key: str) -> Column:
    return sure(F.exists(fields, lambda f: key_is(f, key)))


def field(fields: str, key: str | Iterable[str], op: str, wanted: str) -> Column:
    """= : any field of the name fits; != : none does (also without one); an order looks at the first field of the name."""
    keys = [key] if isinstance(key, str) else list(key)
    named = lambda f: F.lit(False) if not keys else _any(key_is(f, k) for k in keys)
    if op in ("=", "!="):
        fits = sure(F.exists(fields, lambda f: named(f) & field_value_is(f["value"], wanted)))
        return fits if op == "=" else ~fits
    first = F.get(F.filter(fields, named), F.lit(0))["value"]
    return number_or_text(first, op, wanted)


def _any(columns: Iterable[Column]) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out | c
    return out


def overlaps(first: str, last: str, low, high) -> Column:
    """The interval [first, last] and [low, high] meet."""
    return sure((F.col(last) >= low) & (F.col(first) <= high))


def conversation(a: tuple[str, int], b: tuple[str, int], source="source", sport="sport", destination="destination", dport="dport") -> Column:
    """Both directions of a conversation, each address with its own port."""
    one = lambda x, y: (F.col(source) == x[0]) & (F.col(sport) == x[1]) & (F.col(destination) == y[0]) & (F.col(dport) == y[1])
    return sure(one(a, b) | one(b, a))
