"""IPv4 and MAC addresses, interface names, URLs and object ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ipv4_number(address: str | Column) -> Column:
    """The address as a number; null if it is none."""
    address = _column(address)
    part = lambda i: F.split_part(address, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(address.rlike(IPV4), F.shiftleft(part(1), 24) + F.shiftleft(part(2), 16) + F.shiftleft(part(3), 8) + part(4))


def ipv4_text(number: Column) -> Column:
    byte = lambda s: F.shiftright(number, s).bitwiseAND(255).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def first_ipv4(text: str | Column) -> Column:
    """The first IPv4 address that stands alone in a text; null without one."""
    found = F.regexp_extract_all(_column(text), F.lit(r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9])(?!\.[0-9])"), F.lit(1))
    return F.get(F.filter(found, lambda x: x.rlike(IPV4)), F.lit(0))


def mac(text: str | Column) -> Column:
    """Twelve hex digits in any spelling (colons, dashes, dots, bare) as lower-case colon form; null if it is none."""
    digits = F.regexp_replace(F.lower(_column(text)), "[:.\\-]", "")
    return F.when(digits.rlike("^[0-9a-f]{12}$"), F.regexp_replace(F.regexp_replace(digits, "(..)", "$1:"), ":$", ""))


def mac_spellings(address: Column) -> Column:
    """The spellings of a MAC in colon form: colon, dash, dotted, bare."""
    bare = F.replace(address, F.lit(":"), F.lit(""))
    dotted = F.concat_ws(".", F.substring(bare, 1, 4), F.substring(bare, 5, 4), F.substring(bare, 9, 4))
    return F.array(address, F.replace(address, F.lit(":"), F.lit("-")), dotted, bare)


#: Short interface names and what they stand for.
INTERFACES = {
    "gi": "GigabitEthernet", "gig": "GigabitEthernet", "ge": "GigabitEthernet", "fa": "FastEthernet",
    "te": "TenGigabitEthernet", "ten": "TenGigabitEthernet", "tw": "TwoGigabitEthernet", "fi": "FiveGigabitEthernet",
    "twe": "TwentyFiveGigE", "fo": "FortyGigabitEthernet", "hu": "HundredGigE", "po": "Port-channel",
    "eth": "Ethernet", "et": "Ethernet", "xge": "XGigabitEthernet",
}


def interface_name(text: str | Column) -> Column:
    """Gi1/0/5 and gigabitethernet1/0/5 as GigabitEthernet1/0/5; eth, et and ge only before a slot."""
    text = _column(text)
    short, rest = F.lower(F.regexp_extract(text, "^([A-Za-z]+)([0-9].*)$", 1)), F.regexp_extract(text, "^([A-Za-z]+)([0-9].*)$", 2)
    names = F.create_map(*(F.lit(x) for pair in (INTERFACES | {v.lower(): v for v in INTERFACES.values()}).items() for x in pair))
    full = F.element_at(names, short)
    slot = ~short.isin("eth", "et", "ge") | rest.contains("/")
    return F.when(full.isNotNull() & slot, F.concat(full, rest)).otherwise(text)


def url_host(url: str | Column) -> Column:
    """A URL's host in lower case, without port and user."""
    return F.lower(F.regexp_extract(_column(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def oid(text: str | Column) -> Column:
    """A dotted object id as an array of its numbers, which orders as object ids do."""
    return F.transform(F.split(F.ltrim(_column(text), F.lit(".")), r"\."), lambda x: x.cast("bigint"))


def natural_key(text: str | Column) -> Column:
    """A text that sorts as people count: runs of digits by their value."""
    parts = F.regexp_extract_all(_column(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(F.lower(p))), "")
