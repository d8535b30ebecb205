"""Display hints (RFC 2579, 3.1) as columns: a hint is read once into steps, and values are folded over these steps by native functions.

Read hints where they are few (the table of objects), join the steps to the values, then format. A hint that cannot be read, and bytes that it
cannot show, give null: the caller shows the plain value. Null values give null, no bytes give an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One step of a hint: a repeat sign with length, form, separator and terminator, or length, form and separator.
STEP = r"\*[0-9]+[xdoat][^0-9*]?[^0-9*]?|[0-9]+[xdoat][^0-9*]?"
#: The hint of DateAndTime.
DATE_AND_TIME = "2d-1d-1d,1d:1d:1d.1d,1a1d:1d"
WIDEST = 65_535


def integer(value: Column, hint: Column) -> Column:
    """An integer by its hint: d, d-n with n places after the point, x, o, b; null for other hints."""
    digits, places = F.abs(value.cast("decimal(20,0)")).cast("string"), F.regexp_extract(hint, r"^d-([0-9]{1,2})$", 1).try_cast("int")
    size = F.greatest(F.length(digits), places + 1)
    padded = F.lpad(digits, size, F.lit("0"))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    point = F.concat(sign, F.substring(padded, F.lit(1), size - places), F.lit("."), F.substring(padded, size - places + 1, places))
    radix = lambda n: F.concat(sign, F.lower(F.conv(digits, 10, n)))
    first = F.substring(hint, 1, 1)
    plain = F.when(first == "d", value.cast("string")).when(first == "x", radix(16)).when(first == "o", radix(8)).when(first == "b", radix(2))
    return F.when(places.between(1, 18), point).otherwise(plain)


def steps(hint: Column) -> Column:
    """The steps of an octet hint: an array of (star, length, form, sep, term), or null."""
    part = lambda s, n: F.regexp_extract(s, r"^(\*?)([0-9]+)([xdoat])([^0-9*]?)([^0-9*]?)$", n)
    step = lambda s: F.struct((part(s, 1) == "*").alias("star"), part(s, 2).try_cast("int").alias("length"), part(s, 3).alias("form"), part(s, 4).alias("sep"), part(s, 5).alias("term"))
    found = F.transform(F.regexp_extract_all(hint, F.lit(STEP), 0), step)
    fits = F.forall(found, lambda s: F.coalesce(s["length"] <= WIDEST, F.lit(False)))
    return F.when(hint.rlike(rf"\A(?:{STEP})+\z") & fits, found)


def shown(chunk: Column, form: Column) -> Column:
    """Bytes (in hex) in one form. Text loses the NULs at its end, and is null if it is not UTF-8 or holds control characters."""
    text = F.try_validate_utf8(F.unhex(F.regexp_replace(chunk, "(?:00)+$", "")).cast("string"))
    text = F.when(~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), text)
    number = F.substring(chunk, 1, 16)
    return F.when(form == "x", F.lower(chunk)).when(form == "d", F.conv(number, 16, 10)).when(form == "o", F.conv(number, 16, 8)).otherwise(text)


def octets(value: Column, steps: Column) -> Column:
    """Bytes by the steps of a hint; the last step goes on to the end.

    A fold of at most one turn a byte: each turn begins a step where none is open (a repeat count is a byte of its own) and shows one piece."""
    raw, size = F.hex(value), F.octet_length(value)
    state = lambda at, step, left, out, more: F.struct(at.alias("at"), step.alias("step"), left.alias("left"), out.alias("out"), more.alias("more"))
    empty = F.lit("")

    def turn(s, _):
        fresh = s["left"] == 0
        number = F.when(fresh, F.least(s["step"] + 1, F.size(steps))).otherwise(s["step"])
        step = F.element_at(steps, number)
        counted = fresh & step["star"]
        byte = F.conv(F.substring(raw, s["at"] * 2 + 1, F.lit(2)), 16, 10).cast("int")
        left = F.when(counted, byte).when(fresh, 1).otherwise(s["left"])
        at = s["at"] + F.when(counted, 1).otherwise(0)
        take = F.least(step["length"], size - at)
        some = (left > 0) & (take > 0)
        end = F.when(some, at + take).otherwise(at)
        rest = F.when(some, left - 1).otherwise(0)
        piece = F.when(some, shown(F.substring(raw, at * 2 + 1, take * 2), step["form"])).otherwise(empty)
        closes = step["star"] & (rest == 0) & (step["term"] != "")
        sep = F.when(some & (end < size) & ~closes, step["sep"]).otherwise(empty)
        term = F.when(closes & (end < size), step["term"]).otherwise(empty)
        return F.when((s["at"] >= size) | ~s["more"], s).otherwise(state(end, number, rest, F.concat(s["out"], piece, sep, term), step["star"] | (step["length"] > 0)))

    turns = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    begin = state(F.lit(0), F.lit(0), F.lit(0), empty.cast("string"), F.lit(True))
    return F.when(steps.isNotNull() & value.isNotNull(), F.aggregate(turns, begin, turn, lambda s: s["out"]))


def date_and_time(value: Column) -> Column:
    """DateAndTime of 8 or 11 bytes; a direction other than + and - is left out with what follows; null for other sizes."""
    byte = lambda n, wide=1: F.conv(F.hex(F.substring(value, n, wide)), 16, 10).cast("int")
    head = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%d", byte(1, 2), *(byte(n) for n in range(3, 9)))
    way = F.when(byte(9) == 43, "+").when(byte(9) == 45, "-")
    zone = F.when((F.octet_length(value) == 11) & way.isNotNull(), F.format_string(" %s%02d:%02d", way, byte(10), byte(11))).otherwise("")
    return F.when(F.octet_length(value).isin(8, 11), F.concat(head, zone))


def bits(value: Column, labels: Column) -> Column:
    """The bits that are set, the first byte's highest as number 0, with labels (a map by number, b for those without); the bytes in hex if none is."""
    raw = F.hex(value)
    byte = lambda n: F.conv(F.substring(raw, (F.floor(n / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    is_set = lambda n: byte(n).bitwiseAND(F.element_at(F.array(*(F.lit(128 >> i) for i in range(8))), n % 8 + 1)) > 0
    numbers = F.when(F.octet_length(value) > 0, F.sequence(F.lit(0), F.octet_length(value) * 8 - 1)).otherwise(F.array().cast("array<int>"))
    named = F.transform(F.filter(numbers, is_set), lambda n: F.concat(F.coalesce(F.try_element_at(labels, n), F.lit("b")), F.lit("("), n.cast("string"), F.lit(")")))
    plain = F.lower(F.rtrim(F.regexp_replace(raw, "(..)", "$1 ")))
    return F.when(value.isNotNull(), F.when(F.size(named) > 0, F.array_join(named, " ")).otherwise(plain))
