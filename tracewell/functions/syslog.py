"""Syslog lines as columns: headers, structured data, key=value fields, vendors, device times.

All native expressions: regular expressions and array functions, no Python in the rows' way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: priority, RFC 5424: version, time, host, program, process, message id, rest.
RFC5424 = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (.*)$"
#: RFC 3164: month, day, time, host, tag, process, rest.
RFC3164 = r"^<(\d{1,3})>([A-Z][a-z]{2}) +(\d{1,2}) (\d{1,2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?: ?(.*)$"
ISO_LINE = r"^<(\d{1,3})>(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*) (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?: ?(.*)$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def some(text: Column) -> Column:
    """Null for an empty text or the nil value."""
    return F.when((text != "") & (text != "-"), text)


def group(text: Column, pattern: str, n: int) -> Column:
    return some(F.regexp_extract(text, pattern, n))


def priority(raw: Column) -> Column:
    """The number in <...>, 0 to 191; without one 13 (user, notice)."""
    n = F.regexp_extract(raw, r"^<(\d{1,3})>", 1).try_cast("int")
    return F.when(n.between(0, 191), n).otherwise(F.lit(13))


def facility(pri: Column) -> Column:
    return F.shiftright(pri, 3)


def severity(pri: Column) -> Column:
    return pri.bitwiseAND(7)


def iso_micros(text: Column) -> Column:
    """An ISO time with or without a fraction and a zone (UTC without one), in microseconds."""
    comma = F.regexp_replace(F.regexp_replace(text, ",", "."), "^(\\S{10}) ", "$1T")
    return F.unix_micros(comma.try_cast("timestamp"))


def rfc3164_micros(month: Column, day: Column, clock: Column, received: Column) -> Column:
    """A time without a year, in the year that puts it near its arrival: the one before if it would be over a day
    ahead, the next if it would be over 300 days behind and then at most a day ahead."""
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
    stamp = lambda year: F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), number.cast("string"), day, clock), F.lit("yyyy M d H:mm:ss")))
    day_us = 86_400_000_000
    now = F.unix_micros(received.cast("timestamp"))
    year = F.year(received)
    here, before, after = stamp(year), stamp(year - 1), stamp(year + 1)
    return F.when(here > now + day_us, before).when((now - here > 300 * day_us) & (after <= now + day_us), after).otherwise(here)


def structured_data(rest: Column) -> Column:
    """The elements [id p="v" ...] at the start of a message as fields sd.<id>.<param>; escaped signs stand for themselves."""
    block = F.regexp_extract(rest, r'^((?:\[[^\s\]]+(?: [^\s=\]]+="(?:[^"\\]|\\.)*")*\])+)', 1)
    element = r'\[([^\s\]]+)((?: [^\s=\]]+="(?:[^"\\]|\\.)*")*)\]'
    ids = F.regexp_extract_all(block, F.lit(element), F.lit(1))
    bodies = F.regexp_extract_all(block, F.lit(element), F.lit(2))
    param = r'([^\s=\]]+)="((?:[^"\\]|\\.)*)"'

    def fields(z: Column) -> Column:
        keys, values = F.regexp_extract_all(z["bodies"], F.lit(param), F.lit(1)), F.regexp_extract_all(z["bodies"], F.lit(param), F.lit(2))
        pair = lambda p: F.struct(F.concat(F.lit("sd."), z["ids"], F.lit("."), p["k"]).alias("key"), F.regexp_replace(p["v"], r'\\(["\\\]])', "$1").alias("value"))
        return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), pair)

    return F.flatten(F.transform(F.arrays_zip(ids.alias("ids"), bodies.alias("bodies")), fields))


def without_structured_data(rest: Column) -> Column:
    return F.regexp_replace(rest, r'^(?:-|(?:\[[^\s\]]+(?: [^\s=\]]+="(?:[^"\\]|\\.)*")*\])+) ?', "")


def key_values(text: Column) -> Column:
    """k=v and k="v" as an ordered list of fields; a bare value loses commas and semicolons at its end."""
    pattern = r'([A-Za-z][A-Za-z0-9_.\-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)'
    keys, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    clean = lambda v: F.when(v.startswith('"'), F.regexp_replace(F.substring(v, 2, F.length(v) - 2), r"\\(.)", "$1")).otherwise(F.regexp_replace(v, "[,;]+$", ""))
    return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(p["k"].alias("key"), clean(p["v"]).alias("value")))


def value_of(fields: Column, key: str) -> Column:
    """The first field of that name; null without one."""
    return F.get(F.filter(fields, lambda f: F.lower(f["key"]) == key.lower()), F.lit(0))["value"]


def vendor(message: Column) -> Column:
    """The first form that fits; the order of the tests is part of the meaning."""
    has = lambda *words: _all(message.contains(w) for w in words)
    return (
        F.when(message.startswith("Event|"), "aos-cx")
        .when(message.rlike(r"^[^,]*,[^,]*,[^,]*,(?:TRAFFIC|THREAT|SYSTEM|CONFIG|USERID|GLOBALPROTECT|DECRYPTION),"), "pan-os")
        .when(message.rlike(r"^<\d{6}>"), "aos-8")
        .when(has("logid=", "type=") & (has("devid=") | has("devname=")), "fortios")
        .when(message.rlike(r"%%\d\d[A-Z]"), "vrp")
        .when(message.rlike(r'^\[[A-Za-z_]+:"'), "check-point")
        .when(message.rlike(r"^(?:[a-z_]+=[^;]*;){2,}") & has("product="), "check-point")
        .when(message.rlike(r"^\d{5} [a-z]+:"), "aos-s")
        .otherwise("generic")
    )


def _all(tests) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def aos_cx(message: Column) -> Column:
    """Event|id|LOG_SEV|module|slot|text."""
    part = lambda i: F.split_part(message, F.lit("|"), F.lit(i))
    return F.struct(part(2).alias("event"), F.regexp_replace(part(3), "^LOG_", "").alias("level"), part(4).alias("module"), part(5).alias("slot"), F.regexp_extract(message, r"^(?:[^|]*\|){5}(.*)$", 1).alias("text"))


def vrp(message: Column) -> Column:
    """%%01MOD/sev/MNEMONIC(kind)[seq]:text."""
    pattern = r"%%(\d\d)([A-Z0-9_]+)/(\d)/([A-Za-z0-9_]+)\(([a-z]+)\)(?:\[(\d+)\])?:(.*)$"
    g = lambda i: F.regexp_extract(message, pattern, i)
    return F.struct(g(2).alias("module"), g(3).try_cast("int").alias("severity"), g(4).alias("mnemonic"), g(5).alias("kind"), g(6).alias("sequence"), g(7).alias("text"))


#: The columns of two record types that rules read, by place from 0.
PAN_COLUMNS = {"TRAFFIC": {7: "src", 8: "dst", 11: "rule", 30: "action"}, "SYSTEM": {4: "subtype", 8: "eventid", 9: "object", 13: "severity", 14: "description"}}


def pan_os(message: Column) -> Column:
    """The named columns of a CSV record by its type; quoted cells may hold commas."""
    cells = F.transform(F.regexp_extract_all(F.concat(message, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    kind = F.get(cells, F.lit(3))
    out = F.array().cast("array<struct<key:string,value:string>>")
    for name, columns in PAN_COLUMNS.items():
        fields = F.array(*(F.struct(F.lit(n).alias("key"), F.get(cells, F.lit(i)).alias("value")) for i, n in columns.items()))
        out = F.when(kind == name, fields).otherwise(out)
    return out


def epoch_micros(digits: Column) -> Column:
    """An epoch by its number of digits: seconds (to 11), milliseconds (to 14), microseconds (to 17) or nanoseconds."""
    n, size = digits.try_cast("decimal(20,0)"), F.length(digits)
    us = F.when(size <= 11, n * 1_000_000).when(size <= 14, n * 1000).when(size <= 17, n).otherwise(F.floor(n / 1000))
    return us.cast("bigint")


def frame_text(data: Column) -> Column:
    """Bytes as text: UTF-8 if they are, else Latin 1."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def frames(buffer: Column) -> Column:
    """The messages of a stream's text: octet-counted ("<count> <message>") where a count stands before a "<", else up to a
    line end or NUL. Counts are of characters, so the text is to be decoded as Latin 1 first. An unfinished message at the end is left out."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))
    counted = r"^(\d{1,7}) <"
    # A message takes two characters at least, which bounds the number of steps.
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(buffer) / 2).cast("int")))

    def step(s: Column, _: Column) -> Column:
        rest = F.substring(buffer, s["at"], F.lit(1 << 30))
        n = F.regexp_extract(rest, counted, 1)
        size, head = n.try_cast("int"), F.length(n) + 1
        has = n != ""
        enough = F.length(rest) >= head + size
        line = F.regexp_extract(rest, "^([^\n\x00]*)[\n\x00]", 1)
        ended = rest.rlike("^[^\n\x00]*[\n\x00]")
        message = F.when(has & enough, F.substring(rest, head + 1, size)).when(~has & ended, line)
        took = F.when(has & enough, head + size).when(~has & ended, F.length(line) + 1)
        clean = F.regexp_replace(message, "^[\r\n\x00]+|[\r\n\x00]+$", "")
        out = F.when(message.isNull() | (clean == ""), s["out"]).otherwise(F.concat(s["out"], F.array(clean)))
        return F.when(s["done"] | took.isNull(), F.struct(s["at"].alias("at"), s["out"].alias("out"), F.lit(True).alias("done"))).otherwise(F.struct((s["at"] + took).cast("int").alias("at"), out.alias("out"), F.lit(False).alias("done")))

    return F.aggregate(steps, start, step)["out"]
