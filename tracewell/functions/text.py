"""Numbers, durations and lists in words; guards for exported cells; pieces of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_words(seconds: Column) -> Column:
    """45 s, 3 min 20 s (below 10 min), 12 min, 2 h 5 min, 1 d 3 h."""
    s = seconds.cast("bigint")
    whole = lambda n: F.floor(s / n).cast("bigint").cast("string")
    left = lambda n, unit: F.floor((s % n) / unit).cast("bigint")
    some = lambda n, unit, name: F.when(left(n, unit) > 0, F.concat(F.lit(" "), left(n, unit).cast("string"), F.lit(name))).otherwise("")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 600, F.concat(whole(60), F.lit(" min"), some(60, 1, " s")))
        .when(s < 3600, F.concat(whole(60), F.lit(" min")))
        .when(s < 86400, F.concat(whole(3600), F.lit(" h"), some(3600, 60, " min")))
        .otherwise(F.concat(whole(86400), F.lit(" d"), some(86400, 3600, " h")))
    )


def uptime(ticks: Column) -> Column:
    """Hundredths of a second as 1d 00:00:01."""
    s = F.floor(ticks / 100).cast("bigint")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.concat(F.floor(s / 86400).cast("bigint").cast("string"), F.lit("d "), two(F.floor(s % 86400 / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))


def byte_words(n: Column) -> Column:
    """Bytes in units of 1024 with one decimal, cut and not rounded."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        tenths = F.floor(n * 10 / F.lit(float(1024**power))).cast("bigint")
        text = F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1024**power, text).otherwise(out)
    return out


def list_words(items: Column, most: int = 3) -> Column:
    """a; a and b; a, b and c; a, b, c and 2 more."""
    n = F.size(items)
    more = F.concat(F.array_join(F.slice(items, 1, most), ", "), F.lit(" and "), (n - most).cast("string"), F.lit(" more"))
    pair = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).when(n > most, more).otherwise(pair)


def csv_guard(cell: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def csv_quote(cell: Column) -> Column:
    """Quotes a cell that holds a comma, a quote or a line end."""
    return F.when(cell.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def octal_escape(text: Column, keep: str = "\t") -> Column:
    """Control characters as # and three octal digits, so that one record stays one line."""
    out = text
    for code in [*range(32), *range(127, 160)]:
        if chr(code) not in keep:
            out = F.replace(out, F.lit(chr(code)), F.lit(f"#{code:03o}"))
    return F.when(text.rlike("[\\x00-\\x1f\\x7f-\\x9f]"), out).otherwise(text)


def neutral(text: Column) -> Column:
    """Control characters (but tab, line feed and return) as U+FFFD."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]", "�")


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([*_`\[\]<>|\\])", r"\\$1")


def excerpt(text: Column, most: int = 90) -> Column:
    """Trimmed and cut to so many characters, the last an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def token_after(text: Column, marker: str) -> Column:
    """The word after a marker in any case; null without one."""
    found = F.rtrim(F.regexp_extract(text, rf"(?i){marker}[ =:\"']*([^ ,;()\[\]\"'\r\n]+)", 1), F.lit(".:"))
    return F.when(found != "", found)


def hex_dump(data: Column) -> Column:
    """Lines of an offset and 16 bytes in hex."""
    size = F.octet_length(data)
    rows = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / 16).cast("int"))).otherwise(F.array().cast("array<int>"))
    line = lambda i: F.concat(F.lpad(F.lower(F.hex(i * 16)), 4, "0"), F.lit("  "), F.trim(F.regexp_replace(F.lower(F.hex(F.substring(data, i * 16 + 1, F.lit(16)))), "(..)", "$1 ")))
    return F.array_join(F.transform(rows, line), "\n")


def ms_words(tenths: Column) -> Column:
    """Tenths of milliseconds (whole): 3.5 ms below 10 ms, 120 ms below a second, 1.25 s below ten, else 14.0 s; cut and not rounded."""
    n = tenths.cast("bigint")
    part = lambda unit, keep: (F.floor(n / unit) % keep).cast("bigint").cast("string")
    whole = lambda unit: F.floor(n / unit).cast("bigint").cast("string")
    small, large = F.concat(whole(10), F.lit("."), part(1, 10), F.lit(" ms")), F.concat(whole(10_000), F.lit("."), part(1000, 10), F.lit(" s"))
    return F.when(n < 100, small).when(n < 10_000, F.concat(whole(10), F.lit(" ms"))).when(n < 100_000, F.concat(whole(10_000), F.lit("."), F.lpad(part(100, 100), 2, "0"), F.lit(" s"))).otherwise(large)


def quoted(word: Column) -> Column:
    """A word as a filter takes it: in quotes unless it is one plain word and no operator."""
    plain = word.rlike("^[A-Za-z0-9._:\\-]+$") & ~F.upper(word).isin("AND", "OR", "NOT", "NOR")
    return F.when(plain, word).otherwise(F.concat(F.lit('"'), F.replace(word, F.lit('"'), F.lit("")), F.lit('"')))


def day_file(stamp: Column, arrival: Column) -> Column:
    """The file of a line: that of its own day if it arrives on it or on the next, else that of its arrival."""
    own = F.datediff(arrival, stamp).between(0, 1)
    return F.concat(F.date_format(F.when(own, stamp).otherwise(arrival), "yyyy-MM-dd"), F.lit(".log"))
