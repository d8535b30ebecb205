"""One line parser: a raw line to a log row, whatever its header.

Header (RFC 5424, ISO, RFC 3164 with a year or without, an epoch stamp, or none), prefixes of routers and counters, host and tag, the vendor's body, its fields and its
own severity, and the device's time, all native expressions in one pass over the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import syslog as s
from .text import neutral

#: Fields that a line has at most; of more, the last one says how many were not kept.
MOST_FIELDS = 1000
#: Bytes of host, program and process that a row keeps at most.
HOST_BYTES, LABEL_BYTES = 255, 128

_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
#: month, day, year before the clock, clock, zone, year behind it, rest
BSD = rf"^[*.]?([A-Z][a-z]{{2}}) +(\d{{1,2}}) +(?:(\d{{4}}) +)?({_CLOCK})(?: (?:([A-Z]{{3,4}})(?: (\d{{4}}))?|(\d{{4}})))?:? +(.*)$"
ISO = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?):? +(.*)$"
#: version, stamp, host, program, process, message id, rest
VERSION_1 = r"^1 (\S+) (\S+) (\S+) (\S+) (\S+)(?: (.*))?$"
#: seconds and fraction, host, program, text
EPOCH = r"^1 (\d{10})\.(\d{1,9}) (\S+) (\S+) (.*)$"
#: the node before a router's time stamp, with a host before it or not
NODE = r"^(?:(\S+) )?((?:RP|LC)/\d+/\w+/CPU\d+):(.*)$"
#: a counter, a host that the line came from, a second counter
COUNTED = r"^(\d+): (?:([A-Za-z][\w.\-]*): )?(?:(\d{6}): )?(?=[*.]?[A-Z][a-z]{2} +\d)(.*)$"
TAG = r"^([^\s:\[\]]+)(?:\[([^\]]*)\])?: ?(.*)$"
HOST_TAG = r"^(\S+) ([^\s:\[\]]+)(?:\[([^\]]*)\])?: ?(.*)$"


def label(text: Column, most: int) -> Column:
    """One line, without control signs and signs that turn or hide text, cut to so many bytes at a whole character."""
    clean = F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2069\\ufeff]", "\ufffd")
    cut = F.decode(F.substring(F.encode(clean, "UTF-8"), 1, most), "UTF-8")
    short = F.regexp_replace(cut, "\ufffd+$", "")
    return F.when(F.octet_length(clean) <= most, clean).otherwise(short)


def _g(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def _field(key: str, value: Column) -> Column:
    return F.when(value != "", F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


#: Severity words and numbers that a vendor's line says of itself.
LEVELS = {
    "emergency": 0, "emerg": 0, "alert": 1, "critical": 2, "crit": 2, "error": 3, "err": 3, "high": 3, "warning": 4, "warn": 4, "warni": 4, "medium": 4,
    "notice": 5, "notification": 5, "low": 5, "information": 6, "informational": 6, "info": 6, "debug": 7,
}


def level(word: Column) -> Column:
    """The severity that a word stands for; null for another word."""
    names = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.element_at(names, F.lower(word)).cast("int")


def aos_8(message: Column) -> Column:
    """<code> [<pid>] <LEVEL> text, as fields, with the text's own key=value pairs."""
    pattern = r"^<(\d{6})> (?:<(\d+)> )?<([A-Z]+)> ?(?:<[^>]*> ?|\|([^|]*)\| ?)?(.*)$"
    return F.struct(_g(message, pattern, 1).alias("code"), _g(message, pattern, 3).alias("level"), _g(message, pattern, 4).alias("device"), _g(message, pattern, 5).alias("text"))


def check_point(message: Column) -> Column:
    """[k:"v"; k:"v"] or k=v;k=v; as an ordered list of fields."""
    quoted = r'([A-Za-z_][\w.\-]*):"((?:[^"\\]|\\.)*)"'
    bare = r"([a-z_]+)=([^;]*);"

    def pairs(pattern: str, clean) -> Column:
        keys, values = F.regexp_extract_all(message, F.lit(pattern), F.lit(1)), F.regexp_extract_all(message, F.lit(pattern), F.lit(2))
        return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(p["k"].alias("key"), clean(p["v"]).alias("value")))

    return F.when(message.startswith("["), pairs(quoted, lambda v: F.regexp_replace(v, r"\\(.)", "$1"))).otherwise(pairs(bare, lambda v: v))


def clear_pass(message: Column) -> Column:
    """Prefix.Key=value, Prefix.Key=value: a value runs to the next key."""
    pattern = r"([A-Z][\w\-]*\.[\w.\-]+)=(.*?)(?=, ?[A-Z][\w\-]*\.[\w.\-]+=|$)"
    keys, values = F.regexp_extract_all(message, F.lit(pattern), F.lit(1)), F.regexp_extract_all(message, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(p["k"].alias("key"), F.trim(p["v"]).alias("value")))


def parsed(df: DataFrame, raw: str = "raw", received: str = "received") -> DataFrame:
    """df with the columns of a log row: facility, severity, device_t, host, program, pid, vendor, message, fields.

    A line without a priority is of user and notice. A header that does not fit is part of the message. The vendor's own severity, where its line has one, counts."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    pri = s.priority(F.col(raw))
    rows = df.withColumn("_pri", pri).withColumn("_rest", F.regexp_replace(F.col(raw), r"^<(?:[0-9]|[1-9][0-9]|1[0-8][0-9]|19[01])>", ""))
    # Prefixes before the time stamp.
    rest = F.col("_rest")
    counted, node = rest.rlike(COUNTED), rest.rlike(NODE)
    rows = rows.withColumn("_before", F.when(counted, F.concat(_field("seq", _g(rest, COUNTED, 1)), _field("seqno", _g(rest, COUNTED, 3)))).when(node, _field("node", _g(rest, NODE, 2))).otherwise(none))
    rows = rows.withColumn("_named", F.when(counted, _g(rest, COUNTED, 2)).when(node, _g(rest, NODE, 1)).otherwise(""))
    rows = rows.withColumn("_rest", F.when(counted, _g(rest, COUNTED, 4)).when(node, _g(rest, NODE, 3)).otherwise(rest))
    # The kind of header, then its parts.
    kind = F.when(rest.rlike(EPOCH), "epoch").when(rest.rlike(VERSION_1), "version").when(rest.rlike(ISO), "iso").when(rest.rlike(BSD), "bsd").otherwise("none")
    rows = rows.withColumn("_kind", kind)
    is_ = lambda k: F.col("_kind") == k
    year = F.concat(_g(rest, BSD, 3), _g(rest, BSD, 6), _g(rest, BSD, 7))
    clock = F.regexp_extract(_g(rest, BSD, 4), r"^(\d{1,2}:\d{2}:\d{2})", 1)
    fraction = F.rpad(F.regexp_extract(_g(rest, BSD, 4), r"[.,](\d{1,6})", 1), 6, "0").try_cast("bigint")
    dated = F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", year, _g(rest, BSD, 1), _g(rest, BSD, 2), clock), F.lit("yyyy MMM d H:mm:ss")))
    bsd = F.when(year != "", dated).otherwise(s.rfc3164_micros(_g(rest, BSD, 1), _g(rest, BSD, 2), clock, F.col(received))) + F.coalesce(fraction, F.lit(0))
    epoch = _g(rest, EPOCH, 1).try_cast("bigint") * 1_000_000 + F.rpad(F.substring(_g(rest, EPOCH, 2), 1, 6), 6, "0").try_cast("bigint")
    rows = rows.withColumn("device_t", F.when(is_("epoch"), epoch).when(is_("version"), s.iso_micros(_g(rest, VERSION_1, 1))).when(is_("iso"), s.iso_micros(_g(rest, ISO, 1))).when(is_("bsd"), bsd))
    body = F.when(is_("iso"), _g(rest, ISO, 2)).when(is_("bsd"), _g(rest, BSD, 8)).when(is_("epoch"), _g(rest, EPOCH, 5)).when(is_("version"), _g(rest, VERSION_1, 6)).otherwise(rest)
    rows = rows.withColumn("_body", body)
    body, stamped = F.col("_body"), is_("iso") | is_("bsd")
    bare = is_("none") | (F.col("_named") != "")
    hosted = stamped & ~bare & body.rlike(HOST_TAG)
    tagged = ~hosted & (stamped | is_("none")) & body.rlike(TAG)
    pick = lambda version, epoch_, host_tag, tag: F.when(is_("version"), version).when(is_("epoch"), epoch_).when(hosted, host_tag).when(tagged, tag).otherwise("")
    host = pick(_g(rest, VERSION_1, 2), _g(rest, EPOCH, 3), F.regexp_replace(_g(body, HOST_TAG, 1), ",$", ""), F.lit(""))
    program = pick(_g(rest, VERSION_1, 3), _g(rest, EPOCH, 4), _g(body, HOST_TAG, 2), _g(body, TAG, 1))
    pid = pick(_g(rest, VERSION_1, 4), F.lit(""), _g(body, HOST_TAG, 3), _g(body, TAG, 2))
    message = pick(s.without_structured_data(body), body, _g(body, HOST_TAG, 4), _g(body, TAG, 3))
    message = F.when(is_("version") | is_("epoch") | hosted | tagged, message).otherwise(body)
    rows = rows.withColumn("message", neutral(F.regexp_replace(message, "^\ufeff", "")))
    rows = rows.withColumn("host", s.some(label(F.when(F.col("_named") != "", F.col("_named")).otherwise(host), HOST_BYTES)))
    rows = rows.withColumn("program", s.some(label(program, LABEL_BYTES))).withColumn("pid", s.some(label(pid, LABEL_BYTES)))
    own = F.when(is_("version"), F.concat(_field("msgid", F.coalesce(s.some(_g(rest, VERSION_1, 5)), F.lit(""))), F.coalesce(s.structured_data(body), none))).otherwise(none)
    # The vendor's body.
    m = F.col("message")
    rows = rows.withColumn("_own", own).withColumn("vendor", s.vendor(m))
    is_v = lambda v: F.col("vendor") == v
    cx, eight, vrp, pan, pairs = s.aos_cx(m), aos_8(m), s.vrp(m), s.pan_os(m), s.key_values(m)
    few = F.when(F.size(pairs) >= 3, pairs).otherwise(none)  # of an unknown vendor, a pair or two are prose
    fields = (
        F.when(is_v("aos-cx"), F.concat(_field("event", cx["event"]), _field("module", cx["module"]), _field("slot", cx["slot"])))
        .when(is_v("aos-8"), F.concat(_field("code", eight["code"]), _field("device", eight["device"]), s.key_values(eight["text"])))
        .when(is_v("aos-s"), F.concat(_field("event", _g(m, r"^(\d{5}) ", 1)), _field("module", _g(m, r"^\d{5} ([a-z]+):", 1))))
        .when(is_v("vrp"), F.concat(_field("module", vrp["module"]), _field("mnemonic", vrp["mnemonic"]), s.key_values(F.regexp_extract(vrp["text"], r"\(([^()]*)\)\s*$", 1))))
        .when(is_v("check-point"), check_point(m))
        .when(is_v("pan-os"), pan)
        .when(is_v("fortios"), pairs)
        .otherwise(few)
    )
    said = (
        F.when(is_v("aos-cx"), level(cx["level"]))
        .when(is_v("aos-8"), level(eight["level"]))
        .when(is_v("vrp"), vrp["severity"])
        .when(is_v("check-point"), level(s.value_of(F.col("_all"), "severity")))
        .when(is_v("pan-os"), level(s.value_of(F.col("_all"), "severity")))
        .when(is_v("fortios"), level(s.value_of(F.col("_all"), "level")))
    )
    rows = rows.withColumn("_all", F.concat(F.col("_before"), F.col("_own"), F.coalesce(fields, none)))
    n = F.size("_all")
    note = F.concat((n - (MOST_FIELDS - 1)).cast("string"), F.lit(" more not kept"))
    cut = F.concat(F.slice("_all", 1, MOST_FIELDS - 1), F.array(F.struct(F.lit("truncated_fields").alias("key"), note.alias("value"))))
    rows = rows.withColumn("facility", s.facility(F.col("_pri"))).withColumn("severity", F.coalesce(said, s.severity(F.col("_pri"))))
    rows = rows.withColumn("fields", F.when(n > MOST_FIELDS, cut).otherwise(F.col("_all")))
    # As a generator: a filter on a column is not pushed below it, where it would be worked out from the line once more for each use.
    out = ("facility", "severity", "device_t", "host", "program", "pid", "vendor", "message", "fields")
    return rows.select(*(c for c in df.columns if c not in out), F.inline(F.array(F.struct(*out))))
