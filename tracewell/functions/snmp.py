"""Notifications in BER: nested type-length-value data read for a whole batch at once, level by level, to object ids, types and values, and on to log rows.

A level's heads are read for all messages together; var-binds are read by their place in the list, the first ones of all messages, then the second ones. Object ids and numbers of
all var-binds are then decoded together. Messages are built with native expressions.

A notification of version 1 becomes one of version 2: a generic one has an id of its own, others are numbered below the enterprise, and the agent's address and the enterprise are appended as var-binds. A message that
is cut, of another version or another kind is none, and its columns are null; a list of var-binds ends at the first that cannot be read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packets import Frames, hex_of

# Tags, their names, and well-known object ids.
SEQUENCE, INTEGER, OCTETS, NULL, OID, ADDRESS, COUNTER32, GAUGE, TICKS, OPAQUE, COUNTER64 = 0x30, 0x02, 0x04, 0x05, 0x06, 0x40, 0x41, 0x42, 0x43, 0x44, 0x46
TRAP_1, INFORM, TRAP_2 = 0xA4, 0xA6, 0xA7
TYPES = {
    INTEGER: "INTEGER", OCTETS: "OCTET STRING", NULL: "NULL", OID: "OBJECT IDENTIFIER", ADDRESS: "IpAddress", COUNTER32: "Counter32", GAUGE: "Gauge32", TICKS: "TimeTicks", OPAQUE: "Opaque", COUNTER64: "Counter64",
    0x80: "noSuchObject", 0x81: "noSuchInstance", 0x82: "endOfMibView",
}
UPTIME, TRAP_OID, TRAP_ADDRESS, TRAP_ENTERPRISE, GENERIC = "1.3.6.1.2.1.1.3.0", "1.3.6.1.6.3.1.1.4.1.0", "1.3.6.1.6.3.18.1.3.0", "1.3.6.1.6.3.1.1.4.3.0", "1.3.6.1.6.3.1.1.5"
NOTIFICATIONS = {
    f"{GENERIC}.1": "coldStart", f"{GENERIC}.2": "warmStart", f"{GENERIC}.3": "linkDown", f"{GENERIC}.4": "linkUp", f"{GENERIC}.5": "authenticationFailure", "1.3.6.1.2.1.15.7.1": "bgpEstablished",
    "1.3.6.1.2.1.15.7.2": "bgpBackwardTransition", "1.3.6.1.2.1.14.16.2.2": "ospfNbrStateChange", "1.3.6.1.2.1.14.16.2.6": "ospfIfAuthFailure", "1.3.6.1.2.1.17.0.1": "newRoot", "1.3.6.1.2.1.17.0.2": "topologyChange",
}
WARNINGS = ("coldStart", "warmStart", "linkDown", "authenticationFailure")
COLUMNS = {
    "1.3.6.1.2.1.2.2.1.1": "ifIndex", "1.3.6.1.2.1.2.2.1.2": "ifDescr", "1.3.6.1.2.1.2.2.1.7": "ifAdminStatus", "1.3.6.1.2.1.2.2.1.8": "ifOperStatus", "1.3.6.1.2.1.31.1.1.1.1": "ifName",
}
#: Var-binds of a notification at most.
MOST_BINDS = 1000

BINDS = T.ArrayType(T.StructType([T.StructField("oid", T.StringType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
FIELDS = [("version", T.LongType()), ("community", T.StringType()), ("kind", T.StringType()), ("trap_oid", T.StringType()), ("uptime", T.LongType()), ("agent", T.StringType()), ("binds", BINDS)]


class Level:
    """Heads at a place of each message: tag, where the value begins and ends, and whether it lies within its parent."""

    def __init__(self, frames: Frames, at: np.ndarray, limit: np.ndarray, who: np.ndarray):
        self.tag, there = frames.number(at, 1)
        first, whole = frames.number(at + 1, 1)
        count = np.where(first >= 128, first & 127, 0)
        size = first.copy()
        for n in range(1, 5):
            value, ok = frames.number(at + 2, n)
            size = np.where(count == n, value, size)
            whole &= (count != n) | ok
        self.start = at + 2 + count
        self.end = self.start + size
        self.ok = who & there & whole & (count <= 4) & (first != 128) & (self.end <= limit)

    def a(self, *tags: int) -> np.ndarray:
        return self.ok & np.isin(self.tag, tags)


def whole_numbers(frames: Frames, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last eight bytes of each value as a number of 64 bits, filled by the sign of the first."""
    size = end - start
    first = frames.raw[frames.start[rows] + np.minimum(start, np.maximum(frames.size[rows] - 1, 0))].astype(np.uint64)
    out = np.where((first >= 128) & (size > 0), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    for i in range(9):
        inside = i < size
        byte = frames.raw[np.where(inside, frames.start[rows] + start + i, 0)].astype(np.uint64)
        out = np.where(inside, out << np.uint64(8) | byte, out)
    return out


def joined(values: pa.Array, counts: np.ndarray, between: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values), between)


def object_ids(frames: Frames, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Dotted texts of object ids; null where one is empty, does not end, or has a part beyond 63 bits."""
    out = np.full(len(rows), None, object)
    size = end - start
    begin = frames.start[rows] + start
    good = np.flatnonzero((size > 0) & (frames.raw[np.where(size > 0, begin + size - 1, 0)] < 128))
    if not len(good):
        return out
    begin, size = begin[good], size[good]
    ends = np.cumsum(size)
    raw = frames.raw[np.repeat(begin - ends + size, size) + np.arange(ends[-1])].astype(np.int64)
    last = np.flatnonzero(raw < 128)  # each part's last byte
    first = np.r_[0, last[:-1] + 1]
    width = last - first + 1
    place = np.repeat(last, width) - np.arange(len(raw))
    part = np.add.reduceat((raw & 127) << np.minimum(7 * place, 56), first)
    parts = np.diff(np.searchsorted(last, np.r_[0, ends], "left"))  # of each object id
    head = np.r_[0, np.cumsum(parts)[:-1]]
    root = np.minimum(part[head] // 40, 2)
    both = np.insert(part, head, root)
    both[head + np.arange(len(head)) + 1] -= 40 * root
    text = joined(pa.array(both).cast(pa.string()), parts + 1, ".").to_numpy(zero_copy_only=False)
    long_ = np.add.reduceat((width > 9).astype(int), head) > 0
    out[good] = np.where(long_, None, text)
    return out


def octets(frames: Frames, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Octet strings as text where they are printable, without zero bytes at their end; else as bytes in hex with spaces between."""
    begin, size = frames.start[rows] + start, end - start
    raw = frames.raw
    ends = np.cumsum(size)
    flat = raw[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.r_[0, ends].astype(np.int32)
    plain = np.r_[0, np.cumsum((flat >= 32) & (flat < 127))][bounds]
    simple = np.diff(plain) == size
    values = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])
    out = np.full(len(size), None, object)
    out[simple] = values.filter(pa.array(simple)).cast(pa.string()).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(~simple):  # few: text beyond ASCII, addresses, bit strings
        value = flat[bounds[i] : bounds[i + 1]].tobytes()
        try:
            said = value.rstrip(b"\0").decode()
            out[i] = said if said.isprintable() else value.hex(" ")
        except UnicodeDecodeError:
            out[i] = value.hex(" ")
    return out


def values_of(frames: Frames, rows: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Texts of values of all types; null for those without one."""
    out = np.full(len(rows), None, object)
    number = whole_numbers(frames, rows, start, end)
    signed = tag == INTEGER
    unsigned = np.isin(tag, (COUNTER32, GAUGE, TICKS, COUNTER64))
    # A counter's bytes are not signed: what the sign filled is taken off again.
    size = np.minimum(end - start, 8)
    clean = np.where(size < 8, number & ((np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1)), number)
    out[signed] = number[signed].view(np.int64).astype(str) if signed.any() else out[signed]
    out[unsigned] = clean[unsigned].astype(str) if unsigned.any() else out[unsigned]
    for kinds, read in (((OCTETS, OPAQUE), octets), ((OID,), object_ids)):
        mine = np.isin(tag, kinds)
        if mine.any():
            out[mine] = read(frames, rows[mine], start[mine], end[mine])
    four = (tag == ADDRESS) & (end - start == 4)
    if four.any():
        out[four] = [".".join(str(int(v) >> s & 255) for s in (24, 16, 8, 0)) for v in clean[four]]
    return out


def fields(frames: Frames) -> dict[str, np.ndarray | pa.Array]:
    """The columns of FIELDS for all messages."""
    n = len(frames.start)
    zero, every = np.zeros(n, np.int64), np.ones(n, bool)
    outer = Level(frames, zero, frames.size, every)
    version = Level(frames, outer.start, outer.end, outer.a(SEQUENCE))
    community = Level(frames, version.end, outer.end, version.a(INTEGER))
    pdu = Level(frames, community.end, outer.end, community.a(OCTETS))
    rows = np.arange(n)
    number = lambda level, who: np.where(who, whole_numbers(frames, rows, np.where(who, level.start, 0), np.where(who, level.end, 0)).view(np.int64), 0)
    of = number(version, version.a(INTEGER))
    one, two = pdu.a(TRAP_1) & (of == 0), pdu.a(TRAP_2, INFORM) & (of == 1)

    # Version 1: enterprise, agent, generic, specific, time. Version 2: request, error, index.
    enterprise = Level(frames, pdu.start, pdu.end, one)
    agent = Level(frames, enterprise.end, pdu.end, enterprise.a(OID))
    generic = Level(frames, agent.end, pdu.end, agent.a(ADDRESS))
    specific = Level(frames, generic.end, pdu.end, generic.a(INTEGER))
    ticks = Level(frames, specific.end, pdu.end, specific.a(INTEGER))
    request = Level(frames, pdu.start, pdu.end, two)
    error = Level(frames, request.end, pdu.end, request.a(INTEGER))
    index = Level(frames, error.end, pdu.end, error.a(INTEGER))
    one, two = ticks.a(TICKS), index.a(INTEGER)
    listed = Level(frames, np.where(one, ticks.end, index.end), pdu.end, one | two)
    good = listed.a(SEQUENCE)

    found: list[tuple[np.ndarray, ...]] = []
    at, open_ = listed.start, good.copy()
    for _ in range(MOST_BINDS):
        open_ &= at < listed.end
        if not open_.any():
            break
        pair = Level(frames, at, listed.end, open_)
        name = Level(frames, pair.start, pair.end, pair.a(SEQUENCE))
        value = Level(frames, name.end, pair.end, name.a(OID))
        open_ = value.ok
        mine = np.flatnonzero(open_)
        found.append((mine, name.start[mine], name.end[mine], value.tag[mine], value.start[mine], value.end[mine]))
        at = pair.end
    row, n_start, n_end, tag, v_start, v_end = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(6))
    order = np.argsort(row, kind="stable")
    row, n_start, n_end, tag, v_start, v_end = (x[order] for x in (row, n_start, n_end, tag, v_start, v_end))
    oid, value = object_ids(frames, row, n_start, n_end), values_of(frames, row, tag, v_start, v_end)
    kind = np.array([TYPES.get(int(t), f"type {int(t)}") for t in tag], object)

    # What version 2 says in its first var-binds, version 1 says in its head.
    is_time, is_trap = (oid == UPTIME) & (tag == TICKS), (oid == TRAP_OID) & (tag == OID)
    uptime, trap = np.full(n, None, object), np.full(n, None, object)
    for taken, where, which in ((uptime, is_time & two[row], slice(None, None, -1)), (trap, is_trap & two[row], slice(None))):
        taken[row[where][which]] = value[where][which]  # the first time, the last id
    rest = ~((is_time | is_trap) & two[row])
    ones = np.flatnonzero(good & one)
    root, address = object_ids(frames, ones, enterprise.start[ones], enterprise.end[ones]), values_of(frames, ones, agent.tag[ones], agent.start[ones], agent.end[ones])
    g, s = number(generic, one)[ones], number(specific, one)[ones]
    trap[ones] = [f"{GENERIC}.{a + 1}" if a < 6 else f"{e}.0.{b}" for a, b, e in zip(g.tolist(), s.tolist(), root)]
    time_of = values_of(frames, ones, ticks.tag[ones], ticks.start[ones], ticks.end[ones])
    uptime[ones] = time_of
    addressed = np.array([a not in (None, "0.0.0.0") for a in address], bool)
    more = [(ones[addressed], np.full(addressed.sum(), TRAP_ADDRESS, object), np.full(addressed.sum(), "IpAddress", object), address[addressed]), (ones, np.full(len(ones), TRAP_ENTERPRISE, object), np.full(len(ones), "OBJECT IDENTIFIER", object), root)]
    row, oid, kind, value = (np.concatenate([x[rest], *(m[i] for m in more)]) for i, x in enumerate((row, oid, kind, value)))
    order = np.argsort(row, kind="stable")
    row, oid, kind, value = row[order], oid[order], kind[order], value[order]
    items = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (oid, kind, value)], names=["oid", "type", "value"])
    binds = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), items)
    none = lambda x: np.where(good, x, None)
    said = np.full(n, None, object)
    said[good] = octets(frames, rows[good], community.start[good], community.end[good])
    agents = np.full(n, None, object)
    agents[ones] = address
    return {
        "version": pa.array(of + 1, mask=~good), "community": pa.array(said, pa.string()), "kind": pa.array(none(np.where(pdu.tag == INFORM, "inform", "trap")), pa.string()), "trap_oid": pa.array(none(trap), pa.string()),
        "uptime": pa.array([None if u is None else int(u) for u in none(uptime)], pa.int64()), "agent": pa.array(none(agents), pa.string()), "binds": pc.if_else(pa.array(good), binds, pa.scalar(None, binds.type)),
    }


def decoded(df: DataFrame, data: str = "data") -> DataFrame:
    """df with the columns of FIELDS in place of the message. A null message has none of them."""
    rest = [f for f in df.schema.fields if f.name != data]

    def run(batches):
        for b in batches:
            got = fields(Frames(b.column(b.schema.get_field_index(data)).fill_null(b"")))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), *(got[n] for n, _ in FIELDS)], names=[*(f.name for f in rest), *(n for n, _ in FIELDS)])

    return df.mapInArrow(run, T.StructType([*rest, *(T.StructField(n, k) for n, k in FIELDS)]))


# ---- log rows ---------------------------------------------------------------------------------------------------


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in of.items() for x in pair))


def column_name(oid: Column) -> Column:
    """ifName.3 for an object id of a known column with a row of one number; else the id itself."""
    column = F.regexp_extract(oid, r"^(.*)\.\d+$", 1)
    known = F.element_at(_map(COLUMNS), column)
    return F.coalesce(F.concat(known, F.regexp_extract(oid, r"(\.\d+)$", 1)), oid)


def log_rows(traps: DataFrame) -> DataFrame:
    """traps (with FIELDS) as log rows: program, severity, message, fields and vendor beside the columns that they had."""
    name = F.coalesce(F.element_at(_map(NOTIFICATIONS), F.col("trap_oid")), F.col("trap_oid"))
    item = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    said = F.filter(F.array(item("trap_oid", F.col("trap_oid")), item("version", F.when(F.col("version") == 1, "1").otherwise("2c")), item("community", F.col("community")), item("uptime", F.col("uptime")), item("agent_addr", F.col("agent"))), lambda x: x["value"].isNotNull())
    binds = F.transform("binds", lambda b: F.struct(column_name(b["oid"]).alias("key"), F.coalesce(b["value"], F.lit("")).alias("value")))
    text = F.concat_ws(" ", F.concat(F.lit("SNMPv"), F.when(F.col("version") == 1, "1").otherwise("2c"), F.lit(" "), F.col("kind")), F.col("trap_oid"), F.transform("binds", lambda b: F.concat(b["oid"], F.lit("="), F.coalesce(b["value"], F.lit("")))))
    rest = [c for c in traps.columns if c not in dict(FIELDS)]
    return traps.where("kind is not null").select(*rest, name.alias("program"), F.when(name.isin(*WARNINGS), 4).otherwise(5).alias("severity"), text.alias("message"), F.concat(binds, said).alias("fields"), F.lit("generic").alias("vendor"))


# ---- messages ---------------------------------------------------------------------------------------------------


def tlv(tag: int, body: Column) -> Column:
    """A tag, the length and the body, as text in hex. The body is an array's only entry, so that nested ones are worked out once."""

    def framed(b: Column) -> Column:
        size = F.shiftright(F.length(b), 1)
        return F.concat(F.lit(f"{tag:02x}"), F.when(size < 128, hex_of(size, 1)).otherwise(F.concat(F.lit("82"), hex_of(size, 2))), b)

    return F.get(F.transform(F.array(body), framed), F.lit(0))


def oid_hex(*parts: int | Column) -> Column:
    """An object id from its parts, of which columns are below 16,384."""
    out: list[Column] = []
    for p in [parts[0] * 40 + parts[1], *parts[2:]]:
        if isinstance(p, int):
            groups = [p & 127]
            while p := p >> 7:
                groups.insert(0, p & 127 | 128)
            out.append(F.lit(bytes(groups).hex()))
        else:
            out.append(F.when(p < 128, hex_of(p, 1)).otherwise(hex_of(F.lit(0x8000).bitwiseOR(F.shiftleft(F.shiftright(p, 7), 8)).bitwiseOR(p.bitwiseAND(127)), 2)))
    return tlv(OID, F.concat(*out))


def bind(oid: Column, value: Column) -> Column:
    return tlv(SEQUENCE, F.concat(oid, value))


def number_hex(tag: int, value: Column, size: int) -> Column:
    return tlv(tag, hex_of(value, size))


def message_v2(community: str, binds: list[Column], kind: int = TRAP_2) -> Column:
    pdu = F.concat(number_hex(INTEGER, F.lit(7), 1), F.lit("020100020100"), tlv(SEQUENCE, F.concat(*binds)))
    return F.unhex(tlv(SEQUENCE, F.concat(F.lit("020101"), tlv(OCTETS, F.lit(community.encode().hex())), tlv(kind, pdu))))


def message_v1(community: str, enterprise: Column, agent: Column, generic: Column, specific: Column, time: Column, binds: list[Column]) -> Column:
    pdu = F.concat(enterprise, number_hex(ADDRESS, agent, 4), number_hex(INTEGER, generic, 1), number_hex(INTEGER, specific, 2), number_hex(TICKS, time, 4), tlv(SEQUENCE, F.concat(*binds)))
    return F.unhex(tlv(SEQUENCE, F.concat(F.lit("020100"), tlv(OCTETS, F.lit(community.encode().hex())), tlv(TRAP_1, pdu))))
