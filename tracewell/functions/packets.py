"""Frames as columns, in one pass over the bytes of a batch: Ethernet and VLAN tags, ARP, IPv4 and IPv6, TCP with options, UDP, ICMP, DNS and DHCP.

Every field is read for all frames of a batch at once; a part that is not there, or that a frame ends before, is null. Frames are built with native expressions.
"""

from __future__ import annotations

import ipaddress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
#: Ports by service name.
SERVICES = {"ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "dns": 53, "dhcp": 67, "http": 80, "ntp": 123, "snmp": 161, "ldap": 389, "https": 443, "syslog": 514, "radius": 1812}


FIELDS = [
    ("src_mac", T.StringType()), ("dst_mac", T.StringType()), ("vlan", T.LongType()), ("tags", T.LongType()), ("ether_type", T.LongType()), ("source", T.StringType()), ("destination", T.StringType()),
    ("proto", T.LongType()), ("ttl", T.LongType()), ("identification", T.LongType()), ("sport", T.LongType()), ("dport", T.LongType()), ("seq", T.LongType()), ("ack", T.LongType()),
    ("flags", T.LongType()), ("window", T.LongType()), ("mss", T.LongType()), ("window_scale", T.LongType()), ("sack_blocks", T.LongType()), ("ts_value", T.LongType()), ("ts_echo", T.LongType()), ("payload_at", T.LongType()), ("payload_length", T.LongType()), ("icmp_type", T.LongType()), ("icmp_code", T.LongType()),
    ("arp_request", T.BooleanType()), ("dns_id", T.LongType()), ("dns_response", T.BooleanType()), ("dns_rcode", T.LongType()), ("dns_name", T.StringType()), ("dns_type", T.LongType()), ("dns_answers", T.ArrayType(T.StringType())), ("dhcp_type", T.LongType()),
    ("dhcp_xid", T.LongType()), ("dhcp_client", T.StringType()), ("dhcp_server", T.StringType()), ("dhcp_lease", T.LongType()),
]
#: Tags of VLANs that a frame may carry one after another, and headers between IPv6 and its transport.
MOST_TAGS, MOST_EXTENSIONS = 4, 8
VLAN_TAGS, IPV6_EXTENSIONS = (0x8100, 0x88A8, 0x9100), (0, 43, 60)


class Frames:
    """The bytes of a batch's frames, read at one place of each at a time."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.raw = np.r_[raw[: offsets[-1]], np.zeros(32, np.uint8)]

    def number(self, at, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned big-endian numbers of so many bytes at a place of each frame, and whether the frame has them."""
        at = np.broadcast_to(np.asarray(at), self.start.shape)
        there = (at >= 0) & (at + size <= self.size)
        first = np.where(there, self.start + at, 0)
        out = np.zeros(len(first), np.int64)
        for i in range(size):
            out = out << 8 | self.raw[first + i]
        return out, there


def _texts(values: np.ndarray, there: np.ndarray, text) -> np.ndarray:
    """text of each different value, for the rows that have one."""
    out = np.full(len(values), None, object)
    different, which = np.unique(values[there], return_inverse=True, axis=0)
    words = np.array([text(v) for v in different], object)
    out[there] = words[which.ravel()] if len(words) else out[there]
    return out


def _mac(n: int) -> str:
    h = f"{int(n):012x}"
    return ":".join(h[i : i + 2] for i in range(0, 12, 2))


#: Fixed values of name messages: ports (also multicast and link-local ones), jumps of a name at most, answers read, types whose data is an address or a name.
DNS_PORTS, MOST_JUMPS, MOST_ANSWERS = (53, 5353, 5355), 16, 8
TYPE_A, TYPE_AAAA, NAME_TYPES = 1, 28, (2, 5, 12)


def names(frames: Frames, at: np.ndarray, begin: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names that begin at a place of each frame of who, and where each ends: labels with dots between, pointers followed from begin, for all frames a label at a time.

    A name is null that does not end in its frame, has a label of another kind, or jumps more than MOST_JUMPS times, which a ring of pointers does."""
    n = len(at)
    at, open_, ended = at.copy(), who.copy(), np.zeros(n, bool)
    after, jumps = np.full(n, -1), np.zeros(n, np.int64)
    of, start, size = [], [], []
    while open_.any():
        length, there = frames.number(at, 1)
        low, whole = frames.number(at + 1, 1)
        open_ &= there
        last = open_ & (length == 0)
        after = np.where(last & (after < 0), at + 1, after)
        ended |= last
        jump = open_ & (length >= 192) & whole
        after = np.where(jump & (after < 0), at + 2, after)
        jumps += jump
        label = open_ & (length > 0) & (length < 64) & (at + 1 + length <= frames.size)
        rows = np.flatnonzero(label)
        of.append(rows)
        start.append(frames.start[rows] + at[rows] + 1)
        size.append(length[rows])
        at = np.where(jump, begin + ((length & 63) << 8 | low), at + 1 + length)
        open_ = (jump & (jumps <= MOST_JUMPS)) | label
    of, start, size = (np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64) for x in (of, start, size))
    order = np.argsort(of, kind="stable")
    of, start, size = of[order], start[order], size[order]
    # The labels' bytes, those beyond ASCII as two, and the labels of each frame joined.
    ends = np.cumsum(size)
    raw = frames.raw[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    wide = raw >= 128
    place = np.arange(len(raw)) + np.cumsum(wide) - wide
    text = np.zeros(len(raw) + int(wide.sum()), np.uint8)
    text[place] = np.where(wide, 192 | raw >> 6, raw)
    text[place[wide] + 1] = 128 | raw[wide] & 63
    bounds = np.r_[0, np.cumsum(1 + wide)][np.r_[0, ends]].astype(np.int32) if len(ends) else np.zeros(1, np.int32)
    labels = pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds.tobytes()), pa.py_buffer(text.tobytes()))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), labels)
    out = pc.binary_join(lists, ".").to_numpy(zero_copy_only=False).astype(object)
    out[~ended] = None
    return out, ended, after


def ipv4_text(value: np.ndarray, there: np.ndarray) -> np.ndarray:
    return _texts(value, there, lambda v: ".".join(str(int(v) >> s & 255) for s in (24, 16, 8, 0)))


def ipv6_text(high: np.ndarray, low: np.ndarray, there: np.ndarray) -> np.ndarray:
    return _texts(np.stack([high, low], 1).astype(np.uint64), there, lambda v: str(ipaddress.IPv6Address((int(v[0]) << 64) | int(v[1]))))


def dns_fields(frames: Frames, begin: np.ndarray, dns: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The message that begins at a place of each frame of dns: its head, its first question, and up to MOST_ANSWERS answers as text."""
    number, n = frames.number, len(begin)
    ident, i_ok = number(begin, 2)
    bits, b_ok = number(begin + 2, 2)
    asked, _ = number(begin + 4, 2)
    answers, a_ok = number(begin + 6, 2)
    name, named, at = names(frames, begin + 12, begin, dns & b_ok & a_ok & (asked > 0))
    kind, k_ok = number(at, 2)
    out = {"dns_id": (ident, dns & i_ok), "dns_response": (bits >> 15 == 1, dns & b_ok), "dns_rcode": (bits & 15, dns & b_ok), "dns_name": (name, named), "dns_type": (kind, named & k_ok)}
    # Behind the first question come the others, then the answers.
    at, ready = np.where(named, at + 4, begin + 12), dns & a_ok & (named | (asked == 0))
    more = np.where(named, asked - 1, 0)
    while (ready & (more > 0)).any():
        now = ready & (more > 0)
        _, ok, after = names(frames, at, begin, now)
        ready &= ~now | ok
        at, more = np.where(now & ok, after + 4, at), more - 1
    texts = []
    for k in range(MOST_ANSWERS):
        now = ready & (answers > k)
        if not now.any():
            break
        _, ok, after = names(frames, at, begin, now)
        kind, _ = number(after, 2)
        size, s_ok = number(after + 8, 2)
        data = after + 10
        now &= ok & s_ok & (data + size <= frames.size)
        four, _ = number(data, 4)
        high, _ = number(data, 8)
        low, _ = number(data + 8, 8)
        said = ipv4_text(four, now & (kind == TYPE_A) & (size == 4))
        is_six, is_name = now & (kind == TYPE_AAAA) & (size == 16), now & np.isin(kind, NAME_TYPES)
        said = np.where(is_six, ipv6_text(high, low, is_six), said) if is_six.any() else said
        said = np.where(is_name, names(frames, data, begin, is_name)[0], said) if is_name.any() else said
        texts.append(said)
        ready, at = now | (ready & (answers <= k)), np.where(now, data + size, at)
    lists = np.full(n, None, object)
    for i in np.flatnonzero(dns & a_ok & (answers > 0)):
        lists[i] = [t[i] for t in texts if t[i] is not None]
    out["dns_answers"] = (lists, dns & a_ok & (answers > 0))
    return out


def dhcp_options(frames: Frames, at: np.ndarray, who: np.ndarray, wanted: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The first value of each option wanted, as a number of up to eight bytes, and its size (0: not there), for all frames an option at a time, to the frames' ends."""
    out = {code: (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)) for code in wanted}
    at, open_ = at.copy(), who.copy()
    while open_.any():
        code, there = frames.number(at, 1)
        size, whole = frames.number(at + 1, 1)
        open_ &= there & (code != 255) & (whole | (code == 0))
        for kind, (value, held) in out.items():
            mine = open_ & (code == kind) & (held == 0) & (at + 2 + size <= frames.size)
            if mine.any():
                number = np.zeros(len(at), np.int64)
                for i in range(8):
                    byte, _ = frames.number(at + 2 + i, 1)
                    number = np.where(i < size, number << 8 | byte, number)
                value[mine], held[mine] = number[mine], size[mine]
        at = at + np.where(code == 0, 1, 2 + size)
    return out


def fields(frames: Frames) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each field's values, and where it is there."""
    number, n = frames.number, len(frames.start)
    every = np.ones(n, bool)
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name, at in (("dst_mac", 0), ("src_mac", 6)):
        value, ok = number(at, 6)
        out[name] = (_texts(value, ok, _mac), ok)
    # Tags of VLANs: the first one counts, the others are stepped over.
    kind, ok = number(12, 2)
    l3, tags, vlan = np.full(n, 14), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(MOST_TAGS):
        tagged = ok & np.isin(kind, VLAN_TAGS)
        if not tagged.any():
            break
        tag, has = number(l3, 2)
        vlan = np.where(tagged & (k == 0), tag & 4095, vlan)
        inner, ok_inner = number(l3 + 2, 2)
        tags, l3 = tags + tagged, l3 + 4 * tagged
        kind, ok = np.where(tagged, inner, kind), np.where(tagged, has & ok_inner, ok)
    out["vlan"], out["tags"], out["ether_type"] = (vlan, tags > 0), (tags, every), (kind, ok)
    # IPv4
    head, has = number(l3, 1)
    size = (head & 15) * 4
    four = ok & has & (kind == 0x0800) & (head >> 4 == 4) & (size >= 20)
    total, _ = number(l3 + 2, 2)
    part, _ = number(l3 + 6, 2)
    ttl, ttl_ok = number(l3 + 8, 1)
    proto, proto_ok = number(l3 + 9, 1)
    ident, ident_ok = number(l3 + 4, 2)
    # IPv6, and the headers before its transport.
    six = ok & has & (kind == 0x86DD) & (head >> 4 == 6)
    length6, _ = number(l3 + 4, 2)
    next6, next_ok = number(l3 + 6, 1)
    hops, hops_ok = number(l3 + 7, 1)
    l4 = np.where(six, l3 + 40, l3 + size)
    whole = four & (part & 8191 == 0)  # later fragments have no transport head
    whole6 = six & next_ok
    for _ in range(MOST_EXTENSIONS):
        more = whole6 & (np.isin(next6, IPV6_EXTENSIONS) | (next6 == 44))
        if not more.any():
            break
        following, f_ok = number(l4, 1)
        span, s_ok = number(l4 + 1, 1)
        place, p_ok = number(l4 + 2, 2)
        piece = more & (next6 == 44)
        whole6 &= ~more | (f_ok & s_ok)
        whole6 &= ~piece | (p_ok & (place >> 3 == 0))
        l4 = np.where(more, l4 + np.where(piece, 8, (span + 1) * 8), l4)
        next6 = np.where(more, following, next6)
    proto = np.where(six, next6, proto)
    is_ip = (four & proto_ok) | (six & next_ok)
    first = (whole & proto_ok) | whole6
    rest = np.where(six, length6 - (l4 - l3 - 40), total - size)  # bytes from the transport head on
    out["proto"], out["ttl"] = (proto, is_ip), (np.where(six, hops, ttl), np.where(six, hops_ok, four & ttl_ok))
    out["identification"] = (ident, four & ident_ok)
    arp = ok & (kind == 0x0806)
    request, r_ok = number(l3 + 6, 2)
    out["arp_request"] = (request == 1, arp & r_ok)
    for name, at4, at_arp, at6 in (("source", 12, 14, 8), ("destination", 16, 24, 24)):
        value, v_ok = number(l3 + np.where(arp, at_arp, at4), 4)
        text = ipv4_text(value, (four | arp) & v_ok)
        high, h_ok = number(l3 + at6, 8)
        low, w_ok = number(l3 + at6 + 8, 8)
        long_ = six & h_ok & w_ok
        if long_.any():
            text = np.where(long_, ipv6_text(high, low, long_), text)
        out[name] = (text, ((four | arp) & v_ok) | long_)
    # Transport
    tcp, udp = first & (proto == 6), first & (proto == 17)
    icmp = first & ((four & (proto == 1)) | (six & (proto == 58)))
    for name, at, width, who in (("sport", 0, 2, tcp | udp), ("dport", 2, 2, tcp | udp), ("seq", 4, 4, tcp), ("ack", 8, 4, tcp), ("flags", 13, 1, tcp), ("window", 14, 2, tcp), ("icmp_type", 0, 1, icmp), ("icmp_code", 1, 1, icmp)):
        value, v_ok = number(l4 + at, width)
        out[name] = (value, who & v_ok)
    data, d_ok = number(l4 + 12, 1)
    tcp_head = (data >> 4) * 4
    udp_size, u_ok = number(l4 + 4, 2)
    out["payload_length"] = (np.where(tcp, rest - tcp_head, udp_size - 8), (tcp & d_ok) | (udp & u_ok))
    out["payload_at"] = (np.where(tcp, l4 + tcp_head, l4 + 8), (tcp & d_ok) | (udp & u_ok))
    # Options of TCP, one of each frame at a time.
    mss, scale, sack, stamp, echo = ((np.zeros(n, np.int64), np.zeros(n, bool)) for _ in range(5))
    at, open_ = l4 + 20, tcp & d_ok & (tcp_head > 20)
    while open_.any():
        code, c_ok = number(at, 1)
        long_, g_ok = number(at + 1, 1)
        open_ = open_ & c_ok & (code != 0) & (at < l4 + tcp_head)
        for kept, kind_, place, width in ((mss, 2, 2, 2), (scale, 3, 2, 1), (stamp, 8, 2, 4), (echo, 8, 6, 4)):
            value, v_ok = number(at + place, width)
            mine = open_ & (code == kind_) & v_ok
            kept[0][mine] = value[mine]
            kept[1][mine] = True
        blocks = open_ & (code == 5) & g_ok & (long_ >= 10)
        sack[0][blocks], sack[1][blocks] = (long_[blocks] - 2) // 8, True
        open_ = open_ & ((code == 1) | (g_ok & (long_ >= 2)))
        at = at + np.where(code == 1, 1, np.maximum(long_, 1))
    out["mss"], out["window_scale"], out["sack_blocks"], out["ts_value"], out["ts_echo"] = mss, scale, sack, stamp, echo
    # DNS, and DHCP with its options.
    sport, dport = out["sport"][0], out["dport"][0]
    dns = udp & out["dport"][1] & (np.isin(sport, DNS_PORTS) | np.isin(dport, DNS_PORTS))
    out |= dns_fields(frames, l4 + 8, dns)
    dhcp = udp & out["dport"][1] & np.isin(sport, (67, 68)) & np.isin(dport, (67, 68))
    cookie, k_ok = number(l4 + 8 + 236, 4)
    dhcp &= k_ok & (cookie == 0x63825363)
    xid, _ = number(l4 + 12, 4)
    client, _ = number(l4 + 36, 6)
    options = dhcp_options(frames, l4 + 248, dhcp, (53, 51, 54))
    out["dhcp_xid"], out["dhcp_client"] = (xid, dhcp), (_texts(client, dhcp, _mac), dhcp)
    for name, code in (("dhcp_type", 53), ("dhcp_lease", 51)):
        out[name] = (options[code][0], options[code][1] > 0)
    four = options[54][1] == 4
    out["dhcp_server"] = (ipv4_text(options[54][0], four), four)
    return out


def decoded(df: DataFrame, data: str = "data") -> DataFrame:
    """df with the columns of FIELDS in place of the frame. A null frame has none of them."""
    rest = [f for f in df.schema.fields if f.name != data]

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index(data))
            got = fields(Frames(column.fill_null(b"")))
            kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.ArrayType(T.StringType()): pa.list_(pa.string())}
            arrays = [pa.array(got[n][0] if k in (T.LongType(), T.BooleanType()) else got[n][0].astype(object), kinds[k], mask=~got[n][1]) for n, k in FIELDS]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), *arrays], names=[*(f.name for f in rest), *(n for n, _ in FIELDS)])

    return df.mapInArrow(run, T.StructType([*rest, *(T.StructField(n, k) for n, k in FIELDS)]))


def flag_label(flags: Column) -> Column:
    """SYN,ACK for the bits that are set."""
    return F.concat_ws(",", *(F.when(flags.bitwiseAND(1 << i) > 0, name) for i, name in enumerate(FLAGS)))


def has(flags: Column, *names: str) -> Column:
    bits = sum(1 << FLAGS.index(n) for n in names)
    return flags.bitwiseAND(bits) == bits


def hex_of(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n), 2 * size, "0")


def tcp_frame(source: Column, destination: Column, sport: Column, dport: Column, seq: Column, ack: Column, flags: Column, payload: Column, vlan: Column | None = None, window: Column | None = None) -> Column:
    """An Ethernet frame with IPv4 and TCP heads (checksums 0) and the payload's bytes; addresses are numbers."""
    size = F.octet_length(payload)
    eth = F.concat(F.lit("020000000002020000000001"), F.when(vlan.isNull(), F.lit("0800")).otherwise(F.concat(F.lit("8100"), hex_of(vlan, 2), F.lit("0800"))) if vlan is not None else F.lit("0800"))
    ip = F.concat(F.lit("4500"), hex_of(size + 40, 2), F.lit("0001"), F.lit("4000"), F.lit("4006"), F.lit("0000"), hex_of(source, 4), hex_of(destination, 4))
    tcp = F.concat(hex_of(sport, 2), hex_of(dport, 2), hex_of(seq, 4), hex_of(ack, 4), F.lit("50"), hex_of(flags, 1), hex_of(window, 2) if window is not None else F.lit("2000"), F.lit("0000"), F.lit("0000"))
    return F.unhex(F.concat(eth, ip, tcp, F.hex(payload)))


def udp_frame(source: Column, destination: Column, sport: Column, dport: Column, payload: Column) -> Column:
    """An Ethernet frame with IPv4 and UDP heads (checksums 0) and the payload, which is text in hex; addresses are numbers."""
    size = (F.length(payload) / 2).cast("int")
    ip = F.concat(F.lit("4500"), hex_of(size + 28, 2), F.lit("0001"), F.lit("0000"), F.lit("4011"), F.lit("0000"), hex_of(source, 4), hex_of(destination, 4))
    return F.unhex(F.concat(F.lit("0200000000020200000000010800"), ip, hex_of(sport, 2), hex_of(dport, 2), hex_of(size + 8, 2), F.lit("0000"), payload))


def dns_payload(ident: Column, response: Column, rcode: Column, *labels: Column) -> Column:
    """A DNS message with one question, as text in hex."""
    name = [x for l in labels for x in (hex_of(F.octet_length(l), 1), F.hex(l.cast("binary")))]
    return F.concat(hex_of(ident, 2), hex_of(F.when(response, 0x8180).otherwise(0x0100) + rcode, 2), F.lit("0001000000000000"), *name, F.lit("0000010001"))


def dns_answer_payload(ident: Column, labels: list[Column], alias: Column, address: Column) -> Column:
    """An answer with one question, the alias of its name (a label before the name's own last one) and the alias's address, as text in hex; names are pointers where they can be."""
    name = [x for l in labels for x in (hex_of(F.octet_length(l), 1), F.hex(l.cast("binary")))]
    last = F.lit(12) + sum((F.octet_length(l) + 1 for l in labels[:-1]), F.lit(0))  # where the last label stands
    behind = F.lit(12) + sum((F.octet_length(l) + 1 for l in labels), F.lit(0)) + 1 + 4
    target = F.concat(hex_of(F.octet_length(alias), 1), F.hex(alias.cast("binary")), hex_of(F.lit(0xC000) + last, 2))
    cname = F.concat(F.lit("c00c0005000100000e10"), hex_of(F.octet_length(alias) + 3, 2), target)
    host = F.concat(hex_of(F.lit(0xC000) + behind + 12, 2), F.lit("0001000100000e100004"), hex_of(address, 4))
    return F.concat(hex_of(ident, 2), F.lit("81800001000200000000"), *name, F.lit("0000010001"), cname, host)


def dhcp_payload(kind: Column, xid: Column, client: Column, server: Column, lease: Column) -> Column:
    """A DHCP message, as text in hex: its type, and the server and the lease where they are not null. The client is a number of 48 bits."""
    option = lambda code, value, size: F.coalesce(F.concat(F.lit(f"{code:02x}{size:02x}"), hex_of(value, size)), F.lit(""))
    head = F.concat(F.lit("01010600"), hex_of(xid, 4), F.lit("00" * 20), hex_of(client, 6), F.lit("00" * 202), F.lit("63825363"))
    return F.concat(head, option(53, kind, 1), F.lit("00"), option(54, server, 4), option(51, lease, 4), F.lit("ff"))


def ipv6_frame(source: Column, destination: Column, sport: Column, dport: Column, flags: Column, mss: Column) -> Column:
    """A TCP segment in IPv6 behind two VLAN tags and a hop-by-hop header, with options; addresses are text in hex."""
    options = F.concat(F.lit("0204"), hex_of(mss, 2), F.lit("01030307"))
    tcp = F.concat(hex_of(sport, 2), hex_of(dport, 2), F.lit("0000000100000000"), F.lit("70"), hex_of(flags, 1), F.lit("200000000000"), options)
    return F.unhex(F.concat(F.lit("020000000002020000000001"), F.lit("88a8000a"), F.lit("81000014"), F.lit("86dd"), F.lit("60000000"), F.lit("0024"), F.lit("0040"), source, destination, F.lit("0600000000000000"), tcp))
