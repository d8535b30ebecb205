"""Filter leaves over decoded frames, two-valued like those over logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packets import flag_label
from .predicates import compare, field_value_is, sure

#: Protocol numbers by name.
PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "icmp6": 58, "eigrp": 88, "ospf": 89, "pim": 103, "vrrp": 112, "sctp": 132}


def either(leaf, side: str) -> Column:
    """leaf of the source, the destination, or one of both."""
    return {"source": leaf("source"), "destination": leaf("destination")}.get(side, leaf("source") | leaf("destination"))


def address(wanted: str, side: str = "either") -> Column:
    """An address, a subnet, or a glob."""
    return either(lambda c: sure(field_value_is(F.col(c), wanted)), side)


def port(op: str, number: int, side: str = "either") -> Column:
    return either(lambda c: compare({"source": "sport", "destination": "dport"}[c], op, number), side)


def protocol(name: str) -> Column:
    """A protocol by name: of IP, its version, or ARP."""
    if name == "arp":
        return sure(F.col("ether_type") == 0x0806)
    if name in ("ip", "ipv4", "ipv6"):
        version = F.when(F.col("ether_type") == 0x86DD, "ipv6").when(F.col("ether_type") == 0x0800, "ipv4")
        return sure(F.col("proto").isNotNull()) & (F.lit(True) if name == "ip" else sure(version == name))
    return sure(F.col("proto") == PROTOCOLS[name])


def vlan(op: str, number: int) -> Column:
    return compare("vlan", op, number)


def mac(part: str) -> Column:
    """A part of one of both hardware addresses, in any case."""
    return either(lambda c: sure(F.col({"source": "src_mac", "destination": "dst_mac"}[c]).contains(part.lower())), "either")


def flags(label: str) -> Column:
    """Flags by name, next to each other as they are listed: SYN or SYN,ACK."""
    return sure(flag_label(F.col("flags")).contains(label.upper()))


def host(part: str) -> Column:
    """A part of the name that a DNS message asks for."""
    return sure(F.lower("dns_name").contains(part.lower()))
