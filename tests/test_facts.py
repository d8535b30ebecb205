"""Lines of several systems and what they report, malformed and misleading ones too."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions.facts import lexicon, tags_of, with_facts

#: program, message, fields, vendor, severity -> fact, subject, state
LINES = [
    ("", "Interface Gi0/1, changed state to administratively down", {}, "generic", 5, None),
    ("lldpd", "LLDP neighbor on link down", {}, "generic", 5, None),
    ("", "Interface ethernet 1/1/5, state down", {}, "generic", 5, ("link", "ethernet 1/1/5", "down")),
    ("", "port 3 status changed from 1Gfdx to down", {}, "generic", 5, ("link", "3", "down")),
    ("", "port 3 status changed from down to 1Gfdx", {}, "generic", 5, ("link", "3", "up")),
    ("", "port 7 err-disable recovery, re-enabled", {}, "generic", 5, None),
    ("", "msg", {"logdesc": "Interface status changed", "status": "UP", "intf": "port2"}, "fortios", 5, ("link", "port2", "up")),
    ("", "msg", {"logdesc": "Interface status changed", "status": "testing", "intf": "port2"}, "fortios", 5, None),
    ("", "msg", {"logdesc": "Link monitor status", "name": "wan1", "msg": "Link Monitor changed state from alive to die"}, "fortios", 5, ("link", "wan1", "down")),
    ("", "x", {"eventid": "link-change", "description": "Port ae1: Up 10Gb/s"}, "pan-os", 6, ("link", "ae1", "up")),
    ("", "x", {"eventid": "ha2-link-change", "description": "HA2 link down"}, "pan-os", 6, ("link", "HA2", "down")),
    ("", "x", {"eventid": "link-change", "description": "Port : strange"}, "pan-os", 6, None),
    ("mib2d", "ifIndex 526", {"msgid": "SNMP_TRAP_LINK_DOWN", "sd.junos.interface-name": "ge-0/0/1", "sd.junos.admin-status": "up(1)"}, "generic", 4, ("link", "ge-0/0/1", "down")),
    ("mib2d", "ifIndex 526", {"msgid": "SNMP_TRAP_LINK_DOWN", "sd.junos.interface-name": "ge-0/0/1", "sd.junos.admin-status": "down(2)"}, "generic", 4, None),
    ("zebra", "interface eth0 index 2 changed <UP,BROADCAST,MULTICAST>.", {}, "generic", 6, ("link", "eth0", "down")),
    ("zebra", "interface docker0 index 3 changed <UP,BROADCAST>.", {}, "generic", 6, None),
    ("zebra", "interface lo index 1 changed <UP,LOOPBACK,RUNNING>.", {}, "generic", 6, None),
    ("zebra", "interface eth1 index 4 changed <BROADCAST,MULTICAST>.", {}, "generic", 6, None),
    ("ipmon", "2: eth3: <NO-CARRIER,BROADCAST,UP> mtu 1500", {}, "generic", 6, ("link", "eth3", "down")),
    ("envd", "Power supply 2 is ok", {}, "generic", 6, ("hardware", "psu", "recovered")),
    ("envd", "Power supply 2 status polled", {}, "generic", 6, None),
    ("envd", "PSU 1 input noisy", {}, "generic", 3, ("hardware", "psu", "failed")),
    ("envd", "fan speed increased, fan 2 stopped", {}, "generic", 4, ("hardware", "fan", "failed")),
    ("envd", "fantasy football is down", {}, "generic", 4, None),
    ("envd", "temperature 45C, critical threshold 90C", {}, "generic", 6, None),
    ("stpd", "storm-control detected on interface Gi0/3", {}, "generic", 4, ("stp", "Gi0/3", "storm")),
    ("", "loop-protect: loop detected on port 12", {}, "generic", 4, ("stp", "12", "loop")),
    ("ospfd", "SPF: topology change computed", {}, "generic", 6, None),
    ("bgpd", "neighbor 2001:db8::2 Down Peer closed", {}, "generic", 5, ("routing", "BGP 2001:db8::2", "down")),
    ("ospfd", "nbr 10.0.0.9 (eth1) Full/DR -> Down", {}, "generic", 5, ("routing", "OSPF 10.0.0.9", "down")),
    ("rpd", "OSPF neighbor 10.0.0.1 state changed from Full to Full", {}, "generic", 5, ("routing", "OSPF 10.0.0.1", "step")),
    ("ospfd", "interface eth1: auth-type mismatch, local MD5, rcvd Null, Router-ID 10.255.0.2", {}, "generic", 4, ("routing", "OSPF 10.255.0.2", "authFail")),
    ("kernel", "MD5 Hash mismatch for (10.0.0.2, 646)->(10.0.0.1, 40312)", {}, "generic", 4, ("routing", "LDP 10.0.0.2", "authFail")),
    ("upgrade", "MD5 checksum mismatch of image from 10.0.0.2", {}, "generic", 4, None),
    ("linkUp", "SNMPv2c trap", {"ifIndex.4": "4"}, "generic", 5, ("link", "ifIndex 4", "up")),
    ("warmStart", "SNMPv2c trap", {}, "generic", 5, ("restart", "warm", "planned")),
    ("ospfNbrStateChange", "SNMPv2c trap 1.3.6.1.2.1.14.16.2.2 1.3.6.1.2.1.14.10.1.6.10.0.0.7.0=1", {}, "generic", 5, ("routing", "OSPF 10.0.0.7", "down")),
    ("ospfIfAuthFailure", "SNMPv2c trap 1.3.6.1.2.1.14.16.2.6 1.3.6.1.2.1.14.16.1.4.0=10.0.0.8", {}, "generic", 5, ("routing", "OSPF 10.0.0.8", "authFail")),
    ("bgpEstablished", "SNMPv2c trap without values", {}, "generic", 5, None),
    ("sshd", "process restart requested", {}, "generic", 5, None),
    ("sshd", "802.1X authentication failed for user bob", {}, "generic", 5, None),
    ("sshd", "Failed password for root", {}, "generic", 5, ("login", "", "failed")),
    ("mgmt", "configuration change failed", {}, "generic", 5, None),
    ("mgmt", "commit complete by alice", {}, "generic", 5, ("config", "alice", "changed")),
    (None, "", {}, "generic", 5, None),
    (None, None, {}, "generic", None, None),
]


def test_lines(spark):
    rows = [(i, p, m, [(k, v) for k, v in f.items()], v, s) for i, (p, m, f, v, s, _) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "id int, program string, message string, fields array<struct<key:string,value:string>>, vendor string, severity int")
    got = {r["id"]: (r["fact"], r["subject"], r["state"]) if r["fact"] else None for r in with_facts(df).collect()}
    wrong = {LINES[i][1]: (g, LINES[i][5]) for i, g in got.items() if g != LINES[i][5]}
    assert not wrong


@pytest.mark.parametrize("text, wanted", [("fan tray 1", {"fan"}), ("the fantasy", set()), ("err-disabled", {"disabled", "guarded"}), ("psu", {"psu"}), ("xpsu1", set()), ("", set())])
def test_tags(spark, text, wanted):
    got = set(spark.range(1).select(tags_of(F.lit(text)).alias("t")).first()["t"])
    assert got == wanted or wanted <= got and text == "err-disabled"


def test_words_keep_the_tags_of_those_they_begin_with():
    _, tags = lexicon()
    assert {"temperature", "failed"} <= set(tags["overheat"]) and {"stp", "storm"} & set(tags["storm-control"]) == {"storm"}
    assert "restart" in tags["restarted"] and "restart_word" in tags["restarted"]


def test_fields_of_very_long_lines(spark):
    from tracewell.functions.lines import parsed

    say = lambda n: "<13>Jan  5 10:00:00 h app: date=1 devname=F devid=FGT logid=1 type=t " + " ".join(f"k{i}=v{i}" for i in range(n))
    rows = spark.createDataFrame([(n, say(n)) for n in (995, 996, 1200)], "n int, raw string").withColumn("received", F.expr("timestamp'2024-01-05 10:00:00'"))
    got = {r["n"]: r["fields"] for r in parsed(rows).collect()}
    assert [len(got[n]) for n in (995, 996, 1200)] == [1000, 1000, 1000]
    assert tuple(got[995][-1]) == ("k994", "v994") and tuple(got[996][-1]) == ("truncated_fields", "2 more not kept") and tuple(got[1200][998]) == ("k993", "v993")
