"""Raw lines of many systems, made from the events, through the one line parser, the classifiers and the rules on them.

Each kind of line says what it must be parsed to, so that the SQL needs no parser: it names the values that the line was made from. Some kinds are malformed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import functions as F

from ..functions.facts import with_facts
from ..functions.lines import parsed
from ..operators import line_rules
from ..sources.stored import stored
from ..sources.views import LOG_SQL, log
from .registry import query

DAY = 86_400_000_000


class Kind(NamedTuple):
    """A kind of line: header, program and message, and what they are parsed to. {n}, {host} and {address} stand for a row's values."""

    header: str
    program: str
    message: str
    vendor: str = "generic"
    severity: int | None = None
    fields: int = 0
    fact: str | None = None
    subject: str | None = None
    state: str | None = None


KINDS = [
    Kind("iso", "%LINK-3-UPDOWN", "Interface GigabitEthernet1/0/{n}, changed state to down", fact="link", subject="GigabitEthernet1/0/{n}", state="down"),
    Kind("bsd", "%LINK-3-UPDOWN", "Interface GigabitEthernet1/0/{n}, changed state to up", fact="link", subject="GigabitEthernet1/0/{n}", state="up"),
    Kind("version", "envd", "power supply 1 failed", fields=2, fact="hardware", subject="psu", state="failed"),
    Kind("epoch", "envd", "Fan 2 fault on unit 1", fact="hardware", subject="fan", state="failed"),
    Kind("iso", "envd", "Fan speed adjusted to high"),
    Kind("bsd", "envd", "temperature sensor 2 is normal, warning threshold 70C", fact="hardware", subject="temperature", state="recovered"),
    Kind("iso", "stpd", "BPDU guard disabled port 1/1/{n}", fact="stp", subject="1/1/{n}", state="bpduGuard"),
    Kind("version", "stpd", "topology change received on interface 1/{n}", fields=2, fact="stp", subject="1/{n}", state="topologyChange"),
    Kind("bsd", "ospfd", "OSPF neighbor {address} changed from FULL to DOWN", fact="routing", subject="OSPF {address}", state="down"),
    Kind("iso", "bgpd", "BGP neighbor {address} old state OpenConfirm new state Established", fact="routing", subject="BGP {address}", state="up"),
    Kind("node", "ospfd", "OSPF packet from {address}: authentication failed, key mismatch", fields=1, fact="routing", subject="OSPF {address}", state="authFail"),
    Kind("bsd", "init", "System restarted by user admin", fact="restart", subject="warm", state="planned"),
    Kind("iso", "snmpd", "Cold start", fact="restart", subject="cold", state="unplanned"),
    Kind("iso", "sudo", "systemctl restart nginx"),
    Kind("iso", "sshd", "Failed password for admin from {address} port 22 ssh2", fact="login", subject="{address}", state="failed"),
    Kind("year", "sshd", "Accepted password for admin from {address} port 22 ssh2", fact="login", subject="{address}", state="accepted"),
    Kind("counter", "%SYS-5-CONFIG_I", "Configured from console by user admin", fields=2, fact="config", subject="admin", state="changed"),
    Kind("bare", "", 'date=2024-01-05 devname=FG1 devid=FGT60 logid=0100 type=event level=warning action=login status=failed srcip={address} user=admin msg="bad password"', "fortios", 4, 11, "login", "{address}", "failed"),
    Kind("iso", "envd", "Event|1201|LOG_WARN|AMM|1/1|fan tray 2 removed", "aos-cx", 4, 3, "hardware", "fan", "failed"),
    Kind("iso", "vrpd", "%%01IFNET/4/LINK_STATE(l)[12]:The line protocol on the interface GE1/0/{n} has entered the DOWN state.", "vrp", 4, 2, "link", "GE1/0/{n}", "down"),
    Kind("none", "", "plain words {n} without a header"),
    Kind("wrong", "", "<999>bad priority {n}"),
    Kind("iso", "CheckPoint", '[action:"drop"; src:"{address}"; severity:"High"; product:"VPN; \\"1\\""]', "check-point", 3, 4),
    Kind("iso", "stm", "<501102> <WARN> |stm| Disassoc from sta {address}: client gone", "aos-8", 4, 2),
    Kind("epoch", "ospfd", "OSPF neighbor {address} changed from Init to 2Way", fact="routing", subject="OSPF {address}", state="step"),
    Kind("bsd", "portd", "putting Gi1/0/{n} in err-disable state", fact="link", subject="Gi1/0/{n}", state="down"),
    Kind("bare", "", 'date=2024-01-05 devname=FG1 devid=FGT60 logid=0100 type=event level=notice logdesc="Interface status changed" action=interface-stat-change status=DOWN interface=port{n}', "fortios", 5, 10, "link", "port{n}", "down"),
    Kind("bare", "", 'date=2024-01-05 devname=FG1 devid=FGT60 logid=0101 type=event level=warning logdesc="Link monitor status" interface=wan{n} msg="Link Monitor changed state from dead to alive"', "fortios", 4, 9, "link", "wan{n}", "up"),
    Kind("bare", "", '1,2024/01/05 10:00:00,0001,SYSTEM,general,0,2024/01/05 10:00:00,,link-change,ethernet1/{n},0,0,general,informational,"Port ethernet1/{n}: Down 1Gb/s-full duplex",1,0x0', "pan-os", 6, 5, "link", "ethernet1/{n}", "down"),
    Kind("iso", "zebra", "interface eth{n} index 2 changed <UP,BROADCAST,RUNNING,MULTICAST>.", fact="link", subject="eth{n}", state="up"),
    Kind("bsd", "ospfd", "OSPF neighbor {address} changed from FULL/DR to DOWN", fact="routing", subject="OSPF {address}", state="down"),
    Kind("iso", "ospfd", "OSPF neighbor fe80::1:{n} changed from Init to 2-Way", fact="routing", subject="OSPF fe80::1:{n}", state="step"),
    Kind("iso", "%TCP-6-BADAUTH", "Invalid MD5 digest from {address}(179) to 10.0.0.1(11003)", fact="routing", subject="BGP {address}", state="authFail"),
    Kind("iso", "bgpd", "received NOTIFICATION from neighbor {address} 6/4 (Administrative Reset)", fact="routing", subject="BGP {address}", state="down"),
    Kind("iso", "linkDown", "SNMPv2c trap 1.3.6.1.6.3.1.1.5.3 ifIndex.{n}={n} ifName.{n}=ge-0/0/{n} ifAdminStatus.{n}=1 ifOperStatus.{n}=2", fields=4, fact="link", subject="ge-0/0/{n}", state="down"),
    Kind("iso", "ospfNbrStateChange", "SNMPv2c trap 1.3.6.1.2.1.14.16.2.2 1.3.6.1.2.1.14.10.1.6.{address}.0=8", fact="routing", subject="OSPF {address}", state="up"),
    Kind("iso", "bgpBackwardTransition", "SNMPv2c trap 1.3.6.1.2.1.15.7.2 1.3.6.1.2.1.15.3.1.7.{address}=6", fact="routing", subject="BGP {address}", state="down"),
]
#: A header's parts: whether a line has a priority, a time of whole seconds or microseconds, a host, a process.
TIMED, HOSTED = {"iso", "bsd", "version", "year", "counter", "node"}, {"iso", "bsd", "version", "year", "counter", "epoch"}


def _pieces(template: str) -> list[str]:
    out = [""]
    for part in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        out.append(part)
    return [p for p in out if p]


def _text(template: str) -> str:
    """The Spark expression of a template."""
    known = {"{n}": "cast(id % 48 as string)", "{host}": "host", "{address}": "address"}
    return "concat('', " + ", ".join(known.get(p) or "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in _pieces(template) or [""]) + ")"


def _sql(template: str | None) -> str:
    known = {"{n}": "(id % 48)", "{host}": "host", "{address}": "address"}
    return "NULL" if template is None else " || ".join(["''", *(known.get(p) or "'" + p.replace("'", "''") + "'" for p in _pieces(template))])


def _case(value) -> str:
    return "CASE id % " + str(len(KINDS)) + " " + " ".join(f"WHEN {i} THEN {value(k)}" for i, k in enumerate(KINDS)) + " END"


def raw_lines(spark, sf_dir):
    """(id, received, t, raw): a line for each event, of a kind by its id."""
    start, tag = "concat('<', cast(facility * 8 + severity as string), '>')", "coalesce(concat('[', pid, ']'), '')"
    iso, bsd, year = (f'date_format(received, "{form}")' for form in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "MMM d HH:mm:ss", "MMM d yyyy HH:mm:ss"))
    name = lambda k: "'" + k.program + "'"
    heads = {
        "iso": lambda k: [start, iso, "' '", "host", "' '", name(k), tag, "': '"],
        "bsd": lambda k: [start, bsd, "' '", "host", "' '", name(k), tag, "': '"],
        "year": lambda k: [start, year, "' '", "host", "' '", name(k), tag, "': '"],
        "version": lambda k: [start, "'1 '", iso, "' '", "host", "' '", name(k), "' '", "coalesce(pid, '-')", """' M1 [ex@1 part="a \\\\"b\\\\""] '"""],
        "epoch": lambda k: [start, "'1 '", "cast(t div 1000000 as string)", "'.'", "lpad(cast(t % 1000000 as string), 6, '0')", "' '", "host", "' '", name(k), "' '"],
        "counter": lambda k: [start, "'35: '", "host", "': 000034: *'", bsd, "': '", name(k), tag, "': '"],
        "node": lambda k: [start, "'RP/0/RSP0/CPU0:'", bsd, "': '", name(k), tag, "': '"],
        "bare": lambda k: [start],
    }
    line = lambda k: "concat(" + ", ".join([*heads.get(k.header, lambda _: [])(k), _text(k.message)]) + ")"
    return log(spark, sf_dir).select("id", "received", "t", F.expr(_case(line)).alias("raw"))


LINES_SQL = f"""{LOG_SQL}, lines AS (SELECT id, t,
  {_case(lambda k: "1" if k.header in ("none", "wrong") else "facility")}::INT AS facility,
  {_case(lambda k: k.severity if k.severity is not None else 5 if k.header in ("none", "wrong") else "severity")}::INT AS severity,
  {_case(lambda k: "t" if k.header == "epoch" else "t // 1000000 * 1000000" if k.header in TIMED else "NULL")}::BIGINT AS device_t,
  {_case(lambda k: "host" if k.header in HOSTED else "NULL")} AS host,
  {_case(lambda k: _sql(k.program) if k.program else "NULL")} AS program,
  {_case(lambda k: "pid" if k.header in TIMED else "NULL")} AS pid,
  {_case(lambda k: f"'{k.vendor}'")} AS vendor,
  {_case(lambda k: _sql(k.message))} AS message,
  {_case(lambda k: k.fields)}::INT AS n_fields,
  {_case(lambda k: f"'{k.fact}'" if k.fact else "NULL")} AS fact,
  {_case(lambda k: _sql(k.subject))} AS subject,
  {_case(lambda k: _sql(k.state))} AS state
  FROM log)"""
W = f"WITH {LINES_SQL}"


@query("line_parse", f"{W} SELECT id, facility, severity, device_t, host, program, pid, vendor, message, n_fields FROM lines")
def line_parse(spark, sf_dir):
    """Every raw line as a log row."""
    return parsed(raw_lines(spark, sf_dir)).select("id", "facility", "severity", "device_t", "host", "program", "pid", "vendor", "message", F.size("fields").alias("n_fields"))


def facts(spark, sf_dir):
    return with_facts(parsed(raw_lines(spark, sf_dir))).withColumn("host", F.coalesce("host", F.lit("")))


@query("line_facts", f"{W} SELECT id, fact, subject, state FROM lines")
def line_facts(spark, sf_dir):
    """What each line reports."""
    return facts(spark, sf_dir).select("id", "fact", "subject", "state")


@query("line_fields", f"{W} SELECT id, CASE WHEN id % {len(KINDS)} = {next(i for i, k in enumerate(KINDS) if k.vendor == 'fortios')} THEN 'admin' END AS user_name, CASE WHEN n_fields = 2 AND id % {len(KINDS)} IN (2, 7) THEN 'a \"b\"' END AS part, CASE WHEN vendor = 'check-point' THEN 'VPN; \"1\"' END AS product FROM lines")
def line_fields(spark, sf_dir):
    """Single fields of the lines that have them, escapes undone."""
    from ..functions.syslog import value_of

    rows = parsed(raw_lines(spark, sf_dir))
    return rows.select("id", value_of(F.col("fields"), "user").alias("user_name"), value_of(F.col("fields"), "sd.ex@1.part").alias("part"), value_of(F.col("fields"), "product").alias("product"))


# ---- rules ------------------------------------------------------------------------------------------------------

ABOUT = "min(t) AS first, max(t) AS last, count(*) AS count, list_sort(list(id))[1:50] AS evidence"
RULES_SQL = f"""{LINES_SQL}, f AS (SELECT id, t, coalesce(host, '') AS host, severity, message, fact, subject, state FROM lines),
hw AS (SELECT host, subject, last(state ORDER BY t, id) AS last_state, min(CASE WHEN state = 'failed' THEN severity END) AS worst FROM f WHERE fact = 'hardware' GROUP BY 1, 2),
st AS (SELECT id, t, host, state AS subject, count(*) OVER (PARTITION BY host, state ORDER BY t RANGE BETWEEN {300 * DAY // 86400} PRECEDING AND CURRENT ROW) AS n FROM f WHERE fact = 'stp'),
re AS (SELECT *, state = 'planned' OR coalesce(t - max(CASE WHEN state = 'planned' THEN t END) OVER (PARTITION BY host ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1800000000, false) AS explained FROM f WHERE fact = 'restart'),
ro AS (SELECT * FROM f WHERE fact = 'routing'),
af AS (SELECT host, subject FROM ro GROUP BY 1, 2 HAVING count(*) FILTER (state = 'authFail') > 0 AND coalesce(max(t) FILTER (state = 'up') <= max(t) FILTER (state = 'authFail'), true)),
ud AS (SELECT *, lag(state) OVER (PARTITION BY host, subject ORDER BY t, id) AS before FROM ro WHERE state IN ('up', 'down')),
us AS (SELECT host, subject, last(state ORDER BY t, id) = 'down' AS still FROM ud GROUP BY 1, 2),
lk AS (SELECT *, count(*) OVER (PARTITION BY host, subject ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS n FROM f WHERE fact = 'link' AND state = 'down'),
lo AS (SELECT *, count(*) OVER (PARTITION BY host, subject ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY subject ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS m FROM f WHERE fact = 'login' AND state = 'failed'),
la AS (SELECT subject, max(m) AS across FROM lo GROUP BY 1),
cf AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY host ORDER BY t, id) <= 60000000 THEN 0 ELSE 1 END AS new FROM f WHERE fact = 'config')"""
RULE_SQL = {
    "hw": f"SELECT 'hw.' || subject AS rule, CASE WHEN max(last_state) = 'recovered' THEN 1 WHEN subject IN ('psu', 'fan') THEN 3 WHEN subject = 'temperature' AND max(worst) <= 2 THEN 3 ELSE 2 END AS severity, 'hardware' AS category, host AS device, subject || ': ' || count(*) || ' failures' AS title, {ABOUT} FROM f JOIN hw USING (host, subject) WHERE fact = 'hardware' AND state = 'failed' GROUP BY host, subject",
    "stp": f"SELECT 'stp.' || subject AS rule, CASE WHEN subject IN ('loop', 'storm') THEN 3 ELSE 2 END AS severity, 'stp' AS category, host AS device, count(*) || ' lines' AS title, {ABOUT} FROM st GROUP BY host, subject HAVING subject IN ('loop', 'storm', 'bpduGuard') OR max(n) >= 3",
    "restart": f"SELECT 'device.restart' AS rule, CASE WHEN bool_or(NOT explained) THEN 2 ELSE 1 END AS severity, 'device' AS category, host AS device, count(*) || ' restarts, ' || count(*) FILTER (NOT explained) || ' unexplained' AS title, {ABOUT} FROM re GROUP BY host",
    "routing_auth": f"SELECT 'routing.authFail' AS rule, 3 AS severity, 'routing' AS category, host AS device, subject || ': ' || count(*) || ' rejected' AS title, {ABOUT} FROM ro JOIN af USING (host, subject) WHERE state = 'authFail' GROUP BY host, subject",
    "routing_not_up": f"SELECT 'routing.notUp' AS rule, 3 AS severity, 'routing' AS category, host AS device, subject || ': ' || count(*) || ' steps' AS title, {ABOUT} FROM ro WHERE state = 'step' AND NOT EXISTS (SELECT 1 FROM ud WHERE ud.host = ro.host AND ud.subject = ro.subject) GROUP BY host, subject HAVING count(*) >= 2 AND max(t) - min(t) >= 120000000",
    "routing_neighbor": f"SELECT 'routing.neighbor' AS rule, CASE WHEN bool_or(still) THEN 3 ELSE 2 END AS severity, 'routing' AS category, host AS device, subject || ': ' || count(*) || ' outages' AS title, {ABOUT} FROM ud JOIN us USING (host, subject) WHERE state = 'down' AND coalesce(before, 'up') = 'up' GROUP BY host, subject HAVING bool_or(still) OR count(*) >= 2",
    "link_flap": f"SELECT 'link.flap' AS rule, 3 AS severity, 'link' AS category, host AS device, subject || ': ' || max(n) || ' downs in a window' AS title, {ABOUT} FROM lk GROUP BY host, subject HAVING max(n) >= 2",
    "login": f"SELECT 'login.failures' AS rule, CASE WHEN max(n) >= 2 OR max(across) >= 2 THEN 3 ELSE 1 END AS severity, 'login' AS category, host AS device, subject || ': ' || count(*) || ' failures' AS title, {ABOUT} FROM lo JOIN la USING (subject) GROUP BY host, subject HAVING max(n) >= 2 OR max(across) >= 2 OR count(*) >= 2",
    "config": f"SELECT 'config.change' AS rule, 1 AS severity, 'config' AS category, host AS device, sum(new)::BIGINT || ' changes' AS title, {ABOUT} FROM cf GROUP BY host",
}
#: The events are far apart: windows of days and fewer lines than a device's log has.
LOOSER = {"routing_not_up": {"least": 2}, "link_flap": {"window": 5 * DAY, "least": 2}, "login": {"window": 5 * DAY, "many": 2}}

for _name, _rule in line_rules.LINE_RULES.items():

    def _one(spark, sf_dir, name=_name, rule=_rule):
        rows = stored(facts(spark, sf_dir).select("id", "t", "host", "severity", "message", "fact", "subject", "state"))  # parsed once
        return rule(rows, **LOOSER.get(name, {}))

    query("line_rule_" + _name, f"WITH {RULES_SQL} {RULE_SQL[_name]}")(_one)
