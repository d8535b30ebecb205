"""Findings: what rules report, in one form, with evidence, order, counts by category and causes.

A rule is a function of the log (or flows) that returns finding rows; ``RULES`` holds them by id, and analyse unites them.
Severity is 3 for bad, 2 for warn, 1 for info.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_words
from .correlate import within
from .sequences import SECOND, burst, last_state, outage_starts

BAD, WARN, INFO = 3, 2, 1
DAY, HOUR = 86_400 * SECOND, 3600 * SECOND
COLUMNS = ("rule", "severity", "category", "device", "title", "first", "last", "count", "evidence")
RULES: dict[str, Callable[..., DataFrame]] = {}
CATEGORIES = ("link", "login", "routing", "config", "syslog", "capacity", "tcp")


def rule(name: str):
    def add(f):
        RULES[name] = f
        return f

    return add


def finding(df: DataFrame, rule: Column | str, severity: Column | int, category: str, title: Column, device: str = "host") -> DataFrame:
    """Rows of (device, first, last, count, evidence) as findings."""
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select((rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), level.cast("int").alias("severity"), F.lit(category).alias("category"), F.col(device).alias("device"), title.alias("title"), "first", "last", F.col("count").cast("bigint").alias("count"), "evidence")


def about(rows: DataFrame, keys: list[str], *more: Column, most: int = 50) -> DataFrame:
    """(keys, first, last, count, more..., evidence) of each group; its evidence is the least so many ids.

    Ids are ranked, which tasks do for their own rows before anything is shuffled, and only those that count are gathered."""
    sums = rows.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("count"), *more)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    few = rows.select(*keys, "id").withColumn("_place", place).where(F.col("_place") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("evidence"))
    return sums.join(few, keys)


@rule("link.flap")
def link_flap(log: DataFrame, window: int = 5 * DAY, least: int = 3) -> DataFrame:
    """At least so many errors of one device in any window."""
    downs = log.where("program = 'error'")
    found = burst(downs, "host", window).where(F.col("most") >= least)
    rows = about(downs.join(found.select("host", "most"), "host"), ["host", "most"])
    return finding(rows, "link.flap", BAD, "link", F.concat(F.lit("down "), F.col("most").cast("string"), F.lit(" times in a window")))


@rule("link.down")
def link_down(log: DataFrame, now: int, after: int = HOUR) -> DataFrame:
    """The last event of a device is an error, and that is long ago."""
    last = last_state(log, "host", "program").where((F.col("program") == "error") & (F.lit(now) - F.col("t") > after)).select("host")
    rows = about(log.where("program = 'error'").join(last, "host"), ["host"])
    return finding(rows, "link.down", WARN, "link", F.lit("down since its last line"))


@rule("login.failures")
def login_failures(log: DataFrame, window: int = 5 * DAY, many: int = 4) -> DataFrame:
    """Failures of one address: a burst is bad, two or more at any time are worth a note."""
    failed = log.where("program = 'error'")
    most = burst(failed, "address", window).where("events >= 2").select("address", "most")
    rows = about(failed.join(most, "address"), ["address", "most"])
    return finding(rows, "login.failures", F.when(F.col("most") >= many, BAD).otherwise(INFO), "login", F.concat(F.col("count").cast("string"), F.lit(" failures")), "address")


@rule("routing.neighbor")
def routing_neighbor(log: DataFrame) -> DataFrame:
    """Outages (a down whose predecessor is not down); still down is bad, two or more warn."""
    events = log.where("program in ('error', 'purchase')")
    starts = outage_starts(events.select("host", "t", "id", "program"), "host", F.col("program") == "purchase")
    still = last_state(events, "host", "program").select("host", (F.col("program") == "error").alias("still"))
    rows = about(starts, ["host"]).join(still, "host").where("still or count >= 2")
    return finding(rows, "routing.neighbor", F.when(F.col("still"), BAD).otherwise(WARN), "routing", F.concat(F.col("count").cast("string"), F.lit(" outages")))


@rule("config.change")
def config_change(log: DataFrame, gap: int = HOUR) -> DataFrame:
    """Changes of a device; lines close to each other are one change."""
    w = Window.partitionBy("host").orderBy("t", "id")
    lines = log.where("program = 'signup'").withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1))
    rows = about(lines, ["host"], F.sum("_new").alias("_changes"))
    return finding(rows, "config.change", INFO, "config", F.concat(F.col("_changes").cast("string"), F.lit(" changes")))


@rule("syslog.errorSpike")
def error_spike(log: DataFrame, times: float = 3.0, least_days: int = 10) -> DataFrame:
    """The busiest day of problems against the usual day."""
    problems = log.where("severity <= 4").withColumn("day", F.expr(f"t div {DAY}"))
    days = problems.groupBy("host", "day").agg(F.count("*").alias("n"))
    s = days.groupBy("host").agg(F.max("n").alias("peak"), F.max_by("day", F.struct("n", -F.col("day"))).alias("day"), F.sum("n").alias("total"), (F.max("day") - F.min("day") + 1).alias("span"))
    usual = (F.col("total") - F.col("peak")) / F.greatest(F.col("span") - 1, F.lit(1))
    s = s.where((F.col("span") >= least_days) & (F.col("peak") >= times * F.greatest(usual, F.lit(0.5)))).select("host", "day", "peak")
    rows = about(problems.join(s, ["host", "day"]), ["host", "peak"])
    return finding(rows, "syslog.errorSpike", WARN, "syslog", F.concat(F.col("peak").cast("string"), F.lit(" problems in a day")))


@rule("capacity.logRate")
def log_rate(log: DataFrame, least: int = 4, hours: int = 2) -> DataFrame:
    """Hours with many lines of one group of devices."""
    keyed = log.withColumn("part", F.concat(F.lit("port "), F.col("port").cast("string"))).withColumn("hour", F.expr(f"t div {HOUR}"))
    busy = keyed.groupBy("part", "hour").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    many = busy.groupBy("part").agg(F.count("*").alias("hours")).where(F.col("hours") >= hours)
    rows = about(keyed.join(busy.select("part", "hour"), ["part", "hour"], "left_semi").join(many, "part"), ["part", "hours"])
    return finding(rows, "capacity.logRate", WARN, "capacity", F.concat(F.col("hours").cast("string"), F.lit(" busy hours")), "part")


def analyse(log: DataFrame, now: int, rules: list[str] | None = None) -> DataFrame:
    """The findings of all rules."""
    out = None
    for name in rules or RULES:
        found = RULES[name](log, now) if name == "link.down" else RULES[name](log)
        out = found if out is None else out.unionByName(found)
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """By first time, then the worst, then by title."""
    return findings.orderBy("first", F.desc("severity"), "title", "device", "rule")


def chips(findings: DataFrame) -> DataFrame:
    """Counts of all categories, those without findings too."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, place int")
    counted = findings.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= WARN).alias("problems"))
    return F.broadcast(names).join(counted, "category", "left").select("category", "place", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "problems")))


def with_causes(findings: DataFrame, changes: DataFrame, lead: int = HOUR) -> DataFrame:
    """findings with cause: the nearest change on the device in the time before; null without one."""
    keyed = findings.withColumn("id", F.xxhash64("rule", "device", "first")).withColumn("t", F.col("first"))
    near = within(keyed.select("id", "device", "t"), changes.select(F.col("host").alias("device"), F.col("t").alias("other_t"), F.col("id").alias("cause")), ["device"], lead, 0)
    best = near.groupBy("id").agg(F.max(F.struct("other_t", "cause")).alias("m"))
    return keyed.join(best, "id", "left").withColumn("cause", F.col("m.cause")).drop("id", "t", "m")


def liveness(findings: DataFrame, kept_ids: DataFrame) -> DataFrame:
    """Per finding, how many of its evidence ids are still held."""
    each = findings.select("rule", "device", "first", F.explode("evidence").alias("id"))
    held = each.join(kept_ids.select("id", F.lit(1).alias("_held")), "id", "left")
    return held.groupBy("rule", "device", "first").agg(F.count("_held").alias("present"), F.count("*").alias("total"))


def report_lines(findings: DataFrame) -> DataFrame:
    """Markdown lines, one for each severity and category, with the first devices named."""
    g = findings.groupBy("severity", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("device")).alias("devices"))
    label = F.when(F.col("severity") == BAD, "bad").when(F.col("severity") == WARN, "warn").otherwise("info")
    return g.select("severity", "category", F.concat(F.lit("- **"), label, F.lit("** "), "category", F.lit(": "), F.col("n").cast("string"), F.lit(" on "), list_words(F.col("devices"))).alias("line"))
