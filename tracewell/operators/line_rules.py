"""Rules on what lines report (functions.facts): rows of (id, t, host, severity, message, fact, subject, state) to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import BAD, INFO, WARN, about, finding
from .sequences import SECOND, burst, planned_before

MINUTE = 60 * SECOND


def _about(rows: DataFrame, *more, keys: tuple[str, ...] = ("host", "subject")) -> DataFrame:
    return about(rows, list(keys), *more)


def hardware(rows: DataFrame) -> DataFrame:
    """hw.psu, hw.fan, hw.temperature, hw.poe: any failure of a device's part; one whose last line is a recovery is worth a note."""
    parts = rows.where("fact = 'hardware'")
    last = F.max_by("state", F.struct("t", "id"))
    seen = parts.groupBy("host", "subject").agg(last.alias("_last"), F.min(F.when(F.col("state") == "failed", F.col("severity"))).alias("_worst"), F.max(F.when(F.col("state") == "failed", F.lower("message").contains("shut"))).alias("_shut"))
    failed = _about(parts.where("state = 'failed'")).join(seen, ["host", "subject"])
    hot = (F.col("_worst") <= 2) | F.col("_shut")
    level = F.when(F.col("_last") == "recovered", INFO).when(F.col("subject").isin("psu", "fan"), BAD).when((F.col("subject") == "temperature") & hot, BAD).otherwise(WARN)
    return finding(failed, F.concat(F.lit("hw."), "subject"), level, "hardware", F.concat("subject", F.lit(": "), F.col("count").cast("string"), F.lit(" failures")))


def spanning_tree(rows: DataFrame, window: int = 300 * SECOND, least: int = 3) -> DataFrame:
    """stp.*: a loop, a storm or a guard at any time; changes of topology or root when so many stand in a window."""
    lines = rows.where("fact = 'stp'").select("id", "t", "host", F.col("state").alias("subject"))
    often = burst(lines, ["host", "subject"], window).select("host", "subject", "most")
    told = _about(lines).join(often, ["host", "subject"])
    told = told.where(F.col("subject").isin("loop", "storm", "bpduGuard") | (F.col("most") >= least))
    level = F.when(F.col("subject").isin("loop", "storm"), BAD).otherwise(WARN)
    return finding(told, F.concat(F.lit("stp."), "subject"), level, "stp", F.concat(F.col("count").cast("string"), F.lit(" lines")))


def restarts(rows: DataFrame, lead: int = 1800 * SECOND) -> DataFrame:
    """device.restart: a device's restarts; a planned one explains those shortly after it."""
    lines = planned_before(rows.where("fact = 'restart'"), "host", F.col("state") == "planned", lead)
    told = _about(lines, F.count_if(~F.col("explained")).alias("_open"), keys=("host",))
    return finding(told, "device.restart", F.when(F.col("_open") > 0, WARN).otherwise(INFO), "device", F.concat(F.col("count").cast("string"), F.lit(" restarts, "), F.col("_open").cast("string"), F.lit(" unexplained")))


def refused_neighbours(rows: DataFrame) -> DataFrame:
    """routing.authFail: a neighbour's packets rejected, and it never came up after that."""
    lines = rows.where("fact = 'routing'")
    last_up = lines.where("state = 'up'").groupBy("host", "subject").agg(F.max("t").alias("_up"))
    refused = lines.where("state = 'authFail'")
    last = refused.groupBy("host", "subject").agg(F.max("t").alias("_refused"))
    still = last.join(last_up, ["host", "subject"], "left").where("_up is null or _up <= _refused").select("host", "subject")
    return finding(_about(refused.join(still, ["host", "subject"])), "routing.authFail", BAD, "routing", F.concat("subject", F.lit(": "), F.col("count").cast("string"), F.lit(" rejected")))


def never_up(rows: DataFrame, least: int = 3, span: int = 120 * SECOND) -> DataFrame:
    """routing.notUp: a neighbour that makes steps for some time and is never up or down."""
    lines = rows.where("fact = 'routing'")
    reached = lines.where("state in ('up', 'down')").select("host", "subject").distinct()
    steps = _about(lines.where("state = 'step'").join(reached, ["host", "subject"], "left_anti"))
    return finding(steps.where((F.col("count") >= least) & (F.col("last") - F.col("first") >= span)), "routing.notUp", BAD, "routing", F.concat("subject", F.lit(": "), F.col("count").cast("string"), F.lit(" steps")))


def neighbours(rows: DataFrame) -> DataFrame:
    """routing.neighbor: outages of a neighbour (a down whose predecessor is not down); still down is bad, two or more warn."""
    lines = rows.where("fact = 'routing' and state in ('up', 'down')")
    w = Window.partitionBy("host", "subject").orderBy("t", "id")
    starts = lines.withColumn("_before", F.lag("state").over(w)).where("state = 'down' and coalesce(_before, 'up') = 'up'")
    still = lines.groupBy("host", "subject").agg((F.max_by("state", F.struct("t", "id")) == "down").alias("_still"))
    told = _about(starts).join(still, ["host", "subject"]).where("_still or count >= 2")
    return finding(told, "routing.neighbor", F.when(F.col("_still"), BAD).otherwise(WARN), "routing", F.concat("subject", F.lit(": "), F.col("count").cast("string"), F.lit(" outages")))


def links(rows: DataFrame, window: int = 600 * SECOND, least: int = 3) -> DataFrame:
    """link.flap: so many downs of one port in a window."""
    downs = rows.where("fact = 'link' and state = 'down'")
    often = burst(downs, ["host", "subject"], window).where(F.col("most") >= least).select("host", "subject", "most")
    return finding(_about(downs.join(often, ["host", "subject"]), F.max("most").alias("_most")), "link.flap", BAD, "link", F.concat("subject", F.lit(": "), F.col("_most").cast("string"), F.lit(" downs in a window")))


def logins(rows: DataFrame, window: int = 300 * SECOND, many: int = 5) -> DataFrame:
    """login.failures: an address's failures on a device; a burst there or across devices is bad, two or more are worth a note."""
    failed = rows.where("fact = 'login' and state = 'failed' and subject <> ''")
    here = burst(failed, ["host", "subject"], window).select("host", "subject", F.col("most").alias("_here"))
    anywhere = burst(failed, "subject", window).select("subject", F.col("most").alias("_any"))
    told = _about(failed).join(here, ["host", "subject"]).join(anywhere, "subject")
    bad = (F.col("_here") >= many) | (F.col("_any") >= many)
    return finding(told.where(bad | (F.col("count") >= 2)), "login.failures", F.when(bad, BAD).otherwise(INFO), "login", F.concat("subject", F.lit(": "), F.col("count").cast("string"), F.lit(" failures")))


def changes(rows: DataFrame, gap: int = MINUTE) -> DataFrame:
    """config.change: a device's changes; lines close to each other are one."""
    w = Window.partitionBy("host").orderBy("t", "id")
    lines = rows.where("fact = 'config'").withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1))
    told = _about(lines, F.sum("_new").alias("_changes"), keys=("host",))
    return finding(told, "config.change", INFO, "config", F.concat(F.col("_changes").cast("string"), F.lit(" changes")))


LINE_RULES = {
    "hw": hardware, "stp": spanning_tree, "restart": restarts, "routing_auth": refused_neighbours, "routing_not_up": never_up, "routing_neighbor": neighbours, "link_flap": links, "login": logins, "config": changes,
}
