"""TCP conversations from decoded segments.

A conversation is a direction-free pair of ends. Its segments are put in order of time in one window, in which the
running largest end of each side tells new data from data said before; everything else is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packets import has

SECOND = 1_000_000


def ends(df: DataFrame) -> DataFrame:
    """df with a and b: the ends of the conversation in order, and forward: whether the segment goes from a to b."""
    one, two = F.struct(F.col("source").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("destination").alias("ip"), F.col("dport").alias("port"))
    return df.withColumn("a", F.least(one, two)).withColumn("b", F.greatest(one, two)).withColumn("forward", one == F.least(one, two))


def segments(df: DataFrame, idle: int = 60 * SECOND) -> DataFrame:
    """Segments with conversation (a number within the pair of ends) and again (data or SYN said before).

    A SYN after an end (FIN, RST) or after an idle spell, with a new sequence number, opens a new conversation."""
    w = Window.partitionBy("a", "b").orderBy("t", "id")
    syn = has(F.col("flags"), "SYN") & ~has(F.col("flags"), "ACK")
    over = has(F.col("flags"), "FIN") | has(F.col("flags"), "RST")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = ends(df).withColumn("_syn", syn)
    d = d.withColumn("_gap", F.col("t") - F.lag("t").over(w)).withColumn("_over", F.max(F.when(over, F.col("t"))).over(past))
    d = d.withColumn("_last_syn", F.last(F.when(syn, F.struct("seq", "t")), ignorenulls=True).over(past))
    fresh = F.col("_syn") & (F.col("_last_syn").isNull() | (F.col("_last_syn.seq") != F.col("seq"))) & (F.col("_gap").isNull() | (F.col("_gap") > idle) | (F.col("_over") >= F.coalesce(F.col("_last_syn.t"), F.lit(0))))
    d = d.withColumn("_new", F.when(fresh & F.col("_gap").isNotNull(), 1).otherwise(0))
    d = d.withColumn("conversation", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    way = Window.partitionBy("a", "b", "conversation", "forward").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("payload_length") + F.when(has(F.col("flags"), "SYN") | has(F.col("flags"), "FIN"), 1).otherwise(0)
    d = d.withColumn("_end", F.col("seq") + size).withColumn("_most", F.max("_end").over(way))
    again = (size > 0) & F.coalesce(F.col("_end") <= F.col("_most"), F.lit(False))
    return d.withColumn("again", again).drop("_syn", "_gap", "_over", "_last_syn", "_new", "_end", "_most")


def flows(df: DataFrame) -> DataFrame:
    """A row for each conversation: client and server, counts, handshake time, and how it went."""
    f = F.col("flags")
    syn, synack, rst = has(f, "SYN") & ~has(f, "ACK"), has(f, "SYN", "ACK"), has(f, "RST")
    here, there = F.struct(F.col("source").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("destination").alias("ip"), F.col("dport").alias("port"))
    g = segments(df).groupBy("a", "b", "conversation").agg(
        F.min_by(here, F.when(syn, F.struct("t", "id"))).alias("_by_syn"),
        F.min_by(there, F.when(synack, F.struct("t", "id"))).alias("_by_synack"),
        F.count("*").alias("packets"),
        F.sum("payload_length").alias("bytes"),
        F.count_if(F.col("payload_length") > 0).alias("data_segments"),
        F.count_if(F.col("again")).alias("lost"),
        F.count_if(syn).alias("syns"),
        F.min(F.when(synack, F.col("t"))).alias("_synack"),
        F.max(F.when(syn, F.col("t"))).alias("_syn"),
        F.min(F.when(rst, F.col("t"))).alias("_rst"),
        F.count_if(~syn & ~rst).alias("_more"),
        F.count_if((F.col("window") == 0) & ~rst).alias("zero_windows"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
    )
    # Without a handshake the end with the smaller port is the server.
    guess = F.when(F.col("a.port") < F.col("b.port"), F.col("b")).otherwise(F.col("a"))
    client = F.coalesce("_by_syn", "_by_synack", guess)
    server = F.when(client == F.col("a"), F.col("b")).otherwise(F.col("a"))
    never = (F.col("syns") > 0) & F.col("_synack").isNull() & F.col("_rst").isNull() & (F.col("_more") == 0)
    refused = (F.col("syns") > 0) & F.col("_synack").isNull() & F.col("_rst").isNotNull() & (F.col("_more") == 0)
    share = F.col("lost") / F.greatest(F.col("packets"), F.lit(1))
    reasons = F.array_compact(
        F.array(
            F.when(never, "never answered"),
            F.when(refused, "refused"),
            F.when(F.col("_rst").isNotNull() & ~refused, "reset"),
            F.when((F.col("lost") >= 3) & (share >= 0.02), "retransmissions"),
            F.when(F.col("zero_windows") > 0, "zero window"),
        )
    )
    rtt = F.when((F.col("_syn") < F.col("_synack")), F.col("_synack") - F.col("_syn"))
    return g.select(
        client.alias("client"), server.alias("server"), "conversation", "packets", "bytes", "data_segments", "lost", "syns", rtt.alias("handshake_us"),
        never.alias("never_answered"), refused.alias("refused"), F.col("_rst").isNotNull().alias("reset"), "zero_windows", "first", "last", reasons.alias("reasons"),
        F.when(never | (F.array_contains(reasons, "retransmissions")), "bad").when(F.size(reasons) > 0, "warn").otherwise("ok").alias("health"),
    )
