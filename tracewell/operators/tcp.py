"""What TCP segments tell about loss: a verdict for each segment, from what both sides had sent before it.

Everything that a verdict asks for is a running value of one side (its highest sequence number, its last acknowledgement, window and time) or of the other, so a verdict is an
expression over exclusive scans of a conversation (``scans.before``); no row is folded in Python. Conversations of more than ``MOST`` segments are cut by time, all
others share one shuffle and one sort. Sequence numbers
are unwrapped to 64 bits first: each step of a side is the signed 32-bit difference to its number before.

Whether a late segment's bytes had been seen is a join of late segments, which are few, with segments that cover their first byte, by
pieces of 65,536 bytes.

An acknowledgement counts as one of unseen data where it lies beyond everything that was captured or acknowledged of the other side; a hole within the captured range is not looked for there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packets import has
from ..sources.stored import stored
from .scans import before

# Fixed values of the rules, times in microseconds.
LEAST_DATA, LEAST_LOST, LOST_SHARE, BAD_SHARE, SLOW_HANDSHAKE, SLOW_ANSWER = 20, 3, 0.02, 0.05, 300_000, 3_000_000
# Fixed values, in microseconds: a resend this soon after the other side's last segment can answer its duplicate acknowledgements; a late segment counts as out of order
# below the initial round trip, or this where none is known.
FAST, REORDERED = 20_000, 3_000
#: Segments of a conversation that one task takes, microseconds of a slice, bytes of a piece of sequence space.
MOST, SLICE, PIECE = 2_000_000, 60_000_000, 1 << 16
KEYS = ["a", "b", "conversation"]


def signed(difference: Column) -> Column:
    """A difference of 32-bit sequence numbers as a number from -2**31 to 2**31 - 1."""
    return F.pmod(difference + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def sided(df: DataFrame, **values: tuple[str, Column]) -> DataFrame:
    """df with own_<name> and peer_<name>: running values of the segment's own side and of the other one, before it."""
    kinds = {f"_{side}_{n}": (kind, F.when(F.col("forward") == F.lit(side == "f"), v)) for n, (kind, v) in values.items() for side in ("f", "b")}
    out = before(df, KEYS, "_slice" if "_slice" in df.columns else None, ["t", "id"], **kinds)
    mine = lambda n, same: F.when(F.col("forward") == F.lit(same), F.col(f"_f_{n}")).otherwise(F.col(f"_b_{n}"))
    return out.select(*df.columns, *(mine(n, True).alias(f"own_{n}") for n in values), *(mine(n, False).alias(f"peer_{n}") for n in values))


def unwrapped(df: DataFrame) -> DataFrame:
    """df with u and end (the segment's numbers in 64 bits, after the payload and SYN or FIN) and acked (its acknowledgement, in the other side's numbers)."""
    d = sided(df, raw=("last", F.col("seq")))
    step = F.when(F.col("own_raw").isNull(), F.col("seq")).otherwise(signed(F.col("seq") - F.col("own_raw")))
    d = d.withColumn("_step", step).withColumnRenamed("peer_raw", "_peer_raw").drop("own_raw")
    d = sided(d, u=("sum", F.col("_step")))
    u = F.col("own_u") + F.col("_step")
    # The other side's sum before is the number of its last segment.
    acked = F.when(F.col("_peer_raw").isNull(), F.col("ack")).otherwise(F.col("peer_u") + signed(F.col("ack") - F.col("_peer_raw")))
    numbered = F.when(has(F.col("flags"), "SYN") | has(F.col("flags"), "FIN"), 1).otherwise(0)
    return d.withColumn("u", u).withColumn("end", u + F.col("payload_length") + numbered).withColumn("acked", F.when(has(F.col("flags"), "ACK"), acked)).drop("own_u", "peer_u", "_step", "_peer_raw")


def seen_before(late: DataFrame, sent: DataFrame) -> DataFrame:
    """The keys and ids of late segments whose bytes are in one segment captured before and not acknowledged since (late: with peer_acked_most)."""
    pieces = sent.where("end > u").select(*KEYS, "forward", F.col("t").alias("_t"), F.col("id").alias("_id"), F.col("u").alias("_u"), F.col("end").alias("_end"))
    pieces = pieces.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_u") / PIECE), F.floor((F.col("_end") - 1) / PIECE))))
    asked = late.select(*KEYS, "forward", "t", "id", "u", "end", "peer_acked_most", F.floor(F.col("u") / PIECE).alias("_piece"))
    met = asked.join(pieces, [*KEYS, "forward", "_piece"])
    acked = F.coalesce(F.col("peer_acked_most"), F.col("_u"))
    cover = (F.struct("_t", "_id") < F.struct("t", "id")) & (F.greatest(F.col("_u"), acked) <= F.col("u")) & (F.col("_end") >= F.col("end")) & (F.col("_end") > acked)
    return met.where(cover).select(*KEYS, "id").distinct()


def parted(segments: DataFrame, most: int, judge) -> DataFrame:
    """judge of the segments of usual conversations, and of those with more than most segments, which get the column _slice."""
    hot = segments.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*KEYS)
    if hot.isEmpty():
        return judge(segments)
    sliced = segments.withColumn("_slice", F.floor(F.col("t") / SLICE))
    return judge(segments.join(hot, KEYS, "left_anti")).unionByName(judge(sliced.join(hot, KEYS, "left_semi")))


def verdicts(segments: DataFrame, most: int = MOST) -> DataFrame:
    """Segments of conversations (a, b, conversation, forward, id, t, seq, ack, flags, window, payload_length, sack_blocks) with verdict, or null for nothing of note, and zero_window.

    A verdict is one of: zero-window probe, keep-alive, keep-alive ACK, probe ACK, window update, duplicate ACK, spurious retransmission, fast retransmission, out of order, retransmission,
    unseen segment acknowledged, segment before not captured."""
    return parted(segments, most, judged)


def judged(segments: DataFrame) -> DataFrame:
    f, n = F.col("flags"), F.col("payload_length")
    numbered = has(f, "SYN") | has(f, "FIN")
    special = numbered | has(f, "RST")
    plain = ~special
    sacked = F.coalesce(F.col("sack_blocks"), F.lit(0)) > 0
    d = unwrapped(segments)
    d = sided(d, window=("last", F.col("window")), t=("last", F.col("t")), acked=("last", F.col("acked")), acked_most=("max", F.col("acked")), sacked=("last", sacked), syn=("last", F.when(has(f, "SYN") & ~has(f, "ACK"), F.col("t"))))

    # A byte sent into a closed window does not count as sent before the other side takes it.
    into_closed = (n == 1) & (F.col("peer_window") == 0) & ~numbered
    d = sided(d, sent=("max", F.when(~into_closed, F.col("end"))), sent_all=("max", F.col("end")))
    d = d.withColumn("_next", F.greatest("own_sent", F.when(F.col("own_sent_all").isNotNull(), F.least("own_sent_all", "peer_acked_most"))))
    at_next = F.col("u") == F.col("_next")
    d = d.withColumn("_probe", F.coalesce((n == 1) & at_next & (F.col("peer_window") == 0), F.lit(False)))
    d = d.withColumn("_keep", F.coalesce(~F.col("_probe") & plain & (n <= 1) & (F.col("u") == F.col("_next") - 1), F.lit(False)))
    answered = F.greatest("own_syn", "peer_syn")
    trip = F.when(has(f, "ACK") & ~has(f, "SYN") & (F.col("t") > answered), F.col("t") - answered)
    further = F.col("_next").isNull() | (F.col("end") > F.col("_next") + F.when(numbered, 1).otherwise(0))
    d = sided(d.withColumn("_trip", trip), keep=("last", F.col("_keep")), probe=("last", F.col("_probe")), grew=("last", F.when(further, n)), trip=("first", F.when(F.col("_trip").isNotNull(), F.struct("t", "_trip"))))

    quiet = plain & ~F.col("_probe") & (n == 0) & at_next
    same_window, open_ = F.col("window") == F.col("own_window"), F.col("window") != 0
    same_ack = F.col("acked").eqNullSafe(F.col("own_acked"))
    keep_ack = quiet & same_window & open_ & same_ack & F.coalesce("peer_keep", F.lit(False))
    probe_ack = quiet & same_window & ~open_ & (same_ack | (F.col("acked") == F.col("own_acked") + 1)) & F.coalesce("peer_probe", F.lit(False))
    update = quiet & ~same_window & open_ & same_ack
    twice = (quiet & same_window & open_ & same_ack & ~keep_ack) | (update & sacked)
    d = d.select("*", *(F.coalesce(c, F.lit(False)).alias(name) for name, c in (("_keep_ack", keep_ack), ("_probe_ack", probe_ack), ("_update", update & ~sacked), ("_twice", twice), ("_moved", ~same_ack))))
    # Duplicate acknowledgements in a row: those in all, less those before the acknowledgement last moved.
    d = sided(d, twice=("sum", F.col("_twice").cast("long")))
    d = sided(d.withColumnRenamed("peer_twice", "_peer_twice"), since=("last", F.when(F.col("_moved"), F.col("own_twice"))))
    in_row = F.col("_peer_twice") - F.coalesce("peer_since", F.lit(0))

    carries = (n > 0) | numbered
    stop = F.col("u") + n
    spurious = (n > 0) & (stop <= F.col("peer_acked"))
    late = (F.col("u") < F.col("_next")) & ~((n > 1) & (F.col("u") == F.col("_next") - 1))
    soon = F.col("t") - F.col("peer_t")
    fast = (soon < FAST) & (in_row >= 2) & ((F.col("peer_acked") == F.col("u")) | F.coalesce("peer_sacked", F.lit(False)))
    first_trip = F.array_min(F.filter(F.array("own_trip", "peer_trip"), lambda x: x.isNotNull()))["_trip"]
    no = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumn("_sort", F.when(~carries | F.col("_keep") | F.col("_probe"), None).when(no(spurious), "spurious retransmission").when(no(late) & no(fast), "fast retransmission").when(no(late), "late"))
    d = d.withColumn("_reordered", no(soon < F.coalesce(first_trip, F.lit(REORDERED))) & ((F.col("_next") != F.col("end")) | no(F.col("own_grew") == 0)))
    d = stored(d)  # read by the look-back and by what it is joined with
    late_ones = d.where("_sort = 'late' and _reordered")
    d = d.join(seen_before(late_ones, d.where(carries)).withColumn("_seen", F.lit(True)), [*KEYS, "id"], "left")

    beyond = no(F.col("acked") > F.greatest("peer_sent_all", "own_acked_most"))
    verdict = (
        F.when(F.col("_probe"), "zero-window probe")
        .when(F.col("_keep"), "keep-alive")
        .when(F.col("_keep_ack"), "keep-alive ACK")
        .when(F.col("_probe_ack"), "probe ACK")
        .when(F.col("_sort") == "late", F.when(F.col("_reordered") & F.col("_seen").isNull(), "out of order").otherwise("retransmission"))
        .when(F.col("_sort").isNotNull(), F.col("_sort"))
        .when(F.col("_twice"), "duplicate ACK")
        .when(F.col("_update"), "window update")
        .when(beyond, "unseen segment acknowledged")
        .when(no(F.col("u") > F.col("_next")) & ~has(f, "RST"), "segment before not captured")
    )
    return d.select(*(c for c in segments.columns if c != "_slice"), verdict.alias("verdict"), ((F.col("window") == 0) & ~special & ~F.col("_probe")).alias("zero_window"), "u", "end", "acked")


def waits(seen: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, conversation, turn, asked, answered, wait): each turn of a conversation, from the asking side's last new data to the first answer. seen: verdicts' rows with client_forward.

    A turn is a run of the client's data and the run of the server's that follows; resent data is not looked at. A turn without an answer has a null wait."""
    resent = F.coalesce(F.col("verdict").isin("retransmission", "fast retransmission", "spurious retransmission", "out of order", "keep-alive", "zero-window probe"), F.lit(False))
    data = seen.where((F.col("payload_length") > 0) & ~resent).select(*KEYS, "t", "id", (F.col("forward") == F.col("client_forward")).alias("_asks"))
    return parted(data, most, turns)


def turns(data: DataFrame) -> DataFrame:
    slice_ = "_slice" if "_slice" in data.columns else None
    d = before(data, KEYS, slice_, ["t", "id"], _was=("last", F.col("_asks")))
    begins = (F.col("_asks") & ~F.coalesce("_was", F.lit(False))).cast("long")
    d = before(d.withColumn("_begins", begins), KEYS, slice_, ["t", "id"], turn=("sum", F.col("_begins")))
    d = d.withColumn("turn", F.col("turn") + F.col("_begins")).where("turn > 0")
    g = d.groupBy(*KEYS, "turn").agg(F.max(F.when(F.col("_asks"), F.col("t"))).alias("asked"), F.min(F.when(~F.col("_asks"), F.col("t"))).alias("answered"))
    return g.withColumn("wait", F.col("answered") - F.col("asked"))


RESENT = ("retransmission", "fast retransmission", "spurious retransmission")


def with_client(seen: DataFrame) -> DataFrame:
    """seen with client_forward: the client sent the first SYN, or got the first SYN with ACK, or has the higher port."""
    f = F.col("flags")
    syn, reply, place = has(f, "SYN") & ~has(f, "ACK"), has(f, "SYN", "ACK"), F.struct("t", "id")
    of = seen.groupBy(*KEYS).agg(F.min_by("forward", F.when(syn, place)).alias("_syn"), F.min_by(~F.col("forward"), F.when(reply, place)).alias("_reply"))
    of = of.select(*KEYS, F.coalesce("_syn", "_reply", F.col("a.port") >= F.col("b.port")).alias("client_forward"))
    return seen.join(of, KEYS)


def conversation_facts(seen: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each conversation: client, server, counts by verdict, handshake, early reset, zero windows, waits. seen: verdicts' rows with client_forward; answers: waits."""
    f, from_client = F.col("flags"), F.col("forward") == F.col("client_forward")
    syn, reply, rst, fin, data = has(f, "SYN") & ~has(f, "ACK"), has(f, "SYN", "ACK"), has(f, "RST"), has(f, "FIN"), F.col("payload_length") > 0
    first = lambda when: F.min(F.when(when, F.struct("t", "id")))
    lost = F.col("verdict").isin(*RESENT)
    g = seen.groupBy(*KEYS, "client_forward").agg(
        F.count("*").alias("packets"), F.count_if(data).alias("data_segments"), F.count_if(lost).alias("resent"), F.count_if(F.col("verdict") == "spurious retransmission").alias("spurious"),
        F.count_if(F.col("verdict") == "out of order").alias("out_of_order"), F.count_if(F.col("verdict") == "duplicate ACK").alias("duplicate_acks"),
        F.count_if(F.col("zero_window") & from_client).alias("client_zero_windows"), F.count_if(F.col("zero_window") & ~from_client).alias("server_zero_windows"),
        first(reply).alias("_reply"), F.max(F.when(syn, F.col("t"))).alias("_syn"), first(fin).alias("_fin"), first(data & ~from_client).alias("_served"), first(data).alias("_data"), first(rst & ~from_client).alias("_reset"),
        F.min("t").alias("first"), F.max("t").alias("last"),
    )
    later = lambda x: F.col(x).isNull() | (F.col(x) > F.col("_reset"))
    refused = F.col("_syn").isNotNull() & later("_reply") & later("_data")
    early = F.col("_reset").isNotNull() & later("_fin") & later("_served") & ~refused
    longest = answers.groupBy(*KEYS).agg(F.max("wait").alias("longest_wait"), F.min_by("wait", "turn").alias("first_wait"))
    ends = [F.when(F.col("client_forward"), F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("client", "a", "b"), ("server", "b", "a"))]
    handshake = F.when(F.col("_reply.t") > F.col("_syn"), F.col("_reply.t") - F.col("_syn"))
    out = g.join(longest, KEYS, "left").withColumn("early_reset", F.coalesce(early, F.lit(False))).withColumn("handshake", handshake)
    return out.select(*KEYS, *ends, *(c for c in out.columns if c not in KEYS and not c.startswith("_") and c != "client_forward"))


def endpoint_findings(facts: DataFrame) -> DataFrame:
    """(rule, server, port, severity, count, value): what the conversations with a server's port have in common. Severity 3 is bad, 2 warns."""
    server = [F.col("server.ip").alias("server"), F.col("server.port").alias("port")]
    lost = F.col("resent") - F.col("spurious")
    long_ = F.col("data_segments") >= LEAST_DATA
    g = facts.groupBy(*server).agg(
        F.count_if("early_reset").alias("resets"), F.sum(F.when(long_, lost)).alias("lost"), F.sum(F.when(long_, F.col("packets"))).alias("packets"),
        F.count("handshake").alias("shakes"), F.count_if(F.col("handshake") > SLOW_HANDSHAKE).alias("slow_shakes"),
        F.count_if(F.col("client_zero_windows") + F.col("server_zero_windows") > 0).alias("closed"), F.count_if(F.col("longest_wait") > SLOW_ANSWER).alias("slow"), F.max("longest_wait").alias("wait"),
    )
    share = F.col("lost") / F.col("packets")
    rule = lambda when, name, severity, count, value: F.when(when, F.struct(F.lit(name).alias("rule"), severity.cast("int").alias("severity"), count.cast("long").alias("count"), value.cast("double").alias("value")))
    # The upper median is slow when the slow ones reach past the middle, so that no list of times is gathered.
    slow_median = F.col("slow_shakes") >= F.col("shakes") - F.floor(F.col("shakes") / 2)
    found = F.array_compact(
        F.array(
            rule(F.col("resets") > 0, "tcp.serverReset", F.when(F.col("resets") >= 3, 3).otherwise(2), F.col("resets"), F.col("resets")),
            rule((F.col("lost") >= LEAST_LOST) & (share >= LOST_SHARE), "tcp.retransmissions", F.when(share >= BAD_SHARE, 3).otherwise(2), F.col("lost"), share),
            rule((F.col("shakes") > 0) & slow_median, "tcp.slowHandshake", F.lit(2), F.col("slow_shakes"), F.col("shakes")),
            rule(F.col("closed") > 0, "tcp.zeroWindow", F.lit(2), F.col("closed"), F.col("closed")),
            rule(F.col("slow") > 0, "tcp.slowResponse", F.lit(2), F.col("slow"), F.col("wait")),
        )
    )
    return g.select("server", "port", F.explode(found).alias("_f")).select("_f.rule", "server", "port", "_f.severity", "_f.count", "_f.value")
