"""Values of events shown by display hints, which are read once and joined to the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hints
from ..sources.views import table
from .registry import query

INTEGER_HINTS = ("d", "d-2", "x", "o", "b")
OCTET_HINTS = ("1x:", "1d.1d.1d.1d/2d", "255a", "*1d.;1d")


@query(
    "hint_integers",
    """WITH v AS (SELECT event_id AS id, event_id * 7 - 3000 AS v, abs(event_id * 7 - 3000) AS a, CASE WHEN event_id * 7 < 3000 THEN '-' ELSE '' END AS s FROM events)
    SELECT id, v AS value, CASE id % 5 WHEN 0 THEN v::VARCHAR WHEN 1 THEN s || (a // 100) || '.' || lpad((a % 100)::VARCHAR, 2, '0') WHEN 2 THEN s || lower(to_base(a, 16)) WHEN 3 THEN s || to_base(a, 8) ELSE s || to_base(a, 2) END AS shown FROM v""",
)
def hint_integers(spark, sf_dir):
    """Integers of both signs in decimal, with two places, and in three other bases."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 7 - 3000).alias("value"))
    hint = F.element_at(F.array(*map(F.lit, INTEGER_HINTS)), (F.col("id") % 5 + 1).cast("int"))
    return e.select("id", "value", hints.integer(F.col("value"), hint).alias("shown"))


@query(
    "hint_octets",
    """WITH v AS (SELECT event_id AS id, event_id // 65536 % 256 AS a, event_id // 256 % 256 AS b, event_id % 256 AS c FROM events)
    SELECT id, CASE id % 4 WHEN 0 THEN rtrim(regexp_replace(lpad(lower(to_base(id, 16)), 12, '0'), '(..)', '\\1:', 'g'), ':') WHEN 1 THEN '10.' || a || '.' || b || '.' || c || '/' || (id % 65536)
      WHEN 2 THEN 'port ' || id ELSE a || '.' || b || ';' || c END AS shown FROM v""",
)
def hint_octets(spark, sf_dir):
    """Hardware addresses, addresses with ports, texts with a NUL at the end, and a counted list with what follows it."""
    kinds = spark.createDataFrame(list(enumerate(OCTET_HINTS)), "kind long, hint string").select("kind", hints.steps(F.col("hint")).alias("steps"))
    i = F.col("event_id")
    wide = lambda n, digits: F.lpad(F.hex(n), digits, F.lit("0"))
    low = wide(i % (1 << 24), 6)
    raw = F.when(i % 4 == 0, wide(i, 12)).when(i % 4 == 1, F.concat(F.lit("0A"), low, wide(i % 65536, 4))).when(i % 4 == 2, F.concat(F.hex(F.concat(F.lit("port "), i.cast("string"))), F.lit("00"))).otherwise(F.concat(F.lit("02"), low))
    e = table(spark, sf_dir, "events").select(i.alias("id"), (i % 4).alias("kind"), F.unhex(raw).alias("value"))
    return e.join(F.broadcast(kinds), "kind").select("id", hints.octets(F.col("value"), F.col("steps")).alias("shown"))  # four hints


@query(
    "hint_bits",
    """WITH v AS (SELECT event_id AS id, event_id % 256 AS c FROM events), s AS (SELECT id, c, list_filter(range(8), lambda n: (c >> (7 - n)) & 1 = 1) AS l FROM v)
    SELECT id, CASE WHEN c = 0 THEN '00' ELSE list_aggregate(list_transform(l, lambda n: CASE n WHEN 0 THEN 'up' WHEN 3 THEN 'down' ELSE 'b' END || '(' || n || ')'), 'string_agg', ' ') END AS shown FROM s""",
)
def hint_bits(spark, sf_dir):
    """A byte of bits, two of them with labels."""
    labels = F.create_map(F.lit(0), F.lit("up"), F.lit(3), F.lit("down"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), hints.bits(F.unhex(F.lpad(F.hex(F.col("event_id") % 256), 2, F.lit("0"))), labels).alias("shown"))
