"""Text, number and address forms over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses as a
from ..functions import text as x
from ..sources.views import LOG_SQL, log, table
from .registry import query

W = f"WITH {LOG_SQL}"


@query(
    "duration_words",
    """SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN s < 600 THEN s // 60 || ' min' || CASE WHEN s % 60 > 0 THEN ' ' || s % 60 || ' s' ELSE '' END WHEN s < 3600 THEN s // 60 || ' min'
WHEN s < 86400 THEN s // 3600 || ' h' || CASE WHEN s % 3600 // 60 > 0 THEN ' ' || s % 3600 // 60 || ' min' ELSE '' END ELSE s // 86400 || ' d' || CASE WHEN s % 86400 // 3600 > 0 THEN ' ' || s % 86400 // 3600 || ' h' ELSE '' END END AS words
FROM (SELECT event_id, event_id * event_id % 400000 AS s FROM events)""",
)
def duration_words(spark, sf_dir):
    s = F.col("event_id") * F.col("event_id") % 400_000
    return table(spark, sf_dir, "events").select("event_id", x.duration_words(s).alias("words"))


@query("uptime_words", "SELECT event_id, s // 86400 || 'd ' || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS uptime FROM (SELECT event_id, event_id * 12345 // 100 AS s FROM events)")
def uptime_words(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", x.uptime(F.col("event_id") * 12345).alias("uptime"))


@query(
    "byte_words",
    "SELECT doc_id, CASE WHEN n >= 1073741824 THEN n * 10 // 1073741824 // 10 || '.' || n * 10 // 1073741824 % 10 || ' GB' WHEN n >= 1048576 THEN n * 10 // 1048576 // 10 || '.' || n * 10 // 1048576 % 10 || ' MB' WHEN n >= 1024 THEN n * 10 // 1024 // 10 || '.' || n * 10 // 1024 % 10 || ' KB' ELSE n || ' B' END AS words FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)",
)
def byte_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.byte_words(F.col("n_chars") * F.col("n_chars")).alias("words"))


@query(
    "list_words",
    f"{W}, l AS (SELECT host, t // 86400000000 AS day, list_sort(list(DISTINCT program)) AS p FROM log GROUP BY 1, 2) SELECT host, day, CASE len(p) WHEN 1 THEN p[1] WHEN 2 THEN p[1] || ' and ' || p[2] WHEN 3 THEN p[1] || ', ' || p[2] || ' and ' || p[3] ELSE p[1] || ', ' || p[2] || ', ' || p[3] || ' and ' || (len(p) - 3) || ' more' END AS words FROM l",
)
def list_words(spark, sf_dir):
    """The programs of each device and day, in words."""
    rows = log(spark, sf_dir).groupBy("host", F.expr("t div 86400000000").alias("day")).agg(F.array_sort(F.collect_set("program")).alias("p"))
    return rows.select("host", "day", x.list_words(F.col("p")).alias("words"))


@query("csv_guard", "SELECT event_id, CASE WHEN left(c, 1) IN ('=', '+', '-', '@') THEN '''' || c ELSE c END AS cell FROM (SELECT event_id, ['=', '+', '-', '@', 'a', '1'][event_id % 6 + 1] || event_type AS c FROM events)")
def csv_guard(spark, sf_dir):
    first = F.element_at(F.array(*map(F.lit, "=+-@a1")), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", x.csv_guard(F.concat(first, "event_type")).alias("cell"))


@query("csv_lines", """SELECT doc_id, CASE WHEN regexp_matches(t, '[,"\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ',' || source AS line FROM (SELECT doc_id, source, text AS t FROM documents)""")
def csv_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(x.csv_quote(F.col("text")), F.lit(","), "source").alias("line"))


@query("control_escape", "SELECT doc_id, replace(replace(text, chr(10), '#012'), chr(13), '#015') AS line FROM documents")
def control_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.octal_escape(F.col("text")).alias("line"))


@query("markdown_escape", r"SELECT doc_id, regexp_replace(text, '([*_`\[\]<>|\\])', '\\\1', 'g') AS line FROM documents")
def markdown_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.markdown_escape(F.col("text")).alias("line"))


@query("excerpt", "SELECT doc_id, CASE WHEN length(trim(text)) > 90 THEN rtrim(left(trim(text), 89)) || '…' ELSE trim(text) END AS words FROM documents")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.excerpt(F.col("text")).alias("words"))


@query("token_after", r"""SELECT doc_id, nullif(rtrim(regexp_extract(text, '(?i)licensed[ =:"'']*([^ ,;()\[\]"''\r\n]+)', 1), '.:'), '') AS token FROM documents""")
def token_after(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.token_after(F.col("text"), "licensed").alias("token"))


@query("url_host", r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)', 1)) AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", a.url_host("url").alias("host"))


@query("ipv4_number", f"{W} SELECT id, split_part(address, '.', 1)::BIGINT * 16777216 + split_part(address, '.', 2)::BIGINT * 65536 + split_part(address, '.', 3)::BIGINT * 256 + split_part(address, '.', 4)::BIGINT AS number, address AS back FROM log")
def ipv4_number(spark, sf_dir):
    rows = log(spark, sf_dir).select("id", a.ipv4_number("address").alias("number"))
    return rows.withColumn("back", a.ipv4_text(F.col("number")))


@query("first_address", f"{W} SELECT id, address AS found FROM log")
def first_address(spark, sf_dir):
    return log(spark, sf_dir).select("id", a.first_ipv4("raw").alias("found"))


@query("mac_forms", "SELECT event_id, lower(substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2) || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2)) AS mac FROM (SELECT event_id, left(md5(event_id::VARCHAR), 12) AS h FROM events)")
def mac_forms(spark, sf_dir):
    """Addresses in four spellings, all brought to one."""
    h = F.substring(F.md5(F.col("event_id").cast("string")), 1, 12)
    colons = F.regexp_replace(F.regexp_replace(h, "(..)", "$1:"), ":$", "")
    spelt = F.element_at(a.mac_spellings(colons), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", a.mac(F.upper(spelt)).alias("mac"))


#: Short and full spellings, and what they are brought to.
SPELLINGS = {
    "Gi1/0/": "GigabitEthernet1/0/", "te1/": "TenGigabitEthernet1/", "eth": "eth", "et1/": "Ethernet1/", "Tw1/0/": "TwoGigabitEthernet1/0/", "fi1/0/": "FiveGigabitEthernet1/0/", "XGE0/0/": "XGigabitEthernet0/0/",
    "gigabitethernet1/0/": "GigabitEthernet1/0/", "ge": "ge", "GE0/0/": "GigabitEthernet0/0/", "PORT-CHANNEL": "PORT-CHANNEL", "po": "Port-channel", "Vl": "Vl", "mgmt/": "mgmt/",
}


@query("interface_names", f"SELECT event_id, {list(SPELLINGS.values())}[event_id % {len(SPELLINGS)} + 1] || event_id % 48 AS name FROM events")
def interface_names(spark, sf_dir):
    spelt = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("event_id") % len(SPELLINGS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", a.interface_name(F.concat(spelt, (F.col("event_id") % 48).cast("string"))).alias("name"))


@query("natural_order", f"{W} SELECT host, row_number() OVER (ORDER BY source) AS place FROM (SELECT DISTINCT host, source FROM log)")
def natural_order(spark, sf_dir):
    """Hosts in the order in which people count, sw2 before sw10, with their places.

    Places are counted in two steps, so that no task ranks all hosts: how many stand in each lot of a thousand neighbours, and the place inside a lot."""
    from pyspark.sql import Window

    key = a.natural_key("host")
    hosts = log(spark, sf_dir).select("host").distinct().select("host", key.alias("key"), F.substring(key, 1, F.greatest(F.length(key) - 3, F.lit(0))).alias("lot"))
    lots = hosts.groupBy("lot").agg(F.count("*").alias("n"))
    before = lots.select("lot", (F.sum("n").over(Window.orderBy("lot")) - F.col("n")).alias("before"))  # a row for a thousand hosts
    placed = hosts.withColumn("inside", F.row_number().over(Window.partitionBy("lot").orderBy("key")))
    return placed.join(before, "lot").select("host", (F.col("before") + F.col("inside")).alias("place"))


@query("oid_order", "SELECT event_id, [1, 3, 6, event_id % 12, event_id] AS oid, list_concat([1, 3, 6], [event_id % 12]) < [1, 3, 6, 5, 0] AS before FROM events")
def oid_order(spark, sf_dir):
    text = F.concat(F.lit("1.3.6."), (F.col("event_id") % 12).cast("string"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(a.oid(text), F.array("event_id")).alias("oid"), (a.oid(text) < a.oid(F.lit("1.3.6.5.0"))).alias("before"))


@query("severity_names", f"{W} SELECT DISTINCT severity, ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug'][severity + 1] AS name, severity <= 4 AS problem FROM log")
def severity_names(spark, sf_dir):
    from ..sources.views import SEVERITIES

    names = F.array(*map(F.lit, SEVERITIES))
    return log(spark, sf_dir).select("severity").distinct().select("severity", F.get(names, F.col("severity")).alias("name"), (F.col("severity") <= 4).alias("problem"))


@query("sequence_order", "SELECT o_orderkey, CASE WHEN a <> b THEN ((b - a) % 4294967296 + 4294967296) % 4294967296 < 2147483648 ELSE false END AS before FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS a, o_custkey * 40503 % 4294967296 AS b FROM orders)")
def sequence_order(spark, sf_dir):
    from ..operators.sequences import sequence_before

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 2654435761 % (1 << 32)).alias("a"), (F.col("o_custkey") * 40503 % (1 << 32)).alias("b"))
    return o.select("o_orderkey", sequence_before(F.col("a"), F.col("b")).alias("before"))


@query("hex_lines", "SELECT event_id, '0000  ' || rtrim(regexp_replace(lower(hex(encode(event_type || event_id))), '(..)', '\\1 ', 'g')) AS dump FROM events".replace("\\\\", "\\"))
def hex_lines(spark, sf_dir):
    data = F.concat("event_type", F.col("event_id").cast("string")).cast("binary")
    return table(spark, sf_dir, "events").select("event_id", x.hex_dump(data).alias("dump"))
