"""Merkle fixity audit of WARC replicas.

Pages become WARC response records; a file holds ``FILE_RECORDS`` of them in order of page_id, at the offsets
where their predecessors end. A record's leaf is the SHA-256 of its offset, length and bytes' digest; ``FANOUT``
neighbours in order of offset make the next node, up to one root for each file. Two replicas are compared root
by root, and only the children of mismatching nodes are looked at on the way down; the mismatching leaves
are the corrupt records. The levels of both trees are written once, each from the one below, so that the descent reads stored nodes.

A null url or html is an empty one. Repeated page_ids stay apart (ordered by url and html as well); equal rows are
interchangeable, so their order does not matter. A record present in one replica only mismatches. A page with a null
id belongs to file -1, whose records are split into files by a hash of their contents. An empty table gives
an empty audit. Extra columns are not part of a record. Very long pages are hashed as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

FILE_RECORDS, FANOUT = 4096, 16


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC/1.0 response record as text."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, seq, page_id, offset, length, digest): one row for each record. A file holds the pages of one range of ids."""
    raw = record_bytes(F.col("url"), F.col("html"))
    of = F.coalesce(F.floor(F.col("page_id") / file_records), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)))
    rows = pages.select(of.cast("long").alias("file"), "page_id", F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("seq", F.row_number().over(order) - 1).withColumn("offset", before)


def tree(leaves: DataFrame, fanout: int = FANOUT, depth: int = 3) -> list[DataFrame]:
    """The levels of each file's tree, leaves first: (replica, file, pos, hash), each stored. The last has one node a file."""
    level = leaves.select("replica", "file", F.col("seq").cast("long").alias("pos"), F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256).alias("hash"))
    out = [level]
    for _ in range(depth):
        children = F.array_sort(F.collect_list(F.struct("pos", "hash")))  # fanout of them at most
        level = level.groupBy("replica", "file", F.floor(F.col("pos") / fanout).alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256).alias("hash"))
        level = written(level.select("replica", "file", F.col("up").alias("pos"), "hash"))
        out.append(level)
    return out


def levels(file_records: int, fanout: int) -> int:
    """How many levels above the leaves bring a file of so many records to one root."""
    n, k = max(file_records, 1), 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def mismatches(nodes: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, pos): the leaves that differ between the two replicas, found from the roots down."""
    open_ = None
    for level in reversed(nodes):
        if open_ is not None:  # only the children of nodes that differ
            level = level.withColumn("up", F.floor(F.col("pos") / fanout)).join(open_.withColumnRenamed("pos", "up"), ["file", "up"], "left_semi")
        both = level.groupBy("file", "pos").agg(F.count("*").alias("n"), F.min("hash").alias("a"), F.max("hash").alias("b"))
        open_ = both.where("n < 2 or a <> b").select("file", "pos")
        if level is not nodes[0]:
            open_ = written(open_)
    return open_


def audit(first: DataFrame, second: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """Each record of the first replica's pages with intact: whether the second has it, at the same place."""
    replica = lambda pages, n: records(pages, file_records).withColumn("replica", F.lit(n))
    rows = written(replica(first, 1).unionByName(replica(second, 2)))
    most = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    depth = max(levels(file_records, fanout), levels(most, fanout))
    bad = mismatches(tree(rows, fanout, depth), fanout).withColumn("_bad", F.lit(True))
    joined = rows.where("replica = 1").join(bad.withColumnRenamed("pos", "seq"), ["file", "seq"], "left")
    return joined.select("page_id", "file", F.col("seq").cast("long").alias("seq"), "offset", "length", F.col("digest").alias("record_sha256"), F.col("_bad").isNull().alias("intact"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of pages with faults: the first character is another where page_id leaves 7 modulo 97, and a letter is turned where it leaves 11 modulo 101."""
    html = F.col("html")
    first = F.when(F.pmod("page_id", F.lit(97)) == 7, F.expr("'#' || substr(html, 2)"))
    turned = F.when(F.pmod("page_id", F.lit(101)) == 11, F.translate(html, "e", "a"))
    return pages.withColumn("html", F.coalesce(first, turned, html))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica with planted faults: a row for each record."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


OP8_SQL = f"""
WITH raw AS (
  SELECT page_id, r.v AS replica,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM (SELECT page_id, url, v, coalesce(CASE WHEN v = 1 THEN html WHEN page_id % 97 = 7 THEN '#' || substr(html, 2) WHEN page_id % 101 = 11 THEN replace(html, 'e', 'a') ELSE html END, '') AS body
        FROM pages, (VALUES (1), (2)) r(v)) r
),
rows AS (SELECT page_id, replica, page_id // {FILE_RECORDS} AS file, strlen(rec)::BIGINT AS length, sha256(rec) AS digest FROM raw),
placed AS (SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(length) OVER (PARTITION BY replica, file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
           FROM rows WINDOW w AS (PARTITION BY replica, file ORDER BY page_id, digest))
SELECT a.page_id, a.file, a.seq, a."offset", a.length, a.digest AS record_sha256,
  coalesce(a."offset" = b."offset" AND a.length = b.length AND a.digest = b.digest, false) AS intact
FROM (SELECT * FROM placed WHERE replica = 1) a LEFT JOIN (SELECT * FROM placed WHERE replica = 2) b USING (file, seq)
"""
