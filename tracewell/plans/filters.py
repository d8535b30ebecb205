"""Boolean filters over logs, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..sources.views import LOG_SQL, log, table
from .registry import query


def _log_filter(name: str, leaf, condition: str) -> None:
    @query(name, f"WITH {LOG_SQL} SELECT id, host, severity FROM log WHERE coalesce({condition}, false)")
    def run(spark, sf_dir):
        return log(spark, sf_dir).where(leaf()).select("id", "host", "severity")


def _text_filter(name: str, leaf, condition: str) -> None:
    @query(name, f"SELECT doc_id, source FROM documents WHERE coalesce({condition}, false)")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").where(leaf()).select("doc_id", "source")


_text_filter("filter_word", lambda: p.word("text", "tion"), "contains(lower(text), 'tion')")
_text_filter("filter_phrase", lambda: p.word("text", "of the"), "contains(lower(text), 'of the')")
_text_filter("filter_not", lambda: p.word("text", "the") & ~p.word("text", "and"), "contains(lower(text), 'the') AND NOT contains(lower(text), 'and')")
_text_filter("filter_nor", lambda: p.nor(p.word("text", "que"), p.word("text", "der"), p.word("text", "oi")), "NOT contains(lower(text), 'que') AND NOT contains(lower(text), 'der') AND NOT contains(lower(text), 'oi')")
_text_filter(
    "filter_nested",
    lambda: (p.word("text", "the") & ~(p.word("text", "que") | p.word("source", "src1"))) | p.matches("text", "lic?ense"),
    "(contains(lower(text), 'the') AND NOT (contains(lower(text), 'que') OR contains(lower(source), 'src1'))) OR regexp_matches(text, 'lic?ense', 'i')",
)
_text_filter("filter_regex", lambda: p.matches("text", "th[ae]n?[a-z]+ing"), "regexp_matches(text, 'th[ae]n?[a-z]+ing', 'i')")
_text_filter("filter_whole_word", lambda: p.whole_word("text", "license"), "regexp_matches(text, '(^|[^A-Za-z0-9])license([^A-Za-z0-9./:]|[./:]([^0-9]|$)|$)', 'i')")
_text_filter("filter_whole_address", lambda: p.sure(F.col("text").rlike(r"(?<![0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])")), r"regexp_matches(text, '(^|[^0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}($|[^0-9.]|\.($|[^0-9]))')")


@query("filter_glob", "SELECT page_id, url FROM pages WHERE coalesce(lower(url) LIKE 'http%://%/%1', false)")
def filter_glob(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(p.glob("url", "http*://*/*1")).select("page_id", "url")


_log_filter("filter_severity_range", lambda: p.compare("severity", "<=", 4), "severity <= 4")
_log_filter("filter_severity_list", lambda: p.sure(F.col("severity").isin(3, 5)), "severity IN (3, 5)")
_log_filter("filter_facility", lambda: p.compare("facility", ">=", 16), "facility >= 16")
_log_filter("filter_program", lambda: p.word("program", "URCH"), "contains(lower(program), 'urch')")
_log_filter("filter_program_exact", lambda: p.sure(F.lower("program") == "error"), "lower(program) = 'error'")
_log_filter("filter_pid", lambda: p.compare("pid", "=", "42"), "pid = '42'")
_log_filter("filter_pid_not", lambda: p.compare("pid", "!=", "42"), "pid IS NULL OR pid <> '42'")
_log_filter("filter_port", lambda: p.compare("port", ">", 516), "port > 516")
_log_filter("filter_host_prefix", lambda: p.host("address", "host", "SW1"), "starts_with(lower(address), 'sw1') OR starts_with(lower(host), 'sw1')")
_log_filter("filter_host_exact", lambda: p.host("address", "host", "sw12$"), "lower(host) = 'sw12'")
_log_filter("filter_host_address", lambda: p.host("address", "host", "10.1.5.21"), "address = '10.1.5.21'")
_log_filter("filter_host_glob", lambda: p.glob("host", "sw*3"), "lower(host) LIKE 'sw%3'")
_log_filter("filter_subnet", lambda: p.in_subnet("address", "10.1.0.0/20"), "split_part(address, '.', 2) = '1' AND split_part(address, '.', 3)::INT < 16")
_log_filter("filter_address_in_line", lambda: p.whole_address("raw", "10.2.2.2"), "address = '10.2.2.2'")
_log_filter("filter_field_exists", lambda: p.field_exists("fields", "ifIndex"), "true")
_log_filter("filter_field_number", lambda: p.field("fields", "k", ">=", "90"), "k >= 90")
_log_filter("filter_field_equal", lambda: p.field("fields", "k", "=", "007"), "k = 7")
_log_filter("filter_field_not", lambda: p.field("fields", "k", "!=", "7"), "k IS NULL OR k <> 7")
_log_filter("filter_field_prefix", lambda: p.field("fields", "USER", "=", "u1"), "starts_with('u' || source, 'u1')")
_log_filter("filter_field_subnet", lambda: p.field("fields", ("src", "srcip", "source"), "=", "10.3.0.0/16"), "split_part(address, '.', 2) = '3'")
_log_filter("filter_field_instance", lambda: p.field("fields", "ifIndex", "=", "5"), "id % 48 = 5")
_log_filter("filter_number_or_text", lambda: p.number_or_text(F.col("k").cast("string"), ">", "50.5") | p.number_or_text(F.col("program"), "<", "error"), "k > 50.5 OR lower(program) < 'error'")
_log_filter("filter_unknown_field", lambda: p.field("fields", "nothing", "=", "x") | ~p.field("fields", "nothing", "!=", "x"), "false")
_log_filter("filter_mask_and_query", lambda: p.sure(F.col("severity").isin(3, 4)) & p.compare("source", "=", 7) & p.word("raw", "user=u7"), "severity IN (3, 4) AND source = 7")


@query("filter_time_overlap", f"WITH {LOG_SQL}, spans AS (SELECT source, min(t) AS first, max(t) AS last FROM log WHERE severity = 3 GROUP BY 1) SELECT source, first, last FROM spans WHERE last >= 1704412800000000 AND first <= 1704499200000000")
def filter_time_overlap(spark, sf_dir):
    spans = log(spark, sf_dir).where("severity = 3").groupBy("source").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return spans.where(p.overlaps("first", "last", 1704412800000000, 1704499200000000))


@query("filter_conversation", "SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_nationkey = 3 AND o_orderstatus = 'O') OR (c_nationkey = 7 AND o_orderstatus = 'F')")
def filter_conversation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pair = p.sure((F.col("c_nationkey") == 3) & (F.col("o_orderstatus") == "O")) | p.sure((F.col("c_nationkey") == 7) & (F.col("o_orderstatus") == "F"))
    return rows.where(pair).select("o_orderkey", "c_custkey", "c_nationkey")
