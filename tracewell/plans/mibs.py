"""MIB modules written from the parts, fifty names to a module, linked over imports and conventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mib
from ..sources.views import table
from .registry import query

BASE = """CONV-MIB DEFINITIONS ::= BEGIN
IMPORTS TEXTUAL-CONVENTION FROM SNMPv2-TC;
tracewell OBJECT IDENTIFIER ::= { iso org(3) dod(6) internet(1) private(4) enterprises(1) 9999 } -- the root of all parts
Tenths ::= TEXTUAL-CONVENTION DISPLAY-HINT "d-1" STATUS current DESCRIPTION "not a ::= { definition 1 }" SYNTAX Integer32
Level ::= TEXTUAL-CONVENTION STATUS current DESCRIPTION "a refinement" SYNTAX Tenths (0..100)
ring OBJECT IDENTIFIER ::= { rong 1 }
rong OBJECT IDENTIFIER ::= { ring 2 }
END"""


def modules(spark, sf_dir):
    """(module, text): part p is below part p // 10, or below the root; parents of other modules are imported, every fifth by way of the module of names."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    p = p.withColumn("parent", F.floor(F.col("p") / 10)).withColumn("m", F.floor(F.col("p") / 50)).withColumn("pm", F.floor(F.col("parent") / 50))
    name = lambda c: F.concat(F.lit("part"), c.cast("string"))
    module = lambda c: F.concat(F.lit("M"), c.cast("string"), F.lit("-MIB"))
    above = F.when(F.col("parent") == 0, F.lit("tracewell")).otherwise(name(F.col("parent")))
    syntax = F.element_at(F.array(*map(F.lit, ("INTEGER { up(1), down(2) }", "Tenths", "Level", "Counter32"))), (F.col("p") % 4 + 1).cast("int"))
    said = F.concat(name(F.col("p")), F.lit(" OBJECT-TYPE\n  SYNTAX "), syntax, F.lit('\n  MAX-ACCESS read-only\n  STATUS current\n  DESCRIPTION "of part { x 1 }"\n  ::= { '), above, F.lit(" "), (F.col("p") % 10 + 1).cast("string"), F.lit(" }\n"))
    far = (F.col("parent") > 0) & (F.col("pm") != F.col("m"))
    taken = F.when(far, F.concat(name(F.col("parent")), F.lit(" FROM "), F.when(F.col("parent") % 5 == 0, F.lit("NAMES-MIB")).otherwise(module(F.col("pm"))), F.lit("\n")))
    g = p.groupBy("m").agg(F.array_join(F.array_sort(F.collect_list(said)), "").alias("body"), F.array_join(F.array_sort(F.collect_set(taken)), "").alias("taken"))
    head = F.concat(module(F.col("m")), F.lit(" DEFINITIONS ::= BEGIN\nIMPORTS tracewell, Tenths, Level FROM CONV-MIB -- shared\n"), F.col("taken"), F.lit(";\n"))
    own = g.select(module(F.col("m")).alias("module"), F.concat(head, F.col("body"), F.lit("END\n")).alias("text"))
    # The module of names imports what others take from it: in pieces of a hundred, each a row of its text.
    passed = p.where(far & (F.col("parent") % 5 == 0)).select("parent", "pm").distinct()
    names = passed.groupBy(F.floor(F.col("parent") / 100).alias("g")).agg(F.array_join(F.collect_list(F.concat(name(F.col("parent")), F.lit(" FROM "), module(F.col("pm")), F.lit("\n"))), "").alias("taken"))
    names = names.select(F.lit("NAMES-MIB").alias("module"), F.concat(F.lit("NAMES-MIB DEFINITIONS ::= BEGIN\nIMPORTS "), F.col("taken"), F.lit(";\nEND")).alias("text"))
    return own.unionByName(names).unionByName(spark.createDataFrame([("CONV-MIB", BASE)], "module string, text string"))


@query(
    "mib_object_ids",
    """WITH RECURSIVE up AS (SELECT p_partkey AS p, p_partkey AS now, '' AS oid FROM part UNION ALL SELECT p, now // 10, '.' || (now % 10 + 1) || oid FROM up WHERE now > 0),
    linked AS (SELECT p, 'M' || (p // 50) || '-MIB' AS module, 'part' || p AS name, 'OBJECT-TYPE' AS kind, oid FROM up WHERE now = 0)
    SELECT module, name, kind, CASE WHEN p >= 10 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = p // 10) THEN NULL ELSE '1.3.6.1.4.1.9999' || CASE WHEN p = 0 THEN '.1' ELSE oid END END AS oid FROM linked
    UNION ALL SELECT 'CONV-MIB', 'tracewell', 'OBJECT IDENTIFIER', '1.3.6.1.4.1.9999' UNION ALL SELECT 'CONV-MIB', x, 'OBJECT IDENTIFIER', NULL FROM (VALUES ('ring'), ('rong')) t(x)""",
)
def mib_object_ids(spark, sf_dir):
    """Every name's object id."""
    return mib.object_ids(modules(spark, sf_dir)).select("module", "name", "kind", "oid")


@query(
    "mib_syntaxes",
    "SELECT 'M' || (p_partkey // 50) || '-MIB' AS module, 'part' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'INTEGER' WHEN 3 THEN 'Counter32' ELSE 'Integer32' END AS base, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'd-1' END AS hint FROM part",
)
def mib_syntaxes(spark, sf_dir):
    """The type that every object's syntax ends at, and the display hint that it inherits."""
    return mib.syntaxes(modules(spark, sf_dir)).select("module", "name", "base", "hint")
