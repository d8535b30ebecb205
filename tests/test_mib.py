"""Modules of several spellings linked: imports by way of others, rings, missing modules, repeated and malformed definitions."""

from tracewell.operators import mib

A = '''A-MIB DEFINITIONS ::= BEGIN
IMPORTS
  enterprises FROM RFC1155-SMI -- { not 1 }
  DisplayString, Count FROM TC-MIB
  shared FROM B-MIB;
acme MODULE-IDENTITY
  LAST-UPDATED "0" DESCRIPTION "x OBJECT IDENTIFIER ::= { y 1 }"
  ::= { enterprises 42 }
table OBJECT-TYPE SYNTAX SEQUENCE OF Entry MAX-ACCESS not-accessible STATUS current DESCRIPTION "" ::= { acme 1 }
name OBJECT-TYPE SYNTAX DisplayString (SIZE (0..9)) MAX-ACCESS read-only STATUS current DESCRIPTION "d" ::= { table entry(1) 2 }
count OBJECT-TYPE SYNTAX Count ACCESS read-only STATUS mandatory ::= { name 3 }
raw OBJECT-TYPE SYNTAX OCTET  STRING ACCESS read-only STATUS mandatory ::= {name 4}
gone OBJECT IDENTIFIER ::= { nowhere 1 }
under OBJECT IDENTIFIER ::= { shared 7 }
plain OBJECT IDENTIFIER ::= { 1 3 6 9 }
loop1 OBJECT IDENTIFIER ::= { loop2 1 }
loop2 OBJECT IDENTIFIER ::= { loop3 1 }
loop3 OBJECT IDENTIFIER ::= { loop1 1 }
tail OBJECT IDENTIFIER ::= { loop1 5 }
twice OBJECT IDENTIFIER ::= { acme 8 }
twice OBJECT IDENTIFIER ::= { acme 9 }
down NOTIFICATION-TYPE OBJECTS { name } STATUS current ::= { acme 0 6 }
END'''
SMI = "RFC1155-SMI DEFINITIONS ::= BEGIN\ninternet OBJECT IDENTIFIER ::= { iso org(3) dod(6) 1 }\nenterprises OBJECT IDENTIFIER ::= { internet private(4) 1 }\nEND"
B = "B-MIB DEFINITIONS ::= BEGIN IMPORTS shared FROM C-MIB; END"
C = "C-MIB DEFINITIONS ::= BEGIN IMPORTS enterprises FROM RFC1155-SMI; shared OBJECT IDENTIFIER ::= { enterprises 5 } END"
TC = '''TC-MIB DEFINITIONS ::= BEGIN
DisplayString ::= TEXTUAL-CONVENTION DISPLAY-HINT "255a" STATUS current DESCRIPTION "SYNTAX no" SYNTAX OCTET STRING (SIZE (0..255))
Half ::= TEXTUAL-CONVENTION DISPLAY-HINT "d-1" STATUS current DESCRIPTION "" SYNTAX Integer32
Count ::= TEXTUAL-CONVENTION STATUS current DESCRIPTION "" SYNTAX Half
END'''


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "module string, text string")


def test_linked(spark):
    df = frame(spark, ("A-MIB", A), ("RFC1155-SMI", SMI), ("B-MIB", B), ("C-MIB", C), ("TC-MIB", TC), (None, A), ("EMPTY", ""), ("NULL", None))
    got = {(r["module"], r["name"]): r["oid"] for r in mib.object_ids(df).collect()}
    root = "1.3.6.1.4.1.42"
    assert got == {
        ("A-MIB", "acme"): root, ("A-MIB", "table"): f"{root}.1", ("A-MIB", "name"): f"{root}.1.1.2", ("A-MIB", "count"): f"{root}.1.1.2.3", ("A-MIB", "raw"): f"{root}.1.1.2.4", ("A-MIB", "gone"): None,
        ("A-MIB", "under"): "1.3.6.1.4.1.5.7", ("A-MIB", "plain"): "1.3.6.9", ("A-MIB", "loop1"): None, ("A-MIB", "loop2"): None, ("A-MIB", "loop3"): None, ("A-MIB", "tail"): None, ("A-MIB", "twice"): f"{root}.9",
        ("A-MIB", "down"): f"{root}.0.6", ("RFC1155-SMI", "internet"): "1.3.6.1", ("RFC1155-SMI", "enterprises"): "1.3.6.1.4.1", ("C-MIB", "shared"): "1.3.6.1.4.1.5",
    }
    shown = {r["name"]: (r["base"], r["hint"]) for r in mib.syntaxes(df).where("module = 'A-MIB'").collect()}
    assert shown["name"] == ("OCTET STRING", "255a") and shown["count"] == ("Integer32", "d-1") and shown["raw"] == ("OCTET STRING", None) and shown["table"] == (None, None)


def test_without_modules(spark):
    none = frame(spark, ("X", "x")).limit(0)
    assert mib.object_ids(none).count() == 0 and mib.syntaxes(none).count() == 0
