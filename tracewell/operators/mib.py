"""MIB modules as text, linked: every name's object id, over imports, and what textual conventions hand on.

Definitions and imports are read from the modules' texts by patterns. Each is an edge: a definition leads to its parent with the numbers between them, an import leads to the same name in another
module with none. Edges are followed by doubling: in each round every name takes over the end that its own end has reached, with the numbers in front, so that a chain of a thousand takes ten
joins. A name that ends at a root has its object id; one whose chain ends elsewhere, or runs in a ring, has none. Conventions are followed in the same way, and the first display hint
on the way counts.

All names are dealt by module and name; nothing is gathered in one task. Of definitions that repeat a name within a module the last in its text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

# The roots of object ids, the macros that define a name, and the types that a syntax ends at.
ROOTS = {"ccitt": "0", "iso": "1", "joint-iso-ccitt": "2"}
MACROS = ("OBJECT IDENTIFIER", "OBJECT-TYPE", "MODULE-IDENTITY", "OBJECT-IDENTITY", "NOTIFICATION-TYPE", "OBJECT-GROUP", "NOTIFICATION-GROUP", "MODULE-COMPLIANCE", "AGENT-CAPABILITIES")
BASES = ("INTEGER", "Integer32", "OCTET STRING", "OBJECT IDENTIFIER", "BITS", "Counter32", "Counter64", "Gauge32", "Unsigned32", "TimeTicks", "IpAddress", "Opaque")
#: Names of a chain at most: 2 ** ROUNDS.
ROUNDS = 10

NAME = r"[A-Za-z][A-Za-z0-9-]*"
SYNTAX = rf"SYNTAX\s+((?:OCTET\s+STRING|OBJECT\s+IDENTIFIER|SEQUENCE\s+OF\s+{NAME}|{NAME}))"
DEFINED = rf"(?s)(?<![A-Za-z0-9-])({NAME})\s+({'|'.join(m.replace(' ', chr(92) + 's+') for m in MACROS)})\b((?:(?!::=).)*?)::=\s*\{{\s*([^{{}}]*?)\s*\}}"
CONVENTION = rf"(?s)(?<![A-Za-z0-9-])({NAME})\s*::=\s*TEXTUAL-CONVENTION\b((?:(?!::=).)*?)" + SYNTAX
IMPORTED = rf"(?s)((?:{NAME}\s*,\s*)*{NAME})\s+FROM\s+({NAME})"


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """Rows of a pattern's groups, with their place in the text."""
    return F.posexplode(F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups)))


def _said(modules: DataFrame) -> DataFrame:
    """(module, text, bare): without comments and descriptions, and without any quoted text as well."""
    text = F.regexp_replace(F.regexp_replace("text", r"--[^\n]*", " "), r'\b(?:DESCRIPTION|REFERENCE|ORGANIZATION|CONTACT-INFO)\s+"[^"]*"', " ")
    return modules.where("module is not null and text is not null").select("module", text.alias("text"), F.regexp_replace(text, r'"[^"]*"', " ").alias("bare"))


def definitions(modules: DataFrame) -> DataFrame:
    """(module, name, kind, parent, numbers, syntax): modules are rows of (module, text)."""
    rows = _said(modules).select("module", _all(F.col("bare"), DEFINED, 1, 2, 3, 4).alias("at", "d"))
    tokens = F.filter(F.split(F.col("d.g4"), r"\s+(?![^(]*\))"), lambda t: t != "")
    first = F.get(tokens, F.lit(0))
    number = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"\(\s*(\d+)\s*\)", 1), F.lit("")), F.when(t.rlike(r"^\d+$"), t))
    rest = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), number)
    # {1 3 6} begins with a number: its parent is the root of that number.
    known = F.element_at(F.create_map(*(F.lit(x) for n, i in ROOTS.items() for x in (i, n))), first)
    out = rows.select("module", F.col("d.g1").alias("name"), F.regexp_replace(F.col("d.g2"), r"\s+", " ").alias("kind"), F.coalesce(known, F.regexp_extract(first, rf"^({NAME})", 1)).alias("parent"), rest.alias("numbers"), F.regexp_replace(F.nullif(F.regexp_extract(F.col("d.g3"), SYNTAX, 1), F.lit("")), r"\s+", " ").alias("syntax"), "at")
    last = Window.partitionBy("module", "name").orderBy(F.desc("at"))
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "at")


def imports(modules: DataFrame) -> DataFrame:
    """(module, name, source): each name that a module imports."""
    part = F.regexp_extract("bare", r"(?s)\bIMPORTS\b(.*?);", 1)
    rows = _said(modules).select("module", part.alias("part")).select("module", _all(F.col("part"), IMPORTED, 1, 2).alias("at", "i"))
    return rows.select("module", F.explode(F.split(F.col("i.g1"), r"\s*,\s*")).alias("name"), F.col("i.g2").alias("source")).distinct()


def conventions(modules: DataFrame) -> DataFrame:
    """(module, name, syntax, hint): each textual convention, what it refines and how its values are shown."""
    rows = _said(modules).select("module", _all(F.col("text"), CONVENTION, 1, 2, 3).alias("at", "c"))
    hint = F.nullif(F.regexp_extract(F.col("c.g2"), r'DISPLAY-HINT\s+"([^"]*)"', 1), F.lit(""))
    return rows.select("module", F.col("c.g1").alias("name"), F.regexp_replace(F.col("c.g3"), r"\s+", " ").alias("syntax"), hint.alias("hint")).dropDuplicates(["module", "name"])


def followed(edges: DataFrame, join) -> DataFrame:
    """edges (module, name, to_module, to_name, carried) with each end moved on as far as edges lead; join(own, next) adds what the rest of the way carries. Ends without an edge stay."""
    edges = stored(edges)
    for _ in range(ROUNDS):
        onward = edges.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("to_module").alias("_module"), F.col("to_name").alias("_name"), F.col("carried").alias("_carried"))
        moved = edges.join(onward, ["to_module", "to_name"], "left")
        on = F.col("_name").isNotNull()
        moved = moved.select("module", "name", F.when(on, F.col("_module")).otherwise(F.col("to_module")).alias("to_module"), F.when(on, F.col("_name")).otherwise(F.col("to_name")).alias("to_name"), F.when(on, join(F.col("carried"), F.col("_carried"))).otherwise(F.col("carried")).alias("carried"), on.alias("_on"))
        moved = stored(moved)
        edges = moved.drop("_on").where("not (module = to_module and name = to_name)")  # back where it began: a ring
        if moved.where("_on").isEmpty():
            break
        # In longer rings the numbers grow with every round: a way of more names than a chain may have is none.
        edges = edges.where(F.size("carried") <= 1 << ROUNDS) if dict(edges.dtypes)["carried"].startswith("array") else edges
    return edges


def object_ids(modules: DataFrame) -> DataFrame:
    """(module, name, kind, syntax, oid): each definition, with its object id if its chain ends at a root."""
    defined, imported = definitions(modules), imports(modules)
    nothing = F.array().cast("array<string>")
    known = defined.select("module", "name").withColumn("_here", F.lit(True))
    sources = imported.withColumnRenamed("source", "_source")
    # A parent is of the same module, or imported by it, or a root (whose module has no name).
    parents = defined.where(F.col("parent") != "").select("module", "name", "parent", "numbers")
    here = parents.join(known.withColumnRenamed("name", "parent"), ["module", "parent"], "left").join(sources.withColumnRenamed("name", "parent"), ["module", "parent"], "left")
    is_root = F.col("_here").isNull() & F.col("_source").isNull() & F.col("parent").isin(*ROOTS)
    target = F.when(is_root, "").when(F.col("_here"), F.col("module")).otherwise(F.coalesce("_source", F.lit("?")))
    steps = here.select("module", "name", target.alias("to_module"), F.col("parent").alias("to_name"), F.col("numbers").alias("carried"))
    # An imported name leads on only if the module does not define it itself.
    aliases = sources.join(known, ["module", "name"], "left_anti").select("module", "name", F.col("_source").alias("to_module"), F.col("name").alias("to_name"), nothing.alias("carried"))
    ends = followed(steps.unionByName(aliases), lambda own, onward: F.concat(onward, own)).where("to_module = ''")
    root = F.element_at(F.create_map(*(F.lit(x) for n, i in ROOTS.items() for x in (n, i))), F.col("to_name"))
    whole = ends.where(~F.exists("carried", lambda x: x.isNull())).select("module", "name", F.concat_ws(".", root, F.col("carried")).alias("oid"))
    return defined.select("module", "name", "kind", "syntax").join(whole, ["module", "name"], "left")


def syntaxes(modules: DataFrame) -> DataFrame:
    """(module, name, base, hint): each definition with a syntax, the type that it ends at, and the first display hint on the way."""
    refined, imported = conventions(modules), imports(modules)
    used = definitions(modules).where("syntax is not null").select("module", F.concat(F.lit("="), "name").alias("name"), "syntax", F.lit(None).cast("string").alias("hint"))
    rows = refined.unionByName(used)
    known = refined.select("module", F.col("name").alias("syntax")).withColumn("_here", F.lit(True))
    sources = imported.select("module", F.col("name").alias("syntax"), F.col("source").alias("_source"))
    here = rows.join(known, ["module", "syntax"], "left").join(sources, ["module", "syntax"], "left")
    target = F.when(F.col("_here"), F.col("module")).when(F.col("syntax").isin(*BASES), "").otherwise(F.coalesce("_source", F.lit("?")))
    steps = here.select("module", "name", target.alias("to_module"), F.col("syntax").alias("to_name"), F.array_compact(F.array("hint")).alias("carried"))
    aliases = imported.join(refined.select("module", "name"), ["module", "name"], "left_anti").where(~F.col("name").isin(*BASES)).select("module", "name", F.col("source").alias("to_module"), F.col("name").alias("to_name"), F.array().cast("array<string>").alias("carried"))
    ends = followed(steps.unionByName(aliases), lambda own, onward: F.slice(F.concat(own, onward), 1, 1))
    mine = ends.where(F.col("name").startswith("="))
    return mine.select("module", F.expr("substr(name, 2)").alias("name"), F.when(F.col("to_module") == "", F.col("to_name")).alias("base"), F.get("carried", F.lit(0)).alias("hint"))
