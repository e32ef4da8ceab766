"""What a query by a stranger may do before it runs, how risky a planned operation is, and the plan of a write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a question may be for, how it may begin, what it must not contain.
INTENTS = ("orient", "diagnose", "inventory", "trace")
BEGINS = ("SELECT", "WITH", "FROM", "VALUES")
WRITES = ("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "DROP", "ALTER", "TRUNCATE", "REPLACE", "COPY", "SET", "CALL", "LOAD", "REFRESH", "CACHE", "UNCACHE", "ANALYZE", "ADD", "MSCK", "GRANT", "REVOKE")
MOST_ROWS, MOST_HOPS = 500, 6


def bare(sql: str) -> str:
    """A statement without what stands in comments, quotes or back-ticks."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", " ", sql, flags=re.S)


def checked(sql: str, intent: str, hops: int | None = None) -> str:
    """``sql`` if it only reads, is one statement and is bounded; raises otherwise."""
    if intent.strip().lower() not in INTENTS:
        raise ValueError(f"intent must be one of {', '.join(INTENTS)}")
    plain = bare(sql).strip().rstrip(";").strip()
    if ";" in plain:
        raise ValueError("one statement only")
    words = re.findall(r"[A-Za-z_]+", plain.upper())
    if not words or words[0] not in BEGINS:
        raise ValueError("a question must begin with " + ", ".join(BEGINS))
    if found := sorted(set(words) & set(WRITES)):
        raise ValueError(f"a question must not write: {', '.join(found)}")
    limit = re.search(r"\bLIMIT\s+(\d+)\s*$", plain, re.I)
    if not limit or not 1 <= int(limit[1]) <= MOST_ROWS:
        raise ValueError(f"a question must end with LIMIT 1 to {MOST_ROWS}")
    if hops is not None and not 1 <= hops <= MOST_HOPS:
        raise ValueError(f"between 1 and {MOST_HOPS} hops only")
    return sql


def risk(operation: Column, mode: Column, effects: Column) -> Column:
    """The risk class of a planned operation; ``effects`` is a struct of booleans (network, destructive, writes, append_only) or null.

    Destructive outweighs external, that reversible, that append-only; what is not known is external.
    """
    op = F.lower(F.trim(F.coalesce(operation, F.lit(""))))
    on = lambda name: F.coalesce(effects.getField(name), F.lit(False))
    loads = op.isin("graph.load", "graph.load.sync", "graph.load.rebuild")
    destructive = on("destructive") | (loads & (F.lower(F.trim(F.coalesce(mode, F.lit("")))) == "rebuild"))
    return (
        F.when(op.isin("lint", "registry.diff", "pack"), "read_only").when(op.isin("artifact.approve", "artifact.created", "artifact.append"), "append_only")
        .when(destructive, "mutation_destructive").when(on("network") | loads, "external_side_effect")
        .when(on("writes") | op.isin("registry.build", "registry.build.in_place"), "mutation_reversible").when(on("append_only"), "append_only").otherwise("external_side_effect")
    )


def planned(tables: dict[str, DataFrame], existing: dict[str, DataFrame] | None = None, key: str = "note_id") -> DataFrame:
    """(table, rows, added, kept, removed): what a write would change, without writing."""
    from functools import reduce

    out = []
    for name, new in sorted(tables.items()):
        old = (existing or {}).get(name)
        n = new.select(key).distinct().withColumn("_new", F.lit(True))
        o = (old.select(key).distinct() if old is not None else new.select(key).limit(0)).withColumn("_old", F.lit(True))
        both = n.join(o, key, "full")
        out.append(both.agg(F.count("_new").alias("rows"), F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_new") & F.col("_old")).alias("kept"), F.count_if(F.col("_new").isNull()).alias("removed")).select(F.lit(name).alias("table"), "rows", "added", "kept", "removed"))
    return reduce(DataFrame.unionByName, out)
