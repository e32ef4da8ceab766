"""Registry tables of concepts by layer, and whether a stored registry still says the same."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections of the registry in their order, with the layers each holds.
SECTIONS = (
    ("Primitives", ("primitive", "foundational")), ("First-order composites", ("first-order",)), ("Mechanisms", ("mechanism",)),
    ("Accounting", ("accounting",)), ("Failure states", ("failure-state",)), ("Selectors", ("selector", "meta-analytical")),
)
HEAD = ("", "| Concept | Role | Depends On |", "|---|---|---|")


def section_of(layer: Column, sections: Sequence[tuple[str, Sequence[str]]] = SECTIONS) -> tuple[Column, Column]:
    """(section, place) of a layer; an unknown one has a section of its own after all others."""
    low = F.lower(F.trim(F.coalesce(layer, F.lit("unknown"))))
    name, place = F.concat(F.lit("Unclassified ("), low, F.lit(")")), F.lit(len(sections))
    for i, (title, layers) in enumerate(sections):
        name = F.when(low.isin(*layers), F.lit(title)).otherwise(name)
        place = F.when(low.isin(*layers), F.lit(i)).otherwise(place)
    return name, place


def unknown_layers(concepts: DataFrame, sections=SECTIONS) -> DataFrame:
    """(layer, n): layers that no section holds."""
    low = F.lower(F.trim(F.coalesce("layer", F.lit("unknown"))))
    known = [x for _, layers in sections for x in layers]
    return concepts.select(low.alias("layer")).where(~F.col("layer").isin(known)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def rows(concepts: DataFrame, overrides: DataFrame | None = None, orders: Mapping[str, Sequence[str]] | None = None, sections=SECTIONS) -> DataFrame:
    """(section, section_place, place, name, line): the table rows of every section.

    ``concepts`` has (name, layer, role, deps).  ``overrides`` (name, role,
    hub_class) replaces roles and adds hub classes; ``orders`` lists names that come
    first in a section.  Others follow by name.  A concept without dependencies says
    why: ``None (primitive)``, ``None (axiomatic)`` for a foundational one, else ``None``.
    """
    title, at = section_of(F.col("layer"), sections)
    out = concepts.select("name", F.lower(F.trim("layer")).alias("layer"), "role", "deps", title.alias("section"), at.alias("section_place"))
    if overrides is not None:
        own = overrides.select(F.lower("name").alias("_name"), F.col("role").alias("_role"), "hub_class")
        out = out.join(own, F.lower("name") == F.col("_name"), "left").withColumn("role", F.coalesce(F.nullif(F.trim("_role"), F.lit("")), "role"))
        out = out.withColumn("role", F.when(F.coalesce(F.trim("hub_class"), F.lit("")) != "", F.concat("role", F.lit(" (hub: "), F.trim("hub_class"), F.lit(")"))).otherwise(F.col("role")))
    none = F.when(F.col("layer") == "primitive", "None (primitive)").when(F.col("layer") == "foundational", "None (axiomatic)").otherwise("None")
    deps = F.array_join(F.transform(F.array_sort(F.coalesce("deps", F.array().cast("array<string>"))), lambda d: F.concat(F.lit("[["), d, F.lit("]]"))), ", ")
    line = F.concat(F.lit("| [["), "name", F.lit("]] | "), F.coalesce("role", F.lit("")), F.lit(" | "), F.when(deps == "", none).otherwise(deps), F.lit(" |"))
    rank = F.lit(None).cast("int")
    for section, names in (orders or {}).items():
        rank = F.when(F.lower("section") == section.strip().lower(), F.nullif(F.array_position(F.array(*[F.lit(n.strip().lower()) for n in names]), F.lower("name")), F.lit(0)).cast("int")).otherwise(rank)
    out = out.withColumn("_rank", rank).withColumn("line", line)
    order = Window.partitionBy("section").orderBy(F.col("_rank").asc_nulls_last(), F.lower("name"), "name")
    return out.select("section", "section_place", F.row_number().over(order).alias("place"), "name", "line")


def text(found: DataFrame) -> DataFrame:
    """(text): the registry as one text, sections in order."""
    per = found.groupBy("section", "section_place").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("_lines"))
    block = F.concat(F.array(F.concat(F.lit("### Concepts :: "), "section"), *map(F.lit, HEAD)), F.transform("_lines", lambda x: x["line"]), F.array(F.lit("")))
    whole = per.select("section_place", "section", F.array_join(block, "\n").alias("t")).agg(F.array_sort(F.collect_list(F.struct("section_place", "section", "t"))).alias("s"))
    return whole.select(F.concat(F.btrim(F.array_join(F.transform("s", lambda x: x["t"]), "\n"), F.lit(" \n")), F.lit("\n")).alias("text"))


def stored_tables(note: Column) -> Column:
    """The lines of a registry note inside its ``### Concepts ::`` blocks: from such a heading to the next heading of another kind."""
    lines = F.split(note, r"\r?\n")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        opens = line.startswith("### Concepts ::")
        inside = opens | (acc.inside & ~line.rlike(r"^#{1,6} "))
        return F.struct(inside.alias("inside"), F.when(inside, F.concat(acc.kept, F.array(F.rtrim(line)))).otherwise(acc.kept).alias("kept"))

    return F.aggregate(lines, start, step, lambda acc: acc.kept)


def drift(found: DataFrame, notes: DataFrame) -> DataFrame:
    """(status, kind, line): whether the stored registry says what the concepts say.

    ``notes`` has (name, role, content).  The registry is the one note of role
    ``registry``, else the one whose name contains it; none is ``ok``, several are
    an ``error``.  Otherwise one row for each line only one side has, ``missing``
    from the stored text or ``stale`` in it, or one row ``ok``.
    """
    spark = found.sparkSession
    by_role = notes.where(F.lower(F.trim("role")) == "registry").limit(2).collect()
    candidates = by_role or notes.where(F.lower("name").contains("registry")).limit(2).collect()
    schema = "status string, kind string, line string"
    if not candidates:
        return spark.createDataFrame([("ok", "no registry", None)], schema)
    if len(candidates) > 1:
        return spark.createDataFrame([("error", "several registries", None)], schema)
    stored = spark.createDataFrame([(candidates[0]["content"],)], "note string").select(F.explode(stored_tables(F.col("note"))).alias("line")).where(F.col("line").startswith("| [["))
    now = found.select("line")
    sides = now.exceptAll(stored).select(F.lit("drift").alias("status"), F.lit("missing").alias("kind"), "line").unionByName(stored.exceptAll(now).select(F.lit("drift").alias("status"), F.lit("stale").alias("kind"), "line"))
    fine = spark.createDataFrame([("ok", "current", None)], schema)
    return sides.unionByName(fine.join(F.broadcast(sides.agg(F.count(F.lit(1)).alias("_n"))).where("_n = 0")).select("status", "kind", "line"))
