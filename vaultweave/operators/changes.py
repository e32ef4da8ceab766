"""Structural change: what differs between two states of the same notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_SECTIONS = ["Definition", "What this is NOT", "Structural dependencies"]
_EMPTY = "array<string>"


def classify(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per note of either state, with what changed.

    Both have (note_id, role, layer, deps, links, sections, aliases, definition);
    a note missing from one state counts as empty there, null arrays likewise.
    ``change_types`` is never empty: ``unknown`` stands where nothing differs.
    ``ambiguity_delta`` falls with each dependency or key section added and rises
    with each removed.  ``note_id`` must be unique in each state.
    """
    fields = ["role", "layer", "deps", "links", "sections", "aliases", "definition"]
    side = lambda df, p: df.select("note_id", *[F.col(f).alias(f"{p}_{f}") for f in fields])
    both = side(before, "b").join(side(after, "a"), "note_id", "full")
    arr = lambda c: F.coalesce(F.col(c), F.array().cast(_EMPTY))
    added = lambda f: F.array_sort(F.array_except(arr(f"a_{f}"), arr(f"b_{f}")))
    removed = lambda f: F.array_sort(F.array_except(arr(f"b_{f}"), arr(f"a_{f}")))
    free = lambda p: F.array_except(arr(f"{p}_links"), arr(f"{p}_deps"))
    links_added, links_removed = F.array_sort(F.array_except(free("a"), free("b"))), F.array_sort(F.array_except(free("b"), free("a")))
    key = F.array(*map(F.lit, KEY_SECTIONS))
    changed = lambda f: ~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}"))
    has_definition = F.array_contains(arr("b_sections"), "Definition") | F.array_contains(arr("a_sections"), "Definition")
    some = lambda c: F.size(c) > 0
    alias_change = some(F.array_except(arr("a_aliases"), arr("b_aliases"))) | some(F.array_except(arr("b_aliases"), arr("a_aliases")))
    tests: list[tuple[str, Column]] = [
        ("dependency_addition", some(added("deps"))), ("dependency_removal", some(removed("deps"))), ("link_addition", some(links_added)), ("link_removal", some(links_removed)),
        ("section_addition", some(added("sections"))), ("section_removal", some(removed("sections"))), ("definition_refinement", has_definition & changed("definition")),
        ("role_change", changed("role")), ("layer_change", changed("layer")), ("alias_change", alias_change),
    ]
    kinds = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    key_added, key_removed = F.size(F.array_intersect(added("sections"), key)), F.size(F.array_intersect(removed("sections"), key))
    delta = F.size(removed("deps")) - F.size(added("deps")) + key_removed - key_added
    return both.select(
        "note_id", F.when(some(kinds), kinds).otherwise(F.array(F.lit("unknown"))).alias("change_types"), added("deps").alias("dependencies_added"), removed("deps").alias("dependencies_removed"),
        links_added.alias("links_added"), links_removed.alias("links_removed"), added("sections").alias("sections_added"), removed("sections").alias("sections_removed"),
        F.col("b_role").alias("role_before"), F.col("a_role").alias("role_after"), F.col("b_layer").alias("layer_before"), F.col("a_layer").alias("layer_after"),
        delta.alias("ambiguity_delta"), F.when(some(added("deps")), F.lit("decomposition")).alias("improved"),
    )


def summary(changes: DataFrame) -> DataFrame:
    """(change_type, n, ambiguity): how often each type occurs and the ambiguity of those changes."""
    return changes.select(F.explode("change_types").alias("change_type"), "ambiguity_delta").groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.sum("ambiguity_delta").alias("ambiguity"))
