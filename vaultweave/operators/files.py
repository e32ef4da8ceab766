"""File-system events of a vault: scopes, relevance, moves, what is erased, and the logs they go to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings a watcher follows, names of configuration files, kinds of events and artifacts.
RELEVANT = (".md", ".yml", ".yaml", ".toml")
CONFIGS = ("pyproject.toml", "hubs.yml", "registry.overrides.yml")


def scope_of(path: Column, inside: Column | None = None) -> Column:
    """What a path holds: registry, vault_note, config, rules or unknown.

    Paths are relative to the vault where ``inside`` holds (everywhere if not
    given); outside it only known configuration and rule files are told.
    """
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.substring_index(low, "/", -1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    within = F.when(low.contains("registry") & ext.isin(".md", ".yml", ".yaml"), "registry").when(ext == ".md", "vault_note").when(ext.isin(".yml", ".yaml", ".toml"), "config").otherwise("unknown")
    beyond = F.when(name.isin(*CONFIGS), "config").when(path.contains("rules.py") | path.contains("invariants.py"), "rules").otherwise("unknown")
    return within if inside is None else F.when(inside, within).otherwise(beyond)


def is_relevant(path: Column, scopes: Sequence[str] = ()) -> Column:
    """Whether a watcher follows a path: nothing hidden in it, a known ending, one of ``scopes`` if given."""
    visible = ~F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"(^|/)\.")
    known = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*RELEVANT)
    return visible & known & (scope_of(path).isin(*scopes) if scopes else F.lit(True))


def moves(events: DataFrame, source: str = "source", target: str = "target", scopes: Sequence[str] = ()) -> DataFrame:
    """``events`` with ``kind`` and ``path``: a rename inside the scope, a deletion out of it, a creation into it; others are left out."""
    a, b = is_relevant(F.col(source), scopes), is_relevant(F.col(target), scopes)
    kind = F.when(a & b, "file_renamed").when(a, "file_deleted").when(b, "file_created")
    return events.withColumn("kind", kind).where("kind is not null").withColumn("path", F.when(F.col("kind") == "file_deleted", F.col(source)).otherwise(F.col(target)))


def with_erasure(events: DataFrame, path: str = "path", kind: str = "kind", size: str = "size", order: str = "seq") -> DataFrame:
    """``events`` with ``bytes_erased``: a deletion erases the size its path had last."""
    from pyspark.sql import Window

    before = F.last(F.when(F.col(kind) != "file_deleted", F.col(size)), ignorenulls=True).over(Window.partitionBy(path).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("bytes_erased", F.when(F.col(kind) == "file_deleted", F.coalesce(before, F.lit(0))).otherwise(F.lit(0)).cast("long"))


def affected(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """(kind, name): pages, folders and tags to be written anew after some slugs (slug) changed; ``pages`` has (slug, tags)."""
    from vaultweave.functions.slugs import folder, segment_prefixes

    hit = pages.join(changed.select("slug").distinct(), "slug", "left_semi")
    gone = changed.select("slug").distinct()
    one = gone.select(F.lit("page").alias("kind"), F.col("slug").alias("name"))
    up = gone.select(F.lit("folder").alias("kind"), F.explode(segment_prefixes(folder(F.col("slug")))).alias("name")).where("name <> ''")
    tags = hit.select(F.explode("tags").alias("t")).select(F.lit("tag").alias("kind"), F.explode(segment_prefixes(F.col("t"))).alias("name"))
    return one.unionByName(up).unionByName(tags).distinct()


def settled(batches: DataFrame, ts: str, wait: str = "250 milliseconds") -> DataFrame:
    """(started, ended, n): rebuilds after changes (ts): one for each stretch without a pause as long as ``wait``, the later changes superseding the earlier."""
    window = F.session_window(F.col(ts), wait)
    return batches.groupBy(window.alias("_w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n")).drop("_w")


def event_summary(events: DataFrame) -> DataFrame:
    """(by, name, n, bytes_erased, first_at, last_at): events by kind and by scope; ``events`` has (kind, scope, ts, bytes_erased)."""
    each = events.select(F.explode(F.array(F.struct(F.lit("kind").alias("by"), F.col("kind").alias("name")), F.struct(F.lit("scope").alias("by"), F.col("scope").alias("name")))).alias("x"), "ts", "bytes_erased")
    return each.groupBy(F.col("x.by").alias("by"), F.col("x.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_erased").alias("bytes_erased"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def incremental(state: DataFrame, changes: DataFrame, key: str = "path", order: str = "seq", kind: str = "kind") -> DataFrame:
    """``state`` after ``changes``: of each key the last change counts, deletions take it out, others replace it."""
    fields = [c for c in state.columns]
    last = changes.groupBy(key).agg(F.max_by(F.struct(kind, *[c for c in fields if c != key]), order).alias("_r"))
    fresh = last.where(F.col(f"_r.{kind}") != "file_deleted").select(key, *[F.col(f"_r.{c}").alias(c) for c in fields if c != key])
    return state.join(last.select(key), key, "left_anti").select(*fields).unionByName(fresh.select(*fields))
