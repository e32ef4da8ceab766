"""Names, aliases and slugs to notes; listings by tag and folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultweave.functions import site
from vaultweave.functions.markdown import heading_slug
from vaultweave.functions.slugs import folder, segment_prefixes
from vaultweave.session import written


def resolve_links(links: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``links`` (link) with ``target``: the note of that name, else of that alias, else null.

    ``names`` has (name), ``aliases`` (alias, canonical), in lower case; of
    several canonical names the smallest counts.
    """
    known = names.select(F.col("name").alias("link"), F.col("name").alias("_by_name")).distinct()
    out = links.join(known, "link", "left")
    if aliases is None:
        return out.withColumnRenamed("_by_name", "target")
    other = aliases.groupBy(F.col("alias").alias("link")).agg(F.min("canonical").alias("_by_alias"))
    return out.join(other, "link", "left").withColumn("target", F.coalesce("_by_name", "_by_alias")).drop("_by_name", "_by_alias")


def shortest_links(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """``links`` (link) with ``slug``: the only page of that file name, else the link itself from the root."""
    last = F.substring_index("slug", "/", -1)
    unique = slugs.groupBy(last.alias("link")).agg(F.min("slug").alias("_slug"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return links.join(unique, "link", "left").withColumn("slug", F.coalesce("_slug", "link")).drop("_slug")


def backlinks(links: DataFrame) -> DataFrame:
    """(target, sources, n): how many notes link to each target, and how often."""
    return links.groupBy("target").agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("n"))


def by_prefix(pages: DataFrame, path: str, first: int = 10, order: Sequence[str | Column] = ("page",)) -> tuple[DataFrame, DataFrame]:
    """(prefix, pages) counts and (prefix, page, k) listings over every prefix of a ``/`` path; a page counts once per prefix."""
    spread = pages.select("page", F.explode(segment_prefixes(F.col(path))).alias("prefix")).distinct()
    counts = spread.groupBy("prefix").agg(F.count(F.lit(1)).alias("pages"))
    k = F.row_number().over(Window.partitionBy("prefix").orderBy(*order))
    return counts, spread.withColumn("k", k).where(F.col("k") <= first)


def folder_dates(pages: DataFrame, path: str, dates: Sequence[str]) -> DataFrame:
    """(folder, pages, dates...): the latest of each date by folder."""
    return pages.groupBy(folder(F.col(path)).alias("folder")).agg(F.count(F.lit(1)).alias("pages"), *[F.max(d).alias(d) for d in dates])


def ancestry(paths: DataFrame, path: str) -> DataFrame:
    """(path, depth, crumb): each page's chain of folders and itself, from the root."""
    named = paths.select(F.col(path).alias("path"))
    return named.select("path", F.posexplode(segment_prefixes(named.path)).alias("depth", "crumb"))


def transform_links(links: DataFrame, slugs: DataFrame, strategy: str = "shortest") -> DataFrame:
    """``links`` (page, link) with ``href``: where each link of a page leads, by one of three strategies.

    ``relative`` takes the link as it is; ``absolute`` from the root; ``shortest``
    by its file name if only one of ``slugs`` (slug) has it, else from the root.
    """
    if strategy not in ("relative", "absolute", "shortest"):
        raise ValueError("strategy must be relative, absolute or shortest")
    out = links.withColumn("_rel", site.internal_link(F.col("link")))
    if strategy == "relative":
        return out.withColumnRenamed("_rel", "href")
    canonical = site.strip_slashes(F.regexp_replace("_rel", r"^\.", ""))
    tail = F.when(site.is_folder_path(F.col("_rel")), F.lit("/")).otherwise(F.lit(""))
    out = out.withColumn("_canonical", canonical).withColumn("_name", F.substring_index("_canonical", "#", 1)).withColumn("_anchor", F.when(F.col("_canonical").contains("#"), F.concat(F.lit("#"), F.regexp_extract("_canonical", "#(.*)$", 1))).otherwise(F.lit("")))
    href = F.concat(site.join_segments(site.path_to_root(F.col("page")), F.col("_canonical")), tail)
    if strategy == "shortest":
        last = F.substring_index("slug", "/", -1)
        unique = slugs.groupBy(last.alias("_name")).agg(F.min("slug").alias("_slug"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        out = out.join(unique, "_name", "left")
        href = F.when(F.col("_slug").isNotNull(), F.concat(site.resolve_relative(F.col("page"), F.col("_slug")), F.col("_anchor"))).otherwise(href)
    return out.withColumn("href", href).select(*links.columns, "href")


def named(notes: DataFrame, asked: str, name: str = "name") -> DataFrame:
    """The notes a name means: those of exactly that name, else those that contain it, whatever its case; see :func:`one`."""
    low = asked.strip().lower()
    hits = notes.where(F.lower(name).contains(low)).withColumn("_exact", F.lower(name) == low)
    best = hits.agg(F.bool_or("_exact").alias("_any"))
    return hits.join(F.broadcast(best)).where(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def one(found: DataFrame, asked: str):
    """The single row of :func:`named`; raises if there is none or the name is ambiguous."""
    rows = found.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{asked!r} names {'nothing' if not rows else 'several notes'}")
    return rows[0]


def overlaid(default: DataFrame, authored: DataFrame, key: str) -> DataFrame:
    """Pages made by default with what an authored page of the same ``key`` says instead, column by column."""
    own = [c for c in default.columns if c != key and c in authored.columns]
    over = authored.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_own_{c}") for c in own], F.lit(True).alias("authored"))
    out = default.join(over, key, "left")
    return out.select(key, *[F.coalesce(f"_own_{c}", c).alias(c) if c in own else F.col(c) for c in default.columns if c != key], F.coalesce("authored", F.lit(False)).alias("authored"))


def transcluded(pages: DataFrame, depth: int = 5) -> DataFrame:
    """(slug, text): pages with every embedded page, heading or block put in its place, ``depth`` levels deep.

    ``pages`` has (slug, text).  ``![[page]]`` stands for a page, with ``#heading``
    for the section to the next heading of its level or above, with ``#^block`` for
    the line that ends so.  An embed of a page within itself, at any level, and
    one of an unknown page stay as they are written.
    """
    base = written(pages.select("slug", "text", F.lower(F.substring_index("slug", "/", -1)).alias("_name")), "pages")
    names = base.groupBy("_name").agg(F.min_by("text", "slug").alias("_inner"), F.min("slug").alias("_of"))
    # One row per piece of a page, in order: text, or an embed with the pages it lies within.
    cut = lambda t: F.regexp_extract_all(t, F.lit(r"!\[\[[^\[\]]+\]\]|(?:(?!!\[\[[^\[\]]+\]\])[\s\S])+"), F.lit(0))
    state = base.select("slug", F.posexplode(cut(F.col("text"))).alias("p", "piece"), F.array("_name").alias("within")).select("slug", F.array("p").alias("at"), "piece", "within")
    for _ in range(depth):
        link = F.element_at(site.site_links(F.col("piece")), 1)
        is_embed = F.col("piece").rlike(r"^!\[\[[^\[\]]+\]\]$")
        marked = state.withColumn("_l", F.when(is_embed, link)).withColumn("_name", F.lower(F.substring_index("_l.target", "/", -1)))
        joined = marked.join(names, "_name", "left")
        fits_in = F.col("_of").isNotNull() & ~F.array_contains("within", F.col("_name"))
        inner = F.when(F.col("_l.block").isNotNull(), _block(F.col("_inner"), F.col("_l.block"))).when(F.col("_l.heading").isNotNull(), _section(F.col("_inner"), F.col("_l.heading"))).otherwise(F.col("_inner"))
        opened = joined.withColumn("_pieces", F.when(fits_in, cut(inner)))
        kept = opened.where("_pieces is null").select("slug", "at", "piece", "within")
        grown = opened.where("_pieces is not null").select("slug", "at", "_name", "within", F.posexplode("_pieces").alias("p", "piece"))
        state = written(kept.unionByName(grown.select("slug", F.concat("at", F.array("p")).alias("at"), "piece", F.concat("within", F.array("_name")).alias("within"))), "pages")
    order = F.array_sort(F.collect_list(F.struct("at", "piece")))
    whole = state.groupBy("slug").agg(F.array_join(F.transform(order, lambda x: x["piece"]), "").alias("text"))
    return base.select("slug").join(whole, "slug", "left")


def _section(text, heading):
    """From a heading (by its slug) to the next of its level or above."""
    lines = F.split(text, "\n")
    level = lambda x: F.length(F.regexp_extract(x, "^(#{1,6}) ", 1))
    slug = heading_slug(heading)
    start = F.array_position(F.transform(lines, lambda x: (level(x) > 0) & (heading_slug(F.regexp_replace(x, r"^#{1,6} +|\r$", "")) == slug)), F.lit(True)).cast("int")
    own = level(F.try_element_at(lines, start))
    rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    ends = F.array_position(F.transform(rest, lambda x: (level(x) > 0) & (level(x) <= own)), F.lit(True)).cast("int")
    body = F.when(ends > 0, F.slice(rest, F.lit(1), ends - 1)).otherwise(rest)
    return F.when(start > 0, F.array_join(F.concat(F.slice(lines, start, F.lit(1)), body), "\n")).otherwise(F.lit(""))


def _block(text, name):
    """The line that ends with a block id, without it."""
    hit = F.filter(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(" \t\r")).endswith(F.concat(F.lit("^"), name)))
    return F.coalesce(F.rtrim(F.substring_index(F.try_element_at(hit, F.lit(1)), "^", 1)), F.lit(""))
