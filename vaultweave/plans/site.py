"""Site queries: wikilinks in parts, callouts, tasks, blocks, link strategies, scopes, partial rebuilds, sitemap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.functions import show, site, slugs
from vaultweave.operators import files, guard, ordering, resolve
from vaultweave.operators.highlight import marked
from vaultweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


_SITE_LINK = r"!?\[\[(?:[^\[\]|#\\]+)?(?:#+[^\[\]|#\\]+)?(?:\\?\|[^\[\]#]*)?\]\]"


@query(
    rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '{_SITE_LINK}', 0) AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM a)),
      h AS (SELECT *, trim(regexp_replace(regexp_extract(l, '(#+[^\[\]|#\\]+)', 1), '^#+', '')) AS anchor FROM e)
    SELECT doc_id, CAST(i AS INTEGER) AS pos, starts_with(l, '!') AS embed, nullif(trim(regexp_extract(l, '\[\[([^\[\]|#\\]+)', 1)), '') AS target, CASE WHEN NOT starts_with(anchor, '^') THEN nullif(anchor, '') END AS heading,
      CASE WHEN starts_with(anchor, '^') THEN substr(anchor, 2) END AS block, nullif(trim(regexp_extract(l, '\|([^\[\]#]*)\]\]', 1)), '') AS alias FROM h"""
)
def site_links(spark, sf):
    """Wikilinks of each document in their parts."""
    found = _docs(spark, sf).select("doc_id", F.posexplode(site.site_links(F.col("text"))).alias("p", "x"))
    return found.select("doc_id", (F.col("p") + 1).alias("pos"), "x.*")


_KINDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in site.CALLOUTS.items()) + "}"


@query(
    rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^> *(\[![A-Za-z0-9_-]+[^\]\r\n]*\][^\r\n]*)', 1)) AS l FROM documents), k AS (SELECT doc_id, regexp_extract(l, '\[!([A-Za-z0-9_-]+)', 1) AS raw FROM a)
    SELECT doc_id, coalesce({_KINDS}[lower(raw)], raw) AS kind, count(*) AS n FROM k GROUP BY 1, 2"""
)
def site_callouts(spark, sf):
    """Callouts of each document by canonical kind."""
    return _docs(spark, sf).select("doc_id", F.explode(site.callouts(F.col("text"))).alias("c")).groupBy("doc_id", F.col("c.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^[ \t]*[-*+] \[ \] ')) AS INTEGER) AS open, CAST(len(regexp_extract_all(text, '(?m)^[ \t]*[-*+] \[[xX]\] ')) AS INTEGER) AS done,
      CAST(len(regexp_extract_all(text, '==([^=]+)==', 1)) AS INTEGER) AS highlights, CAST(len(regexp_extract_all(text, '(?m)(?:^|[ \t])\^([-_A-Za-z0-9]+)[ \t\r]*$', 1)) AS INTEGER) AS blocks, length(regexp_replace(text, '(?s)%%.*?%%', '', 'g')) AS n_chars FROM documents WHERE text IS NOT NULL"""
)
def site_marks(spark, sf):
    """Task items, highlights and block references of each document, and its length without comments."""
    t = F.col("text")
    open_, done = site.checkboxes(t)
    return _docs(spark, sf).where("text is not null").select("doc_id", open_.alias("open"), done.alias("done"), F.size(site.highlights(t)).alias("highlights"), F.size(site.block_references(t)).alias("blocks"), F.length(site.without_comments(t)).cast("long").alias("n_chars"))


_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"


@query(
    rf"""WITH l AS (SELECT DISTINCT trim(lower(unnest(regexp_extract_all(text, '{_LINK}', 1)))) AS link FROM documents), p AS (SELECT link, replace(regexp_replace(link, '\.md$', ''), ' ', '-') AS slug FROM l WHERE regexp_matches(link, '^[a-z0-9/ .-]+$') AND NOT ends_with(link, '/') AND NOT contains(link, 'index') AND NOT starts_with(link, '.') AND NOT starts_with(link, '/')),
      n AS (SELECT regexp_replace(path, '\.md$', '') AS slug FROM notes UNION ALL SELECT regexp_replace(path, '\.md$', '') FROM concepts), u AS (SELECT split_part(slug, '/', -1) AS name, min(slug) AS slug FROM n GROUP BY 1 HAVING count(*) = 1)
    SELECT link, './' || p.slug AS relative, '../../' || p.slug AS absolute, '../../' || coalesce(u.slug, p.slug) AS shortest FROM p LEFT JOIN u ON u.name = p.slug"""
)
def site_hrefs(spark, sf):
    """Where each link of a page two folders deep leads by each strategy."""
    links = _docs(spark, sf).select(F.explode(md.links(F.col("text"))).alias("link")).distinct()
    plain = F.col("link").rlike(r"^[a-z0-9/ .-]+$") & ~F.col("link").endswith("/") & ~F.col("link").contains("index") & ~F.col("link").startswith(".") & ~F.col("link").startswith("/")
    links = links.where(plain).select(F.lit("a/b/c").alias("page"), "link")
    pages = table(spark, sf, "notes").select("path").unionByName(table(spark, sf, "concepts").select("path")).select(slugs.slugify_path(F.col("path")).alias("slug"))
    of = lambda s: resolve.transform_links(links, pages, s).select("link", F.col("href").alias(s))
    return reduce(lambda a, b: a.join(b, "link"), map(of, ("relative", "absolute", "shortest")))


@query(
    """WITH s AS (SELECT note_id, lower(path) AS p, path FROM notes) SELECT note_id, CASE WHEN contains(p, 'registry') AND (ends_with(p, '.md') OR ends_with(p, '.yml') OR ends_with(p, '.yaml')) THEN 'registry' WHEN ends_with(p, '.md') THEN 'vault_note'
      WHEN ends_with(p, '.yml') OR ends_with(p, '.yaml') OR ends_with(p, '.toml') THEN 'config' ELSE 'unknown' END AS scope, NOT regexp_matches(path, '(^|/)[.]') AND regexp_matches(p, '[.](md|yml|yaml|toml)$') AS relevant FROM s"""
)
def note_scopes(spark, sf):
    """What each path holds and whether a watcher follows it."""
    return table(spark, sf, "notes").select("note_id", files.scope_of(F.col("path")).alias("scope"), files.is_relevant(F.col("path")).alias("relevant"))


@query(
    """WITH p AS (SELECT regexp_replace(path, '[.]md$', '') AS slug, kind, vault, modified FROM notes), c AS (SELECT DISTINCT slug FROM p WHERE modified >= TIMESTAMP '2024-06-01')
    SELECT 'page' AS kind, slug AS name FROM c UNION SELECT 'folder', split_part(slug, '/', 1) FROM c WHERE contains(slug, '/')
    UNION SELECT 'tag', p.kind FROM p WHERE slug IN (SELECT slug FROM c) UNION SELECT 'tag', p.kind || '/' || p.vault FROM p WHERE vault IS NOT NULL AND slug IN (SELECT slug FROM c)"""
)
def affected_pages(spark, sf):
    """Pages, folders and tags to write anew after the notes modified since a day."""
    slug = slugs.slugify_path(F.col("path"))
    notes = table(spark, sf, "notes")
    changed = notes.where(F.col("modified") >= F.lit("2024-06-01").cast("timestamp_ntz")).select(slug.alias("slug"))
    return files.affected(changed, notes.select(slug.alias("slug"), F.array(F.concat_ws("/", "kind", "vault")).alias("tags")))


@query(
    """WITH s AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM events), g AS (SELECT ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS run FROM s)
    SELECT min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY run"""
)
def settled_rebuilds(spark, sf):
    """Rebuilds, each after five quiet minutes."""
    return files.settled(table(spark, sf, "events"), "ts", "5 minutes")


@query(
    """WITH e AS (SELECT event_type AS kind, 'shard-' || user_id % 4 AS scope, ts, CAST(floor(value) AS BIGINT) AS bytes_erased FROM events)
    SELECT 'kind' AS by, kind AS name, count(*) AS n, CAST(sum(bytes_erased) AS BIGINT) AS bytes_erased, min(ts) AS first_at, max(ts) AS last_at FROM e GROUP BY kind
    UNION ALL SELECT 'scope', scope, count(*), CAST(sum(bytes_erased) AS BIGINT), min(ts), max(ts) FROM e GROUP BY scope"""
)
def file_event_summary(spark, sf):
    """Events by kind and by scope."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("shard-"), F.col("user_id") % 4).alias("scope"), "ts", F.floor("value").alias("bytes_erased"))
    return files.event_summary(e)


_FILE_EVENTS = "WITH e AS (SELECT event_id AS seq, 'f-' || user_id AS path, CASE event_type WHEN 'error' THEN 'file_deleted' WHEN 'signup' THEN 'file_created' ELSE 'file_modified' END AS kind, CAST(round(value) AS BIGINT) AS size FROM events)"


def _file_events(spark, sf) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "file_deleted").when(F.col("event_type") == "signup", "file_created").otherwise("file_modified")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("f-"), F.col("user_id")).alias("path"), kind.alias("kind"), F.round("value").cast("long").alias("size"))


@query(
    f"""{_FILE_EVENTS}, l AS (SELECT *, last_value(CASE WHEN kind <> 'file_deleted' THEN size END IGNORE NULLS) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT seq, path, CASE WHEN kind = 'file_deleted' THEN coalesce(before, 0) ELSE 0 END AS bytes_erased FROM l WHERE kind = 'file_deleted'"""
)
def erased_bytes(spark, sf):
    """What each deletion erases: the size its path had last."""
    return files.with_erasure(_file_events(spark, sf)).where("kind = 'file_deleted'").select("seq", "path", "bytes_erased")


@query(
    f"""{_FILE_EVENTS}, s AS (SELECT path, arg_max(size, seq) AS size FROM e WHERE seq <= 300 GROUP BY 1), c AS (SELECT path, arg_max(kind, seq) AS kind, arg_max(size, seq) AS size FROM e WHERE seq > 300 GROUP BY 1)
    SELECT path, size FROM s WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, size FROM c WHERE kind <> 'file_deleted'"""
)
def incremental_state(spark, sf):
    """The state after event 300 brought up to date by what follows."""
    e = _file_events(spark, sf)
    state = e.where("seq <= 300").groupBy("path").agg(F.max_by("size", "seq").alias("size"))
    return files.incremental(state, e.where("seq > 300"))


@query(
    r"""SELECT doc_id, '<url><loc>https://example.org/documents/' || doc_id || '</loc>' || CASE WHEN updated_at IS NULL THEN '' ELSE '<lastmod>' || strftime(updated_at, '%Y-%m-%d') || '</lastmod>' END || '</url>' AS entry FROM documents"""
)
def sitemap(spark, sf):
    """The sitemap's entry of each document."""
    day = F.when(F.col("updated_at").isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format("updated_at", "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<url><loc>https://example.org/documents/"), F.col("doc_id"), F.lit("</loc>"), day, F.lit("</url>")).alias("entry"))


@query(
    """SELECT event_id, CASE WHEN value < 1000 THEN CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || 'ms' END AS short, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, CASE event_type WHEN 'signup' THEN 'proposed' WHEN 'view' THEN 'ready for approval' WHEN 'purchase' THEN 'done' ELSE event_type END AS status FROM events"""
)
def formatted_events(spark, sf):
    """Durations, times and states as a reader sees them."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "validated").when(F.col("event_type") == "purchase", "executed").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", show.duration(F.col("value")).alias("short"), show.moment(F.col("ts")).alias("moment"), show.status_word(kind).alias("status"))


@query(
    """SELECT event_id, CASE WHEN user_id % 6 = 0 THEN 'read_only' WHEN user_id % 6 = 1 AND user_id % 4 = 1 THEN 'mutation_destructive' WHEN user_id % 6 = 1 THEN 'external_side_effect'
      WHEN value > 90 THEN 'mutation_destructive' WHEN value > 60 THEN 'external_side_effect' WHEN user_id % 6 = 2 OR value > 30 THEN 'mutation_reversible' ELSE 'external_side_effect' END AS risk FROM events"""
)
def risk_classes(spark, sf):
    """The risk class of each event read as a planned operation."""
    k = F.col("user_id") % 6
    op = F.when(k == 0, "lint").when(k == 1, "graph.load").when(k == 2, "registry.build").otherwise("other")
    effects = F.struct((F.col("value") > 60).alias("network"), (F.col("value") > 90).alias("destructive"), (F.col("value") > 30).alias("writes"), F.lit(False).alias("append_only"))
    effects_type = "struct<network:boolean,destructive:boolean,writes:boolean,append_only:boolean>"
    none = F.lit(None).cast(effects_type)
    mode = F.when((k == 1) & (F.col("user_id") % 4 == 1), "rebuild").otherwise("sync")
    given = F.when(k > 1, effects.cast(effects_type)).otherwise(none)
    return table(spark, sf, "events").select("event_id", guard.risk(op, mode, given).alias("risk"))


@query("SELECT name, CAST(row_number() OVER (ORDER BY CASE name WHEN 'yoke' THEN 1 WHEN 'plateau' THEN 2 ELSE 3 END, lower(name)) AS BIGINT) AS number FROM concepts")
def listed_concepts(spark, sf):
    """Concepts, those of a list first in its order, the others by name, numbered."""
    return ordering.numbered(table(spark, sf, "concepts").select("name"), *ordering.listed_first("name", ["yoke", "Plateau"]))


@query("SELECT name, concept_id FROM concepts WHERE name = 'plateau'")
def named_concept(spark, sf):
    """The concept a name means."""
    return resolve.named(table(spark, sf, "concepts"), "Plateau").select("name", "concept_id")


@query(
    """WITH d AS (SELECT DISTINCT split_part(path, '/', 1) AS folder FROM notes), a AS (SELECT kind || 's' AS folder, min(title) AS title FROM notes WHERE kind <> 'domain' GROUP BY 1)
    SELECT folder, coalesce(a.title, 'Folder: ' || folder) AS title, a.folder IS NOT NULL AS authored FROM d LEFT JOIN a USING (folder)"""
)
def folder_pages(spark, sf):
    """Folder pages, by what an author wrote where there is such a page."""
    notes = table(spark, sf, "notes")
    folders = notes.select(F.substring_index("path", "/", 1).alias("folder")).distinct().withColumn("title", F.concat(F.lit("Folder: "), "folder"))
    authored = notes.where("kind <> 'domain'").groupBy(F.concat("kind", F.lit("s")).alias("folder")).agg(F.min("title").alias("title"))
    return resolve.overlaid(folders, authored, "folder")



@query(
    r"""WITH t AS (SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)), ''), 'note-' || doc_id) AS title FROM documents)
    SELECT doc_id, trim(regexp_replace(' ' || replace(title, ' ', '  ') || ' ', '([^\pL\pN_])((?i:seam|harb)[\pL\pN_]*)', '\1<mark>\2</mark>', 'g')) AS title FROM t"""
)
def marked_titles(spark, sf):
    """Titles with the words that begin with a search term marked."""
    title = md.title(F.col("text"), F.concat(F.lit("note-"), F.col("doc_id")))
    return _docs(spark, sf).select("doc_id", F.trim(F.replace(marked(title, ["seam", "harb"]), F.lit(" "), F.lit("  "))).alias("title"))
